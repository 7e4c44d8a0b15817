"""Small WAV fixtures."""

import numpy as np

from lingomark.sources.waveform import write_wav

RATE = 16000


def tone(frequency, seconds=1.0, level=0.5, rate=RATE):
    return level * np.sin(2 * np.pi * frequency * np.arange(int(rate * seconds)) / rate)


def clicks(per_minute, seconds=8.0, rate=RATE):
    wave = np.zeros(int(rate * seconds))
    step = int(rate * 60 / per_minute)
    for start in range(0, len(wave) - 200, step):
        wave[start : start + 200] = 0.8 * np.random.default_rng(0).normal(size=200).clip(-1, 1)
    return wave


def save(folder, name, samples, rate=RATE):
    path = folder / name
    path.write_bytes(write_wav(samples, rate))
    return path


def lookup_recogniser(transcripts):
    """A recogniser that knows the transcripts by clip name."""

    def load():
        def predict(names):
            for name in names:
                if name not in transcripts:
                    raise KeyError(f"no transcript for {name}")
            return [transcripts[name] for name in names]

        return predict

    return load
