"""Per-clip helpers that run inside the Arrow tasks: WAV bytes to samples to feature numbers."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np

from lingomark.functions.signal import FRAME_LENGTH, HOP_LENGTH

# Silence threshold, roll-off share, mel spectrogram and tempo settings.
SILENCE = 1e-10
ROLLOFF_SHARE = 0.85
MEL_FFT, MEL_HOP, MEL_BANDS = 400, 200, 128
TEMPO_PRIOR = 120.0
TEMPO_RANGE = (30.0, 300.0)
FRAMES_PER_BLOCK = 512

# Samples per channel that are decoded at a time.
BLOCK_SAMPLES = 1 << 18

ROW_FIELDS = [
    "sr",
    "channels",
    "n_samples",
    "duration",
    "zero_crossing_rate",
    "spectral_centroid",
    "rmse",
    "spectral_rolloff",
    "mel_power_mean",
    "tempo",
    "zero_crossing_global",
    "rms_global",
    "error",
]


def _values(raw: bytes, width: int) -> np.ndarray:
    """Samples in [-1, 1) of little-endian PCM bytes."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128.0) / 128.0
    if width == 3:
        triples = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3)
        wide = np.zeros((len(triples), 4), np.uint8)
        wide[:, 1:] = triples
        return wide.view("<i4")[:, 0] / 2147483648.0
    return np.frombuffer(raw[: len(raw) // width * width], f"<i{width}") / float(1 << (8 * width - 1))


def wav_blocks(content: bytes, seconds: float | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sample rate, channel count and consecutive blocks of samples (frames x channels)."""
    with wave.open(io.BytesIO(content)) as clip:
        rate, channels, width = clip.getframerate(), clip.getnchannels(), clip.getsampwidth()
        left = clip.getnframes() if seconds is None else min(clip.getnframes(), int(rate * seconds))
        if rate <= 0:
            raise ValueError("no audio data")
        found = False
        while left > 0:
            values = _values(clip.readframes(min(left, BLOCK_SAMPLES)), width)
            whole = len(values) // channels * channels
            if not whole:
                break
            found = True
            left -= whole // channels
            yield rate, channels, values[:whole].reshape(-1, channels)
    if not found:
        raise ValueError("no audio data")


def read_wav(content: bytes, seconds: float | None = None) -> tuple[int, int, np.ndarray]:
    """Sample rate, channel count and all samples (frames x channels)."""
    blocks = list(wav_blocks(content, seconds))
    return blocks[0][0], blocks[0][1], np.concatenate([samples for _, _, samples in blocks])


def write_wav(values, rate: int) -> bytes:
    """16-bit WAV bytes; a two-dimensional input is frames x channels."""
    array = np.asarray(values, dtype=np.float64)
    channels = 1 if array.ndim == 1 else array.shape[1]
    steps = np.clip(np.floor(array * 32768.0 + 0.5), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as clip:
        clip.setnchannels(channels)
        clip.setsampwidth(2)
        clip.setframerate(rate)
        clip.writeframes(steps.tobytes())
    return out.getvalue()


class Frames:
    """Centred overlapping frames of a signal that comes in blocks; a block's end is carried over.

    The signal is padded by half a frame on either side: with zeros, its edge values or its mirror image.
    """

    def __init__(self, length: int, hop: int, pad: str):
        self.length, self.hop, self.pad, self.half = length, hop, pad, length // 2
        self.held, self.tail, self.opened = np.zeros(0), np.zeros(0), False

    def _padding(self, near: np.ndarray, before: bool) -> np.ndarray:
        if self.pad == "constant":
            return np.zeros(self.half)
        if self.pad == "edge":
            return np.full(self.half, near[0] if before else near[-1])
        mirrored = near[1 : self.half + 1] if before else near[-self.half - 1 : -1]
        return mirrored[::-1]

    def _cut(self) -> Iterator[np.ndarray]:
        if len(self.held) < self.length:
            return
        view = np.lib.stride_tricks.sliding_window_view(self.held, self.length)[:: self.hop]
        for start in range(0, len(view), FRAMES_PER_BLOCK):
            yield view[start : start + FRAMES_PER_BLOCK]
        self.held = self.held[len(view) * self.hop :]

    def feed(self, samples: np.ndarray) -> Iterator[np.ndarray]:
        self.held = np.concatenate([self.held, samples])
        self.tail = np.concatenate([self.tail, samples])[-self.half - 1 :]
        if not self.opened:
            if len(self.held) <= self.half:
                return
            self.held, self.opened = np.concatenate([self._padding(self.held, True), self.held]), True
        yield from self._cut()

    def close(self) -> Iterator[np.ndarray]:
        """The frames at the signal's end. A signal too short to mirror has none with that padding."""
        if not self.opened:
            if self.pad == "reflect" or not len(self.tail):
                return
            self.held = np.concatenate([self._padding(self.tail, True), self.held])
        self.held = np.concatenate([self.held, self._padding(self.tail, False)])
        yield from self._cut()


def hann(length: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(length) / length)


class Crossings:
    """Mean share of sign changes per frame; values near zero count as positive."""

    def __init__(self):
        self.frames, self.total, self.count = Frames(FRAME_LENGTH, HOP_LENGTH, "edge"), 0.0, 0

    def add(self, blocks: Iterator[np.ndarray]) -> None:
        for block in blocks:
            changed = block[:, 1:] != block[:, :-1]
            self.total += float(np.count_nonzero(changed)) / FRAME_LENGTH
            self.count += len(block)

    def feed(self, samples: np.ndarray) -> None:
        self.add(self.frames.feed((np.where(np.abs(samples) <= SILENCE, 0.0, samples) < 0).astype(np.float64)))

    def mean(self) -> float:
        self.add(self.frames.close())
        return self.total / self.count


class Spectrum:
    """Mean centroid, roll-off and RMS over frames, and the spectral flux of each frame."""

    def __init__(self, rate: int):
        self.frames, self.window = Frames(FRAME_LENGTH, HOP_LENGTH, "constant"), hann(FRAME_LENGTH)
        self.bins = np.fft.rfftfreq(FRAME_LENGTH, 1.0 / rate)
        self.sums, self.flux, self.previous = np.zeros(3), [], None

    def add(self, blocks: Iterator[np.ndarray]) -> None:
        for block in blocks:
            magnitude = np.abs(np.fft.rfft(block * self.window, axis=1))
            total = magnitude.sum(axis=1)
            weighted = magnitude @ self.bins
            running = np.cumsum(magnitude, axis=1)
            reached = running >= ROLLOFF_SHARE * running[:, -1:]
            self.sums += (
                np.divide(weighted, total, out=np.zeros_like(total), where=total > 0).sum(),
                self.bins[np.argmax(reached, axis=1)].sum(),
                np.sqrt(np.mean(block * block, axis=1)).sum(),
            )
            loud = np.log1p(magnitude)
            before = np.vstack([loud[:1] if self.previous is None else self.previous, loud[:-1]])
            self.flux.append(np.maximum(loud - before, 0.0).sum(axis=1))
            self.previous = loud[-1:]

    def feed(self, samples: np.ndarray) -> None:
        self.add(self.frames.feed(samples))

    def means(self) -> tuple[float, float, float, np.ndarray]:
        self.add(self.frames.close())
        flux = np.concatenate(self.flux)
        return (*(self.sums / len(flux)).tolist(), flux)


def framed_zero_crossings(samples: np.ndarray) -> float:
    crossings = Crossings()
    crossings.feed(samples)
    return crossings.mean()


def framed_spectrum(samples: np.ndarray, rate: int) -> tuple[float, float, float, np.ndarray]:
    spectrum = Spectrum(rate)
    spectrum.feed(samples)
    return spectrum.means()


def mel_filters(rate: int) -> np.ndarray:
    """Triangular filters (bins x bands) on the 2595 * log10(1 + f / 700) scale, up to rate / 2."""
    bins = np.linspace(0.0, rate // 2, MEL_FFT // 2 + 1)
    top = 2595.0 * np.log10(1.0 + (rate / 2.0) / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, top, MEL_BANDS + 2) / 2595.0) - 1.0)
    rising = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[:-1]
    falling = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[1:]
    return np.maximum(0.0, np.minimum(rising, falling))


class MelPower:
    """Mean mel power over bands, frames and channels; None for clips too short to mirror."""

    def __init__(self, rate: int, channels: int):
        self.frames = [Frames(MEL_FFT, MEL_HOP, "reflect") for _ in range(channels)]
        self.window, self.filters = hann(MEL_FFT), mel_filters(rate)
        self.total, self.cells = 0.0, 0

    def add(self, blocks: Iterator[np.ndarray]) -> None:
        for block in blocks:
            mel = np.abs(np.fft.rfft(block * self.window, axis=1)) ** 2 @ self.filters
            self.total += float(mel.sum())
            self.cells += mel.size

    def feed(self, channels: np.ndarray) -> None:
        for frames, column in zip(self.frames, channels.T, strict=True):
            self.add(frames.feed(column))

    def mean(self) -> float | None:
        for frames in self.frames:
            self.add(frames.close())
        return self.total / self.cells if self.cells else None


def mel_power_mean(channels: np.ndarray, rate: int) -> float | None:
    power = MelPower(rate, channels.shape[1])
    power.feed(channels)
    return power.mean()


def tempo(flux: np.ndarray, rate: int) -> float | None:
    """Beats per minute at the strongest onset autocorrelation, weighted around the prior."""
    if len(flux) < 4 or not np.any(flux > 0):
        return None
    centred = flux - flux.mean()
    size = 1 << int(np.ceil(np.log2(2 * len(centred))))
    spectrum = np.fft.rfft(centred, size)
    strength = np.fft.irfft(np.abs(spectrum) ** 2, size)[: len(centred)]
    lags = np.arange(1, len(centred))
    beats = 60.0 * rate / (HOP_LENGTH * lags)
    usable = (beats >= TEMPO_RANGE[0]) & (beats <= TEMPO_RANGE[1])
    if not usable.any():
        return None
    prior = np.exp(-0.5 * np.log2(beats[usable] / TEMPO_PRIOR) ** 2)
    best = int(np.argmax(np.maximum(strength[lags[usable]], 0.0) * prior))
    return float(beats[usable][best])


class WholeClip:
    """Mean absolute step of the sign, and root mean square, over all samples of all channels."""

    def __init__(self):
        self.last, self.steps, self.squares, self.cells = None, 0.0, 0.0, 0

    def feed(self, channels: np.ndarray) -> None:
        signs = np.sign(channels)
        before = signs[:1] if self.last is None else self.last
        self.steps += float(np.abs(np.diff(np.concatenate([before, signs]), axis=0)).sum())
        self.squares += float((channels * channels).sum())
        self.cells += channels.size
        self.last = signs[-1:]

    def means(self) -> tuple[float, float]:
        moves = self.cells - self.last.size
        return self.steps / moves if moves else 0.0, float(np.sqrt(self.squares / self.cells))


def feature_row(content: bytes | None, with_tempo: bool = True) -> tuple:
    """One row of ``ROW_FIELDS``; a clip that cannot be read yields only its error.

    The clip is decoded block by block, so its length does not matter for memory: besides a block there
    is one number per frame, the flux that the tempo needs.
    """
    try:
        if content is None:
            raise ValueError("no audio data")
        parts, size = None, 0
        for rate, count, channels in wav_blocks(content):
            if parts is None:
                parts = Crossings(), Spectrum(rate), MelPower(rate, count), WholeClip()
            mono = channels.mean(axis=1)
            for part, samples in zip(parts, (mono, mono, channels, channels), strict=True):
                part.feed(samples)
            size += len(mono)
        crossings, spectrum, power, whole = parts
        centroid, rolloff, level, flux = spectrum.means()
        return (
            rate,
            count,
            size,
            size / rate,
            crossings.mean(),
            centroid,
            level,
            rolloff,
            power.mean(),
            tempo(flux, rate) if with_tempo else None,
            *whole.means(),
            None,
        )
    except Exception as error:  # an unreadable clip is a data error, not a task failure
        return (None,) * (len(ROW_FIELDS) - 1) + (str(error) or type(error).__name__,)


def decoded_row(content: bytes | None, seconds: float | None = None) -> tuple:
    try:
        if content is None:
            raise ValueError("no audio data")
        rate, count, channels = read_wav(content, seconds)
        return rate, count, channels.mean(axis=1).astype(np.float32), None
    except Exception as error:
        return None, None, None, str(error) or type(error).__name__
