"""Spoken-English scoring and correction as Spark DataFrame jobs."""
