"""Scoring and reporting of recorded model answers as Spark DataFrame jobs."""

from tallywright.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
