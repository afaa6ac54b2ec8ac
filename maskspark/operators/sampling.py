"""Row samples below the masks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..registry import Sample


def sample(df: DataFrame, ratio: Sample) -> DataFrame:
    """Each row with the ratio's probability. SYSTEM, which takes pages, is a row sample as well, since files have none."""
    return df.sample(withReplacement=False, fraction=ratio.share, seed=ratio.seed)
