"""Bounded samples of labelled rows for the classifiers, and held-out marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_by_label(rows: DataFrame, label: str, per_label: int, key: str) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``; never more than
    twice that many times the number of labels.  Only one count per label reaches the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    wide = 1 << 24
    rate = F.lit(0)
    for value, n in sorted(counts.items()):
        rate = F.when(F.col(label) == value, F.lit(int(min(1.0, per_label / n) * wide))).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(wide)) < rate).limit(2 * per_label * max(1, len(counts)))
