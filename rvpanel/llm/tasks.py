"""Small helpers that the operators share: Arrow batches inside tasks, bounded tables."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents whose words are held in Python at a time.
SLICE = 256


def text_slices(batch: pa.RecordBatch, column: str = "text", rows: int = SLICE) -> Iterator[tuple[int, list]]:
    """(first row, UTF-8 texts as bytes or None) of a few rows of the batch at a time."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    for start in range(0, batch.num_rows, rows):
        yield start, texts.slice(start, rows).to_pylist()



def on_executors(spark) -> None:
    """Ship this package to the executors, once per application, as ``--py-files`` would.

    Operators import it in their tasks; where it is installed on all machines this changes nothing.
    """
    context = spark.sparkContext
    if getattr(context, "_rvpanel_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-rvpanel-")) / "rvpanel_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._rvpanel_shipped = True


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def sent(spark, value):
    """``value`` behind a Spark broadcast: the driver's part of shipping a bounded table."""
    return spark.sparkContext.broadcast(value)



def most_frequent(counts: DataFrame, key: str, n: str, limit: int) -> list:
    """The ``limit`` rows with the largest ``n`` (ties: smaller key), collected: at most
    ``limit`` rows and a histogram of at most a few hundred lines reach the driver.

    The histogram of magnitudes gives a cut below which no row can be among them, so that
    only about ``limit`` rows are sorted, however many keys there are.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    taken, cut = 0, None
    for lev, rows in histogram:
        taken, cut = taken + rows, lev
        if taken >= limit:
            break
    if cut is None:
        return []
    # Levels are steps of an eighth of a power of two; one step lower is safe against rounding.
    least = int(math.floor(2 ** ((cut - 1) / 8)))
    return counts.where(F.col(n) >= least).orderBy(F.desc(n), key).limit(limit).collect()
