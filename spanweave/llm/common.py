"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are maximal runs of anything else.  ``bytes.split()`` splits on exactly these six bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  Where it is unset, a temporary one in local mode only; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows whose texts in ``column`` have at most ``size`` bytes together; a longer text is a part of its own.

    What a worker holds is so bounded by bytes, however long the rows of a batch are.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = min(max(stop, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)
