"""Small Spark helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from echofold.scratch import delete, delete_on_exit, shared_dir

_LOCAL_BITS = 33
#: Size of the filter that keeps rows without a partner out of a shuffle, whatever the number of keys.
FILTER_BYTES = 4 << 20


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder, once, and read it from there. The files stay until the session ends."""
    path, out = _written(df)
    delete_on_exit(df.sparkSession, path)
    return out


@contextmanager
def scratch_table(df: DataFrame):
    """As ``cut``, but the files are deleted on leaving, so whatever is derived must be materialised before the block ends."""
    path, out = _written(df)
    try:
        yield out
    finally:
        delete(df.sparkSession, path)


def parts_by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with ``most`` bytes at most in a text or binary column, or a single longer value."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_keys(data: Column) -> dict[str, Column]:
    """Two 64-bit hashes that stand for a text (never null), as columns ``ha`` and ``hb``."""
    return {"ha": F.xxhash64(data), "hb": F.xxhash64(F.lit(1), data)}


def marked(rows: DataFrame, keys: DataFrame, on: list[str], name: str = "_maybe") -> DataFrame:
    """``rows`` with a flag that is true for all whose ``on`` columns are in ``keys``, and for few others.

    A bit for each hash value stands for the keys; the table of bits that is broadcast has FILTER_BYTES in rows of 4 KB at most,
    however many keys there are. With very many keys more flags are true, never fewer.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(8 * FILTER_BYTES))
    bits = keys.select(F.bitmap_bucket_number(bit).alias("_chunk"), F.bitmap_bit_position(bit).alias("_at")).groupBy("_chunk").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    found = rows.withColumns({"_chunk": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)}).join(F.broadcast(cut(bits)), "_chunk", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))).drop("_chunk", "_at", "_bits")


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """Range-partition and sort by ``order``; adds ``_part`` and ``_local`` (row within the partition).

    The result is written down, so both stay as they are when executors are lost. A hot value of the
    leading column is spread over partitions as long as a later column tells its rows apart.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    out = cut(out)
    return out.withColumns(
        {
            "_part": F.shiftright("_mid", _LOCAL_BITS),
            "_local": F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
        }
    ).drop("_mid")


def global_rank(df: DataFrame, *order: str, name: str = "_rank") -> DataFrame:
    """Gapless rank from 0 over the whole table in the order given, without a single-task sort.

    Only one row per partition (never rows of data) passes through the unpartitioned window.
    """
    rows = ordered(df, *order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_local")).cast(T.LongType()))
        .drop("_part", "_local", "_before")
    )
