"""Sharding along a Hilbert curve."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factmill.llm.common import global_position, materialize, shuffle_partitions


def hilbert_numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each column of cells (dimensions x rows, values below 2**bits), after J. Skilling,
    "Programming the Hilbert curve" (2004)."""
    x = cells.astype(np.int64).copy()
    n = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> k & 1
    return out


def order_code(df: DataFrame, name: str) -> Column:
    """A long that grows with a column of numbers or times. Null: least."""
    kind = df.schema[name].dataType
    c = df[name]
    if isinstance(kind, T.DateType):
        code = F.unix_date(c).cast("long")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        code = F.round(c.cast("double") * 1024).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        code = F.unix_micros(c.cast("timestamp"))
    else:
        code = c.cast("long")
    return F.coalesce(code, F.lit(-(1 << 62)))


def text_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """Texts that part a column into so many runs of near-equal counts of rows at most, each a value of the column: by
    the whole text, however long a beginning its values share. The distinct values are ordered with their counts by a
    range shuffle; the driver sees the values that a cut falls on."""
    held = df.where(df[name].isNotNull()).groupBy(df[name].cast("binary").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    placed = materialize(held.repartitionByRange(shuffle_partitions(spark), "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "values")
    sums = sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.sum("n")).collect())
    total, starts, at = sum(n for _, n in sums), [], 0
    for part, n in sums:
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "part int, start long")
    run = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # Rows before each value; a value opens a new cell where this passes a multiple of total / cells.
    before = placed.join(F.broadcast(offsets), "part").withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    cell = lambda c: F.floor(c * cells / max(total, 1))
    opens = before.withColumn("cell", cell(F.col("before"))).withColumn("last", cell(F.col("before") + F.col("n"))).where(F.col("last") > F.col("cell"))
    # One value for each cell that ends at most: the first value behind it.
    ends = opens.agg(F.sort_array(F.collect_set("value"))).first()[0]
    return [bytes(v) for v in ends]


def hilbert_shards(df: DataFrame, dims: Sequence[str], shards: int, carry: Sequence[Column], ties: Sequence[str], bits: int = 6) -> DataFrame:
    """The carried columns plus ``hilbert long, shard int, slot long``: rows in curve order, cut into runs whose
    counts differ by one at most.

    Each dimension is quantised at its own quantiles into up to 2**bits cells (texts by their whole value; a null counts
    as the least), so a hot value takes one cell and does not starve the rest. Rows of one cell are ordered by ``ties``
    (names among the carried columns), which keeps copies side by side and lets a hot cell spread over tasks and
    shards. Fewer rows than shards: the last shards stay empty. No rows: no rows. Repeated rows are all kept. Other
    columns of df play no part, whatever their names.
    """
    if bits * len(dims) > 62:
        raise ValueError("bits times dimensions must not exceed 62")
    texts = [isinstance(df.schema[d].dataType, (T.StringType, T.BinaryType)) for d in dims]
    numbers = [d for d, text in zip(dims, texts, strict=True) if not text]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = dict(zip(numbers, df.agg(*(F.percentile_approx(order_code(df, d), steps, 10_000) for d in numbers)).first(), strict=True)) if numbers else {}
    cuts = [text_cuts(df, d, 1 << bits) if text else np.unique(np.asarray(found[d] or [], np.int64)) for d, text in zip(dims, texts, strict=True)]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        cells = []
        for text, cut, c in zip(texts, cuts, columns, strict=True):
            if text:
                code, values = pd.factorize(c)
                place = np.array([bisect_left(cut, bytes(v)) for v in values] + [0])
                cells.append(np.minimum(place, max(len(cut) - 1, 0))[code])
            else:
                cells.append(np.searchsorted(cut, c.to_numpy(np.int64), side="right"))
        return pd.Series(hilbert_numbers(np.stack(cells), bits))

    codes = [df[d].cast("binary") if text else order_code(df, d) for d, text in zip(dims, texts, strict=True)]
    # Written, as the range shuffle reads its input twice.
    slim = materialize(df.select(F.struct(*carry).alias("row"), curve(*codes).alias("hilbert")), "curve")
    placed, total = global_position(slim, [F.col("hilbert"), *(F.col(f"row.{t}") for t in ties)], "hilbert")
    short, longer = divmod(total, shards)
    at, edge = F.col("position"), longer * (short + 1)
    shard = F.when(at < edge, F.floor(at / (short + 1))).otherwise(longer + F.floor((at - edge) / max(short, 1)))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.col("shard") * F.lit(short).cast("long") + F.least(F.col("shard"), F.lit(longer))
    return placed.select("row.*", "hilbert", "shard", (at - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its files each a run of the curve, so that min and max of the dimensions prune files.
    The rows come from the range shuffle in runs already; nothing is moved again."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
