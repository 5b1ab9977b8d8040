"""What the operators share: tables in the shared folder, global positions, ASCII text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of one Arrow batch at most. Texts can be long, so these are fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. On a local master that names none, one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="factmill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts the lineage: a lost executor costs
    the tasks that it ran, not the steps before. The table stays until the folder is cleaned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that materialize wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes of an Arrow batch for this session, as texts may be long: plans are run after this
    returns, so the bounds stay. A bound that is lower already is kept."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        held = str(spark.conf.get(name)).removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold at most so many bytes; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def one_of_each(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The keys, each once, and ``row``, the columns of one of the rows that have them. Tasks keep one row a key before
    anything moves, so rows that repeat, however often, never meet in one task."""
    whole = F.struct(*(df[c] for c in df.columns)).alias("row")
    return df.select(*(c.alias(k) for k, c in keys.items()), whole).groupBy(*keys).agg(F.first("row").alias("row"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """df with ``position``, its gapless place from 0 in the given order, and the count of rows.

    A range shuffle sorts in many tasks; the driver sees one count per partition. The sorted rows are written
    before they are counted, since a second run of a range shuffle may cut elsewhere.
    """
    spark = df.sparkSession
    kept = df.columns
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), name)
    part, row = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    # One row per partition: the number of partitions bounds what is broadcast.
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select(*kept, (F.col("_start") + row).alias("position")), total
