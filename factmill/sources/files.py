"""Files: JSON lines, manifests of JSON documents, reports, counter tables."""

from __future__ import annotations

import tempfile
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factmill.operators.validation import CASE_SCHEMA, case_error, enforce


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; on a local master one of our own if none is
    named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="factmill-")
    return f"{named.rstrip('/')}/factmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what follows reads it as often as it likes, and a lost executor
    costs the tasks that it ran. The table stays until the folder is cleaned."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Inputs below this are dealt to all cores, as one small file with one row group is one task.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where what it reads is less than SPREAD_BYTES, by the plan's own statistics; that is what is
    shuffled at most, on whatever cluster. Larger inputs are left as they lie: Spark cuts their files by bytes."""
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if read < SPREAD_BYTES else df


def remove_written(spark: SparkSession, seconds: float = 86_400) -> int:
    """Removes what ``written`` and ``scratch``, and the training-data operators, left in the shared folder that long ago;
    gives how many. Results are read from these tables lazily, so no job that needs them may still run."""
    folder = scratch(spark, "x").rsplit("/", 1)[0]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in store.listStatus(root) if time.time() - s.getModificationTime() / 1000 > seconds] if store.exists(root) else []
    return sum(bool(store.delete(p, True)) for p in old)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """One row per line; a line that is no JSON of this schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_cases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cases as JSON lines; one that breaks the schema fails the job."""
    rows = read_json_lines(spark, path, CASE_SCHEMA)
    return enforce(rows, case_error(F.struct("*")), strict=True)


def read_manifest(spark: SparkSession, manifest: str, schema: StructType | str) -> DataFrame:
    """One row per JSON document that a text file lists, a path a line. The list itself is short: paths, not rows."""
    paths = [r[0] for r in spark.read.text(manifest).where(F.trim("value") != "").select(F.trim("value")).collect()]
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(paths) if paths else spark.createDataFrame([], schema)


def write_observations(df: DataFrame, path: str) -> None:
    """JSON by case and repeat, so that one case's observations can be read alone."""
    df.write.mode("overwrite").partitionBy("caseId", "repeat").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row, as indented JSON in one part file."""
    row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def create_counter_table(spark: SparkSession, name: str, keys: dict[str, str], counts: list[str], day: str) -> None:
    columns = ", ".join([*(f"{k} {t}" for k, t in keys.items()), *(f"{c} BIGINT" for c in counts)])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({day})")


def drop_counter_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_jobs(state: DataFrame, path: str, batch: int) -> None:
    """state: request_id, expiresAt and the job's columns. One batch of states, a folder of its own; batches are numbered
    as they are written."""
    state.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def live_jobs(spark: SparkSession, path: str, now: str | datetime) -> DataFrame:
    """The state of each job that was written last, without those whose time is over: an entry that a later one replaced
    is never seen again, however long it would have lived. Of rows of one job in one batch the later end counts. ``now``
    as text is a moment of the session's zone."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("request_id", "batch")]
    last = rows.groupBy("request_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("batch").cast("long"), "expiresAt")).alias("s")).select("request_id", "s.*")
    return last.where(F.col("expiresAt") > F.lit(now).cast("timestamp"))


def write_records(records: DataFrame, path: str) -> None:
    """Records of usage and requests, a JSON object a line, added to those that are there."""
    records.write.mode("append").json(path)
