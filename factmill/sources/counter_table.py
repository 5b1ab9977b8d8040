"""Tables of counters: folders of files that only grow, and a log of commits that says which of them count.

``data/`` holds a folder for each batch, by day; ``log/`` a JSON file for each version, which lists the folders that are
live in it and the batches that they hold. Readers take one version whole. A batch whose writer dies before its commit
is a folder that no version names.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How often a commit is tried again when others come first.
TRIES = 20


class _Files:
    """The file system that holds a path, by Hadoop's interface, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gently = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[tuple[str, float]]:
        """Names and seconds since their last change of what is in a folder."""
        if not self.fs.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file at once or not at all; False if there is one already. Safe against other writers where the store
        renames atomically, as HDFS does."""
        hidden = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(hidden), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(hidden)), self.fs.makeQualified(self.path(name)), self.gently)
        except Py4JJavaError as e:
            self.fs.delete(self.path(hidden), False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n, _ in _Files(spark, path).names(f"{path}/log") if n.endswith(".json"))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version of the table, the newest if none is named: version, schema (None before the first batch), folders, and
    seen, by writer the batch up to which all are counted and those beyond it."""
    known = versions(spark, path)
    if not known:
        return {"version": -1, "schema": None, "folders": [], "seen": {}}
    return json.loads(_Files(spark, path).read(f"{path}/log/{version if version is not None else known[-1]:020}.json"))


def _is_seen(state: dict, writer: str, batch: int) -> bool:
    upto, beyond = state["seen"].get(writer, [-1, []])
    return batch <= upto or batch in beyond


def _with_batch(seen: dict, writer: str, batch: int) -> dict:
    upto, beyond = seen.get(writer, [-1, []])
    beyond = {*beyond, batch}
    while upto + 1 in beyond:
        upto += 1
    return seen | {writer: [upto, sorted(b for b in beyond if b > upto)]}


def _commit(spark: SparkSession, path: str, change) -> int | None:
    """Makes a new version of the newest by ``change``, again if another writer's version comes first; None if change
    finds nothing to do."""
    files = _Files(spark, path)
    for _ in range(TRIES):
        held = snapshot(spark, path)
        new = change(held)
        if new is None:
            return None
        version = held["version"] + 1
        if files.publish(f"{path}/log/{version:020}.json", json.dumps(new | {"version": version})):
            return version
    raise RuntimeError(f"{TRIES} commits to {path} were overtaken")


def _write(rows: DataFrame, path: str, day: str) -> str:
    folder = f"data/part={uuid.uuid4().hex}"
    rows.write.partitionBy(day).parquet(f"{path}/{folder}")
    return folder


def add_counts(path: str, new: DataFrame, keys: list[str], counts: list[str], day: str, batch: int, writer: str = "") -> int | None:
    """Adds the counters of a batch, summed by keys (day among them), as one version. Batches are numbered from 0 by each
    writer, in any order; one that is counted already changes nothing, whatever it holds, and gives None."""
    spark = new.sparkSession
    if _is_seen(snapshot(spark, path), writer, batch):
        return None
    summed = new.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts)).select(*(k for k in keys if k != day), *counts, day)
    folder = _write(summed, path, day)

    def change(held: dict) -> dict | None:
        if _is_seen(held, writer, batch):
            return None
        return {"schema": held["schema"] or summed.schema.json(), "folders": [*held["folders"], folder], "seen": _with_batch(held["seen"], writer, batch)}

    return _commit(spark, path, change)


def _rows(spark: SparkSession, path: str, state: dict) -> DataFrame:
    schema = StructType.fromJson(json.loads(state["schema"]))
    folders = [f"{path}/{f}" for f in state["folders"]]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names) if folders else spark.createDataFrame([], schema)


def read_counts(spark: SparkSession, path: str, keys: list[str], counts: list[str], version: int | None = None) -> DataFrame:
    """The counters of one version, the newest by default, summed by keys. What is committed or compacted while it is
    read is not seen. A filter on the day prunes folders. A table without batches has no schema and is an error."""
    state = snapshot(spark, path, version)
    if state["schema"] is None:
        raise ValueError(f"{path} holds no batch")
    return _rows(spark, path, state).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def compact_counts(spark: SparkSession, path: str, keys: list[str], counts: list[str], day: str, most: int = 1) -> int | None:
    """Where more than ``most`` folders are live, makes them one, as a new version. Batches that others add meanwhile stay
    live beside it; if another compaction takes any of these folders first, this one gives way (None), and its folder is
    left for remove_unused."""
    state = snapshot(spark, path)
    old = state["folders"]
    if len(old) <= most:
        return None
    rows = _rows(spark, path, state)
    folder = _write(rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts)).select(*rows.columns), path, day)

    def change(held: dict) -> dict | None:
        if not set(old) <= set(held["folders"]):
            return None
        return held | {"folders": [folder, *(f for f in held["folders"] if f not in set(old))]}

    return _commit(spark, path, change)


def remove_unused(spark: SparkSession, path: str, seconds: float = 7 * 86_400) -> list[str]:
    """Drops versions that were replaced more than so many seconds ago, then folders of that age that no version left
    names: those of old compactions, and those of writers that died. A reader or writer must not take longer."""
    files = _Files(spark, path)
    ages = {n: age for n, age in files.names(f"{path}/log")}
    known = versions(spark, path)
    gone = [v for v, after in zip(known, known[1:], strict=False) if ages.get(f"{after:020}.json", 0) > seconds]
    for v in gone:
        files.remove(f"{path}/log/{v:020}.json")
    live = {f for v in known if v not in set(gone) for f in snapshot(spark, path, v)["folders"]}
    removed = [f"data/{n}" for n, age in files.names(f"{path}/data") if age > seconds and f"data/{n}" not in live]
    for f in removed:
        files.remove(f"{path}/{f}")
    for n, age in ages.items():
        if n.endswith(".tmp") and age > seconds:
            files.remove(f"{path}/log/{n}")
    return removed
