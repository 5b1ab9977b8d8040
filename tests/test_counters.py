"""Tables of counters: batches count once, readers see one version, dead writers leave nothing; days are UTC days."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from factmill.operators import evaluation, rollups
from factmill.sources import counter_table as ct
from factmill.sources import files

KEYS, COUNTS = ["day", "k"], ["c"]


@pytest.fixture
def add(spark, tmp_path):
    def run(batch, rows, writer=""):
        new = spark.createDataFrame(rows, "day string, k string, c long").withColumn("day", F.to_date("day"))
        return ct.add_counts(str(tmp_path), new, KEYS, COUNTS, "day", batch, writer)

    return run


def read(spark, path, version=None):
    return sorted((str(r["day"]), r["k"], r["c"]) for r in ct.read_counts(spark, str(path), KEYS, COUNTS, version).collect())


def test_a_batch_counts_once_whatever_the_order(spark, add, tmp_path):
    assert add(2, [("2024-01-01", "x", 1)]) == 0
    assert add(0, [("2024-01-02", "x", 5), ("2024-01-02", "x", 1)]) == 1
    assert add(2, [("2024-01-01", "x", 100)]) is None
    assert add(2, [("2024-01-01", "x", 7), (None, None, 3)], "other") == 2
    assert read(spark, tmp_path) == [("2024-01-01", "x", 8), ("2024-01-02", "x", 6), ("None", None, 3)]
    assert ct.snapshot(spark, str(tmp_path))["seen"] == {"": [0, [2]], "other": [-1, [2]]}
    ct.compact_counts(spark, str(tmp_path), KEYS, COUNTS, "day")
    # What was compacted is still known.
    assert add(0, [("2024-01-02", "x", 5)]) is None and add(1, [("2024-01-02", "y", 1)]) == 4
    assert ct.snapshot(spark, str(tmp_path))["seen"][""] == [2, []]
    assert read(spark, tmp_path) == [("2024-01-01", "x", 8), ("2024-01-02", "x", 6), ("2024-01-02", "y", 1), ("None", None, 3)]


def test_readers_during_compaction_see_one_version(spark, add, tmp_path, monkeypatch):
    for b in range(3):
        add(b, [("2024-01-01", "x", 1)])
    before = ct.read_counts(spark, str(tmp_path), KEYS, COUNTS)
    publish, seen = ct._Files.publish, []

    def slow(self, name, text):
        # The new folder is whole, the commit isn't there yet; meanwhile a batch is added and read.
        monkeypatch.setattr(ct._Files, "publish", publish)
        seen.append(read(spark, tmp_path))
        add(3, [("2024-01-01", "x", 10)])
        seen.append(read(spark, tmp_path))
        return publish(self, name, text)

    monkeypatch.setattr(ct._Files, "publish", slow)
    assert ct.compact_counts(spark, str(tmp_path), KEYS, COUNTS, "day") == 4
    assert seen == [[("2024-01-01", "x", 3)], [("2024-01-01", "x", 13)]]
    assert read(spark, tmp_path) == [("2024-01-01", "x", 13)]
    assert len(ct.snapshot(spark, str(tmp_path))["folders"]) == 2
    # A reader that began before goes on with its version, which can still be named.
    assert [r["c"] for r in before.collect()] == [3]
    assert read(spark, tmp_path, 1) == [("2024-01-01", "x", 2)]


def test_two_compactions_at_once_count_once(spark, add, tmp_path, monkeypatch):
    for b in range(3):
        add(b, [("2024-01-01", "x", 1)])
    commit = ct._commit

    def overtaken(*args):
        monkeypatch.setattr(ct, "_commit", commit)
        assert ct.compact_counts(spark, str(tmp_path), KEYS, COUNTS, "day") == 3
        return commit(*args)

    monkeypatch.setattr(ct, "_commit", overtaken)
    assert ct.compact_counts(spark, str(tmp_path), KEYS, COUNTS, "day") is None
    assert read(spark, tmp_path) == [("2024-01-01", "x", 3)]


def test_a_writer_that_dies_leaves_nothing_that_counts(spark, add, tmp_path, monkeypatch):
    add(0, [("2024-01-01", "x", 1)])
    with monkeypatch.context() as m:
        m.setattr(ct, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            add(1, [("2024-01-01", "x", 50)])
    assert read(spark, tmp_path) == [("2024-01-01", "x", 1)]
    assert add(1, [("2024-01-01", "x", 2)]) == 1
    assert read(spark, tmp_path) == [("2024-01-01", "x", 3)]
    ct.compact_counts(spark, str(tmp_path), KEYS, COUNTS, "day")
    assert ct.remove_unused(spark, str(tmp_path)) == []
    # Past its time, what no version names goes: two folders that were compacted, and the dead writer's.
    assert len(ct.remove_unused(spark, str(tmp_path), -1)) == 3
    assert ct.versions(spark, str(tmp_path)) == [2] and read(spark, tmp_path) == [("2024-01-01", "x", 3)]


def test_a_version_is_published_once(spark, tmp_path):
    store = ct._Files(spark, str(tmp_path))
    assert store.publish(f"{tmp_path}/log/a.json", "1") and not store.publish(f"{tmp_path}/log/a.json", "2")
    assert store.read(f"{tmp_path}/log/a.json") == "1"
    assert [n for n, _ in store.names(f"{tmp_path}/log") if not n.startswith(".")] == ["a.json"]
    with pytest.raises(ValueError, match="no batch"):
        ct.read_counts(spark, str(tmp_path / "none"), KEYS, COUNTS)


def test_tables_of_counters_in_the_catalogue(spark):
    files.create_counter_table(spark, "clicks_by_day", {"k": "STRING"}, ["c"], "day DATE")
    files.create_counter_table(spark, "clicks_by_day", {"k": "STRING"}, ["c"], "day DATE")
    spark.sql("INSERT INTO clicks_by_day VALUES ('x', 2, DATE '2024-01-01')")
    assert [tuple(r) for r in spark.sql("SELECT k, c, CAST(day AS STRING) FROM clicks_by_day").collect()] == [("x", 2, "2024-01-01")]
    files.drop_counter_table(spark, "clicks_by_day")
    files.drop_counter_table(spark, "clicks_by_day")
    assert not spark.catalog.tableExists("clicks_by_day")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_days_are_utc_days(spark, zone):
    moments = [dt.datetime(2026, 1, 2, 2, tzinfo=dt.timezone.utc), dt.datetime(2026, 1, 2, 23, 59, 59, 999999, tzinfo=dt.timezone.utc), dt.datetime(1969, 12, 31, 23, tzinfo=dt.timezone.utc)]
    held = spark.conf.get("spark.sql.session.timeZone")
    rows = [(m, "o", "broker_admin", "p", None, "profile", "Dr. Who", "correct", None, "2164442200") for m in moments]
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        events = spark.createDataFrame(rows, "ts timestamp, broker_org_id string, submitter_class string, provider_id string, provider_npi string, fact_type string, fact_value string, validation_status string, reason_code string, phone string")
        days = [str(r[0]) for r in rollups.feedback_rows(events)[0].select("feedback_day").collect()]
        clicks = [str(r[0]) for r in rollups.click_rows(events).select("click_day").collect()]
        local = spark.sql("SELECT TIMESTAMP_NTZ'2026-01-02 02:00:00' AS ts")
        assert str(local.select(rollups.utc_day(local, "ts")).first()[0]) == "2026-01-02"
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    assert sorted(days) == sorted(clicks) == ["1969-12-31", "2026-01-02", "2026-01-02"]


def test_an_observation_of_no_case_fails(spark):
    cases = spark.createDataFrame([("a", 1, "x")], "caseId string, version int, name string")
    seen = spark.createDataFrame([("a", 1), ("b", 1)], "caseId string, repeat int")
    assert evaluation.join_cases(seen.where("caseId = 'a'"), cases, "caseId", "version").count() == 1
    with pytest.raises(Exception, match="names no case: b"):
        evaluation.join_cases(seen, cases, "caseId", "version").collect()


def test_what_was_written_can_be_removed(spark, tmp_path):
    held = spark.conf.get("spark.checkpoint.dir", None)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named and not named.startswith("file:///tmp"):
        pytest.skip("the shared folder isn't this test's")
    table = files.written(spark.range(10), "gone")
    assert table.count() == 10 and files.remove_written(spark, 3600) == 0 and table.count() == 10
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    os.utime(path, (1e9, 1e9))
    assert files.remove_written(spark, 10**6) == 1 and not os.path.exists(path)
    assert spark.conf.get("spark.checkpoint.dir", None) == held


def test_small_inputs_are_spread_and_large_ones_left(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert files.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(files, "SPREAD_BYTES", 10)
    assert files.spread(df).rdd.getNumPartitions() == 1
