"""Queries over one small file use all cores, and do no work that they don't show."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from factmill.functions import text
from factmill.operators import coerce
from factmill.plans import profile_queries, table_queries
from factmill.sources.files import scratch


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_responses_are_made_on_all_cores(spark, sf):
    assert profile_queries.responses(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_citations_are_read_without_typing_the_profiles(spark, sf):
    assert "phone_numbers" not in plan(profile_queries.response_citations(spark, sf))


#: Characters of the plan: what stands in it is planned and computed that often.
@pytest.mark.parametrize(("query", "most"), [("response_citations", 40_000), ("response_verdicts", 150_000)])
def test_a_part_of_a_response_is_not_read_again_for_each_use(spark, sf, query, most):
    assert len(plan(getattr(profile_queries, query)(spark, sf))) < most


def test_requests_are_not_sent_through_the_driver(spark, sf):
    """Nor are profiles parsed once for their identities and once more to be bound."""
    said = profile_queries.profile_matches(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in said and "phone_numbers" not in said


@pytest.mark.parametrize("query", ["profile_phones", "profile_locations", "profile_ratings", "profile_websites"])
def test_a_list_is_computed_once_to_be_exploded(spark, sf, query):
    said = plan(getattr(profile_queries, query)(spark, sf)).split("Project")
    assert not any("array_sort" in node and "Filter ((size(transform(array_sort" in node for node in said)


def test_suspect_texts_are_all_that_may_be_unsafe(spark):
    texts = ["plain", "two  spaces", " led", "ended ", "a\tb", "it is quoted", "Quote", "x@y", "see www.x", "http://x", '"url":', "a 555-0100", "123-4567", "Demo", "resource", "n/a", "unknown", "é", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    cleaned = text.clean_public_text(c, None)
    bad = df.where((text.contains_unsafe(cleaned) | text.contains_placeholder(cleaned) | (cleaned != c)) & ~c.rlike(text.SUSPECT))
    assert bad.count() == 0
    assert df.where(~c.rlike(text.SUSPECT) & (c != "")).count() == 1


def test_kinds_of_values_are_told_without_their_schema(spark):
    values = ['{"a": {"b": 1}}', "{}", "[]", "[1, {}]", '"x"', '""', "0", "-0.5", "1e300", "true", "false", "null", None, "no JSON"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", F.try_parse_json("v").alias("v"))
    got = df.select("i", coerce.kind(F.col("v")).alias("k"), coerce.is_object(F.col("v")).alias("o"), coerce.is_array(F.col("v")).alias("a"), coerce.truthy(F.col("v")).alias("t"), F.size(coerce.items(F.col("v"))).alias("n")).orderBy("i").collect()
    assert [r["o"] for r in got] == [True] * 2 + [False] * 12
    assert [r["a"] for r in got] == [False] * 2 + [True] * 2 + [False] * 10
    assert [r["t"] for r in got] == [True] * 5 + [False] * 2 + [True] * 3 + [False] * 4
    assert [r["n"] for r in got] == [1, 1, 0, 2, 1, 0, 0, 1, 1, 1, 0, 0, 0, 0]
    assert [r["k"] for r in got][:6] + [r["k"] for r in got][9:] == ["OBJECT"] * 2 + ["ARRAY"] * 2 + ["STRING"] * 2 + ["BOOLEAN"] * 2 + ["VOID"] * 3


def test_a_member_of_a_member(spark):
    df = spark.createDataFrame([(json.dumps(v),) for v in ({"source": {"id": "a"}}, {"source": "a"}, {"source": [{"id": "a"}]}, ["source"])], "v string")
    assert [r[0] for r in df.select(coerce.text_of(coerce.part(F.try_parse_json("v"), "source.id"))).collect()] == ["a", None, None, None]


def test_observations_are_written_on_all_cores(spark, sf, monkeypatch):
    """A document for each supplier is a file of its own: one task that writes them all takes most of the time."""
    written = []
    monkeypatch.setattr(table_queries.files, "scratch", lambda s, name: written.append(scratch(s, name)) or written[-1])
    table_queries.score_reports(spark, sf)
    found = glob.glob(f"{written[0].removeprefix('file://')}/observations/part=*/part-*.json")
    tasks = {os.path.basename(f).split("-")[1] for f in found}
    assert len(found) == spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert len(tasks) > 1
