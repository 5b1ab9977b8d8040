"""Scores of emitted facts against gold facts, over flat rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.contact import address_parts, format_location, hmac_sha256, phone_key
from factmill.functions.stats import ratio, wilson
from factmill.functions.text import let, plain_text
from factmill.functions.urls import website_key
from factmill.sources.files import written

FIELDS = ["phones", "addresses", "websites", "ratings"]
COUNTERS = ["eligible", "emitted", "correct", "gold_count", "recovered", "top_one_correct", "citation_present", "unsafe_disclosures"]


def normalized_value(field: Column, value: Column) -> Column:
    """A fact's value as it is compared: phones, addresses and websites by their keys, ratings as plain text."""
    return F.when(field == "phones", phone_key(value)).when(field == "addresses", address_parts(value)["canonical"]).when(field == "websites", F.coalesce(website_key(value), F.lit(""))).otherwise(plain_text(value))


def emitted_facts(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per emitted fact: keys, field, ordinal, value, cited (its source is there with domain and url)."""
    plain = lambda c: F.transform(c, lambda f: F.struct(f["value"].alias("value"), f["sourceId"].alias("id")))
    place = F.transform("locations", lambda f: F.struct(format_location(f["addressLine1"], f["addressLine2"], f["city"], f["state"], f["zip"]).alias("value"), f["sourceId"].alias("id")))
    fields = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("facts")) for n, v in (("phones", plain(F.col("phoneNumbers"))), ("addresses", place), ("websites", plain(F.col("websites"))), ("ratings", plain(F.col("ratings"))))))
    good = F.transform(F.filter("sources", lambda s: (s["domain"] != "") & (s["url"] != "")), lambda s: s["id"])
    each = profiles.select(*keys, good.alias("good"), F.explode(fields).alias("f")).select(*keys, "good", "f.field", F.posexplode("f.facts").alias("ordinal", "fact"))
    return each.select(*keys, "field", "ordinal", "fact.value", F.coalesce(F.array_contains("good", F.col("fact.id")), F.lit(False)).alias("cited"))


def score_fields(cases: DataFrame, gold: DataFrame, emitted: DataFrame, key: str, hmac_key: str | None = None) -> DataFrame:
    """cases: key, field, every pair to score. gold: key, field, value (normalised), status, display_safe, value_hash.
    emitted: key, field, ordinal, value (normalised), cited. Returns COUNTERS per case and field.

    Expected are gold facts that are confirmed_current, display safe and have a value. correct counts emitted facts,
    repeats included; recovered counts distinct values. Three aggregations on (key, field) and one equi-join on the
    value, whose gold side is distinct, so no row is multiplied. Unsafe gold facts without a key are an error.
    """
    by = [key, "field"]
    sure = gold.where((F.col("status") == "confirmed_current") & F.col("display_safe") & (F.col("value") != ""))
    counted = sure.groupBy(*by).agg(F.count(F.lit(1)).alias("gold_count"))
    values = sure.select(*by, "value").distinct().withColumn("hit", F.lit(1))
    bad = gold.where((F.col("status") == "unsafe_personal") & (F.col("value_hash") != "")).select(*by, F.col("value_hash").alias("hash"))
    shown = emitted.select(*by, "ordinal", "value", "cited").join(values, [*by, "value"], "left")
    if hmac_key is None:
        shown = shown.withColumn("leak", F.lit(0))
    else:
        hashed = shown.withColumn("hash", hmac_sha256(F.concat("field", F.lit(":"), "value"), hmac_key))
        shown = hashed.join(bad.distinct().withColumn("l", F.lit(1)), [*by, "hash"], "left").withColumn("leak", F.coalesce("l", F.lit(0)))
    hit = F.coalesce("hit", F.lit(0))
    found = shown.groupBy(*by).agg(
        F.count(F.lit(1)).alias("emitted"), F.sum(hit).alias("correct"), F.count_distinct(F.when(hit == 1, F.col("value"))).alias("recovered"), F.min_by(hit, "ordinal").cast("long").alias("top_one_correct"),
        F.count_if("cited").alias("citation_present"), F.sum("leak").alias("unsafe_disclosures"),
    )
    met = cases.select(*by).distinct().join(counted, by, "left").join(found, by, "left")
    met = met.withColumn("eligible", F.when(F.col("gold_count") > 0, 1).otherwise(0))
    if hmac_key is None:
        unsafe = bad.select(*by).distinct().withColumn("_unsafe", F.lit(True))
        met = met.join(unsafe, by, "left").where(F.when(F.col("_unsafe"), F.raise_error(F.lit("a key is required to score unsafe facts")).cast("boolean")).otherwise(True))
    return met.select(*by, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS))


RATIOS = {"coverage": ("covered", "eligible"), "emitted_precision": ("correct", "emitted"), "gold_recall": ("recovered", "gold_count"), "top_one_accuracy": ("top_one_correct", "eligible"), "citation_presence": ("citation_present", "emitted")}


def with_interval(name: str, successes: Column, total: Column) -> list[Column]:
    """A ratio (null where nothing was counted) and its interval as three columns."""
    return [ratio(successes, total).alias(name), wilson(successes, total)["lower"].alias(f"{name}_low"), wilson(successes, total)["upper"].alias(f"{name}_high")]


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """scores: rows of score_fields. Per field the ratios with their intervals; null where nothing was counted."""
    sums = scores.groupBy("field").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.count_if((F.col("eligible") > 0) & (F.col("emitted") > 0)).alias("covered"))
    cols = [x for name, (a, b) in RATIOS.items() for x in with_interval(name, F.col(a), F.col(b))]
    return sums.select("field", *cols, "unsafe_disclosures")


def identity_reason(npi: Column, name: Column, gold_npi: Column, asked_name: Column, present: Column) -> Column:
    """missing, npi, name or match."""
    return F.when(~present, "missing").when(~npi.eqNullSafe(gold_npi), "npi").when(plain_text(name) != plain_text(asked_name), "name").otherwise("match")


def with_latency(observations: DataFrame, started: str, completed: str) -> DataFrame:
    """Adds latency_ms between two moments."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return observations.withColumn("latency_ms", ms(completed) - ms(started))


def join_cases(observations: DataFrame, cases: DataFrame, key: str, order: str) -> DataFrame:
    """Observations with their case; of cases with one key the last by order. An observation of no case fails the job."""
    last = cases.groupBy(key).agg(F.max_by(F.struct(*(c for c in cases.columns if c != key)), order).alias("_case"))
    met = observations.join(last, key, "left")
    named = F.concat(F.lit("an observation names no case: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    fine = F.when(F.col("_case").isNotNull(), F.col("_case")).otherwise(F.raise_error(named))
    return met.withColumn("_case", fine).select(*observations.columns, "_case.*")


def score_cases(observed: DataFrame, key: str) -> DataFrame:
    """observed, one row for each case: key, status, latency_ms, npi, provider_name, address (the first, formatted; null
    if none), present (whether a profile was found), gold_npi, asked_name, baseline_address. Adds reason,
    identity_correct, wrong_provider, address_agrees (null without a baseline), address_conflicts, failed."""
    c = F.col
    reason = identity_reason(c("npi"), c("provider_name"), c("gold_npi"), c("asked_name"), c("present"))
    place = lambda x: address_parts(x)["canonical"]
    agrees = F.when(F.nullif("baseline_address", F.lit("")).isNotNull(), F.coalesce(c("present") & c("address").isNotNull() & (place(c("address")) == place(c("baseline_address"))), F.lit(False)))
    judged = observed.withColumns({"reason": reason, "address_agrees": agrees})
    return judged.select(
        key, "reason", (c("reason") == "match").alias("identity_correct"), (c("present") & (c("reason") != "match")).alias("wrong_provider"), "address_agrees", (~c("address_agrees")).alias("address_conflicts"), "latency_ms",
        (~c("present") | ~c("status").eqNullSafe("completed")).alias("failed"),
    )


def case_overview(cases: DataFrame) -> DataFrame:
    """cases: rows of score_cases. One row of ratios with their intervals, and latency; null where nothing was counted."""
    c = F.col
    sums = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("identity_correct").alias("right"), F.count_if("wrong_provider").alias("wrong"), F.count_if("failed").alias("fell"), F.count("address_agrees").alias("paired"),
        F.count_if("address_agrees").alias("agree"), F.count_if("address_conflicts").alias("conflict"), F.avg("latency_ms").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
    )
    pairs = {"identity_accuracy": ("right", "cases"), "wrong_provider_rate": ("wrong", "cases"), "failure_rate": ("fell", "cases"), "address_agreement": ("agree", "paired"), "address_conflict": ("conflict", "paired")}
    return sums.select("cases", *(x for name, (a, b) in pairs.items() for x in with_interval(name, c(a), c(b))), "mean_latency_ms", "max_latency_ms")


#: Distinct sets of facts (with their top_one) of a case that are compared inside one row; more are compared in blocks of
#: some SETS sets and FACTS facts. Floats of a slice of such a block, whatever its vocabulary.
FEW, SETS, FACTS, SLICE = 32, 512, 1 << 18, 1 << 22


def _shared(rows: np.ndarray, codes: np.ndarray, members: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many facts each of first shares with each of second. rows, codes: one entry for each member and fact. Facts are
    inverted, and taken a slice of the vocabulary at a time; those of one member alone are shared with none."""
    often = np.bincount(codes) > 1
    place = np.cumsum(often) - 1
    kept = often[codes]
    rows, codes = rows[kept], place[codes[kept]]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    both = np.zeros((len(first), len(second)), np.float32)
    step = max(1, SLICE // members)
    for start in range(0, int(often.sum()), step):
        a, b = np.searchsorted(codes, [start, start + step])
        held = np.zeros((members, step), np.float32)
        held[rows[a:b], codes[a:b] - start] = 1
        both += held[first] @ held[second].T
    return both


def _block_sum(block: pd.DataFrame) -> pd.DataFrame:
    """Weighted sum of the similarities between the sets of two blocks of a case, or inside one block."""
    code: dict[str, int] = {}
    codes = np.array([code.setdefault(f, len(code)) for facts in block["facts"] for f in facts], np.int64)
    size, weight, side = np.array([len(f) for f in block["facts"]]), block["n"].to_numpy(float), block["side"].to_numpy()
    rows = np.repeat(np.arange(len(block)), size)
    same = bool((block["lo"] == block["hi"]).all())
    first, second = (np.arange(len(block)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    both = _shared(rows, codes, len(block), first, second)
    # Two empty sets are alike.
    whole = size[first][:, None] + size[second][None, :] - both
    each = np.where(whole > 0, both / np.maximum(whole, 1), 1.0) * weight[first][:, None] * weight[second][None, :]
    total = float(np.triu(each, 1).sum() if same else each.sum())
    return pd.DataFrame({"case": block["case"].iloc[:1], "total": [total]})


def _few_sets(counted: DataFrame) -> DataFrame:
    """case, total (similarities of all pairs of different sets), alike, repeats, top_one_agreement of cases with few
    sets, each in one row."""
    row = counted.groupBy("case").agg(F.collect_list(F.struct("facts", "top_one", "n")).alias("r"))
    share = lambda both, a, b: F.when(a["facts"] == b["facts"], 1.0).otherwise(both / (F.size(a["facts"]) + F.size(b["facts"]) - both)) * a["n"] * b["n"]
    pair = lambda a, b: let(F.size(F.array_intersect(a["facts"], b["facts"])), lambda both: share(both, a, b))
    later = lambda a, i: F.aggregate(F.slice("r", i + 2, F.size("r")), F.lit(0.0), lambda t, b: t + pair(a, b))
    sum_of = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0.0), lambda t, x: t + x)
    n = lambda x: x["n"].cast("double")
    tops = F.transform(F.array_distinct(F.transform("r", lambda x: x["top_one"])), lambda t: sum_of(F.filter("r", lambda x: x["top_one"].eqNullSafe(t)), n))
    total, repeats = F.aggregate(F.transform("r", later), F.lit(0.0), lambda t, x: t + x), sum_of("r", n)
    return row.select("case", total.alias("total"), sum_of("r", lambda x: n(x) * (n(x) - 1) / 2).alias("alike"), repeats.alias("repeats"), (F.array_max(tops) / repeats).alias("top_one_agreement"))


def _many_sets(counted: DataFrame, case_type: str) -> DataFrame:
    """The same for cases of any number of sets. The sets of a case are dealt into blocks, and each two blocks are a group
    of their own that gives one sum, so that no row or task holds a whole case and no pair is ever a row."""
    sets = counted.groupBy("case", "facts").agg(F.sum("n").alias("n"))
    sized = sets.groupBy("case").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("facts")).alias("all"), F.sum("n").cast("double").alias("repeats"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("alike"))
    blocks = F.greatest(F.ceil(F.col("sets") / SETS), F.ceil(F.col("all") / FACTS)).cast("int")
    many = sets.join(sized.select("case", blocks.alias("blocks")), "case").withColumn("block", F.pmod(F.xxhash64("facts"), "blocks").cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = many.select("case", "facts", "n", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") == F.least("block", "other"), 0).otherwise(1).alias("side"))
    totals = dealt.groupBy("case", "lo", "hi").applyInPandas(_block_sum, f"case {case_type}, total double").groupBy("case").agg(F.sum("total").alias("total"))
    tops = counted.groupBy("case", "top_one").agg(F.sum("n").alias("m")).groupBy("case").agg((F.max("m") / F.sum("m")).alias("top_one_agreement"))
    return sized.join(totals, "case", "left").join(tops, "case").select("case", F.coalesce("total", F.lit(0.0)).alias("total"), "alike", "repeats", "top_one_agreement")


def repeat_variance(repeats: DataFrame, key: str) -> DataFrame:
    """repeats: key, facts (array), top_one. Per case mean_jaccard over all pairs of its repeats (1 for one repeat; two
    without facts are alike) and top_one_agreement, the share of its most frequent top_one.

    Rows without key are of no case. Repeats of equal facts are one set with a count, whose pairs are alike. Only if some case has more than FEW are the
    sets written; then such cases are compared in blocks, and the others in a row each.
    """
    counted = repeats.where(F.col(key).isNotNull()).select(F.col(key).alias("case"), F.array_sort(F.array_distinct("facts")).alias("facts"), "top_one").groupBy("case", "facts", "top_one").agg(F.count(F.lit(1)).alias("n"))
    most = counted.groupBy("case").count().agg(F.max("count")).first()[0] or 0
    if most <= FEW:
        out = _few_sets(counted)
    else:
        counted = written(counted, "repeats")
        large = counted.groupBy("case").count().where(F.col("count") > FEW).select("case")
        held = lambda kind: counted.join(large, "case", kind)
        out = _few_sets(held("left_anti")).unionByName(_many_sets(held("left_semi"), repeats.schema[key].dataType.simpleString()))
    pairs = F.col("repeats") * (F.col("repeats") - 1) / 2
    mean = F.when(F.col("repeats") < 2, 1.0).otherwise((F.col("total") + F.col("alike")) / pairs)
    return out.select(F.col("case").alias(key), mean.alias("mean_jaccard"), "top_one_agreement")


def mean_variance(cases: DataFrame) -> DataFrame:
    """Means of repeat_variance over all cases; null for none."""
    return cases.agg(F.avg("mean_jaccard").alias("mean_jaccard"), F.avg("top_one_agreement").alias("mean_top_one_agreement"))


def repeats_of(emitted: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """emitted: key, repeat, field, ordinal, value (as emitted_facts gives them). observations: key, repeat. Rows for
    repeat_variance: the normalised facts of each observation, and its first fact of each field as one text."""
    by = [key, "repeat"]
    # A column of its own, as what asks the JVM for a host may not stand in an aggregate.
    normal = emitted.withColumn("_normal", normalized_value(F.col("field"), F.col("value")))
    facts = normal.groupBy(*by).agg(F.collect_set("_normal").alias("facts"), *(F.max(F.when((F.col("field") == f) & (F.col("ordinal") == 0), F.col("value"))).alias(f"_{f}") for f in FIELDS))
    met = observations.select(*by).distinct().join(facts, by, "left")
    top = plain_text(F.concat_ws("|", *(F.coalesce(F.col(f"_{f}"), F.lit("")) for f in FIELDS)))
    return met.select(*by, F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), top.alias("top_one"))
