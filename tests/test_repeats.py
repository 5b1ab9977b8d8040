"""Similarity of repeats against all pairs, in a row, in blocks, and in slices of a vocabulary."""

import random
from collections import Counter, defaultdict

import pytest

from factmill.operators import evaluation


def plain(rows):
    cases = defaultdict(list)
    for case, facts, top in rows:
        cases[case].append((set(facts), top))
    out = {}
    for case, held in cases.items():
        pairs = [len(a & b) / len(a | b) if a | b else 1.0 for i, (a, _) in enumerate(held) for b, _ in held[i + 1 :]]
        out[case] = (sum(pairs) / len(pairs) if pairs else 1.0, max(Counter(t for _, t in held).values()) / len(held))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "k string, facts array<string>, top_one string").repartition(5)
    got = {r["k"]: (r["mean_jaccard"], r["top_one_agreement"]) for r in evaluation.repeat_variance(df, "k").collect()}
    expected = plain([r for r in rows if r[0] is not None])
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-5), k


@pytest.mark.parametrize("few", [2, 32])
def test_variance_equals_all_pairs(spark, monkeypatch, few):
    r = random.Random(few)
    rows = [(f"c{i % 9}", [f"f{r.randrange(12)}" for _ in range(r.randrange(6))], r.choice(["a", "b", None])) for i in range(180)]
    rows += [("one", ["x"], "a"), ("none", [], None), ("none", [], "t"), (None, ["x"], "a")] + [("copies", ["p", "q"], "a")] * 40
    monkeypatch.setattr(evaluation, "FEW", few)
    monkeypatch.setattr(evaluation, "SETS", 6)
    check(spark, rows)


def test_blocks_are_cut_by_facts_and_vocabularies_by_slices(spark, monkeypatch):
    r = random.Random(7)
    rows = [("big", r.sample([f"w{k}" for k in range(900)], r.randrange(1, 300)), "t") for _ in range(50)]
    monkeypatch.setattr(evaluation, "FACTS", 2000)
    monkeypatch.setattr(evaluation, "SLICE", 1000)
    check(spark, rows)
    assert evaluation.repeat_variance(spark.createDataFrame([], "k string, facts array<string>, top_one string"), "k").collect() == []
