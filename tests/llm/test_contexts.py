"""Contexts of the tree run across spaces."""

import math

import numpy as np

from factmill.llm import ctw


def test_order_of_words_changes_the_score(spark):
    """Each score against the model's cost of every byte of the running text; reordered words cost more."""
    texts = ["ab cd ef gh"] * 40 + ["gh ef cd ab", "ab cd ef gh", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score_documents(docs).collect()}
    assert got[40]["score"] < got[41]["score"] - 1

    def keys(text):
        raw = b" " * ctw.DEPTH + (text.encode() + b" " if text else b"") + ctw.END
        return [sum(b << 8 * (ctw.DEPTH - k) for k, b in enumerate([*reversed(raw[i - ctw.DEPTH : i]), raw[i]])) for i in range(ctw.DEPTH, len(raw))]

    every, n = {}, {}
    for i, t in enumerate(texts):
        for k in keys(t):
            every[k] = every.get(k, 0) + (not got[i]["held_out"])
    order = np.array(sorted(every), np.int64)
    n = np.array([every[k] for k in order.tolist()], float)
    last = ctw.subtree(order, n)[0][-1]
    sums = {}
    for i, w, z, o in zip(last["ids"], last["weighted"], last["zeros"], last["ones"], strict=True):
        at = sums.setdefault((int(i >> 16) & 255, int(i & 255)), [0.0, 0.0, 0.0])
        for k, v in enumerate((w, z, o)):
            at[k] += v
    cost = dict(zip(order.tolist(), ctw.code_bits(order, n, ctw.top_levels([(*k, *v) for k, v in sums.items()])).tolist(), strict=True))
    for i, t in enumerate(texts):
        assert math.isclose(got[i]["score"], -math.log10(2) * sum(cost[k] for k in keys(t)), rel_tol=1e-6), t
