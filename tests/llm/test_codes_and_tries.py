"""op11 and op12 against plain versions of the whole result, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.llm import codebooks, trie

# op11


def plain_codes(rows, entries=256):
    """rows: (vec_id, ints). Codebooks and, per row, code and error, by the contract's words."""
    width = len(rows[0][1]) // 4
    seeds = sorted(rows)[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in seeds] for p in range(4)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(4):
        new = []
        for p in range(4):
            met = defaultdict(list)
            for _, v in rows:
                met[assign(v, p)[1]].append(v[p * width : (p + 1) * width])
            new.append([[sum(c) // len(met[j]) for c in zip(*met[j], strict=True)] if met[j] else e for j, e in enumerate(books[p])])
        books = new
    out = [(i, "".join(f"{assign(v, p)[1]:02x}" for p in range(4)), sum(assign(v, p)[0] for p in range(4))) for i, v in rows]
    return out, hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string"


def test_op11_equals_the_plain_version(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([0.5, -0.5, 0.25, r.uniform(-1, 1)]) for _ in range(8)], r.choice([None, 1, 2])) for i in range(500, 0, -1)]
    rows += [(600 + i, rows[7][1], None) for i in range(80)]  # one vector that is common
    odd = [(900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [float("nan")] + [0.0] * 7, 2), (903, [float("inf")] + [0.0] * 7, 2)]
    df = spark.createDataFrame([(*x, "", "") for x in rows + odd], SCHEMA).repartition(5)
    got = codebooks.coded_vectors(df).collect()
    expected, sha = plain_codes([(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v, _ in rows])
    assert {(x["vec_id"], x["code"], x["error"]) for x in got} == set(expected) and len(got) == len(rows)
    assert {x["codebooks_sha256"] for x in got} == {sha}
    errors, sums = {i: e for i, _, e in expected}, defaultdict(int)
    for i, _, label in rows:
        sums[label] += errors[i]
    assert all(x["label_error"] == sums[x["label"]] for x in got)


def test_op11_on_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codebooks.coded_vectors(empty).collect() == []
    assert codebooks.coded_vectors(empty).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    # Of another length, of a length that four doesn't divide, without id, repeated, huge.
    rows = [(1, [1.0] * 8), (1, [1.0] * 8), (2, [2.0] * 8), (3, [1.0] * 4), (4, [1.0] * 6), (None, [9.0] * 8), (5, [3e38] * 8), (6, [-3e38] * 8), (7, [])]
    got = codebooks.coded_vectors(spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], SCHEMA)).collect()
    by = defaultdict(list)
    for x in got:
        by[x["vec_id"]].append((x["code"], x["error"]))
    # The second of two equal seeds is nearest to none, as the first wins ties.
    assert by[1] == [("00000000", 0)] * 2 and by[2] == [("02020202", 0)]
    assert by[3] == by[4] == by[7] == [(None, None)]
    assert by[None] == [("05050505", 0)] and by[5] == [("03030303", 0)] and by[6] == [("04040404", 0)]


def test_op11_decodes(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    whole = codebooks.whole_vectors(df)
    books = codebooks.learn(whole, entries=16)
    back = codebooks.encode(whole.withColumn("kept", F.col("v")), books).withColumn("d", codebooks.decoded(F.col("code"), books)).collect()
    assert all(sum((a - b) ** 2 for a, b in zip(x["kept"], x["d"], strict=True)) == x["error"] for x in back)
    # A codebook learnt serves better than one that is a sample.
    first = codebooks.learn(whole, entries=16, rounds=0)
    assert sum(x["error"] for x in back) < codebooks.encode(whole, first).agg(F.sum("error")).first()[0]


# op12


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) with distinct turns a conversation."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * len(node[-1][1].encode()) * 1 + sum(saved[k] for k in children[node]) if node else sum(saved[k] for k in children[node])
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest()) for node, m in members.items()
    )


def _talks(seed, n=50):
    """Conversations that share beginnings, copies of one, snapshots of one as it grows, and long ones."""
    r = random.Random(seed)
    rows, common = [], [("user", "héllo"), ("assistant", "hi"), ("user", "x" * 40)]
    for c in range(-12, n):
        if c % 3 == 0:
            turns = list(common)
        elif c % 3 == 1:
            turns = [*common[:2], *((r.choice(["user", None]), r.choice(["a", "b", None, ""])) for _ in range(r.randrange(6)))]
        else:
            turns = [("user", f"turn {k}") for k in range(c % 12)] or [("system", "s")]
        if c % 17 == 0:
            turns = turns * 8
        if c % 10 == 5:
            continue  # a base that is absent
        rows += [(c, None if k == 0 else k, role, text) for k, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_turns", [12, trie.LOCAL_TURNS])
def test_op12_equals_the_plain_version(spark, local_turns):
    rows = _talks(local_turns)
    df = spark.createDataFrame([(*x, "", 0) for x in rows] + [(None, 1, "user", "nobody", "", 0)], "conv_id long, turn long, role string, text string, seq string, depth int").repartition(6)
    got = [tuple(x) for x in trie.conversation_trie(df, local_turns).collect()]
    assert sorted(got) == plain_trie(rows)


def test_op12_on_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    # A conversation whose base is absent and whose turns all fall to it is turnless: only the root.
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    only = trie.conversation_trie(spark.createDataFrame([(c, 0, "user", "x")], schema)).collect()
    assert [tuple(x) for x in only] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # Rows that repeat are turns each; equal turns have one order, however the rows are dealt.
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "user", "b"), (5, 1, "user", "a")]
    for parts in (1, 4):
        got = trie.conversation_trie(spark.createDataFrame(rows, schema).repartition(parts)).collect()
        assert sorted((x["depth"], x["n_convs"]) for x in got) == [(0, 2), (1, 2), (2, 2), (3, 2)]


def test_op12_hashes_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 50)
    members = spark.range(-500, 20_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 100)).alias("class"), F.col("id").alias("conv_id"))
    got = {x["class"]: x["ends_sha256"] for x in trie.member_digests(members).collect()}
    assert got["a"] == hashlib.sha256(",".join(str(i) for i in range(-500, 20_000) if i % 3 == 0).encode()).hexdigest()
    assert len(got) > 60


def test_op12_parts_by_turns():
    r = np.random.default_rng(1)
    symbols = r.integers(0, 40, 3000)
    parts = trie._parted(np.arange(3000), symbols)
    assert sorted(np.concatenate(parts).tolist()) == list(range(3000))
    assert len(parts) == 40 and all(len(set(symbols[p])) == 1 for p in parts)
