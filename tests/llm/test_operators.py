"""Each operator against a plain version, with nulls, empty and long texts, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factmill.llm import ctw, langid, mixing, pieces, queries, sharding, simhash, sketch, topk, urlfilter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, key int, digest string, fp string"
EXTRA = ("r", "s", 1, "d", "f")


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 120)
    rows = [(i, words(i, 40), "en", f"src{i % 3}", 100, *EXTRA) for i in range(1, 30)]
    rows += [(100 + i, base, "en", "src0", 5, *EXTRA) for i in range(25)]  # copies
    rows += [(200, base + " tail", "en", "src0", 5, *EXTRA), (201, "", "en", None, 0, *EXTRA), (202, None, None, "src1", None, *EXTRA), (203, "one", "fr", "src2", 3, *EXTRA), (204, "  \t\n ", "en", "src2", 5, *EXTRA)]
    rows += [(205, "Ünï 😀 " + words(9, 9000), "de", "src1", None, *EXTRA), (None, "no id at all", None, None, 12, *EXTRA), (1, rows[0][1], "en", "src1", 100, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def at(spark, docs, tmp_path_factory):
    """A folder of tables, and one of empty tables."""
    full, none = (tmp_path_factory.mktemp(n) for n in ("full", "none"))
    r = random.Random(5)
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "x" * 2000), (2, "https://www.a.com/en/1?ref=x", "x" * 2000), (3, None, None), (4, "no scheme", ""), (5, "http://EXAMPLE.com/en/7", "<html>" + "y" * 999), (6, "http://b.net", "x" * 2000), (6, "http://b.net", "x" * 2000)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(320)] + [(100, [1.0] * 4), (500, None), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan")] * 4), (None, [1.0] * 4)], "vec_id long, embedding array<double>").withColumn("label", (F.col("vec_id") % 3).cast("int"))
    talks = spark.createDataFrame([(i, k, r.choice(["user", None]), r.choice(["hi", "", None])) for i in range(12) for k in range(i % 5)] + [(None, 1, "user", "x"), (3, None, None, None)], "conv_id long, turn long, role string, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)] + [(None, 1, 0), (100, None, 0)], "doc_id long, quality int, toxic int")
    for name, df in {"documents": docs, "pages": pages, "embeddings": vectors, "conversations": talks, "labels": labels}.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    return str(full), str(none)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, at, name):
    assert queries.QUERIES[name](spark, at[1]).count() == 0


def test_op1_is_a_partition_with_even_counts(spark, at, docs):
    got = queries.op1_hilbert_sharding(spark, at[0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)


def test_hilbert_neighbours_differ_in_one_step():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)]).T
    order = np.argsort(sharding.hilbert_numbers(cells, 3))
    steps = np.abs(np.diff(cells[:, order], axis=1)).sum(0)
    assert (steps == 1).all()


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].lower(), tail[:end]


def test_op2_rules(spark, sf):
    got = {r["page_id"]: r for r in queries.op2_redirect_equivalence(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host, path = host_path(p["url"])
        fits = [(len(h + q), h + q, v) for h, q, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        r = got[p["page_id"]]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert not fits or r["verdict"] == max(fits)[2]


def test_op2_blocks_spread_and_allows_stand(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/x"), (2, "http://alias.org/1"), (3, "http://far.org/2"), (4, "http://good.com/ok"), (5, "http://alone.org/"), (6, None)], "page_id long, url string")
    links = spark.createDataFrame([("http://alias.org/1", "http://bad.com/x"), ("http://far.org/2", "http://alias.org/1"), ("http://good.com/ok", "http://bad.com/x"), (None, "http://z.com/")], "a string, b string")
    rules = spark.createDataFrame([("bad.com", "/", "block"), ("good.com", "/", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["verdict"], r["basis"]) for r in urlfilter.judge_urls(pages, rules, links).collect()}
    assert got == {1: ("block", "rule"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "rule"), 5: ("allow", "default"), 6: ("allow", "default")}


def test_op3_edits(spark, at, docs):
    got = sorted(queries.op3_scaled_sketch(spark, at[0]).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0), reverse=True)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    prints = {}
    expected = Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        expected[i, len(t), hashlib.sha256(new.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for t in texts[r["doc_id"]]:
            assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_sketch_containment_is_an_estimate():
    a = words(3, 20_000)
    part = " ".join(a.split()[:5000])
    whole, some = sketch.sketches([a, part])
    assert sketch.containment(some, whole) == 1
    assert abs(sketch.containment(whole, some) - 0.25) < 0.05
    both = sketch.merge(whole, some)
    assert both.scale == whole.scale == sketch.SCALE and (both.hashes == whole.hashes).all()
    # Small sketches keep all; merged beyond FEW they are thinned as the whole would be.
    parts = [" ".join(words(k, 200).split()) for k in (31, 32)]
    x, y = sketch.sketches(parts)
    assert x.scale == y.scale == 1 and sketch.merge(x, y).scale == sketch.SCALE
    assert set(sketch.merge(x, y).hashes) == {h for h in [*x.hashes, *y.hashes] if h < (1 << 64) // sketch.SCALE}


def plain_fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_op4_equals_all_pairs(spark, at, docs):
    got = queries.op4_simhash_near_dedup(spark, at[0]).collect()
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    part = plain_components(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in rows:
        if i is not None:
            least[part[f]] = min(least.get(part[f], i), i)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", least.get(part[f])) for i, f in rows)


@pytest.mark.parametrize("bucket", [4, 8192])
def test_hamming_links_lose_nothing(spark, bucket):
    r = random.Random(2)
    prints = {r.getrandbits(64) for _ in range(100)}
    for p in list(prints)[:40]:
        for _ in range(6):
            q = p
            for b in r.sample(range(64), r.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.hamming_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), bucket).collect()
    pairs = {frozenset((a % (1 << 64), b % (1 << 64))) for a, b in links}
    assert all((a ^ b).bit_count() <= 3 for a, b in map(tuple, (p for p in pairs if len(p) == 2)))
    mine = plain_components(sorted(prints), lambda a, b: frozenset((a, b)) in pairs)
    full = plain_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    groups = lambda c: {frozenset(n for n in c if c[n] == v) for v in c.values()}
    assert groups(mine) == groups(full)


def test_keep_one_keeps_all_columns(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sum(r["doc_id"] is not None and 100 <= r["doc_id"] < 125 for r in kept.collect()) <= 1


def test_op5_and_op6_equal_sql(spark, sf, at):
    from tests.oracle import alike, rows, sql_rows

    for name in ("op5_warc_transactions", "op6_exact_top_k"):
        got, want = rows(queries.QUERIES[name](spark, sf)), sql_rows(queries.ORACLE_SQL[name], sf)
        assert got[0] == want[0] and alike(got[1], want[1])
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.op5_warc_transactions(spark, at[0]).collect())
    assert got == [(1, 2000, "revisit", 6), (2, 2000, "revisit", 6), (3, 0, "response", None), (4, 0, "response", None), (5, 1005, "response", None), (6, 2000, "response", None), (6, 2000, "response", None)]


def test_warc_reads_back_what_it_wrote(spark, at, tmp_path):
    warc.write_warc(spark.read.parquet(f"{at[0]}/pages.parquet").where("page_id in (1, 5)"), str(tmp_path / "w"))
    seen = {r["response"]["target_uri"]: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    assert set(seen) == {"http://a.com/en/1", "http://EXAMPLE.com/en/7"}
    assert bytes(seen["http://a.com/en/1"]["response"]["payload"]) == b"x" * 2000
    assert all(r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata" for r in seen.values())


def test_op6_with_odd_rows(spark, at):
    got = defaultdict(list)
    for r in queries.op6_exact_top_k(spark, at[0]).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    held = [(r["vec_id"], [math.floor(1024 * x) for x in r["embedding"]]) for r in spark.read.parquet(f"{at[0]}/embeddings.parquet").where("vec_id is not null and vec_id < 500").collect()]
    lists = Counter()
    for q, v in held:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in held if i != q))[:10]
            lists.update((q, i, -s) for s, i in best)
    # Two rows of id 100 with different vectors: a list each.
    assert Counter((q, i, s) for q, found in got.items() for i, s in found) == lists
    assert {q: len(found) for q, found in got.items()} == {0: 10, 100: 20, 200: 10, 300: 10}


def test_topk_of_more_lists_than_one_merge_takes(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 10)
    monkeypatch.setattr(topk, "QUERY_BYTES", 8)  # a block for each query
    monkeypatch.setattr(topk, "FAN_IN", 3)
    v = spark.range(0, 200, 1, 13).select(F.col("id").alias("vec_id"), F.array(((F.col("id") * 37) % 101).cast("double")).alias("embedding"))
    got = topk.exact_top_k(v.where("vec_id = 0 or vec_id = 100").withColumn("embedding", F.array(F.lit(1.0))), v, 5).orderBy("query_id", "rank").collect()
    best = sorted((-(i * 37 % 101), i) for i in range(200))
    for q in (0, 100):
        assert [r["vec_id"] for r in got if r["query_id"] == q] == [i for s, i in best if i != q][:5]


def test_op7_counts_and_base(spark, at, docs):
    got = queries.op7_context_tree_weighting(spark, at[0]).collect()
    rows = [(r["doc_id"], ctw.tokens(r["text"])) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    c = Counter(t for i, ts in rows if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    expected = sorted((i if i is not None else -1, held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4)) for i, ts in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)


def test_ctw_is_a_probability(spark):
    """The model's chances of all bytes after one context sum to one."""
    keys, _ = ctw.gram_keys([b"abcab", b"cab"])
    found, n = np.unique(keys, return_counts=True)
    ctx = int(found[0]) >> 8 << 8
    every = np.unique(np.concatenate([found, ctx | np.arange(256)]))
    counts = np.array([dict(zip(found.tolist(), n.tolist(), strict=True)).get(k, 0) for k in every.tolist()], float)
    last = ctw.subtree(every, counts)[0][-1]
    top = ctw.top_levels([(int(i >> 16), int(i & 255), w, z, o) for i, w, z, o in zip(last["ids"], last["weighted"], last["zeros"], last["ones"], strict=True)])
    bits = ctw.code_bits(every, counts, top)
    assert abs((2.0 ** -bits[(every >> 8 << 8) == ctx]).sum() - 1) < 1e-9


def test_op8_targets_and_copies(spark, at, docs):
    got = queries.op8_pareto_mixing(spark, at[0]).collect()
    again = queries.op8_pareto_mixing(spark, at[0]).collect()
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["source_size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
        if not open_:
            break
    by = defaultdict(float)
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        by[r["source_size"]] += r["taken"]
    for s in names:
        assert any(abs(r["target"] - target[s]) < 1e-6 for r in got if r["source_size"] == sizes[s])
    # A source's words come as near as its largest document allows.
    for s in names:
        largest = max((r["size"] for r in got if r["source_size"] == sizes[s]), default=0)
        assert abs(by[sizes[s]] - target[s]) <= largest / 2 + 1


def test_mixed_rows_keep_columns(spark, docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert max(r["count"] for r in out.where("doc_id is not null and doc_id <> 1").groupBy("doc_id").count().collect()) <= 3


def test_op9_equals_the_library(spark, docs):
    proto = open(pieces.model_path(), "rb").read()
    sp = pieces.processor(proto)
    extra = spark.createDataFrame([(900, "x" * 500 + " " + words(4, 300) + "  two  spaces\n\nlines " + "日本語テキスト" * 40), (901, "▁under " * 9)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    texts = defaultdict(list)
    for r in both.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    got = pieces.encode(both, proto, chunk=256).collect()
    assert len(got) == both.count()
    for r in got:
        assert any(list(r["ids"]) == sp.encode(t) for t in texts[r["doc_id"]]), r["doc_id"]
    back = pieces.round_trip(docs).collect()
    assert all(r["round_trip"] for r in back)


def test_op10_finds_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op10_language_fusion(spark, sf).collect()
    got = {r["doc_id"]: r for r in found if r["table"] == "documents"}
    assert sum(r["table"] == "pages" and r["page_id"] is not None and r["doc_id"] is None for r in found) == spark.read.parquet(f"{sf}/pages.parquet").count()
    rows = docs.where("lang is not null and n_chars > 200").collect()
    right = sum(got[r["doc_id"]]["lang"] == r["lang"] for r in rows) / len(rows)
    text_only = sum(got[r["doc_id"]]["text_lang"] == r["lang"] for r in rows) / len(rows)
    assert right > 0.95 and text_only > 0.8
    assert sum(got[r["doc_id"]]["accepted"] for r in rows) / len(rows) > 0.97


def test_op10_held_out_accuracy(spark, sf):
    """The text model, fitted on half of the documents, on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 200")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1").collect()
    found = [model.languages[int(s.argmax())] if (s := model.scores(r["text"])[:-1]) is not None else None for r in rest]
    assert sum(f == r["lang"] for f, r in zip(found, rest, strict=True)) / len(rest) > 0.9


def test_op10_odd_rows(spark, at, docs):
    found = queries.op10_language_fusion(spark, at[0]).collect()
    got = [r for r in found if r["table"] == "documents"]
    assert len(got) == docs.count() and len(found) == len(got) + 7
    assert all(not r["accepted"] for r in got if r["doc_id"] in (201, 202, 204))


def test_pipeline_stages_keep_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).where("not round_trip").count() == 0
