"""Operators against plain versions of the whole result, and the pipeline's stages on odd rows."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.llm import ctw, langid, mixing, pieces, queries, sharding, sketch, urlfilter
from tests.llm.test_operators import host_path, plain_components, words

MASK = (1 << 64) - 1


# op1


def plain_cell(values, value, cells):
    """Cell of a text: how many values end a cell before it."""
    if value is None:
        return 0
    held, total, before, ends = Counter(v.encode() for v in values if v is not None), sum(v is not None for v in values), 0, []
    for v in sorted(held):
        if (before + held[v]) * cells // total > before * cells // total:
            ends.append(v)
        before += held[v]
    return min(sum(e < value.encode() for e in ends), max(len(ends) - 1, 0))


def test_op1_orders_rows_by_curve_and_ties(spark):
    r = random.Random(4)
    rows = [(i, f"https://host{r.randrange(12):02}.example/{'x' * (i % 3)}" if i % 11 else None, r.randrange(50) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, url string, n long")
    got = {x["id"]: x for x in sharding.hilbert_shards(df, ["url", "n"], 7, [F.col("id")], ["id"], bits=4).collect()}
    urls = [u for _, u, _ in rows]
    low = -(1 << 62)
    numbers = sorted(n if n is not None else low for _, _, n in rows)
    cuts = sorted({numbers[max(math.ceil(k / 16 * len(numbers)) - 1, 0)] for k in range(1, 16)})
    cells = np.array([[plain_cell(urls, u, 16) for _, u, _ in rows], [sum(c <= (n if n is not None else low) for c in cuts) for _, _, n in rows]])
    curve = sharding.hilbert_numbers(cells, 4)
    assert {i: got[i]["hilbert"] for i, _, _ in rows} == {rows[k][0]: int(c) for k, c in enumerate(curve)}
    order = [i for _, i in sorted((int(c), rows[k][0]) for k, c in enumerate(curve))]
    assert sorted(got, key=lambda i: (got[i]["shard"], got[i]["slot"])) == order
    # Urls that begin alike still part.
    assert len({plain_cell(urls, u, 16) for u in urls}) > 8


def test_op1_writes_shards_that_prune(spark, tmp_path):
    df = spark.range(400).select(F.col("id"), (F.col("id") * 7919 % 400).alias("a"), (F.col("id") * 104729 % 400).alias("b"))
    out = sharding.hilbert_shards(df, ["a", "b"], 8, ["id", "a", "b"], ["id"])
    sharding.write_shards(out, str(tmp_path / "s"))
    spans = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b"), F.count("id").alias("n")).collect()
    assert all(x["n"] == 50 for x in spans)
    # A shard covers a part of both dimensions: a query on either reads few shards.
    assert sum(x["a"] for x in spans) / 8 < 300 and sum(x["b"] for x in spans) / 8 < 300


# op2


def plain_key(url):
    host, path = host_path(url)
    if not host:
        return None
    tail = url.split("://", 1)[1].split("#", 1)[0]
    return url.split("://", 1)[0].lower() + "://" + host + path + ("?" + tail.split("?", 1)[1] if "?" in tail else "")


def test_op2_verdicts_of_all_pages(spark):
    r = random.Random(8)
    pages, links = [], []
    for i in range(120):
        url = f"http{'s' * (i % 2)}://{r.choice(['', 'www.', 'm.'])}site{r.randrange(25)}.{r.choice(['com', 'org'])}/{r.choice(['a', 'b/c', ''])}{r.choice(['', '/', '?ref=1', '?q=1&utm_x=2'])}"
        target = r.choice([None, None, "/a", "b/c", f"//site{r.randrange(25)}.org/a", f"https://www.site{r.randrange(25)}.com/b/c?ref=9", "mailto:x@y.z"])
        html = r.choice(['<html><head><LINK rel="canonical" href="{}"></head>', "<meta http-equiv=refresh content='0; url={}'>", "<link href={} title=x rel=canonical><link rel=icon href=/a>"]).format(target) if target else "<html><link rel=icon href=/a>"
        pages.append((i, url, html))
        if target and ":" in target and "://" not in target:
            continue
        if target:
            scheme, (host, path) = url.split("://")[0], host_path(url)
            whole = target if "://" in target else f"{scheme}:{target}" if target.startswith("//") else f"{scheme}://{host}{target}" if target.startswith("/") else f"{scheme}://{host}{(path or '/').rsplit('/', 1)[0]}/{target}"
            links.append((url, whole))
    rules = [("site1.com", "/", "block"), ("site2.org", "/a", "block"), ("site2.org", "/a/", "allow"), ("com", "/b/", "block"), ("m.site3.com", "/b/", "allow")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = urlfilter.page_links(df)
    assert Counter(map(tuple, found.collect())) == Counter(links)
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in urlfilter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), found).collect()}

    def rule(key):
        host, path = host_path(key)
        fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    # Nothing but a declared link makes two urls one.
    edges = {frozenset((plain_key(a), plain_key(b))) for a, b in links}
    nodes = sorted({n for e in edges for n in e} | {plain_key(u) for _, u, _ in pages})
    part = plain_components(nodes, lambda a, b: frozenset((a, b)) in edges)
    blocked = {part[n] for n in nodes if rule(n)[1] == "block"}
    assert len({part[n] for n in nodes}) < len(nodes) - 20 and blocked
    for i, url, _ in pages:
        key = plain_key(url)
        own, verdict = rule(key)
        assert got[i] == (own, verdict or ("block" if part[key] in blocked else "allow")), url


def test_op2_equals_sql_on_pages_with_links(spark, tmp_path):
    """A rewritten url is no alias: without a link, neither is what it would rewrite to."""
    html = lambda t: f'<link rel="canonical" href="{t}">'
    pages = [(1, "https://site.org/es", None), (2, "https://site.org/es/", None), (3, "https://www.site.org/es", ""), (4, "http://site.org/es?utm_x=1", "<html>"), (5, "HTTP://A.net/x#f", html("http://b.com/en/1")), (6, "http://a.net/x", html("/y")), (7, "https://a.net/x", None)]
    pages += [(8, "http://c.org/1", "<META HTTP-EQUIV='refresh' content='3;URL=../es/2'>"), (9, "http://c.org/2", html("//example.com/en/7")), (10, "http://d.net/de/1", html("http://b.com/en/1")), (11, None, html("/y")), (12, "nothing", html("http://b.com/en/1")), (13, "http://e.org/1?q", html("mailto:x@y")), (14, "http://e.org/1", html("http://example.net/de/8"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["verdict"], r["basis"]) for r in queries.op2_redirect_equivalence(spark, str(tmp_path)).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("allow", "default"), ("block", "rule"), ("allow", "default"), ("allow", "default")]
    assert got[5] == got[6] == ("block", "alias") and got[7] == ("allow", "default") and got[10] == ("allow", "rule") and got[14] == ("block", "alias")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = con.execute(queries.OP2_SQL)
    names = [d[0] for d in expected.description]
    assert Counter(tuple(r[n] for n in names) for r in queries.op2_redirect_equivalence(spark, str(tmp_path)).collect()) == Counter(expected.fetchall())


# op3


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_sketch(text):
    found = text.encode().lower().split()
    codes = [plain_mix((sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & MASK) for w in found]
    out = set()
    for k in range(max(len(codes) - 4, min(len(codes), 1))):
        h = 0
        for i, c in enumerate(codes[k : k + 5]):
            h = plain_mix((h * 0xD6E8FEB86659FD93 + c + i + 1) & MASK)
        out.add(h)
    scale = 1 if len(out) <= sketch.FEW else sketch.SCALE
    return f"{scale}:" + "".join(f"{h:016x}" for h in sorted(out) if h < (1 << 64) // scale), out


def test_op3_fingerprints_and_likeness(spark):
    texts = [words(40 + i, n) for i, n in enumerate((0, 1, 3, 5, 6, 8, 12, 30, 200, 200, 259, 260, 261, 700, 900))] + ["A  b\tC d E f " * 9]
    got = {x["doc_id"]: x for x in sketch.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def share(a, b):
        """From the two fingerprints alone."""
        (n, x), (m, y) = (t.split(":") for t in (a, b))
        low = [{h for h in (t[i : i + 16] for i in range(0, len(t), 16)) if int(h, 16) < (1 << 64) // max(int(n), int(m))} for t in (x, y)]
        return len(low[0] & low[1]) / len(low[0]) if all(low) else float(a == b)

    for i, text in enumerate(texts):
        after = texts[i - 1]
        half = len(text) // 2
        (own, whole), (other, all_other), (next_, _) = plain_sketch(text), plain_sketch(text[: len(text) - half] + after[:half]), plain_sketch(after)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own, other)
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((share(own, other), share(own, next_)))
        # Near the truth of the whole sets.
        if len(whole) > 300:
            assert abs(got[i]["near_edited"] - len(whole & all_other) / len(whole)) < 0.15


# op7


def plain_ctw(texts, held_out):
    """Binary-decomposed bytes, one weighted tree of contexts for each node of the byte's tree."""
    counts = defaultdict(lambda: [0, 0])
    steps = lambda t: [(b" " * ctw.DEPTH + t, i + ctw.DEPTH) for i in range(len(t))]
    bits = lambda c: [(1 << k | c >> (8 - k), c >> (7 - k) & 1) for k in range(8)]
    contexts = set()
    for t, out in zip(texts, held_out, strict=True):
        for raw, at in steps(t):
            for node, bit in bits(raw[at]):
                for d in range(ctw.DEPTH + 1):
                    c = raw[at - d : at]
                    contexts.add((node, c))
                    if not out:
                        counts[node, c][bit] += 1
    below = defaultdict(set)
    for node, c in contexts:
        if c:
            below[node, c[1:]].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(node, c):
        if (node, c) not in memo:
            own = kt(*counts[node, c])
            memo[node, c] = own if len(c) == ctw.DEPTH else math.log(0.5) + np.logaddexp(own, sum(weighted(node, x) for x in below[node, c]))
        return memo[node, c]

    def score(t):
        total = 0.0
        for raw, at in steps(t):
            for node, bit in bits(raw[at]):
                p = None
                for d in range(ctw.DEPTH, -1, -1):
                    c = raw[at - d : at]
                    zeros, ones = counts[node, c]
                    one = (ones + 0.5) / (zeros + ones + 1)
                    stop = math.exp(math.log(0.5) + kt(zeros, ones) - weighted(node, c))
                    p = one if p is None else stop * one + (1 - stop) * p
                total += math.log10(p if bit else 1 - p)
        return total

    return [score(t) for t in texts]


@pytest.mark.parametrize("slots", [22, 4])
def test_op7_scores_equal_a_plain_tree(spark, monkeypatch, slots):
    monkeypatch.setattr(ctw, "SLOT_BITS", slots)  # with few slots most keys are joined
    texts = ["the cat sat on the mat", "the mat sat", "Ünï the CAT", "", None, "zzz the q", "the cat sat on the mat", "on on on"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in ctw.score_documents(docs).collect()}
    plain = plain_ctw([ctw.running(t) for t in texts], [got[i]["held_out"] for i in range(len(texts))])
    assert any(got[i]["held_out"] for i in got)
    for i, p in enumerate(plain):
        assert got[i]["score"] == pytest.approx(p, abs=1e-6)


# op8


def test_op8_takes_the_first_by_odds(spark):
    r = random.Random(6)
    rows = [(i, f"s{i % 4}" if i % 9 else None, words(i, r.choice([1, 5, 30, 200]))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), F.col("size"), F.col("digest")), 11)
    got = mixing.mix(docs).withColumn("u", (hashed.cast("double") + 0.5) / float(1 << 53)).collect()
    by = defaultdict(list)
    for x in got:
        by[x["source"]].append(x)
    for xs in by.values():
        assert sum(x["copies"] * x["size"] for x in xs) == pytest.approx(xs[0]["target"])
        whole = {x["doc_id"]: math.floor(x["copies"] + 1e-9) for x in xs}
        lack = xs[0]["target"] - sum(whole[x["doc_id"]] * x["size"] for x in xs)
        open_ = []
        for x in xs:
            p = max(x["copies"] - whole[x["doc_id"]], 0)
            if p > 1e-9:
                odds = (x["u"] / (1 - x["u"])) / (p / (1 - p))
                open_.append((odds, x))
        run = 0
        for _, x in sorted(open_, key=lambda o: o[0]):
            run += x["size"]
            whole[x["doc_id"]] += run - x["size"] / 2 <= lack
        assert {x["doc_id"]: x["take"] for x in xs} == whole


def test_op8_ends_among_rows_that_repeat(spark):
    """A third of all rows is one row; so many of them are taken as bring the words nearest to the target."""
    rows = [(7, "s0", "a b c")] * 300 + [(i, "s0", words(i, 3)) for i in range(300, 400)] + [(i, "s1", words(i, 40)) for i in range(500, 600)] + [(None, None, "x y")] * 50
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == len(rows)
    for source in ("s0", "s1", None):
        own = [x for x in got if x["source"] == source]
        assert abs(sum(x["take"] * x["size"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own) / 2
        assert all(x["take"] in (math.floor(x["copies"] + 1e-9), math.floor(x["copies"] + 1e-9) + 1) for x in own)


# op9


def test_op9_long_texts_in_blocks(spark):
    proto = open(pieces.model_path(), "rb").read()
    sp = pieces.processor(proto)
    texts = [words(70, 900), words(71, 700).replace(" ", ""), " " * 900, "日本語" * 300, "a b " * 800 + "▁x"]
    got = {x["doc_id"]: x for x in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), proto, chunk=128, block=4).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == sp.encode(t), i
        assert got[i]["same"] == ("▁" not in t)


def test_op9_long_text_at_the_real_chunk(spark):
    proto = open(pieces.model_path(), "rb").read()
    text = words(80, 25_000)
    assert len(text) > 3 * pieces.CHUNK
    got = pieces.encode(spark.createDataFrame([(1, text), (2, text[: pieces.CHUNK]), (3, text[: pieces.CHUNK - 1])], "doc_id long, text string"), proto).collect()
    for x in got:
        assert list(x["ids"]) == pieces.processor(proto).encode(text[: {1: None, 2: pieces.CHUNK, 3: pieces.CHUNK - 1}[x["doc_id"]]]) and x["same"]


def test_op9_remembers_a_bounded_part(monkeypatch):
    monkeypatch.setattr(pieces, "HELD_BYTES", 1 << 16)
    held = pieces.Words(open(pieces.model_path(), "rb").read())
    for i in range(40):
        held.encode([words(900 + i, 400).replace(" ", ""), words(i, 300)])
    assert held.held <= (1 << 16) + 400 * 200 and max(map(len, held.codes)) <= pieces.WORD
    assert sum(len(w) for w in held.codes) < 1 << 17


# op10


def test_op10_posteriors(spark):
    r = random.Random(2)
    vocab = {"aa": "the and of with that", "bb": "der und die nicht das", "cc": "los que una para con"}
    rows = []
    for i in range(120):
        lang = r.choice(sorted(vocab))
        text = " ".join(r.choice(vocab[lang].split()) for _ in range(r.choice([3, 40]))) if i % 17 else r.choice([None, "", "123 456"])
        host = f"{r.choice(['www.', ''])}{'site' if i % 5 else 'blog'}.{lang if i % 4 else 'com'}"
        rows.append((i, text, lang.upper() + "-x" if i % 6 else None, host if i % 19 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb", "cc"]
    got = {x["row"]["doc_id"]: x["language"] for x in langid.identify_documents(docs, ["doc_id"]).collect()}
    scores = {i: s for i, t, _, _ in rows if (s := model.scores(t)) is not None}
    best = {i: int(s.argmax()) for i, s in scores.items()}
    said = {i: lang.split("-")[0].lower() if lang else None for i, _, lang, _ in rows}

    def levels(host):
        parts = (host or "").split(".")
        return ("", host or "", host or "") if len(parts) < 2 else (parts[-1], ".".join(parts[-2:]), host)

    seen = np.zeros((4, 4))
    for i, b in best.items():
        seen[b, model.languages.index(said[i]) if said[i] else 3] += 1
    told = np.log((seen[:, :3] + 0.5) / (seen[:, :3] + 0.5).sum(1, keepdims=True))
    overall = seen.sum(1) + 1
    overall[3] = 0
    overall = np.append(overall[:3] / overall.sum() * (1 - langid.NONE_PRIOR), langid.NONE_PRIOR)

    def prior(key, depth):
        above = overall if depth == 0 else prior(key, depth - 1)
        n = np.bincount([best[i] for i, _, _, h in rows if i in best and levels(h)[: depth + 1] == key[: depth + 1]], minlength=4)
        return (n + langid.STRENGTH * above) / (n.sum() + langid.STRENGTH)

    for i, _, _, host in rows:
        if i not in scores:
            assert not got[i]["accepted"]
            continue
        total = scores[i] + np.log(prior(levels(host), 2)) + (told[:, model.languages.index(said[i])] if said[i] else 0)
        p = np.exp(total - total.max())
        p /= p.sum()
        assert got[i]["probability"] == pytest.approx(p.max(), abs=1e-6)
        assert got[i]["lang"] == ([*model.languages, None])[int(p.argmax())]


def test_op10_hosts_and_markup_change_verdicts(spark):
    """A short text that could be either language follows its page's markup, or else its host."""
    plain = [(i, " ".join(random.Random(i).choices(w.split(), k=40)), lang, "x") for i in range(200) for lang, w in [("aa", "ten one tan ane")] + [("bb", "ten one tin ine")]]
    docs = spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(plain)], "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    page = lambda host, text, lang: (host, f'<html{f" lang={lang}" if lang else ""}><body><script>tan ane</script>{text}</body>')
    many = [page("one.aa", "tan ane tan ane", "aa")] * 40 + [page("two.bb", "tin ine tin ine", "bb")] * 40
    odd = [page("one.aa", "ten one", None), page("two.bb", "ten one", None), page("new.aa", "ten one", None), page("three.cc", "ten one", "bb"), page("three.cc", "ten one", "aa")]
    pages = spark.createDataFrame([(i, f"https://{h}/", html) for i, (h, html) in enumerate(many + odd)], "page_id long, url string, html string")
    got = {x["row"]["page_id"]: x["language"]["lang"] for x in langid.identify_pages(pages, model, ["page_id"]).collect()}
    assert [got[80 + i] for i in range(5)] == ["aa", "bb", "aa", "bb", "aa"]


# The pipeline.


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    long = words(5, 30_000)
    rows = [(i, words(i, 60), "en", "s0", 1, "x") for i in range(20)]
    rows += [(100, long, "en", "s1", 2, "x"), (101, long + " tail", "en", "s1", 2, "x"), (102, None, "en", "s1", None, "x"), (103, "", None, None, 0, "x"), (None, "no id " + words(7, 50), "en", "s0", 3, "x"), (None, "no id " + words(7, 50), "en", "s0", 3, "x")]
    rows += [(104, words(3, 60), "en", "s0", 1, "x")] * 2 + [(104, words(4, 60), "de", "s1", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    held = Counter(tuple(x) for x in docs.collect())
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, "")
    assert known.columns == docs.columns
    out = Counter(tuple(x) for x in known.collect())
    assert all(out[x] <= n for x, n in held.items()) and not any(x[1] in (None, "") for x in out)
    kept = [tuple(x) for x in stages["near_dedup"](spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(held)
    assert {x[0] for x in kept} >= set(range(20)) and sum(x[0] in (100, 101) for x in kept) == 1
    # Of 102 and 103, without words, one stays; 104's texts repeat those of 3 and 4.
    assert sum(x[0] in (102, 103) for x in kept) == 1 and not any(x[0] == 104 for x in kept)
    mixed = Counter(tuple(x) for x in stages["mixing"](spark, docs, "").collect())
    assert set(mixed) <= set(held) and all(n <= 3 * held[x] for x, n in mixed.items())
    tokens = stages["tokenize"](spark, docs, "").collect()
    assert len(tokens) == len(rows) and all(x["round_trip"] for x in tokens)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
