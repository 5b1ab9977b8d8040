"""op13: encoding against a plain version, gradients against differences, accuracy on labels held out, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from factmill.llm import passages

WORDS = "a of the that river, stone. light Water under 42 über-all 'quoted' (and) so!? x/y".split()


def _text(r, n, bad=False):
    words = [WORDS[k] for k in r.integers(0, len(WORDS), n)]
    return " ".join(w.upper() + "!!" if bad else w for w in words)


def plain_passages(text):
    """Whole passages of a text by its words."""
    data = text.encode()
    starts = [i for i, b in enumerate(data) if b not in b" \t\n\v\f\r" and (i == 0 or data[i - 1] in b" \t\n\v\f\r")]
    cuts = [0, *starts[passages.WORDS :: passages.WORDS], len(data)]
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def test_features_are_those_of_each_passage_alone():
    r = np.random.default_rng(2)
    texts = [_text(r, n) for n in (0, 1, 63, 64, 65, 300)] + [" \n ", None, "wörd" * 500, _text(r, 200, True)]
    got = list(passages._encoded(pa.array(texts)))
    rows = np.concatenate([row[piece] for row, piece, _ in got])
    x = np.concatenate([x for _, _, x in got])
    alone = [(i, p) for i, t in enumerate(texts) for p in plain_passages(t or "")]
    assert rows.tolist() == [i for i, _ in alone]
    for k, (_, p) in enumerate(alone):
        _, one = passages.encode(np.frombuffer(p, np.uint8), np.array([0]))
        assert len(one) == 1 and np.allclose(one[0], x[k]), p
        words = p.split()
        assert x[k][0] == pytest.approx(sum(97 <= b <= 122 for b in p) / max(len(p), 1))
        assert x[k][-1] == pytest.approx(len(words) / passages.WORDS)
        assert x[k][-3] == pytest.approx(sum(w in words[:i] for i, w in enumerate(words)) / max(len(words), 1))
        pairs = list(zip(words, words[1:], strict=False))
        assert x[k][-2] == pytest.approx(sum(w in pairs[:i] for i, w in enumerate(pairs)) / max(len(words), 1))


def test_training_follows_the_gradient(monkeypatch):
    r = np.random.default_rng(3)
    sizes = r.integers(1, 5, 30)
    starts = np.cumsum(sizes) - sizes
    x, y, weight = r.normal(size=(sizes.sum(), 6)), r.integers(0, 2, 30).astype(float), r.uniform(0.5, 2, 30)
    monkeypatch.setattr(passages, "SHRINK", 0.0)

    def loss(m):
        h, _, _, e = m.gated(m.scaled(x))
        _, total, z = m.pooled(e, h, starts)
        p = passages._squashed(z / total[:, None] @ m.weights["c"] + m.weights["d"])
        return -(weight / weight.sum() * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    monkeypatch.setattr(passages, "PASSES", 0)
    before = passages.train(x, starts, y, weight)
    # One step of Adam moves each weight by RATE against the sign of its derivative.
    monkeypatch.setattr(passages, "PASSES", 1)
    after = passages.train(x, starts, y, weight)
    for k, v in before.weights.items():
        for at in list(np.ndindex(v.shape))[:5]:
            sides = []
            for by in (1e-5, -1e-5):
                moved = {n: w.copy() for n, w in before.weights.items()}
                moved[k][at] += by
                sides.append(loss(passages.Model(before.mean, before.spread, moved)))
            slope = (sides[0] - sides[1]) / 2e-5
            if abs(slope) > 1e-6:
                assert (after.weights[k][at] - v[at]) == pytest.approx(-passages.RATE * np.sign(slope), rel=1e-2), (k, at)


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    r = np.random.default_rng(4)
    bags = [_text(r, int(n), bad=i % 2 == 0) for i, n in enumerate(r.integers(1, 400, 60))]
    got = [np.concatenate([x for _, _, x in passages._encoded(pa.array([t]))]) for t in bags]
    sizes = np.array([len(x) for x in got])
    model = passages.train(np.concatenate(got), np.cumsum(sizes) - sizes, np.arange(60) % 2.0, np.ones(60))
    whole, count = model.scores(pa.array(bags))
    assert ((whole >= 0.5) == (np.arange(60) % 2 == 1)).all() and (count == sizes).all()
    # A piece that holds whole passages changes nothing.
    words = [f"w{k:06}" for k in range(64 * 40)]
    text = " ".join(words) + " "
    alone, n = model.scores(pa.array([text]))
    monkeypatch.setattr(passages, "PIECE", 64 * 8 * 4)
    again, m = model.scores(pa.array(["x", text, None]))
    assert n[0] == m[1] == 40 and again[1] == pytest.approx(alone[0], abs=1e-12)


def test_op13_learns_quality_from_rows_not_held_out(spark):
    r = np.random.default_rng(6)
    rows = [(i, _text(r, int(r.integers(5, 300)), bad=i % 4 == 0), "x", 0.5) for i in range(600)]
    # Noise in a part of the passages.
    rows += [(600 + i, _text(r, 200) + " " + _text(r, 200, bad=i % 2 == 0), "x", 0.5) for i in range(200)]
    label = lambda i: int(i % 4 > 0) if i < 600 else int(i % 2 > 0)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # Labels of rows held out are wrong; they must teach nothing. Ids that disagree say nothing.
    labels = [(i, label(i) if not held(i) else 1 - label(i), 0) for i, *_ in rows] + [(7, 1 - label(7), 0), (None, 1, 0), (11, None, 0), (12, 5, 0), (99_999, 1, 0)]
    docs = spark.createDataFrame([*rows, (None, "a b", "", 0.0), (5000, None, "", 0.0), (5001, "", "", 0.0), (5002, "\n", "", 0.0), rows[3]], "doc_id long, text string, lang string, score double")
    got = passages.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 5
    by = {x["doc_id"]: x for x in got}
    assert all(x["held_out"] == (x["doc_id"] is not None and held(x["doc_id"])) and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    right = [by[i]["predicted"] == label(i) for i, *_ in rows if held(i)]
    assert sum(right) / len(right) > 0.97
    assert by[5000]["score"] == by[5001]["score"] and by[5002]["passages"] == 1


def test_op13_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x["score"] for x in passages.quality_scores(docs, none).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(i, 1) for i in (2, 3)], "doc_id long, quality int")
    taught = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (2, 3))
    assert {x["score"] for x in passages.quality_scores(docs, ones).collect()} == {round((taught + 1) / (taught + 2), 9)}
    assert passages.quality_scores(docs.where("false"), ones).collect() == []
    # Labels of both kinds whose documents are absent.
    both = spark.createDataFrame([(i, i % 2) for i in range(50, 80)], "doc_id long, quality int")
    assert len(passages.quality_scores(docs, both).collect()) == 2


def test_op13_on_the_given_tables(spark):
    d = "/root/testdata/sf0.01"
    got = passages.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    met = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(met) > 100 and sum(a == b for a, b in met) / len(met) > 0.95
