"""Sketches of short texts against true containment."""

from factmill.llm import sketch
from tests.llm.test_operators import words


def test_excerpts_are_found_in_their_texts():
    for k in range(200):
        w = words(1000 + k, 248).split()
        for n in (2 if k % 2 else 5, 6, 25):
            part = w[k % 200 : k % 200 + n]
            text, excerpt = " ".join(w), " ".join(part)
            true = float(n >= 5)
            a, b = sketch.sketches([excerpt, text])
            assert sketch.containment(a, b) == true, (k, n)
        other = words(5000 + k, 124).split()
        mixed = " ".join(w[:124] + other)
        a, b = sketch.sketches([text, mixed])
        assert abs(sketch.containment(a, b) - 120 / 244) < 0.2


def test_walk_finds_one_shingle_in_the_next_text(spark):
    """One-shingle texts, each followed by a longer one that holds it: near_next is one, whatever the hash."""
    rows = []
    for k in range(40):
        w = words(2000 + k, 60).split()
        rows += [(1000 - 2 * k, " ".join(w[20:25])), (999 - 2 * k, " ".join(w))]
    got = {r["doc_id"]: r["near_next"] for r in sketch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 1 for i, _ in rows[::2])
