"""The pipeline's near-duplicates against all pairs by brute force."""

import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from factmill.llm import jaccard, simhash
from tests.llm.test_operators import plain_components, words


def test_keep_one_takes_near_copies_of_four_fifths(spark):
    """Against all pairs by brute force, a bucket of more than SMALL members among them; op4's distance keeps most."""
    r = random.Random(11)
    rows = []
    for i in range(40):
        w = words(500 + i, 200).split()
        rows.append(" ".join(w))
        for _ in range(40 if i == 0 else 2):
            v = list(w)
            for k in r.sample(range(200), r.randint(1, 6)):
                v[k] = "changed" + str(r.random())
            rows.append(" ".join(v))
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
    part = plain_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    first = {}
    for i, c in sorted(part.items()):
        first.setdefault(c, i)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs).collect()) == sorted(first.values())


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Copies of a text that is not among them: most pairs are just below the threshold, some above, and none may be
    lost where the first member of a bucket links to few."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(3)
    base = words(7, 60).split()
    rows = []
    for i in range(150):
        v = list(base)
        for k in r.sample(range(60), 2 if i % 3 else 1):
            v[k] = f"new{i}x{k}"
        rows.append(" ".join(v))
    rows += ["", "  ", rows[0] + " "]
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
    part = plain_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    groups = {}
    for x in jaccard.jaccard_groups(docs).collect():
        groups.setdefault(x["c"], set()).add(x["doc_id"])
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i in part if part[i] == c) for c in part.values()}


def test_texts_whose_first_hash_clashes_are_apart(spark, monkeypatch):
    """Different texts stay different texts; copies are one, and blocks are cut by bytes too."""
    monkeypatch.setattr(jaccard, "text_key", lambda t: [(F.xxhash64(t) % 3).alias("digest"), F.xxhash64(F.lit(1), t).alias("other")])
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    base = words(70, 60).split()
    rows = [words(600 + i, 60) for i in range(30)] + [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(2, 58)]
    docs = spark.createDataFrame(list(enumerate(rows)) + [(1000 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
    part = plain_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_groups(docs).collect()}
    least = {}
    for i, c in sorted(part.items()):
        least.setdefault(c, i)
    assert got == {i + add: least[c] for i, c in part.items() for add in (0, 1000)}


def test_fingerprints_alone_connect_near_copies(spark, monkeypatch):
    """Without MinHash bands too: the blocks of the fingerprints and their distance find all of the candidates of some
    0.88 and most of those just above 0.8."""
    monkeypatch.setattr(jaccard, "band_rows", lambda nodes: jaccard.print_rows(nodes).where("false"))
    r = random.Random(23)

    def copy(w, changes):
        v = list(w)
        for k in r.sample(range(250), changes):
            v[k] = f"new{r.random()}"
        return " ".join(v)

    rows = [copy(words(900 + i, 250).split(), n) for i in range(60) for n in (0, 1, 2, 3, 40)] + ["", " \t", None]
    whole = len(rows)
    rows += [copy(words(2000 + i, 250).split(), n) for i in range(60) for n in (0, 5)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").split() for t in rows)]
    part = plain_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for i, c in sorted(part.items()):
        least.setdefault(c, i)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_groups(docs).collect()}
    assert {i: got[i] for i in range(whole)} == {i: least[part[i]] for i in range(whole)}
    close = [i for i in range(whole, len(rows)) if least[part[i]] != i]
    assert len(close) >= 50 and sum(got[i] == least[part[i]] for i in close) >= 0.75 * len(close)


def test_pairs_are_held_against_the_distance_of_their_fingerprints(spark):
    """Against plain bits; sets of similarity 0.8 lie within the distance, unrelated ones beyond, and 47 bits always meet."""
    r = random.Random(5)
    shared = [np.array(sorted(r.sample(range(1 << 62), 50)), np.uint64) for _ in range(20)]
    sets = [s[k : k + 45] for s in shared for k in (0, 5)] + [np.zeros(0, np.uint64)] * 2
    prints = jaccard.set_prints(sets)
    flipped = prints.copy()
    for row in flipped:
        for bit in [64 * w + b for w in range(jaccard.PRINT_WORDS) for b in r.sample(range(64), 4)][:-1]:
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    every = np.concatenate([prints, flipped])
    nodes = spark.createDataFrame([(i, p.view(np.int64).tolist()) for i, p in enumerate(every)], "node long, print array<bigint>")
    apart = [[bin(int.from_bytes(a.tobytes()) ^ int.from_bytes(b.tobytes())).count("1") for b in prints] for a in prints]
    pairs = spark.createDataFrame([(a, b) for a in range(len(sets)) for b in range(a)], "a long, b long")
    got = {(x["a"], x["b"]) for x in jaccard.print_pairs(pairs, nodes).collect()}
    assert got == {(a, b) for a in range(len(sets)) for b in range(a) if apart[a][b] <= jaccard.DISTANCE} == {(k + 1, k) for k in range(0, len(sets), 2)}
    meet = {(x["part"], x["key"], x["node"]) for x in jaccard.print_rows(nodes).collect()}
    buckets = {}
    for part, key, node in meet:
        buckets.setdefault((part, key), set()).add(node)
    assert len(meet) == len(every) * 96
    assert all(any({i, i + len(sets)} <= b for b in buckets.values()) for i in range(len(sets)))


def test_a_group_of_near_copies_moves_with_its_size_not_its_square(spark, monkeypatch, tmp_path):
    """Texts in large buckets that nothing links to the group of copies there meet it once for each of its blocks; its
    members, in one component already, are not dealt against each other. Twice the group moves about twice the rows."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    inner = jaccard._block_links

    def run(copies):
        log = tmp_path / f"rows{copies}"
        log.mkdir()

        def logged(block):
            with open(log / str(uuid.uuid4()), "w") as f:
                f.write(str(block.num_rows))
            return inner(block)

        monkeypatch.setattr(jaccard, "_block_links", logged)
        r = random.Random(31)
        base = words(41, 200).split()
        rows = []
        for changes in [1] * copies + [9] * 6:
            v = list(base)
            for k in r.sample(range(8, 192), changes):
                v[k] = f"new{r.random()}"
            rows.append(" ".join(v))
        sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
        part = plain_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
        least = {}
        for i, c in sorted(part.items()):
            least.setdefault(c, i)
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        assert {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_groups(docs).collect()} == {i: least[c] for i, c in part.items()}
        assert len(least) == 7
        return sum(int(f.read_text()) for f in log.iterdir())

    few, many = run(64), run(128)
    assert 0 < few and many <= 2.5 * few


def test_members_of_two_components_meet_in_a_group(spark, monkeypatch):
    """Any two members of a bucket and of two components, where the home is met as a whole and where bucket by bucket."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(8)
    label = {node: (0 if node < 60 else 1000 if node < 500 else node) for node in range(560)}
    buckets = {(p, k): r.sample(range(60), 40) + r.sample(range(500, 512), r.randint(4, 12)) for p in range(5) for k in range(3)}
    buckets |= {(7, k): r.sample(range(60, 500), 6) + r.sample(range(560), 1 + 5 * k) for k in range(3)}
    buckets = {k: sorted(set(v)) for k, v in buckets.items()} | {(9, 0): list(range(10))}
    large = spark.createDataFrame([(p, k, x) for (p, k), v in buckets.items() for x in v], "part int, key long, node long")
    labels = spark.createDataFrame([(x, 10, c) for x, c in label.items()], "node long, size long, c long")
    groups = {}
    for x in jaccard.block_members(large, labels).collect():
        groups.setdefault((x["part"], x["key"], x["lo"], x["hi"]), ([], []))[x["side"]].append(x["node"])
    met = set()
    for (part, _, lo, hi), (a, b) in groups.items():
        met |= {frozenset((x, y)) for x in a for y in (a if part >= 0 and lo == hi else b) if label[x] != label[y]}
    assert {frozenset((x, y)) for v in buckets.values() for x in v for y in v if label[x] != label[y]} <= met
    assert {part < jaccard.HOME for part, *_ in groups if part < 0} == {True, False}
    assert not any(part == 9 for part, *_ in groups)


def test_a_member_of_many_large_buckets_meets_few_of_their_first(spark, monkeypatch):
    """Pairs of a group of copies grow with its members, not with the buckets of each; small buckets give all pairs."""
    seen = []
    inner = jaccard.print_pairs
    monkeypatch.setattr(jaccard, "print_pairs", lambda pairs, nodes: seen.append(pairs.count()) or inner(pairs, nodes))
    r = random.Random(77)
    base = words(43, 60).split()
    rows = [" ".join("x" + str(r.random()) if k in at else w for k, w in enumerate(base)) for at in (r.sample(range(60), 2) for _ in range(200))]
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
    part = plain_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for i, c in sorted(part.items()):
        least.setdefault(c, i)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_groups(docs).collect()} == {i: least[c] for i, c in part.items()}
    assert len(seen) == 1
    buckets = [(p, 0, x) for p in range(50) for x in range(p, 70)] + [(60, 1, x) for x in (1, 2, 3, 4)]
    import pyarrow as pa

    batch = pa.table({"part": pa.array([b[0] for b in buckets], pa.int32()), "key": [b[1] for b in buckets], "node": [b[2] for b in buckets]}).to_batches()
    got = [tuple(x.values()) for b in jaccard._bucket_pairs(iter(batch)) for x in b.to_pylist()]
    assert sorted(x[2:] for x in got if x[0] == jaccard.ALL) == [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]
    stars = [x[2:] for x in got if x[0] == jaccard.STAR]
    assert sorted(stars) == sorted((p, x) for p in range(50) for x in range(p + 1, 70))
    hubs = [(x["a"], x["b"]) for x in jaccard.hub_pairs(spark.createDataFrame(stars, "a long, b long")).collect()]
    assert len(set(hubs)) == len(hubs) <= 4 * 69 and set(hubs) <= set(stars) and {b for _, b in hubs} == set(range(1, 70))
