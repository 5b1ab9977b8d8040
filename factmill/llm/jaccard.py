"""Near-duplicates by the Jaccard similarity of word shingles: candidates by wide SimHash fingerprints, in pigeonhole
blocks and then by distance, each verified exactly. MinHash bands add candidates where no blocks of a pair agree."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import materialize, shuffle_partitions, small_batches
from factmill.llm.components import connected_components
from factmill.llm.sketch import RUN_BYTES, _mix, shingle_hashes

#: Words of a shingle and least similarity of near-duplicates.
WORDS, LEAST = 5, 0.8
#: Pairs of similarity s share a band with a chance of 1 - (1 - s**ROWS)**BANDS: 0.99994 at 0.8.
BANDS, ROWS = 32, 6
#: Words of 64 bits of a fingerprint.
PRINT_WORDS = 12
#: Sets of similarity LEAST differ in 0.15 of their 768 bits on average, in 0.19 where they are smallest (four shingles
#: and five): in more than DISTANCE bits with a chance of some 3 in 10**7. Unrelated sets differ in half.
DISTANCE = 200
#: Of the eight bytes of each word three must agree, for one of these choices. Two choices of a word share one byte at
#: most, and three differing bits leave one of the eight whole, so pairs within 47 bits always meet; at LEAST some four
#: in five do, at 0.9 all but some in 10**3.
MASKS = [sum(0xFF << 8 * (k % 8) for k in (i, i + 1, i + 3)) for i in range(8)]
_STEPS = np.arange(1, PRINT_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Up to so many members of a bucket are all paired at once; larger ones first with one member, then in blocks of some
#: BLOCK members or BLOCK_BYTES of text, two at a time.
SMALL, BLOCK, BLOCK_BYTES = 4, 256, 4 << 20
#: The part of groups that are no bucket's, but of a component and those that share buckets with it.
HOME = -1
#: The parts of pairs: all of a small bucket, and those of a large one with its first member.
ALL, STAR = -1, -2
_FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Shingles whose least hashes are taken at a time.
CHUNK = 1 << 15


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; null counts as empty."""
    out: list[np.ndarray] = []
    run: list[bytes] = []
    size = 0

    def flush() -> None:
        hashes, counts = shingle_hashes(run, WORDS)
        at = 0
        for n in counts.tolist():
            out.append(np.unique(hashes[at : at + n]))
            at += n
        run.clear()

    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > RUN_BYTES:
            flush()
            size = 0
        run.append(b)
        size += len(b) + 1
    if run:
        flush()
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One key for each set (row) and band; empty sets share all of theirs."""
    least = np.full((BANDS * ROWS, len(sets)), (1 << 64) - 1, np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= CHUNK):
            size += len(sets[full[end]])
            end += 1
        own = full[at:end]
        joined = np.concatenate([sets[i] for i in own])
        starts = np.cumsum([0, *(len(sets[i]) for i in own[:-1])])
        for k, factor in enumerate(_FACTORS):
            least[k, own] = np.minimum.reduceat(joined * factor, starts)
        at = end
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for k in range(ROWS):
        keys = _mix(keys * np.uint64(0xD6E8FEB86659FD93) + least[k::ROWS] + np.uint64(k + 1))
    return keys.T.copy()


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each set (row), PRINT_WORDS words of 64 majority bits over all of its hashes; 0 for an empty set."""
    out = np.zeros((len(sets), PRINT_WORDS), np.uint64)
    for i, s in enumerate(sets):
        ones = np.zeros(64 * PRINT_WORDS, np.int64)
        for k in range(0, len(s), 255):  # as many as a byte counts
            bits = np.unpackbits(_mix(s[k : k + 255, None] + _STEPS).view(np.uint8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.uint8)
        out[i] = np.packbits(ones * 2 > len(s), bitorder="little").view(np.uint64)
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.view(np.int64).ravel()))


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *KEY, "size")), _lists(set_prints(sets)), _lists(band_keys(sets))], ["doc_id", *KEY, "size", "print", "bands"])


#: What names a text: 128 bits, so that two different texts of even 10**10 don't meet.
KEY = ("digest", "other")


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("digest"), F.xxhash64(F.lit(1), text).alias("other")]


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (part, key, node) sorted by all three: pairs of each bucket. A bucket of up to SMALL gives all of its
    pairs (part ALL); a larger one those with its first member (part STAR), and its rows again. No bucket is held."""
    head: list[int] = []
    now: tuple | None = None
    out: list[tuple] = []
    first, count = 0, 0
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(3)]
        same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
        # Most buckets have one member and pair nothing; those at the ends of a batch may have more.
        met = np.ones(batch.num_rows, bool)
        met[1:-1] = same[1:] | same[:-1]
        for part, key, node in zip(*(c[met].tolist() for c in columns), strict=True):
            if (part, key) != now:
                out.extend((ALL, 0, *p) for p in combinations(head, 2))
                now, head, first, count = (part, key), [], node, 0
            count += 1
            if count <= SMALL:
                head.append(node)
            else:
                if count == SMALL + 1:
                    out.extend((STAR, 0, first, x) for x in head[1:])
                    out.extend((part, key, x, x) for x in head)
                    head = []
                out.append((STAR, 0, first, node))
                out.append((part, key, node, node))
            if len(out) > 1 << 16:
                yield _pairs(out)
                out = []
    out.extend((ALL, 0, *p) for p in combinations(head, 2))
    yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "key", "a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        texts = dict(zip(a, batch.column("text_a").to_pylist(), strict=True)) | dict(zip(b, batch.column("text_b").to_pylist(), strict=True))
        sets = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
        good = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if similarity(sets[x], sets[y]) >= LEAST]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in good], pa.int64()) for c in (a, b)], ["a", "b"])


def print_rows(nodes: DataFrame) -> DataFrame:
    """node, part and key: the bytes of its fingerprint that must agree, for each word and choice of MASKS."""
    keys = F.array(*(F.col("word").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in MASKS))
    cut = nodes.select("node", F.posexplode("print").alias("at", "word")).select("node", "at", F.posexplode(keys).alias("mask", "key"))
    return cut.select((F.col("at") * len(MASKS) + F.col("mask")).alias("part"), "key", "node")


def band_rows(nodes: DataFrame) -> DataFrame:
    """node, part and key of its MinHash bands; the parts follow those of print_rows."""
    cut = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    return cut.select((F.col("band") + PRINT_WORDS * len(MASKS)).alias("part"), "key", "node")


def print_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose fingerprints differ in DISTANCE bits at most."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("print").alias(f"print_{c}"))
    apart = sum((F.bit_count(F.col("print_a")[k].bitwiseXOR(F.col("print_b")[k])) for k in range(PRINT_WORDS)), F.lit(0))
    return pairs.join(side("b"), "b").join(side("a"), "a").where(apart <= DISTANCE).select("a", "b")


def hub_pairs(stars: DataFrame) -> DataFrame:
    """Four of the pairs a, b of each b at most: a node is in up to one large bucket a part and may meet as many first
    members. They connect most of a group; what they leave apart meets in block_members all the same."""
    by = F.xxhash64("a", "b")
    hubs = F.array_distinct(F.array(F.min("a"), F.max("a"), F.min_by("a", by), F.max_by("a", by)))
    return stars.groupBy("b").agg(hubs.alias("hubs")).select(F.explode("hubs").alias("a"), "b")


def _links(pairs: DataFrame, large: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of the pairs whose texts are at least LEAST alike, and the texts of pairs and of large buckets."""
    pairs = materialize(print_pairs(pairs.distinct(), nodes), "pairs")
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct().join(nodes.select("node", *KEY), "node")
    texts = materialize(texts.join(used, [*KEY]).select("node", "text"), "compared")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return materialize(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verified, "a long, b long"), "links"), texts


def _block_links(block: pa.Table) -> pa.Table:
    """Links that connect the members of two blocks, or of one, as all of their pairs of similarity LEAST or more do:
    pairs of one component are skipped, and a link makes one component of two."""
    side = block["side"].to_numpy()
    node, sets = block["node"].to_numpy(), shingle_sets(block["text"].to_pylist())
    label = np.unique(block["c"].to_numpy(), return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts = ends - size
    whole = block["part"][0].as_py() >= 0 and block["lo"][0].as_py() == block["hi"][0].as_py()
    mark = np.zeros(len(code) and int(code.max()) + 1, bool)
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(side == 0).tolist():
        other = (np.arange(len(node)) > i) if whole else side == 1
        other = np.flatnonzero(other & (label != label[i]))
        if not len(other):
            continue
        own = code[starts[i] : ends[i]]
        mark[own] = True
        upto = np.concatenate(([0], np.cumsum(mark[code])))
        mark[own] = False
        both = upto[ends[other]] - upto[starts[other]]
        union = size[i] + size[other] - both
        for j in other[(union == 0) | (both / np.maximum(union, 1) >= LEAST)].tolist():
            if label[j] != label[i]:
                out.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})


def _blocks(n: Column, size: Column) -> Column:
    """Blocks of so many members of so many bytes: by both, so a block of long texts has few."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _placed(rows: DataFrame, part: Column, key: str, own: str, others: str, side: int) -> DataFrame:
    """Each row in its block, one of the count in column own, once for each block of the other side."""
    block, other = F.pmod(F.xxhash64("node"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
    dealt = rows.select(part.cast("int").alias("part"), F.col(key).alias("key"), "node", "c", block.alias("hi" if side else "lo"), other.alias("lo" if side else "hi"))
    return dealt.select("part", "key", "lo", "hi", F.lit(side).alias("side"), "node", "c")


def block_members(large: DataFrame, labels: DataFrame) -> DataFrame:
    """large: part, key, node, the members of large buckets; labels: node, size, c (its component). Groups (part, key,
    lo, hi) of members to compare, side 0 with side 1, or all where part isn't negative and lo and hi are one block: each
    two members of one bucket and two components meet in one group at least.

    The home of a bucket is the component that has most of its members; the others are its guests. They meet all of the
    home, whatever buckets they share with it, in groups of that home (part HOME), or else its members in each bucket
    (part below HOME), whichever moves fewer rows. Among each other the guests of a bucket meet in blocks of that bucket.
    So the members of a component are never dealt against each other.
    """
    members = materialize(large.join(labels, "node").select("part", "key", "node", "size", "c"), "members")
    counted = members.groupBy("part", "key", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    counted = counted.groupBy("part", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "c", "bytes")).alias("home")).where("parts > 1")
    counted = counted.select("part", "key", "parts", F.col("home.c").alias("home"), (F.col("n") - F.col("home.n")).alias("guests"), (F.col("bytes") - F.col("home.bytes")).alias("bytes"), F.col("home.n").alias("hosts"), F.col("home.bytes").alias("home_bytes"))
    moved = F.col("guests") * F.col("host_blocks") + F.col("hosts") * F.col("guest_blocks")
    # Written, as are the homes, so that both sides of a join are plain shuffles, which AQE can split where a key is hot.
    buckets = counted.withColumns({"guest_blocks": _blocks(F.col("guests"), F.col("bytes")), "host_blocks": _blocks(F.col("hosts"), F.col("home_bytes"))})
    buckets = materialize(buckets.select("part", "key", "parts", "home", "guest_blocks", "host_blocks", moved.alias("moved")), "open")
    outside = materialize(members.join(buckets, ["part", "key"]).where("c <> home").select(*members.columns, "parts", "home", "guest_blocks"), "outside")

    guests = materialize(outside.select("home", "node", "size", "c").distinct(), "guests")
    counts = guests.groupBy("home").agg(F.count(F.lit(1)).alias("guests"), _blocks(F.count(F.lit(1)), F.sum("size")).alias("guest_blocks"))
    hosts = labels.groupBy(F.col("c").alias("home")).agg(F.count(F.lit(1)).alias("hosts"), _blocks(F.count(F.lit(1)), F.sum("size")).alias("host_blocks"))
    apart = buckets.groupBy("home").agg(F.sum("moved").alias("apart"))
    homes = materialize(counts.join(hosts, "home").join(apart, "home").select("home", "guest_blocks", "host_blocks", (moved <= F.col("apart")).alias("whole")), "homes")
    whole = homes.where("whole")
    coming = _placed(guests.join(whole, "home"), F.lit(HOME), "home", "guest_blocks", "host_blocks", 0)
    living = _placed(labels.withColumn("home", F.col("c")).join(whole, "home"), F.lit(HOME), "home", "host_blocks", "guest_blocks", 1)

    own = materialize(buckets.join(homes.where("not whole").select("home"), "home"), "own")
    held = members.join(own.drop("parts", "moved"), ["part", "key"])
    part = HOME - 1 - F.col("part")
    here = _placed(held.where("c <> home"), part, "key", "guest_blocks", "host_blocks", 0).union(_placed(held.where("c = home"), part, "key", "host_blocks", "guest_blocks", 1))

    dealt = _placed(outside.where("parts > 2"), F.col("part"), "key", "guest_blocks", "guest_blocks", 0)
    lo, hi = F.least("lo", "hi"), F.greatest("lo", "hi")
    among = dealt.select("part", "key", lo.alias("lo"), hi.alias("hi"), F.when(F.col("lo") == lo, 0).otherwise(1).alias("side"), "node", "c")
    return coming.union(living).union(here).union(among)


def near_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes: node, KEY, size (bytes), print, bands, distinct; texts: KEY, text, distinct. Pairs a, b of similarity
    LEAST or more that connect the nodes as all such pairs do that share a bucket, of fingerprints or of bands.

    Pairs of a bucket are first held against DISTANCE, then compared as texts.

    In large buckets each member meets a few of their first ones. If that doesn't connect a bucket, those outside of the component that has
    most of them meet that component and each other, in groups of two blocks whose members are compared where they lie
    (block_members): no pair is ever a row, and two members are left uncompared only where they are connected.
    """
    rows = print_rows(nodes).union(band_rows(nodes))
    dealt = rows.repartition(shuffle_partitions(nodes.sparkSession), "part", "key").sortWithinPartitions("part", "key", "node")
    found = materialize(dealt.mapInArrow(_bucket_pairs, "part int, key long, a long, b long"), "buckets")
    large = found.where("part >= 0").select("part", "key", F.col("a").alias("node"))
    stars = hub_pairs(found.where(F.col("part") == STAR).select("a", "b"))
    links, compared = _links(found.where(F.col("part") == ALL).select("a", "b").union(stars), large, nodes, texts)
    if large.isEmpty():
        return links
    parts = connected_components(links)
    labels = materialize(nodes.join(parts, "node", "left").select("node", "size", F.coalesce("component", "node").alias("c")), "labels")
    late = block_members(large, labels).join(compared, "node").groupBy("part", "key", "lo", "hi").applyInArrow(_block_links, "a long, b long")
    return links.union(materialize(late, "late"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (other columns are ignored). Returns per row doc_id, digest (of the text), c (a number of its
    component) and component_id, the smallest doc_id that can be reached over links of similarity LEAST or more.

    Null and wordless texts have no shingles and are alike; a text of fewer than WORDS words is one shingle. Texts of
    one KEY are one node, so copies are never paired with each other.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(docs["text"]), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    prints = materialize(slim.mapInArrow(_print_batches, "doc_id long, digest long, other long, size long, print array<bigint>, bands array<bigint>"), "prints")
    distinct = prints.groupBy(*KEY).agg(F.min("doc_id").alias("least"), F.max("size").alias("size"), F.first("print").alias("print"), F.first("bands").alias("bands"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = docs.select(*text_key(docs["text"]), "text").groupBy(*KEY).agg(F.first("text").alias("text"))
    parts = connected_components(near_links(nodes.select("node", *KEY, "size", "print", "bands"), texts))
    named = nodes.join(parts, "node", "left").select(*KEY, "least", F.coalesce("component", "node").alias("c"))
    named = materialize(named, "members")
    tops = named.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(tops, "c").select(*KEY, "c", "component_id"), "groups")
    return prints.select("doc_id", *KEY).join(ids, [*KEY]).select("doc_id", "digest", "c", "component_id")
