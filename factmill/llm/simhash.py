"""Near-duplicates by SimHash with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import materialize, one_of_each, shuffle_partitions, small_batches
from factmill.llm.components import connected_components
from factmill.llm.jaccard import jaccard_groups

DISTANCE = 3
#: Blocks of a fingerprint. Pairs within DISTANCE agree on BLOCKS - DISTANCE whole blocks at least.
BLOCKS = 6
#: Blocks in a second split, of the bits that the first left open, for the members of large buckets.
FINE_BLOCKS = 8
#: Distinct fingerprints of one bucket that a task compares at a time; larger buckets are split again.
BUCKET = 8192
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 majority bits over XXH64 of all word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    ends = ends[min(width, len(words)) - 1 :].tolist()
    starts = [0, *(np.cumsum([len(w) + 1 for w in words[: len(ends) - 1]]).tolist() if len(ends) > 1 else [])]
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(found, pa.int64())], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and fp (the bits of the fingerprint as a long) of every row; null text has no words."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return slim.mapInArrow(_print_batches, "doc_id long, digest long, fp long")


def _masks(open_bits: list[int], blocks: int) -> list[int]:
    """One mask for each choice of blocks that must agree, over the given bits dealt into blocks of near-equal width."""
    cut = [len(open_bits) * k // blocks for k in range(blocks + 1)]
    widths = [sum(1 << b for b in open_bits[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
    return [sum(c) for c in combinations(widths, blocks - DISTANCE)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_links(fps: np.ndarray) -> np.ndarray:
    """Pairs (two columns) that connect the distinct fingerprints of one bucket as all pairs within DISTANCE would:
    breadth first from a seed, each newly reached one linked to the seed, so never more pairs than members."""
    left, out = fps, []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = np.array([seed], np.uint64)
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                hit |= (np.bitwise_count(front[k : k + 64, None] ^ left[None, :]) <= DISTANCE).any(0)
            front, left = left[hit], left[~hit]
            out.append(np.stack([np.full(len(front), seed), front]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)


def _join_buckets(limit: int):
    """Over rows (part, key, fp) sorted by all three: links inside each bucket, or its rows again where it has more
    than limit members. Memory holds one bucket of limit members and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, t) for t in (np.int32, np.int64, np.uint64)]
        spilling: tuple | None = None

        def out(kind: str, a: np.ndarray, b: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(part, pa.int32())], ["kind", "a", "b", "part"])

        def links(part: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])))) if len(part) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(part)))
            few = np.repeat(sizes <= 8, sizes)
            group = np.repeat(np.arange(len(starts)), sizes)
            for k in range(1, 8):
                if len(fp) > k:
                    hit = few[:-k] & (group[:-k] == group[k:]) & (np.bitwise_count(fp[:-k] ^ fp[k:]) <= DISTANCE)
                    if hit.any():
                        yield out("link", fp[:-k][hit], fp[k:][hit], part[:-k][hit])
            found = [_bucket_links(fp[s : s + n]) for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True)]
            if found:
                both = np.concatenate(found, axis=1)
                yield out("link", both[0], both[1], np.zeros(both.shape[1], np.int32))

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            part, key, fp = kept
            if spilling is not None:
                more = (part == spilling[0]) & (key == spilling[1])
                if more.any():
                    yield out("large", fp[more], key[more].view(np.uint64), part[more])
                    part, key, fp = kept = [x[~more] for x in kept]
                if len(part):
                    spilling = None
            if not len(part):
                continue
            same = (part == part[-1]) & (key == key[-1])
            last = int(np.argmax(same))
            if last:
                # Whole buckets, but those above the limit go out as they are.
                change = np.flatnonzero((part[1:last] != part[: last - 1]) | (key[1:last] != key[: last - 1])) + 1
                sizes = np.diff(np.concatenate(([0], change, [last])))
                large = np.repeat(sizes > limit, sizes)
                if large.any():
                    yield out("large", fp[:last][large], key[:last][large].view(np.uint64), part[:last][large])
                yield from links(*(x[:last][~large] for x in kept))
            kept = [x[last:] for x in kept]
            if len(kept[0]) > limit:
                part, key, fp = kept
                yield out("large", fp, key.view(np.uint64), part)
                spilling, kept = (part[-1], key[-1]), [x[:0] for x in kept]
        yield from links(*kept)

    return run


LINKS = "kind string, a long, b long, part int"


def _bucketed(rows: DataFrame, limit: int) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.select("part", "key", "fp").repartition(n, "part", "key").sortWithinPartitions("part", "key", "fp")
    return dealt.mapInArrow(_join_buckets(limit), LINKS)


def hamming_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """prints: fp, distinct. Pairs a, b that connect the fingerprints exactly as all pairs within DISTANCE do.

    Each fingerprint goes to one bucket for every choice of BLOCKS - DISTANCE blocks, some 32 agreeing bits. In a
    bucket at most one pair per member is given. The members of a bucket of more than ``bucket`` are split again by
    the bits that its blocks leave open: these differ in DISTANCE at most too, so pigeonholes over FINE_BLOCKS of
    them lose no pair, and such a bucket has 4096 members at most, as only 12 bits stay open.
    """
    first = _masks(list(range(64)), BLOCKS)
    keys = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(first)]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.key", "fp")
    found = materialize(_bucketed(rows, bucket), "blocks")
    # A large bucket: part says which mask, so which bits are open.
    fine = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(first):
        masks = [_signed(m | x) for x in _masks([b for b in range(64) if not m >> b & 1], FINE_BLOCKS)]
        fine = F.when(F.col("part") == i, F.array(*(F.lit(x).cast("long") for x in masks))).otherwise(fine)
    large = found.where(F.col("kind") == "large").select(F.col("a").alias("fp"), F.col("part").alias("coarse"), fine.alias("masks"))
    spread = large.select("fp", "coarse", F.posexplode("masks").alias("at", "mask"))
    again = spread.select((F.col("coarse") * 1000 + F.col("at")).cast("int").alias("part"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    links = found.where(F.col("kind") == "link").select("a", "b")
    return links.union(_bucketed(again, 1 << 14).select("a", "b"))


def near_groups(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (other columns are ignored). Returns per row doc_id, digest (of the text), fp, c (the least
    fingerprint of its component) and component_id, the smallest doc_id that can be reached over links of DISTANCE
    bits or fewer, itself included.

    Null or wordless texts have fingerprint zero and link like any other. A null doc_id never names a component
    unless it has no other member. Repeated rows get a row each. No documents: no rows.

    Documents of one fingerprint are one node, so copies are never paired with each other.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(hamming_links(nodes.select("fp")))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    named = materialize(named.select("fp", "least", "c"), "members")
    tops = named.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(tops, "c").select("fp", "c", "component_id"), "groups")
    return prints.join(ids, "fp").select("doc_id", "digest", "fp", "c", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of jaccard_groups (five-word shingles, similarity 0.8 or more; op4's distance of
    3 would leave most such copies), with all columns of docs: that of the smallest doc_id; of rows that share it the
    least by hash of the text, and of rows alike in both any one."""
    groups = jaccard_groups(docs)
    ident = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("c").agg(F.min(F.struct("doc_id", "digest")).alias("k"))
    kept = materialize(kept.select(ident(F.col("k.doc_id")).alias("ident"), F.col("k.digest").alias("digest")), "kept")
    rows = one_of_each(docs, {"ident": ident(docs["doc_id"]), "digest": F.xxhash64(docs["text"])})
    return rows.join(kept, ["ident", "digest"], "left_semi").select("row.*")


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
