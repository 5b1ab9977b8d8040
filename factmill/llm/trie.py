"""Conversation prefix trie: radix partitioning of sequences of turn ids, multikey quicksort in what fits one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import materialize, shuffle_partitions, small_batches

#: A bucket whose sequences have so many turns left at most is finished in one task; a larger one is parted again.
LOCAL_TURNS = 1 << 18
#: Bytes of ids of members, as text, that one row holds before they are hashed.
CHUNK = 1 << 18
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Conversations whose ids differ by less than this share a beginning; a beginning has fewer turns than LENGTHS.
GROUP, LENGTHS = 5, 9
#: An edge ends at the node (rep, bottom): nodes of depths top + 1 to bottom with the same members, of which rep is the
#: least. cum: bytes of all texts from the root to depth top, top + 1, ..., bottom.
EDGE = "rep long, top int, bottom int, up_rep long, n_convs long, n_children long, n_leaves long, below long, cum array<long>, class string"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text. Per conv_id ``seq``, the ids of its turns in order, and ``sizes``, the
    UTF-8 bytes of each text. Turns of equal number, null first, go by digest of role and text. Null roles and texts are
    empty. Rows without conv_id are no turns.

    The dictionary numbers each distinct (role, text); it is joined by digest, so texts never move. One conversation's
    turn ids are one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = materialize(conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")), "turns")
    dictionary = materialize(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    numbered = turns.join(dictionary, "digest").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "id", "size"))).alias("t"))
    return numbered.select("conv_id", F.col("t.id").alias("seq"), F.col("t.size").alias("sizes"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from the conversation of its group's first id (all, if that has
    fewer; none, if there is none); h is the unsigned CRC-32 of its id as text, modulo LENGTHS. Remainders of negative
    ids are negative, so groups meet towards zero."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENGTHS).cast("int")
    head = lists.select(F.col("conv_id").alias("_base"), F.slice("seq", 1, LENGTHS - 1).alias("_seq"), F.slice("sizes", 1, LENGTHS - 1).alias("_sizes"))
    met = lists.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % GROUP, "_h": h}).join(head, "_base", "left")
    none = F.array().cast("array<long>")
    joined = lambda own, base: F.concat(F.slice(F.coalesce(base, none), F.lit(1), F.col("_h")), F.slice(own, F.col("_h") + 1, F.size(own)))
    return met.select("conv_id", joined(F.col("seq"), F.col("_seq")).alias("seq"), joined(F.col("sizes"), F.col("_sizes")).alias("sizes"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, conv_id) in order: the ids of a class joined, CHUNK bytes at most a row."""
    part, seq, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"class": [now], "part": pa.array([part], pa.int32()), "seq": [seq], "ids": [",".join(held)]})

    for batch in batches:
        for c, i in zip(batch.column("class").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (c != now or size > CHUNK):
                yield row()
                seq, held, size = seq + 1, [], 0
            now = c
            held.append(str(i))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _chunks in order, each class in one task: the hash of its ids, taken in as they stream by."""
    now, state = None, None
    done: tuple[list[str], list[str]] = ([], [])
    for batch in batches:
        for c, ids in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if c != now:
                if state is not None:
                    done[0].append(now)
                    done[1].append(state.hexdigest())
                now, state = c, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], ["class", "ends_sha256"])
            done = ([], [])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["class", "ends_sha256"])


def member_digests(members: DataFrame) -> DataFrame:
    """members: class, conv_id. Per class ``ends_sha256``, the hash of its ids in numerical order, joined by commas.

    Ids are sorted over all tasks and joined there to texts of CHUNK bytes; what one task reads of a class, however
    common, is these texts in order, one at a time, as a hash has to.
    """
    n = shuffle_partitions(members.sparkSession)
    ordered = members.repartitionByRange(n, "class", "conv_id").sortWithinPartitions("class", "conv_id")
    texts = ordered.mapInArrow(_chunks, "class string, part int, seq long, ids string")
    return texts.repartition(n, "class").sortWithinPartitions("class", "part", "seq").mapInArrow(_digests, "class string, ends_sha256 string")


def _parted(rows: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
    """rows by equal symbols: three-way quicksort, whose parts of less, equal and greater symbols go on a stack."""
    out, stack = [], [(rows, symbols)]
    while stack:
        rows, symbols = stack.pop()
        pivot = symbols[len(symbols) // 2]
        same = symbols == pivot
        if same.all():
            out.append(rows)
            continue
        out.append(rows[same])
        for side in (symbols < pivot, symbols > pivot):
            if side.any():
                stack.append((rows[side], symbols[side]))
    return out


def _bucket_edges(rep: int, depth: int, reps: np.ndarray, counts: np.ndarray, classes: list[str], seqs: list[np.ndarray], cums: list[np.ndarray]) -> Iterator[tuple]:
    """Edges below the node (rep, depth), all of whose distinct sequences are given, and last a row that carries what the
    node itself has: children, leaves and tokens saved below, with a null class and top -1."""
    lengths = np.array([len(s) for s in seqs])
    # Nodes in the order in which they were met: parents come first, so totals are added up from the end.
    nodes: list[list] = [[rep, -1, depth, None, 0, 0, 0, 0, None, None]]
    above = [-1]
    stack = [(0, np.arange(len(seqs)))]
    while stack:
        at, rows = stack.pop()
        top = nodes[at][2]
        rows = rows[lengths[rows] > top]
        if not len(rows):
            continue
        for part in _parted(rows, np.array([seqs[r][top] for r in rows])):
            first, bottom = seqs[part[0]], top + 1
            least = int(lengths[part].min())
            if len(part) == 1:
                bottom = least
            while bottom < least and all(seqs[r][bottom] == first[bottom] for r in part[1:]):
                bottom += 1
            ended = part[lengths[part] == bottom]
            nodes.append([int(reps[part].min()), top, bottom, nodes[at][0], int(counts[part].sum()), 0, 0, 0, cums[part[0]][top : bottom + 1], classes[ended[0]] if len(ended) else None])
            above.append(at)
            if len(part) > 1:
                stack.append((len(nodes) - 1, part))
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[above[i]]
        node[6] = node[6] or 1
        up[5] += 1
        up[6] += node[6]
        up[7] += node[7] + (node[4] - 1) * int(node[8][-1] - node[8][0])
    yield from (tuple(n) for n in nodes[1:])
    yield tuple(nodes[0])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences in order of their buckets, which are whole in a task: the edges of each bucket."""
    fields = [x.split() for x in EDGE.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    now, held, out = None, [], []

    def table() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    def edges() -> Iterator[tuple]:
        reps, counts, classes, seqs, cums = zip(*held, strict=True)
        return _bucket_edges(*now, np.array(reps), np.array(counts), list(classes), list(seqs), list(cums))

    for batch in batches:
        keys = zip(batch.column("up_rep").to_pylist(), batch.column("up").to_pylist(), strict=True)
        seqs, cums = batch.column("seq"), batch.column("cum")
        rest = zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "class")), strict=True)
        for i, (key, (rep, n, name)) in enumerate(zip(keys, rest, strict=True)):
            if held and key != now:
                out.extend(edges())
                held = []
                if len(out) > 4096:
                    yield table()
            now = key
            held.append((rep, n, name, seqs[i].values.to_numpy(), cums[i].values.to_numpy()))
    if held:
        out.extend(edges())
    if out:
        yield table()


def _cumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sizes as cum: sums of the sizes before each place and after the last."""
    for batch in batches:
        sizes = batch.column("sizes")
        upto = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())])
        ends = np.concatenate([[0], np.cumsum(sizes.value_lengths().to_numpy())])
        # The sum at the end of one list is also where the next begins, so each list has one element more.
        at = np.concatenate([np.arange(a, b + 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]) if len(sizes) else np.zeros(0, int)
        base = np.repeat(upto[ends[:-1]], np.diff(ends) + 1)
        cum = pa.ListArray.from_arrays(pa.array(ends + np.arange(len(ends)), pa.int32()), pa.array(upto[at] - base, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "seq", "rep", "n")), cum], ["class", "seq", "rep", "n", "cum"])


def _common(a: Column, b: Column) -> Column:
    """How many elements two lists share from their start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def trie_edges(classes: DataFrame, local_turns: int = LOCAL_TURNS) -> tuple[DataFrame, DataFrame]:
    """classes: rep (the least member, a different one for each), class (its name), n (members), seq (distinct), cum (bytes
    of the texts up to each depth, from 0). Returns the edges of the trie (EDGE), and the root as one row (n_children,
    n_leaves, below).

    Each round parts the sequences of the open buckets by their next turn id. A grouped aggregation gives each part its
    least and greatest sequence, hence how far all of them agree, and thus one edge. A part of one sequence is a leaf; one
    with local_turns or fewer left is finished by one task; a larger one stays open. So rounds are as many as branchings
    one below another within buckets beyond that size. Totals are added up from the last round to the first.
    """
    spark = classes.sparkSession
    n = shuffle_partitions(spark)
    rows = classes.select(F.lit(None).cast("long").alias("up_rep"), F.lit(0).alias("up"), "rep", "class", "n", "seq", "cum")
    levels, locals_ = [], []
    bucket = [F.col("up_rep").eqNullSafe(F.col("_up_rep")), F.col("up") == F.col("_up"), F.col("digit") == F.col("_digit")]
    while True:
        going = rows.where(F.size("seq") > F.col("up")).withColumn("digit", F.get("seq", F.col("up")))
        agg = going.groupBy("up_rep", "up", "digit").agg(
            F.min(F.struct("seq", "cum", "class")).alias("lo"), F.max("seq").alias("hi"), F.min("rep").alias("rep"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("n_classes"), F.sum(F.size("seq") - F.col("up")).alias("turns"),
        )
        agg = agg.withColumn("bottom", _common(F.col("lo.seq"), F.col("hi")))
        state = F.when(F.col("n_classes") == 1, "leaf").when(F.col("turns") <= local_turns, "local").otherwise("open")
        ended = F.when(F.size("lo.seq") == F.col("bottom"), F.col("lo.class"))
        cum = F.slice("lo.cum", F.col("up") + 1, F.col("bottom") - F.col("up") + 1)
        level = materialize(agg.select("up_rep", F.col("up").alias("top"), "digit", "bottom", "rep", "n_convs", state.alias("state"), cum.alias("cum"), ended.alias("class")), "level")
        levels.append(level)
        states = {r[0] for r in level.select("state").distinct().collect()}
        below = level.where("state <> 'leaf'").select(F.col("up_rep").alias("_up_rep"), F.col("top").alias("_up"), F.col("digit").alias("_digit"), F.col("rep").alias("_rep"), "bottom", "state")
        met = going.join(below, bucket[0] & bucket[1] & bucket[2]).select(F.col("_rep").alias("up_rep"), F.col("bottom").alias("up"), "rep", "class", "n", "seq", "cum", "state")
        if "open" in states:
            met = materialize(met, "buckets")
        if "local" in states:
            dealt = met.where("state = 'local'").drop("state").repartition(n, "up_rep", "up").sortWithinPartitions("up_rep", "up")
            locals_.append(materialize(dealt.mapInArrow(_finish, EDGE), "edges"))
        if "open" not in states:
            break
        rows = met.where("state = 'open'").drop("state")
    inner = spark.createDataFrame([], EDGE)
    for found in locals_:
        inner = inner.unionByName(found)
    parts = [inner.where("top >= 0")]
    tops = inner.where("top < 0")
    for level in reversed(levels):
        # A node is (rep, bottom): its totals come from the task that finished its bucket, or from the next round.
        sums = tops.select(F.col("rep").alias("_rep"), F.col("bottom").alias("_bottom"), "n_children", "n_leaves", "below")
        met = level.join(sums, (F.col("rep") == F.col("_rep")) & (F.col("bottom") == F.col("_bottom")) & (F.col("state") != "leaf"), "left")
        nothing = F.lit(0).cast("long")
        whole = materialize(met.select("rep", "top", "bottom", "up_rep", "n_convs", F.coalesce("n_children", nothing).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("below", nothing).alias("below"), "cum", "class"), "edges")
        parts.append(whole)
        saved = F.col("below") + (F.col("n_convs") - 1) * (F.element_at("cum", -1) - F.get("cum", F.lit(0)))
        added = whole.groupBy(F.col("up_rep").alias("rep"), F.col("top").alias("bottom")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum(saved).alias("below"))
        tops = inner.where("top < 0").select("rep", "bottom", "n_children", "n_leaves", "below").unionByName(added)
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges, added.select("n_children", "n_leaves", "below")


def prefix_trie(sequences: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """sequences: conv_id (one row each), seq, sizes. One row a node: conv_id (its least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No sequences: no rows. Equal sequences are one class with
    many members before anything is parted, so copies cost no more than their ids."""
    spark = sequences.sparkSession
    small_batches(spark)
    named = materialize(sequences.select("conv_id", "seq", "sizes", F.sha2(F.array_join("seq", ",").cast("binary"), 256).alias("class")), "sequences")
    grouped = named.groupBy("class", "seq", "sizes").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped.mapInArrow(_cumulated, "class string, seq array<long>, rep long, n long, cum array<long>"), "classes")
    digests = materialize(member_digests(named.select("class", "conv_id")), "digests")
    edges, root = trie_edges(classes, local_turns)

    columns = ["rep", "top", "bottom", "up_rep", "n_convs", "n_children", "n_leaves", "below", "cum"]
    # Apart, so that edges at whose node nothing ends don't meet in one task.
    ended = edges.where(F.col("class").isNotNull()).join(digests, "class").select(*columns, "ends_sha256")
    passed = edges.where(F.col("class").isNull()).select(*columns, F.lit(EMPTY_SHA256).alias("ends_sha256"))
    every = ended.unionByName(passed).withColumn("depth", F.explode(F.sequence(F.col("top") + 1, F.col("bottom"))))
    least, members = classes.agg(F.min("rep"), F.sum("n")).first()
    last = F.col("depth") == F.col("bottom")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.element_at("cum", -1) - F.get("cum", F.col("depth") - F.col("top") - 1))
    nodes = every.select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("top") + 1, F.col("rep")).otherwise(F.coalesce("up_rep", F.lit(least).cast("long"))).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(EMPTY_SHA256).alias("ends_sha256"),
    )
    if least is None:
        return nodes
    children, leaves, below = root.first() or (0, 1, 0)
    # The class of the empty sequence has the hash of an empty text for its name.
    turnless = digests.where(F.col("class") == EMPTY_SHA256).select("ends_sha256").first()
    top = [(least, 0, None, members, children, leaves, below, turnless[0] if turnless else EMPTY_SHA256)]
    return nodes.unionByName(spark.createDataFrame(top, nodes.schema))


def conversation_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie of all rebuilt conversations; other columns than conv_id, turn, role and text are left out."""
    return prefix_trie(rebuilt(turn_lists(conversations)), local_turns)
