"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.llm.common import global_position, materialize, one_of_each

WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size, and a document at most so many copies.
MOST = 3
#: Cells of each of two histograms of ranks; what is left after both is ordered exactly.
CELLS = 4096
SEED = 8


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sizes: source, source_size. Adds target: the total shared by weights, which repeat over the sources in code
    point order, null last; no target above ``most`` times its source, the excess shared again by weight. Each round
    is one aggregation to three numbers, whatever the number of sources."""
    ranked, _ = global_position(sizes, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("w") * level >= F.col("cap")
        n, spent, open_w = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == capped or not open_w:
            break
        capped, level = n, (total - spent) / open_w
    target = F.least(F.col("w") * F.lit(level or 0.0), F.col("cap")) if level is not None else F.lit(0.0)
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def expected_copies(docs: DataFrame, most: int) -> DataFrame:
    """docs: source, size, target, source_size ... Adds copies: expected copies of each document, in proportion to its
    importance (one more than the whole part of log2(1 + size)) and at most ``most``, so that the expected words of
    a source are its target. At most 64 classes of importance per source are solved."""
    importance = (F.floor(F.log2(F.col("size") + 1)) + 1).cast("double")
    classes = docs.withColumn("g", importance).groupBy("source", "g").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    up = Window.partitionBy("source").orderBy(F.col("g").desc())
    before = F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("g") * F.col("words")).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # If all classes above this one are full, this is the factor of the rest; the largest g first, so the first that
    # fits is right.
    factor = classes.withColumn("f", F.when(after > 0, (F.col("target") - most * before) / after))
    fits = (F.col("f") * F.col("g") <= most * (1 + 1e-12)) & (F.col("f") >= 0)
    chosen = factor.where(fits).groupBy("source").agg(F.max_by("f", "g").alias("f"))
    mean = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.coalesce("f", F.lit(float(most))) * importance)).otherwise(0.0)
    return docs.join(chosen.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", mean).drop("s", "f")


def _cumulated(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Adds before: words of the earlier cells of a group; cells are few."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))


#: Parts that rows alike in rank are dealt into where a sample ends among them.
SALTS = 64


def _ends(last: DataFrame) -> DataFrame:
    """last: the rows of the cell in which a source's sample ends. Adds take: a row is in if that brings the words nearer
    to the lack. Rows alike in all that ranks them are one row with a count in the order; so many of them as the
    sample takes are then chosen part by part, so that repeats, however many, are never ordered in one task."""
    alike = F.to_json(F.struct("source", "place", "id", "digest", "size"))
    rows = materialize(last.withColumn("alike", alike).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))), "last")
    ranks = rows.groupBy("alike").agg(F.count(F.lit(1)).alias("m"), *(F.first(c).alias(c) for c in ("source", "place", "id", "digest", "size", "lack")))
    before = F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("source").orderBy("place", "id", "digest").rowsBetween(Window.unboundedPreceding, -1))
    quota = F.floor((F.col("lack") - F.coalesce(before, F.lit(0))) / F.col("size") + 0.5)
    ranks = ranks.select("alike", F.greatest(F.least(quota, F.col("m")), F.lit(0)).alias("quota"))
    earlier = F.sum("count").over(Window.partitionBy("alike").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("alike", "salt").count().withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(ranks, "alike")
    nth = F.row_number().over(Window.partitionBy("alike", "salt").orderBy("salt"))
    met = rows.join(parts.select("alike", "salt", "earlier", "quota"), ["alike", "salt"]).withColumn("nth", nth)
    taken = F.when(F.col("earlier") + F.col("nth") <= F.col("quota"), 1).otherwise(0)
    return met.withColumn("take", F.col("whole") + taken).drop("alike", "salt", "earlier", "quota", "nth")


def pareto_sample(docs: DataFrame) -> DataFrame:
    """docs: source, size, copies, id, ... with expected copies. Adds take: whole copies for certain, and one more for
    the documents that Pareto order sampling selects by the rest of copies, p: ranked by u/(1-u) over p/(1-p), the
    first are taken until their words come nearest to the words that the source still lacks.

    No source is ever sorted in one task: the rank is cut into cells twice, CELLS each, and only the cell in which
    the source's sample ends is ordered.
    """
    whole = F.floor(F.col("copies") + 1e-9)
    p = F.greatest(F.col("copies") - whole, F.lit(0.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id", "size", "digest"), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (p / (1 - p))
    place = F.when(p > 1e-9, odds / (1 + odds))
    spot = F.least(F.floor(place * CELLS * CELLS), F.lit(CELLS * CELLS - 1)).cast("long")
    cells = docs.withColumn("whole", whole.cast("long")).withColumn("place", place).withColumn("spot", spot)
    cells = materialize(cells.withColumn("cell", F.floor(F.col("spot") / CELLS).cast("long")), "ranked")
    lacks = cells.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("lack"))
    open_ = cells.where("spot is not null")

    def ends(group: Sequence[str], key: str, rows: DataFrame, lack: DataFrame) -> DataFrame:
        """The cell of each source in which its sample ends, and what is lacking there."""
        summed = _cumulated(rows.groupBy("source", key).agg(F.sum("size").alias("words")), ["source"], key)
        met = summed.join(lack.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # The last cell before which the sample is not complete.
        met = met.where(F.col("before") < F.col("lack"))
        return met.groupBy("source").agg(F.max(F.struct(key, (F.col("lack") - F.col("before")).alias("lack"))).alias("e")).select(F.col("source").alias("s"), F.col(f"e.{key}").alias(f"end_{key}"), F.col("e.lack").alias("lack"))

    first = materialize(ends(["source"], "cell", open_, lacks), "ends")
    inside = open_.join(first, F.col("source").eqNullSafe(F.col("s"))).where(F.col("cell") == F.col("end_cell")).drop("s", "end_cell", "lack")
    second = materialize(ends(["source"], "spot", inside, first.select(F.col("s").alias("source"), "lack")), "ends")
    marked = cells.join(second, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    last = _ends(marked.where(F.col("spot") == F.col("end_spot")))
    rest = marked.where(F.col("spot").isNull() | F.col("end_spot").isNull() | (F.col("spot") != F.col("end_spot")))
    rest = rest.withColumn("take", F.col("whole") + F.when(F.col("spot") < F.col("end_spot"), 1).otherwise(0))
    return rest.unionByName(last)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs: doc_id, source, text (other columns are ignored). Returns per row doc_id, source, digest (of the text),
    size, source_size, target, copies (expected) and take (whole copies that the mix takes, ``most`` at most).

    Null text: no words. Null source: a source of its own, the last. Documents without words are not taken. The
    random numbers are hashes of doc_id, size and text, so reruns agree and rows that repeat fare alike up to the
    last cell of a sample. No documents: no rows.
    """
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", F.xxhash64("text").alias("digest"), word_count(F.col("text")).alias("size"))
    rows = materialize(rows, "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = materialize(targets.withColumnRenamed("source", "t"), "targets")
    met = rows.join(targets, F.col("source").eqNullSafe(F.col("t"))).drop("t")
    out = pareto_sample(expected_copies(met, most))
    return out.select("doc_id", "source", "digest", "size", "source_size", "target", "copies", F.col("take").cast("long").alias("take"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs, all columns, as often as mix takes them. Rows alike in doc_id, source and text are one
    document that is taken as often as all of them together."""
    key = lambda id_, source: F.to_json(F.struct(id_.alias("i"), source.alias("s")))
    taken = mix(docs, weights, most).groupBy(key(F.col("doc_id"), F.col("source")).alias("key"), "digest").agg(F.sum("take").alias("take"))
    taken = materialize(taken.where("take > 0"), "taken")
    one = one_of_each(docs, {"key": key(docs["doc_id"], docs["source"]), "digest": F.xxhash64(docs["text"])}).join(taken, ["key", "digest"])
    return one.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take"))).alias("copy")).select("row.*")
