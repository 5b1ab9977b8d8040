"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factmill.llm.common import materialize, small_batches

#: Bytes of queries that tasks hold at a time, vectors of a shard, and products that a tile has.
QUERY_BYTES, SHARD, PRODUCTS = 16 << 20, 8192, 1 << 22
#: Top lists that one merge takes.
FAN_IN = 16
LISTS = "q long, vec_id long, score long"


def _whole(vectors: pa.ListArray) -> np.ndarray:
    """floor(1024 * x) of vectors of one length, one a row."""
    return np.floor(1024 * vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles as long as no sum can pass 2**53, else in Python's integers."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return (q @ c.T).astype(np.int64)
    big = [[int(x) for x in row] for row in c]
    return np.array([[max(1 - 2**63, min(2**63 - 1, sum(map(int.__mul__, [int(x) for x in a], b)))) for b in big] for a in q], np.int64).reshape(len(q), len(c))


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller name."""
    place = np.arange(len(scores))
    if len(place) > k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = place[scores >= worst]
    return place[np.lexsort((names[place], -scores[place]))[:k]]


def _select(block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """For a block of queries, by length of vector their numbers, ids and whole components: the k best of the task's
    vectors for each, a shard of vectors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def take(dim: int) -> None:
            parts = waiting.pop(dim, [])
            if not parts:
                return
            names, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, ids, q = block[dim]
            known = held.get(dim) or [none] * len(q)
            step = max(1, PRODUCTS // len(c))
            for at in range(0, len(q), step):
                for i, row in enumerate(_products(q[at : at + step], c), at):
                    other = names != ids[i]
                    both = np.concatenate([known[i][0], names[other]]), np.concatenate([known[i][1], row[other]])
                    best = _best(both[1], both[0], k)
                    known[i] = both[0][best], both[1][best]
            held[dim] = known

        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in block:
                    rows = batch.filter(pa.array(dims == dim))
                    waiting.setdefault(dim, []).append((rows.column("vec_id").to_numpy(), _whole(rows.column("v"))))
                    if sum(len(n) for n, _ in waiting[dim]) >= SHARD:
                        take(dim)
        for dim in list(waiting):
            take(dim)
        for dim, known in held.items():
            numbers = block[dim][0]
            owner = np.concatenate([np.full(len(n), q) for q, (n, _) in zip(numbers, known, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(owner), *(pa.array(np.concatenate([x[i] for x in known])) for i in (0, 1))], ["q", "vec_id", "score"])

    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """queries and vectors: an id and an array of numbers each. Returns query_id, rank (from 1), vec_id, score: for
    each query its k best inner products of floor(1024 * x), ties to the smaller vec_id.

    A query's candidates are all rows of its length with another id; rows with a null id take no part, nor do vectors
    that are null, empty, or hold null or non-finite components. Query rows that are alike count once; rows of one id
    with different vectors have a list each, all under that id. Repeated candidates each take a rank. Products beyond
    64 bits are clipped to them. No queries or no vectors: no rows.

    Vectors stay where they are. Queries are numbered and cut into blocks of QUERY_BYTES; each block goes to all tasks,
    which multiply it, a tile at a time, by their vectors and keep k a query. Only these lists move: they are merged
    FAN_IN at a time.
    """
    spark = vectors.sparkSession
    small_batches(spark, SHARD, 1 << 26)

    def usable(df: DataFrame, name: str) -> DataFrame:
        a, b = df.columns
        fine = F.forall(F.col(b), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where(fine).select(F.col(a).cast("long").alias(name), F.col(b).cast("array<double>").alias("v"), F.size(b).alias("dim")).where("dim > 0")

    numbered = materialize(usable(queries, "query_id").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    size = numbered.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0] * 8
    blocks = -(-size // QUERY_BYTES)
    asked = materialize(numbered.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1))).cast("int")), "blocks") if blocks > 1 else numbered.withColumn("block", F.lit(0))
    held = usable(vectors, "vec_id")
    lists = None
    for b in range(blocks):
        # QUERY_BYTES on average.
        rows = asked.where(F.col("block") == b).toArrow().combine_chunks()
        dims = rows["dim"].to_numpy()
        block = {d: (part["q"].to_numpy(), part["query_id"].to_numpy(), _whole(part["v"].combine_chunks())) for d in np.unique(dims).tolist() for part in [rows.filter(pa.array(dims == d))]}
        found = held.mapInArrow(_select(block, k), LISTS).withColumn("part", F.spark_partition_id())
        found = materialize(found, "lists")
        lists = found if lists is None else lists.union(found)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = [F.col("score").desc(), F.col("vec_id")]
    parts = (lists.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN_IN:
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
        parts = -(-parts // FAN_IN)
        lists = materialize(lists, "lists")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.join(numbered.select("q", "query_id"), "q").select("query_id", "rank", "vec_id", "score")
