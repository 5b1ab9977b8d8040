"""Vector code compression: product codes over integer codebooks that Lloyd's rounds learn."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond this are set to it, so that sums of 2**32 rows fit 64 bits.
MOST = 2**31
#: Vectors of an Arrow batch: a task holds their distances to all entries of one part at a time.
ROWS = 4096
LONGEST = 2**63 - 1


def whole_vectors(vectors: DataFrame, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """keep and ``v``, floor(SCALE * x) of each component. Rows whose vector is null or holds null or non-finite
    components are dropped. Components beyond MOST are set to it."""
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    within = lambda x: F.greatest(F.least(x, F.lit(float(MOST))), F.lit(float(-MOST)))
    whole = F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(within(x * SCALE)).cast("long"))
    return vectors.where(F.col(column).isNotNull() & fine).select(*keep, whole.alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of the nearest entries of a codebook, and its squared distance: |x|² - 2x·c + |c|² in
    64-bit integers, or in Python's where these could overflow."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    if reach**2 * x.shape[1] >= 2**62:
        x, book = x.astype(object), book.astype(object)
    # |x|² is the same for all entries and comes last.
    far = (book * book).sum(axis=1) - 2 * (x @ book.T)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best] + (x * x).sum(axis=1)


def _matrix(v: pa.ListArray, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(v), dim)


def _sums(books: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and sums of a task's vectors by part and nearest entry: a row for each entry that is nearest to any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = books()
        parts, entries, width = held.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), parts * width)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                best, _ = nearest(part, held[p])
                counts[p] += np.bincount(best, minlength=entries)
                np.add.at(sums[p], best, part)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), *(pa.array(sums[p, e, i]) for i in range(width))], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return run


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) of rows (vec_id, v); None if no row can be cut into so many equal parts.

    The first codebooks are the parts of the rows of the smallest ids; ids that are null come last, rows of one id go by
    their vectors. Vectors of another length than the first of these take no part. Each round sends the codebooks to all
    tasks; each adds up its vectors by nearest entry, a grouped shuffle merges these sums, and an entry that is nearest to
    none stays. Only codebooks reach the driver.
    """
    spark = rows.sparkSession
    cut = rows.where((F.size("v") % parts == 0))
    first = [r[0] for r in cut.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return None
    dim = len(first[0])
    if any(len(v) != dim for v in first):
        cut = cut.where(F.size("v") == dim)
        first = [r[0] for r in cut.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width = dim // parts
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["part int, entry int, n long", *(f"{s} long" for s in names)])
    alike = cut.where(F.size("v") == dim).select("v")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        merged = alike.mapInArrow(_sums(lambda sent=sent: sent.value), schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))
        books = books.copy()
        for r in merged.collect():
            books[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
        sent.unpersist()
    return books


def books_sha256(books: np.ndarray) -> str:
    """Hash of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (``v`` and any others) without v, with ``code``, the nearest entry of each part as two hex digits (more, where
    a codebook has over 256 entries), and ``error``, the squared distances summed, 2**63 - 1 at most. Both are null for a
    vector of another length."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{entries - 1:x}"))
    sent = rows.sparkSession.sparkContext.broadcast(books)
    rest = [c for c in rows.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = sent.value, np.array([f"{i:0{digits}x}" for i in range(entries)])
        for batch in batches:
            v = batch.column("v")
            fits = pc.equal(pc.list_value_length(v), parts * width)
            x = _matrix(v.filter(fits), parts * width)
            code, error = np.full(len(x), "", f"U{digits * parts}"), np.zeros(len(x), object)
            for p in range(parts):
                best, far = nearest(x[:, p * width : (p + 1) * width], held[p])
                code, error = np.char.add(code, words[best]), error + far
            place = np.cumsum(fits.to_numpy(zero_copy_only=False)) - 1
            taken = pa.array(place, mask=~fits.to_numpy(zero_copy_only=False))
            made = [pa.array(code.tolist(), pa.string()).take(taken), pa.array([min(e, LONGEST) for e in error.tolist()], pa.int64()).take(taken)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "code", "error"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "v"]
    return rows.select(*rest, "v").mapInArrow(run, ", ".join([*fields, "code string, error long"]))


def decoded(code: Column, books: np.ndarray) -> Column:
    """The vector (integers) that a code stands for, as an expression: the entries are one constant."""
    parts, entries, _ = books.shape
    digits = max(2, len(f"{entries - 1:x}"))
    held = F.lit(books.reshape(parts * entries, -1).tolist())
    place = lambda p: F.conv(F.substring(code, p * digits + 1, digits), 16, 10).cast("int") + p * entries
    return F.when(code.isNotNull(), F.concat(*(F.get(held, place(p)) for p in range(parts))))


def coded_vectors(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id, embedding, label; other columns are left out. Per kept row vec_id, label, code, error, label_error
    (error summed over equal labels, nulls together, 2**63 - 1 at most) and codebooks_sha256. No kept row: no rows. Rows
    that repeat are coded each; null ids are coded like others.

    Whole vectors are written once and read each round; sums by label are small and meet the rows in a join that Spark
    splits where a label is hot.
    """
    spark = vectors.sparkSession
    small_batches(spark, ROWS, 1 << 24)
    rows = materialize(whole_vectors(vectors, keep=("vec_id", "label")), "vectors")
    books = learn(rows)
    if books is None:
        nothing = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return nothing.withColumns({"label_error": F.lit(None).cast("long"), "codebooks_sha256": F.lit(hashlib.sha256(b"").hexdigest())})
    codes = materialize(encode(rows, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    met = codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return met.withColumn("codebooks_sha256", F.lit(books_sha256(books)))
