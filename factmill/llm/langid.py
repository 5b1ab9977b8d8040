"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factmill.llm.common import ascii_lower, materialize, small_batches
from factmill.llm.urlfilter import host_of

#: Cells of the table of byte trigrams.
CELLS = 1 << 16
#: The text model is fitted on about so many labelled documents of each language, and all if there are fewer.
SAMPLE = 2000
#: Languages whose counts a task holds, or the driver fetches, at a time; there is a model for every label.
BLOCK = 64
#: Weight of one trigram's evidence: three neighbours share each byte.
TRIGRAM_WEIGHT = 1 / 3
#: Prior of text in no known language, strength of each step of smoothing, and least probability of an answer.
NONE_PRIOR, STRENGTH, LEAST = 0.001, 20.0, 0.5
BYTES = 1 << 20
#: Log probabilities looked up at a time.
LOOKUPS = 1 << 23


_LETTER, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def trigram_cells(raw: np.ndarray) -> np.ndarray:
    """Cell of each three neighbouring bytes that are letters or white space, one a letter at least: numbers, signs and
    addresses belong to no language."""
    letter = _LETTER[raw]
    fine = letter | _SPACE[raw]
    kept = np.flatnonzero(fine[:-2] & fine[1:-1] & fine[2:] & (letter[:-2] | letter[1:-1] | letter[2:]))
    y = raw.astype(np.uint32)
    x = (y[kept], y[kept + 1], y[kept + 2])
    return ((x[0] * np.uint32(0x9E3779B1)) ^ (x[1] * np.uint32(0x85EBCA77)) ^ (x[2] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)


def text_bytes(text: str | None) -> np.ndarray:
    """Lower-cased bytes between spaces; none for a text without a letter."""
    raw = np.frombuffer(f" {text or ''} ".encode("utf-8", "surrogatepass").lower(), np.uint8)
    return raw if _LETTER[raw].any() else raw[:0]


@dataclass
class TextModel:
    """Log probabilities of trigram cells (rows) by language (columns); the last column is text of no known language."""

    languages: list[str]
    table: np.ndarray

    def scores(self, text: str | None) -> np.ndarray | None:
        """Weighted log likelihood by language, None without letters."""
        raw = text_bytes(text)
        if len(raw) < 3:
            return None
        out = np.zeros(self.table.shape[1])
        step = max(1, min(BYTES, LOOKUPS // len(out)))
        for k in range(0, len(raw) - 2, step):
            out += self.table[trigram_cells(raw[k : k + step + 2])].sum(0, dtype=np.float64)
        return out * TRIGRAM_WEIGHT


def folded(label: Column) -> Column:
    """A label or declared language as it is compared: its code of two or three letters, lower-cased, without region. Null
    for what is no such code, so there are no more languages than codes, whatever stands in a column of labels."""
    return F.nullif(F.regexp_extract(ascii_lower(F.trim(label)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), lang, np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[cell])], ["at", "cell", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("at").to_pylist(), strict=True):
            raw = text_bytes(text.as_py())
            if len(raw) >= 3:
                if lang not in held and len(held) == BLOCK:
                    yield from out()
                found = np.bincount(trigram_cells(raw), minlength=CELLS)
                held[lang] = held[lang] + found if lang in held else found
    yield from out()


def fit(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """docs: doc_id, text, lang (the label). Counts come from all labelled documents; the trigrams from those whose
    hash of doc_id and source of labels falls in the share that makes about ``sample`` documents of a language.

    Labels are folded as declared languages are, and each has a model: a column of CELLS floats (256 KB). Tasks get the
    table as a broadcast, once an executor; labels that are no language codes have no part in it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.select("text", folded(docs["lang"]).alias("lang"), "doc_id").where("lang is not null")
    found = dict(tuple(r) for r in labelled.groupBy("lang").count().collect())
    languages = sorted(found)
    table = np.empty((CELLS, len(languages) + 1), np.float32)
    table[:, -1] = -np.log(CELLS)
    if languages:
        shares = spark.createDataFrame([(lang, at, min(1.0, sample / found[lang])) for at, lang in enumerate(languages)], "lang string, at int, share double")
        place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
        chosen = labelled.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("text", "at")
        counted = chosen.mapInArrow(_count_cells, "at int, cell int, n long").groupBy("at", "cell").agg(F.sum("n").alias("n"))
        counted = materialize(counted, "trigrams")
        for k in range(0, len(languages), BLOCK):
            # BLOCK times CELLS rows at most.
            rows = counted.where((F.col("at") >= k) & (F.col("at") < k + BLOCK)).toArrow()
            counts = np.full((CELLS, min(BLOCK, len(languages) - k)), 0.5)
            counts[rows["cell"].to_numpy(), rows["at"].to_numpy() - k] += rows["n"].to_numpy()
            table[:, k : k + counts.shape[1]] = np.log(counts / counts.sum(0))
    return TextModel(languages, table)


def _scorer(spark: SparkSession, model: TextModel):
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([None if (x := sent.value.scores(t)) is None else x.tolist() for t in text], dtype=object)

    return score


def _best(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def host_levels(host: Column) -> list[Column]:
    """Suffix, domain and host of an address, each one with those before; an address without a dot is its own domain."""
    parts = F.split(host, r"\.")
    dotted = F.size(parts) > 1
    suffix = F.when(dotted, F.element_at(parts, -1)).otherwise(F.lit(""))
    domain = F.when(dotted, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(host)
    return [F.coalesce(c, F.lit("")) for c in (suffix, domain, host)]


def _smoothed(cube: DataFrame, keys: list[str], parent: DataFrame | Column) -> DataFrame:
    """prior (array by language) for each key: counts plus STRENGTH times the prior of the key without its last part."""
    each = cube.groupBy(*keys, "best").agg(F.sum("n").alias("n"))
    counts = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("found"), F.sum("n").alias("all"))
    met = counts.withColumn("above", parent) if isinstance(parent, Column) else counts.join(parent.withColumnRenamed("prior", "above"), keys[:-1])
    chance = lambda p, i: (F.coalesce(F.try_element_at("found", i), F.lit(0)) + STRENGTH * p) / (F.col("all") + STRENGTH)
    return met.select(*keys, F.transform("above", chance).alias("prior"))


def identify(docs: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """Returns row, a struct of the columns ``keep`` of docs (all of them if none are named), and ``language``, a struct
    of lang (null if none), probability, text_lang (from the text alone), declared, accepted.

    log posterior = weighted log likelihood of the text's trigrams + log P(declared | language) + log P(language |
    host). The table of what is declared for texts of each language and the counts of languages by host come from one
    grouped aggregation over all rows; a host is smoothed by its domain, that by its suffix, that by all. Text of no
    known language is one more outcome; rows with it, without letters (null and empty ones too), or below LEAST are
    not accepted. An unknown or null declared language and a null host say nothing. Ties: the first language by name.
    Repeated rows are judged alike. No labelled documents: nothing is accepted. The likelihoods are written with the
    kept columns, so each text is scored once.
    """
    small_batches(docs.sparkSession)
    names, size = model.languages, len(model.languages) + 1
    score = _scorer(docs.sparkSession, model)
    whole = F.struct(*(docs[c] for c in keep or docs.columns))
    level = host_levels(F.coalesce(ascii_lower(host), F.lit("")))
    said = folded(declared)
    said = F.when(said.isin(*names), said) if names else F.lit(None).cast("string")
    rows = docs.select(whole.alias("row"), said.alias("declared"), level[0].alias("suffix"), level[1].alias("domain"), level[2].alias("host"), score(text).alias("scores"))
    rows = materialize(rows, "scored")
    cube = rows.where("scores is not null").groupBy("suffix", "domain", "host", "declared", _best(F.col("scores")).alias("best")).agg(F.count(F.lit(1)).alias("n"))
    cube = materialize(cube, "evidence")

    # Languages squared at most.
    place = {name: i for i, name in enumerate(names)}
    seen = np.zeros((size, len(names) + 1))
    for best, lang, n in cube.groupBy("best", "declared").agg(F.sum("n")).collect():
        seen[best, place[lang] if lang is not None else -1] += n
    known = seen[:, :-1] + 0.5
    told = np.log(known / known.sum(1, keepdims=True)) if names else known
    overall = seen.sum(1) + 1
    overall[-1] = 0
    overall = np.append(overall[:-1] / max(overall.sum(), 1) * (1 - NONE_PRIOR), NONE_PRIOR) if names else np.ones(1)

    array = lambda x: F.array(*(F.lit(float(v)) for v in x))
    suffix = _smoothed(cube, ["suffix"], array(overall))
    domain = _smoothed(cube, ["suffix", "domain"], suffix)
    hosts = materialize(_smoothed(cube, ["suffix", "domain", "host"], domain).select("host", "prior"), "hosts")

    # A row for each language; how it meets the rows is left to its size.
    evidence = docs.sparkSession.createDataFrame([(name, told[:, i].tolist()) for i, name in enumerate(names)], "declared string, told array<double>")
    met = rows.join(hosts, "host", "left").join(evidence, "declared", "left")
    met = met.withColumn("prior", F.coalesce("prior", array(overall))).withColumn("told", F.coalesce("told", array(np.zeros(size))))
    total = F.zip_with(F.zip_with("scores", "prior", lambda s, p: s + F.ln(p)), "told", lambda s, t: s + t)
    met = met.withColumn("total", F.when(F.col("scores").isNotNull(), total)).withColumn("top", F.array_max("total")).withColumn("best", _best(F.col("total")))
    chance = 1 / F.aggregate(F.transform("total", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    labels = F.array(*(F.lit(n) for n in names), F.lit(None).cast("string"))
    lang = labels[F.col("best")]
    text_lang = labels[_best(F.col("scores"))]
    found = F.struct(lang.alias("lang"), chance.alias("probability"), text_lang.alias("text_lang"), F.col("declared").alias("declared"), F.coalesce(lang.isNotNull() & (chance >= LEAST), F.lit(False)).alias("accepted"))
    return met.select("row", found.alias("language"))


def identify_documents(docs: DataFrame, keep: Sequence[str] | None = None, model: TextModel | None = None) -> DataFrame:
    """docs: doc_id, text, lang (the declared language), source (the host). Fits the text model on the labels, if none is
    given, and returns row and language as identify does."""
    model = model or fit(docs.select(*(docs[c] for c in ("doc_id", "text", "lang"))))
    return identify(docs, model, docs["text"], docs["lang"], docs["source"], keep)


def markup_language(html: Column) -> Column:
    """The language that a page's html element declares."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3}(?:-[a-z0-9]+)*)""", 1), F.lit(""))


_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """What a page shows: without scripts, styles, comments and tags, entities read."""
    return pd.Series([None if h is None else markup.unescape(_HIDDEN.sub(" ", h)) for h in html], dtype=object)


def page_host(url: Column) -> Column:
    """Host of a url without user and port; null where it has none."""
    return F.nullif(F.regexp_replace(host_of(url), r"^.*@|:\d*$", ""), F.lit(""))


def identify_pages(pages: DataFrame, model: TextModel, keep: Sequence[str] | None = None) -> DataFrame:
    """pages: page_id, url, html. Returns row and language as identify does, from the visible text, the language that
    the markup declares and the levels of the url's host."""
    return identify(pages, model, visible_text(pages["html"]), markup_language(pages["html"]), page_host(pages["url"]), keep)
