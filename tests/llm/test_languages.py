"""Languages: every label has a model, and pages are judged by markup and by each level of the host."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.llm import langid, queries


def prose(lang, seed, n=30):
    """Words over the five letters of a language; no two languages share a word's letters often."""
    r = random.Random(lang)
    letters = r.sample("abcdefghijklmnopqrstuvwxyz", 6)
    r = random.Random(f"{lang} {seed}")
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(n))


def test_forty_labels_are_all_modelled(spark):
    codes = [f"{a}{b}" for a in "abcdefgh" for b in "vwxyz"]
    rows = [(i * 100 + k, prose(c, k), c.upper() + "-XX" if k % 2 else c, "src") for i, c in enumerate(codes) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert langid.fit(docs).languages == codes
    got = langid.identify_documents(docs).select("row.lang", "language.*").toDF("label", *"lang probability text_lang declared accepted".split()).collect()
    assert len(got) == len(rows)
    assert all(r["declared"] == r["label"][:2].lower() == r["lang"] and r["accepted"] for r in got)


@pytest.fixture(scope="module")
def model():
    texts = {"de": "der hund und die katze " * 20, "en": "the dog with this cat " * 20}
    table = np.full((langid.CELLS, 3), 0.5)
    for k, t in enumerate(texts.values()):
        table[:, k] += np.bincount(langid.trigram_cells(langid.text_bytes(t)), minlength=langid.CELLS)
    table[:, -1] = 1
    return langid.TextModel(list(texts), np.log(table / table.sum(0)).astype(np.float32))


def test_host_levels_and_markup_change_verdicts(spark, model):
    """The same doubtful text everywhere: only the address, or the markup, tells its language."""
    clear = {"de": "der hund und die katze", "en": "the dog with this cat"}
    hosts = [("a.one.xx", "de"), ("a.two.xx", "en"), ("d.three.xx", "de"), ("e.three.xx", "en"), ("k.four.yy", "en"), ("k.five.zz", "de")]
    rows = [(0, f"http://{h}/{k}", f'<html lang="{w}"><script>the the</script><p>{clear[w]}</p></html>') for h, w in hosts for k in range(60)]
    doubtful = {1: "m.one.xx", 2: "m.two.xx", 3: "d.three.xx", 4: "e.three.xx:80", 5: "n.six.yy", 6: "n.six.zz", 7: "n.six.ww", 8: "n.six.ww"}
    rows += [(i, f"https://{h}/", f'<html{" lang=de" if i == 7 else " lang=en-GB" if i == 8 else ""}><p>qxq</p></html>') for i, h in doubtful.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["lang"] for r in langid.identify_pages(pages, model).select("row.page_id", "language.lang").where("page_id > 0").collect()}
    assert (got[1], got[2]) == ("de", "en"), "domain"
    assert (got[3], got[4]) == ("de", "en"), "host"
    assert (got[5], got[6]) == ("en", "de"), "suffix"
    assert (got[7], got[8]) == ("de", "en"), "markup"


def test_pages_query(spark, sf):
    got = queries.page_languages(spark, sf)
    declared = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", langid.markup_language(F.col("html")).alias("said"))
    rows = got.join(declared, "page_id").collect()
    assert len(rows) == declared.count()
    assert sum(r["lang"] == r["said"] for r in rows) / len(rows) > 0.9


def test_op10_itself_follows_markup_suffix_domain_and_host(spark, tmp_path):
    """The registered query on tables where each kind of evidence alone tells the language of doubtful pages. Labels teach
    the text model from documents; no page that is judged has one."""
    words = {"en": "tan ane", "de": "tin ine"}
    docs = [(i, " ".join(random.Random(i).choices(f"ten one {words[lang]}".split(), k=60)), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de"] * 100)]
    docs += [(900 + i, "ten one tan ane tin ine " * 9, f"junk label {i}", "s0") for i in range(300)] + [(1300, "x", "xx" * 40, "s0")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    page = lambda host, lang, said=None, text=None: (host, f"<html{f' lang={said}' if said else ''}><p>{text or f'{words[lang]} ' * 3}</p><script>{words['en']}</script></html>")
    many = [page(f"www.h{k % 3}.aa", "en", "en") for k in range(60)] + [page(f"www.g{k % 3}.bb", "de", "de") for k in range(60)]
    many += [page("x.both.cc", "en") for _ in range(60)] + [page("y.both.cc", "de") for _ in range(60)] + [page("a.one.cc", "en") for _ in range(60)] + [page("a.two.cc", "de") for _ in range(60)]
    doubt = "ten one"
    odd = [page("new.aa", "", None, doubt), page("new.bb", "", None, doubt), page("n.one.cc", "", None, doubt), page("n.two.cc", "", None, doubt), page("x.both.cc", "", None, doubt), page("y.both.cc", "", None, doubt), page("q.zz", "", "en", doubt), page("q.zz", "", "de-CH", doubt)]
    rows = [(i, f"https://{h}/", html) for i, (h, html) in enumerate(many + odd)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op10_language_fusion(spark, str(tmp_path)).collect()
    got = {r["page_id"]: r for r in found if r["table"] == "pages"}
    assert [got[len(many) + k]["lang"] for k in range(8)] == ["en", "de"] * 4
    # Suffix, domain, host and markup tell what the text alone can't: it is the same in all eight.
    assert len({got[len(many) + k]["text_lang"] for k in range(8)}) == 1
    # Junk labels are no languages: they teach nothing, and their documents are judged as all others.
    assert {r["lang"] for r in found} <= {"en", "de", None} and all(r["declared"] is None for r in found if r["doc_id"] is not None and r["doc_id"] >= 900)


def test_documents_are_judged_without_their_own_labels(spark):
    """The text model learns from one half; the other half's labels are taken away and then asked for."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 200")
    model = langid.fit(docs.where("doc_id % 2 = 0").select("doc_id", "text", "lang"))
    rest = docs.where("doc_id % 2 = 1")
    got = langid.identify_documents(rest.withColumn("lang", F.lit(None).cast("string")), ["doc_id"], model).select("row.doc_id", "language.*")
    met = got.join(rest.select("doc_id", F.col("lang").alias("label")), "doc_id").collect()
    assert all(r["declared"] is None for r in met) and sum(r["lang"] == r["label"] for r in met) / len(met) > 0.9
