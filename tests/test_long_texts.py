"""Texts beyond a million characters are read whole."""

from factmill.plans import queries


def test_what_stands_late_in_a_long_text_counts(spark, tmp_path):
    text = "word " * 200_001 + "see https://example.org/page"
    spark.createDataFrame([(1, text, "en"), (2, "plain words", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in queries.safe_documents_by_lang(spark, str(tmp_path)).collect()] == [("en", 2, 1)]
    assert {r["doc_id"]: r["cleaned"] for r in queries.clean_text(spark, str(tmp_path)).collect()}[1] == text
