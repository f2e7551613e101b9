"""Queries take whole texts."""

from tapeloom.plans import queries


def test_safe_filename_cuts_the_whole_text(spark, tmp_path):
    rows = [(3, "a" + " " * 140 + "b" * 200, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.safe_filename(spark, str(tmp_path)).first().name == "a_" + "b" * 118
