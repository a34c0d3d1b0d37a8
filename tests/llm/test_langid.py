import pytest
from pyspark.sql import functions as F

from sourceweave.llm import langid
from sourceweave.llm.queries import op10_language_id


def test_held_out_accuracy(spark, sf):
    found = op10_language_id(spark, sf)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_edges(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model).filter("doc_id in (3, 4, 5) or doc_id = 9").collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id != 9] == [("und", 0.0, True)] * 3
    assert [r.lang_pred for r in got if r.doc_id == 9] == ["de", "de"]
    assert langid.identify(docs.limit(0), model).collect() == []
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_far_texts_are_rejected(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(documents)
    odd = [chr(0x4E00 + i % 900) * 3 for i in range(400)]
    assert model.predict(["".join(odd)])[0][2]
    few = documents.select("lang").distinct().withColumn("doc_id", F.lit(1)).withColumn("text", F.lit("x"))
    assert len(langid.fit(few).languages) == few.count()


def test_more_labels_than_a_model_holds(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(rows)
