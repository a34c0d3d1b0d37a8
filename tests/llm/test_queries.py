"""The numbered queries and the pipeline on the smallest tables, against SQL or a plain count."""

import re

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from sourceweave.llm.common import written
from sourceweave.llm.decontam import budget, myers, normalised
from sourceweave.llm.queries import ORACLES, QUERIES
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_pipeline_stage_by_stage(spark, sf, con):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept.append(written(stage(spark, kept[-1], sf)))
        assert kept[-1].columns == docs.columns
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    assert ids[1] == ids[0]  # every text of these is in one of the languages
    groups = con.execute(ORACLES["op6_jaccard_join"]).fetchall()
    assert sorted(ids[2]) == sorted({g[2] for g in groups})
    items = [normalised(r[0]) for r in con.execute("select text from benchmark").fetchall()]
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    held = {i for i in ids[2] if any(x in normalised(texts[i]) for x in items)}
    near = {i for i in ids[2] if len(texts[i]) < 3000 and any(myers(x, normalised(texts[i]))[0] <= budget(x) for x in items)}
    assert set(ids[2]) - set(ids[3]) >= held and near <= set(ids[2]) - set(ids[3])
    packed = corpus_pipeline.STAGES[3][1](spark, kept[3], sf).collect()
    assert {r.doc_id for r in packed} == set(ids[3])


def test_run_applies_the_stages(spark, sf, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[i] for i in (0, 2)])
    kept = corpus_pipeline.run(spark, sf)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < kept.count() < 200
