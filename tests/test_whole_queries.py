"""Nothing of their tables is left out of these queries."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql
from sourceweave.plans import PLANS
from sourceweave.plans import graphs as plans
from sourceweave.session import dealt
from sourceweave.sources.tables import table
from tools.check import TABLES, rows_of

WHOLE = ["set_missing_titles", "session_list", "add_sources", "answer_confidence", "smart_confidence"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = PLANS[name].run(spark, sf)
    cur = con.execute(oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_conversation_and_turn_is_there(spark, sf):
    turns = {(r["conv_id"], r["turn"]) for r in table(spark, sf, "conversations").collect()}
    for name in WHOLE[:2]:
        assert {r["session_id"] for r in PLANS[name].run(spark, sf).collect()} == {c for c, _ in turns}
    text = {r["answer_id"]: r["text"] for r in PLANS["add_sources"].run(spark, sf).collect()}
    for c, t in turns:
        assert all(f"- [f{other}.py:{other + 1}" in text[f"{c}-{t}"] for d, other in turns if d == c)


def test_call_chain_reaches_the_fixed_point(spark, sf):
    nodes, edges = plans._graph(spark, sf)
    after: dict = {}
    for e in edges.collect():
        after.setdefault((e["project_id"], "callees", e["src"]), set()).add(e["dst"])
        after.setdefault((e["project_id"], "callers", e["dst"]), set()).add(e["src"])
    want = {}
    for n in nodes.where("name like 'main%' or name like 'load%'").collect():
        for direction in ("callers", "callees"):
            front, hop = {n["id"]}, 0
            while front := {x for at in front for x in after.get((n["project_id"], direction, at), ())} - {k[3] for k in want if k[:3] == (n["project_id"], n["id"], direction)}:
                want.update({(n["project_id"], n["id"], direction, x): hop for x in front})
                hop += 1
    got = {(r["project_id"], r["seed"], r["direction"], r["id"]): r["hop"] for r in PLANS["call_chain"].run(spark, sf).collect()}
    assert got == want and want


def test_graph_joins_gather_no_table_on_the_driver(spark, sf):
    """Checkpoints of written texts count as small tables, whatever they hold."""
    nodes, edges = plans._graph(spark, sf)
    seeds = nodes.where("name like 'main%'")
    for df in (edges, plans.gr.entry_points(nodes, edges), plans.gr.leaf_functions(nodes, edges), plans.gr.neighbours(edges, seeds)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_graph_totals_gather_no_table_on_the_driver(spark, sf):
    nodes, edges = plans._graph(spark, sf)
    for df in (plans.gr.call_graph_stats(nodes, edges), plans.gr.graph_export_edges(edges)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["classify_imports_boundary", "dependency_counts", "most_dependent"])
def test_import_joins_gather_no_table_on_the_driver(spark, sf, name):
    assert "Broadcast" not in PLANS[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_more_key_rows_get_more_tasks(spark):
    assert dealt(spark.range(20_000), "id").rdd.getNumPartitions() == 8
    assert dealt(spark.range(100_000), "id").rdd.getNumPartitions() == 25


@pytest.mark.parametrize("name", ["extract_models_typeorm", "extract_model_fields"])
def test_only_heads_of_models_become_rows(spark, sf, name):
    """A row carries its whole file, so other lines must not be unnested."""
    plan = PLANS[name].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(lines" not in plan


def test_deleted_projects_are_not_gathered_on_the_driver(spark, sf):
    plan = PLANS["cascade_delete"].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", ["backend_top", "tree_counts"])
def test_only_feature_hits_become_rows(spark, sf, name, monkeypatch):
    """A row carries its whole file, so other lines must not be unnested; a staged table has no column that nobody reads."""
    from sourceweave.operators.infra import detect_features
    from sourceweave.plans import insight
    from sourceweave.sources.corpus import corpus

    plan = detect_features(corpus(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    staged = []
    monkeypatch.setattr(insight, "cut_lineage", lambda df: staged.append(df.columns) or df)
    PLANS[name].run(spark, sf)
    assert not any("framework" in columns and "host" in columns for columns in staged)
