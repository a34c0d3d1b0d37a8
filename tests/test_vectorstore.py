"""The stored index: only changed files are embedded, untouched parts stay, the manifest decides."""

import os
import random

import numpy as np

from sourceweave.operators import retrieval as rt
from sourceweave.operators import vectorstore as vs

SCHEMA = "project_id string, path string, content string"


def rows_of(df):
    return sorted((r.id, r.project_id, r.file_path, r.start_line, r.end_line, r.content, tuple(r.embedding)) for r in df.collect())


def text_of(rng, n):
    return "\n".join(" ".join(rng.choices(["def", "class", "lamp", "river", "x = 1", ""], k=5)) for _ in range(n))


def direct(spark, files):
    """The rows of an index that is built at once from the files."""
    return rows_of(rt.index_chunks(spark.createDataFrame(files, SCHEMA)))


def test_updates_equal_an_index_built_at_once(spark, tmp_path):
    rng, folder = random.Random(5), str(tmp_path / "store")
    assert vs.read_store(spark, folder).collect() == [] and vs.store_state(spark, folder) is None
    files = [(f"p{i % 5}", f"a/f{i}.py", text_of(rng, rng.choice([1, 60, 200]))) for i in range(30)] + [("p0", "b/hot.py", text_of(rng, 4000)), ("p1", "e.py", "")]
    vs.update_store(folder, spark.createDataFrame(files, SCHEMA).selectExpr("*", "1 as embedding", "2 as sha256", "3 as part"), "one")
    assert rows_of(vs.read_store(spark, folder)) == direct(spark, files) and vs.store_state(spark, folder) == "one"
    first = vs.store_versions(spark, folder)

    changed = [(p, f, c + "\nnew = 2") if f == "a/f7.py" else (p, f, c) for p, f, c in files if f != "a/f12.py"] + [("p2", "a/added.py", "y = 3")]
    vs.update_store(folder, spark.createDataFrame(changed, SCHEMA), "two")
    assert rows_of(vs.read_store(spark, folder)) == direct(spark, changed) and vs.store_state(spark, folder) == "two"
    second = vs.store_versions(spark, folder)
    assert {p for p in first if first[p] == second[p]}  # projects without a change are not written
    assert rows_of(vs.read_store(spark, folder, "p2")) == direct(spark, [r for r in changed if r[0] == "p2"])
    assert vs.read_store(spark, folder, "none").collect() == []

    vs.update_store(folder, spark.createDataFrame(changed, SCHEMA), "three")
    assert vs.store_versions(spark, folder) == second and vs.store_state(spark, folder) == "three"
    without = [r for r in changed if r[0] != "p3"]
    vs.update_store(folder, spark.createDataFrame(without, SCHEMA))
    assert rows_of(vs.read_store(spark, folder)) == direct(spark, without)
    vs.update_store(folder, spark.createDataFrame([], SCHEMA))
    assert vs.read_store(spark, folder).collect() == [] == list(vs.store_versions(spark, folder))


def test_repeated_and_null_rows(spark, tmp_path):
    folder = str(tmp_path / "store")
    files = [("p", "a.py", "x = 1"), ("p", "a.py", "x = 1"), ("p", "n.py", None), (None, "b.py", "z"), ("p", None, "z")]
    vs.update_store(folder, spark.createDataFrame(files, SCHEMA))
    assert [r[:6] for r in rows_of(vs.read_store(spark, folder))] == [("p:a.py:1:1", "p", "a.py", 1, 1, "x = 1"), ("p:n.py:1:1", "p", "n.py", 1, 1, "")]


def test_a_version_without_manifest_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "store")
    vs.update_store(folder, spark.createDataFrame([("p", "a.py", "x = 1")], SCHEMA))
    (part,) = vs.store_versions(spark, folder)
    os.makedirs(f"{folder}/data/version=2/part={part}")
    assert len(vs.read_store(spark, folder).collect()) == 1
    vs.update_store(folder, spark.createDataFrame([("p", "a.py", "x = 2")], SCHEMA))
    assert [r.content for r in vs.read_store(spark, folder).collect()] == ["x = 2"]


def test_retrieval_reads_the_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    rng = random.Random(6)
    files = [(f"p{i % 2}", f"f{i}.py", text_of(rng, 80)) for i in range(12)]
    vs.update_store(folder, spark.createDataFrame(files, SCHEMA))
    st = vs.read_store(spark, folder)
    asked = spark.createDataFrame([("q", "lamp river")], "query_id string, text string")
    hits = rt.retrieve(st, asked, 5).orderBy("rank").collect()
    matrix = {r.id: np.array(r.embedding, dtype=float) for r in st.collect()}
    q = np.array(asked.select(rt.V.hash_embed(asked.text)).first()[0], dtype=float)
    want = sorted(((-round(float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-8)), 9), i) for i, v in matrix.items()))[:5]
    assert [h.id for h in hits] == [i for _, i in want]
    table = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(table)
    before = vs.table_state(spark, table)
    assert vs.table_state(spark, table) == before
    spark.range(4).write.mode("append").parquet(table)
    assert vs.table_state(spark, table) != before


def test_texts_move_once_before_they_are_embedded(spark, tmp_path, monkeypatch):
    """The exchange in which copies of a file meet is the only one that carries texts."""
    seen = []
    monkeypatch.setattr(vs, "chunk_lines", lambda files, *a: seen.append(files) or rt.chunk_lines(files, *a))
    files = spark.createDataFrame([("p", "a.py", "x = 1"), ("p", "a.py", "x = 1"), ("q", "b.py", "y")], "project_id string, path string, content string")
    vs.update_store(str(tmp_path / "store"), files)
    assert "Repartition" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in vs.read_store(spark, str(tmp_path / "store")).collect()) == ["p:a.py:1:1", "q:b.py:1:1"]


def test_payload_of_few_hits_is_not_shuffled(spark):
    vectors = spark.range(200_000).selectExpr("concat('v', id) as id", "repeat('text ', 50) as content")
    hits = spark.createDataFrame([("q", "v7", 0.5, 1), ("q", "v9", 0.4, 2)], "query_id string, id string, score double, rank int")
    got = rt.with_payload(hits, vectors, "content")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r["id"], r["rank"], len(r["content"])) for r in got.collect()) == [("v7", 1, 250), ("v9", 2, 250)]


def test_search_and_embedding_see_small_batches(spark, tmp_path):
    """A worker's memory must not grow with the rows of a task."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    one = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<float>")
    files = spark.createDataFrame([("p", "a.py", "x = 1")], "project_id string, path string, content string")
    for work in (
        lambda: rt.topk_search(one, one.selectExpr("id as query_id", "embedding"), 1).collect(),
        lambda: vs.update_store(str(tmp_path / "store"), files),
    ):
        for n in names:
            spark.conf.unset(n)
        work()
        assert int(spark.conf.get(names[0])) <= 1000 and int(spark.conf.get(names[1])) <= 4 << 20
