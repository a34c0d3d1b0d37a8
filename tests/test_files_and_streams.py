"""Scans, inventory, snapshots, history and streams."""

import os
import tempfile

from samples import files_of
from pyspark.sql import functions as F

from sourceweave.operators import frontend as fe
from sourceweave.operators import history as hi
from sourceweave.operators import snapshots as sn
from sourceweave.plans import PLANS
from sourceweave.sources import files as fs
from sourceweave.streaming import jobs


def test_scan_tree(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for path, text in (("p1/src/a.py", "x\ny\n"), ("p1/b.js", "é"), ("p2/node_modules/c.js", "z")):
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", encoding="utf-8") as f:
            f.write(text)
    files = fs.scan_files(spark, root)
    assert {(r["project_id"], r["path"], r["content"]) for r in files.collect()} == {("p1", "src/a.py", "x\ny\n"), ("p1", "b.js", "é"), ("p2", "node_modules/c.js", "z")}
    assert fs.skip_filter(files, "count").count() == 2


def test_count_files_and_lines(spark):
    files = files_of(spark, a_py="a\nb\nc\n", b_js="x", c_txt="t", node_modules__d_js="n\n")
    (r,) = fs.count_files_lines(files).collect()
    assert (r["file_count"], r["line_count"]) == (2, 4)
    assert sn.snapshot_stats(files_of(spark, a_py="a\n")).collect()[0]["line_count"] == 2


def test_write_replaces_only_given_projects(spark):
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, v int")
    fs.write_table(df, out)
    fs.write_table(spark.createDataFrame([("b", 3)], "project_id string, v int"), out)
    assert sorted((r["project_id"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]


def test_unique_directories_with_a_hot_name(spark):
    rows = [(i, "https://github.com/o/app.git" if i % 3 else f"https://x.org/r{i}/") for i in range(300)]
    got = fs.assign_directories(spark.createDataFrame(rows, "id long, url string")).orderBy("id").collect()
    hot = [r["folder"] for r in got if r["name"] == "app"]
    assert hot == ["app"] + [f"app_{i}" for i in range(1, len(hot))]
    assert got[0]["folder"] == "r0" and got[0]["source_type"] == "git" and got[1]["source_type"] == "github"


def test_folders_with_a_hot_name_go_by_one_set_of_cuts(spark):
    """Quantiles of a large group are estimates: ranks and shifts must not take them twice."""
    rows = [(i, f"https://github.com/o/{'app' if i % 3 else 'lib'}.git") for i in range(300)]
    df = fs.assign_directories(spark.createDataFrame(rows, "id long, url string"), parts=7, hot=120)
    assert "percentile_approx" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = df.orderBy("id").collect()
    for name in ("app", "lib"):
        assert [r["folder"] for r in got if r["name"] == name] == [name] + [f"{name}_{i}" for i in range(1, 200 if name == "app" else 100)]


def test_streams_read_tables_of_one_file_and_of_many(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("stream_sessions",):
        one, many = (PLANS[name].run(spark, d).collect() for d in (sf, str(tmp_path)))
        assert sorted(map(str, one)) == sorted(map(str, many)) and one


def test_changes_add_up(spark):
    old = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "project_id string, path string, sha256 string")
    new = spark.createDataFrame([("p", "b", "2"), ("p", "c", "9"), ("p", "d", "4")], "project_id string, path string, sha256 string")
    changes = sn.detect_changes(old, new)
    assert {(r["path"], r["change_type"]) for r in changes.collect()} == {("a", "deleted"), ("c", "modified"), ("d", "added")}
    (s,) = sn.changeset_summary(changes).collect()
    assert s["total_changes"] == s["added"] + s["modified"] + s["deleted"] == 3


def test_history_limits(spark):
    rows = [("s", i, "user" if i % 2 == 0 else "assistant", f"m{i} " + "x" * 60) for i in range(20)]
    m = spark.createDataFrame(rows, "session_id string, turn long, role string, content string").withColumn("ts", F.timestamp_seconds("turn"))
    assert [r["turn"] for r in hi.history(m, 10).orderBy("position").collect()] == list(range(10))
    assert sorted(r["turn"] for r in hi.recent_history(m, 10).collect()) == list(range(10, 20))
    assert hi.session_titles(m).collect()[0]["title"] == ("m0 " + "x" * 60)[:50] + "..."
    gone = m.select("session_id").distinct()
    assert hi.delete_sessions(m, gone).count() == 0


def test_context_holds_every_message(spark):
    rows = [("s", i, "user", f"m{i}") for i in range(150)]
    m = spark.createDataFrame(rows, "session_id string, turn long, role string, content string").withColumn("ts", F.timestamp_seconds("turn"))

    def read(df):
        return [r["content"] for r in df.orderBy("position").collect()]

    assert read(hi.llm_context(m)) == [f"m{i}" for i in range(150)]
    assert read(hi.llm_context(m, 100)) == [f"m{i}" for i in range(50, 150)]
    assert read(hi.llm_context(m, 3, "first")) == ["m0", "m1", "m2"]


def test_large_files_are_scanned(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "big.py").write_text("x = 1\n" * 2_000_000)
    files = fs.scan_files(spark, f"file://{tmp_path}")
    assert files.selectExpr("length(content)").collect()[0][0] == 12_000_000
    assert fs.skip_filter(files, "structure").count() == 1 and fs.skip_filter(files, "structure", 10 << 20).count() == 0


def test_folders_are_unique(spark):
    names = ["foo", "foo", "foo_1", "foo", "foo_3", "bar_1", "bar", "bar", "foo_1", "x"]
    rows = [(i, f"https://github.com/o/{n}.git") for i, n in enumerate(names)]
    got = fs.assign_directories(spark.createDataFrame(rows, "id long, url string"), parts=3).orderBy("id").collect()
    assert [r["folder"] for r in got] == ["foo", "foo_2", "foo_1", "foo_4", "foo_3", "bar_1", "bar", "bar_2", "foo_1_1", "x"]


def test_api_call_rules(spark):
    js = 'async function go() {\n  axios.get("/a", { params: { page: 1 } });\n  $post("b/${id}");\n}\n'
    files = files_of(spark, a_js=js)
    once = {(r["line_no"], r["method"], r["api_path"], r["function_name"], r["params"]) for r in fe.extract_api_calls(files).collect()}
    assert once == {(2, "GET", "/a", "go", "page"), (3, "GET", "/b/:param", "go", "")}
    assert fe.extract_api_calls(files, dedupe=False).count() > 2


def test_incremental_index_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "project_id string, path string, content string, version long"

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{name}")

    def run(state="state"):
        files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        jobs.index_stream(files, f"{folder}/index", f"{folder}/{state}").awaitTermination()
        now = jobs.current_index(spark, f"{folder}/index").select("path", "content", "batch").collect()
        return {r["path"]: r["content"] for r in now}, {r["path"]: r["batch"] for r in now}

    arrive("v1", [("p", "a.py", "one", 1), ("p", "b.py", "two", 1)])
    first = run()
    assert first[0] == {"a.py": "one", "b.py": "two"}
    arrive("v5", [("p", "a.py", "one", 5), ("p", "b.py", "changed", 5), ("p", "c.py", "new", 2)])
    second = run()
    assert second[0] == {"a.py": "one", "b.py": "changed", "c.py": "new"}
    assert second[1]["a.py"] == first[1]["a.py"] != second[1]["c.py"]  # same content: not written again
    arrive("v3", [("p", "a.py", "late", 3), ("p", "b.py", "late", 3), ("p", "c.py", None, 4)])
    assert run()[0] == {"a.py": "one", "b.py": "changed"}
    assert run("lost")[0] == {"a.py": "one", "b.py": "changed"}  # everything again after a lost checkpoint
    jobs.compact_index(spark, f"{folder}/index", f"{folder}/compact")
    assert {r["path"]: r["content"] for r in jobs.current_index(spark, f"{folder}/compact").collect()} == {"a.py": "one", "b.py": "changed"}


def test_session_table_keeps_idle_sessions(spark, tmp_path):
    """Late and repeated messages, a null session, a stream that starts anew, and a compacted table."""
    kind = "session_id long, ts timestamp, turn int, content string"
    runs = [
        [(1, 10, 0, "a"), (1, 20, 1, "b"), (2, 5, 0, "idle"), (None, 1, 0, None)],
        [(1, 1, 0, "late"), (3, 30, 0, "c"), (1, 20, 1, "b")],
        [(3, 40, 1, None), (None, 9, 1, "n")],
    ]
    table = f"{tmp_path}/t"
    for i, rows in enumerate(runs):
        frame = spark.createDataFrame(rows, "session_id long, s int, turn int, content string").selectExpr("session_id", "timestamp_seconds(s) as ts", "turn", "content")
        frame.write.parquet(f"{tmp_path}/in{i}")
        arriving = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{i}")
        query = jobs.session_table_stream(arriving, table, f"{tmp_path}/state{i}")
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
        if i == 1:
            jobs.compact_sessions(spark, table, f"{tmp_path}/u")
            table = f"{tmp_path}/u"
    got = sorted((str(r.session_id), r.message_count, r.first_content, r.last_content) for r in jobs.current_sessions(spark, table).collect())
    assert got == [("1", 4, "late", "b"), ("2", 1, "idle", "idle"), ("3", 2, "c", None), ("None", 2, None, "n")]
