"""Graph operators against brute force."""

import itertools
import random

import pytest

from sourceweave.operators import graphs as gr


def reachable(edges, start):
    seen, todo = set(), [start]
    while todo:
        v = todo.pop()
        for a, b in edges:
            if a == v and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def random_edges(seed, n=14, m=22):
    rnd = random.Random(seed)
    return sorted({(f"v{a:02}", f"v{b:02}") for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(m)) if a != b})


def frame(spark, edges):
    return spark.createDataFrame([("p", a, b) for a, b in edges], "project_id string, src string, dst string")


def test_cycles_and_components(spark):
    for seed in (3, 8):
        edges = random_edges(seed)
        es = set(edges)
        nodes = sorted({v for e in edges for v in e})
        want = set()
        for k in (2, 3, 4):
            for path in itertools.permutations(nodes, k):
                if path[0] == min(path) and all((path[i], path[(i + 1) % k]) in es for i in range(k)):
                    want.add(" -> ".join([*path, path[0]]))
        assert {r["cycle"] for r in gr.circular_dependencies(frame(spark, edges), 4).collect()} == want
        reach = {v: reachable(edges, v) for v in nodes}
        comp = {v: min(w for w in nodes if w in reach[v] and v in reach[w]) for v in nodes if v in reach[v]}
        assert {r["module"]: r["component"] for r in gr.strong_components(frame(spark, edges)).collect()} == comp


def test_depth_on_chain_with_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "e")]
    mods = spark.createDataFrame([("p", m, m) for m in "abcdexz"], "project_id string, module string, path string")
    got = {r["module"]: (r["depth"], r["in_cycle"]) for r in gr.dependency_depth(frame(spark, edges), mods).collect()}
    assert got == {"a": (3, False), "b": (2, True), "c": (2, True), "d": (1, False), "e": (0, False), "x": (1, False), "z": (0, False)}


def test_acyclic_graph_has_no_components(spark):
    assert gr.strong_components(frame(spark, [("a", "b"), ("b", "c")])).count() == 0
    assert gr.circular_dependencies(frame(spark, [("a", "b"), ("b", "c")]), 9).count() == 0
    assert gr.witness_cycles(frame(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_cycle_of_any_length_has_a_witness(spark):
    ring = [(f"m{i}", f"m{(i + 1) % 6}") for i in range(6)]
    edges = [*ring, ("m2", "x"), ("x", "m4"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("m1", "a")]
    got = {r["component"]: (r["cycle"], r["length"]) for r in gr.witness_cycles(frame(spark, edges)).collect()}
    assert got["a"] == ("a -> b -> a", 2)
    path, length = got["m0"][0].split(" -> "), got["m0"][1]
    assert length == 6 and path[0] == path[-1] == "m0" and set(zip(path, path[1:], strict=False)) <= set(edges)


def test_call_chain_hops(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("z", "a")])
    seeds = spark.createDataFrame([("p", "a")], "project_id string, id string")
    got = {(r["direction"], r["id"]): r["hop"] for r in gr.call_chain(edges, seeds).collect()}
    assert got == {("callees", "b"): 0, ("callees", "c"): 0, ("callees", "a"): 1, ("callers", "c"): 0, ("callers", "z"): 0, ("callers", "b"): 1, ("callers", "a"): 1}


def test_import_classes(spark):
    mods = spark.createDataFrame([("p", "requests_util", ""), ("p", "app.api", "")], "project_id string, module string, path string")
    targets = spark.createDataFrame([("p", t) for t in ("re", "app", "app.api.x", "app.apix", "os")], "project_id string, target string")
    raw = {r["target"]: r["is_internal"] for r in gr.classify_imports(targets, mods).collect()}
    dotted = {r["target"]: r["is_internal"] for r in gr.classify_imports(targets, mods, boundary=True).collect()}
    assert raw == {"re": True, "app": True, "app.api.x": True, "app.apix": True, "os": False}
    assert dotted == {"re": False, "app": True, "app.api.x": True, "app.apix": False, "os": False}


def test_callee_resolution(spark):
    fn = spark.createDataFrame(
        [("p", "a.py", "run", "", 1), ("p", "b.py", "run", "", 1), ("p", "a.py", "go", "K", 5), ("p", "a.py", "main", "", 9)],
        "project_id string, path string, name string, class_name string, start_line int",
    )
    calls = spark.createDataFrame(
        [("p", "a.py", 10, "main", "run"), ("p", "a.py", 11, "main", "K.go"), ("p", "a.py", 12, "main", "go"), ("p", "a.py", 2, "", "run"), ("p", "a.py", 6, "go", "main")],
        "project_id string, path string, line_no int, caller string, callee string",
    )
    got = {(r["src"], r["dst"], r["line"]) for r in gr.call_edges(gr.call_nodes(fn), calls).collect()}
    assert got == {("a.py:main", "b.py:run", 10), ("a.py:main", "a.py:K.go", 11), ("a.py:K.go", "a.py:main", 6)}


@pytest.mark.parametrize("boundary", [False, True])
def test_imports_are_classified_in_tasks_of_bounded_rows(spark, monkeypatch, boundary):
    """Names share prefixes over bundles, null and empty ones are there; more rows get more tasks."""
    monkeypatch.setattr(gr, "PREFIX_ROWS", 4, raising=False)
    monkeypatch.setattr(gr, "BUNDLE", 3, raising=False)
    parts = ["a", "ab", "a.b", "a.bc", "a.b.c", "b", "b.", "ba.a", "c\u00e9", "c\u00e9.d", None]
    modules = [("p", m) for m in parts[1::2]] + [("p", f"m{i}") for i in range(40)] + [("q", ""), ("r", None), (None, "a")]
    targets = [("p", x) for x in [*parts, "m1", "m10.x", "m1z", "x", ""]] + [("q", "z"), ("q", None), ("r", "a"), (None, "a"), ("s", "a")]
    names = spark.createDataFrame(modules, "project_id string, module string")
    got = gr.classify_imports(spark.createDataFrame(targets * 2, "project_id string, target string"), names, boundary)
    dot = "." if boundary else ""

    def internal(p, x):
        found = [m for q, m in modules if q == p and p is not None and x is not None and m is not None]
        return any(m == x or m.startswith(x + dot) or x.startswith(m + dot) for m in found)

    assert sorted(map(tuple, got.collect()), key=repr) == sorted({(p, x, internal(p, x)) for p, x in targets}, key=repr)
    assert got.rdd.getNumPartitions() > 8
