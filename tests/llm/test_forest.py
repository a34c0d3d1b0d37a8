from collections import Counter

import numpy as np
import pyarrow as pa

from sourceweave.llm import forest
from sourceweave.llm.forest import nearest

SCHEMA = "vec_id long, embedding array<float>, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0) for i, v in rows], SCHEMA)


def recall(spark, x, monkeypatch, k=10):
    monkeypatch.setattr(forest, "BLOCK", 200)
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32))]
    vectors = frame(spark, rows)
    got = nearest(vectors, vectors.filter("vec_id % 20 = 0"), k).collect()
    y = x.astype(np.float32).astype(float)
    score = y @ y.T
    hits = 0
    for q in range(0, len(x), 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, k + 1)) and own == sorted(own, key=lambda r: (-r[2], r[1]))
        assert all(abs(score[q, v] - s) < 1e-9 and v != q for _, v, s in own)
        order = sorted((-s, v) for v, s in enumerate(score[q]) if v != q)[:k]
        hits += len({v for _, v in order} & {v for _, v, _ in own})
    return hits / (k * len(range(0, len(x), 20)))


def test_recall_on_uniform_and_uneven_norms(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1200, 24))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True), monkeypatch) >= 0.9
    assert recall(spark, x * rng.uniform(0.2, 3, (1200, 1)) + 0.3, monkeypatch) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(i, [0.0, 1.0]) for i in range(100, 103)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0]), (203, [None, 1.0]), (204, [float("nan"), 1.0]), (205, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    vectors = frame(spark, rows)
    asked = vectors.filter("vec_id in (0, 50, 101, 200, 204)")
    got = nearest(vectors, asked, 5).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}}
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 101: [100, 102, 0, 1, 2]}
    few = nearest(vectors.filter("vec_id < 3"), vectors.filter("vec_id = 1"), 5).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 0), (2, 2)]
    assert nearest(vectors.limit(0), vectors.limit(0)).collect() == []


def near_copies(n):
    """Half of the vectors are nearly the same and share their whole strings."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 8))
    x[: n // 2] = x[0] + 1e-9 * rng.normal(size=(n // 2, 8))
    return x


def test_near_copies_are_cut_into_pieces():
    x = near_copies(2000)
    f = forest.Forest(x[::4], 20, float(np.linalg.norm(x, axis=1).max()), "<f8")
    given = type("Given", (), {"value": f})
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "x"])
    found = next(forest._block_sizes(given)(iter([batch])))
    f.cut({(t, b): n for t, b, n in zip(*[c.to_pylist() for c in found.columns], strict=True)}, 100)
    groups, ids = Counter(), {}
    for part in forest._index_rows(given)(iter([batch])):
        for t, b, p, i in zip(*[part.column(c).to_pylist() for c in ("tree", "block", "piece", "id")], strict=True):
            groups[t, b, p] += 1
            ids.setdefault(t, set()).add(i)
    assert max(groups.values()) <= 200 and all(len(v) == 2000 for v in ids.values())


def test_pieces_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 20)
    x = near_copies(400)
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(frame, frame.filter("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.score
    hit = 0
    for q in range(0, 400, 10):
        want = np.sort(np.delete(x @ x[q], q))[::-1][:5]
        hit += sum(abs(got[q][i + 1] - s) < 1e-6 for i, s in enumerate(want))
    assert hit >= 0.97 * 200  # TARGET
