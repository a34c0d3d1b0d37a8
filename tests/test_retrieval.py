"""Chunking, embedding, search and context."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import files_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceweave.functions import prompts as P
from sourceweave.functions import vectors as V
from sourceweave.operators import context as cx
from sourceweave.operators import retrieval as rt
from sourceweave.plans import PLANS
from sourceweave.plans import retrieval as plans


def greedy(text, limit, cap=50):
    """Chunk ranges by definition, one line at a time."""
    out, start, n, tok = [], 1, 0, 0
    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        t = len(line.split())
        if n and (tok + t > limit or n >= cap):
            out.append((start, i - 1))
            start, n, tok = i, 1, t
        else:
            n, tok = n + 1, tok + t
    return [*out, (start, len(lines))]


def embed(text, dim=384):
    text = " " + text.lower() + " "
    v = np.zeros(dim)
    for i in range(len(text) - 2):
        g = text[i : i + 3].encode()
        v[int.from_bytes(hashlib.md5(g).digest()[:4], "little") % dim] += 1 if hashlib.sha1(g).digest()[0] % 2 == 0 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def test_chunks_of_long_file(spark):
    text = "def f():\n    return 1\n" * 100
    rows = rt.chunk_lines(files_of(spark, a_py=text)).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == greedy(text, 1000)
    assert len(rows) == 5 and rows[0]["chunk_id"] == "a.py:1:50"


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab 　é\n", max_size=12), max_size=70), min_size=8, max_size=8))
def test_chunks_partition_the_file(spark, docs):
    texts = ["\n".join(d) for d in docs]
    files = spark.createDataFrame([("p", f"{i}.py", t) for i, t in enumerate(texts)], "project_id string, path string, content string")
    got = {}
    for r in rt.chunk_lines(files, max_tokens=6).orderBy("path", "start_line").collect():
        got.setdefault(r["path"], []).append((r["start_line"], r["end_line"], r["content"]))
    for i, t in enumerate(texts):
        assert [c[:2] for c in got[f"{i}.py"]] == greedy(t, 6)
        assert "\n".join(c[2] for c in got[f"{i}.py"]) == t


def test_hash_embed_matches_definition(spark):
    texts = ["Hello Wörld", "", "a", "漢字 mixed ÀÉ text", "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", V.hash_embed(F.col("text")).alias("e"))
    for r in df.collect():
        assert np.allclose(r["e"], embed(texts[r["id"]]), atol=1e-6)
        norm = float(np.linalg.norm(r["e"]))
        assert abs(norm) < 1e-6 or abs(norm - 1) < 1e-5


@pytest.mark.parametrize("block", [3, 1000])
def test_topk_is_exact_with_many_copies(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    base[:25] = base[0]  # a hot group of identical vectors
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    vecs = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    qs = vecs.select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in rt.topk_search(vecs, qs, 7, block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    m = np.array([v for _, v in rows])
    n = np.linalg.norm(m, axis=1)
    sim = np.round(m @ m.T / (np.outer(n, n) + 1e-8), 9)
    for q in range(60):
        want = sorted(range(60), key=lambda i: (-sim[q, i], i))[:7]
        assert got[q] == want


def test_blocks_of_queries_do_not_widen_the_plan(spark):
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, embedding array<float>")
    qs = vecs.select(F.col("id").alias("query_id"), "embedding")
    df = rt.topk_search(vecs, qs, 3, 4)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
    assert df.count() == 120 and rt.topk_search(vecs, qs.limit(0), 3).count() == 0


def test_every_vector_asks_in_blocks(spark, sf):
    """The SQL asks for no part of the vectors either, and passes that are written give what one pass gives."""
    names = ["query_id", "id", "score", "rank"]
    got = sorted(tuple(r[n] for n in names) for r in PLANS["topk_search_blocks"].run(spark, sf).collect())
    assert len({q for q, *_ in got}) == plans.vectors(spark, sf).count()
    assert got == sorted(tuple(r[n] for n in names) for r in PLANS["topk_search"].run(spark, sf).collect())
    assert PLANS["topk_search_blocks"].sql == PLANS["topk_search"].sql


def test_passes_over_the_vectors_are_written(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(50)], "id long, embedding array<float>")
    qs = vecs.select(F.col("id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, rt.topk_search(vecs, qs, 4, 3).collect()))
    monkeypatch.setattr(rt, "QUERY_BLOCK", 13)
    several = rt.topk_search(vecs, qs, 4, 3)
    assert "MapInArrow" not in several._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, several.collect())) == whole and len(whole) == 200


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_screened_pairs_are_the_exact_ones(scale):
    """Over many batches: copies, zero vectors and hardly different scores; short vectors are not screened."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(900, 24)) + 3
    m[100:300] = m[0]
    m[300:600] = m[1] + rng.normal(size=(300, 24)) * 1e-7
    m[600:620] = 0
    m, ids = (m[rng.permutation(900)] * scale).astype(np.float32).astype(np.float64), rng.permutation(900)
    floats = [pa.array(list(m[i : i + 70].astype(np.float32)), pa.list_(pa.float32())) for i in range(0, 900, 70)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[70 * n : 70 * n + 70]), e], names=["id", "embedding"]) for n, e in enumerate(floats)]
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    (out,) = V.topk_batches(iter(batches), ids.astype(object), m.astype(np.float32), 6, schema, 100)
    got, norms = {}, np.linalg.norm(m, axis=1)
    for q, i, s in sorted(zip(*(c.to_pylist() for c in out.columns)), key=lambda r: (r[0], -r[2], r[1])):
        got.setdefault(q, []).append((i, s))
    scores = np.round(m @ m.T / (np.outer(norms, norms) + V.COSINE_EPSILON), 9)
    for q in range(900):
        best = np.lexsort((ids, -scores[:, q]))[:6]
        assert got[ids[q]] == [(ids[i], scores[i, q]) for i in best]


def test_single_precision_rules_pairs_out(monkeypatch):
    """Once a query has its best, a batch of far vectors is not scored densely again."""
    dense = []
    monkeypatch.setattr(V, "score_block", lambda ids, vecs, queries, *rest, f=V.score_block: dense.append(len(queries)) or f(ids, vecs, queries, *rest))
    m = np.eye(8, dtype=np.float32)
    near, far = (pa.RecordBatch.from_arrays([pa.array(range(a, a + 4)), pa.array(list(m[a : a + 4]))], names=["id", "embedding"]) for a in (0, 4))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    (out,) = V.topk_batches(iter([near, *[far] * 9]), np.arange(4, dtype=object), m[:4], 1, schema)
    assert dense == [4] and out.column(1).to_pylist() == [0, 1, 2, 3]


def test_threshold_applies_after_topk(spark):
    texts = ["login function", "logout handler", "zzz qqq"]
    vecs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    vecs = vecs.select("id", "content", V.hash_embed(F.col("content")).alias("embedding"))
    asked = spark.createDataFrame([(1, "login function")], "query_id int, text string")
    assert rt.retrieve(vecs, asked, 2).count() == 2
    assert [r["id"] for r in rt.retrieve(vecs, asked, 3, 0.9).collect()] == ["0"]
    top = rt.hybrid_retrieve(vecs, asked, ["QQQ"], 3).where("rank = 1").collect()[0]
    assert top["id"] == "0" and abs(top["score"] - 0.7) < 1e-6


def test_question_types(spark):
    rows = ["How is the login function implemented?", "I want to create new feature", "What is this code about?"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(cx.question_type(F.col("t")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["implementation", "planning", "hybrid"]


def test_context_and_prompt(spark):
    asked = spark.createDataFrame([(1, "What does {x} do"), (2, "none")], "query_id int, text string")
    hits = spark.createDataFrame([(1, 1, "a.py", 3, "x = {context}")], "query_id int, rank int, file string, line int, content string")
    packed = cx.context_pack(asked, hits)
    got = {r["query_id"]: r["context"] for r in packed.collect()}
    assert got == {1: "[1] File: a.py, Line: 3\n```\nx = {context}\n```\n", 2: P.NO_CONTEXT}
    prompt = {r["query_id"]: r for r in cx.prompt_rows(packed).collect()}[1]
    assert prompt["qa_type"] == "implementation"
    assert prompt["prompt"] == P.PROMPTS["implementation"].split("{context}")[0] + got[1] + P.PROMPTS["implementation"].split("{context}")[1].replace("{question}", "What does {x} do")


def test_citations(spark):
    text = "see [file.py:10](file.py#L10) and b.py:3:4 or [c.go:1-5](c.go) then b.py:3:4 file.py:10 end"
    rows = cx.extract_citations(spark.createDataFrame([(1, text)], "answer_id int, text string")).orderBy("ordinal").collect()
    assert [(r["file"], r["line"], r["end_line"]) for r in rows] == [("file.py", 10, None), ("c.go", 1, 5), ("b.py", 3, 4)]
    one = spark.range(1).select(cx.format_citation(F.lit("test.py"), F.lit(5), F.lit(None).cast("int")).alias("c")).collect()[0]["c"]
    assert one == "[test.py:5](test.py#L5)"


def test_confidence(spark):
    answers = spark.createDataFrame([(1, "plain"), (2, "[a.py:1](a.py) file"), (3, "none")], "answer_id int, text string")
    hits = spark.createDataFrame([(1, 0.8), (1, 0.9), *[(2, 1.0)] * 5], "answer_id int, score double")
    got = {r["answer_id"]: r["confidence"] for r in cx.answer_confidence(answers, hits).collect()}
    assert abs(got[1] - 0.595) < 1e-9 and got[3] == 0.0 and abs(got[2] - 1.0) < 1e-9
    smart = {r["answer_id"]: r["confidence"] for r in cx.smart_confidence(answers, hits).collect()}
    assert smart[3] == 0.3 and abs(smart[1] - 0.51) < 1e-9 and abs(smart[2] - 1.0) < 1e-9


def test_code_blocks_and_json(spark):
    text = "a ```py\nx\n``` b ```\ny\n``` ```py\nx\n```"
    rows = cx.extract_code_blocks(spark.createDataFrame([(1, text)], "answer_id int, text string")).orderBy("ordinal").collect()
    assert [(r["language"], r["code"], text[r["start"] : r["end"]]) for r in rows] == [
        ("py", "x", "```py\nx\n```"),
        ("unknown", "y", "```\ny\n```"),
        ("py", "x", "```py\nx\n```"),
    ]
    replies = ['```json\n{"a": 1}\n```', 'Sure: {"b": {"c": 2}} done', "no json", "{bad"]
    df = spark.createDataFrame([(r,) for r in replies], "t string").select(cx.json_from_text(F.col("t")).alias("j"))
    assert [r["j"] for r in df.collect()] == ['{"a": 1}', '{"b": {"c": 2}}', None, None]


def brute_topk(store, word, k):
    """``id, score`` of the ``k`` best by definition; ``store`` has ids and unit vectors."""
    score = {i: round(float(np.dot(v, embed(word)) / (np.linalg.norm(v) * np.linalg.norm(embed(word)) + 1e-8)), 6) for i, v in store.items()}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_all_keywords_ask(spark, tmp_path):
    """Short and repeated words too, by brute force."""
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(["a cat sat here", "dogs run far away", "the cat ran", "unrelated words stand about", "sat on a mat"])]
    asked = [(7, "cat sat cat"), (8, "a dog  ran"), (9, "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    store = {r["id"]: embed(r["content"]) for r in plans.store(spark, str(tmp_path)).collect()}
    want = {}
    for q, text in asked:
        for word in dict.fromkeys(text.split()):
            for i, score in brute_topk(store, word, 4):
                want.setdefault(str(q), {}).setdefault(i, score)
    got = {}
    for r in PLANS["multi_query_retrieve"].run(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    assert got.keys() == want.keys() == {"7", "8"}
    for q, hits in want.items():
        assert got[q].keys() == hits.keys() and all(abs(got[q][i] - s) < 1e-5 for i, s in hits.items())


def test_one_file_in_twenty_asks(spark, sf):
    files = {f"{r['project_id']}:{r['path']}": r["content"] for r in plans.corpus(spark, sf).collect()}
    store = {i: embed(t) for i, t in files.items()}
    got = {}
    for r in PLANS["retrieve_by_code"].run(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    assert got.keys() == {i for i in files if zlib.crc32(i.encode()) % 20 == 0}
    for i in sorted(got)[::7]:
        assert np.allclose([got[i][r + 1] for r in range(5)], [s for _, s in brute_topk(store, files[i], 5)], atol=1e-5)


def test_every_file_asks(spark, sf):
    files = {f"{r['project_id']}:{r['path']}": r["content"] for r in plans.corpus(spark, sf).collect()}
    store = {i: embed(t) for i, t in files.items()}
    got = {}
    for r in PLANS["retrieve_by_code"].run(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    assert got.keys() == files.keys()
    for i in sorted(files)[::97]:
        assert np.allclose([got[i][r + 1] for r in range(5)], [s for _, s in brute_topk(store, files[i], 5)], atol=1e-5)
