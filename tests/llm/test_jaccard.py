import random

import pytest

from sourceweave.llm import jaccard
from sourceweave.llm.jaccard import components, jaccard_components, keep_one


def brute(rows):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((str(d), len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed, n, spread):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = rng.choices(vocabulary, k=60)
    out = []
    for i in range(n):
        base = random.Random(rng.randrange(spread)).choices(vocabulary, k=random.Random(i % spread).randint(3, 140))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            base += shared
        out.append((1000 - i, " ".join(base)))
    return out


@pytest.mark.parametrize(("seed", "spread"), [(2, 12), (3, 1)])
def test_against_brute_force(spark, seed, spread):
    """From one large group of near copies to many small ones."""
    rows = corpus(seed, 150, spread)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(frame).collect())
    assert got == brute(rows)


def test_edges(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == brute(rows)
    assert jaccard_components(docs.limit(0)).collect() == []
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "9", "None"])


def test_rows_are_kept_one_by_one(spark):
    """An id with two texts, near copies under one id, and copies without an id."""
    words = [f"w{i}" for i in range(80)]
    text, near = " ".join(words), " ".join([*words[:-1], "x"])
    other, unnamed = " ".join(reversed(words)), " ".join(words[::3])
    rows = [(1, text, {"k": 1}), (2, near, None), (2, other, None), (3, unnamed.upper() + " y z", None), (3, unnamed.upper() + " y z", None)]
    rows += [(None, unnamed, None), (None, unnamed + "  ", None), (None, near, None), (4, "a b c d e f", None), (4, "a b c d e f", None)]
    rows += [(None, None, None), (None, None, None), (5, "", None), (5, "", None), (5, " ", None)]
    rows += [(6, " ".join(f"v{i}" for i in range(90)), None), (6, " ".join(f"v{i}" for i in range(89)), None), (None, "n1 n2 n3 n4 n5", None), (None, "n1 n2 n3 n4 n5", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig map<string,int>")
    got = keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted((str(r.doc_id), str(r.text)[:5]) for r in got.collect())
    assert kept == sorted(
        [("1", "w0 w1"), ("2", "w79 w"), ("3", "W0 W3"), ("4", "a b c"), ("None", "None"), ("None", "None"), ("5", ""), ("5", " "), ("6", "v0 v1"), ("None", "n1 n2")]
    )


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").unionAll(spark.createDataFrame([(900, 901), (950, 950)], "a long, b long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_screening_never_loses_a_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_FLUSH", 50)
    rows = corpus(7, 80, 4)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(frame).collect())
    assert got == brute(rows)
