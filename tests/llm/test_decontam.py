import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sourceweave.llm import decontam
from sourceweave.llm.decontam import budget, decontaminate, find_leaks, myers, normalised


def table_distance(pattern, text, anchored):
    column, best, end = list(range(len(pattern) + 1)), len(pattern), 0
    for j, c in enumerate(text, 1):
        after = [j if anchored else 0]
        for i, p in enumerate(pattern, 1):
            after.append(min(after[-1] + 1, column[i] + 1, column[i - 1] + (p != c)))
        column = after
        if column[-1] < best:
            best, end = column[-1], j
    return best, end


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=90), st.booleans())
def test_bit_parallel_distance(pattern, text, anchored):
    assert myers(pattern, text, anchored) == table_distance(pattern, text, anchored)


def edited(rng, item, n):
    for _ in range(n):
        i = rng.randrange(len(item))
        item = rng.choice([item[:i] + "#" + item[i + 1 :], item[:i] + item[i + 1 :], item[:i] + "#" + item[i:]])
    return item


def test_against_brute_force(spark, sf, monkeypatch):
    """All whole texts against all items by the plain table, in several blocks of items."""
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)
    rng = random.Random(4)
    words = ["stone", "river", "of", "the", "lamp", "under", "green", "tell", "and", "paper"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(9, 14)))) for i in range(8)]
    items += [(8, "too short"), (9, None), (10, items[0][1].upper())]
    docs = []
    for d in range(40):
        item = items[rng.randrange(8)][1]
        hidden = edited(rng, item, rng.randint(0, budget(item) + 2)) if d % 2 else ""
        docs.append((d, f"{' '.join(rng.choices(words, k=20))} {hidden} {' '.join(rng.choices(words, k=20))}"))
    docs += [(40, None), (41, ""), (42, items[0][1].replace(" ", " \n ").upper()), (42, items[0][1])]
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as start")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, text in docs:
        for i, item in items[:8]:
            found = table_distance(normalised(item), normalised(text), False)[0]
            if found <= budget(normalised(item)):
                want[d, i] = found
                if i == 0:
                    want[d, 10] = found  # the same item under another id
    got = find_leaks(documents, benchmark).collect()
    assert {(d, i): min(r.distance for r in got if (r.doc_id, r.item_id) == (d, i)) for d, i in {(r.doc_id, r.item_id) for r in got}} == want and len(want) > 10
    texts = {d: normalised(t) for d, t in docs}
    for r in got:
        piece = texts[r.doc_id][r.start : r.start + r.length]
        assert myers(normalised(dict(items)[r.item_id]), piece)[0] == r.distance
    assert sum(r.doc_id == 42 for r in got) == 4
    clean = decontaminate(documents, benchmark)
    assert clean.columns == documents.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {k[0] for k in want})
    assert find_leaks(documents, benchmark.limit(0)).collect() == [] == find_leaks(documents.limit(0), benchmark).collect()


def test_short_items_equal_items_and_all_occurrences(spark):
    long = "which of the rivers of the green country runs under the old stone bridge"
    items = [(1, "What is the capital of Peru?"), (2, long), (3, long.upper()), (3, long), (4, "lamp"), (5, ""), (6, None), (7, "c++")]
    docs = [
        (1, "He asked: what is the  capital\nof peru? WHAT IS THE CAPITAL OF PERU? Lima"),
        (2, f"{long}. And again: {long.replace('green', 'grey')}; {long}"),
        (3, "lamps and a headlamp"),
        (4, "a lamp, a lamp"),
        (5, "what is the capital of perus"),
        (6, "in c++ and c++11"),
        (7, "word " * 300_000 + long),
    ]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.distance) for r in find_leaks(documents, benchmark).collect())
    second = len(long) + len(". And again: ")
    third = second + len(long) - 1 + 2
    assert got == sorted([
        (1, 1, 10, 0), (1, 1, 39, 0), *[(2, i, at, d) for i in (2, 3) for at, d in ((0, 0), (second, 2), (third, 0))],
        (4, 4, 2, 0), (4, 4, 10, 0), (6, 7, 3, 0), (6, 7, 11, 0), (7, 2, 1_500_000, 0), (7, 3, 1_500_000, 0),
    ])
    assert sorted(r.doc_id for r in decontaminate(documents, benchmark).collect()) == [3, 5]
