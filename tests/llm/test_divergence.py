import re
from collections import Counter, defaultdict

import pytest

from sourceweave.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(rows, min_docs=10, top=10):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [m.encode().lower().decode() for m in TERM.findall(text or "")]
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (at, t), n in docs.items() if at == lang and n >= min_docs]
        sources = sorted(s for at, s in groups if at == lang)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))

        def apart(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [divergence.BLOCK, 2000])
def test_equals_a_dense_count(spark, block):
    words = ["Alpha", "beta", "Gämma", "日本語", "delta9eps", "x_y", "ζ"]
    rows = [
        (i, " ".join(words[(i * k) % 7] for k in range(1, 2 + i % 9)) + "!", ["en", "de", None][i % 3], ["s0", "s1", None, "s0", "s0", "s4"][i % 6])
        for i in range(300)
    ]
    rows += [(900, None, "en", "empty"), (901, "12 34", "fr", "a"), (902, "once", "fr", "b"), (903, "beta " * 50_000, "en", "s1")]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(5).selectExpr("*", "1 as n", "'k' as item", "2L as total", "'q' as term")
    assert found(divergence.audit(df, block=block)) == by_hand(rows + rows[:5])


def test_no_rows_and_edge_rows(spark, docs):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert found(divergence.audit(docs, min_docs=2)) == by_hand(rows, min_docs=2)


def test_counts_beyond_64_bits_are_exact(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 5)], "n long, own_n long, v long")
    got = df.select(divergence._share("n", "own_n", "v")).first()[0]
    assert got == 1 + 1000000000 * (10**13 + 2) // (3 * 10**13 + 10)
