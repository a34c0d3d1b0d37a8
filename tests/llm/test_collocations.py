import random
import re
import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from sourceweave.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def by_hand(rows, min_count, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, c in counts.items():
        phrases = {p: n for p, n in c.items() if len(p) > 1 and n >= min_count}
        inside = Counter()
        for p, n in phrases.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], n)
        best = []
        for p, a in phrases.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, totals[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def sample(n):
    pick = random.Random(5)
    words = ["The", "of", "house", "Über", "日本", "x-y", "a\x01", "rare"]
    rows = []
    for i in range(n):
        text = "".join(pick.choices(words, [8, 6, 3, 2, 2, 1, 1, 0.1])[0] + pick.choices([" ", "\t ", ", ", "\n", ". "], [8, 1, 1, 1, 1])[0] for _ in range(pick.randrange(30)))
        rows.append((i, text, ["en", "de", None][i % 3]))
    return rows


@pytest.mark.parametrize("cuts", [{}, {"block": 40, "slice_bytes": 30, "budget": 20}, {"block": 7, "slice_bytes": 11, "budget": 1}])
def test_equals_a_plain_count(spark, cuts):
    rows = [*sample(400), (900, None, "en"), (901, "", None), (902, " \t", "fr"), (903, "one word" * 3, "es"), (904, "very long of house " * 20_000, "en")]
    df = spark.createDataFrame(rows + rows[:7], SCHEMA).repartition(4).selectExpr("*", "1 as n", "'k' as phrase", "2L as grp", "'q' as words")
    assert found(collocations.collocations(df, min_count=5, **cuts)) == by_hand([r[1:] for r in rows + rows[:7]], 5)


def test_no_rows_and_edge_rows(spark, docs):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert found(collocations.collocations(docs, min_count=2)) == by_hand([(r.text, r.lang) for r in docs.collect()], 2)


def test_best_phrases_of_every_language_only(spark):
    rows = sample(300)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(collocations.collocations(df, min_count=3, top=4)) == by_hand([r[1:] for r in rows], 3, 4)


def test_slices_never_cut_a_word():
    text = b"aa bbb\ncccccccccc d " * 9
    for size in (1, 3, 8, 1000):
        cut = list(collocations._slices(text, size))
        assert b"".join(cut) == text and [w for c in cut for w in c.split()] == text.split()


def test_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    """However many blocks a task writes, few are held at once, and each has pages of its own."""
    monkeypatch.setattr(collocations, "ROW_GROUP", 150)
    df = spark.createDataFrame([(i, f"some words of text {i} " * 40, "en") for i in range(60)], SCHEMA).coalesce(1)
    blocks = collocations.encode(df, block=50)
    (path,) = blocks.inputFiles()
    file = pq.ParquetFile(path.removeprefix("file://"))
    assert blocks.count() >= 60
    groups = [file.metadata.row_group(g) for g in range(file.num_row_groups)]
    assert {g.num_rows for g in groups[:-1]} == {3}


def test_shuffles_do_not_pile_up(spark):
    """Words, pairs and suffixes are each shuffled; the files of one are gone before the next needs as much."""

    def files():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    collocations.collocations(spark.createDataFrame(sample(300), SCHEMA), min_count=3)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(name) == setting
