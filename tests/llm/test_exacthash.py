import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from sourceweave.llm import exacthash

SCHEMA = "doc_id long, text string"


def by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").encode().lower()].append(doc_id)
    want = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text).hexdigest()
        want += [(i, top, len(ids), k == ids.index(top), sha) for k, i in enumerate(ids)]
    return sorted(want, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edge_rows(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(exacthash.exact_groups(docs)) == by_hand(rows)


def test_no_rows(spark):
    df = exacthash.exact_groups(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.collect() == []


def test_null_ids_rank_below_all_and_one_of_equal_ids_stays(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (1, "B"), (7, "c"), (7, "C"), (7, "c"), (2, "É"), (3, "é"), (4, None), (5, "")]
    got = found(exacthash.exact_groups(spark.createDataFrame(rows, SCHEMA)))
    assert got == by_hand(rows)
    assert sum(r[3] for r in got) == len({(t or "").encode().lower() for _, t in rows})


@pytest.mark.parametrize("capacity", [1, 700, 1 << 30])
def test_hot_group_over_pages(spark, capacity):
    """A third of all rows share a text; buckets of any size give the same rows."""
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 500} {'x' * (i % 40)}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    assert found(exacthash.exact_groups(df, capacity=capacity)) == by_hand(rows)


def test_colliding_hashes_stay_apart(spark, monkeypatch):
    index = exacthash.build_index(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], SCHEMA).repartition(4)).filter("key is not null")
    same = index.withColumn("key", index.key * 0)
    for capacity in (1, 1 << 30):
        sizes = sorted(r.group_size for r in exacthash.resolve(same, capacity).collect())
        assert sizes in ([1, 1, 2, 2], [1, 1, 2])  # the two copies are one entry if one task met both


def test_directory_splits_until_buckets_fit():
    loads = {0: 50, 1: 5, 2: 5, 8: 40, 15: 10}
    depth, local, pages = exacthash.directory(loads, 60, limit=4)
    assert depth == 1 and local.tolist() == [1, 1] and pages.max() == 1
    depth, local, pages = exacthash.directory(loads, 20, limit=4)
    slots = np.arange(1 << depth)
    buckets = slots >> (depth - local) << (depth - local)
    sums = defaultdict(int)
    for slot, load in loads.items():
        sums[buckets[slot >> (4 - depth)]] += load
    assert depth == 4 and all(load <= 20 * pages[b] for b, load in sums.items())
    assert pages[0] == 3 and pages[8] == 2 and pages[15] == 1


def test_key_is_a_hash_of_the_normalised_bytes(spark):
    index = exacthash.build_index(spark.createDataFrame([(1, "Ab")], SCHEMA)).filter("key is not null").first()
    assert (index.key, bytes(index.text)) == (xxhash.xxh64_intdigest(b"ab") - (1 << 63), b"ab")
