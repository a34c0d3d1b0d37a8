"""Metadata table: upserts rewrite what they touch, earlier versions stay until the manifest names the new one."""

import os

from sourceweave.operators import snapshots as sn

SCHEMA = "project_id string, path string, sha256 string, metadata string, processed_at long"


def test_upserts_and_lookup(spark, tmp_path):
    folder = str(tmp_path / "meta")

    def rows():
        return sorted(tuple(r) for r in sn.stored_metadata(spark, folder).select("project_id", "path", "sha256", "metadata", "processed_at").collect())

    assert rows() == []
    sn.upsert_metadata(folder, spark.createDataFrame([("p", "a", "1", "m", 1), ("q", "a", "2", None, 1), ("p", "a", "0", "old", 0)], SCHEMA))
    first = sn._committed(spark, folder)
    sn.upsert_metadata(folder, spark.createDataFrame([("p", "a", "3", None, 2), ("p", "b", None, "n", 2)], SCHEMA))
    second = sn._committed(spark, folder)
    assert sorted(first.values()) == [1, 1] and sorted(second.values()) == [1, 2]  # the other project's bucket is not rewritten
    assert rows() == [("p", "a", "3", "m", 2), ("p", "b", None, "n", 2), ("q", "a", "2", None, 1)]
    sn.upsert_metadata(folder, spark.createDataFrame([], SCHEMA))
    assert sn._committed(spark, folder) == second
    probe = spark.createDataFrame([("p", "a"), ("p", "c"), ("z", "a")], "project_id string, path string")
    assert sorted(tuple(r) for r in sn.lookup_metadata(probe, folder).collect()) == [("p", "a", "m"), ("p", "c", None), ("z", "a", None)]


def test_a_version_without_manifest_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "meta")
    sn.upsert_metadata(folder, spark.createDataFrame([("p", "a", "1", "m", 1)], SCHEMA))
    (bucket,) = sn._committed(spark, folder)
    os.makedirs(f"{folder}/data/version=2/bucket={bucket}")
    assert [r.sha256 for r in sn.stored_metadata(spark, folder).collect()] == ["1"]
    sn.upsert_metadata(folder, spark.createDataFrame([("p", "a", "2", "m", 2)], SCHEMA))
    assert [r.sha256 for r in sn.stored_metadata(spark, folder).collect()] == ["2"]
