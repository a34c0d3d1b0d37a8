"""Small frames that several test modules build."""


def files_of(spark, **contents):
    """``files`` frame of one project; keys use ``__`` for ``/`` and end in ``_ext``."""
    rows = [("p", path.replace("__", "/")[::-1].replace("_", ".", 1)[::-1], text) for path, text in contents.items()]
    return spark.createDataFrame(rows, "project_id string, path string, content string")
