"""sourceweave: source-code corpora, documents and chat logs as Spark tables.

Every operator is a ``DataFrame -> DataFrame`` function keyed by
``project_id``; nothing is collected, and per-file work stays inside the row
that holds the file so that it needs no shuffle.
"""
