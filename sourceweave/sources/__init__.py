from sourceweave.sources.corpus import corpus, corpus_sql
from sourceweave.sources.tables import table

__all__ = ["corpus", "corpus_sql", "table"]
