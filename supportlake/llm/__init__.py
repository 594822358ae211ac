"""Training-data operators (deduplication, filtering, search, tokenising,
packing).  Nothing else in the library imports this subpackage; its queries
are in ``llm.queries`` and are added by ``__spark_entry__`` only when the
subpackage is there."""
