"""Import every query module so the registry is complete."""

from supportlake.plans import queries, queries_artefacts, queries_curation, queries_models, queries_pipeline, queries_streaming, queries_vectors  # noqa: F401
