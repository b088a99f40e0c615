"""Imports every query module so the registry is complete."""

from lobloom.catalog import (  # noqa: F401
    base_queries, book_queries, contrast_queries, flow_queries, mechanism_queries, path_queries, stream_queries,
    study_queries, summary_queries,
)
