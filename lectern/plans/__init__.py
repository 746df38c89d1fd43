"""Queries over the given tables, with SQL for the same rows."""

from . import more_queries, note_queries, page_queries, reply_queries, revision_queries, search_queries, stream_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
