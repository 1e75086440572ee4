"""All queries of the engine's own operators."""

from __future__ import annotations

from . import face_queries, job_queries, record_queries, scene_queries, store_queries, stream_queries, tag_queries, text_queries  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
