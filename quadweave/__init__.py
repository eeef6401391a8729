"""Drafts, queries, diffs and publication of RDF-style quads as Spark DataFrame jobs."""

from quadweave.schema import Snapshot, Vocabulary
from quadweave.session import build_session

__all__ = ["Snapshot", "Vocabulary", "build_session"]
