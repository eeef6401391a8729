"""Scalar helpers over plain columns: ids, versions, hashes, times and IRIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.schema import Vocabulary

MAILTO = "mailto:"


def draft_graph_iri(draftset: Column, lg: Column, vocab: Vocabulary) -> Column:
    """Private graph of (draftset, live graph). Hash-derived, so a retried task makes the same IRI."""
    return F.concat(F.lit(vocab.draft_graph_base), F.md5(F.concat_ws("|", draftset, lg)))


def keyed_uuid(*parts: Column) -> Column:
    """UUID-shaped text from a key: the same for every retry of the same write."""
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in cuts])


def random_uuid() -> Column:
    return F.uuid()


def version_iri(uuid: Column, vocab: Vocabulary) -> Column:
    return F.concat(F.lit(vocab.version_base), uuid)


def version_id(version: Column, vocab: Vocabulary) -> Column:
    """Id of a version IRI; NULL when the IRI is not a version."""
    # Fixed value: the id alphabet of a version IRI.
    pattern = "^" + _quote(vocab.version_base) + "([0-9a-f-]+)$"
    found = F.regexp_extract(version, pattern, 1)
    return F.when(found != "", found)


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def merged_version(versions: Column, vocab: Vocabulary) -> Column:
    """Version of several versions together: MD5 over their sorted ids, so order does not matter."""
    ids = F.array_sort(F.transform(versions, lambda v: F.coalesce(version_id(v, vocab), F.lit(""))))
    return F.concat(F.lit(vocab.version_base), F.md5(F.concat_ws("", ids)))


def merge_versions(a: Column, b: Column, vocab: Vocabulary) -> Column:
    both = merged_version(F.array(a, b), vocab)
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def user_iri(user: Column) -> Column:
    return F.concat(F.lit(MAILTO), user)


def user_name(user_iri_: Column) -> Column:
    return F.when(F.startswith(user_iri_, F.lit(MAILTO)), F.substr(user_iri_, F.lit(len(MAILTO) + 1)))


def append_path(base: Column, *segments: Column) -> Column:
    trimmed = F.regexp_replace(base, "/+$", "")
    return F.concat_ws("/", trimmed, *segments)


def last_segment(iri: Column) -> Column:
    return F.regexp_extract(iri, "([^/]+)$", 1)


def full_match(value: Column, pattern: str) -> Column:
    return value.rlike("^(?:" + pattern + ")$")


def is_protected(graph: Column, vocab: Vocabulary) -> Column:
    return graph.rlike(vocab.protected_regex)


def is_user_graph(graph: Column, vocab: Vocabulary) -> Column:
    return ~is_protected(graph, vocab)
