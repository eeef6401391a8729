"""Subclass reasoning: types inherited along rdfs:subClassOf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.operators import lookup
from quadweave.schema import IRI, OWL_THING, QUAD_COLS, RDF_TYPE, RDFS_SUBCLASS, local_table, struct
from quadweave.session import stage


def subclass_edges(quads: DataFrame) -> DataFrame:
    """``(sub, sup)`` of the hierarchy stated in the visible graphs."""
    stated = quads.filter((F.col("p") == RDFS_SUBCLASS) & (F.col("o_kind") == IRI) & (F.col("s_kind") == IRI))
    return stated.select(F.col("s").alias("sub"), F.col("o").alias("sup")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All ``(sub, sup)`` pairs reachable in one or more steps. Cycles are fine.

    A hierarchy of few edges and pairs is walked as a local relation. Beyond that each round joins only
    the pairs found in the round before with all known ones, so path lengths double and no pair of old
    paths meets twice. Rounds end when one finds nothing new; each is staged in the shared folder, so
    plans stay short and lost executors do not restart it all.
    """
    edges = lookup.local(edges.select("sub", "sup"))
    pairs = _walked(edges._rows, lookup.BROADCAST_ROWS) if hasattr(edges, "_rows") else None
    if pairs is not None:
        return local_table(edges.sparkSession, pairs, struct("sub STRING, sup STRING"))
    known = new = stage(edges.select("sub", "sup").distinct())
    while True:
        ahead = new.select("sub", F.col("sup").alias("mid")).join(known.select(F.col("sub").alias("mid"), "sup"), "mid")
        behind = known.select("sub", F.col("sup").alias("mid")).join(new.select(F.col("sub").alias("mid"), "sup"), "mid")
        found = ahead.unionByName(behind).select("sub", "sup").distinct()
        new = stage(found.join(known, ["sub", "sup"], "left_anti"))
        if new.isEmpty():
            return known
        known = stage(known.unionByName(new))


def _walked(edges: list[tuple[str, str]], most: int) -> list[tuple[str, str]] | None:
    """The pairs of a small hierarchy, from every class upwards; None if there are more than ``most``."""
    above: dict[str, set[str]] = {}
    for sub, sup in edges:
        if sub is not None and sup is not None:
            above.setdefault(sub, set()).add(sup)
    found: list[tuple[str, str]] = []
    for start in above:
        seen, open_ = set(), [start]
        while open_:
            for sup in above.get(open_.pop(), ()):
                if sup not in seen:
                    seen.add(sup)
                    open_.append(sup)
            if len(found) + len(seen) > most:
                return None
        found += [(start, sup) for sup in seen]
    return found


def inferred_types(quads: DataFrame, closed: DataFrame | None = None, with_thing: bool = False) -> DataFrame:
    """rdf:type quads that follow from the hierarchy and are not stated. ``with_thing`` adds the top class."""
    closed = closure(subclass_edges(quads)) if closed is None else closed
    typed = quads.filter((F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI))
    closed, small = lookup.settle(closed)
    side = F.broadcast(closed) if small else closed
    found = typed.join(side, F.col("o") == F.col("sub")).withColumn("o", F.col("sup")).select(*QUAD_COLS)
    if with_thing:
        found = found.unionByName(typed.withColumn("o", F.lit(OWL_THING)).select(*QUAD_COLS))
    return lookup.minus(found.dropDuplicates(), typed)


def with_inference(quads: DataFrame, with_thing: bool = False) -> DataFrame:
    """A view including what follows from its class hierarchy."""
    return quads.select(*QUAD_COLS).unionByName(inferred_types(quads, with_thing=with_thing))
