"""Helpers of the tests: quads by short names, and back."""

from __future__ import annotations

from quadweave.schema import BNODE, IRI, LITERAL, XSD


def row(s, p, o, g):
    """A quad of short names; ``"'x"`` is a plain literal, ``_:x`` a blank node, anything else an IRI."""
    if o.startswith("'"):
        return (g, s, IRI, p, o[1:], LITERAL, XSD + "string", "")
    return (g, s, BNODE if s.startswith("_:") else IRI, p, o, BNODE if o.startswith("_:") else IRI, "", "")


def shown(df):
    """Quads as a set of (s, p, o, g)."""
    found = [(r.s, r.p, ("'" if r.o_kind == LITERAL else "") + r.o, r.g) for r in df.collect()]
    assert len(found) == len(set(found)), "a graph is a set"
    return set(found)
