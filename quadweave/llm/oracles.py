"""DuckDB SQL that is built by rule, for operators of several rounds or levels."""

from __future__ import annotations

_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
_Q = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"

TOPK = f"""
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS own, vec_id, list_transform({_Q}, lambda x: x::DOUBLE) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND coalesce({_FINITE}, true)),
    met AS (
      SELECT a.own, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.own != b.own WHERE a.vec_id % 50 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM met)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """


def kmeans(k: int, rounds: int, dims: int) -> str:
    """Plain rounds over all pairs of a vector and a centroid."""
    made = [
        f"""v AS MATERIALIZED (
      SELECT row_number() OVER () AS own, vec_id, {_Q} AS q, sha256('2:' || vec_id) AS h FROM embeddings
      WHERE len(embedding) = {dims} AND {_FINITE})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS cluster, q FROM v QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        made.append(
            f"""a{r} AS MATERIALIZED (
      SELECT own, min({{'d': list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, 'c': cluster}}) AS best
      FROM v, c{r} c GROUP BY own)"""
        )
        if r < rounds:
            made.append(
                f"""c{r + 1} AS MATERIALIZED (
      SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
        SELECT cluster, list(x ORDER BY i) AS q FROM (
          SELECT cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (
            SELECT best.c AS cluster, unnest(q) AS x, unnest(range({dims})) AS i FROM a{r} JOIN v ON a{r}.own = v.own)
          GROUP BY cluster, i)
        GROUP BY cluster) m ON c.cluster = m.cluster)"""
            )
    return f"""
    WITH {", ".join(made)}
    SELECT vec_id, best.c AS cluster, best.d AS distance,
      (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
      sha256(list_aggregate(c.q, 'string_agg', ',')) AS centroid_sha256
    FROM a{rounds} JOIN v ON a{rounds}.own = v.own JOIN c{rounds} c ON c.cluster = best.c
    """


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


#: CRC-32 (reflected polynomial 0xEDB88320) of a short ASCII text.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _levels(name: str, leaves: str, count: int, fan_out: int) -> list[str]:
    """Levels 0 to ``count`` of trees over (tree, idx, n, d), each node with its siblings ``l`` and ``r``."""
    made, below = [], leaves
    for k in range(count + 1):
        if k:
            below = f"""SELECT tree, idx // {fan_out} AS idx, (any_value(n) + {fan_out - 1}) // {fan_out} AS n,
        CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d
      FROM {name}{k - 1} GROUP BY tree, idx // {fan_out}"""
        run = f"string_agg(d, '') OVER (PARTITION BY tree, idx // {fan_out} ORDER BY idx ROWS BETWEEN"
        made.append(
            f"""{name}{k} AS MATERIALIZED (
      SELECT *, coalesce({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
      FROM ({below}))"""
        )
    return made


def manifest(fan_out: int, lower: int, upper: int) -> str:
    """Levels grouped one on the other: enough for fan_out ** lower rows of a group, fan_out ** upper groups."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    made = [
        f"""leaf AS MATERIALIZED (
      SELECT doc_id, lang, coalesce('=' || lang, '-') AS tree, sha256({head} || {_field("text")}) AS d,
        CASE WHEN {_CRC} % 3 = 0 THEN sha256({head} || {_field(lowered)}) ELSE sha256({head} || {_field("text")}) END AS changed
      FROM documents)""",
        """placed AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf)""",
        *_levels("t", "SELECT tree, idx, n, d FROM placed", lower, fan_out),
        f"""tops AS MATERIALIZED (
      SELECT t.tree AS member, '' AS tree, row_number() OVER (ORDER BY encode(g.lang) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, t.d
      FROM t{lower} t JOIN (SELECT DISTINCT tree, lang FROM leaf) g ON t.tree = g.tree)""",
        *_levels("u", "SELECT tree, idx, n, d FROM tops", upper, fan_out),
    ]
    steps = [f"t{k}" for k in range(lower)] + [f"u{k}" for k in range(upper)]
    froms = ["placed p"] + [f"JOIN t{k} ON t{k}.tree = p.tree AND t{k}.idx = p.idx // {fan_out**k}" for k in range(lower + 1)]
    froms += ["JOIN tops ON tops.member = p.tree"] + [f"JOIN u{k} ON u{k}.idx = tops.idx // {fan_out**k}" for k in range(upper + 1)]
    made.append(
        f"""way AS MATERIALIZED (
      SELECT p.doc_id, p.d AS leaf, p.changed, t{lower}.d AS subroot, u{upper}.d AS root, [{", ".join(f"{{'l': {s}.l, 'r': {s}.r, 'n': {s}.n}}" for s in steps)}] AS steps
      FROM {" ".join(froms)})"""
    )
    fold = [
        """f0 AS (SELECT *, changed AS f FROM way)""",
        *[f"f{i + 1} AS (SELECT * EXCLUDE (f), CASE WHEN steps[{i + 1}].n = 1 THEN f ELSE sha256(steps[{i + 1}].l || f || steps[{i + 1}].r) END AS f FROM f{i})" for i in range(len(steps))],
    ]
    return f"""
    WITH {", ".join(made + fold)}
    SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(steps, lambda x: x.l || x.r), 'string_agg', '')) AS proof_sha256,
      f AS folded_root, f = root AS verified
    FROM f{len(steps)}
    """
