"""Brute-force DuckDB SQL for searches: every pair is formed and scored. Only for checking results."""

from __future__ import annotations

from kinmatch.plans.spec import SearchSpec

DOCS = (
    "SELECT d.doc_id AS item_id, d.text, d.lang, d.source, coalesce(CAST(e.label AS VARCHAR), '') AS label, "
    "CAST(e.embedding AS DOUBLE[]) AS textEmbedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"
)
BLANK_DOCS = (
    "SELECT d.doc_id AS item_id, d.text, CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE d.lang END AS lang, "
    "CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.source END AS source, "
    "CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST(e.embedding AS DOUBLE[]) END AS textEmbedding "
    "FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"
)
PARTS = (
    "SELECT p_partkey AS item_id, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part"
)


def _pairs(spec: SearchSpec, scoring: str) -> tuple[str, list[str]]:
    cols, joins = [], []
    for i, c in enumerate(spec.clauses):
        if c.kind == "vector":
            sim = f"1 / (1 + power(list_distance(q.{c.column}, i.{c.column}), 2))"
            cols.append(f"q.{c.column} IS NOT NULL AS a{i}, round({sim}, 12) AS b{i}")
            cols.append(f"coalesce(round({sim}, 12) >= {c.min_score}, false) AS h{i}")
        else:
            base = f"ln(1 + ((SELECT n FROM total) - f{i}.n + 0.5) / (f{i}.n + 0.5))" if scoring == "bm25" else "CAST(1 AS DOUBLE)"
            if scoring == "bm25":
                joins.append(
                    f"LEFT JOIN (SELECT {c.field} AS v, count(*) AS n FROM items GROUP BY 1) f{i} ON f{i}.v = q.{c.field}"
                )
            cols.append(f"q.{c.field} <> '' AS a{i}, {base} AS b{i}, q.{c.field} <> '' AND q.{c.field} = i.{c.field} AS h{i}")
    return ", ".join(cols), joins


def brute_sql(
    items: str,
    spec: SearchSpec,
    select: str,
    *,
    queries: str = "SELECT * FROM items",
    scoring: str = "bm25",
    exclude_self: bool = False,
) -> str:
    """`select` reads `ranked` (query_id, item_id, rank, score, names, h*, b*) and `summary`."""
    n = range(len(spec.clauses))
    cols, joins = _pairs(spec, scoring)
    score = " + ".join(f"CASE WHEN h{i} THEN b{i} * CAST({c.weight} AS DOUBLE) ELSE 0 END" for i, c in enumerate(spec.clauses))
    active = " OR ".join(f"a{i}" for i in n)
    any_hit = " OR ".join(f"h{i}" for i in n)
    required = " AND ".join(f"(h{i} OR NOT a{i})" for i, c in enumerate(spec.clauses) if c.occur == "must") or "true"
    optional = " + ".join(f"CAST(h{i} AS INT)" for i, c in enumerate(spec.clauses) if c.occur == "should") or "0"
    names = ", ".join(f"CASE WHEN h{i} THEN '{c.name}' END" for i, c in enumerate(spec.clauses))
    own = "WHERE q.item_id <> i.item_id" if exclude_self else ""
    return f"""
WITH items AS ({items}), queries AS ({queries}), total AS (SELECT count(*) AS n FROM items),
pairs AS (SELECT q.item_id AS query_id, i.item_id, {cols} FROM queries q CROSS JOIN items i {' '.join(joins)} {own}),
matched AS (SELECT *, CASE WHEN {active} THEN round({score}, 6) ELSE 1.0 END AS score,
    list_filter([{names}], lambda x: x IS NOT NULL) AS names FROM pairs
    WHERE NOT ({active}) OR (({required}) AND ({optional}) >= {spec.min_should} AND ({any_hit}))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM matched
    QUALIFY rank <= {spec.size}),
summary AS (SELECT q.item_id AS query_id, count(m.query_id) AS total_results, max(m.score) AS max_score
    FROM queries q LEFT JOIN matched m ON m.query_id = q.item_id GROUP BY 1)
{select}"""


HITS = "SELECT query_id, item_id, rank, score FROM ranked"
SUMMARY = "SELECT query_id, total_results, max_score FROM summary"
NAMES = "SELECT query_id, item_id, rank, array_to_string(names, ',') AS matched_queries FROM ranked"


def explain_select(spec: SearchSpec) -> str:
    rows = [
        f"SELECT query_id, item_id, '{c.name}' AS name, '{c.occur}' AS occur, round(b{i}, 6) AS base, "
        f"CAST({c.weight} AS DOUBLE) AS weight, round(b{i} * CAST({c.weight} AS DOUBLE), 6) AS clause_score FROM ranked WHERE h{i}"
        for i, c in enumerate(spec.clauses)
    ]
    return " UNION ALL ".join(rows)


def lsh_places(lsh, min_score: float, dimension: int = 64) -> str:
    """CTEs `place` (vec_id, t, p, x), rebuilding the projections of `kinmatch/operators/lsh.py` from integer arithmetic,
    and `meet` (a, b, t), the tables in which query a visits the bucket of item b."""
    h = "(t * 7919 + p * 104729 + j * 611953) % 2147483647"
    number = f"CAST((({h}) * ({h})) % 2147483647 % {{}} AS DOUBLE)"
    width = f"(sqrt(1000 * 1001 / 3.0) * {lsh.width} * sqrt(1 / {min_score} - 1))"
    return f"""
dir AS (SELECT t, p, list_transform(range(1, {dimension + 1}), lambda j: {number.format(2001)} - 1000) AS w,
    {number.replace("j * 611953", "0").format(1000)} / 1000 AS off FROM range(0, {lsh.tables}) a(t), range(0, {lsh.projections}) b(p)),
place AS MATERIALIZED (SELECT vec_id, t, p, list_inner_product(CAST(embedding AS DOUBLE[]), w) / {width} + off AS x FROM embeddings, dir),
border AS (SELECT *, floor(x) AS home, x - floor(x) AS share FROM place),
meet AS (SELECT a.vec_id AS a, b.vec_id AS b, a.t FROM border a JOIN border b ON a.t = b.t AND a.p = b.p GROUP BY ALL
    HAVING bool_and(b.home = a.home OR b.home = a.home + CASE WHEN a.share < 0.5 THEN -1 ELSE 1 END)
    AND sum(CASE WHEN b.home = a.home THEN 0 ELSE power(least(a.share, 1 - a.share), 2) END) <= {lsh.probe})"""
