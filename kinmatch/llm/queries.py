"""Queries opN_<name> over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.bpe import round_trip
from kinmatch.llm.embedding_duplicates import embedding_duplicates
from kinmatch.llm.filter_audit import filter_audit
from kinmatch.llm.lexical_search import lexical_search
from kinmatch.llm.line_windows import line_windows
from kinmatch.llm.near_duplicates import near_duplicates
from kinmatch.llm.nearest import nearest
from kinmatch.llm.packing import pack
from kinmatch.llm.personal_data import BASE_KINDS, personal_data
from kinmatch.llm.quality import COUNTS, quality
from kinmatch.llm.repeated_bytes import remove_repeats
from kinmatch.llm.token_files import read_token_files, write_token_files
from kinmatch.llm.toxicity import toxicity
from kinmatch.session import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = quality(_documents(spark, sf).select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", *COUNTS, "base_failed", "kept")


def _written(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data(_documents(spark, sf).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op5_line_windows(spark: SparkSession, sf: str) -> DataFrame:
    cut = line_windows(_documents(spark, sf).select("doc_id", "text"), keep=["doc_id"])
    return cut.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = round_trip(_documents(spark, sf).select("doc_id", "text"), path)
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder, path = scratch_folder(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json")
    write_token_files(_documents(spark, sf), folder, path, end_id=1)
    return read_token_files(spark, folder, path, ids=False)


def op10_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    cut = remove_repeats(_documents(spark, sf))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_embedding_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit(spark, f"{sf}/documents.parquet", spark.read.parquet(f"{sf}/labels.parquet"))


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality_rules": op2_quality_rules,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_line_windows": op5_line_windows,
    "op6_bpe": op6_bpe,
    "op7_nearest": op7_nearest,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_files": op9_token_files,
    "op10_repeated_bytes": op10_repeated_bytes,
    "op11_embedding_duplicates": op11_embedding_duplicates,
    "op12_filter_audit": op12_filter_audit,
    "op13_lexical_search": op13_lexical_search,
}

#: Lines of a text, windows of three lines that hold a word, those seen earlier, the lines they cover.
_OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM d),
w AS (
    SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS w
    FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
r AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth
    FROM w WHERE w IS NOT NULL AND regexp_matches(w, '[^ \\x09-\\x0D]')
),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) v(k) WHERE nth > 1),
m AS (
    SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS gone,
        c.pos IS NOT NULL AND lag(c.pos) OVER (PARTITION BY l.doc_id ORDER BY l.pos) IS NULL AS opens
    FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: All pairs of usable vectors, their links, and what can be reached by links.
_OP11_SQL = """
WITH RECURSIVE u AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id FROM u a JOIN u b ON a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM u UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
c AS (SELECT reach.a, min(u.vec_id) AS component_id FROM reach JOIN u ON reach.b = u.r GROUP BY reach.a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM u JOIN c ON u.r = c.a LEFT JOIN n ON u.r = n.a
UNION ALL
SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings
WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""

#: Each document's failures, then every order of the five filters by their positions.
_OP12_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents
),
f AS (
    SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS dd, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS bad
    FROM d
),
g AS (
    SELECT part, good, bad, map {'A': a, 'B': b, 'C': c, 'D': dd, 'E': e} AS fails, count(*) AS n,
    FROM f GROUP BY ALL
),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
st AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter,
        string_split(filter_order[1:step - 1], '') AS earlier FROM o, range(1, 6) v(step)
),
m AS (
    SELECT part, filter_order, step, letter, n, good, bad, fails[letter] AS hit,
        len(list_filter(earlier, lambda x: coalesce(fails[x], false))) > 0 AS gone,
        len(list_filter(map_values(fails), lambda x: x)) = 1 AS single
    FROM g, st
),
s AS (
    SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept,
        coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
        coalesce(sum(n) FILTER (hit AND single), 0) AS unique_fails, coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost,
        coalesce(sum(n) FILTER (hit AND NOT gone AND bad), 0) AS toxic_lost FROM m GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""

#: Every document scored for every item that shares a term with it.
_OP13_SQL = """
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT nn FROM total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
),
m AS (SELECT r, 50 + (50 * n * (SELECT nn FROM total)) // (SELECT ll FROM total) AS m FROM n),
s AS (
    SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op5_line_windows": _OP5_SQL,
    "op11_embedding_duplicates": _OP11_SQL,
    "op12_filter_audit": _OP12_SQL,
    "op13_lexical_search": _OP13_SQL,
}
