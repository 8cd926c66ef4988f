"""Search by stored specification: single rows that were never ingested, and the whole work queue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.embed import VECTOR, Embedder
from kinmatch.functions.text import NAME_FIELDS, dedupe_names
from kinmatch.operators.search import MatchResult, match
from kinmatch.plans.spec import SearchSpec
from kinmatch.session import scratch_folder
from kinmatch.sources.catalog import load_spec


def related_items(catalog: DataFrame, queries: DataFrame, items: DataFrame, index_name: str, **options) -> MatchResult:
    """Run the specification stored for an index on query rows that have vectors, and the items of that index."""
    return match(queries, items, load_spec(catalog, index_name), index_name=index_name, **options)


def embed_queries(
    rows: DataFrame, spec: SearchSpec, embedder: Embedder, name_fields: Sequence[str] = NAME_FIELDS
) -> DataFrame:
    """Add the vectors a specification asks for to ad-hoc query rows, from the same text that ingest stores:
    name lists without repeats. For queue rows, whose items' vectors are stored, see `map_queue`."""
    for clause in spec.clauses:
        if clause.kind == "vector" and clause.column not in rows.columns:
            if clause.field in name_fields:
                rows = rows.withColumn(clause.field, dedupe_names(F.col(clause.field)))
            rows = embedder(rows, clause.field, clause.column)
    return rows


@dataclass
class QueueVectors:
    rows: DataFrame  # queue rows with the vectors of the specification, without those in `errors`
    errors: DataFrame  # (query_id, field, error): text without a vector
    sources: DataFrame  # (query_id, field, source): blank, stored, embedded or error


def queue_vectors(
    queue: DataFrame,
    items: DataFrame,
    spec: SearchSpec,
    embedder: Embedder | None = None,
    *,
    index_name: str | None = None,
    query_id: str = "item_id",
    item_id: str = "item_id",
    name_fields: Sequence[str] = NAME_FIELDS,
) -> QueueVectors:
    """The vectors that a specification needs for work-queue rows, which carry texts only.

    A field's vector is taken from the item of the same id if that still has the row's text; else the text is embedded; without
    an embedder, or where it gives nothing, the row is an error and does not search. Blank texts need no vector. Items and queue
    meet in one equi-join by id, within the index, on ids, texts and vectors alone; tables bucketed by id
    (`Tables.write_bucketed`) meet without a shuffle. Only texts without a stored vector reach the embedder. The rows
    are stored in the scratch folder, so that neither join nor embedder runs again for each pass of the search."""
    if index_name is not None:
        queue, items = (df.where(F.col("index_name") == index_name) for df in (queue, items))
    fields = list(dict.fromkeys(c.field for c in spec.clauses if c.kind == "vector"))
    columns = {c.field: c.column for c in spec.clauses if c.kind == "vector"}
    for name, df, wanted in (("queue", queue, fields), ("items", items, [*fields, *columns.values()])):
        lacking = [c for c in wanted if c not in df.columns]
        if lacking:
            raise ValueError(f"the specification needs the columns {lacking}, which the {name} lacks")

    def stored_text(field: str):
        value = F.coalesce(F.col(f"`{field}`").cast("string"), F.lit(""))
        return dedupe_names(value) if field in name_fields else value

    known = [F.struct(stored_text(f).alias("text"), F.col(f"`{columns[f]}`").cast(VECTOR).alias("vector")).alias(f"_known{k}") for k, f in enumerate(fields)]
    known = items.select(F.col(item_id).alias("_id"), *known)
    rows = queue.drop(*columns.values()).withColumns({f: stored_text(f) for f in fields})
    rows = rows.join(known, F.col(query_id) == F.col("_id"), "left").drop("_id")
    states = []
    for k, field in enumerate(fields):
        text, column, made = F.col(f"`{field}`"), columns[field], f"_made{k}"
        same = (F.col(f"_known{k}.text") == text) & (F.size(f"_known{k}.vector") > 0)
        rows = rows.withColumn(f"_has{k}", F.coalesce(same, F.lit(False)))
        if embedder is None:
            rows = rows.withColumn(made, F.lit(None).cast(VECTOR))
        else:
            rows = rows.withColumn(f"_todo{k}", F.when(F.col(f"_has{k}"), F.lit("")).otherwise(text))
            rows = embedder(rows, f"_todo{k}", made).drop(f"_todo{k}")
        usable = F.when((text != "") & (F.size(made) > 0), F.col(made))
        rows = rows.withColumn(column, F.when(F.col(f"_has{k}"), F.col(f"_known{k}.vector")).otherwise(usable))
        state = F.when(text == "", "blank").when(F.col(f"_has{k}"), "stored").when(F.col(f"`{column}`").isNotNull(), "embedded").otherwise("error")
        rows = rows.withColumn(f"_state{k}", state).drop(f"_known{k}", f"_has{k}", made)
        states.append(F.struct(F.lit(field).alias("field"), F.col(f"_state{k}").alias("source")))
    rows = rows.withColumn("_states", F.array(*states).cast("array<struct<field:string,source:string>>")).drop(*[f"_state{k}" for k in range(len(fields))])
    path = scratch_folder(queue.sparkSession, "queue")
    rows.write.parquet(path)
    rows = queue.sparkSession.read.schema(rows.schema).parquet(path)
    sources = rows.select(F.col(query_id).alias("query_id"), F.explode("_states").alias("s")).select("query_id", "s.field", "s.source")
    errors = sources.where("source = 'error'").select("query_id", "field", F.lit("text without a vector: none is stored and none was made").alias("error"))
    return QueueVectors(rows.where("NOT exists(_states, s -> s.source = 'error')").drop("_states"), errors, sources)


@dataclass
class MappedQueue:
    result: MatchResult
    vectors: QueueVectors


def map_queue(
    catalog: DataFrame, queue: DataFrame, items: DataFrame, index_name: str, embedder: Embedder | None = None, *, name_fields: Sequence[str] = NAME_FIELDS, **options
) -> MappedQueue:
    """The work queue of an index against its items, by the stored specification: see `queue_vectors` and `match`."""
    spec = load_spec(catalog, index_name)
    ids = {k: options[k] for k in ("query_id", "item_id") if k in options}
    vectors = queue_vectors(queue, items, spec, embedder, index_name=index_name, name_fields=name_fields, **ids)
    return MappedQueue(match(vectors.rows, items, spec, index_name=index_name, **options), vectors)
