"""Batch search: every query row against every item of an index, best `size` items per query.

The pairs to score come from the most restrictive source that keeps the result whole:

* a required vector clause: radial join on it (cells, blocks);
* otherwise radial joins on the optional vector clauses and equi-joins on rare exact values, plus
  `value_groups.py` for frequent exact values; a pair found by several sources counts under the first;
* a handful of queries: one pass over the items.

With `lsh` the radial joins are approximate: rows meet in hash buckets (`lsh.py`) in place of cells.

A query's blank values switch its clauses off, also required ones, so queries are routed one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.operators.blocks import block_scores, partitions_for, scan_join, useful_cells
from kinmatch.operators.lsh import Lsh, add_buckets
from kinmatch.operators.scoring import Scoring
from kinmatch.operators.topk import top_rows
from kinmatch.operators.term_stats import add_counts, idf, idf_value, slot_counts, stored_counts, stored_total
from kinmatch.operators.value_groups import count_rows, frequent_only, group_patterns, subset_count, value_group_matches
from kinmatch.plans.spec import SearchSpec
from kinmatch.session import scratch_folder


#: With more exact fields the queries, which are joined with the counts of each, are prepared once and reread.
STAGED_FIELDS = 8


@dataclass(frozen=True)
class MatchOptions:
    term_scoring: str = "bm25"  # or "constant": every exact hit has base 1
    term_scale: float = 1.0
    exclude_self: bool = False
    match_all: bool = True  # queries without any value match everything with score 1
    block_rows: int = 8192  # a task holds 256 times as many distinct value combinations, as bytes
    held_rows: int = 131_072  # items that a task holds while queries stream past
    scan_queries: int = 16  # up to this many queries are scored in one pass over the items
    rare_rows: int | None = None  # exact values on at most this many items are joined directly
    subsets: int = 512  # of exact fields that are counted one by one; with more, value combinations are compared in blocks
    cell_rows: int = 65536  # wanted items per metric cell; fewer items than twice this use no cells
    lsh: Lsh | None = None  # approximate: pairs of a vector clause meet in hash buckets; found ones are right, some are missed
    broadcast_bytes: int = 8 << 20  # largest value-count table of a field that is broadcast
    stage_rows: int = 1_000_000  # from this many queries on, prepared queries are written once and reread; so are items with vectors


@dataclass
class MatchResult:
    spec: SearchSpec
    pairs: DataFrame  # best rows and counts per block, see `score_block`
    queries: DataFrame  # (query_id)
    merged: bool  # whether a pair can occur twice in `pairs`
    items: int  # number of items searched
    kept: list[DataFrame] = field(default_factory=list)  # small persisted helper tables
    best: DataFrame | None = None  # `pairs` where no totals are wanted
    totals: DataFrame | None = None  # `pairs` where no more than the best score and the totals are wanted

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> MatchResult:
        """Keep the scored pairs while both `hits` and `summary` are read."""
        return replace(self, pairs=self.pairs.persist(level), best=None, totals=None)

    def unpersist(self) -> None:
        for df in [self.pairs, *self.kept]:
            df.unpersist()

    @cached_property
    def ranked(self) -> DataFrame:
        rows = (self.pairs if self.best is None else self.best).where(F.col("item_id").isNotNull()).drop("n")
        if self.merged:
            best = F.max(F.struct("score", F.bit_count("hits"), "hits", "bases")).alias("b")
            rows = rows.groupBy("query_id", "item_id").agg(best).select("query_id", "item_id", "b.score", "b.hits", "b.bases")
        ranked = top_rows(rows, ["query_id"], [F.col("score").desc(), "item_id"], self.spec.size, "rank", "item_id", self.items)
        return ranked.withColumn("rank", F.col("rank").cast("bigint"))

    @cached_property
    def hits(self) -> DataFrame:
        """(query_id, item_id, rank, score, matched_queries[, explanation])."""
        clauses = self.spec.clauses
        named = self.ranked.withColumns(
            {
                "_hit": F.expr(f"filter(array({', '.join(map(str, range(len(clauses))))}), i -> shiftright(hits, i) & 1L = 1L)"),
                "_names": F.lit([c.name for c in clauses]).cast("array<string>"),
                "_occur": F.lit([c.occur for c in clauses]).cast("array<string>"),
                "_weight": F.lit([float(c.weight) for c in clauses]).cast("array<double>"),
            }
        )
        columns = ["query_id", "item_id", "rank", "score", "transform(_hit, i -> _names[i]) AS matched_queries"]
        if self.spec.explain:
            columns.append(
                "transform(_hit, i -> named_struct('name', _names[i], 'occur', _occur[i], 'base', bases[i], "
                "'weight', _weight[i], 'score', bases[i] * _weight[i])) AS explanation"
            )
        return named.selectExpr(*columns)

    @cached_property
    def summary(self) -> DataFrame:
        """(query_id, total_results, max_score), one row per query, also without results."""
        rows = (self.pairs if self.totals is None else self.totals).select("query_id", "score", "n")
        none = self.queries.select("query_id", F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("n"))
        return (
            rows.unionByName(none)
            .groupBy("query_id")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_results"), F.max("score").alias("max_score"))
        )

    def with_source(self, items: DataFrame, item_id: str = "item_id") -> DataFrame:
        """Hits with the item's columns, without vectors."""
        shown = [c for c in items.columns if not c.endswith("Embedding") and c != item_id and c != "index_name"]
        source = items.select(F.col(item_id).alias("item_id"), *shown)
        return self.hits.join(source, "item_id")


def _column(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(f"`{name}`").cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def _check_columns(queries: DataFrame, items: DataFrame, spec: SearchSpec, indexed: bool) -> None:
    """A clause without its column would count as blank in every row, or never hit: that is an error of the caller.
    Only an exact column may be absent on one side, or on both in a search of one index, whose rows need not have brought all
    columns to the shared tables; its value is blank there."""
    for c in spec.clauses:
        lacking = [name for name, df in (("queries", queries), ("items", items)) if c.column not in df.columns]
        if lacking and c.kind == "vector" or len(lacking) == 2 and not indexed:
            hint = "; queue rows get their vectors from map_queue" if c.kind == "vector" else ""
            raise ValueError(f"clause {c.name} needs the column {c.column!r}, which {' and '.join(lacking)} lack{hint}")


def _prepare(df: DataFrame, spec: SearchSpec, id_col: str, name: str, item_side: bool) -> DataFrame:
    """id, v<slot>, t<slot>; on the query side also act, the mask of clauses whose value is not blank."""
    cols, active = [F.col(id_col).alias(name)], ["0L"]
    slots = {"vector": 0, "exact": 0}
    for i, c in enumerate(spec.clauses):
        slot = slots[c.kind]
        slots[c.kind] += 1
        if c.kind == "vector":
            vector = _column(df, c.column, "array<float>")
            given = F.size(vector) > 0
            if c.field in df.columns:
                given = given & (F.col(f"`{c.field}`").cast("string") != "")
            cols.append(F.when(given, vector).alias(f"v{slot}"))
            active.append(f"CASE WHEN v{slot} IS NOT NULL THEN {1 << i}L ELSE 0L END")
        else:
            cols.append(F.coalesce(_column(df, c.field, "string"), F.lit("")).alias(f"t{slot}"))
            active.append(f"CASE WHEN t{slot} <> '' THEN {1 << i}L ELSE 0L END")
    out = df.select(*cols)
    return out if item_side else out.withColumn("act", F.expr(" | ".join(active)))


def _on(mask: str, i: int) -> str:
    return f"({mask} & {1 << i}L) <> 0L"


def _route(q: DataFrame, spec: SearchSpec, rare: int) -> DataFrame:
    """Add gens and heavy (see `scoring.py`) from the active clauses and the value counts n_t<slot>."""
    numbered = list(enumerate(spec.clauses))
    exact = [i for i, c in numbered if c.kind == "exact"]
    must_vectors = [i for i, c in numbered if c.kind == "vector" and c.occur == "must"]
    must_vectors.sort(key=lambda i: -spec.clauses[i].min_score)
    should_vectors = sum(1 << i for i, c in numbered if c.kind == "vector" and c.occur == "should")
    scarce = {i: f"{_on('act', i)} AND coalesce(n_t{slot}, 0L) <= {rare}" for slot, i in enumerate(exact)}

    # one clause that every match has to hit, if there is one: a required vector, else a required rare value
    single = [(_on("act", i), i) for i in must_vectors]
    if rare:
        single += [(scarce[i], i) for i in exact if spec.clauses[i].occur == "must"]
    rare_bits = " | ".join([f"CASE WHEN {scarce[i]} THEN {1 << i}L ELSE 0L END" for i in exact if rare] or ["0L"])
    q = q.withColumn("_rare", F.expr(rare_bits))
    when = " ".join(f"WHEN {condition} THEN {1 << i}L" for condition, i in single)
    any_match = f"(act & {should_vectors}L) | _rare"
    groups = f"act & {sum(1 << i for i in exact)}L & ~_rare"
    q = q.withColumn("gens", F.expr(f"CASE {when} ELSE {any_match} END" if when else any_match))
    when = " OR ".join(condition for condition, _ in single)
    return q.withColumn("heavy", F.expr(f"CASE WHEN {when} THEN 0L ELSE {groups} END" if when else groups)).drop("_rare")


def _with_bases(q: DataFrame, spec: SearchSpec, opt: MatchOptions, total: int) -> DataFrame:
    """Add base, the score of a hit per exact clause, from the value counts n_t<slot>."""
    slots = range(sum(c.kind == "exact" for c in spec.clauses))
    scale = F.lit(float(opt.term_scale))
    if opt.term_scoring == "constant":
        bases = [scale for _ in slots]
    else:
        bases = [idf(F.coalesce(F.col(f"n_t{s}"), F.lit(0)), total) * scale for s in slots]
    q = q.withColumn("base", F.array(*bases) if bases else F.array().cast("array<double>"))
    return q.drop(*[f"n_t{s}" for s in slots])


def match(
    queries: DataFrame,
    items: DataFrame,
    spec: SearchSpec,
    *,
    query_id: str = "item_id",
    item_id: str = "item_id",
    index_name: str | None = None,
    counts: DataFrame | None = None,
    options: MatchOptions | None = None,
    **changes,
) -> MatchResult:
    """Find, for each query row, the items that satisfy `spec`, best first.

    Both tables hold the spec's exact fields and `<field>Embedding` vectors; ids are unique in each. A vector clause
    whose column a table lacks, and an exact one that both lack without `index_name`, raise a ValueError.
    `index_name` restricts both to one index. `counts` are value counts kept by ingest (`Tables.term_counts`); without them
    the items are counted. Options can also be given as keywords. Small jobs run at
    once (counts, and which clauses the queries use); the search itself is lazy."""
    opt = replace(options or MatchOptions(), **changes)
    if opt.term_scoring not in ("bm25", "constant"):
        raise ValueError(f"unknown term_scoring {opt.term_scoring!r}")
    _check_columns(queries, items, spec, index_name is not None)
    if index_name is not None:
        queries = queries.where(F.col("index_name") == index_name)
        items = items.where(F.col("index_name") == index_name)
    exact = [i for i, c in enumerate(spec.clauses) if c.kind == "exact"]
    rare = opt.rare_rows if opt.rare_rows is not None else (0 if len(exact) <= 5 else 4096)
    side = _prepare(items, spec, item_id, "item_id", True)
    q = _prepare(queries, spec, query_id, "query_id", False)
    nq = queries.count()
    if nq <= opt.scan_queries:
        return _scan(q, items, spec, item_id, opt, counts)

    total = stored_total(counts) if counts is not None else nq if queries.sameSemantics(items) else items.count()
    kept: list[DataFrame] = []
    slots = [f"t{s}" for s in range(len(exact))]
    plain = q
    if exact and (rare or opt.term_scoring == "bm25"):
        fields = dict(zip(slots, (spec.clauses[i].field for i in exact)))
        counts = stored_counts(counts, fields) if counts is not None else slot_counts(side, slots)
        counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(counts)
        q = add_counts(q, counts, slots, opt.broadcast_bytes)
    q = _with_bases(_route(q, spec, rare), spec, opt, total)
    staged = nq >= opt.stage_rows or len(exact) > STAGED_FIELDS
    if staged:
        path = scratch_folder(q.sparkSession, "queries")
        q.write.parquet(path)
        q = q.sparkSession.read.parquet(path)
    if total >= opt.stage_rows and any(c.kind == "vector" for c in spec.clauses):
        # cells and blocks read the items several times, and their vectors may be made on the way
        path, shape = scratch_folder(q.sparkSession, "items"), side.schema
        side.write.parquet(path)
        side = q.sparkSession.read.schema(shape).parquet(path)
    # without rare values the routes do not depend on the counts, so the profile can skip them
    routed = q if rare or staged else _route(plain, spec, 0)
    return _batch(q, routed, side, spec, nq, total, rare, kept, opt)


def _batch(q, routed, side, spec: SearchSpec, nq: int, total: int, rare: int, kept: list, opt: MatchOptions) -> MatchResult:
    """Many queries: one part per generating clause in use, and the value groups."""
    scoring = Scoring.of(spec, opt.exclude_self)
    key = next((i for i, c in enumerate(spec.clauses) if c.kind == "exact" and c.occur == "must"), None)
    keyed = _on("act", key) if key is not None else "false"
    used = [(gen, on, with_key) for gen in range(len(spec.clauses)) for on, with_key in ((keyed, True), (f"NOT ({keyed})", False))]
    profile = routed.selectExpr(
        "count_if(act = 0) AS blank",
        "coalesce(bit_or(heavy), 0L) AS heavy",
        *[f"count_if({_on('gens', gen)} AND {on})" for gen, on, _ in used],
    ).first()

    passes = []
    for (gen, on, with_key), n in zip(used, profile[2:]):
        if n:
            part = q if n == nq else q.where(f"{_on('gens', gen)} AND {on}")
            passes.append(_pass(part, side, scoring, gen, key if with_key else None, n, total, opt))
    grouped = profile["heavy"] != 0
    if grouped:
        patterns = None
        if subset_count(scoring, profile["heavy"]) <= opt.subsets:
            masks = routed.select("heavy").where("heavy <> 0").distinct().collect()  # at most `subsets` rows
            patterns = group_patterns(scoring, [m.heavy for m in masks])
        grouped = patterns is None or len(patterns) > 0
    others = []
    if grouped:
        frequent = frequent_only(side, scoring, rare) if rare else side
        others.append(value_group_matches(q, frequent, scoring, patterns, partitions_for(q.sparkSession, nq), total, opt.block_rows))
    ids = q.select("query_id") if rare else routed.select("query_id")
    if opt.match_all and profile["blank"]:
        others.append(_match_all(routed, side, scoring, total))
    if not passes and not others:
        others.append(count_rows(ids.limit(0), F.lit(0), side))
    merged = bool(grouped) and len(passes) > 0
    pairs, best, totals = (
        reduce(DataFrame.unionByName, [*(scores(rule, counted) for scores in passes), *others])
        for rule, counted in ((scoring, True), (scoring, False), (replace(scoring, keep=1), True))
    )
    return MatchResult(spec, pairs, ids, merged, total, kept, best, totals)


def _scan(q: DataFrame, items: DataFrame, spec: SearchSpec, item_id: str, opt: MatchOptions, counts: DataFrame | None = None) -> MatchResult:
    """A few queries: they are collected, and every item is scored against them in one pass."""
    scoring = Scoring.of(spec, opt.exclude_self)
    side = _prepare(items, spec, item_id, "item_id", True)
    few = q.toArrow()
    slots = [f"t{s}" for s in range(sum(c.kind == "exact" for c in spec.clauses))]
    wanted = [(s, v) for s in slots for v in few.column(s).unique().to_pylist() if v]
    counted = wanted if opt.term_scoring == "bm25" else []
    if counts is None:
        found = side.agg(F.count("*"), *[F.count_if(F.col(s) == v) for s, v in counted]).first()
        total, n = found[0], dict(zip(counted, found[1:]))
    else:
        fields = dict(zip(slots, (c.field for c in spec.clauses if c.kind == "exact")))
        values = stored_counts(counts, fields).where(F.col("value").isin(sorted({v for _, v in counted}))) if counted else None
        total, n = stored_total(counts), {(r.slot, r.value): r.n for r in values.collect()} if counted else {}
    zeros = pa.array([0] * few.num_rows, pa.int64())
    bases = [
        [opt.term_scale * (idf_value(n.get((s, v), 0), total) if opt.term_scoring == "bm25" else 1.0) for s, v in zip(slots, row)]
        for row in zip(*[few.column(s).to_pylist() for s in slots])
    ] or [[] for _ in range(few.num_rows)]
    few = few.append_column("gens", zeros).append_column("heavy", zeros)
    few = few.append_column("base", pa.array(bases, pa.list_(pa.float64())))
    narrowed = _prepare(_required_values(items, spec, few), spec, item_id, "item_id", True)
    pairs = scan_join(few, narrowed, scoring, q.schema["query_id"].dataType.simpleString())
    if opt.match_all and 0 in few.column("act").to_pylist():
        pairs = pairs.unionByName(_match_all(q, side, scoring, total))
    return MatchResult(spec, pairs, q.select("query_id"), False, total)


def _pass(q, items, scoring: Scoring, gen: int, key: int | None, nq: int, ni: int, opt: MatchOptions) -> Callable[[Scoring, bool], DataFrame]:
    """Pairs whose first generator is clause `gen`, met on the values that have to be equal; see `block_scores`."""
    clause, keys = scoring.clauses[gen], []
    column = f"{'v' if clause.kind == 'vector' else 't'}{scoring.slot(gen)}"
    items = items.where(F.col(column).isNotNull() if clause.kind == "vector" else F.col(column) != "")
    if clause.kind == "exact":
        q, items = q.withColumn("_value", F.col(column)), items.withColumn("_value", F.col(column))
        keys.append("_value")
    if key is not None and key != gen:
        name = f"t{scoring.slot(key)}"
        q, items = q.withColumn("_need", F.col(name)), items.where(F.col(name) != "").withColumn("_need", F.col(name))
        keys.append("_need")
    cells = ni // opt.cell_rows
    lsh = opt.lsh if clause.kind == "vector" and clause.min_score > 0 else None
    if lsh:
        q, items = add_buckets(q, items, column, clause.min_score, lsh)
        keys += ["_table", "_bucket"]
    elif clause.kind == "vector" and clause.min_score > 0 and cells >= 2:
        placed = useful_cells(q, items, column, clause.min_score, cells)
        if placed:
            q, items = placed
            keys.append("_cell")
    spread = 4 * q.sparkSession.sparkContext.defaultParallelism
    return block_scores(q, items, keys, gen, lsh, nq=nq, ni=ni, held_rows=opt.held_rows, spread=spread)


def _required_values(items: DataFrame, spec: SearchSpec, few) -> DataFrame:
    """Push the values that every one of a few queries requires down to the item scan."""
    slot = 0
    for c in spec.clauses:
        if c.kind == "exact":
            values = few.column(f"t{slot}").unique().to_pylist()
            slot += 1
            if c.occur == "must" and "" not in values and c.field in items.columns:
                items = items.where(F.col(f"`{c.field}`").cast("string").isin(values))
    return items


def _match_all(q: DataFrame, items: DataFrame, scoring: Scoring, total: int) -> DataFrame:
    """Queries without any active clause get the first items by id, with score 1."""
    keep = scoring.keep + (1 if scoring.exclude_self else 0)
    first = items.select("item_id").orderBy("item_id").limit(keep).toArrow().column(0).to_pylist()
    blank = q.where(F.col("act") == 0).select("query_id")
    dtype = T.ArrayType(items.schema["item_id"].dataType)
    listed = F.from_json(F.lit(_json_list(first)), dtype) if first else F.array().cast(dtype)
    rows = blank.select(
        "query_id",
        F.explode(listed).alias("item_id"),
        F.lit(1.0).alias("score"),
        F.lit(0).cast("bigint").alias("hits"),
        F.array(*[F.lit(0.0)] * len(scoring.clauses)).cast("array<double>").alias("bases"),
        F.lit(None).cast("bigint").alias("n"),
    )
    if scoring.exclude_self:
        rows = rows.where(F.col("item_id") != F.col("query_id"))
        own = blank.join(items.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
        rows = rows.unionByName(count_rows(own, F.lit(-1), items))
    return rows.unionByName(count_rows(blank, F.lit(total), items))


def _json_list(values: list) -> str:
    import json

    return json.dumps(values, default=str)
