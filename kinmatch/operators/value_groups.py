"""Matches by exact values, without forming pairs.

Items that agree on a set of fields are interchangeable for a query: the hits of a pair depend only on
which fields agree. So items are counted per field subset and value combination, and per combination only
the lowest `keep` ids are kept. Any item among a query's best `keep` is among the lowest `keep` ids of the
combination it agrees on, since the items before it there score at least as high; the totals follow from
the counts by inclusion and exclusion. Work grows with items + queries, not with their product, however
frequent a value is.

The number of field subsets doubles with every optional field. Beyond `subsets` of them the distinct value combinations
of queries and items meet instead (`combination_matches`), in cells of rows that agree on some fields (`agreement.py`; by bitmaps,
`bitmaps.py`, where points can be negative): each combination of the items has a number of rows and a lowest id, so that a task
yields totals and, best first, the combinations that can hold a query's best rows; ids are fetched for these alone. Rows that
agree on every field count once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kinmatch.operators.agreement import pack, score_packed
from kinmatch.operators.bitmaps import score_held
from kinmatch.operators.blocks import _runs
from kinmatch.operators.scoring import DIGITS, Scoring
from kinmatch.operators.topk import top_rows
from kinmatch.session import scratch_folder


def _bits(clauses: Iterable[int]) -> int:
    return sum(1 << i for i in clauses)


def group_patterns(scoring: Scoring, heavy_masks: Iterable[int]) -> dict[int, int]:
    """Field subsets (as clause bitmasks) that can make a match on their own, for queries whose active
    frequent clauses are one of the masks, with their sign in the inclusion-exclusion sum."""
    exact = [i for i, c in enumerate(scoring.clauses) if c.kind == "exact"]
    must = [i for i in exact if scoring.clauses[i].occur == "must"]
    out: dict[int, int] = {}
    for mask in heavy_masks:
        required = [i for i in must if mask >> i & 1]
        optional = [i for i in exact if mask >> i & 1 and i not in must]
        least = scoring.min_should if required else max(scoring.min_should, 1)
        for s in range(least, len(optional) + 1):
            sign = sum(comb(s, u) * (-1) ** (s - u) for u in range(least, s + 1))
            for chosen in combinations(optional, s):
                out[_bits(required) | _bits(chosen)] = sign
    return out


def subset_count(scoring: Scoring, heavy: int) -> int:
    """How many field subsets `group_patterns` can give for masks within `heavy`."""
    optional = sum(1 for i, c in enumerate(scoring.clauses) if c.kind == "exact" and heavy >> i & 1)
    return 1 << optional


def _key(scoring: Scoring) -> tuple[list[str], Column, Column]:
    """Text columns; the key array under the row's pattern; and whether every field of it has a value."""
    exact = [i for i, c in enumerate(scoring.clauses) if c.kind == "exact"]
    cols = [f"t{scoring.slot(i)}" for i in exact]
    chosen = [F.col("pattern").bitwiseAND(F.lit(1 << i)) != 0 for i in exact]
    key = F.array(*[F.when(on, F.col(c)).otherwise(F.lit("")) for on, c in zip(chosen, cols)])
    whole = reduce(lambda a, b: a & b, [~on | (F.col(c) != "") for on, c in zip(chosen, cols)])
    return cols, key, whole


def _patterns(values: Iterable[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in sorted(values))})")


def frequent_only(items: DataFrame, scoring: Scoring, threshold: int) -> DataFrame:
    """Blank the item values that occur at most `threshold` times."""
    for i, c in enumerate(scoring.clauses):
        if c.kind == "exact":
            name = f"t{scoring.slot(i)}"
            often = items.where(F.col(name) != "").groupBy(name).count().where(F.col("count") > threshold)
            often = often.select(F.col(name).alias("_often"))
            filler = F.concat(F.lit("\0"), F.pmod(F.xxhash64("item_id"), F.lit(4096)).cast("string"))
            items = items.withColumn("_key", F.when(F.col(name) == "", filler).otherwise(F.col(name)))
            items = items.join(often, F.col("_key") == F.col("_often"), "left")
            items = items.withColumn(name, F.coalesce("_often", F.lit(""))).drop("_key", "_often")
    return items


def _groups(items: DataFrame, cols: list[str], key: Column, whole: Column, patterns: Iterable[int], keep: int, ni: int) -> DataFrame:
    """(pattern, key, n, ids): count and lowest `keep` ids of every value combination. Items are reduced to
    their distinct value combinations first, so that only those are spread over the field subsets; both
    windows are cut to `keep` rows per group before they are shuffled."""
    spread = F.explode(_patterns(patterns)).alias("pattern")
    counts = items.groupBy(*cols).agg(F.count("*").alias("n")).select("*", spread).where(whole)
    counts = counts.groupBy("pattern", key.alias("key")).agg(F.sum("n").alias("n"))
    ids = top_rows(items, cols, ["item_id"], keep, "_r", "item_id", ni).drop("_r")
    ids = ids.select("*", spread).where(whole).select("pattern", key.alias("key"), "item_id")
    ids = top_rows(ids, ["pattern", "key"], ["item_id"], keep, "_r", "item_id", ni)
    ids = ids.groupBy("pattern", "key").agg(F.collect_list("item_id").alias("ids"))
    return counts.join(ids, ["pattern", "key"])


def _masked(scoring: Scoring, cols: list[str]) -> tuple[list[Column], Column]:
    """Query values and bases under the mask of frequent clauses; others are blank and zero."""
    exact = [i for i, c in enumerate(scoring.clauses) if c.kind == "exact"]

    def masked(i: int, value: Column, blank) -> Column:
        return F.when(F.col("heavy").bitwiseAND(F.lit(1 << i)) != 0, value).otherwise(F.lit(blank))

    values = [masked(i, F.col(c), "").alias(c) for i, c in zip(exact, cols)]
    return values, F.array(*[masked(i, F.col("base")[scoring.slot(i)], 0.0) for i in exact]).alias("base")


def _bases_of(scoring: Scoring, hits: str) -> list[Column]:
    """Score of a hit by clause, from a column of hit bits and the bases of the exact clauses."""
    zero, bases = F.lit(0.0), [F.lit(0.0)] * len(scoring.clauses)
    for slot, i in enumerate(i for i, c in enumerate(scoring.clauses) if c.kind == "exact"):
        bases[i] = F.when(F.col(hits).bitwiseAND(F.lit(1 << i)) != 0, F.col("base")[slot]).otherwise(zero)
    return bases


def _pattern_matches(asked: DataFrame, items: DataFrame, scoring: Scoring, cols: list[str], key: Column, whole: Column, patterns: dict[int, int], keep: int, partitions: int, ni: int) -> DataFrame:
    """The best items of every combination of query values, by field subsets."""
    must_mask = F.lit(_bits(i for i, c in enumerate(scoring.clauses) if c.occur == "must" and c.kind == "exact"))
    combo = ["heavy", *cols]
    groups = _groups(items, cols, key, whole, patterns, keep, ni)

    # one row per distinct combination of frequent query values, then one per usable field subset
    usable = F.filter(
        _patterns(patterns),
        lambda p: (p.bitwiseAND(F.col("heavy")) == p)
        & (p.bitwiseAND(must_mask) == F.col("heavy").bitwiseAND(must_mask)),
    )
    asked = asked.withColumn("pattern", F.explode(usable)).withColumn("key", key)
    bases = _bases_of(scoring, "pattern")
    score = reduce(lambda a, b: a + b, [b * F.lit(float(c.weight)) for b, c in zip(bases, scoring.clauses)])
    signs = ", ".join(f"{p}L, {s}" for p, s in patterns.items())
    sign = F.try_element_at(F.expr(f"map({signs})"), F.col("pattern"))
    found = asked.join(groups, ["pattern", "key"]).select(
        *combo, "pattern", "n", "ids", sign.alias("sign"), F.round(score, DIGITS).alias("score"), F.array(*bases).alias("bases")
    )

    # a subset with `keep` items makes every lower-scored subset superfluous
    per_combo = W.partitionBy(*combo)
    found = found.repartition(partitions, *combo)
    found = found.withColumn("enough", F.max(F.when(F.col("n") >= keep, F.col("score"))).over(per_combo))
    found = found.withColumn("total", F.sum(F.col("sign") * F.col("n")).over(per_combo))
    found = found.where(F.col("enough").isNull() | (F.col("score") >= F.col("enough")))
    best = F.max(F.struct("score", F.col("pattern").alias("hits"), "bases")).alias("best")
    found = found.withColumn("item_id", F.explode("ids")).groupBy(*combo, "item_id").agg(best, F.first("total").alias("total"))
    order = per_combo.orderBy(F.col("best.score").desc(), "item_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)


def _combination_matches(asked: DataFrame, items: DataFrame, scoring: Scoring, cols: list[str], keep: int, block_rows: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The best items of every combination of query values, by number of the combination, and the numbered combinations. Items
    are held by tasks and queries stream past; each side is copied to a number of tasks that does not grow with the rows."""
    spark, folder = asked.sparkSession, scratch_folder(asked.sparkSession, "combinations")

    def stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        df.write.parquet(f"{folder}/{name}")
        found = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        return found, found.count()

    # ids are drawn once, when the combinations are stored
    asked, nq = stored(asked.withColumn("query_id", F.monotonically_increasing_id()), "asked")
    least = items.groupBy(*cols).agg(F.count("*").alias("n"), F.min("item_id").alias("least"))
    known, ni = stored(least.withColumn("item_id", F.monotonically_increasing_id()), "known")
    # cells count on points that only add up; with others the combinations are compared one by one
    falling = (asked.agg(F.min(F.array_min("base"))).first()[0] or 0) < 0
    # a task holds items by the byte, 256 combinations for a row of a block; compared one by one by the bit, 64 for a row
    pi = max(-(-ni // ((64 if falling else 256) * block_rows)), 1)
    pq = max(min(-(-(4 if falling else 2) * spark.sparkContext.defaultParallelism // pi), -(-nq // 64)), 1)
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("_pq", part("query_id", pq)).withColumn("_pi", every(pi)).withColumn("_side", F.lit(1))
    side = known.withColumn("_pi", part("item_id", pi))
    if not falling:
        side = side.sortWithinPartitions("_pi").mapInArrow(pack(cols, _runs), "_pi int, packed binary")
    side = side.withColumn("_pq", every(pq)).withColumn("_side", F.lit(0))
    both = side.unionByName(q, allowMissingColumns=True).withColumn("_block", F.col("_pq") * pi + F.col("_pi")).drop("_pq", "_pi")
    both = both.repartitionById(pq * pi, F.col("_block")).sortWithinPartitions("_block", "_side")
    shape = f"query_id bigint, combination bigint, least {items.schema['item_id'].dataType.simpleString()}, score double, hits bigint, n bigint"
    scorer = score_held if falling else score_packed
    pairs, _ = stored(both.mapInArrow(scorer(scoring, cols, keep, _runs), shape), "pairs")

    best = top_rows(pairs.where("combination IS NOT NULL"), ["query_id"], [F.desc("score"), "least"], keep, "_r", "combination", ni).drop("_r", "n", "least")
    ids = top_rows(items, cols, ["item_id"], keep, "_r", "item_id", rows).drop("_r")
    ids, _ = stored(ids.join(known.select(*cols, F.col("item_id").alias("combination")), cols).select("combination", "item_id"), "ids")
    ranked = top_rows(best.join(ids, "combination"), ["query_id"], [F.desc("score"), "item_id"], keep, "_r", "item_id", min(rows, keep * keep))
    totals = pairs.where("combination IS NULL").groupBy("query_id").agg(F.sum("n").alias("total"))
    found = ranked.join(totals, "query_id").join(asked.select("query_id", "base"), "query_id")
    best = F.struct("score", "hits", F.array(*_bases_of(scoring, "hits")).alias("bases")).alias("best")
    number = F.col("query_id").alias("number")
    return found.select(number, "item_id", best, "total", "_r"), asked.select("heavy", *cols, number)


def value_group_matches(
    q: DataFrame, items: DataFrame, scoring: Scoring, patterns: dict[int, int] | None, partitions: int, ni: int, block_rows: int = 8192
) -> DataFrame:
    """Rows as from `score_block`, for the queries with a non-zero `heavy` mask. With `patterns` (see `group_patterns`) by
    field subsets, without by combinations. A query's total stands on the row of its best item here."""
    cols, key, whole = _key(scoring)
    keep = scoring.keep + (1 if scoring.exclude_self else 0)
    items = items.select("item_id", *cols)
    values, base = _masked(scoring, cols)
    combo = ["heavy", *cols]
    combos = q.where(F.col("heavy") != 0).select("query_id", "heavy", *values, base)
    asked = combos.groupBy(*combo).agg(F.first("base").alias("base"))
    if patterns is None:
        found, numbered = _combination_matches(asked, items, scoring, cols, keep, block_rows, ni)
        # the wide columns meet once, for a number by which the rows found are joined
        combos, combo = combos.drop("base").join(numbered, combo).select("query_id", "number"), ["number"]
    else:
        combos = combos.drop("base")
        found = _pattern_matches(asked, items, scoring, cols, key, whole, patterns, keep, partitions, ni)

    # Back to the single queries. The few rows found are stored, so that both sides of the join are shuffled and a
    # combination that a third of all queries share can be split.
    path = scratch_folder(q.sparkSession, "value-groups")
    found.write.parquet(path)
    found = q.sparkSession.read.schema(found.schema).parquet(path)
    rows = combos.join(found, combo)
    own = F.col("query_id") == F.col("item_id") if scoring.exclude_self else F.lit(False)
    out = rows.select(
        "query_id",
        F.when(~own, F.col("item_id")).alias("item_id"),
        F.when(~own, F.col("best.score")).alias("score"),
        F.col("best.hits").alias("hits"),
        F.col("best.bases").alias("bases"),
        F.when(F.col("_r") == 1, F.col("total")).cast("bigint").alias("n"),
    )
    return out.unionByName(_self_rows(q, items, scoring)) if scoring.exclude_self else out


def count_rows(rows: DataFrame, n: Column, items: DataFrame) -> DataFrame:
    """Rows that add `n` to a query's total and carry no item."""
    return rows.select(
        "query_id",
        F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("bigint").alias("hits"),
        F.lit(None).cast(T.ArrayType(T.DoubleType())).alias("bases"),
        n.cast("bigint").alias("n"),
    )


def _self_rows(q: DataFrame, items: DataFrame, scoring: Scoring) -> DataFrame:
    """Take an item's match with itself out of the group totals."""
    own = items.select(F.col("item_id").alias("query_id"), *[F.col(c).alias(f"_{c}") for c in items.columns if c != "item_id"])
    both = q.where(F.col("heavy") != 0).drop("base").join(own, "query_id")
    required, optional, any_hit = F.lit(True), F.lit(0), F.lit(False)
    for i, c in enumerate(scoring.clauses):
        if c.kind == "exact":
            name = f"t{scoring.slot(i)}"
            used = F.col("heavy").bitwiseAND(F.lit(1 << i)) != 0
            hit = used & (F.col(name) == F.col(f"_{name}"))
            any_hit = any_hit | hit
            if c.occur == "must":
                required = required & (hit | ~used)
            else:
                optional = optional + hit.cast("int")
    return count_rows(both.where(required & any_hit & (optional >= scoring.min_should)), F.lit(-1), items)
