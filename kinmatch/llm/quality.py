"""Quality rules under weak supervision, in DataFrame functions only.

Every rule looks at counts of one text and votes "good", "bad" or abstains. Which rules can be trusted is learnt
without labels: expectation-maximisation over the votes estimates how each rule votes on good and on bad texts, and a
text is kept if its posterior probability of being good is at least 0.5.

The rules share no vote that follows length alone: else the two classes that explain the votes best are long and short
texts. Texts that fail the base test are rejected whatever the rules say, and are left out of the estimation, which
would otherwise find just these again.

The votes of all other documents are first counted by pattern. There are at most 3 ** len(RULES) patterns whatever the
number of documents, so a round of the estimation is one aggregate over a small stored table, and the driver sees only
the parameters. Texts are read once: counts are stored in the shared scratch folder.

Edge cases: a null or empty text, or one without words, has zero counts, no votes, fails the base test and is not kept.
Null ids and repeated rows are ordinary rows. An empty table gives an empty result. Input columns named like an output
column are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.session import scratch_folder

# Fixed values of the contract: white space between words, symbols, base limits.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = "[ \\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# What is believed of any rule before votes are counted, as so many texts by vote: good texts are hardly ever voted bad,
# bad texts by three rules in ten. Large tables outweigh it.
PRIOR = {"good": {-1: 0.05, 0: 0.5, 1: 9.45}, "bad": {-1: 3.0, 0: 1.0, 1: 6.0}}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SIGNALS = ["n_lines", "n_upper", "n_letters", "n_marks", "n_ended", "n_distinct", "n_symbol_runs"]


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    good: str
    bad: str


RULES = [
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "100 * n_symbols < n_words", "10 * n_symbols > n_words"),
    Rule("marked_words", "50 * n_symbol_runs < n_words", "5 * n_symbol_runs > n_words"),
    Rule("letters", "20 * n_letters >= 19 * word_chars", "10 * n_letters < 9 * word_chars"),
    Rule("duplicate_lines", "10 * n_dup_lines <= n_lines", "3 * n_dup_lines > n_lines"),
    Rule("repeats", "10 * n_repeat_words < n_words", "4 * n_repeat_words > n_words"),
    Rule("upper_case", "5 * n_upper < n_letters", "2 * n_upper > n_letters"),
    Rule("marks", "50 * n_marks < n_words", "5 * n_marks > n_words"),
    Rule("ended_lines", "4 * n_ended >= 3 * n_lines", "3 * n_ended < n_lines"),
    Rule("variety", "4 * n_distinct > n_words OR n_distinct > 500", "10 * n_distinct < n_words AND n_distinct < 200"),
]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def count_signals(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and the counts of each text. Words are parted by SPACE.

    n_repeat_words counts the words that lie in a three-word window found at least twice in the text. Windows are
    compared as 64-bit hashes within one text.
    """
    keep = docs.columns if keep is None else keep
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), t.alias("t"))
    out = out.withColumn("words", F.filter(F.split("t", SPACE_RE), lambda w: w != ""))
    out = out.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")))
    n = F.size("words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get("words", i)
    out = out.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    ordered = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("ordered", ordered)
    near = lambda i: F.get("ordered", i)["h"]
    found = F.filter("ordered", lambda x, k: (F.coalesce(near(k - 1) == x["h"], F.lit(False))) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    out = out.withColumn("at", F.array_sort(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b
    )
    length = F.length("t")
    lower = F.length(F.regexp_replace("t", "\\p{Lu}", ""))
    return out.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(_without(F.col("t"), SPACE)).cast("long").alias("word_chars"),
        (length - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (length - lower).cast("long").alias("n_upper"),
        F.length(_without(F.col("t"), SPACE + "0123456789" + SYMBOLS + ".,!?;:-")).cast("long").alias("n_letters"),
        (length - F.length(_without(F.col("t"), "!?"))).cast("long").alias("n_marks"),
        F.size(F.filter("lines", lambda x: x.rlike("[.!?:;\"')][ \\x09-\\x0D]*$"))).cast("long").alias("n_ended"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]+")).cast("long").alias("n_symbol_runs"),
    )


def vote(rule: Rule) -> Column:
    """1 good, -1 bad, 0 abstains; texts without words get no votes."""
    return F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END")


Chances = dict[str, dict[int, tuple[float, float]]]


def log_odds(prior: float, chances: Chances) -> Column:
    """Log of P(good | votes) / P(bad | votes). chances[rule][vote]: chance of this vote on good and on bad texts."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name, by_vote in chances.items():
        ratio = {v: math.log(g / b) for v, (g, b) in by_vote.items()}
        total = total + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    return total


def estimate(patterns: DataFrame, names: list[str], rounds: int = 20) -> tuple[float, Chances]:
    """Prior of good texts, and how each rule votes on good and on bad texts, from the columns `names` (votes) and `n`
    (documents with these votes).

    To abstain is an outcome of its own: a rule that only ever speaks up against junk says something by silence too.
    Starts from the number of bad votes. PRIOR is added to the counts of each rule and class. `rounds` aggregates over the small table; the driver gets one row of sums from each.
    """
    voted = patterns.where(F.greatest(*[F.abs(F.col(c)) for c in names]) > 0)
    down = sum((F.when(F.col(c) == -1, 1).otherwise(0) for c in names), F.lit(0))
    q = F.when(down == 0, 0.99).when(down == 1, 0.2).otherwise(0.01)
    prior, chances = 0.5, {c: {v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for c in names}
    n = F.col("n")
    for _ in range(rounds):
        sums = [F.sum(n * F.col("q")).alias("good"), F.sum(n * (1 - F.col("q"))).alias("bad")]
        for c in names:
            for v in (-1, 0, 1):
                sums += [F.sum(F.when(F.col(c) == v, n * F.col("q"))).alias(f"good {c} {v}")]
                sums += [F.sum(F.when(F.col(c) == v, n * (1 - F.col("q")))).alias(f"bad {c} {v}")]
        s = voted.select("*", q.alias("q")).agg(*sums).first()
        if s["good"] is None:
            break
        share = lambda kind, c, v: ((s[f"{kind} {c} {v}"] or 0.0) + PRIOR[kind][v]) / (s[kind] + sum(PRIOR[kind].values()))  # noqa: E731, B023
        prior = (s["good"] + 1) / (s["good"] + s["bad"] + 2)
        chances = {c: {v: (share("good", c, v), share("bad", c, v)) for v in (-1, 0, 1)} for c in names}
        q = 1 / (1 + F.exp(-log_odds(prior, chances)))
    return prior, chances


def quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None, rounds: int = 20) -> DataFrame:
    """The columns `keep` (default: all), the counts, base_failed, posterior (P(good), null without votes) and kept."""
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    path = f"{scratch_folder(spark, 'quality')}/counts"
    keep = docs.columns if keep is None else keep
    counted = count_signals(docs, text, keep)
    names = [f"vote_{r.name}" for r in rules]
    counted = counted.select("*", *[vote(r).alias(c) for r, c in zip(rules, names, strict=True)])
    counted.write.parquet(path)
    stored = spark.read.schema(counted.schema).parquet(path)

    # At most 3 ** len(rules) rows, in one partition so that every round adds them up in the same order.
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    patterns = stored.where(~failed).groupBy(*names).agg(F.count("*").alias("n"))
    small = f"{path}-patterns"
    patterns.orderBy(*names).coalesce(1).write.parquet(small)
    prior, chances = estimate(spark.read.schema(patterns.schema).parquet(small).coalesce(1), names, rounds)

    voted = F.greatest(*[F.abs(F.col(c)) for c in names]) > 0
    odds = log_odds(prior, chances)
    posterior = F.when(voted, 1 / (1 + F.exp(-odds)))
    made = [*COUNTS, "base_failed", "posterior", "kept"]
    return stored.select(
        *[F.col("row")[c].alias(c) for c in keep if c not in made],
        *COUNTS,
        failed.alias("base_failed"),
        posterior.alias("posterior"),
        (~failed & F.coalesce(posterior >= 0.5, F.lit(False))).alias("kept"),
    )


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: documents that the rules reject go. Columns stay as they are."""
    renamed = docs.select(F.col("text").alias("t"), F.struct(*docs.columns).alias("doc"))
    return quality(renamed, "t", ["doc"]).where("kept").select("doc.*")
