"""Toxicity by non-negative positive-unlabelled learning.

Known are some toxic texts (positives); all other texts are unlabelled, a few of them toxic too. With the share of toxic
texts (class prior) the risk on clean texts follows from both samples: unlabelled risk less the prior times the positives'
risk as if clean. That difference cannot be negative in truth; where a flexible model makes it so, training steps back
instead (Kiryo and others' non-negative estimator). The model is logistic over hashed words, in numpy.

The model is fitted on a bounded sample: at most POSITIVES toxic texts and UNLABELLED texts, taken by a hash of the id from
the rows that may be learnt from, so the driver holds a fixed number of texts' word lists. The prior is the share of toxic
texts among all labelled rows that may be learnt from. All texts are scored, whole, where they are read.

Words are runs of letters (ASCII letters in lower case, and all non-ASCII bytes); words and their beginnings, which
stand for inflected and joined forms, are hashed, and a text counts each once.
Only words in at least MIN_TEXTS of the sampled positives, and LIFT times as frequent there as in unlabelled texts, have a
weight, and no weight is negative beyond a common bias: texts get no better by getting longer. Ids, languages, sources and labels are no inputs of a score.

Edge cases: null and empty texts have no words and get the bias alone, a low score. Without any toxic text to learn from,
all scores are 0. A null id is never held out and its labels are not learnt. Repeated rows and label rows are counted as
they come. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.flat import LOWER, flat_text, slices, span_hashes, words

BUCKETS = 1 << 18
POSITIVES, UNLABELLED = 4000, 12000
MIN_TEXTS = 5
LIFT = 3.0
STEPS, RATE, DECAY = 400, 0.1, 1e-3
FOLDS = 5
PREFIXES = (4, 5, 6, 7)

#: Bytes that belong to no word become blanks.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = LOWER[65:91]
_LETTERS[128:] = np.arange(128, 256)


def word_buckets(column: pa.Array) -> list[np.ndarray]:
    """Distinct hashed words of each text, and the beginnings of PREFIXES bytes of longer words."""
    data, offsets = flat_text(column)
    data = _LETTERS[data]
    starts, ends, first = words(data, offsets)
    spans = [span_hashes(data, starts, ends)]
    spans += [span_hashes(data, starts, np.minimum(ends, starts + k)) + np.uint64(k) for k in PREFIXES]
    buckets = np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in spans], axis=1)
    return [np.unique(buckets[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights of all buckets and bias, by full steps of Adam on the non-negative risk."""
    counts = np.zeros(BUCKETS, np.int64)
    for x in positives:
        counts[x] += 1
    among = np.ones(BUCKETS)
    for x in unlabelled:
        among[x] += 1
    used = np.flatnonzero((counts >= MIN_TEXTS) & (counts / max(len(positives), 1) >= LIFT * among / max(len(unlabelled), 1)))
    column = np.full(BUCKETS, -1, np.int64)
    column[used] = np.arange(len(used))

    def sparse(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        kept = [c[c >= 0] for c in (column[x] for x in texts)]
        return np.repeat(np.arange(len(texts)), [len(c) for c in kept]), np.concatenate([*kept, np.empty(0, np.int64)]), len(texts)

    p, u = sparse(positives), sparse(unlabelled)
    w, bias = np.zeros(len(used) + 1), -2.0
    w[-1] = bias
    mean, square = np.zeros_like(w), np.zeros_like(w)

    def scores(rows: tuple) -> np.ndarray:
        return np.bincount(rows[0], w[rows[1]], rows[2]) + w[-1]

    def gradient(rows: tuple, slope: np.ndarray) -> np.ndarray:
        out = np.empty_like(w)
        out[:-1] = np.bincount(rows[1], slope[rows[0]], len(used))
        out[-1] = slope.sum()
        return out / max(rows[2], 1)

    for step in range(1, STEPS + 1):
        zp, zu = scores(p), scores(u)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # Logistic losses: log(1 + exp(-z)) as toxic, log(1 + exp(z)) as clean; slopes s - 1 and s.
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = gradient(u, su) - prior * gradient(p, sp)
        g = prior * gradient(p, sp - 1) + of_negative if negative >= 0 else -of_negative
        g[:-1] += DECAY * w[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = pa.array([x.tobytes() for x in word_buckets(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), found], ["toxic", "words"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias. docs: doc_id, text; labels: doc_id, toxic. Both are used only where held_out does not hold."""
    known = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return np.zeros(BUCKETS), -np.inf
    # Narrow rows choose the sample; only its texts are read in full.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(POSITIVES).withColumn("toxic", F.lit(1))
    other = docs.select("doc_id").where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).withColumn("toxic", F.lit(0))
    chosen = F.broadcast(toxic.unionByName(other))  # at most POSITIVES + UNLABELLED rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text").mapInArrow(_word_lists, "toxic int, words binary").collect()
    lists: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in rows:
        lists[r["toxic"]].append(np.frombuffer(r["words"], np.int32))
    if not lists[1] or not lists[0]:
        return np.zeros(BUCKETS), -np.inf
    return fit(lists[1], lists[0], min(max(share, 1e-4), 1 - 1e-4))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5)."""
    plain = docs.select("doc_id", "text")
    weights, bias = train(plain, labels)
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS numbers, whatever the input
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in slices(batches, "text"):
            z = np.array([w[x].sum(dtype=float) for x in word_buckets(batch.column("text"))]) + bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    scored = plain.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
