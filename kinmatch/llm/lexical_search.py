"""Ranked lexical search by Block-Max MaxScore over document shards.

1. One pass over whole texts writes, for each document, its number of terms and the occurrences of the terms that any query
   item asks for. Counts of documents, of terms and of documents by term are taken from that table, over all documents.
2. A task reads its part of the table and cuts it into shards of at most SHARD documents or POSTINGS postings. A shard gets
   an inverted index in ascending order of document: lists of compressed blocks of BLOCK postings, each with its last
   document and the largest score that one of its postings gives.
3. Items are run against a shard by MaxScore, in ranges of documents. Lists are ordered by their largest score; those whose
   largest scores together do not exceed the k-th best score so far are non-essential. Essential lists give the candidates.
   Non-essential lists are then looked up from the largest down: a candidate that cannot pass the k-th best score with the
   maximum of its block and of the lists after it is rejected, and only blocks that hold a remaining candidate are
   decompressed. Bounds are the scores themselves, in integers, so nothing that belongs to the k best is lost.
4. The heaps of the shards, k rows for each item, are merged by rank.

Items are taken in groups of about GROUP_BYTES bytes of text, with a pass over the documents for each group, so that the
terms sent to the tasks stay bounded however many items there are. Terms are met by a 64-bit hash and then compared by bytes.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. Scores follow
`weights` and `impacts`, in 64-bit integers.

Edge cases: null and empty texts, and texts without terms, hold no term; such documents do not count, and such items find
nothing. Very long texts are one document whatever their length. Items under one id, null too, are one item with the terms of
all; repeated rows of documents are documents of their own, ranked side by side. Equal scores go to the smaller doc_id, null
ids last. Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.flat import LOWER, U, flat_text, slices, span_hashes, words
from kinmatch.session import scratch_folder

K = 50
SHARD, POSTINGS = 32768, 4_000_000
BLOCK = 64
#: Documents of a range: the first is short, so that a k-th best score is known early.
FIRST, RANGE = 1024, 8192
GROUP_BYTES = 4 << 20

#: Bytes that no term holds: ASCII but for digits and letters.
APART = np.ones(256, bool)
APART[128:] = False
for _from, _to in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    APART[_from : _to + 1] = False


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of the terms, and each text's first term, len + 1."""
    data, offsets = flat_text(column)
    data = LOWER[data]
    return data, *words(data, offsets, APART)


class Vocabulary:
    """Numbers of the terms that a group of items asks for."""

    def __init__(self, terms: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = span_hashes(self.data, starts, ends)
        self.order = np.argsort(hashes)
        self.hashes, self.starts, self.lengths = hashes[self.order], starts[self.order], (ends - starts)[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise RuntimeError("two terms of the items share a 64-bit hash")

    def __len__(self) -> int:
        return len(self.order)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span of bytes, or -1."""
        if not len(starts) or not len(self):
            return np.full(len(starts), -1)
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == ends - starts))
        length = self.lengths[at[hit]]
        first = np.cumsum(length) - length
        step = np.arange(length.sum()) - np.repeat(first, length)
        same = data[np.repeat(starts[hit], length) + step] == self.data[np.repeat(self.starts[at[hit]], length) + step]
        if len(hit):
            hit = hit[np.logical_and.reduceat(same, first)]
        out = np.full(len(starts), -1)
        out[hit] = self.order[at[hit]]
        return out


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.array([int(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in holding.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


# ---- index ---------------------------------------------------------------------------------------------


def _count_terms(vocabulary: Vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, starts, ends, first = text_terms(batch.column("text"))
            numbers = vocabulary.numbers(data, starts, ends)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            held = numbers >= 0
            pairs, tf = np.unique(doc[held] * max(len(vocabulary), 1) + numbers[held], return_counts=True)
            at, term = np.divmod(pairs, max(len(vocabulary), 1))
            offsets = pa.array(np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return count


def _count_holding(width: int):
    """Number of documents by term, one row for each term that a task meets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[held])], ["term", "df"])

    return count


def _packed(values: np.ndarray) -> np.ndarray:
    """Values as unsigned integers of the least width that holds them."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


class PostingList:
    """Blocks of postings: gaps between documents and occurrences, in as few bytes as a block needs."""

    def __init__(self, docs: np.ndarray, tfs: np.ndarray, gains: np.ndarray) -> None:
        cuts = np.arange(0, len(docs), BLOCK)
        self.first = docs[cuts]
        self.last = docs[np.minimum(cuts + BLOCK, len(docs)) - 1]
        self.most = np.maximum.reduceat(gains, cuts)
        self.bound = int(self.most.max())
        gaps = np.diff(docs, prepend=docs[:1])
        gaps[cuts] = 0
        self.blocks = [(_packed(gaps[a : a + BLOCK]), _packed(tfs[a : a + BLOCK])) for a in cuts.tolist()]

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences of the blocks asked for, decompressed."""
        docs = [np.cumsum(self.blocks[b][0], dtype=np.int64) + self.first[b] for b in blocks.tolist()]
        tfs = [self.blocks[b][1] for b in blocks.tolist()]
        return np.concatenate(docs), np.concatenate(tfs).astype(np.int64)

    def within(self, low: int, high: int) -> np.ndarray:
        """Blocks that may hold documents of [low, high)."""
        return np.arange(np.searchsorted(self.last, low), np.searchsorted(self.first, high))


class Shard:
    """An inverted index over documents in ascending order of id."""

    def __init__(self, docs: pa.Table, weight: np.ndarray, n_docs: int, n_terms: int) -> None:
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
        self.ids = docs.column("doc_id").combine_chunks()
        self.m = 50 + (50 * docs.column("n").to_numpy() * n_docs) // max(n_terms, 1)
        self.weight = weight
        lists = docs.column("terms").combine_chunks()
        term, tf = lists.flatten().to_numpy(), docs.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        gains = impacts(weight[term], tf, self.m[doc])
        cuts = np.flatnonzero(np.diff(term, prepend=-1, append=len(weight)))
        self.lists = {int(term[a]): PostingList(doc[a:b], tf[a:b], gains[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}

    def _gains(self, term: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, tfs = self.lists[term].read(blocks)
        return docs, impacts(self.weight[term], tfs, self.m[docs])

    def search(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best documents."""
        terms = sorted((t for t in terms if t in self.lists and self.lists[t].bound > 0), key=lambda t: (self.lists[t].bound, t))
        below = np.cumsum([0, *(self.lists[t].bound for t in terms)])  # below[i]: all that the first i lists can add
        best, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
        low = 0
        while low < len(self.ids) and terms:
            high = low + (RANGE if low else FIRST)
            # Later documents lose ties, so a candidate has to pass the k-th best score.
            essential = int(np.searchsorted(below, least, "right")) - 1
            if essential >= len(terms):
                break
            total, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
            for t in terms[essential:]:
                blocks = self.lists[t].within(low, high)
                if len(blocks):
                    docs, gains = self._gains(t, blocks)
                    inside = (docs >= low) & (docs < high)
                    total[docs[inside] - low] += gains[inside]  # a document is once in a list
                    seen[docs[inside] - low] = True
            docs = np.flatnonzero(seen & (total + below[essential] > least))
            total, docs = total[docs], docs + low
            for i in range(essential - 1, -1, -1):
                if not len(docs):
                    break
                found = self.lists[terms[i]]
                block = np.minimum(np.searchsorted(found.last, docs), len(found.last) - 1)
                there = (found.first[block] <= docs) & (docs <= found.last[block])
                stays = total + np.where(there, found.most[block], 0) + below[i] > least
                docs, total, block, there = docs[stays], total[stays], block[stays], there[stays]
                if there.any():
                    have, gains = self._gains(terms[i], np.unique(block[there]))
                    at = np.minimum(np.searchsorted(have, docs), len(have) - 1)
                    total = total + np.where(have[at] == docs, gains[at], 0)
            best, scores = np.concatenate([best, docs[total > least]]), np.concatenate([scores, total[total > least]])
            if len(best) > k:
                top = np.lexsort((best, -scores))[:k]
                best, scores = best[top], scores[top]
            if len(best) == k:
                least = int(scores.min())
            low = high
        return best, scores


def _search(items: list[tuple], kind: pa.DataType, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The heap of each item (id, term numbers) over each shard of a task."""

    def run(shard: Shard) -> Iterator[pa.RecordBatch]:
        names, docs, scores = [], [], []
        for name, terms in items:
            at, found = shard.search(terms, k)
            names.extend([name] * len(at))
            docs.append(at)
            scores.append(found)
        at = np.concatenate([np.empty(0, np.int64), *docs])
        found = pa.array(np.concatenate([np.empty(0, np.int64), *scores]))
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), shard.ids.take(pa.array(at)), found], ["item_id", "doc_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, postings = rows + batch.num_rows, postings + len(batch.column("terms").flatten())
            if rows >= SHARD or postings >= POSTINGS:
                yield from run(Shard(pa.Table.from_batches(held), weight, n_docs, n_terms))
                held, rows, postings = [], 0, 0
        if held:
            yield from run(Shard(pa.Table.from_batches(held), weight, n_docs, n_terms))

    return search


def _item_terms(items: pa.Table) -> tuple[list[tuple], list[bytes]]:
    """(id, term numbers) of each item, ids once, and the terms."""
    known: dict[bytes, int] = {}
    asked: dict = {}
    for batch in items.to_batches():
        data, starts, ends, first = text_terms(batch.column("text"))
        whole = data.tobytes()
        for r, name in enumerate(batch.column("item_id").to_pylist()):
            found = asked.setdefault(name, set())
            for a, b in zip(starts[first[r] : first[r + 1]].tolist(), ends[first[r] : first[r + 1]].tolist(), strict=True):
                found.add(known.setdefault(whole[a:b], len(known)))
    return [(name, sorted(terms)) for name, terms in asked.items()], list(known)


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item, with a score above 0."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession, "lexical-search")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    items = items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    heap = f"item_id {kinds[1]}, doc_id {kinds[0]}, score bigint"
    groups = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes
    heaps = []
    for g in range(groups):
        asked, terms = _item_terms(items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow())
        if not terms:
            continue
        index = docs.mapInArrow(_count_terms(Vocabulary(terms)), f"doc_id {kinds[0]}, n bigint, terms array<int>, tfs array<int>")
        index = stored(index, f"index-{g}")
        total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = index.select("terms").mapInArrow(_count_holding(len(terms)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        holding = np.zeros(len(terms), np.int64)
        for row in counted.collect():  # at most one row for each term of the group
            holding[row["term"]] = row["df"]
        kind = pa.int64() if kinds[1] == "bigint" else items.where("false").toArrow().schema.field("item_id").type
        search = _search(asked, kind, weights(total[0], holding), total[0], total[1], k)
        heaps.append(stored(index.where("n > 0").mapInArrow(search, heap), f"heaps-{g}"))
    if not heaps:
        return spark.createDataFrame([], heap).selectExpr("item_id", "0 AS rank", "doc_id", "score")
    found = heaps[0]
    for more in heaps[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
