"""Best-fit packing of documents into sequences of a fixed number of tokens, bulk-synchronous.

A document is its ids and an end id. Only documents longer than a sequence are cut: into full pieces, the first piece
taking what is over. Pieces are then packed best-fit:

1. Pieces are range-sorted by length; each gets its rank among the pieces of its length, by counts per task and prefix
   sums over them. Pieces of one length are interchangeable, and so are sequences with one gap, so from here on runs
   (length, ranks) and (gap, sequence numbers) stand for rows: at most CAPACITY lengths, however many documents.
2. A round sweeps the lengths downwards and matches each run with its successor among the gaps, the smallest gap that
   holds it. Where more pieces want a gap than there are sequences with it, the lower ranks get it and the rest go to
   the next gap. Gaps are updated after the sweep, and the next round starts.
3. When nothing fits, the longest of the remaining pieces open new sequences: all pieces over half a sequence, or as many
   as the remaining tokens need.
4. The matched runs (a table that depends on CAPACITY only) are joined to the pieces by length and rank.

Only the counts by length reach the driver. The step that turns runs into rows is a join on the pieces in place.

Edge cases: null and empty texts are one end id. Null ids, equal ids and repeated rows are separate documents. An empty
table gives no sequence. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.flat import slices, worker_cache
from kinmatch.llm.tokens import crc32
from kinmatch.session import scratch_folder

CAPACITY = 1024
END_ID = 2
#: Written, not taken from a tokenizer library: letters, digits, other marks with an optional blank before, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteEncoder:
    """Ids of a byte-level vocabulary whose ids follow the order of its merges, as the file says."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        letters, vocabulary = byte_letters(), saved["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in saved["added_tokens"]}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in saved["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        self.plain = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids. Strings of special tokens become these, as the file's tokenizer has it."""
        allowed = {s for s in self.special if s in text}
        return self.plain.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype(np.uint32)


def byte_encoder(path: str) -> ByteEncoder:
    cache = worker_cache()
    key = f"bytes {path}"
    if key not in cache:
        cache[key] = ByteEncoder(path)
    return cache[key]


# ---- rounds -------------------------------------------------------------------------------------------

#: length, first rank, number of pieces, first sequence, place in the sequence.
Run = tuple[int, int, int, int, int]


def pack_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Matches runs of equal lengths with runs of sequences. counts: pieces by length."""
    left, rank = dict(counts), dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    runs: list[Run] = []
    opened = 0

    def take(length: int, n: int, first: int, gap: int) -> None:
        runs.append((length, rank[length], n, first, capacity - gap))
        rank[length] += n
        left[length] -= n

    while any(left.values()):
        # Sweep until no gap holds a remaining piece.
        while True:
            sizes, updated = sorted(gaps), []
            for length in sorted((x for x, n in left.items() if n), reverse=True):
                at = bisect.bisect_left(sizes, length)
                while left[length] and at < len(sizes):
                    gap = sizes[at]
                    first, n = gaps[gap].pop()
                    used = min(n, left[length])
                    take(length, used, first, gap)
                    updated.append((gap - length, first, used))
                    if used < n:
                        gaps[gap].append((first + used, n - used))
                    if not gaps[gap]:
                        del gaps[gap]
                        sizes.pop(at)
            for gap, first, n in updated:
                if gap:
                    gaps.setdefault(gap, []).append((first, n))
            if not updated:
                break
        # Open sequences for the longest pieces.
        rest = sorted((x for x, n in left.items() if n), reverse=True)
        if not rest:
            break
        need = -(-sum(x * left[x] for x in rest) // capacity)
        large = sum(left[x] for x in rest if 2 * x > capacity)
        new = large or need
        for length in rest:
            n = min(new, left[length])
            if not n:
                break
            take(length, n, opened, capacity)
            if length < capacity:
                gaps.setdefault(capacity - length, []).append((opened, n))
            opened, new = opened + n, new - n
    return runs


# ---- operator -----------------------------------------------------------------------------------------


def _piece_writer(path: str, capacity: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_encoder(path), np.array([end_id], np.uint32)
        place, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, at, row = batch.column("doc_id"), [], {k: [] for k in ("piece", "start", "length", "ids_crc32")}
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = np.concatenate([encoder.encode(text), end]) if text else end
                cuts = [0, *range(len(found) % capacity or capacity, len(found) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    at.append(k)
                    for name, v in zip(row, (piece, a, b - a, crc32(found[a:b])), strict=True):
                        row[name].append(v)
            uid = np.arange(number, number + len(at), dtype=np.int64) + (place << 40)
            number += len(at)
            made = [pa.array(row["piece"], pa.int32())] + [pa.array(row[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([pa.array(uid), ids.take(pa.array(at, pa.int64())), *made], ["uid", "doc_id", *row])

    return pieces


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank of each piece among those of its length in this task; rows come sorted by length."""
    place, last, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        starts = np.flatnonzero(np.concatenate([[length[0] != last], length[1:] != length[:-1]]))
        nth = np.arange(len(length), dtype=np.int64)
        begun = np.full(len(length), -seen, np.int64)
        for a in starts.tolist():
            begun[a:] = a
        nth = nth - begun
        last, seen = length[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("length"), pa.array(np.full(len(length), place, np.int32)), pa.array(nth)], ["uid", "length", "place", "nth"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession, "packing")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    plain = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    shape = f"uid bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stored(plain.mapInArrow(_piece_writer(path, capacity, end_id), shape), "pieces")

    # The hash in the range key parts a length that very many pieces share.
    ordered = pieces.select("uid", "length").repartitionByRange("length", F.xxhash64("uid")).sortWithinPartitions("length", "uid")
    ranked = stored(ordered.mapInArrow(_number, "uid bigint, length bigint, place int, nth bigint"), "ranked")
    shares = ranked.groupBy("length", "place").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.select("length", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(pack_runs(counts, capacity), "length bigint, first bigint, n bigint, sequence bigint, offset bigint")
    rank = ranked.join(F.broadcast(bases), ["length", "place"]).select("uid", "length", (F.col("base") + F.col("nth")).alias("rank"))
    # Both broadcast tables are bounded: a length has at most one row for each task, and runs depend on the capacity.
    placed = rank.join(F.broadcast(runs), "length").where("rank >= first AND rank < first + n")
    placed = placed.select("uid", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the corpus pipeline: the pieces of all documents and their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
