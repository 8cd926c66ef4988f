"""BPE encoding and decoding.

A word's symbols form a doubly linked list; every adjacent pair that the vocabulary can merge waits in a priority queue by
rank of its merge, then by place. The best entry is taken, entries whose symbols have changed since are skipped, and the
merged symbol meets its new neighbours. Decoding joins the vocabulary strings of the ids.

The vocabulary file is in the tokenizers library's JSON form, for tokenizers that compose characters (NFC), lower-case,
drop white space, split words by a pattern and mark word ends. Words met before are looked up; the memory of them is
bounded and never changes a result.

Edge cases: null and empty texts have no ids and decode to "". A special token's string in a text becomes that token.
Null ids, repeated rows and empty tables need nothing special; texts are encoded whole. Input columns named like the
output column are replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinmatch.llm.flat import slices, worker_cache
from kinmatch.llm.packing import byte_letters
from kinmatch.llm.tokens import ChunkEncoder

# Fixed values of the vocabulary files: Unicode white space, and the word pattern over it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{WHITE}\\p{{L}}\\p{{N}}]+"


class Bpe(ChunkEncoder):
    """Encoder and decoder of one vocabulary file."""

    #: Words remembered beside the chunks, which are single words mostly and are remembered as such.
    WORDS_LIMIT = 100_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        model = saved["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = {b: c for c, b in byte_letters().items()}
        self.first = [vocabulary.get(letters[b]) for b in range(256)]
        self.last = [vocabulary.get(letters[b] + self.suffix) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.ids = {t["content"]: t["id"] for t in saved["added_tokens"]}
        self.special = list(self.ids)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        strings = {i: s for s, i in (vocabulary | self.ids).items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.words = regex.compile(WORDS)
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, tuple[int, ...]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges."""
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        ids: list[int | None] = list(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i]
            # Stale: the left symbol was merged away, or one of the two is no longer what it was.
            if ids[i] is None or j < 0 or merges.get((ids[i], ids[j])) != (rank, made):
                continue
            ids[i], ids[j] = made, None
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                found = merges.get((made, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], made))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [x for x in ids if x is not None]

    def word(self, word: str, remember: bool = True) -> tuple[int, ...]:
        """Ids of one word of the pattern."""
        found = self.known_words.get(word)
        if found is None:
            data = word.encode()
            symbols = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
            found = tuple(self.merge([s for s in symbols if s is not None]))
            if remember and len(self.known_words) < self.WORDS_LIMIT and len(word) <= self.LONGEST:
                self.known_words[word] = found
        return found

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        # Character by character: the final sigma has no rule of its own here.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        found = self.words.findall(text)
        return [i for w in found for i in self.word(w, len(found) > 1)]

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        return {c: np.array(self.plain(c), np.uint32).tobytes() for c in chunks}

    def _whole(self, text: str) -> list[int]:
        parts = self.parts.split(text) if self.parts else [text]
        return [i for p in parts if p for i in ([self.ids[p]] if p in self.ids else self.plain(p))]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def bpe(path: str) -> Bpe:
    cache = worker_cache()
    key = f"bpe {path}"
    if key not in cache:
        cache[key] = Bpe(path)
    return cache[key]


def _id_lists(coder: Bpe, texts: pa.Array) -> pa.ListArray:
    found = coder.encode(texts.fill_null("").to_pylist())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _texts(coder: Bpe, ids: pa.Array) -> pa.Array:
    return pa.array([coder.decode(x) if x else "" for x in ids.to_pylist()], pa.string())


def _mapped(docs: DataFrame, keep: list[str], made: dict[str, T.DataType], pieces, columns) -> DataFrame:
    """The kept columns with those that `columns` makes of each piece of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns(batch)], [*keep, *made])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(*m) for m in made.items()]]))


_IDS = T.ArrayType(T.IntegerType())


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with the ids of each text."""
    keep = [c for c in docs.columns if c != out]
    return _mapped(docs, keep, {out: _IDS}, lambda b: slices(b, text), lambda b: [_id_lists(bpe(path), b.column(text))])


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded", rows: int = 500) -> DataFrame:
    """The rows with the text of their ids; null ids decode to ""."""
    keep = [c for c in docs.columns if c != out]
    pieces = lambda batches: (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
    return _mapped(docs, keep, {out: T.StringType()}, pieces, lambda b: [_texts(bpe(path), b.column(ids))])


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the ids of each text and the text of these ids in place of the text, by one Python worker for each core."""
    keep = [c for c in docs.columns if c not in (text, ids, decoded)]

    def both(batch: pa.RecordBatch) -> list[pa.Array]:
        found = _id_lists(bpe(path), batch.column(text))
        return [found, _texts(bpe(path), found)]

    return _mapped(docs, keep, {ids: _IDS, decoded: T.StringType()}, lambda b: slices(b, text), both)
