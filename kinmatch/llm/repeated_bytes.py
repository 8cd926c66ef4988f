"""Exact removal of repeated byte strings, by a sorted array of sampled suffixes.

A string of LENGTH bytes that also starts earlier (smaller id, or same document and earlier start) is a repeat; every byte
that a repeat covers is removed. Strings are judged on the input, never across documents. Documents are UTF-8 bytes.

Sorting the suffix of every byte would move LENGTH bytes for each byte of text. So suffixes are sampled by their content:
in each window of LENGTH bytes the least GRAM-byte hash is an anchor, and equal strings have equal anchors in them. Only
suffixes at anchors are sorted, about one in forty.

1. Texts are written to the shared scratch folder as they are read, one folder for each task, with row numbers; later
   steps bring their small rows to the task that reads that folder, so that texts are never shuffled. Documents that
   equal an earlier one are settled here: all their bytes go, if there are LENGTH of them.
2. Anchors get a key, the suffix's leading bytes followed by a hash of its GRAM bytes. Splitters, quantiles of the keys
   of a bounded sample of documents (SAMPLE), range-partition them; each bucket sorts its keys and keeps those that
   occur twice. Equal keys never part, so no boundary runs through a group.
3. Kept anchors fetch their surroundings, LENGTH - GRAM bytes before and LENGTH after, and are partitioned again by the
   splitters. A bucket sorts each window around its anchors, window by window, and sees which has an earlier equal; the
   windows of one anchor overlap, so what they cover is one span. Windows are compared as 64-bit hashes within a group.
4. A key that more than GROUP anchors share gives one row for each window instead, keyed by the window's hash and spread
   over all buckets. A task sends on only a window's earliest row of a slice, and none if it sent an earlier one before (SEEN
   windows are remembered); the others are settled at once, as spans of all that they cover. So a passage of a third of
   all documents needs neither a large group nor a large task, and no row for each of its windows.
5. Spans meet their texts, overlaps are merged, and what is left is put together.

Edge cases: null and empty texts have no bytes and lose none; a text under LENGTH bytes loses none. A null id comes last.
Rows with equal id and text are one document: none is earlier than the other. Extra columns are ignored. An empty table
gives an empty result. Kept bytes may cut a character, so they are binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.flat import U, flat_text, mix, slices
from kinmatch.llm.parts import by_part, read_part, to_parts, write_parts
from kinmatch.session import scratch_folder

LENGTH = 100
GRAM = 16
BEFORE = LENGTH - GRAM
CONTEXT = BEFORE + LENGTH
GROUP = 1000
SAMPLE = 2000
#: Slices of about so many bytes of text, and pieces of so many contexts: both bound the memory of a task.
SLICE = 1 << 20
PIECE = 5_000
#: Windows that a task remembers to have sent on.
SEEN = 1 << 18
LAST = (1 << 63) - 1
_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of every `width` consecutive values (best: np.minimum or np.maximum), by blocks."""
    n = len(values)
    filler = np.iinfo(np.uint64).max if best is np.minimum else 0
    rows = np.concatenate([values, np.full(-n % width, filler, U)]).reshape(-1, width)
    left = best.accumulate(rows, axis=1).ravel()
    right = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in a flat buffer of texts and their keys."""
    n, width = len(data), BEFORE + 1
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers(_P, n), out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * _powers(_P_INV, n - GRAM + 1))
    least = _slide(grams, width, np.minimum)  # of the window that starts at each place
    # Windows that run over the end of a text count for nothing.
    ends = np.repeat(offsets[1:], np.diff(offsets))
    least[np.arange(len(least)) + LENGTH > ends[: len(least)]] = 0
    pad = np.zeros(width - 1, U)
    greatest = _slide(np.concatenate([pad, least, pad]), width, np.maximum)  # over the windows that hold the gram
    at = np.flatnonzero((grams <= greatest) & (greatest > 0))
    lead = np.zeros(len(at), U)
    for k in range(4):
        lead = (lead << U(8)) | data[at + k].astype(U)
    keys = ((lead << U(32)) | (grams[at] >> U(32))) ^ U(1 << 63)  # signed order is the order of leading bytes
    return at, keys.view(np.int64)


def _find_anchors(folder: str, splitters: list[int]):
    cuts = np.array(splitters, np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            wanted = rows.column("uid").combine_chunks()
            for batch in slices(read_part(folder, part, ["uid", "text"]), "text", SLICE):
                batch = batch.filter(pc.is_in(batch.column("uid"), wanted))
                if not batch.num_rows:
                    continue
                data, offsets = flat_text(batch.column("text"))
                at, keys = anchors(data, offsets)
                row = np.searchsorted(offsets, at, "right") - 1
                made = {"key": keys, "uid": batch.column("uid").to_numpy()[row], "pos": (at - offsets[row]).astype(np.int32)}
                made["bucket"] = np.searchsorted(cuts, keys, "right").astype(np.int32)
                yield pa.RecordBatch.from_pydict(made)

    return find


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those whose key the row before or after has too."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        same = part.column("key").to_numpy()
        same = same[1:] == same[:-1]
        # The last row waits for the next batch; whether the one before it has its key is kept by sending both.
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if held is not None and held.num_rows == 2:
            shared[0] = False  # was sent before
        last = 2 if len(same) and same[-1] else 1
        if last == 2:
            shared[-1] = False
            if held is not None and held.num_rows == 2 and len(shared) == 2:
                shared[0] = False
        yield from part.filter(pa.array(shared)).to_batches()
        held = part.slice(part.num_rows - last)
    if held is not None and held.num_rows == 2:
        yield from held.slice(1).to_batches()


def _window_hashes(context: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each number of bytes before the anchor, the hashes of the windows that start there."""
    sums = np.zeros((len(context), CONTEXT + 1), U)
    np.cumsum((context.astype(U) + U(1)) * _powers(_P, CONTEXT), axis=1, out=sums[:, 1:])
    back = _powers(_P_INV, CONTEXT)
    for before in range(BEFORE + 1):
        a = BEFORE - before
        yield before, mix((sums[:, a + LENGTH] - sums[:, a]) * back[a])


def _fetch_contexts(folder: str, splitters: list[int], buckets: int):
    cuts = np.array(splitters, np.int64)
    names = ["bucket", "key", "ord", "uid", "pos", "low", "high", "context", "settled"]

    def rows_of(key, order, uid, pos, low, high, context, settled, bucket) -> pa.RecordBatch:
        n = len(key)
        raw = pa.array([None] * n, pa.binary()) if context is None else pa.array([x.tobytes() for x in context], pa.binary())
        made = [bucket.astype(np.int32), key, order, uid, pos.astype(np.int32), low.astype(np.int32), high.astype(np.int32)]
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in made], raw, pa.array(np.full(n, settled))], names)

    def hot_windows(batch, data, offsets, at, low, high, seen) -> Iterator[pa.RecordBatch]:
        """Rows of the windows around anchors of hot keys: what repeats is settled here, and what may be first is sent on."""
        edges = np.zeros(len(data) + 1, np.int64)
        fits = low <= high
        np.add.at(edges, (at - high)[fits], 1)
        np.add.at(edges, (at - low)[fits] + 1, -1)
        starts = np.flatnonzero(np.cumsum(edges) > 0)
        if not len(starts):
            return
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _powers(_P, len(data)), out=sums[1:])
        window = mix((sums[starts + LENGTH] - sums[starts]) * _powers(_P_INV, len(data))[starts]).view(np.int64)
        row = np.searchsorted(offsets, starts, "right") - 1
        order, uid, first = batch.column("ord").to_numpy()[row], batch.column("uid").to_numpy()[row], starts - offsets[row]
        by = np.argsort(order, kind="stable")  # starts come by uid and place
        by = by[np.argsort(window[by], kind="stable")]
        window, order, uid, first, starts, row = (x[by] for x in (window, order, uid, first, starts, row))
        later = np.concatenate([[False], window[1:] == window[:-1]])
        heads = np.flatnonzero(~later)
        head = heads[np.cumsum(~later) - 1]
        same = later & (order == order[head]) & (first == first[head])
        # Sent on: the earliest row of each window, and its twins under one id and text.
        go = (~later | same) & ~seen.earlier(window[heads], order[heads], first[heads])[np.cumsum(~later) - 1]
        zero = np.zeros(int(go.sum()), np.int32)
        bucket = (window[go].view(U) % U(buckets)).astype(np.int32)
        yield rows_of(window[go], order[go], uid[go], first[go], zero, zero, None, False, bucket)
        if not go.all():
            by = np.flatnonzero(~go)
            by = by[np.argsort(starts[by])]
            apart = (np.diff(starts[by]) > LENGTH) | (np.diff(row[by]) != 0)
            a, b = by[np.concatenate([[True], apart])], by[np.concatenate([apart, [True]])]
            bucket = (mix(uid[a].astype(U)) % U(buckets)).astype(np.int32)
            zero = np.zeros(len(a), np.int32)
            yield rows_of(window[a], order[a], uid[a], first[a], zero, first[b] + LENGTH - first[a], None, True, bucket)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for part, rows in by_part(batches):
            uids, places = rows.column("uid").to_numpy(), rows.column("pos").to_numpy()
            keys, hot = rows.column("key").to_numpy(), rows.column("hot").to_numpy(zero_copy_only=False)
            for batch in slices(read_part(folder, part, ["uid", "ord", "text"]), "text", SLICE):
                own = batch.column("uid").to_numpy()
                mine = np.arange(np.searchsorted(uids, own[0], "left"), np.searchsorted(uids, own[-1], "right"))
                if not len(mine):
                    continue
                data, offsets = flat_text(batch.column("text"))

                def around(some):
                    row = np.searchsorted(own, uids[some])
                    start, end = offsets[row], offsets[row + 1]
                    at = start + places[some]
                    # Windows start `low` to `high` bytes before the anchor.
                    return row, start, end, at, np.maximum(0, LENGTH - (end - at)), np.minimum(BEFORE, at - start)

                many, mine = mine[hot[mine]], mine[~hot[mine]]
                if len(many):
                    yield from hot_windows(batch, data, offsets, *around(many)[3:], seen)
                for i in range(0, len(mine), PIECE):
                    some = mine[i : i + PIECE]
                    row, start, end, at, low, high = around(some)
                    index = at[:, None] + np.arange(-BEFORE, LENGTH)
                    inside = (index >= start[:, None]) & (index < end[:, None])
                    context = np.where(inside, data[np.clip(index, 0, len(data) - 1)], 0).astype(np.uint8)
                    bucket = np.searchsorted(cuts, keys[some], "right")
                    yield rows_of(keys[some], batch.column("ord").to_numpy()[row], uids[some], places[some], low, high, context, False, bucket)

    return fetch


class _Seen:
    """The earliest row (order, place) of the windows that a task sent on; beyond SEEN those that came up last."""

    def __init__(self) -> None:
        self.window, self.order, self.first = (np.empty(0, np.int64) for _ in range(3))

    def earlier(self, window: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a row before was earlier; what was not is remembered. Windows come sorted and once each."""
        at = np.searchsorted(self.window, window)
        known = np.zeros(len(window), bool)
        there = at < len(self.window)
        known[there] = self.window[at[there]] == window[there]
        out, k = np.zeros(len(window), bool), at[known]
        out[known] = (self.order[k] < order[known]) | ((self.order[k] == order[known]) & (self.first[k] < first[known]))
        less = known & ~out
        self.order[at[less]], self.first[at[less]] = order[less], first[less]
        new = ~known
        if len(self.window) + new.sum() > SEEN:
            kept = at[known]
            self.window, self.order, self.first = self.window[kept], self.order[kept], self.first[kept]
            at = np.searchsorted(self.window, window)
        self.window = np.insert(self.window, at[new], window[new])
        self.order = np.insert(self.order, at[new], order[new])
        self.first = np.insert(self.first, at[new], first[new])
        return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that repeats cover. Rows come sorted by key, then by document and place; a key with contexts has a bounded
    number of rows. For keys that are windows only the first row is remembered from batch to batch."""

    def spans(uid, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["uid", "a", "b"])

    def grouped(part: pa.Table) -> pa.RecordBatch:
        key, order = part.column("key").to_numpy().view(U), part.column("ord").to_numpy()
        pos, low, high = (part.column(c).to_numpy().astype(np.int64) for c in ("pos", "low", "high"))
        context = np.frombuffer(b"".join(part.column("context").to_pylist()), np.uint8).reshape(-1, CONTEXT)
        group = mix(key)
        least, most = np.full(len(key), CONTEXT), np.full(len(key), -1)
        for before, h in _window_hashes(context):
            fits = np.flatnonzero((low <= before) & (before <= high))
            if not len(fits):
                continue
            h = (h ^ group)[fits]
            sort = np.argsort(h, kind="stable")  # keeps the order by document and place
            h, who = h[sort], fits[sort]
            later = np.concatenate([[False], h[1:] == h[:-1]])
            head = np.maximum.accumulate(np.where(later, 0, np.arange(len(later))))
            later &= (order[who] != order[who[head]]) | (pos[who] != pos[who[head]])
            hit = who[later]
            least[hit] = np.minimum(least[hit], before)
            most[hit] = np.maximum(most[hit], before)
        hit = most >= 0
        return spans(part.column("uid").to_numpy()[hit], pos[hit] - most[hit], pos[hit] - least[hit] + LENGTH)

    held, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        window = batch.column("context").is_null().to_numpy(zero_copy_only=False)
        if settled.any():
            done = batch.filter(pa.array(settled))
            pos = done.column("pos").to_numpy()
            yield spans(done.column("uid").to_numpy(), pos, pos + done.column("high").to_numpy())
        if (window & ~settled).any():
            rows = batch.filter(pa.array(window & ~settled))
            key, order, pos = (rows.column(c).to_numpy() for c in ("key", "ord", "pos"))
            later = np.concatenate([[False], key[1:] == key[:-1]])
            head = np.maximum.accumulate(np.where(later, 0, np.arange(len(key))))
            head_order, head_pos = order[head].copy(), pos[head].copy()
            if first is not None and first[0] == key[0]:
                run = key == key[0]
                later |= run
                head_order[run], head_pos[run] = first[1], first[2]
            later &= (order != head_order) | (pos != head_pos)
            first = (key[-1], head_order[-1], head_pos[-1])
            yield spans(rows.column("uid").to_numpy()[later], pos[later], pos[later] + LENGTH)
        if (~window).any():
            part = pa.Table.from_batches([batch.filter(pa.array(~window))])
            part = part if held is None else pa.concat_tables([held, part])
            key = part.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                for i in _cuts(key[:cut]):
                    yield grouped(part.slice(*i))
            held = part.slice(cut)
    if held is not None and held.num_rows:
        yield grouped(held)


def _cuts(key: np.ndarray, rows: int = PIECE) -> Iterator[tuple[int, int]]:
    """(start, length) of pieces of about `rows` rows that part no key."""
    start = 0
    while start < len(key):
        end = min(start + rows, len(key))
        end = int(np.searchsorted(key, key[end - 1], "right"))
        yield start, end - start
        start = end


def _cut_texts(folder: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            uids, a, b = (rows.column(c).to_numpy() for c in ("uid", "a", "b"))
            for batch in slices(read_part(folder, part, ["uid", "doc_id", "text"]), "text"):
                data, offsets = flat_text(batch.column("text"))
                own = batch.column("uid").to_numpy()
                first, last = np.searchsorted(uids, own, "left"), np.searchsorted(uids, own, "right")
                removed, spans, kept = [], [], []
                for row, (x, y) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                    text, runs, at, left = data[offsets[row] : offsets[row + 1]], 0, 0, []
                    n, reach = len(text), -1
                    for s, e in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True):
                        e = min(e, n)
                        if e <= s:
                            continue  # the row that every document has, or nothing to cut
                        if s > reach:
                            runs += 1
                            left.append(text[at:s])
                            at = reach = e
                        elif e > reach:
                            at = reach = e
                    left.append(text[at:])
                    whole = b"".join([p.tobytes() for p in left])
                    removed.append(n - len(whole))
                    spans.append(runs)
                    kept.append(whole)
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return cut


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and kept (binary)."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession, "repeats")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = f"{folder}/texts"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    base = base.withColumn("ord", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
    base = base.withColumns({"n": F.octet_length("text").cast("int"), "digest": F.unhex(F.md5(F.col("text").cast("binary")))})
    narrow = write_parts(base, texts).select("uid", "ord", "n", "digest")

    first = stored(narrow.where(F.col("n") >= LENGTH).groupBy("digest").agg(F.count("*").alias("c"), F.min("ord").alias("first")).where("c > 1").select("digest", "first"), "first")
    state = stored(narrow.join(first, "digest", "left").select("uid", "n", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)).alias("copy")), "state")
    fresh = state.where(~F.col("copy") & (F.col("n") >= LENGTH)).select("uid")

    shape = "key bigint, uid bigint, pos int, bucket int"
    sample = fresh.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE)
    keys = to_parts(sample).mapInArrow(_find_anchors(texts, []), shape)
    shares = [k / buckets for k in range(1, buckets)]
    splitters = sorted(set(keys.agg(F.percentile("key", F.array(*map(F.lit, shares)))).first()[0] or [])) if shares else []
    splitters = [int(x) for x in splitters]

    found = to_parts(fresh).mapInArrow(_find_anchors(texts, splitters), shape)
    found = found.repartitionById(buckets, F.col("bucket")).drop("bucket").sortWithinPartitions("key")
    shared = stored(found.mapInArrow(_keep_shared, "key bigint, uid bigint, pos int"), "shared")
    hot = stored(shared.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("key", F.lit(True).alias("hot")), "hot")
    shared = shared.join(hot, "key", "left").select("key", "uid", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))

    shape = "bucket int, key bigint, ord bigint, uid bigint, pos int, low int, high int, context binary, settled boolean"
    around = to_parts(shared, "pos").mapInArrow(_fetch_contexts(texts, splitters, buckets), shape)
    around = around.repartitionById(buckets, F.col("bucket")).drop("bucket").sortWithinPartitions("key", "ord", "pos", "uid")
    spans = stored(around.mapInArrow(_resolve, "uid bigint, a int, b int"), "spans")

    every = state.select("uid", F.lit(0).alias("a"), F.when(F.col("copy"), F.col("n")).otherwise(0).alias("b"))
    rows = to_parts(every.unionByName(spans), "a", "b")
    return rows.mapInArrow(_cut_texts(texts), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
