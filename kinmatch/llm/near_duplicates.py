"""MinHash near-deduplication: set similarity join by chosen paths (Christiani, Pagh and Sivertsen's scheme).

A document's set holds its distinct five-word shingles; two documents are linked if the Jaccard similarity of their
sets is at least 0.75. Documents of equal sets form a class, and only one text per class takes part below.

1. One pass over the texts gives every class the smallest of its shingles under HASHES hash functions (minwise tokens).
2. Trees: at a node, every class follows CHOSEN minwise tokens, picked by a hash of the path, to child nodes named by
   path and token. Similar classes choose the same tokens, and the two chosen at a node make a pair at the threshold
   follow each other with a chance of 0.94, at any depth with 0.89 or more; TREES independent trees miss it with a
   chance of 2e-5.
3. A node of at most LEAF classes is a leaf and is compared exhaustively, by minwise tokens. A larger node picks PIVOTS
   classes, compares all others with them, and branches on without the classes that nearly equal a pivot: these would
   stay together for ever. What left is remembered, and what lies near a pivot without such nearness (the ring), since
   classes that left may be linked to each other and to the ring.
4. Candidates (estimate at least CANDIDATE) are confirmed on whole sets, taken from whole texts, in two turns. First every
   leaf gives a spanning forest of its candidates, best first, and pivots give theirs: a handful for each class, however
   large its group. Texts are kept by the task that read them (parts.py), and only those of candidates are moved. Components
   follow from confirmed links. Then leaves, and the classes that left a node with each other and with its ring, are
   compared again, in blocks, for candidates between different components. Classes that have one meet once more with their
   sets, by 32 bits of each shingle, and pairs near by these are confirmed on whole sets. So no link that joins two
   components is lost, and neither pairs inside a component nor the many candidates that are no links are ever listed.

Every level, candidate set and confirmed link table is written to the shared scratch folder. Nothing is collected. Many of
these tables are small, so what shuffles deal out is worked off by as many tasks as the documents call for (SHARE), each
taking several partitions one after another: with many shuffle partitions, the time would go into tasks and files.

Edge cases: null and empty texts and texts of white space have an empty set and are linked with nothing; fewer than
five words are one shingle. Repeated rows are equal sets. Rows under one id are judged by their texts, each on its own.
A null id never names a component: where only null ids are linked, the component is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinmatch.llm.flat import LOWER, U, flat_text, mix, slices, span_hashes, words
from kinmatch.llm.parts import by_part, read_part, to_parts, write_parts
from kinmatch.session import scratch_folder

SHINGLE = 5
NUM, DEN = 75, 100  # linked: DEN * intersection >= NUM * union
HASHES = 256
BRANCHING = 128  # of these may be chosen as branches; estimates use one byte of all
TREES = 5
CHOSEN = 2
LEAF = 1000
PIVOTS = 3
#: Estimates from HASHES tokens have a standard deviation of 0.027 at 0.75: candidates are taken from three below.
CANDIDATE = 0.67
#: A class leaves a large node if it looks like a pivot by so much; RING: 1 - 2 * (1 - 0.75) less the error of estimates.
LEAVE, RING = 0.78, 0.38
BLOCK = 256
#: Sets known by 32 bits of each shingle are held to a share that is so many hundredths lower, since hashes may be equal by chance.
ROUGH = 1
#: Words of a task, and the words that a document counts for at least.
SHARE, LEAST_WORDS = 5_000_000, 1000

_SHINGLE_FACTORS = mix(np.arange(1, SHINGLE + 1, dtype=U)) | U(1)
_A, _B = mix(np.arange(1000, 1000 + HASHES, dtype=U)) | U(1), mix(np.arange(5000, 5000 + HASHES, dtype=U))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words parted by ASCII white space."""
    data, offsets = flat_text(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    w = span_hashes(data, starts, ends)
    n = len(w)
    padded = np.concatenate([w, np.zeros(SHINGLE, U)])
    hashes = np.zeros(n, U)
    for k in range(SHINGLE):
        hashes += padded[k : k + n] * _SHINGLE_FACTORS[k]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(mix(hashes[a : b - SHINGLE + 1])))
        elif b > a:
            whole = (w[a:b] * _SHINGLE_FACTORS[: b - a]).sum(dtype=U, keepdims=True)
            out.append(mix(mix(whole) + U(b - a)))
        else:
            out.append(np.empty(0, U))
    return out


def class_key(shingles: np.ndarray) -> str:
    """128 bits of a set."""
    a, b = mix(shingles).sum(dtype=U), mix(shingles ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
    return f"{int(a):016x}{int(b):016x}"


def signature(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """HASHES minwise tokens of a set that is not empty."""
    low = None
    for i in range(0, len(shingles), block):
        part = (shingles[i : i + block, None] * _A + _B).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return (low >> U(32)).astype(np.uint32)


def children(nodes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Child nodes, CHOSEN for each row. tokens: the signatures, a row for each node."""
    out, rows, taken = [], np.arange(len(nodes)), None
    for r in range(CHOSEN):
        pick = mix(nodes + U(0x9E3779B97F4A7C15 * (r + 1) % 2**64))
        at = (pick % U(BRANCHING)).astype(np.int64) if r == 0 else (taken + 1 + (pick % U(BRANCHING - 1)).astype(np.int64)) % BRANCHING
        taken = at if r == 0 else taken
        out.append(mix(mix(nodes ^ (at.astype(U) << U(40))) + tokens[rows, at].astype(U)))
    return np.stack(out, axis=1)


def roots(trees: int = TREES) -> np.ndarray:
    return mix(np.arange(7_000, 7_000 + trees, dtype=U))


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    """An Arrow list column from a matrix of longs."""
    offsets = np.arange(0, len(values) * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(values).reshape(-1)))


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the shares of equal token bytes; one in 256 is equal by chance."""
    share = (a == b).mean(axis=-1)
    return (share - 1 / 256) / (1 - 1 / 256)


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = flat_text_binary(column)
    return data.reshape(len(column), -1)


def flat_text_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---- tasks --------------------------------------------------------------------------------------------


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Other columns pass through."""
    for batch in slices(batches, "text"):
        keys, counts, tokens, low = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            counts.append(len(s))
            keys.append(class_key(s) if len(s) else None)
            t = signature(s) if len(s) else None
            tokens.append(t[:BRANCHING].tobytes() if len(s) else None)
            low.append((t & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
        made = [pa.array(counts, pa.int64()), pa.array(keys, pa.string()), pa.array(tokens, pa.binary()), pa.array(low, pa.binary())]
        given = [c for c in batch.schema.names if c not in ("text", "part")]
        yield pa.RecordBatch.from_arrays([*map(batch.column, given), *made], [*given, "n_shingles", "cls", "tokens", "token_bytes"])


def _class_texts(folder: str):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            wanted, names = rows.column("uid").combine_chunks(), rows.column("cls").combine_chunks()
            for batch in read_part(folder, part, ["uid", "text"]):
                at = pc.index_in(batch.column("uid"), wanted)
                there = at.is_valid()
                yield pa.RecordBatch.from_arrays([names.take(at.filter(there)), batch.column("text").filter(there)], ["cls", "text"])

    return fetch


def _branch_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tokens = _matrix(batch.column("tokens")).view(np.uint32)
            nodes = np.concatenate([children(np.full(len(tokens), r, U), tokens) for r in roots()], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), _lists(nodes, nodes.shape[1])], ["cls", "nodes"])


def _forest(i: np.ndarray, j: np.ndarray, est: np.ndarray, n: int) -> list[int]:
    """Positions of the pairs that make a spanning forest of n members, best estimates first."""
    root, kept = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.argsort(-est, kind="stable").tolist():
        x, y = top(int(i[k])), top(int(j[k]))
        if x != y:
            root[y] = x
            kept.append(k)
            if len(kept) == n - 1:
                break
    return kept


def _candidates_in(part: pa.Table, split: bool) -> Iterator[tuple]:
    """For each cell its first row, its number of rows, and the candidates in it: positions i < j and estimates. With
    `split` only those whose groups differ and whose sides meet: side 0 meets all, 1 meets only 2, 2 only 1."""
    cell = part.column("cell").to_numpy()
    tokens = _matrix(part.column("token_bytes").combine_chunks())
    side, group = (part.column(c).to_numpy(zero_copy_only=False) for c in ("side", "group")) if split else (None, None)
    cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2 or (split and not (group[a:b] != group[a]).any()):
            continue
        i, j = np.triu_indices(b - a, 1)
        if split:
            s, g = side[a:b], group[a:b]
            meet = (g[i] != g[j]) & ((s[i] == 0) | (s[i] != s[j]))
            i, j = i[meet], j[meet]
        m = tokens[a:b]
        est = np.concatenate([np.empty(0), *(_estimates(m[i[k : k + 4096]], m[j[k : k + 4096]]) for k in range(0, len(i), 4096))])
        near = est >= CANDIDATE
        yield a, b - a, i[near], j[near], est[near]


def _forest_pairs(part: pa.Table) -> pa.RecordBatch:
    """(a, b, est) of a spanning forest of each cell's candidates."""
    names = part.column("cls").to_pylist()
    found = [(names[a + int(i[k])], names[a + int(j[k])], float(est[k])) for a, n, i, j, est in _candidates_in(part, False) for k in _forest(i, j, est, n)]
    columns = [pa.array([min(x, y) for x, y, _ in found], pa.string()), pa.array([max(x, y) for x, y, _ in found], pa.string()), pa.array([e for *_, e in found], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "est"])


def _meeting_rows(part: pa.Table) -> pa.RecordBatch:
    """The rows with a candidate of another group in their cell."""
    at = [np.unique(np.concatenate([i, j])) + a for a, _, i, j, _ in _candidates_in(part, True)]
    rows = part.select(["cell", "cls", "side", "group"]).take(pa.array(np.concatenate([np.empty(0, np.int64), *at])))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in rows.columns], rows.schema.names)


def _near_pairs(part: pa.Table) -> pa.RecordBatch:
    """(a, b) of each cell's candidates of different groups whose sets, by 32 bits of each shingle, are near."""
    names, sets = part.column("cls").to_pylist(), [np.frombuffer(x, np.uint32) for x in part.column("shingles").to_pylist()]
    found = []
    for a, _, i, j, _ in _candidates_in(part, True):
        for x, y in zip((i + a).tolist(), (j + a).tolist(), strict=True):
            one, two = sets[x], sets[y]
            if DEN * min(len(one), len(two)) < (NUM - ROUGH) * max(len(one), len(two)):
                continue
            both = len(np.intersect1d(one, two, assume_unique=True))
            if DEN * both >= (NUM - ROUGH) * (len(one) + len(two) - both):
                found.append((min(names[x], names[y]), max(names[x], names[y])))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], ["a", "b"])


def _each_cell(make):
    """`make` of all rows of some cells at a time. The rows of a cell come together, and a cell has a bounded number of rows;
    the last cell of a batch waits for the next. Cells need not ascend, as a task may take several partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cell = part.column("cell").to_numpy()
            other = np.flatnonzero(cell != cell[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield make(part.slice(0, cut))
            rest = part.slice(cut)
        if rest is not None:
            yield make(rest)

    return run


def _class_sets(folder: str):
    """(cls, shingles) of the classes asked for: 32 bits of each shingle's hash, sorted and distinct."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _class_texts(folder)(batches):
            for piece in slices(iter([batch]), "text"):
                sets = [np.unique((s >> U(32)).astype(np.uint32)).tobytes() for s in shingle_sets(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("cls"), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return fetch


def _meet_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, low = _matrix(batch.column("tokens")).view(np.uint32), _matrix(batch.column("token_bytes"))
        est = np.stack([_estimates(low, _matrix(batch.column(f"tokens_{k}"))) for k in range(PIVOTS)], axis=1)
        best = est.max(axis=1)
        nodes = children(batch.column("node").to_numpy().view(U), tokens)
        names = batch.column("cls").to_pylist()
        pivots = [batch.column(f"pivot_{k}").to_pylist() for k in range(PIVOTS)]
        leaves = best >= LEAVE
        links = [[{"b": pivots[k][r], "est": float(est[r, k])} for k in range(PIVOTS) if est[r, k] >= CANDIDATE and pivots[k][r] != c] for r, c in enumerate(names)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("cls"), pa.array(leaves), pa.array(~leaves & (best >= RING)), _lists(nodes, CHOSEN), pa.array(links, pa.list_(pa.struct([("b", pa.string()), ("est", pa.float64())])))],
            ["node", "cls", "leaves", "ring", "nodes", "links"],
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(slices(iter([batch]), "text_a"), "text_b"):
            one, two = shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b"))
            linked = []
            for x, y in zip(one, two, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(linked)), part.column("b").filter(pa.array(linked))], ["a", "b"])


# ---- operator -----------------------------------------------------------------------------------------


class _Store:
    """Tables in one scratch folder."""

    def __init__(self, spark) -> None:
        self.spark, self.folder, self.number = spark, scratch_folder(spark, "near-duplicates"), 0
        self.tasks = 0  # not known yet

    def plan(self, n_words: int) -> None:
        self.tasks = max(2 * self.spark.sparkContext.defaultParallelism, -(-n_words // SHARE))

    def few(self, df: DataFrame) -> DataFrame:
        """The same rows in as many partitions as the documents call for, or fewer. Partitions are put together whole."""
        return df.coalesce(self.tasks) if self.tasks else df

    def put(self, df: DataFrame, *digest: str, name: str = "", value: Column | None = None) -> tuple[DataFrame, int]:
        """The stored table and its number of rows, or a digest of the columns asked for, or `value`."""
        self.number += 1
        path, seen = f"{self.folder}/{name or self.number}", Observation()
        if value is None:
            value = F.sum(F.xxhash64(*digest).cast("decimal(38,0)")) if digest else F.count("*")
        self.few(df).observe(seen, value.alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def levels(self, name: str, like: DataFrame) -> DataFrame:
        """All tables stored as <name>/level=<number>, as one: a plan of the same size for any number of levels."""
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{name}")


def _cells(store: _Store, rows: DataFrame, known: DataFrame, make, shape: str) -> DataFrame:
    """What `make` gives for the cells of rows (cell, cls, ...), with the columns that `known` has for each class."""
    rows = rows.join(known, "cls").repartition("cell").sortWithinPartitions("cell", "cls")
    return store.few(rows).mapInArrow(_each_cell(make), shape)


def _candidates(store: _Store, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b, est): forests of leaves and links to pivots. The leaves (node, cls). What met pivots in large nodes."""
    spark = store.spark
    rows = classes.mapInArrow(_branch_roots, "cls string, nodes array<bigint>").select("cls", F.explode("nodes").alias("node"))
    slim = classes.select("cls", "tokens", "token_bytes")
    depth, level = 0, None
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        sizes, _ = store.put(sizes)  # stored, so that the join below shuffles both sides and a hot node can be split
        # Most of these rows are alone in their node: the names of classes travel as bytes.
        met_by = rows.select("node", F.unhex("cls").alias("cls")).join(sizes, "node").withColumn("cls", F.lower(F.hex("cls")))
        shared, _ = store.put(met_by, name=f"shared/level={depth}")
        # Stored apart, so that its size is known: while it is small, the tokens of all classes need not be shuffled for it.
        large, n_large = store.put(shared.where(F.col("n") > LEAF).select("node", F.unhex("cls").alias("cls")))
        if not n_large:
            break
        large = large.select("node", F.lower(F.hex("cls")).alias("cls"))
        # PIVOTS members of each node by the least of as many hashes; grouped minima combine before the shuffle.
        first = [F.min(F.struct(F.xxhash64("cls", "node", F.lit(k)).alias("h"), "cls"))["cls"].alias(f"pivot_{k}") for k in range(PIVOTS)]
        picked = large.groupBy("node").agg(*first)
        picked, _ = store.put(picked.select("node", F.posexplode(F.array(*[f"pivot_{k}" for k in range(PIVOTS)])).alias("k", "cls")))
        known = F.sort_array(F.collect_list(F.struct("k", "cls", "token_bytes"))).alias("known")
        pivots = picked.join(classes.select("cls", "token_bytes"), "cls").groupBy("node").agg(known)
        of = [F.col("known")[k][c].alias(f"{name}_{k}") for k in range(PIVOTS) for c, name in (("cls", "pivot"), ("token_bytes", "tokens"))]
        pivots, _ = store.put(pivots.select("node", *of))  # PIVOTS rows of each large node were joined once
        meeting = store.few(large.join(slim, "cls").join(pivots, "node"))
        shape = "node bigint, cls string, leaves boolean, ring boolean, nodes array<bigint>, links array<struct<b:string,est:double>>"
        level, _ = store.put(meeting.mapInArrow(_meet_pivots, shape), name=f"met/level={depth}")
        rows = level.where(~F.col("leaves")).select("cls", F.explode("nodes").alias("node"))
        depth += 1
    leaf = store.levels("shared", shared).where(F.col("n") <= LEAF).select("node", "cls")
    known = classes.select("cls", "token_bytes")
    pairs = _cells(store, leaf.select(F.col("node").alias("cell"), "cls"), known, _forest_pairs, "a string, b string, est double")
    if level is None:
        ring = spark.createDataFrame([], "node bigint, cls string, leaves boolean, ring boolean")
    else:
        met = store.levels("met", level)
        link = met.select("cls", F.explode("links").alias("l"))
        pairs = pairs.unionByName(link.select(F.least("cls", "l.b").alias("a"), F.greatest("cls", "l.b").alias("b"), F.col("l.est").alias("est")))
        ring = met.select("node", "cls", "leaves", "ring")
    return pairs.groupBy("a", "b").agg(F.max("est").alias("est")), leaf, ring


def _other_candidates(store: _Store, leaf: DataFrame, met: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that may link different components: in leaves, among what left a large node, and between that and the ring.

    The rows of a cell that have a candidate there meet once more, with their sets, so that only near pairs leave the cell."""
    group = F.xxhash64(F.coalesce("group", "cls")).alias("group")
    named, _ = store.put(leaf.join(groups, "cls", "left").select("node", "cls", group))
    # Leaves that lie in one component have nothing to compare.
    mixed = named.groupBy("node").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g != h").select("node")
    mixed, _ = store.put(mixed)
    rows = named.join(mixed, "node").select(F.col("node").alias("cell"), "cls", F.lit(0).alias("side"), "group")
    named, _ = store.put(met.where("leaves OR ring").join(groups, "cls", "left").select("node", "cls", "leaves", group))
    # The largest group of a node has nothing to compare inside; all that left and is of other groups (first) meets all.
    counts = named.groupBy("node", "group").agg(F.count_if("leaves").alias("n_left"), F.count("*").alias("n"))
    most = F.max(F.struct("n", "group", "n_left"))
    sizes = counts.groupBy("node").agg(most.alias("main"), F.sum("n").alias("n"), F.sum("n_left").alias("n_left"))
    first, main_left = F.col("n_left") - F.col("main.n_left"), F.col("main.n_left")
    ring = F.col("n") - F.col("main.n") - first
    blocks = [F.ceil(n / BLOCK).cast("int").alias(b) for n, b in ((first, "b_first"), (F.col("n") - first, "b_rest"), (main_left, "b_main"), (ring, "b_ring"))]
    sizes, n_sizes = store.put(sizes.where(F.col("n") > F.col("main.n")).select("node", F.col("main.group").alias("main"), *blocks))
    if n_sizes:
        # Each class in one block of its part, and that block in a cell with every block of each part that it meets.
        named = named.join(sizes, "node").withColumn("hash", F.xxhash64("cls"))
        is_first, is_main = F.expr("leaves AND group != main"), F.expr("leaves AND group = main")
        parts = [
            (0, is_first, "b_first", "b_first", 0),
            (1, is_first, "b_first", "b_rest", 1),
            (1, ~is_first, "b_rest", "b_first", 2),
            (2, is_main, "b_main", "b_ring", 1),
            (2, F.expr("NOT leaves AND group != main"), "b_ring", "b_main", 2),
        ]
        meets = [F.when(member & (F.col(other) > 0), F.struct(F.lit(kind).alias("kind"), F.col(own).alias("n_own"), F.col(other).alias("n_other"), F.lit(side).alias("side"))) for kind, member, own, other, side in parts]
        named = named.withColumn("meet", F.explode(F.filter(F.array(*meets), F.isnotnull))).select("*", "meet.*")
        named = named.withColumn("own", F.pmod("hash", "n_own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
        # Blocks of one part (side 0): a block meets itself once.
        low, high = F.expr("CASE side WHEN 0 THEN least(own, other) WHEN 1 THEN own ELSE other END"), F.expr("CASE side WHEN 0 THEN greatest(own, other) WHEN 1 THEN other ELSE own END")
        at = F.expr("CASE WHEN side > 0 THEN side WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("side")
        cell = F.xxhash64("node", "kind", low.cast("bigint"), high.cast("bigint")).alias("cell")
        rows = rows.unionByName(named.select(cell, "cls", at, "group"))
    known = classes.select("cls", "token_bytes")
    again, n_again = store.put(_cells(store, rows, known, _meeting_rows, "cell bigint, cls string, side int, group bigint"))
    if not n_again:
        return store.spark.createDataFrame([], "a string, b string")
    needed = again.select("cls").distinct().join(classes.select("cls", "uid"), "cls")
    sets, _ = store.put(store.few(to_parts(needed)).mapInArrow(_class_sets(f"{store.folder}/texts"), "cls string, shingles binary"))
    return _cells(store, again, known.join(sets, "cls"), _near_pairs, "a string, b string").distinct()


def _components(store: _Store, links: DataFrame) -> DataFrame:
    """(cls, group): the smallest class of each component, by rounds of large-star and small-star contraction.

    The grouped minima are stored before they are joined, so that both sides are shuffled and a hub with very many
    links is split by adaptive execution. Ends when a round changes nothing.
    """

    def down(edges: DataFrame) -> DataFrame:
        return store.few(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")).distinct()

    def lowest(edges: DataFrame) -> DataFrame:
        return store.put(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")))[0]

    edges, state = store.put(down(links), "a", "b")
    before = -1
    while state != before:
        low = lowest(edges)
        large, _ = store.put(down(edges.join(low, edges.b == low.node, "left").select("a", F.coalesce("low", "b").alias("b"))))
        low = lowest(large)
        small = large.join(low, large.a == low.node).select(F.col("b").alias("a"), F.col("low").alias("b"))
        before = state
        edges, state = store.put(down(small.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b")))), "a", "b")
    heads = edges.select(F.col("b").alias("cls"), F.col("b").alias("group")).distinct()
    return edges.select(F.col("a").alias("cls"), F.col("b").alias("group")).unionByName(heads)


def _joined(store: _Store, groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: the known ones are single nodes now, so that the rounds work on few edges."""
    one, two = (groups.select(F.col("cls").alias(s), F.col("group").alias(f"group_{s}")) for s in "ab")
    edges = links.join(one, "a", "left").join(two, "b", "left")
    edges = edges.select(F.coalesce("group_a", "a").alias("a"), F.coalesce("group_b", "b").alias("b"))
    higher, _ = store.put(_components(store, edges))
    kept = groups.join(higher.select(F.col("cls").alias("group"), F.col("group").alias("new")), "group", "left")
    kept = kept.select("cls", F.coalesce("new", "group").alias("group"))
    new = higher.join(groups.select("cls"), "cls", "left_anti")
    return store.put(kept.unionByName(new.select("cls", "group")))[0]


def _linked(store: _Store, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one, two = (texts.select(F.col("cls").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    return store.few(pairs.select("a", "b").join(one, "a").join(two, "b")).mapInArrow(_confirm, "a string, b string")


def _texts(store: _Store, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One whole text for each class in the pairs."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes.select("cls", "uid"), "cls")
    return store.put(store.few(to_parts(needed)).mapInArrow(_class_texts(f"{store.folder}/texts"), "cls string, text string"))[0]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id = component_id); with `digest` also
    digest, which tells the texts under one id apart."""
    store = _Store(docs.sparkSession)
    more = [text_digest(docs[text]).alias("digest")] if digest else []
    plain = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), *more)
    kind, extra = plain.schema["doc_id"].dataType.simpleString(), ["digest"] if digest else []
    shape = f"doc_id {kind}, {'digest binary, ' if digest else ''}uid bigint, n_shingles bigint, cls string, tokens binary, token_bytes binary"
    n_words = F.sum(F.greatest(F.lit(LEAST_WORDS), "n_shingles"))
    signed, n_words = store.put(write_parts(plain, f"{store.folder}/texts").mapInArrow(_sign, shape), value=n_words)
    store.plan(n_words or 0)
    same = [F.first(c).alias(c) for c in ("tokens", "token_bytes")]
    classes, _ = store.put(signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("uid").alias("uid"), *same))

    pairs, leaf, met = _candidates(store, classes)
    pairs, n_pairs = store.put(pairs)
    names = classes.select("cls", F.col("rep").alias("component_id"))
    if n_pairs:
        links, _ = store.put(_linked(store, pairs, _texts(store, classes, pairs)))
        groups, _ = store.put(_components(store, links))
        rest, n_rest = store.put(_other_candidates(store, leaf, met, groups, classes).join(pairs, ["a", "b"], "left_anti"))
        if n_rest:
            more, n_more = store.put(_linked(store, rest, _texts(store, classes, rest)))
            groups = _joined(store, groups, more) if n_more else groups
        named = classes.select("cls", "rep").join(groups, "cls")
        least = named.groupBy("group").agg(F.min("rep").alias("least"))
        names = names.join(named.join(least, "group").select("cls", "least"), "cls", "left")
        names = names.select("cls", F.coalesce("least", "component_id").alias("component_id"))
    names, _ = store.put(names)  # as above: a class may hold a third of all rows
    out = store.few(signed.select("doc_id", *extra, "n_shingles", "cls").join(names, "cls", "left"))
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *extra, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def near_duplicates_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: one document of each group stays, that with the smallest id; rows without an id stay.

    Rows are dropped by id and text, so that a text of its own stays though another under its id goes."""
    dropped = near_duplicates(docs, digest=True).where("NOT kept AND doc_id IS NOT NULL")
    dropped = dropped.select(F.col("doc_id").alias("dropped_id"), F.col("digest").alias("dropped_digest")).distinct()
    same = (docs["doc_id"] == F.col("dropped_id")) & (text_digest(docs["text"]) == F.col("dropped_digest"))
    return docs.join(dropped, same, "left_anti").select(docs.columns)
