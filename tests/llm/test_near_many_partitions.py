"""Near-duplicates with many more shuffle partitions than the documents call for."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from kinmatch.llm import near_duplicates as near

MANY = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many(spark):
    before = {k: spark.conf.get(k, None) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups_of(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    top = list(range(len(texts)))

    def head(x):
        return x if top[x] == x else head(top[x])

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((head(a), head(b)))
                top[y] = x
    return {i: head(i) for i in range(len(texts))}


def test_stored_tables_have_few_files(many, monkeypatch):
    """A large group of near copies and texts of their own: the files follow the documents, not the shuffle partitions."""
    monkeypatch.setattr(near, "LEAF", 8)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, texts = [word() for _ in range(120)], []
    for i in range(120):
        copy = list(base) if i % 2 else [word() for _ in range(120)]
        copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    stores = []
    plain = near._Store

    def kept(session):
        stores.append(plain(session))
        return stores[-1]

    monkeypatch.setattr(near, "_Store", kept)
    rng.shuffle(texts)
    docs = many.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
    assert got == groups_of(texts)
    root = Path(stores[0].folder.removeprefix("file://"))
    files = {x: len(list(x.glob("part-*"))) for x in root.rglob("*") if x.is_dir() and not x.is_relative_to(root / "texts")}
    assert max(files.values()) <= 2 * many.sparkContext.defaultParallelism, files
    assert (root / "met").exists()


def test_cells_of_several_partitions(many):
    """A task that takes several partitions gets cells in no order, but each in one piece."""
    cells = np.repeat(np.array([7, 9, -3, 2, 5], np.int64), [3, 4, 2, 5, 1])
    for size in range(1, len(cells) + 1):
        batches = [pa.RecordBatch.from_arrays([pa.array(cells[k : k + size])], ["cell"]) for k in range(0, len(cells), size)]
        seen = [part.column("cell").to_pylist() for part in near._each_cell(lambda part: part)(iter(batches))]
        assert sum(seen, []) == cells.tolist()
        assert not any(set(x) & set(y) for i, x in enumerate(seen) for y in seen[:i])
