"""Near-duplicates whose nodes are larger than leaves: nothing that could join two components may be left out."""

import random

import numpy as np
import pytest

from kinmatch.llm import near_duplicates as near

LEVEL = "node bigint, cls string, leaves boolean, ring boolean"


def other_pairs(spark, monkeypatch, leaf, met, groups, tokens, sets):
    """Pairs of the second turn; tokens and sets: class to bytes."""
    classes = spark.createDataFrame([(c, i, bytearray(t)) for i, (c, t) in enumerate(tokens.items())], "cls string, uid bigint, token_bytes binary")
    known = spark.createDataFrame([(c, bytearray(x)) for c, x in sets.items()], "cls string, shingles binary")
    # Texts are not stored here: the sets come from a table.
    monkeypatch.setattr(near, "to_parts", lambda needed: needed.join(known, "cls").select("cls", "shingles"))
    monkeypatch.setattr(near, "_class_sets", lambda folder: lambda batches: batches)
    found = near._other_candidates(
        near._Store(spark),
        spark.createDataFrame(leaf, "node bigint, cls string"),
        spark.createDataFrame(met, LEVEL),
        spark.createDataFrame(groups, "cls string, group string"),
        classes,
    )
    return sorted((r.a, r.b) for r in found.collect())


SET = np.arange(100, dtype=np.uint32).tobytes()


def test_classes_that_left_one_node_meet(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    rng = np.random.default_rng(1)
    same = rng.integers(0, 256, near.HASHES, np.uint8).tobytes()
    left = {f"{g}{i}": g for g, n in (("a", 9), ("b", 5), ("c", 2)) for i in range(n)}
    ring = {f"{g}{i}": g for g, n in (("a", 19), ("b", 9), ("d", 2)) for i in range(n) if f"{g}{i}" not in left}
    both = left | ring
    met = [(1, c, c in left, c in ring) for c in both]
    got = other_pairs(spark, monkeypatch, [], met, list(both.items()), dict.fromkeys(both, same), dict.fromkeys(both, SET))
    assert got == sorted((x, y) for x in both for y in both if x < y and both[x] != both[y] and (x in left or y in left))


@pytest.mark.parametrize("seed", range(2))
def test_bridged_groups_in_large_nodes(spark, monkeypatch, seed):
    """Near copies around pairs of texts that are linked by a bridge only, with leaves of four classes."""
    monkeypatch.setattr(near, "LEAF", 4)
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        # Runs of changed words at the end: Jaccard similarity of neighbours in the chain is just above 0.75.
        other = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for step in range(4):
            cut = 200 - 24 * step
            head = base[:cut] + other[cut:]
            for _ in range(4):
                copy = list(head)
                copy[rng.randrange(3)] = f"w{rng.randrange(10**6)}"
                texts.append(" ".join(copy))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    top = list(range(len(texts)))

    def head(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((head(a), head(b)))
                top[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
    assert got == {i: head(i) for i in range(len(texts))}


def test_only_near_sets_leave_a_cell(spark, monkeypatch):
    """Three classes with equal tokens, of which two have near sets."""
    same = bytes(range(256))
    sets = {"x": SET, "y": np.arange(10, 110, dtype=np.uint32).tobytes(), "z": np.arange(30, 130, dtype=np.uint32).tobytes()}
    groups = [(c, c) for c in "xyz"]
    got = other_pairs(spark, monkeypatch, [(5, c) for c in "xyz"], [], groups, dict.fromkeys("xyz", same), sets)
    assert got == [("x", "y")]
