"""Embedding duplicates, the filter audit and lexical search against brute force."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from kinmatch.llm.embedding_duplicates import embedding_duplicates
from kinmatch.llm.filter_audit import FILTERS, filter_audit
from kinmatch.llm.lexical_search import PostingList, lexical_search

# ---- embedding duplicates ------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, cls string, node int, size string, label int"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def near(rng, x, cosine):
    """Vectors at about this cosine from those of x."""
    away = rng.standard_normal(x.shape)
    away = unit(away - (away * x).sum(-1, keepdims=True) * x)
    return cosine * x + math.sqrt(1 - cosine**2) * away


def linked(rows, least=0.95):
    """(id, links, component, kept) of every row by comparing all pairs."""
    ok = [v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    x = np.array([np.float32(v) if k else np.zeros(16) for k, (_, v) in zip(ok, rows)], float)
    norm = np.linalg.norm(x, axis=1)
    cosine = (x @ x.T) / np.where(norm > 0, norm, 1)[:, None] / np.where(norm > 0, norm, 1)[None, :]
    edge = (cosine >= least) & np.outer(ok, ok)
    np.fill_diagonal(edge, False)
    out, part = [], list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(edge)):
            if part[i] != part[j]:
                part[i] = part[j] = min(part[i], part[j])
                changed = True
    for i, (name, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if part[j] == part[i] and r[0] is not None]
        least_id = min(ids, default=None)
        out.append((name, int(edge[i].sum()), least_id, name is not None and name == least_id))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = unit(rng.standard_normal((60, 16)))
    tight = near(rng, np.repeat(base[:1], 120, axis=0), 0.995)  # a ball
    loose = near(rng, np.repeat(base[1:2], 60, axis=0), 0.977)  # pairs of about 0.955: not all linked
    edges = near(rng, tight[:40], 0.952)  # around the ball, on both sides of its rim
    chain = [base[2]]
    for _ in range(12):
        chain.append(near(rng, chain[-1], 0.96))
    found = [*base, *tight, *loose, *edges, *chain, *(base[3:6] * 1e-30), *(base[6:9] * 7.5)]
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(found)]
    rows += [(5, rows[5][1]), (900, rows[70][1]), (901, rows[70][1]), (None, rows[10][1]), (None, rows[11][1]), (902, rows[11][1])]
    rows += [(903, None), (904, [0.0] * 16), (905, [1.0, None] + [0.0] * 14), (906, [float("nan")] + [1.0] * 15), (907, [float("inf")] * 16), (908, [1.0, 2.0]), (None, None), (909, [])]
    return rows


@pytest.mark.parametrize("block", [7, 2048])
def test_links_equal_brute_force(spark, vectors, block):
    table = spark.createDataFrame([(i, v, "x", 1, "y", 0) for i, v in vectors], VECTORS)
    got = [tuple(r) for r in embedding_duplicates(table, block=block).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=str) == linked(vectors)


def test_no_vectors(spark):
    assert embedding_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    none = spark.createDataFrame([(1, None, "", 0, "", 0), (1, [0.0], "", 0, "", 0)], VECTORS)
    assert [tuple(r) for r in embedding_duplicates(none).collect()] == [(1, 0, 1, True)] * 2


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold among vectors of no structure, the hardest case."""
    rng = np.random.default_rng(11)
    base = unit(rng.standard_normal((3000, 64)))
    both = np.float32(np.concatenate([base, near(rng, base[:1500], 0.951)]))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id bigint, embedding array<float>")
    x = unit(both.astype(float))
    truth = int(((x @ x.T) >= 0.95).sum()) - len(x)
    found = sum(r.n_links for r in embedding_duplicates(table).select("n_links").collect())
    assert truth >= 2900 and 0.99 * truth <= found <= truth


# ---- filter audit --------------------------------------------------------------------------------------


def failures(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), bool(re.search("[#$%&*|]", text))]


def audited(docs, labels):
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for name, text, lang in docs:
        again = name is not None and any(o is not None and o < name and (t or "") == (text or "") for o, t, _ in docs)
        rows.append((lang or "", dict(zip(FILTERS, [*failures(text), again])), name in good, name in bad))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys(FILTERS, 0)
        found = []
        for order in permutations(FILTERS):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in mine) - len(gone)
                left = [r for r in left if not r[1][f]]
                single = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                total[f] += len(gone)
                found.append([part, "".join(order), step, len(left), len(gone), redundant, single, sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [(*r, total[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
DOCS = "doc_id bigint, text string, lang string, mask int, n string, quality string"


@pytest.fixture(scope="module")
def audit_docs():
    rng = random.Random(4)
    plain = [" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.choice([20, 110, 130]))) for _ in range(12)]
    texts = [*plain, *plain[:6], *plain[:3], None, "", None, " \n", "A B C " * 60, plain[1] + " #", "word " * 200, plain[2].upper(), ("long " + plain[1] + "\n") * 400]
    texts += [plain[0]] * 40
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    return docs + [(3, plain[3], "fr"), (3, plain[3], "fr"), (None, plain[4], "en"), (None, plain[0], "en"), (7, "other text under one id", "de")]


@pytest.mark.parametrize("descending,held", [(True, 5), (False, 100_000)])
def test_audit_equals_brute_force(spark, tmp_path, audit_docs, descending, held):
    """Files arrive with the smaller ids last, so that counted masks are taken back; and in order."""
    docs = sorted(audit_docs, key=lambda d: -1 if d[0] is None else d[0], reverse=descending)
    for k in range(0, len(docs), 12):
        rows = [(i, t, lang, 3, "n", "q") for i, t, lang in docs[k : k + 12]]
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    labels = [(i, i % 2, 1 if i % 5 == 0 else 0) for i in range(0, 60, 3)] + [(3, None, 1), (3, 0, 0), (None, 1, 1), (500, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit(spark, str(tmp_path / "docs"), table, batches=4, held=held, bucket=10)
    assert sorted(tuple(r) for r in found.select(*COLUMNS).collect()) == audited(docs, labels)


def test_audit_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit(spark, str(tmp_path / "none"), labels).count() == 0


# ---- lexical search ------------------------------------------------------------------------------------

TEXTS = "doc_id bigint, text string, n string, terms int, item_id int"


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for name, t in held:
            m = 50 + (50 * len(t) * n_docs) // n_terms
            s = sum(int(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 20 * m)) for w in words if w in t)
            if s > 0:
                scored.append((-s, name is None, name or 0))
        out += [(item, r, None if missing else name, -s) for r, (s, missing, name) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def search_docs():
    rng = random.Random(8)
    vocabulary = [a + b for a in "abcdefgh" for b in ("x", "Y", "é", "9", "ß")]
    pick = lambda n: " ,".join(vocabulary[min(int(rng.expovariate(0.12)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, pick(rng.choice([3, 10, 40, 90]))) for i in range(700)]
    docs += [(i, docs[5][1]) for i in range(700, 780)]  # ties
    docs += [(9, docs[5][1]), (9, docs[5][1]), (None, docs[5][1]), (None, docs[6][1]), (781, None), (782, ""), (783, " ,;\x00"), (784, "rare " + pick(30) * 300)]
    items = [(1, pick(6)), (2, pick(20)), (2, "rare"), (3, None), (4, "absent words"), (5, "RARE"), (None, pick(4)), (6, ""), (7, pick(12)), (8, vocabulary[0])]
    return docs, items


@pytest.mark.parametrize("k,group_bytes,shard", [(50, 4 << 20, None), (7, 60, 90)])
def test_search_equals_brute_force(spark, monkeypatch, search_docs, k, group_bytes, shard):
    from kinmatch.llm import lexical_search as module

    docs, items = search_docs
    if shard:
        # Small shards, ranges and blocks, so that lists are skipped and heaps merged.
        for name, value in (("SHARD", shard), ("FIRST", 16), ("RANGE", 32), ("BLOCK", 4)):
            monkeypatch.setattr(module, name, value)
    table = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in docs], TEXTS)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in lexical_search(table, asked, k=k, group_bytes=group_bytes).collect()]
    assert sorted(got, key=str) == ranked(docs, items, k)


def test_search_without_rows(spark, search_docs):
    table = spark.createDataFrame([], TEXTS)
    asked = spark.createDataFrame(search_docs[1], "item_id bigint, text string")
    assert lexical_search(table, asked).count() == 0
    full = spark.createDataFrame([(1, "word", "n", 1, 2)], TEXTS)
    assert lexical_search(full, asked.where("false")).count() == 0


def test_blocks_are_read_only_where_asked():
    docs = np.array([1, 5, 300, 70_000, 70_001])
    found = PostingList(docs, np.array([1, 2, 300, 1, 1]), np.array([5, 9, 1, 2, 2]))
    assert found.bound == 9
    have, tfs = found.read(np.array([0]))
    assert have.tolist() == docs.tolist() and tfs.tolist() == [1, 2, 300, 1, 1]
    assert found.within(70_002, 80_000).tolist() == []
