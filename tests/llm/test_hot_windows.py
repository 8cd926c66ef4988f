"""Passages that very many documents share: right spans, and few rows for them."""

import random

import pytest
from pyspark.sql import functions as F

from kinmatch.llm import repeated_bytes as rb
from kinmatch.llm.parts import to_parts, write_parts
from kinmatch.session import scratch_folder


def texts():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefg ") for _ in range(n))
    hot, other = word(400), word(130)
    out = [(i, word(rnd.randrange(0, 60)) + hot[rnd.randrange(0, 120) : 400 - rnd.randrange(0, 120)] + word(rnd.randrange(0, 150)) + other * (i % 3)) for i in range(40)]
    rnd.shuffle(out)
    return out + [(7, dict(out)[7]), (41, None), (42, hot), (43, hot), (44, "x" * 300)]


def brute(rows):
    seen, out = {}, {}
    for i, text in sorted(set(rows)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - rb.LENGTH + 1):
            if seen.setdefault(raw[s : s + rb.LENGTH], (i, s)) != (i, s):
                gone[s : s + rb.LENGTH] = b"\1" * rb.LENGTH
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_hot_keys_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(rb, "GROUP", 2)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    want = brute(rows)
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rb.remove_repeats(docs).collect()]
    assert len(got) == len(rows)
    assert {i: v for i, v in got} == want


def test_a_window_of_all_documents_is_sent_once_by_a_task(spark):
    rows = [(i, "0123456789" * 3 + "a shared passage of this and that, " * 9) for i in range(200)]
    folder = scratch_folder(spark, "test")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).withColumn("ord", F.col("doc_id"))
    stored = write_parts(docs, folder)
    anchors = to_parts(stored.select("uid")).mapInArrow(rb._find_anchors(folder, []), "key bigint, uid bigint, pos int, bucket int").drop("bucket")
    shape = "bucket int, key bigint, ord bigint, uid bigint, pos int, low int, high int, context binary, settled boolean"
    made = to_parts(anchors.withColumn("hot", F.lit(True)), "pos").mapInArrow(rb._fetch_contexts(folder, [], 4), shape)
    assert made.count() <= 200 + 400  # a span for each text, and the windows of one
