"""Pipeline stages on rows that share ids, tables without n_chars, and texts that once took quadratic time."""

import time

from kinmatch.llm.bpe import decode_ids, encode_texts, round_trip
from kinmatch.llm.line_windows import line_windows_stage
from kinmatch.llm.near_duplicates import near_duplicates_stage
from kinmatch.llm.personal_data import automaton, find_spans, personal_data_stage


def words(start, n):
    return " ".join(f"w{k}" for k in range(start, start + n))


def test_a_text_of_its_own_stays_under_a_repeated_id(spark):
    a, c = words(0, 40), words(500, 40)
    docs = spark.createDataFrame([(3, c, "x"), (5, a, "y"), (5, c, "z"), (7, a, "q"), (None, c, "n"), (8, None, "e")], "doc_id bigint, text string, digest string")
    kept = near_duplicates_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.digest) for r in kept.collect()) == [(-1, "n"), (3, "x"), (5, "y"), (8, "e")]


def test_stages_without_n_chars(spark):
    docs = spark.createDataFrame([(1, "write to a.b@c.org\nx y\nz"), (2, "one\nx y\nz"), (3, None)], "doc_id bigint, text string")
    assert [r.text for r in personal_data_stage(spark, docs, "").orderBy("doc_id").collect()][:2] == ["write to <EMAIL>\nx y\nz", "one\nx y\nz"]
    assert line_windows_stage(spark, docs, "").columns == ["doc_id", "text"]


def test_schemes_without_names_take_linear_time():
    anchors, start = automaton(), time.perf_counter()
    assert not [s for s in find_spans("://" * 350_000, anchors) if s[0] == "url"]
    assert time.perf_counter() - start < 5


def test_round_trip_equals_both_steps(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Some words, some 12 more."), (2, None), (3, ""), (4, "<|endoftext|> 힣 ß " + words(0, 50))], "doc_id bigint, text string")
    two = decode_ids(encode_texts(docs, path), path).select("doc_id", "ids", "decoded")
    assert sorted(map(tuple, round_trip(docs, path).select("doc_id", "ids", "decoded").collect())) == sorted(map(tuple, two.collect()))
