"""Corpus operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinmatch.llm.bpe import decode_ids, encode_texts
from kinmatch.llm.line_windows import line_windows
from kinmatch.llm.near_duplicates import near_duplicates
from kinmatch.llm.packing import pack
from kinmatch.llm.personal_data import personal_data
from kinmatch.llm.quality import quality
from kinmatch.llm.repeated_bytes import remove_repeats

SCHEMA = "doc_id bigint, text string, key string, n bigint"


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = [words(rng, 120) for _ in range(6)]
    texts = [None, "", " \n\t", "one", "One", "two words", "ä" * 50] + long
    texts += [t.replace(t[:8], "zz yy xx", 1) for t in long] + long[:2]
    texts += ["\n".join(["first line", "second line", "third line", str(i)]) for i in range(3)]
    texts += ["write to a.b@c.org or +44 20 7946 0958 from 10.0.0.1", long[0] * 40]
    return [(i, t, "same", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    found = [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t) for i, t, *_ in rows}
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    top[a] = min(top[a], top[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), top[i], top[i] == i) for i, s in sets.items()}
    assert near_duplicates(empty).count() == 0


def test_repeated_bytes(docs, rows, empty):
    seen, expected = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            if seen.setdefault(b[at : at + 100], (i, at)) != (i, at):
                gone[at : at + 100] = b"\1" * 100
        expected.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == expected
    assert remove_repeats(empty).count() == 0


def test_line_windows(docs, rows, empty):
    seen, expected = set(), {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if re.search("[^ \t-\r]", "".join(window)) and window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        expected[i] = (len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone))
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in line_windows(docs).collect()} == expected
    assert line_windows(empty).count() == 0


def test_bpe_equals_library(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    got = {r.doc_id: (list(r.ids), r.decoded) for r in decode_ids(encode_texts(docs, path), path).collect()}
    for i, t, *_ in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, model.decode(ids, skip_special_tokens=False))
    assert encode_texts(empty, path).count() == 0


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    found = pack(docs, path).collect()
    for i, t, *_ in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        pieces = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 1024)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for s in {r.sequence_id for r in found}:
        at = 0
        for p in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert pack(empty, path).count() == 0


def test_personal_data(docs, empty):
    (row,) = [r for r in personal_data(docs).collect() if r.text and "@" in r.text]
    texts = {s.kind: row.text[s.start : s.end] for s in row.spans}
    assert (texts["email"], texts["ip"], texts["phone"]) == ("a.b@c.org", "10.0.0.1", "+44 20 7946 0958")
    assert personal_data(empty).count() == 0


def test_quality(docs, rows, empty):
    got = {r.doc_id: r for r in quality(docs).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, t, *_ in rows:
        n = len(re.findall("[^ \t-\r]+", t or ""))
        assert got[i].n_words == n
        assert not got[i].kept or not got[i].base_failed
        assert got[i].base_failed or n >= 50
    assert quality(empty).count() == 0


