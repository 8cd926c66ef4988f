import math
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions import cells, display, embed, text


def values(spark, rows, column, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, c {dtype}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def int_model(s):
    try:
        return str(int(s))
    except ValueError:
        return s


def names_model(s):
    if not s.strip():
        return s
    return ", ".join(dict.fromkeys(n.strip() for n in s.split(",") if n.strip()))


def test_integer_edges(spark):
    want = {
        " 42 ": "42", "007": "7", "+5": "5", "1_000": "1000", "-0": "0", "1__0": "1__0", "4.5": "4.5", "": "", "  ": "  ",
        "-012": "-12", "0": "0", "00": "0", "+-5": "+-5", "_1": "_1", "1_": "1_", "\t9\n": "9", "9" * 40: "9" * 40, "12a": "12a",
        " 8 ": "8", "\x1c7": "\x1c7", "\u20037\xa0": "7",
    }
    assert values(spark, list(want), cells.normalise_int(F.col("c"))) == list(want.values())
    assert list(want.values()) == [int_model(s) for s in want]


def test_name_edges(spark):
    want = {"A, B,A ": "A, B", ", ,": "", "  ": "  ", "b,,a,B": "b, a, B", "\tx\n,x": "x", "": "", "one": "one"}
    assert values(spark, list(want), text.dedupe_names(F.col("c"))) == list(want.values())
    assert values(spark, [None], text.dedupe_names(F.col("c"))) == [None]


def test_camel_edges(spark):
    want = {
        "IMDB ID": "imdbId", "longDescription": "longdescription", "a_b c": "aBC", "Foo foo-bar BAZ": "fooFoo-barBaz",
        " _ ": " _ ", "": "", "Release_Date": "releaseDate", "__x  y__": "xY",
    }
    assert [text.camel_case(h) for h in want] == list(want.values())
    assert values(spark, list(want), text.camel_case_col(F.col("c"))) == list(want.values())


cell = st.text(alphabet="0123456789+-_. \t,aBéß", max_size=12)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cell, min_size=120, max_size=200))
def test_text_functions_against_models(spark, texts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, c string").orderBy("i")
    rows = df.select(cells.normalise_int(F.col("c")), text.dedupe_names(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(int_model(t), names_model(t)) for t in texts]


def test_typed_cells(spark):
    double = lambda c: cells.normalise_int(c, T.DoubleType())
    got = values(spark, [4.7, -4.7, -0.2, 1e20, float("nan"), float("inf"), None, 9.1e18], double(F.col("c")), "double")
    assert got == ["4", "-4", "0", "100000000000000000000", "nan", None, None, "9100000000000000000"]
    bad = values(spark, [1.0, float("-inf"), None], cells.bad_number(F.col("c"), T.DoubleType()), "double")
    assert bad == [False, True, False]
    assert values(spark, [4.7], cells.normalise_int(F.col("c"), T.DoubleType(), "exact"), "double") == ["4.7"]
    assert values(spark, [True, False], cells.normalise_int(F.col("c"), T.BooleanType()), "boolean") == ["1", "0"]
    when = F.to_timestamp("c")
    got = values(spark, ["2024-01-02 03:04:05", "2024-01-02 03:04:05.120"], cells.normalise_int(when, T.TimestampType()))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05.120000"]
    assert values(spark, [None, "x"], cells.cell_text(F.col("c"), T.StringType(), False)) == ["", "x"]
    assert values(spark, ["b,b", "7, 7"], cells.cell_text(F.col("c"), T.StringType(), True)) == ["b", "7"]


def test_display(spark):
    assert values(spark, ["x" * 50, "é" * 51, None], display.truncate(F.col("c"))) == ["x" * 50, "é" * 50 + "...", None]
    assert values(spark, [None, "", "0", "a"], display.blank_falsy(F.col("c"))) == ["", "", "", "a"]
    assert values(spark, [0, 3], display.blank_falsy(F.col("c"), T.IntegerType()), "int") == ["", "3"]
    assert values(spark, [1.005, 2.0], display.score_text(F.col("c"), 3), "double") == ["1.005", "2.000"]
    ids = values(spark, ["a", "b"], display.row_id(F.col("c"), F.lit("x")))
    assert len(set(ids)) == 2 and all(re.fullmatch("[0-9a-f]{64}", i) for i in ids)
    assert values(spark, ["1:a"], display.row_id(F.col("c"), F.lit("b"))) != values(spark, ["1"], display.row_id(F.col("c"), F.lit(":ab")))


def test_hashed_vectors(spark):
    long = "lorem ipsum " * 20000 + "tail"
    rows = values(spark, ["Red Bolt", "red bolt", "", None, "x", long, long + "!"], embed.hashed_ngrams(F.col("c"), 32))
    assert rows[0] == rows[1] and rows[2] is None and rows[3] is None
    for v in (rows[0], rows[4], rows[5]):
        assert len(v) == 32 and math.isclose(float(np.dot(v, v)), 1.0, abs_tol=1e-5)
    assert rows[5] != rows[6]  # the end of a long text counts


def test_function_embedder_skips_blanks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "abcd")], "i int, c string")

    def lengths(texts):
        assert all(texts)
        return [[len(t), 1.0] for t in texts]

    rows = embed.function_embedder(lengths, batch_rows=1)(df, "c", "v").orderBy("i").collect()
    assert [r.v for r in rows] == [[2.0, 1.0], None, None, [4.0, 1.0]]


def test_scores_round_their_exact_value(spark):
    """As toFixed does: ties of the binary value go up, decimal look-alikes of ties do not."""
    from decimal import ROUND_HALF_UP, Decimal

    values = [0.125, 1.005, 2.675, 0.375, 0.5, 0.0, 0.995, 0.9999, 12345.678, 1 / 3, 1e-9, 0.045, 1.045, 8.345, 99.995, -1.125, 1e9 + 0.375, None]
    values += [k / 64 + k / 977 for k in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        want = [None if v is None else str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]
        got = [r[0] for r in df.select(display.score_text(F.col("v"), digits)).collect()]
        assert got == [w if w is None or Decimal(w) or not w.startswith("-") else w for w in want]


def test_row_ids_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("a", "", "b"), ("ab", None, None)], "x string, y string, z string")
    ids = [r[0] for r in df.select(display.row_id(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert len(set(ids)) == 5 and None not in ids
