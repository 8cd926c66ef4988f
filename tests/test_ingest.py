import os
import shutil
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kinmatch.functions.embed import function_embedder
from kinmatch.sources import catalog as cat
from kinmatch.sources import files
from kinmatch.sources.ingest import file_status, ingest, rename_columns
from kinmatch.sources.tables import Tables, queue_page
from kinmatch.streaming.landing import ingest_stream, landing_csv, landing_workbooks
from workbook_sample import make_workbook

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = ["Title", "Release_Date", "Directors", "Length"]
ROLES = {"Title": "VECTOR", "Length": "EXACT"}


def two(texts):
    return [[float(len(t)), 1.0] for t in texts]


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def csv(rows):
    return ",".join(HEAD) + "\n" + "".join(",".join(f'"{v}"' for v in r) + "\n" for r in rows)


def test_workbook_cells(spark, tmp_path):
    rows = [
        ["Heat", (35065, 1), "A, B,A ", 170.9],
        [None, None, None, True],
        [],
        ["1917", "4.5", " 007 ", 1e3],
        ["<é&>", (0.5, 1), "", -0.5],
    ]
    put(tmp_path / "x", "a.xlsx", make_workbook(HEAD, rows))
    put(tmp_path / "x", "b.xls", b"old format")
    parsed = files.read_workbooks(spark, str(tmp_path / "x")).cache()
    assert files.workbook_columns(parsed) == sorted(HEAD)
    wide = files.widen_workbooks(parsed, HEAD).orderBy("row_no")
    got = [(r.row_no, *[r[h] for h in HEAD]) for r in wide.collect()]
    assert got == [
        (1, "Heat", "1996-01-01 00:00:00", "A, B,A ", "170"),
        (2, "", "", "", "1"),
        (3, "", "", "", ""),
        (4, "1917", "4.5", " 007 ", "1000"),
        (5, "<é&>", "12:00:00", "", "0"),
    ]
    bad = [r for r in parsed.collect() if r.error]
    assert len(bad) == 1 and bad[0].source_path.endswith("b.xls") and "BadZipFile" in bad[0].error
    result = ingest(wide, ROLES, function_embedder(two), index_name="item001-u", file_errors=parsed, positioned=True)
    items = {r.row_no: r for r in result.items.collect()}
    assert items[4].title == "1917" and items[4].directors == "007" and items[1].directors == "A, B" and items[1].releaseDate == "1996-01-01 00:00:00"
    assert items[1].titleEmbedding == [4.0, 1.0] and items[2].titleEmbedding is None
    assert len({r.item_id for r in items.values()}) == 5
    queue = {r.item_id: r for r in result.queue.collect()}
    assert set(queue) == {r.item_id for r in items.values()} and "titleEmbedding" not in result.queue.columns
    counts = {os.path.basename(r.source_path): (r.successful, r.total) for r in result.counts.collect()}
    assert counts == {"a.xlsx": (5, 5), "b.xls": (0, 0)}
    status = {os.path.basename(r.source_path): r.status for r in file_status(result.items, result.errors).collect()}
    assert status == {"a.xlsx": "success", "b.xls": "failed"}
    assert [r[0] for r in files.preview(wide, 2).collect()] == ["Heat", ""]


def test_equal_rows_keep_apart(spark, tmp_path):
    rows = [["same", "", "", "1"]] * 3000 + [["other", "", "", str(i)] for i in range(50)]
    put(tmp_path / "in", "a.csv", csv(rows))
    put(tmp_path / "in", "b.csv", csv(rows[:5]))
    ids = {}
    try:
        for size in ("4096", "128m"):  # many splits, or one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = files.read_csv(spark, str(tmp_path / "in"), HEAD)
            got = [r.item_id for r in ingest(raw, {}, index_name="i").items.collect()]
            assert len(got) == len(set(got)) == 3055
            ids[size] = set(got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids["4096"] == ids["128m"]  # however the file is split


def test_bad_cells_and_headers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, float("inf"))], "ID int, Size double")
    df = df.select("ID", F.col("Size").alias("A b")).withColumn("a_B", F.lit("last"))
    df = df.select("*", F.lit("p").alias("source_path"), F.col("ID").cast("bigint").alias("row_no"), F.lit(0).cast("bigint").alias("block_start"))
    result = ingest(df, {"A b": "EXACT"}, index_name="i")
    assert "aB" in result.items.columns and result.items.count() == 2 and result.items.first().aB == "last"
    only = ingest(df.drop("a_B"), {"A b": "EXACT"}, index_name="i")
    assert [(r.id, r.aB) for r in only.items.collect()] == [("1", "2")]
    assert [(r.row_no, r.error) for r in only.errors.collect()] == [(2, "A b: number has no integer form")]
    assert [tuple(r) for r in only.counts.collect()] == [("p", 1, 2)]
    assert rename_columns(df.select("ID", "A b", "a_B")).columns == ["id", "aB"]
    with pytest.raises(ValueError, match="missing"):
        ingest(df.drop("row_no"), {}, index_name="i")


def test_wrong_header_fails(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "Title,Other,Directors,Length\na,b,c,d\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "in"), HEAD).collect()


def test_paths_and_types(spark):
    df = spark.createDataFrame(
        [("assets/x/item001-u/f.xlsx",), ("file:/tmp/assets/e%3A1/my+index/f.csv",), ("assets/x%2Fy/i/f",), ("other/a/b",)], "p string"
    )
    got = [r[0] for r in df.select(files.index_name_from_path(F.col("p"))).collect()]
    assert got == ["item001-u", "my index", "y", None]


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_equals_batch_and_replays(spark, tmp_path):
    landing = tmp_path / "landing"
    put(landing / "assets/e1/item001-u", "a.csv", csv([["Heat", "1995", "A,A", "170"], ["", "", "", ""], ["Heat", "1995", "A,A", "170"]]))
    put(landing / "assets/e2/item002-v", "b.csv", csv([["Alien", "1979", "B", " 117 "]]))
    catalog = cat.create_index(cat.empty_catalog(spark), ROLES, "u", "a.csv", "item001-u").catalog
    catalog = cat.create_index(catalog, {"Title": "EXACT"}, "v", "b.csv", "item002-v").catalog
    tables = Tables(str(tmp_path / "tables"))

    def run(checkpoint):
        stream = landing_csv(spark, str(landing), HEAD)
        ingest_stream(stream, tables, str(tmp_path / checkpoint), function_embedder(two), catalog).awaitTermination()

    run("c1")
    first = rows_of(tables.read(spark, "items"), "index_name", "item_id", "title", "length")
    want = [("item001-u", "Heat", "170"), ("item001-u", "", ""), ("item001-u", "Heat", "170"), ("item002-v", "Alien", "117")]
    assert sorted((r[0], r[2], r[3]) for r in first) == sorted(want)
    assert len({r[1] for r in first}) == 4
    batch = ingest(files.read_csv(spark, [str(landing / "assets/e1/item001-u")], HEAD), ROLES, function_embedder(two), index_name="item001-u")
    assert rows_of(batch.items, "index_name", "item_id", "title", "length") == [r for r in first if r[0] == "item001-u"]
    vectors = {r.title: r.titleEmbedding for r in tables.read(spark, "items").collect()}
    assert vectors == {"Heat": [4.0, 1.0], "": None, "Alien": None}  # item002-v has no vector field

    run("c1")  # nothing new
    run("c2")  # everything delivered again
    shutil.rmtree(tables.path("queue"))  # a batch that failed between its two writes
    run("c3")
    assert rows_of(tables.read(spark, "items"), "index_name", "item_id", "title", "length") == first
    assert rows_of(tables.read(spark, "queue"), "index_name", "item_id", "title", "length") == first
    put(landing / "assets/e2/item002-v", "c.csv", csv([["Brazil", "1985", "", "132"]]))
    run("c1")
    assert tables.read(spark, "items").count() == 5
    page = queue_page(tables.read(spark, "queue"), "item001-u", 2).collect()
    assert [r.item_id for r in page] == sorted(r[1] for r in first if r[0] == "item001-u")[:2]


def test_workbook_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    put(landing / "assets/e1/item001-u", "a.xlsx", make_workbook(HEAD, [["Heat", 1995, "A", 170], ["Alien", 1979, "B", 117]]))
    put(landing / "assets/e1/item001-u", "b.xlsx", make_workbook(["Title", "Extra"], [["Brazil", "x"]]))
    put(landing / "assets/e1/item001-u", "c.xlsx", b"broken")
    catalog = cat.create_index(cat.empty_catalog(spark), ROLES, "u", "a.xlsx", "item001-u").catalog
    tables = Tables(str(tmp_path / "tables"))
    for checkpoint in ("c1", "c2"):
        stream = landing_workbooks(spark, str(landing))
        ingest_stream(stream, tables, str(tmp_path / checkpoint), function_embedder(two), catalog).awaitTermination()
    got = rows_of(tables.read(spark, "items"), "title", "length", "extra", "row_no")
    assert got == [("Alien", "117", "", 2), ("Brazil", "", "x", 1), ("Heat", "170", "", 1)]
    errors = tables.read(spark, "ingest_errors").collect()
    assert len(errors) == 1 and errors[0].source_path.endswith("c.xlsx")
