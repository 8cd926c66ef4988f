"""Nothing that is read may go without a stored row or an error row."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions import cells
from kinmatch.plans.spec import EXACT
from kinmatch.sources import catalog as cat
from kinmatch.sources.tables import Tables
from kinmatch.streaming.landing import ingest_stream, landing_csv


def test_large_floats(spark):
    values = [s * v for s in (1, -1) for v in (9e18, 1.2345e22, 1e23, 1e38, 1.5e38, 1e40, 2.0**62, 2.0**511, 7e200, 1.7976931348623157e308)]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = df.select(F.col("c"), cells.normalise_int(F.col("c"), T.DoubleType()).alias("t")).collect()
    assert {r.c: r.t for r in got} == {v: str(int(v)) for v in values}


def test_misplaced_files_become_errors(spark, tmp_path):
    for folder, name in (("assets/e1/item001-u", "a.csv"), ("elsewhere", "b.csv")):
        (tmp_path / "landing" / folder).mkdir(parents=True)
        (tmp_path / "landing" / folder / name).write_text("Title,Length\nHeat,170\nAlien,117\n")
    catalog = cat.create_index(cat.empty_catalog(spark), {"Title": EXACT}, "u", "a.csv", "item001-u").catalog
    tables = Tables(str(tmp_path / "tables"))
    for checkpoint in ("c1", "c1", "c2"):  # the last delivers everything again
        rows = landing_csv(spark, str(tmp_path / "landing"), ["Title", "Length"])
        ingest_stream(rows, tables, str(tmp_path / checkpoint), catalog=catalog).awaitTermination()
        errors = tables.read(spark, "ingest_errors").where("index_name IS NULL").collect()
        assert [(r.source_path.rsplit("/", 1)[1], r.error) for r in errors] == [("b.csv", "path gives no index name")] * 2
        assert tables.read(spark, "items").count() == 2
