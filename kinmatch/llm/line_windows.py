"""Line deduplication by overlapping windows of three consecutive lines, in DataFrame functions.

Texts are split at "\\n". Every three consecutive lines, one window per line, are hashed (128 bits). A window that occurs
anywhere earlier (smaller doc_id, or earlier in the same document) is a repeat; all lines that repeats cover are removed,
runs of covered lines being merged. Windows are judged on the input, not on what is left. Windows without any word never
count.

Windows are grouped with grouped minima (combined before the shuffle); only windows found at least twice are joined
back, both sides being shuffled, so that a window which a third of all documents share is split by adaptive execution.
Texts are read twice and shuffled once, by id.

Edge cases: null and empty texts have one empty line and no window; texts under three lines keep all lines. Null ids
come last in the order. Rows with equal id and text are one document and keep the same lines; rows with equal id and
other text are ordered by a hash of the text. An empty table gives an empty result. Input columns named like an output
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.session import scratch_folder

WINDOW = 3
MADE = ["n_lines", "n_removed", "n_spans", "kept_text"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, at, key) of every window that holds a word. docs: doc_id, text."""
    lines = docs.select("doc_id", _digest(F.col("text")).alias("digest"), _lines(F.col("text")).alias("lines"))
    n = F.size("lines")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    joined = lambda i: F.concat_ws("\n", *[F.get("lines", i + k) for k in range(WINDOW)])
    found = F.transform(starts, lambda i: F.struct(i.alias("at"), joined(i).alias("window")))
    rows = lines.select("doc_id", "digest", F.explode(found).alias("w"))
    rows = rows.where(F.col("w.window").rlike("[^ \\x09-\\x0D]"))
    return rows.select("doc_id", "digest", "w.at", F.unhex(F.md5(F.col("w.window").cast("binary"))).alias("key"))


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all), n_lines, n_removed, n_spans (runs of removed lines) and kept_text."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession, "lines")
    keep = docs.columns if keep is None else keep

    found = windows(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    found.write.parquet(f"{folder}/windows")
    found = spark.read.schema(found.schema).parquet(f"{folder}/windows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "at")
    repeated = found.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select("key", "first")
    repeated.write.parquet(f"{folder}/repeated")
    repeated = spark.read.schema(repeated.schema).parquet(f"{folder}/repeated")
    later = found.join(repeated, "key").where(order != F.col("first"))
    removed = later.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("at")).alias("at"))

    base = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    base = base.withColumn("digest", _digest(F.col("text")))
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "at")
    rows = base.join(removed, base.doc_id.eqNullSafe(F.col("r_id")) & (base.digest == F.col("r_digest")), "left")
    rows = rows.select("row", _lines(F.col("text")).alias("lines"), F.coalesce("at", F.array().cast("array<int>")).alias("at"))
    near = lambda k: F.get("at", k)
    starts = F.filter("at", lambda x, k: (k == 0) | (x > near(k - 1) + WINDOW))
    last = F.filter("at", lambda x, k: (k == F.size("at") - 1) | (near(k + 1) > x + WINDOW))
    rows = rows.withColumns({"starts": starts, "ends": F.transform(last, lambda x: x + WINDOW)})
    # Kept lines lie before the first run, between runs and after the last.
    bounds = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.col("ends")).alias("a"),
        F.concat(F.col("starts"), F.array(F.size("lines"))).alias("b"),
    )
    kept = F.flatten(F.transform(bounds, lambda x: F.slice("lines", x["a"] + 1, x["b"] - x["a"])))
    rows = rows.withColumn("kept", kept)
    return rows.select(
        *[F.col("row")[c].alias(c) for c in keep if c not in MADE],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


def line_windows_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: repeated lines go, and with them documents of which nothing is left.

    Documents without a removed line stay as they are; n_chars, if there, follows the new text.
    """
    boxed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc"))
    cut = line_windows(boxed, keep=["doc"]).where("n_removed = 0 OR n_removed < n_lines")
    text = F.when(F.col("n_removed") == 0, F.col("doc.text")).otherwise(F.col("kept_text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") == 0, F.col("doc.n_chars")).otherwise(F.length("kept_text"))
        new["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
