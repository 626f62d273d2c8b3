"""Cleaning and change detection over documents, pages and their text units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as X


def line_units(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """One row for each non-blank line: doc, page, unit_no (from 0), text. Pages without lines have none."""
    lines = pages.select(doc, page, F.posexplode(F.split(text, "\n")).alias("line", "text")).where(F.trim("text") != "")
    order = Window.partitionBy(doc, page).orderBy("line")
    return lines.select(doc, page, (F.row_number().over(order) - 1).alias("unit_no"), "text")


def strip_headers_footers(units: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """units without repeated first and last units of pages, and without lone page numbers.

    A document needs three pages; a key is dropped that opens (closes) at least half of all its pages,
    two at the least. Pages without units have no say but count as pages.
    """
    each = Window.partitionBy(doc, page)
    keyed = units.withColumns({"key": X.line_key("text"), "last_no": F.max("unit_no").over(each), "first_no": F.min("unit_no").over(each)})
    sizes = pages.groupBy(doc).agg(F.count("*").alias("n")).where("n >= 3")
    sizes = sizes.select(doc, F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2)).alias("least"))

    def repeated(edge: str) -> DataFrame:
        at = keyed.where(F.col("unit_no") == F.col(edge)).groupBy(doc, "key").agg(F.count("*").alias("times"))
        return at.join(sizes, doc).where("times >= least").select(doc, "key", F.lit(True).alias(f"{edge}_drop"))

    out = keyed.join(repeated("first_no"), [doc, "key"], "left").join(repeated("last_no"), [doc, "key"], "left")
    gone = (F.col("first_no_drop") & (F.col("unit_no") == F.col("first_no"))) | (F.col("last_no_drop") & (F.col("unit_no") == F.col("last_no"))) | X.is_page_number("text")
    return out.where(~F.coalesce(gone, F.lit(False))).select(doc, page, "unit_no", "text")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", content: str = "text", parts: int = 32) -> DataFrame:
    """key, sha256, first_key (the least key with these bytes), is_duplicate.

    Texts that occur once need no join; copies of the others are dealt over `parts` tasks, so a text that is a third of all
    rows is not one task's."""
    salt = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    hashed = docs.select(key, F.sha2(content, 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(key).alias("first_key"), F.count("*").alias("n")).where("n > 1").drop("n")
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = hashed.withColumn("salt", salt).join(spread, ["sha256", "salt"], "left").withColumn("first_key", F.coalesce("first_key", key))
    return out.select(key, "sha256", "first_key", (F.col(key) != F.col("first_key")).alias("is_duplicate"))


def pending(docs: DataFrame, registry: DataFrame, signature: Column | str) -> DataFrame:
    """docs (doc_id, sha256) that the registry does not hold as indexed with this content and signature."""
    sig = F.lit(signature) if isinstance(signature, str) else signature
    current = registry.where(F.col("status") == "indexed").select("doc_id", "sha256", "index_sig").distinct()
    return docs.withColumn("index_sig", sig).join(current, ["doc_id", "sha256", "index_sig"], "left_anti").drop("index_sig")


def ratio_report(docs: DataFrame, pdf: Column, txt: Column) -> DataFrame:
    chars = docs.withColumns({"pdf_chars": pdf, "txt_chars": txt})
    return chars.withColumns({"ratio": X.ratio(F.col("pdf_chars"), F.col("txt_chars")), "ratio_ok": X.ratio_ok(F.col("pdf_chars"), F.col("txt_chars"))})
