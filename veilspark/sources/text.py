"""Fragments of plain texts: words with the positions they would have on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Advance of a word: its width, ten a character, and a gap; lines are 30 apart, words 20 high.
CHAR, GAP, LINE, HEIGHT, MARGIN = 10, 8, 30, 20, 10


def words(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, tok, text) of every non-empty word; lines end at newlines, words
    at spaces. Narrow: no shuffle."""
    lines = texts.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("tok", "text")).where("text <> ''")


def fragments(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fragments table of plain texts, dealt out by document once."""
    placed = words(texts, id_col, text_col)
    doc = Window.partitionBy("doc_id").orderBy("line_no", "tok")
    line = Window.partitionBy("doc_id", "line_no").orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    width = F.length("text") * CHAR
    seq = F.row_number().over(doc)
    x = MARGIN + F.coalesce(F.sum(width + GAP).over(line), F.lit(0))
    return placed.select("doc_id", seq.alias("seq"), F.format_string("w%04d", seq).alias("frag_id"), "text", x.cast("int").alias("x"), (F.col("line_no") * LINE + MARGIN).cast("int").alias("y"), width.alias("w"), F.lit(HEIGHT).alias("h"), F.lit(100.0).alias("conf"))


def strip_tags(html: Column) -> Column:
    """The visible text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "\n")
    return F.regexp_replace(bare, "<[^>]*>", "\n")


def from_ocr(raw: DataFrame, floor: float = 30) -> DataFrame:
    """Fragments of raw OCR rows (doc_id, ordinal, text, conf, left, top, width, height,
    block_num, par_num, line_num, all as strings): blank and uncertain words are dropped
    first, then ids are dense; a bad number is 0, a bad confidence -1."""
    n = lambda c: F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0))
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    kept = raw.withColumn("text", text).withColumn("conf", F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))).where((F.col("text") != "") & (F.col("conf") >= floor))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return kept.select("doc_id", seq.alias("seq"), F.format_string("w%04d", seq).alias("frag_id"), "text", n("left").alias("x"), n("top").alias("y"), n("width").alias("w"), n("height").alias("h"), "conf", n("block_num").alias("block_num"), n("par_num").alias("par_num"), n("line_num").alias("line_num"))


def dropped_words(raw: DataFrame, floor: float = 30) -> DataFrame:
    """(doc_id, blank, uncertain, kept): how many raw OCR rows from_ocr drops, and why."""
    bare = F.coalesce(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("")) == ""
    unsure = ~bare & (F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) < floor)
    return raw.groupBy("doc_id").agg(F.count_if(bare).alias("blank"), F.count_if(unsure).alias("uncertain"), F.count_if(~bare & ~unsure).alias("kept"))
