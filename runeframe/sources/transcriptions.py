"""Transcribed pages to rune rows, and the reference tables.

A page is tokenised into single runes and the gaps between them; marks and printed characters of a
gap belong to the rune before it. Rows are long: one per rune, one per printed run, one per page.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runeframe.functions.alphabet import RUNES

#: Marks of the transcription, and the separators a printed run may hold.
MARKS = "-.&$§/"
PRINTED = r"([^\-./&$§](?:[-./]*[^\-./&$§])*)"

PAGES = "page string, book_page int, section string, status string, image string, transcription string, discord_channel string, notes string"
SECTIONS = "section string, first_page string, first_rune int, last_page string, headline string, headline_form string, status string, cipher string, key string, solution_file string, notes string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with header; cells are typed by the schema and never inferred, empty text cells are empty strings."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page, raw`` of the transcription files."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", "_metadata.file_name")
    return files.select(F.regexp_replace("file_name", r"\.txt$", "").alias("page"), F.col("value").alias("raw"))


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(runes, printed, leading)`` from ``page, raw``.

    runes: ``page, pos, idx, line, col, marks_after``; printed: ``page, anchor, ord, text`` with the
    position of the rune before (-1 before the first); leading: ``page, leading_marks``. A rune
    outside the alphabet is an error; a null or empty page has no rune row.
    """
    text = F.regexp_replace(F.coalesce("raw", F.lit("")), r"(?U)\s+", "")
    runes = F.regexp_extract_all(text, F.lit("([ᚠ-᛿])"), F.lit(1))
    # the part before each rune, and what follows the last one
    gaps = F.split(text, "[ᚠ-᛿]", -1)
    cut = F.transform(gaps, lambda g: F.struct(F.regexp_extract_all(g, F.lit(PRINTED), F.lit(1)).alias("printed"), F.regexp_replace(g, PRINTED, "").alias("marks"), (F.length(g) - F.length(F.replace(g, F.lit("/"), F.lit("")))).alias("breaks")))
    base = pages.select("page", runes.alias("runes"), cut.alias("gaps"))
    symbol = lambda r: F.when(F.instr(F.lit(RUNES), r) > 0, F.instr(F.lit(RUNES), r) - 1).otherwise(F.raise_error(F.concat(F.lit("rune outside the alphabet: "), r)).cast("int"))
    rows = F.transform("runes", lambda r, i: F.struct(i.alias("pos"), symbol(r).alias("idx"), F.get("gaps", i)["breaks"].alias("breaks"), F.get("gaps", i + 1)["marks"].alias("marks_after")))
    long = base.select("page", F.inline(rows))
    order = Window.partitionBy("page").orderBy("pos")
    lined = long.withColumn("line", 1 + F.sum("breaks").over(order))
    placed = lined.withColumn("col", F.row_number().over(Window.partitionBy("page", "line").orderBy("pos"))).select("page", "pos", "idx", "line", "col", "marks_after")
    printed = base.select("page", F.posexplode("gaps").alias("g", "gap")).select("page", (F.col("g") - 1).alias("anchor"), F.posexplode("gap.printed").alias("ord", "text"))
    leading = base.select("page", F.get("gaps", F.lit(0))["marks"].alias("leading_marks"))
    return placed, printed, leading


def read_solutions(spark: SparkSession, folder: str) -> DataFrame:
    """``file, text`` of the solution files; sections without one find no row."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def training_texts(spark: SparkSession, folders: list[tuple[str, str]]) -> DataFrame:
    """``o, text``: training texts ordered by kind, then path; ``folders`` are pairs of folder and file pattern, a kind each."""
    parts = [spark.read.text(f, wholetext=True, pathGlobFilter=p).select(F.concat(F.lit(f"{k}/"), F.col("_metadata.file_path")).alias("o"), F.col("value").alias("text")) for k, (f, p) in enumerate(folders)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def corpus_digest(paths: list[str]) -> str:
    """SHA-256 over names and bytes of a corpus's files in the order given; driver-side, as a running digest depends on order."""
    digest = hashlib.sha256()
    for path in map(Path, paths):
        digest.update(path.name.encode())
        digest.update(path.read_bytes())
    return digest.hexdigest()
