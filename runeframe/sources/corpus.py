"""A transcribed book as tables and views: pages, sections, sentences and the runes between them.

The views are lazy DataFrames over the loaded tables; a corpus is loaded once per application and
set of places. Section ids are text, so ``2.1`` and ``2.10`` differ.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.functions import alphabet as A
from runeframe.operators.runetext import sections_by_offset
from runeframe.sources import transcriptions as T

ALPHABET = "index int, prime int, rune string, transliteration string"
SENTENCES = "sentence_id string, section string, runes string, english string"
UNSOLVED = "unsolved"


@dataclass(frozen=True)
class Places:
    """Where the parts of a corpus lie; a sentence table or a folder of solutions may be absent."""

    alphabet: str
    pages: str
    sections: str
    sentences: str
    transcription: str
    solutions: str

    @staticmethod
    def under(folder: str, alphabet: str) -> Places:
        """The usual names inside a book's folder."""
        return Places(alphabet, *(os.path.join(folder, name) for name in ("pages.csv", "sections.csv", "sentences.csv", "transcription", "solutions")))

    def files(self) -> list[str]:
        """Files in the order of the digest: the tables, then transcriptions and solutions by name."""
        tables = [p for p in (self.alphabet, self.pages, self.sections, self.sentences) if os.path.exists(p)]
        inside = [os.path.join(d, n) for d in (self.transcription, self.solutions) if os.path.isdir(d) for n in sorted(os.listdir(d))]
        return tables + inside


class Corpus:
    """The tables of a book, and views of them."""

    def __init__(self, spark: SparkSession, places: Places) -> None:
        self.spark, self.places = spark, places

    def _ordered(self, path: str, schema: str) -> DataFrame:
        """A table with its file order as ``ord``; a file with quoted line ends is one partition, read in order."""
        return T.read_csv(self.spark, path, schema).withColumn("ord", F.monotonically_increasing_id())

    @cached_property
    def alphabet(self) -> DataFrame:
        return T.read_csv(self.spark, self.places.alphabet, ALPHABET).withColumnRenamed("transliteration", "translit")

    @cached_property
    def pages(self) -> DataFrame:
        return self._ordered(self.places.pages, T.PAGES)

    @cached_property
    def sections(self) -> DataFrame:
        return self._ordered(self.places.sections, T.SECTIONS)

    @cached_property
    def sentences(self) -> DataFrame | None:
        return self._ordered(self.places.sentences, SENTENCES) if os.path.exists(self.places.sentences) else None

    @cached_property
    def _parsed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return T.parse_pages(T.read_pages(self.spark, self.places.transcription))

    @cached_property
    def runes(self) -> DataFrame:
        """Rune rows of all pages with page order and section."""
        rows = self._parsed[0].join(self.pages.select("page", F.col("ord").alias("page_ord")), "page")
        starts = self.sections.select(F.col("first_page").alias("page"), "first_rune", "section")
        return sections_by_offset(rows, F.col("page_ord"), starts)

    @property
    def printed(self) -> DataFrame:
        """Printed matter of all pages."""
        return self._parsed[1]

    def texts(self, by: str = "section") -> DataFrame:
        """``section`` (or ``page``), ``canon``, ``n``: the text of each, empty ones as empty texts."""
        rows = F.array_sort(F.collect_list(F.struct("page_ord", "pos", "idx")))
        found = self.runes.groupBy(by).agg(A.canon_of(F.transform(rows, lambda r: r["idx"])).alias("canon"))
        whole = (self.sections if by == "section" else self.pages).select(by, "ord").join(found, by, "left")
        return whole.withColumn("canon", F.coalesce("canon", F.lit(""))).withColumn("n", F.length("canon"))

    def _one(self, rows: DataFrame, kind: str, value: str) -> DataFrame:
        if rows.isEmpty():
            raise KeyError(f"no {kind} {value!r}")
        return rows

    def section(self, section: str) -> DataFrame:
        """The row of a section; an unknown one is an error."""
        return self._one(self.sections.where(F.col("section") == section), "section", section)

    def page(self, page: str) -> DataFrame:
        return self._one(self.pages.where(F.col("page") == page), "page", page)

    def pages_of(self, section: str) -> DataFrame:
        """The pages a section owns, in order."""
        self.section(section)
        return self.pages.where(F.col("section") == section).orderBy("ord")

    def sentences_of(self, section: str) -> DataFrame:
        if self.sentences is None:
            raise FileNotFoundError(self.places.sentences)
        return self.sentences.where(F.col("section") == section).orderBy("ord")

    def pages_in_channel(self, channel: str) -> DataFrame:
        """The pages a channel talks about."""
        return self.pages.where(F.col("discord_channel") == channel).orderBy("ord")

    def of_status(self, solved: bool) -> DataFrame:
        is_open = F.col("status") == UNSOLVED
        return self.sections.where(~is_open if solved else is_open).orderBy("ord")

    def unsolved(self) -> DataFrame:
        """One row ``canon, n``: the texts of the unsolved sections, one after the other."""
        open_ = self.texts().join(self.of_status(False).select("section"), "section")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "canon"))), lambda r: r["canon"]), "")
        return open_.agg(joined.alias("canon")).withColumn("n", F.length("canon"))

    def solutions(self) -> DataFrame:
        """``section, text``: solution texts; null for sections without one."""
        files = T.read_solutions(self.spark, self.places.solutions)
        named = self.sections.select("section", F.element_at(F.split("solution_file", "/"), -1).alias("file"))
        return named.join(files, "file", "left").select("section", "text")


    def training(self, before: list[tuple[str, str]] = (), after: list[tuple[str, str]] = ()) -> DataFrame:
        """``o, canon``: the spelled training texts in order, for ``fitness.model(..., order="o")``.

        First the files of ``before`` (pairs of folder and file pattern, a kind each, by path), then
        the English sentences of the solved sections in their order, then the files of ``after``.
        Texts that hold runes are left out.
        """
        parts = []
        for rank, folders in (("0", before), ("2", after)):
            if folders:
                parts.append(T.training_texts(self.spark, list(folders)).select(F.concat(F.lit(rank + "/"), "o").alias("o"), "text"))
        if self.sentences is not None:
            told = self.sentences.where("english <> ''").join(self.of_status(True).select("section"), "section")
            parts.append(told.select(F.format_string("1/%019d", "ord").alias("o"), F.col("english").alias("text")))
        if not parts:
            raise FileNotFoundError("no training texts")
        return reduce(DataFrame.unionAll, parts).select("o", A.spell(F.col("text")).alias("canon")).where("canon is not null")


_LOADED: dict[tuple[str, Places], Corpus] = {}


def load(spark: SparkSession, places: Places) -> Corpus:
    """The corpus of these places, one per application."""
    return _LOADED.setdefault((spark.sparkContext.applicationId, places), Corpus(spark, places))


def base60(groups: Column, digits: str) -> Column:
    """Two-character groups of digits to base 60 as an array of values; a character that is no digit gives null in its place."""
    if len(digits) != 60 or len(set(digits)) != 60:
        raise ValueError("base 60 needs 60 different digits")
    place = lambda c: F.when(F.instr(F.lit(digits), c) > 0, F.instr(F.lit(digits), c) - 1)
    return F.transform(groups, lambda g: place(F.substring(g, 1, 1)) * 60 + place(F.substring(g, 2, 1)))
