"""Drift checks: each names what it compared, so that a check over nothing does not pass."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeframe.functions.alphabet import CANON, N, PRIMES, RUNES, SPELLINGS, canon_of_runes, index_digest, spell
from runeframe.operators.runetext import first_mismatch
from runeframe.sources.transcriptions import corpus_digest

SCHEMA = "name string, passed boolean, detail string"


def check(name: str, rows: DataFrame, bad: Column, least: int = 1, exactly: int | None = None) -> DataFrame:
    """One row ``name, passed, detail``: no bad row among at least ``least`` (or exactly so many) compared ones."""
    figures = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("int")), F.lit(0)).alias("bad"))
    enough = F.col("n") == exactly if exactly is not None else F.col("n") >= least
    return figures.select(F.lit(name).alias("name"), ((F.col("bad") == 0) & enough).alias("passed"), F.format_string("%d compared, %d wrong", "n", "bad").alias("detail"))


def skipped(spark, name: str, why: str) -> DataFrame:  # noqa: ANN001
    """A check whose table is absent: neither passed nor failed."""
    return spark.createDataFrame([(name, None, f"skipped: {why}")], SCHEMA)


def alphabet_check(alphabet: DataFrame) -> DataFrame:
    """The table has 29 rows in order, with the runes and primes of the built-in one."""
    i = F.col("index")
    bad = (F.substring(F.lit(RUNES), i + 1, F.lit(1)) != F.col("rune")) | (F.get(F.array(*map(F.lit, PRIMES)), i) != F.col("prime"))
    return check("alphabet", alphabet, bad, exactly=N)


def spelling_check(alphabet: DataFrame) -> DataFrame:
    """Every alias spells to its own symbol alone."""
    aliases = alphabet.select("index", F.explode(F.split("translit", "/")).alias("alias"))
    return check("spelling", aliases, spell(F.col("alias")) != F.substring(F.lit(CANON), F.col("index") + 1, F.lit(1)), exactly=len(SPELLINGS) - 1)


def speller_check(pairs: DataFrame, least: int = 1) -> DataFrame:
    """``english, canon``: spelled English equals the printed runes."""
    return check("speller", pairs, spell(F.col("english")) != F.col("canon"), least)


def headline_check(sections: DataFrame, texts: DataFrame, least: int = 1) -> DataFrame:
    """Sections' texts start with their spelled headline: ``section, headline`` against ``section, canon``."""
    both = sections.where("headline <> ''").join(texts, "section")
    return check("headlines", both, ~F.startswith(F.col("canon"), spell(F.col("headline"))), least)


def span_check(page_runes: DataFrame, section_runes: DataFrame) -> DataFrame:
    """Runes of all pages are the runes of all sections: ``n`` on both sides."""
    sums = page_runes.agg(F.sum("n").alias("a")).join(section_runes.agg(F.sum("n").alias("b")))
    return check("spans", sums, F.col("a") != F.col("b"), exactly=1)


def sentence_check(sentences: DataFrame, transcription: DataFrame, key: str) -> DataFrame:
    """Two renderings (``key, pos, idx``) agree up to where the shorter ends."""
    found = first_mismatch(sentences, transcription, key)
    shorter = sentences.groupBy(key).agg(F.max("pos").alias("last"))
    both = found.join(shorter, key)
    return check("sentences", both, F.coalesce(F.col("at") <= F.col("last"), F.lit(False)))


def sequence_checks(runes: DataFrame, messages: DataFrame) -> DataFrame:
    """Checks of an archive's sequence table against its messages."""
    own = check("canon alphabet", runes, ~F.col("canon").rlike("^[a-z012]+$"))
    size = check("lengths", runes.where("n is not null"), F.col("n") != F.length("canon"))
    kinds = check("notations", runes, ~F.col("notation").isin("runic", "runic-joined", "numeric", "translit"))
    cited = runes.select("msg_id").distinct().join(messages.select(F.col("id").alias("msg_id"), F.lit(True).alias("there")).distinct(), "msg_id", "left")
    return report([own, size, kinds, check("messages cited", cited, F.col("there").isNull())])


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


@dataclass(frozen=True)
class Pins:
    """What a corpus is known to hold; a pin that is None leaves its check to compare without an expected number.

    ``invertible``: for sections whose text is the English under i -> a*i + b, the pair (a, b) that undoes it.
    ``gaps``: symbols by which a section's text goes on behind its last sentence.
    """

    digest: str | None = None
    unsolved_sections: tuple[str, ...] | None = None
    unsolved_length: int | None = None
    unsolved_digest: str | None = None
    printed_characters: int | None = None
    exact_sentences: int | None = None
    long_sentences: int | None = None
    headlines: int | None = None
    sentence_sections: int | None = None
    invertible: tuple[tuple[str, tuple[int, int]], ...] = ()
    gaps: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def read(path: str) -> Pins:
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        stated["invertible"] = tuple((k, tuple(v)) for k, v in stated.get("invertible", {}).items())
        stated["gaps"] = tuple(stated.get("gaps", {}).items())
        if stated.get("unsolved_sections") is not None:
            stated["unsolved_sections"] = tuple(stated["unsolved_sections"])
        return Pins(**stated)


def _equal(spark, name: str, found, pinned, shown: str | None = None) -> DataFrame:  # noqa: ANN001
    """A figure against its pin; without a pin the figure is shown and the check is skipped."""
    if pinned is None:
        return skipped(spark, name, f"no pin, found {shown or found}")
    return spark.createDataFrame([(name, found == pinned, f"{shown or found} (pinned {pinned})")], SCHEMA)


def _undone(canon: Column, by: tuple[int, int]) -> Column:
    a, b = by
    return F.translate(canon, CANON, "".join(CANON[(a * i + b) % N] for i in range(N)))


def corpus_checks(corpus, pins: Pins) -> DataFrame:  # noqa: ANN001
    """The nine checks of a loaded corpus: ``name, passed, detail``; a check whose table is absent is skipped.

    Every comparison states how many rows it compared, and where that number is pinned a vacuous
    comparison fails.
    """
    spark, texts = corpus.spark, corpus.texts()
    open_now = tuple(r[0] for r in corpus.of_status(False).select("section").collect())
    stream = corpus.unsolved().select("n", index_digest(F.col("canon")).alias("digest")).first()
    printed = corpus.printed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    digest = corpus_digest(corpus.places.files())
    checks = [
        _equal(spark, "corpus files", digest, pins.digest, digest[:16]),
        _equal(spark, "unsolved by status", open_now, pins.unsolved_sections, ", ".join(open_now)),
        _equal(spark, "unsolved length", stream["n"], pins.unsolved_length),
        _equal(spark, "unsolved digest", stream["digest"], pins.unsolved_digest, stream["digest"][:16]),
        _equal(spark, "printed characters", printed, pins.printed_characters),
    ]
    inverse = dict(pins.invertible)
    plain = F.col("canon")
    for section, by in inverse.items():
        plain = F.when(F.col("section") == section, _undone(F.col("canon"), by)).otherwise(plain)
    known = F.col("section").isin(*inverse) if inverse else F.lit(False)
    if corpus.sentences is None:
        checks += [skipped(spark, name, "no sentence table") for name in ("speller exact", "sentences")]
    else:
        solved = corpus.of_status(True).select("section")
        told = corpus.sentences.where("english <> ''").join(solved, "section").select("section", "english", canon_of_runes(F.col("runes")).alias("canon"))
        told = told.withColumn("plain", plain).withColumn("exact", known)
        right = F.when(F.col("exact"), spell(F.col("english")) == F.col("plain")).otherwise(F.length(spell(F.col("english"))) == F.length("canon"))
        expected = None if pins.exact_sentences is None or pins.long_sentences is None else pins.exact_sentences + pins.long_sentences
        checks.append(check("speller exact", told, ~right, exactly=expected))
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "canon"))), lambda r: r["canon"]), "")
        told = corpus.sentences.select("section", "ord", canon_of_runes(F.col("runes")).alias("canon")).groupBy("section").agg(ordered.alias("told"))
        gap = F.lit(0)
        for section, k in pins.gaps:
            gap = F.when(F.col("section") == section, k).otherwise(gap)
        both = told.join(texts, "section")
        off = ~F.startswith("canon", "told") | (F.col("n") - F.length("told") != gap)
        checks.append(check("sentences", both, off, exactly=pins.sentence_sections))
    runic = F.col("headline_form") == "runic"
    head = F.when(runic, canon_of_runes(F.col("headline"))).otherwise(spell(F.col("headline")))
    begun = corpus.sections.select("section", "headline", "headline_form").where((runic | known) & (F.col("headline") != "")).join(texts, "section")
    checks.append(check("headlines", begun, ~F.startswith(F.when(runic, F.col("canon")).otherwise(plain), head), exactly=pins.headlines))
    owned = corpus.pages.where("section <> ''").groupBy("section").agg(F.max_by("page", "ord").alias("last"))
    torn = corpus.sections.join(owned, "section").where(F.col("last") != F.col("last_page")).count()
    pages, sections = (corpus.texts(by).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for by in ("page", "section"))
    detail = f"{pages} runes on pages, {sections} in sections, {torn} sections end elsewhere"
    checks.append(spark.createDataFrame([("spans", pages == sections and not torn, detail)], SCHEMA))
    return report(checks)
