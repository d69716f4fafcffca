"""One consistent form for text that looks the same but differs in characters.

Two forms of a text:

* the *reading form* keeps what a reader sees: default-ignorable characters removed, no-break
  and fixed-width spaces mapped to the ordinary space, width forms and joined glyphs mapped to their
  plain letters, accents composed. Letters of several scripts that look alike are brought to one
  script word by word: to that of the word's letters which have no likeness, else to Latin, so that
  Russian and Greek words stay whole. Case, accents, raised and circled characters, ordinary spaces
  and line breaks stay.
* the *canonical form* is for comparison regardless of case and style: compatibility
  normalisation (composed), full case folding and whitespace runs as one space on top of it.

Equal reading forms imply equal canonical forms. Character tables are built from the Unicode
data of the standard library, except for the look-alike letters, which are stated.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeframe.session import cut_lineage

#: Letters of other scripts that look like Latin letters, and their likeness.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϳ": "J",
    # Armenian, Latin small forms
    "օ": "o", "ս": "u", "ɡ": "g", "ı": "i",
    # punctuation with the looks of the plain one
    "‐": "-", "‑": "-", "․": ".", "ꓸ": ".",
}

#: Fixed ranges: characters that show nothing (the default-ignorable property).
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))


@cache
def _characters() -> dict[int, str]:
    """Code point to its reading, look-alike letters apart."""
    table: dict[int, str] = {}
    for code in range(0x80, 0x10000):
        ch = chr(code)
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if tag in ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"):
            table[code] = unicodedata.normalize("NFKC", ch)
        elif tag == "<compat>":
            plain = unicodedata.normalize("NFKC", ch)
            joined = all(unicodedata.category(c)[0] == "L" for c in plain)
            if joined or plain in (" ", ".", "..", "...") or (len(plain) == 1 and unicodedata.category(plain)[0] == "P"):
                table[code] = plain
    for a, b in IGNORABLE:
        for code in range(a, b + 1):
            table[code] = ""
    for ch, plain in LOOK_ALIKES.items():
        if not ch.isalpha():
            table[ord(ch)] = plain
    return table


def _pattern(table: dict[int, str]) -> re.Pattern[str]:
    basic = "".join(re.escape(chr(code)) for code in sorted(table) if code < 0x10000)
    beyond = "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE if a >= 0x10000)
    return re.compile(f"[{basic}]|[{beyond}]")


@cache
def _tables() -> tuple[dict[int, str], re.Pattern[str]]:
    """Code point to its reading with every look-alike letter as its Latin one, and a pattern of the characters that have one."""
    table = {code: "".join(LOOK_ALIKES.get(c, c) for c in plain) for code, plain in _characters().items()}
    table |= {ord(ch): plain for ch, plain in LOOK_ALIKES.items()}
    return table, _pattern(table)


@cache
def _special() -> re.Pattern[str]:
    return _pattern(_characters())


ALIKE_LETTERS = re.compile(f"[{''.join(ch for ch in LOOK_ALIKES if ch.isalpha())}]")
WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")


@cache
def _script(ch: str) -> str:
    return unicodedata.name(ch, "").partition(" ")[0]


@cache
def _in_script(script: str) -> dict[int, str]:
    """Latin letters to their likeness in a script."""
    return {ord(plain): ch for ch, plain in LOOK_ALIKES.items() if _script(ch) == script}


def _one_script(m: re.Match[str]) -> str:
    """A word with its look-alike letters in one script."""
    word = m[0]
    if word.isascii() or not ALIKE_LETTERS.search(word):
        return word
    own = {_script(c) for c in unicodedata.normalize("NFD", word) if c not in LOOK_ALIKES and not c.isascii()} - {"LATIN", "COMBINING"}
    if not own:
        return "".join(LOOK_ALIKES.get(c, c) for c in word)
    return word.translate(_in_script(own.pop())) if len(own) == 1 else word


def reading_form(text: str) -> str:
    if text.isascii():
        return text
    if _special().search(text):
        text = text.translate(_characters())
    if ALIKE_LETTERS.search(text):
        text = WORD.sub(_one_script, text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def canonical_form(text: str) -> str:
    """Reading form, then NFKC, full case folding, NFKC again (folding can undo it), single spaces."""
    return _folded(reading_form(text))


def _folded(reading: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", reading).casefold()).split())


def _per_distinct(texts: pd.Series, form) -> list:  # noqa: ANN001
    """``form`` of each text, made once per distinct text of an Arrow batch; nulls stay null."""
    made = {t: form(t) for t in set(texts) if isinstance(t, str)}
    return [made.get(t) if isinstance(t, str) else None for t in texts]


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series(_per_distinct(texts, canonical_form), dtype=object)


def _two_forms(text: str) -> tuple[str, str]:
    reading = reading_form(text)
    return reading, _folded(reading)


@F.pandas_udf(T.StructType([T.StructField("reading", T.StringType()), T.StructField("canonical", T.StringType())]))
def _forms(texts: pd.Series) -> pd.DataFrame:
    pairs = _per_distinct(texts, _two_forms)
    return pd.DataFrame([p or (None, None) for p in pairs], columns=["reading", "canonical"], dtype=object)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _plain_fold(text: Column) -> Column:
    """Canonical form of an ASCII text."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))


def canonical(text: Column) -> Column:
    """Canonical form as a column; NULL for NULL, empty for texts that show nothing. ASCII texts never leave the JVM."""
    return F.coalesce(_canonical(F.when(~_is_ascii(text), text)), _plain_fold(text))


def formed(rows: DataFrame) -> DataFrame:
    """Hashes of each row's canonical form (c1), reading form (k1, k2) and text (t1, t2), and whether the text differs from its reading form.

    ``rows``: ``field, id, text``; texts that are null or show nothing are left out. Both forms come
    from one evaluation per text, and the narrow result is written once for whoever reads it.
    """
    text = F.col("text")
    both = _forms.asNondeterministic()(F.when(~_is_ascii(text), text))
    made = rows.select("field", F.col("id").cast("long").alias("id"), "text").where(text.isNotNull()).select("field", "id", "text", both.alias("f"))
    made = made.select("field", "id", "text", F.coalesce("f.reading", text).alias("form"), F.coalesce("f.canonical", _plain_fold(text)).alias("canonical")).where("canonical <> ''")
    form = F.col("form")
    hashes = [F.xxhash64("canonical").alias("c1"), F.xxhash64(form).alias("k1"), F.hash(form, F.lit("form")).alias("k2"), F.xxhash64(text).alias("t1"), F.hash(text, F.lit("text")).alias("t2")]
    return cut_lineage(made.select("field", "id", *hashes, (form != text).alias("variant")))


def look_alike_pairs(rows: DataFrame, salts: int = 16) -> DataFrame:
    """``field, id_a, id_b``: pairs of rows of one field with equal reading form and different characters.

    ``rows``: ``field, id, text``. Rows meet by canonical form, and the reading form decides. Null
    texts and texts that show nothing have no pairs; rows with exactly the same text are no pair. In
    every pair at least one text differs from its own reading form; only those rows (the variants)
    are matched against all rows. The large side is salted by id and the variants are repeated per
    salt, so one very common text does not end up in one task, and exact copies are never paired
    with each other. ``classes`` gives the same relation without expanding it.
    """
    keyed = formed(rows)
    key = ["field", "c1", "k1", "k2"]
    variants = keyed.where("variant").select(*key, F.col("id").alias("v_id"), F.col("t1").alias("v_t1"), F.col("t2").alias("v_t2"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    every = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    differs = (F.col("t1") != F.col("v_t1")) | (F.col("t2") != F.col("v_t2"))
    pairs = variants.join(every, [*key, "salt"]).where(differs & (~F.col("variant") | (F.col("v_id") < F.col("id"))))
    return pairs.select("field", F.least("v_id", "id").alias("id_a"), F.greatest("v_id", "id").alias("id_b"))


def classes(rows: DataFrame, salts: int = 16) -> DataFrame:
    """``field, id, class_id, n_rows, n_forms``: each row's class of equal canonical form, without listing pairs.

    ``class_id`` is the smallest id of the class, ``n_rows`` its size, ``n_forms`` its number of
    reading forms. Rows that are null or show nothing are in no class. A class is one row of partial
    sums until it is joined back, salted, to its members.
    """
    keyed = formed(rows)
    by_form = keyed.groupBy("field", "c1", "k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    summed = by_form.groupBy("field", "c1").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_forms"))
    spread = summed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = keyed.select("field", "c1", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    return every.join(spread, ["field", "c1", "salt"]).select("field", "id", "class_id", "n_rows", "n_forms")
