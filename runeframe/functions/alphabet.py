"""The 29-symbol alphabet as column functions.

A sequence of symbols is held in one of three forms: an array of indices, a rune string, or the
canonical string with one character of ``a-z012`` per index. The canonical string is the compact
one (a byte per symbol, sliceable by string functions) and the form most operators take.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 29
CANON = "abcdefghijklmnopqrstuvwxyz012"
#: The alphabet table, by index.
RUNES = "ᚠᚢᚦᚩᚱᚳᚷᚹᚻᚾᛁᛄᛇᛈᛉᛋᛏᛒᛖᛗᛚᛝᛟᛞᚪᚫᚣᛡᛠ"
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109)
TRANSLITERATIONS = ("F", "U/V", "TH", "O", "R", "C/K", "G", "W", "H", "N", "I", "J", "EO", "P", "X", "S/Z", "T", "B", "E", "M", "L", "NG/ING", "OE", "D", "A", "AE", "Y", "IA/IO", "EA")
EXTRA = {"Q": 5}

PRIMARY = tuple(t.split("/")[0] for t in TRANSLITERATIONS)
SPELLINGS = {alias: i for i, t in enumerate(TRANSLITERATIONS) for alias in t.split("/")} | EXTRA
#: Spellings of several letters, longest first, so that a greedy alternation takes the longest.
MULTI = tuple(sorted((s for s in SPELLINGS if len(s) > 1), key=lambda s: (-len(s), s)))
SINGLE = "".join(sorted(s for s in SPELLINGS if len(s) == 1))


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds letters of A to Z: those with one letter and that letter, and those with several.

    Made from the Unicode data for upper-cased text; white space of any kind becomes a blank.
    """
    one, plain, several = [], [], {}
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if ch.isspace():
            one.append(ch)
            plain.append(" ")
            continue
        letters = "".join(c for c in unicodedata.normalize("NFKD", ch).upper() if "A" <= c <= "Z")
        if len(letters) == 1:
            one.append(ch)
            plain.append(letters)
        elif letters and ch.upper() == ch:
            several[ch] = letters
    return "".join(one), "".join(plain), several


def alphabet(spark: SparkSession) -> DataFrame:
    """``index, prime, rune, translit``: 29 rows."""
    rows = [(i, PRIMES[i], RUNES[i], TRANSLITERATIONS[i]) for i in range(N)]
    return spark.createDataFrame(rows, "index int, prime int, rune string, translit string")


def spellings(spark: SparkSession) -> DataFrame:
    """``spelling, index``: every accepted spelling, aliases and extras included."""
    return spark.createDataFrame(sorted(SPELLINGS.items()), "spelling string, index int")


def has_rune(text: Column) -> Column:
    """Whether any character of the runic block occurs; wider than the 29."""
    return text.rlike("[\\u16A0-\\u16FF]")


def has_symbol(text: Column) -> Column:
    """Whether one of the 29 occurs; the block's single range is tested first, as it is the faster pattern."""
    return has_rune(text) & text.rlike(f"[{RUNES}]")


def _letters(text: Column) -> Column:
    """Upper-case letters A to Z and white space of the compatibility decomposition; inside the JVM throughout."""
    one, plain, several = _decompositions()
    upper = F.upper(text)
    parted = upper
    for ch, letters in several.items():
        parted = F.replace(parted, F.lit(ch), F.lit(letters))
    # ASCII texts have nothing to decompose, and few texts hold a character of several letters
    rare = upper.rlike("[" + "".join(several) + "]")
    decomposed = F.translate(F.when(rare, parted).otherwise(upper), one, plain)
    return F.regexp_replace(F.when(F.octet_length(text) == F.length(text), upper).otherwise(decomposed), r"[^A-Z\s]+", "")


def spell(text: Column) -> Column:
    """Canonical string of English text: greedy longest spelling inside each word.

    Digraphs do not form across white space; other characters are dropped first. Text that holds
    one of the 29 runes is refused (NULL), as is NULL; text without letters gives an empty string.
    """
    marked = F.regexp_replace(_letters(text), "(" + "|".join(MULTI) + ")", "<$1>")
    for s in MULTI:
        marked = F.replace(marked, F.lit(f"<{s}>"), F.lit(CANON[SPELLINGS[s]]))
    canon = F.translate(marked, SINGLE + " \t\n\x0b\x0c\r", "".join(CANON[SPELLINGS[s]] for s in SINGLE))
    return F.when(~has_symbol(text), canon)


def spell_runes(text: Column) -> Column:
    """English text as runes; NULL where ``spell`` gives NULL."""
    return runes_of(spell(text))


def canon_of_runes(runes: Column) -> Column:
    """Canonical string of the 29 runes in a text; other characters are skipped."""
    return F.translate(F.regexp_replace(runes, f"[^{RUNES}]", ""), RUNES, CANON)


def runes_of(canon: Column) -> Column:
    return F.translate(canon, CANON, RUNES)


def _checked(canon: Column, value: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("not a canonical string: "), canon))
    return F.when(canon.rlike("^[a-z012]*$"), value).when(canon.isNotNull(), bad)


def indices_of(canon: Column) -> Column:
    """Array of indices; a character outside the alphabet is an error."""
    return _checked(canon, F.transform(F.filter(F.split(canon, ""), lambda c: c != ""), lambda c: F.instr(F.lit(CANON), c) - 1))


def canon_of(indices: Column) -> Column:
    """Canonical string of indices; an index outside 0..28 is an error, nothing wraps."""
    letters = F.array(*map(F.lit, CANON))
    bad = F.exists(indices, lambda i: (i < 0) | (i >= N))
    return F.when(~bad, F.array_join(F.transform(indices, lambda i: F.get(letters, i)), "")).when(bad, F.raise_error(F.lit("index outside 0..28")))


def unspell(canon: Column, sep: str = "") -> Column:
    """Readable Latin: the primary spelling of each symbol."""
    latin = F.array(*map(F.lit, PRIMARY))
    return F.array_join(F.transform(indices_of(canon), lambda i: F.get(latin, i)), sep)


def prime_sum(canon: Column) -> Column:
    """Sum of the primes of a sequence."""
    primes = F.array(*map(F.lit, PRIMES))
    return F.aggregate(indices_of(canon), F.lit(0).cast("long"), lambda a, i: a + F.get(primes, i))


def index_digest(canon: Column) -> Column:
    """SHA-256 over one byte per index."""
    return F.sha2(F.unhex(F.array_join(F.transform(indices_of(canon), lambda i: F.lpad(F.hex(i), 2, "0")), "")), 256)
