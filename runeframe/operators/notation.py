"""Rune sequences cited in prose, in four notations, as one canonical string.

Each notation is one linear pattern whose matches are the maximal runs, so extraction is a
projection: no tokens are exploded and nothing is shuffled. The driver-side reader of a query
sequence is stricter than the extractors: it refuses what it cannot read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeframe.functions.alphabet import CANON, N, RUNES, SPELLINGS

#: Shortest runs by notation, shortest run that is indexed, longest raw text kept.
MIN_RUNIC, MIN_JOINED, MIN_NUMERIC, MIN_TRANSLIT, MIN_INDEXED, MAX_RAW = 2, 3, 4, 4, 3, 400
NOTATIONS = ("runic", "runic-joined", "numeric", "translit")

_BLOCK = r"[ᚠ-᛿]"
_SPELLING = "(?i:" + "|".join(sorted(SPELLINGS, key=lambda s: (-len(s), s))) + ")(?![A-Za-z])"
_DIGITS = "(?:[01]?[0-9]|2[0-8])(?![0-9])"
# white space but line ends; opening brackets may only come before closing ones
_GAP = r"(?:-|[\s,;:/\[(&&[^\n\r]]*+[\s,;:/\])&&[^\n\r]]*+)"

# cheap look-aheads come first, so that most positions fail on one character
RUNIC = f"((?={_BLOCK})[{RUNES}]{{{MIN_RUNIC},}})"
JOINED = rf"({_BLOCK}+(?:[-./ \t]+{_BLOCK}+)+)"
FRAGMENT = rf"((?={_BLOCK})[{RUNES}](?:[-./ \t]*[{RUNES}])*)"
NUMERIC = rf"(?U)((?=[0-9])(?<![0-9])(?<![^0-9]-){_DIGITS}(?:{_GAP}{_DIGITS}){{{MIN_NUMERIC - 1},}})"
TRANSLIT = rf"((?=[A-Za-z]{{1,3}}[-. /][A-Za-z]{{1,3}}[-. /])(?<![A-Za-z]){_SPELLING}(?:[-. /]{_SPELLING}){{{MIN_TRANSLIT - 1},}})"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _runs(notation: str, raws: Column, canon) -> Column:  # noqa: ANN001
    return F.transform(raws, lambda r: F.struct(F.lit(notation).alias("notation"), r.alias("raw"), canon(r).alias("canon")))


def _glyphs(raw: Column) -> Column:
    return F.translate(F.regexp_replace(raw, f"[^{RUNES}]", ""), RUNES, CANON)


def _numbers(raw: Column) -> Column:
    letters = F.array(*map(F.lit, CANON))
    return F.array_join(F.transform(_all(raw, "([0-9]+)"), lambda t: F.get(letters, t.cast("int"))), "")


def _spelled(raw: Column) -> Column:
    table = F.create_map(*(F.lit(x) for s, i in SPELLINGS.items() for x in (s, CANON[i])))
    return F.array_join(F.transform(_all(F.upper(raw), "([A-Z]+)"), lambda t: F.element_at(table, t)), "")


def _credible(raw: Column) -> Column:
    """A run held together by blanks or slashes alone needs spellings of several letters."""
    words = _all(raw, "([A-Za-z]+)")
    multi = F.size(F.filter(words, lambda w: F.length(w) > 1))
    return raw.rlike("[-.]") | (multi >= 2) | ((F.size(words) >= 6) & (multi >= 1))


def runs(text: Column) -> Column:
    """Array of ``notation, raw, canon`` in extractor order, then position; empty for NULL."""
    joined = F.flatten(F.transform(_all(text, JOINED), lambda m: F.filter(_all(m, FRAGMENT), lambda f: F.length(_glyphs(f)) >= MIN_JOINED)))
    runic = text.rlike(_BLOCK)
    none = F.array().cast("array<string>")
    found = F.concat(
        _runs("runic", F.when(runic, _all(text, RUNIC)).otherwise(none), _glyphs),
        _runs("runic-joined", F.when(runic, joined).otherwise(none), _glyphs),
        _runs("numeric", _all(text, NUMERIC), _numbers),
        _runs("translit", F.filter(_all(text, TRANSLIT), _credible), _spelled),
    )
    return F.coalesce(found, F.array().cast("array<struct<notation:string,raw:string,canon:string>>"))


def extract(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, notation, raw, canon``: every run of every text."""
    return messages.select(F.col(id_col).alias("id"), F.inline(runs(F.col(text_col))))


def indexed(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``msg_id, notation, raw, canon, n``: runs worth indexing, a canon once per message, the first extractor's.

    A message's runs are one array, so the repetition test stays inside the row.
    """
    several = F.filter(runs(F.col(text_col)), lambda r: F.length(r["canon"]) >= MIN_INDEXED)
    once = messages.select(F.col(id_col).alias("msg_id"), several.alias("runs")).select(
        "msg_id", F.inline(F.filter("runs", lambda r, i: ~F.exists(F.slice("runs", F.lit(1), i), lambda e: e["canon"] == r["canon"])))
    )
    return once.select("msg_id", "notation", F.substring(F.trim("raw"), 1, MAX_RAW).alias("raw"), "canon", F.length("canon").alias("n"))


class UnreadableQuery(ValueError):
    """A query that is no sequence, or could be read in two ways."""


def canonical_query(query: str) -> tuple[str, str]:
    """``(canon, notation)`` of a query sequence; refuses foreign runes, mixtures, signs and unseparated digits."""
    block = re.findall(r"[ᚠ-᛿]", query)
    latin, digits = re.findall(r"[A-Za-z]+", query), re.findall(r"[0-9]+", query)
    if block:
        if foreign := sorted(set(block) - set(RUNES)):
            raise UnreadableQuery(f"{''.join(foreign)} is not among the {N} runes")
        if latin or digits:
            raise UnreadableQuery(f"{query!r} mixes runes with another notation")
        return "".join(CANON[RUNES.index(c)] for c in block), "runic"
    parts = [p for p in re.split(r"[\s,;:\[\]()\-|/]+", query) if p]
    if parts and all(p.isascii() and p.isdigit() for p in parts):
        signed = re.search(r"(?<![0-9])-[0-9]", query)
        if len(parts) < 2 or signed or any(len(p) > 2 or int(p) >= N for p in parts):
            raise UnreadableQuery(f"{query!r} is not two or more separated indices of 0 to {N - 1}")
        return "".join(CANON[int(p)] for p in parts), "numeric"
    if latin and all(w.upper() in SPELLINGS for w in latin):
        if digits:
            raise UnreadableQuery(f"{query!r} mixes spellings with digits")
        return "".join(CANON[SPELLINGS[w.upper()]] for w in latin), "translit"
    raise UnreadableQuery(f"{query!r} reads as no sequence: give runes, separated indices or separated spellings")


def canonical_query_column(query: Column) -> Column:
    """``struct<canon, notation>`` of a column of queries, NULL where the driver-side reader refuses."""
    block, latin, digit = query.rlike(_BLOCK), query.rlike("[A-Za-z]"), query.rlike("[0-9]")
    foreign = F.regexp_replace(query, f"[{RUNES}]", "").rlike(_BLOCK)
    runic = F.when(block & ~foreign & ~latin & ~digit, F.struct(_glyphs(query).alias("canon"), F.lit("runic").alias("notation")))
    separators = r"[\s,;:\[\]()\-|/]"
    listed = query.rlike(rf"(?U)^{separators}*{_DIGITS}(?:{separators}+{_DIGITS})+{separators}*$") & ~query.rlike("(?<![0-9])-[0-9]")
    numeric = F.when(listed, F.struct(_numbers(query).alias("canon"), F.lit("numeric").alias("notation")))
    words = _all(query, "([A-Za-z]+)")
    known = (F.size(words) > 0) & F.forall(words, lambda w: F.upper(w).isin(*SPELLINGS))
    translit = F.when(~block & ~digit & known, F.struct(_spelled(query).alias("canon"), F.lit("translit").alias("notation")))
    return F.coalesce(runic, numeric, translit)
