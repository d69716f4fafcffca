"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.operators.packed import Packing, split_packed
from runeframe.session import table

#: Fixed words that announce a packed body.
LEAD = r"(?i)[\s\u200b\ufeff]*(?:keys|cribs|pages|tags|primes)\s*[:=]"
#: Rune indices are known whole values of a number list, with and without a leading zero.
INDICES = (*map(str, range(29)), *(f"0{i}" for i in range(10)))
#: Bound on the known values sent to every task: an automaton of so many values takes some hundred MB.
MAX_KNOWN = 200_000
NUMBERS = Packing(other_than_digits=True, known=INDICES)


def _known(values: DataFrame) -> tuple[str, ...]:
    """A column of known whole values on the driver, whose number is checked before they go to every task."""
    name = values.columns[0]
    rows = values.where(F.col(name).isNotNull()).distinct().limit(MAX_KNOWN + 1).collect()
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known values")
    return tuple(sorted(r[0] for r in rows))


def headlines(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Known whole values of bodies: the section headlines, a fixed table of a few rows."""
    return _known(table(spark, sf_dir, "sections").select("headline"))


def methods(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Known terms: the methods of the log and the ciphers of the sections, a vocabulary of some dozens."""
    logged = table(spark, sf_dir, "experiments").select(F.lower(F.trim("method")).alias("term"))
    return _known(logged.unionAll(table(spark, sf_dir, "sections").select(F.lower(F.trim("cipher")))))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = split_packed(table(spark, sf_dir, "runes").where("notation = 'numeric'"), "id", "raw", NUMBERS)
    bodies = table(spark, sf_dir, "messages").where(F.col("body").rlike(LEAD.replace("(?i)", "(?iU)^")))
    lists = split_packed(bodies, "id", "body", Packing(lead=LEAD, known=headlines(spark, sf_dir)))
    return numbers.select(F.lit("runes.raw").alias("field"), "id", "pos", "value").unionAll(lists.select(F.lit("messages.body").alias("field"), "id", "pos", "value"))


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists in single words, but terms of several words whole: white space separates too, and only the dictionary protects it."""
    bodies = table(spark, sf_dir, "messages").where(F.col("body").rlike(LEAD.replace("(?i)", "(?iU)^")))
    return split_packed(bodies, "id", "body", Packing(delimiters=Packing.delimiters + " ", lead=LEAD, known=methods(spark, sf_dir)))


_END = r"[ ]*(?:[,;|/\t\n\r]|$)"
_ITEM = rf"""[ ]*"(?:[^"\\]|""|\\.)*"{_END}|[ ]*'(?:[^'\\]|''|\\.)*'{_END}|[ ]*“[^”]*”{_END}|[^,;|/\t\n\r]*(?:[,;|/\t\n\r]|$)""".replace("'", "''")
_LEAD = r"(?i)^\s*(keys|cribs|pages|tags|primes)\s*[:=]"
P6_SQL = rf"""
with nums as (select id, unnest(v) as value, unnest(range(1, len(v) + 1))::int as pos from (select id, regexp_extract_all(raw, '[0-9]+') v from runes where notation = 'numeric')),
b as (select id, regexp_extract_all(regexp_replace(body, '{_LEAD}', ''), '{_ITEM}') v from messages where regexp_matches(body, '{_LEAD}')),
c as (select id, list_filter(list_transform(v, lambda x: trim(regexp_replace(x, '[,;|/\t\n\r]$', ''))), lambda x: x <> '') v from b),
u as (select id, list_transform(v, lambda x: case when length(x) > 1 and x[1] = '"' and x[-1] = '"' then replace(replace(x[2:-2], '""', '"'), '\"', '"')
   when length(x) > 1 and x[1] = '''' and x[-1] = '''' then replace(replace(x[2:-2], '''''', ''''), '\''', '''')
   when length(x) > 1 and x[1] = '“' and x[-1] = '”' then x[2:-2] else x end) v from c)
select 'runes.raw' as field, id, pos, value from nums union all
select 'messages.body', id, unnest(range(1, len(v) + 1))::int as pos, unnest(v) as value from u
"""
QUERIES = {"p6_found": p6_found, "p6_terms": p6_terms}
ORACLES = {"p6_found": P6_SQL}
