"""Queries of the notation extractors over message bodies, and of sequence search."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeframe.functions.alphabet import CANON, RUNES, SPELLINGS
from runeframe.operators import notation as NT
from runeframe.session import table


def _runs(spark, d, what):  # noqa: ANN001, ANN202
    found = NT.extract(table(spark, d, "messages"), "id", "body").where(F.col("notation") == what)
    return found.groupBy("id", "raw", "canon").agg(F.count(F.lit(1)).alias("times"))


def extract_runic(spark, d):  # noqa: ANN001, ANN201
    return _runs(spark, d, "runic")


def extract_joined(spark, d):  # noqa: ANN001, ANN201
    return _runs(spark, d, "runic-joined")


def extract_numeric(spark, d):  # noqa: ANN001, ANN201
    return _runs(spark, d, "numeric")


def extract_translit(spark, d):  # noqa: ANN001, ANN201
    return _runs(spark, d, "translit")


def extract_indexed(spark, d):  # noqa: ANN001, ANN201
    return NT.indexed(table(spark, d, "messages"), "id", "body")


def extract_counts(spark, d):  # noqa: ANN001, ANN201
    """Indexed runs per notation."""
    return extract_indexed(spark, d).groupBy("notation").agg(F.count(F.lit(1)).alias("found"))


_R = f"[{RUNES}]"
_RG = f"translate(regexp_replace(raw, '[^{RUNES}]', '', 'g'), '{RUNES}', '{CANON}')"
_MAP = "MAP {" + ", ".join(f"'{s}': '{CANON[i]}'" for s, i in SPELLINGS.items()) + "}"
_SPELL = "|".join(sorted(SPELLINGS, key=lambda s: (-len(s), s)))
_RUNIC = f"rn as (select id, raw, {_RG} canon, 0 k from (select id, unnest(regexp_extract_all(body, '{_R}{{2,}}')) raw from messages))"
_JOINED = f"""jn as (select id, raw, {_RG} canon, 1 k from (select id, unnest(regexp_extract_all(m, '{_R}(?:[-./ \\t]*{_R})*')) raw
   from (select id, unnest(regexp_extract_all(body, '[ᚠ-᛿]+(?:[-./ \\t]+[ᚠ-᛿]+)+')) m from messages)) where length({_RG}) >= 3)"""
# gaps and islands over the tiling of digit and other tokens
_NUMERIC = f"""tok as (select id, unnest(t) tok, unnest(range(len(t))) p from (select id, regexp_extract_all(body, '[0-9]+|[^0-9]+') t from messages where body is not null)),
 cls as (select id, p, tok, regexp_matches(tok, '^[0-9]') dig,
    regexp_full_match(tok, '[\\s\\x{{a0}}\\x{{2007}}\\x{{202f}},;:\\[\\]()|/-]+') and not regexp_matches(tok, '[\\n\\r|]') and not regexp_matches(tok, '[\\])][^\\[(]*[\\[(]') and (tok = '-' or not contains(tok, '-')) sep from tok),
 sg as (select *, coalesce(lag(not dig and not sep and ends_with(tok, '-')) over (partition by id order by p), false) signed from cls),
 ok as (select *, dig and not signed and length(tok) <= 2 and try_cast(tok as int) <= 28 good from sg),
 isl as (select *, sum((not good and not (not dig and sep))::int) over (partition by id order by p) g from ok),
 ed as (select id, g, min(p) filter (good) a, max(p) filter (good) b, count(*) filter (good) c from isl group by 1, 2),
 nu as (select e.id, string_agg(tok, '' order by p) raw, string_agg(case when dig then substring('{CANON}', tok::int + 1, 1) else '' end, '' order by p) canon, 2 k
    from ed e join isl i on i.id = e.id and i.g = e.g and p between a and b where c >= 4 group by e.id, e.g)"""
_TRANSLIT = f"""wt as (select id, unnest(t) tok, unnest(range(len(t))) p from (select id, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]+') t from messages where body is not null)),
 wc as (select id, p, tok, regexp_matches(tok, '^[A-Za-z]') wd, regexp_full_match(upper(tok), '{_SPELL}') good, lag(tok) over (partition by id order by p) gap, lag(tok, 2) over (partition by id order by p) prv from wt),
 wg as (select *, good and not coalesce(length(gap) = 1 and contains('-. /', gap) and regexp_full_match(upper(prv), '{_SPELL}'), false) fresh from wc where wd),
 wi as (select *, sum(fresh::int) over (partition by id order by p) g from wg where good),
 we as (select id, g, min(p) a, max(p) b, count(*) c, sum((length(tok) > 1)::int) mu, string_agg(({_MAP})[upper(tok)], '' order by p) canon, bool_or(not fresh and gap in ('-', '.')) pu from wi group by 1, 2),
 tl as (select e.id, string_agg(t.tok, '' order by t.p) raw, any_value(e.canon) canon, 3 k from we e join wt t on t.id = e.id and t.p between a and b where c >= 4 and (pu or mu >= 2 or (c >= 6 and mu >= 1)) group by e.id, e.g)"""


def _each(cte: str, name: str) -> str:
    return f"with {cte} select id, raw, canon, count(*) times from {name} group by 1, 2, 3"


_ALL = f"with {_RUNIC}, {_JOINED}, {_NUMERIC}, {_TRANSLIT}, al as (select * from rn union all select * from jn union all select * from nu union all select * from tl)"
_IDX = _ALL + ", ix as (select al.id msg_id, k, canon, length(canon)::int n, arg_min(raw, strpos(body, raw)) raw from al join messages on messages.id = al.id where length(canon) >= 3 group by 1, 2, 3 qualify row_number() over (partition by al.id, canon order by k) = 1)"
_NAMES = "['runic', 'runic-joined', 'numeric', 'translit'][k + 1]"
QUERIES = {"extract_runic": extract_runic, "extract_joined": extract_joined, "extract_numeric": extract_numeric, "extract_translit": extract_translit, "extract_counts": extract_counts, "extract_indexed": extract_indexed}
ORACLES = {
    "extract_runic": _each(_RUNIC, "rn"),
    "extract_joined": _each(_JOINED, "jn"),
    "extract_numeric": _each(_NUMERIC, "nu"),
    "extract_translit": _each(_TRANSLIT, "tl"),
    "extract_counts": _IDX + f" select {_NAMES} notation, count(*) as found from ix group by 1",
    "extract_indexed": _IDX + f" select msg_id, {_NAMES} notation, canon, n, substring(trim(raw), 1, 400) raw from ix",
}
