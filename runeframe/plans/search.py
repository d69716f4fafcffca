"""Queries of the archive search over the message table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runeframe.operators import search as S
from runeframe.operators import textindex as TI
from runeframe.session import cut_lineage, shared_place, table
from runeframe.sources import indexstore

AND_QUERY, OR_QUERY, NOT_QUERY = "running key", "histogram OR lantern OR anneal*", "lattice NOT cipher"
FALLBACK_QUERY = "window ( scoring"
PHRASE_QUERY, NEAR_QUERY = '"window scoring"', "NEAR(fresh repeated, 12)"
SEQUENCE = "ᛋᛏᚱ"
LIMIT, SHOWN = 50, 40


def messages(spark, d):  # noqa: ANN001, ANN201
    return S.archive(table(spark, d, "messages"))


_STORES: dict[tuple[str, str], indexstore.SearchStore] = {}


def store(spark, d):  # noqa: ANN001, ANN201
    """The search tables of a folder's messages, written once per application to the shared folder and read by every search."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORES:
        place = shared_place(spark, "search")
        indexstore.write_search(messages(spark, d), place)
        _STORES[key] = indexstore.SearchStore(spark, place)
    return _STORES[key]


def tokenize_postings(spark, d):  # noqa: ANN001, ANN201
    return TI.postings(messages(spark, d), "id", "body")


def _hits(query):  # noqa: ANN001, ANN202
    def run(spark, d):  # noqa: ANN001, ANN202
        return store(spark, d).text_hits(query, limit=LIMIT).select("id", F.round("score", 6).alias("score"))

    return run


def _match(query):  # noqa: ANN001, ANN202
    return lambda spark, d: store(spark, d).matching(query)


def _ranked_hits(spark, d, query, limit):  # noqa: ANN001, ANN202
    """Hits with their rank; at most ``limit`` rows, made once."""
    hits = store(spark, d).text_hits(query, limit=limit)
    return cut_lineage(hits.select("id", "channel", "seq", F.row_number().over(Window.orderBy("score", "id")).alias("rank")))


def context_docs_6h(spark, d):  # noqa: ANN001, ANN201
    rows = messages(spark, d).where("channel is not null and seq is not null")
    return TI.neighbourhoods(rows).select("id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n"))


def context_blocks(spark, d):  # noqa: ANN001, ANN201
    blocks = store(spark, d).context_blocks(_ranked_hits(spark, d, AND_QUERY, LIMIT), 2)
    return blocks.select("channel", "first_seq", "last_seq", "rank", F.size("messages").alias("n"), F.size(F.filter("messages", lambda x: x["matched"])).alias("hits"))


def search_conversations(spark, d):  # noqa: ANN001, ANN201
    """The messages of a search's conversations as they are shown, bodies cut after a few characters."""
    blocks = store(spark, d).context_blocks(_ranked_hits(spark, d, AND_QUERY, LIMIT), 2, SHOWN)
    return blocks.select("channel", "first_seq", "rank", F.inline("messages")).drop("note")


def rune_search_longest(spark, d):  # noqa: ANN001, ANN201
    return S.sequence_hits(messages(spark, d), table(spark, d, "runes"), SEQUENCE, limit=LIMIT).select("id", "n", "notation", "note")


def filter_channel_since(spark, d):  # noqa: ANN001, ANN201
    return messages(spark, d).where(S.Filters(channel="general-solving", since="2019-06").condition()).select("id", "ts")


def filter_author_until(spark, d):  # noqa: ANN001, ANN201
    return messages(spark, d).where(S.Filters(author="LARK", until="2018").condition()).select("id", "author", "ts")


def channel_summary(spark, d):  # noqa: ANN001, ANN201
    return S.channel_summary(messages(spark, d), table(spark, d, "channels"))


def search_json(spark, d):  # noqa: ANN001, ANN201
    hits = _ranked_hits(spark, d, PHRASE_QUERY, S.LIMIT)
    return S.result_json(store(spark, d).context_blocks(hits, 2), PHRASE_QUERY, hits)


_TS = """strftime(coalesce(try_strptime(trim(ts), '%Y-%m-%d %H:%M'), try_strptime(trim(ts), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(ts), '%Y-%m-%dT%H:%M'),
   try_strptime(trim(ts), '%Y-%m-%dT%H:%M:%S'), try_strptime(trim(ts), '%-m/%-d/%Y %-I:%M %p')), '%Y-%m-%d %H:%M')"""
_AR = f"ar as (select channel, seq, id, author, body, {_TS} ts from messages qualify row_number() over (partition by channel, seq order by id) = 1)"


def _tok(text: str) -> str:
    return f"(' ' || trim(regexp_replace(lower(strip_accents({text})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"


_MS = f"ms as (select id, channel, seq, ts, {_tok('body')} tk from ar where body is not null)"
_CTX = """cx as (select a.id, string_agg(coalesce(b.body, ''), chr(10) order by b.seq) as text from ar a join ar b on a.channel = b.channel and b.seq between a.seq - 2 and a.seq + 2
   and (a.seq = b.seq or abs(epoch(strptime(a.ts, '%Y-%m-%d %H:%M')) - epoch(strptime(b.ts, '%Y-%m-%d %H:%M'))) <= 21600) group by 1)"""


def _count(p: str, prefix: bool) -> str:
    end = "" if prefix else " "
    return f"((length(tk2) - length(replace(tk2, ' {p}{end}', ''))) / {len(p) + 1 + len(end)})"


def _ranked(phrases: list[tuple[str, bool]], hit: str) -> str:
    """Terms here never follow themselves directly, but blanks are doubled so that neighbours do not share one."""
    tf = ", ".join(f"{_count(p, x)} tf{i}" for i, (p, x) in enumerate(phrases))
    df = ", ".join(f"sum((tf{i} > 0)::int) df{i}" for i in range(len(phrases)))
    sc = " + ".join(f"greatest(ln(greatest((n - df{i} + 0.5) / (df{i} + 0.5), 1e-300)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(phrases)))
    return f"""cd as (select id, tk, replace(tk, ' ', '  ') tk2, case when trim(tk) = '' then 0 else length(tk) - length(replace(tk, ' ', '')) - 1 end dl from (select id, {_tok('text')} tk from cx)),
      ct as (select id, dl, {hit.replace('{t}', 'tk')} hit, {tf} from cd), fg as (select count(*) n, avg(dl) av, {df} from ct),
      rk as (select ct.id, -({sc}) score from ct, fg where hit), ht as (select rk.id, score from rk join ms using (id) where {hit.replace('{t}', 'ms.tk')} order by score, id limit {LIMIT})"""


def _rank_sql(phrases, hit):  # noqa: ANN001, ANN202
    return f"with {_AR}, {_MS}, {_CTX}, {_ranked(phrases, hit)} select id, round(score, 6) score from ht"


_AND = ([("running", False), ("key", False)], "contains({t}, ' running ') and contains({t}, ' key ')")
_OR = ([("histogram", False), ("lantern", False), ("anneal", True)], "(contains({t}, ' histogram ') or contains({t}, ' lantern ') or contains({t}, ' anneal'))")
_NOT = ([("lattice", False)], "contains({t}, ' lattice ') and not contains({t}, ' cipher ')")
_FALLBACK = ([("window", False), ("scoring", False)], "contains({t}, ' window ') and contains({t}, ' scoring ')")
_NEAR = "regexp_matches({t}, ' fresh (?:[^ ]+ ){0,12}repeated | repeated (?:[^ ]+ ){0,12}fresh ')"
QUERIES = {
    "tokenize_postings": tokenize_postings,
    "bm25_and": _hits(AND_QUERY),
    "bm25_or_prefix": _hits(OR_QUERY),
    "bm25_not": _hits(NOT_QUERY),
    "bm25_fallback": _hits(FALLBACK_QUERY),
    "phrase_match": _match(PHRASE_QUERY),
    "near_match": _match(NEAR_QUERY),
    "context_docs_6h": context_docs_6h,
    "context_blocks": context_blocks,
    "rune_search_longest": rune_search_longest,
    "filter_channel_since": filter_channel_since,
    "filter_author_until": filter_author_until,
    "channel_summary": channel_summary,
    "search_conversations": search_conversations,
    "search_json": search_json,
}
ORACLES = {
    "tokenize_postings": f"with {_AR}, {_MS} select id, term, count(*) tf from (select id, unnest(string_split(trim(tk), ' ')) term from ms where trim(tk) <> '') group by 1, 2",
    "bm25_and": _rank_sql(*_AND),
    "bm25_or_prefix": _rank_sql(*_OR),
    "bm25_not": _rank_sql(*_NOT),
    "bm25_fallback": _rank_sql(*_FALLBACK),
    "phrase_match": f"with {_AR}, {_MS} select id from ms where contains(tk, ' window scoring ')",
    "near_match": f"with {_AR}, {_MS} select id from ms where {_NEAR.replace('{t}', 'tk')}",
    "context_docs_6h": f"with {_AR}, {_CTX} select id, md5(text) digest, length(text)::int n from cx",
    "context_blocks": f"""with {_AR}, {_MS}, {_CTX}, {_ranked(*_AND)}, hr as (select ht.id, channel, seq, row_number() over (order by score, ht.id) r from ht join ar using (id)),
      wt as (select distinct channel, seq + unnest([-2, -1, 0, 1, 2]) seq from hr), rw as (select ar.channel, ar.seq, ar.id, ar.seq - row_number() over (partition by ar.channel order by ar.seq) g from wt join ar on ar.channel = wt.channel and ar.seq = wt.seq)
      select rw.channel, min(rw.seq)::int first_seq, max(rw.seq)::int last_seq, any_value(b.r)::int as rank, count(*)::int n, count(hr.id)::int hits from rw left join hr on hr.id = rw.id join (select channel, min(r) r from hr group by 1) b on b.channel = rw.channel group by rw.channel, g""",
    "search_conversations": f"""with {_AR}, {_MS}, {_CTX}, {_ranked(*_AND)}, hr as (select ht.id, channel, seq, row_number() over (order by score, ht.id) r from ht join ar using (id)),
      wt as (select distinct channel, seq + unnest([-2, -1, 0, 1, 2]) seq from hr), rw as (select ar.channel, ar.seq, ar.id, ar.ts, ar.seq - row_number() over (partition by ar.channel order by ar.seq) g from wt join ar on ar.channel = wt.channel and ar.seq = wt.seq)
      select rw.channel, (min(rw.seq) over (partition by rw.channel, g))::int first_seq, b.r::int as rank, rw.seq, m.line, rw.ts, m.author, m.pinned, hr.id is not null as matched, substring(m.body, 1, {SHOWN}) body, coalesce(length(m.body) > {SHOWN}, false) truncated
      from rw join messages m on m.id = rw.id left join hr on hr.id = rw.id join (select channel, min(r) r from hr group by 1) b on b.channel = rw.channel""",
    "rune_search_longest": f"""with {_AR} select a.id, max(coalesce(n, length(canon)))::int n, arg_max(notation, struct_pack(n := coalesce(n, length(canon)), i := -r.id)) notation,
      arg_max(notation || ': ' || substring(regexp_replace(trim(raw), '[\\x{{09}}-\\x{{0d}}\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), 1, 100), struct_pack(n := coalesce(n, length(canon)), i := -r.id)) note from runes r join ar a on a.id = r.msg_id
      where contains(canon, 'pqe') group by 1 order by n desc, a.id limit {LIMIT}""",
    "filter_channel_since": f"with {_AR} select id, ts from ar where channel = 'general-solving' and ts >= '2019-06'",
    "filter_author_until": f"with {_AR} select id, author, ts from ar where contains(lower(author), 'lark') and ts <= '2018' || chr(65535)",
    "channel_summary": f"with {_AR} select c.channel, count(ar.id) n, min(ts) first_ts, max(ts) last_ts from (select distinct channel from channels) c left join ar on ar.channel = c.channel group by 1",
}
