"""Queries of rune rows, exports, the log and the drift checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runeframe.functions import alphabet as A
from runeframe.functions.times import parse_minute, spell_minute
from runeframe.operators import runetext as R
from runeframe.operators import verify as V
from runeframe.plans.search import _AR, messages
from runeframe.session import table
from runeframe.sources import exports, explog
from runeframe.sources.corpus import UNSOLVED
from runeframe.sources.transcriptions import parse_pages

FILE_ROWS = 100_000
TERM = "annealing"
LEAVES = 40


def _parsed(spark, d):  # noqa: ANN001, ANN202
    """Rune rows, printed matter and leading marks of every cited text that holds a rune."""
    pages = table(spark, d, "runes").where(A.has_rune(F.col("raw"))).select(F.col("id").alias("page"), "raw")
    return parse_pages(pages)


def transcription_parse(spark, d):  # noqa: ANN001, ANN201
    return _parsed(spark, d)[0]


def transcription_printed(spark, d):  # noqa: ANN001, ANN201
    return _parsed(spark, d)[1]


def _parts(found):  # noqa: ANN001, ANN202
    return found.select("page", F.col("part").cast("int").alias("part"), A.canon_of(F.col("indices")).alias("canon"), "start", "n")


def words_islands(spark, d):  # noqa: ANN001, ANN201
    runes, printed, _ = _parsed(spark, d)
    return _parts(R.words(runes, "page", printed))


def lines_islands(spark, d):  # noqa: ANN001, ANN201
    return _parts(R.lines(_parsed(spark, d)[0], "page"))


def concat_offsets(spark, d):  # noqa: ANN001, ANN201
    """All texts one after the other, leading marks carried over: where each text lies, and how many marks follow its runes."""
    rows, _ = R.concat(*_parsed(spark, d)[:1], "page", "page", *_parsed(spark, d)[1:])
    return rows.groupBy("page").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(F.length("marks_after")).alias("marks"))


def _joined(rows):  # noqa: ANN001, ANN202
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda s: s["idx"])
    return rows.groupBy("page").agg(A.canon_of(in_order).alias("canon"))


def slice_reversed_odd(spark, d):  # noqa: ANN001, ANN201
    """Every second rune from the end."""
    return _joined(R.slice_rows(_parsed(spark, d)[0], "page", None, None, -2))


def slice_range(spark, d):  # noqa: ANN001, ANN201
    """The fourth rune to the one before the last two, as a range of positions."""
    return _joined(R.slice_rows(_parsed(spark, d)[0], "page", 3, -2))


def asof_pinned(spark, d):  # noqa: ANN001, ANN201
    """Each message with the last pinned one at or before it, channels in name order: the section-start join.

    A page is a block of a channel's positions, so a large channel is many partitions.
    """
    rows = messages(spark, d).where("channel is not null and seq is not null").withColumn("page", F.concat("channel", F.lit("\u0001"), F.lpad(F.expr("seq div 4096").cast("string"), 10, "0")))
    starts = rows.where("pinned").select("page", F.col("seq").alias("first_rune"), F.col("id").alias("section"))
    placed = rows.select("page", F.col("seq").alias("pos"), "id")
    return R.sections_by_offset(placed, F.col("page"), starts).select("id", F.col("section").alias("pinned_id"))


def section_range_join(spark, d):  # noqa: ANN001, ANN201
    """Each cited sequence placed on a leaf by its id, and the section that leaf and position lie in."""
    points = table(spark, d, "runes").select("id", F.concat(F.lit("leaf-"), F.lpad((F.col("id") % LEAVES).cast("string"), 2, "0")).alias("page"), (F.col("id") * 7 % 100).alias("pos"))
    starts = table(spark, d, "sections").select(F.col("first_page").alias("page"), "first_rune", "section").where("page is not null and first_rune is not null")
    return R.asof_sections(points, starts, "page", "pos").select("id", "section")


def section_status_counts(spark, d):  # noqa: ANN001, ANN201
    """Documents per section with the section's status: lookup by id, and what is told about solved and unsolved ones."""
    about = table(spark, d, "documents").groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "sections").select("section", "status", (F.col("status") == UNSOLVED).alias("unsolved")).join(about, "section", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def section_after(spark, d):  # noqa: ANN001, ANN201
    parts = F.split("section", r"\.")
    numbered = table(spark, d, "sections").withColumn("o", parts[0].cast("int") * 1000 + parts[1].cast("int"))
    return R.section_after(numbered, "o").select("section", "next_section")


def first_mismatch(spark, d):  # noqa: ANN001, ANN201
    """Raw runes against the canonical string they were indexed as, one symbol of every third text dropped."""
    rows = table(spark, d, "runes").where("notation in ('runic', 'runic-joined')")
    a = rows.select("id", F.posexplode(A.indices_of(F.col("canon"))).alias("pos", "idx"))
    damaged = F.when(F.col("id") % 3 == 0, F.expr("substring(c, 2)")).otherwise(F.col("c"))
    b = rows.select("id", A.canon_of_runes(F.col("raw")).alias("c")).select("id", F.posexplode(A.indices_of(damaged)).alias("pos", "idx"))
    return R.first_mismatch(a, b, "id")


def export_parse(spark, d):  # noqa: ANN001, ANN201
    """All messages with their extra blocks written as export files, one per channel, and parsed back.

    A channel of more messages than a file should hold goes on in a further file. Messages without
    a time or an author get stand-ins, as a header needs both.
    """
    at = F.coalesce(parse_minute(F.col("ts")), F.lit("2000-01-01").cast("timestamp"))
    header = F.concat(F.lit("["), F.date_format(at, "M/d/yyyy h:mm a"), F.lit("] "), F.coalesce("author", F.lit("nobody")))
    rows = table(spark, d, "messages").where("channel is not null and seq is not null").select(
        F.concat("channel", F.lit("~"), F.expr(f"seq div {FILE_ROWS}")).alias("file"), "seq", "id", F.concat(header, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"), F.coalesce("extra", F.lit("")), F.lit("\n")).alias("text")
    )
    # a file's rows meet once, for the first of repeated exports and for its content
    first = Window.partitionBy("file", "seq").orderBy(F.asc_nulls_last("id"))
    once = rows.repartition("file").withColumn("n", F.row_number().over(first)).where("n = 1")
    files = once.groupBy("file").agg(F.concat(F.lit("Guild: archive\nChannel: Part of it\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n")).alias("content"))
    return exports.parse_exports(files.select(F.concat(F.lit("/x/"), "file", F.lit(".txt")).alias("path"), "content"))


def _entries(spark, d):  # noqa: ANN001, ANN202
    """The log's entries with the line each would be written as, every column in it."""
    e = table(spark, d, "experiments")
    line = F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in e.columns)))
    return e.withColumn("raw", line).withColumn("verdict", explog.clean_verdict(F.col("verdict")))


def log_next_id(spark, d):  # noqa: ANN001, ANN201
    return explog.next_id(_entries(spark, d))


def log_filter(spark, d):  # noqa: ANN001, ANN201
    return explog.matching(_entries(spark, d), None, None, "disproved").select("id", "section", "verdict")


def log_search_json(spark, d):  # noqa: ANN001, ANN201
    return explog.searching(_entries(spark, d), TERM).select("id")


def log_params_json(spark, d):  # noqa: ANN001, ANN201
    """Params by kind: none, JSON object, or free text."""
    kind = F.when(F.col("params").isNull(), "none").when(F.coalesce(F.schema_of_variant(F.try_parse_json("params")).rlike("^OBJECT"), F.lit(False)), "object").otherwise("text")
    return table(spark, d, "experiments").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def log_times(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "experiments").select("id", spell_minute(parse_minute(F.col("ts"))).alias("ts"))


def stale_files(spark, d):  # noqa: ANN001, ANN201
    """The channel list as two manifests: one channel gone, one changed, one new."""
    c = table(spark, d, "channels").select(F.col("channel").alias("file"), F.length("channel").cast("long").alias("bytes"), F.sha2(F.col("channel").cast("binary"), 256).alias("sha256"))
    current = c.where("file <> 'newcomers'").withColumn("bytes", F.when(F.col("file") == "hash-hunt", F.col("bytes") + 1).otherwise(F.col("bytes")))
    fresh = c.where("file = 'newcomers'").withColumn("file", F.lit("latecomers"))
    return exports.stale(c, current.unionByName(fresh))


def corpus_verify(spark, d):  # noqa: ANN001, ANN201
    table_ = A.alphabet(spark)
    return V.report([V.alphabet_check(table_), V.spelling_check(table_), V.sequence_checks(table(spark, d, "runes"), table(spark, d, "messages"))])


_C, _RN = f"'{A.CANON}'", f"'{A.RUNES}'"
_GAP = r"[^\-./&$§](?:[-./]*[^\-./&$§])*"
_PG = r"pg as (select id page, regexp_replace(raw, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g') t from runes where regexp_matches(raw, '[ᚠ-᛿]'))"
_TK = _PG + f""", tk as (select page, unnest(regexp_extract_all(t, '[ᚠ-᛿]|[^ᚠ-᛿]+')) tok, unnest(range(len(regexp_extract_all(t, '[ᚠ-᛿]|[^ᚠ-᛿]+')))) p from pg),
 tg as (select page, p, tok, strpos({_RN}, tok) > 0 ru, regexp_replace(tok, '{_GAP}', '', 'g') mk from tk),
 rw as (select *, lead(ru) over (partition by page order by p) nr, lead(mk) over (partition by page order by p) nm, sum(case when ru then 0 else length(tok) - length(replace(tok, '/', '')) end) over (partition by page order by p) br from tg),
 rr as (select page, row_number() over (partition by page order by p)::int - 1 pos, strpos({_RN}, tok)::int - 1 idx, 1 + br as line, case when nr is null or nr then '' else nm end marks_after from rw where ru)"""
_PARTS = """, gp as (select page, p, tok, ru, sum(case when not ru and {ends} then 1 else 0 end) over (partition by page order by p) g from tg),
  wd as (select page, g, translate(string_agg(tok, '' order by p), {rn}, {c}) canon, count(*) n from gp where ru group by 1, 2)
  select page, (row_number() over (partition by page order by g) - 1)::int part, canon, (sum(n) over (partition by page order by g) - n)::int as start, n from wd"""
_WS = r"[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NWS = _WS.replace("[", "[^", 1)
_STAMP = "'%-m/%-d/%Y %-I:%M %p'"
_EX = f"""with {_AR.replace('author, body,', 'author, body, extra,')}, ok as (select channel || '~' || (seq // {FILE_ROWS}) f, seq, '[' || strftime(coalesce(strptime(ts, '%Y-%m-%d %H:%M'), timestamp '2000-01-01'), {_STAMP}) || '] ' || coalesce(author, 'nobody') || chr(10) || coalesce(body, '') || chr(10) || coalesce(extra, '') || chr(10) tx
   from ar where channel is not null and seq is not null),
 fl as (select f, string_split(regexp_replace('Guild: archive' || chr(10) || 'Channel: Part of it' || chr(10) || chr(10) || string_agg(tx, chr(10) order by seq), '\\r\\n?', chr(10), 'g'), chr(10)) v from ok group by 1),
 ln as (select regexp_replace(f, '\\.[^.]*$', '') f, unnest(v) ln, unnest(range(1, len(v) + 1))::int line from fl),
 l1 as (select *, regexp_full_match(ln, '{_WS}*') bl, coalesce(lag(regexp_full_match(ln, '{_WS}*')) over (partition by f order by line), true) ab from ln),
 l2 as (select *, ab and regexp_matches(ln, '^\\[[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} [0-9]{{1,2}}:[0-9]{{2}} [AP]M\\] {_NWS}.*$') sh, try_strptime(regexp_extract(ln, '^\\[([^\\]]*)\\] ', 1), {_STAMP}) tm from l1),
 l3 as (select *, sh and tm is not null hd from l2),
 l4 as (select *, sum(hd::int) over w seq, last_value(case when hd then false when sh then null when regexp_matches(ln, '^\\{{[A-Z][A-Za-z ]*\\}}$') then true when bl then false end ignore nulls) over w st from l3 window w as (partition by f order by line)),
 ms as (select f, seq, min(line) filter (hd) line, min(tm) filter (hd) tm, min(ln) filter (hd) h, string_agg(ln, chr(10) order by line) filter (not hd and not bl and not (coalesce(st, false) and not sh)) b, string_agg(ln, chr(10) order by line) filter (not hd and not bl and coalesce(st, false) and not sh) x from l4 where seq > 0 group by 1, 2),
 au as (select *, regexp_extract(h, '^\\[[^\\]]*\\] (.*)$', 1) a from ms)
 select row_number() over (order by f, seq) id, f channel, 'Part of it' channel_name, strftime(tm, '%Y-%m-%d %H:%M') ts, regexp_replace(a, '\\s*\\(pinned\\)$', '') author, regexp_matches(a, '\\s*\\(pinned\\)$') pinned,
   regexp_replace(coalesce(b, ''), '^{_WS}+|{_WS}+$', '', 'g') body, regexp_replace(coalesce(x, ''), '^{_WS}+|{_WS}+$', '', 'g') extra, seq::int seq, line from au"""
_EN = "en as (select *, case when lower(trim(verdict)) in ('running', 'disproved', 'abandoned', 'inconclusive', 'promising', 'solved') then lower(trim(verdict)) end v from experiments)"
_NAMES = ("transcription_parse", "transcription_printed", "words_islands", "lines_islands", "concat_offsets", "slice_reversed_odd", "slice_range", "asof_pinned", "section_range_join", "section_status_counts", "section_after", "first_mismatch", "export_parse", "log_next_id", "log_filter", "log_search_json", "log_params_json", "log_times", "stale_files", "corpus_verify")
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {
    "transcription_parse": f"with {_TK} select page, pos, idx, line::bigint as line, row_number() over (partition by page, line order by pos)::int as col, marks_after from rr",
    "transcription_printed": f"with {_TK}, an as (select page, tok, ru, (sum(ru::int) over (partition by page order by p))::int - 1 anchor from tg) select page, anchor, unnest(range(len(v)))::int ord, unnest(v) as text from (select page, anchor, regexp_extract_all(tok, '{_GAP}') v from an where not ru)",
    "words_islands": f"with {_TK}" + _PARTS.format(rn=_RN, c=_C, ends="regexp_matches(tok, '[^/]')"),
    "lines_islands": f"with {_TK}" + _PARTS.format(rn=_RN, c=_C, ends="contains(mk, '/')"),
    "concat_offsets": f"""with {_TK}, n as (select page, count(*) n, sum(length(marks_after))::bigint m from rr group by 1), l as (select page, length(mk) k from tg where p = 0 and not ru),
       nx as (select n.page, n, m, lead(page) over (order by page) np, sum(n) over (order by page) e from n) select nx.page, (e - n)::bigint first_pos, (e - 1)::bigint last_pos, m + coalesce(l.k, 0) marks from nx left join l on l.page = np""",
    "slice_reversed_odd": f"with {_TK} select page, string_agg(substring({_C}, idx + 1, 1), '' order by pos desc) canon from (select *, max(pos) over (partition by page) m from rr) where (m - pos) % 2 = 0 group by 1",
    "slice_range": f"with {_TK} select page, string_agg(substring({_C}, idx + 1, 1), '' order by pos) canon from (select *, max(pos) over (partition by page) m from rr) where pos >= 3 and pos < m - 1 group by 1",
    "asof_pinned": f"""with ap as (select channel, seq, id, pinned from messages where channel is not null and seq is not null qualify row_number() over (partition by channel, seq order by id) = 1)
       select id, last_value(case when pinned then id end ignore nulls) over (order by channel collate "binary", seq rows unbounded preceding) pinned_id from ap""".replace(' collate "binary"', ""),
    "section_status_counts": "select s.section, status, status = 'unsolved' as unsolved, count(doc_id) n from sections s left join documents d using (section) group by 1, 2, 3",
    "section_range_join": f"""select p.id, s.section from (select id, 'leaf-' || lpad((id % {LEAVES})::varchar, 2, '0') || ' ' || lpad((id * 7 % 100)::varchar, 9, '0') k from runes) p
       asof left join (select first_page || ' ' || lpad(first_rune::varchar, 9, '0') k, section from sections where first_page is not null and first_rune is not null) s on p.k >= s.k""",
    "section_after": "select section, lead(section) over (order by split_part(section, '.', 1)::int, split_part(section, '.', 2)::int) next_section from sections",
    "first_mismatch": f"""with r as (select id, canon a, translate(regexp_replace(raw, '[^{A.RUNES}]', '', 'g'), {_RN}, {_C}) c from runes where notation in ('runic', 'runic-joined')), s as (select id, a, case when id % 3 = 0 then substring(c, 2) else c end b from r)
       select id, list_min(list_filter(range(greatest(length(a), length(b))), lambda i: substring(a, i::int + 1, 1) <> substring(b, i::int + 1, 1)))::int as at from s""",
    "export_parse": _EX,
    "log_next_id": "select coalesce(max(id), 0) + 1 next_id from experiments",
    "log_filter": f"with {_EN} select id, section, v verdict from en where v = 'disproved'",
    "log_search_json": f"select id from experiments where contains(lower(concat_ws('|', id, ts, section, method, params, coverage, verdict, notes)), '{TERM}')",
    "log_params_json": "select case when params is null then 'none' when json_valid(params) and json_type(case when json_valid(params) then params end) = 'OBJECT' then 'object' else 'text' end kind, count(*) n from experiments group by 1",
    "log_times": "select id, " + _AR.split("body, ", 1)[1].rsplit(" from messages", 1)[0] + " from experiments",
    "corpus_verify": f"""with c as (select 'alphabet' as name, 29 n, 0 bad union all select 'spelling', {len(A.SPELLINGS) - 1}, 0
       union all select 'canon alphabet', count(*), coalesce(sum((coalesce(not regexp_full_match(canon, '[a-z012]+'), true))::int), 0) from runes
       union all select 'lengths', count(*), coalesce(sum((coalesce(n <> length(canon), true))::int), 0) from runes where n is not null
       union all select 'notations', count(*), coalesce(sum((coalesce(notation not in ('runic', 'runic-joined', 'numeric', 'translit'), true))::int), 0) from runes
       union all select 'messages cited', count(*), coalesce(sum((m is null)::int), 0) from (select distinct msg_id from runes) r left join (select distinct id m from messages) on m = msg_id)
       select name, bad = 0 and n > 0 as passed, n || ' compared, ' || bad || ' wrong' detail from c""",
    "stale_files": "select 'newcomers' as file, 'removed' as state union all select 'hash-hunt', 'changed' union all select 'latecomers', 'added'",
}
