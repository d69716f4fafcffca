"""Named queries of the text-preparation operators, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.llm import canonical_text, conversations, markup, packing, personal, shared_spans, stuffing, tokens
from runeframe.session import spread, table

#: Bound on the distinct given and family names of the member table that are sent to every task.
MAX_NAMES = 1_000_000


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "messages").select(F.lit("messages.body").alias("field"), "id", F.col("body").alias("text"))
    return bodies.unionAll(table(spark, sf_dir, "runes").select(F.lit("runes.raw").alias("field"), "id", F.col("raw").alias("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.look_alike_pairs(_texts(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's class of equal canonical form."""
    return canonical_text.classes(_texts(spark, sf_dir))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's text in canonical form."""
    return _texts(spark, sf_dir).select("field", "id", canonical_text.canonical(F.col("text")).alias("form"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages")
    return markup.find_markup(messages, "id", "body", "body").unionAll(markup.find_markup(messages, "id", "extra", "extra"))


def _both(of, first: str, second: str) -> DataFrame:  # noqa: ANN001
    """``id, field, text``: the texts ``of`` gives for two fields of the messages."""
    return of(first).select("id", F.lit(first).alias("field"), "text").unionAll(of(second).select("id", F.lit(second).alias("field"), "text"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every body and every extra."""
    messages = table(spark, sf_dir, "messages")
    return _both(lambda field: markup.cleaned(messages, "id", field), "body", "extra")


def gazetteer(spark: SparkSession, sf_dir: str) -> personal.Gazetteer:
    """Distinct names of the member table, whose number grows with the language rather than the members and is checked before they go to the tasks."""
    words = F.expr(r"filter(split(lower(full_name), '\\s+'), w -> w <> '')")
    named = table(spark, sf_dir, "members").select(words.alias("w")).where("size(w) >= 2")
    last = F.expr("w[size(w) - 1]")
    found = []
    for part in (F.explode(F.expr("filter(slice(w, 1, size(w) - 1), x -> length(trim(BOTH '.' FROM x)) > 1)")), last):
        rows = named.select(part.alias("n")).distinct().limit(MAX_NAMES + 1).collect()
        if len(rows) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} names: give the operator a gazetteer of your own")
        found.append(frozenset(r[0] for r in rows))
    return personal.Gazetteer(*found)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, names = spread(table(spark, sf_dir, "messages").select("id", "body", "author")), gazetteer(spark, sf_dir)
    return personal.find_kinds(messages, "id", "body", "body", names).unionAll(personal.find_kinds(messages, "id", "author", "author", names, signatures=True))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body and every author with placeholders in place of personal information."""
    messages, names = spread(table(spark, sf_dir, "messages").select("id", "body", "author")), gazetteer(spark, sf_dir)
    return _both(lambda field: personal.redacted(messages, "id", field, names, signatures=field == "author"), "body", "author")


def _thread_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "messages"), table(spark, sf_dir, "channels"), table(spark, sf_dir, "members")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.thread_states(*_thread_tables(spark, sf_dir)).where("broken or nameless or unanswered").select("channel")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(*_thread_tables(spark, sf_dir))


_VISIBLE = r"'[^\s\p{Z}\p{Cc}\p{Cf}]'"
P5_SQL = f"""
with t as (select distinct channel from channels where kind = 'thread'),
r as (select m.channel, m.seq, arg_min(struct_pack(a := author, b := body), id) x from messages m join t using (channel) group by 1, 2),
w as (select channel, seq, x.a a, x.b b, (select min(speaker_role) from members mm
        where mm.author = trim(regexp_replace(trim(lower(x.a)), '\\(pinned\\)$', ''))) ro from r),
f as (select channel, count(*) n, min(seq) lo, max(seq) hi,
        bool_or(a is null or not regexp_matches(a, {_VISIBLE})) nameless,
        min(case when ro = 'user' and regexp_matches(b, {_VISIBLE}) then seq end) q,
        max(case when ro = 'assistant' and regexp_matches(b, {_VISIBLE}) then seq end) s from w group by 1)
select t.channel from t left join f using (channel)
where n is null or lo <> 1 or hi <> n or nameless or q is null or s is null or s <= q
"""

#: Shared spans have at least this many characters.
MIN_SHARED = 24
#: Tokens a container holds.
CAPACITY = 2048


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_lengths(table(spark, sf_dir, "runes"), "id", "canon", "msg_id", MIN_SHARED)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over the cores where they come in too few splits for the heavy row-wise work that follows."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(_documents(spark, sf_dir), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return tokens.decoded(p8_ids(spark, sf_dir), "doc_id", "ids")


def p8_multi_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as ids of the vocabulary made for many languages."""
    return tokens.encoded(_documents(spark, sf_dir), "doc_id", "text", "byte_bpe_multi_50k")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    sizes = tokens.counted(_documents(spark, sf_dir), "doc_id", "text")
    placed = packing.packed(sizes, "doc_id", "n_tokens", CAPACITY)
    return placed.select(F.col("id").alias("doc_id"), "part", F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.find_stuffed(_documents(spark, sf_dir), "doc_id", "text")


FUNCTIONS = (p1_found, p1_classes, p1_forms, p2_found, p2_clean, p4_found, p4_redacted, p5_found, p5_conversations, p7_found, p8_ids, p8_decoded, p8_multi_ids, p9_containers, p10_found)
QUERIES = {f.__name__: f for f in FUNCTIONS}


#: Fixed values, written for the SQL from the published list of confusable characters: look-alike letters, and their likeness below.
_ALIKE = "аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳͿօսɡı‐‑․ꓸ"
_PLAIN = "aeopcyxsijhdqwlABEKMHOPCTYXSIJQWABEZHIKMNOPTYXovjJouɡi--..".replace("ɡ", "g")
_SPACES, _UNSEEN = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", r"[\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_ROMAN = "I II III IV V VI VII VIII IX X XI XII".split()
_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "‥": ".."} | {chr(0x2160 + i): r for i, r in enumerate(_ROMAN)} | {chr(0x2170 + i): r.lower() for i, r in enumerate(_ROMAN)}


def _reading_sql(text: str) -> str:
    """Reading form in DuckDB; texts with a Greek or Cyrillic letter that has no likeness keep their letters."""
    form = f"regexp_replace(regexp_replace({text}, '{_UNSEEN}', '', 'g'), '{_SPACES}', ' ', 'g')"
    for ch, plain in _JOINED.items():
        form = f"replace({form}, '{ch}', '{plain}')"
    wide = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    form = f"translate({form}, '{wide[0]}', '{wide[1]}')"
    latin = f"translate({form}, '{_ALIKE}', '{_PLAIN}')"
    return rf"nfc_normalize(case when regexp_matches({latin}, '[\x{{370}}-\x{{4FF}}]') then {form} else {latin} end)"


def _folded_sql(form: str) -> str:
    """Canonical form from a reading form: raised and circled characters plain, case folded, spaces single."""
    for ch, plain in {"ß": "ss", "ẞ": "ss", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "™": "tm"}.items():
        form = f"replace({form}, '{ch}', '{plain}')"
    raised = "⁰¹²³⁴⁵⁶⁷⁸⁹ⁿⁱªº₀₁₂₃₄₅₆₇₈₉①②③④⑤⑥⑦⑧⑨ς", "0123456789niao0123456789123456789σ"
    for i in range(10, 21):
        form = f"replace({form}, '{chr(0x2460 + i - 1)}', '{i}')"
    circled = "".join(chr(0x24B6 + i) for i in range(26)) + "".join(chr(0x24D0 + i) for i in range(26))
    form = f"translate({form}, '{raised[0]}{circled}', '{raised[1]}{'abcdefghijklmnopqrstuvwxyz' * 2}')"
    return rf"trim(regexp_replace(nfc_normalize(lower({form})), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{2028}}\x{{2029}}\x{{0b}}\x{{1680}}]+', ' ', 'g'))"


_P1_ROWS = "a as (select 'messages.body' as field, id, body t from messages union all select 'runes.raw', id, raw from runes)"
P1_SQL = rf"""with {_P1_ROWS},
  f as (select field, id, t, case when strlen(t) = length(t) then t else {_reading_sql('t')} end r from a where t is not null), v as (select * from f where r <> t)
  select distinct v.field, least(v.id, f.id) as id_a, greatest(v.id, f.id) as id_b from v join f on v.field = f.field and v.r = f.r and v.t <> f.t where regexp_matches(v.r, '[^\s]')"""
P1_FORMS_SQL = f"with {_P1_ROWS} select field, id, {_folded_sql(_reading_sql('t'))} as form from a"
P1_CLASSES_SQL = f"""with {_P1_ROWS}, f as (select field, id, {_reading_sql('t')} r from a where t is not null), g as (select field, id, r, {_folded_sql('r')} c from f where r is not null)
  select field, id, min(id) over w as class_id, count(*) over w as n_rows, n_forms from g join (select field, c, count(distinct r) n_forms from g group by 1, 2) using (field, c) where c <> '' window w as (partition by field, c)"""


P7_SQL = f"""
with g as (select id, msg_id, unnest(range(length(canon) - {MIN_SHARED - 1})) p, unnest(list_transform(range(length(canon) - {MIN_SHARED - 1}), lambda i: substring(canon, i::int + 1, {MIN_SHARED}))) w
  from runes where length(canon) >= {MIN_SHARED}),
s as (select w from g group by 1 having count(distinct msg_id) > 1)
select id, count(distinct q) as n_shared from (select id, unnest(range(p, p + {MIN_SHARED})) q from g join s using (w)) group by 1
"""
P5_TURNS_SQL = P5_SQL.replace("select t.channel from t left join f using (channel)", ", bad as (select t.channel from t left join f using (channel)").rstrip() + """)
select channel, seq, ro as role, a as author, b as body from w where channel not in (select channel from bad)
"""
ORACLES = {"p1_found": P1_SQL, "p1_forms": P1_FORMS_SQL, "p1_classes": P1_CLASSES_SQL, "p5_found": P5_SQL, "p5_conversations": P5_TURNS_SQL, "p7_found": P7_SQL, "p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}



def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
