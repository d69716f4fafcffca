"""Queries of the alphabet, the stream statistics and the fitness model over spelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.functions import alphabet as A
from runeframe.operators import fitness, stats
from runeframe.session import cut_lineage, shared_place, spread, table

NEEDLE = "cs"
LONG_PERIOD = 12


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where(F.col("text").isNotNull() & ~A.has_symbol(F.col("text"))))
    return texts.select("doc_id", "lang", A.spell(F.col("text")).alias("canon"))


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training texts: the spelled English documents."""
    return spelled(spark, sf_dir).where("lower(lang) = 'en'")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runes").select("id", "canon").where("canon is not null")


def spell_documents(spark, d):  # noqa: ANN001, ANN201
    return spelled(spark, d).select("doc_id", "canon", F.length("canon").alias("n"))


def spell_runes(spark, d):  # noqa: ANN001, ANN201
    """Documents as runes."""
    texts = table(spark, d, "documents").where(F.col("text").isNotNull() & ~A.has_symbol(F.col("text")))
    return spread(texts.select("doc_id", "text")).select("doc_id", A.spell_runes(F.col("text")).alias("runes"))


def unspell_documents(spark, d):  # noqa: ANN001, ANN201
    return spelled(spark, d).select("doc_id", A.unspell(F.col("canon")).alias("latin"))


def canon_roundtrip(spark, d):  # noqa: ANN001, ANN201
    c = F.col("canon")
    glyphs = A.runes_of(c)
    same = (A.canon_of(A.indices_of(c)) == c) & (A.canon_of_runes(glyphs) == c)
    return cited(spark, d).select("id", glyphs.alias("glyphs"), same.alias("same"), A.prime_sum(c).alias("primes"), A.index_digest(c).alias("digest"))


def rune_counts(spark, d):  # noqa: ANN001, ANN201
    return stats.rune_counts(spelled(spark, d), "canon")


def rune_frequencies_cited(spark, d):  # noqa: ANN001, ANN201
    """Shares over all cited sequences."""
    return stats.rune_frequencies(cited(spark, d), "canon").select("idx", F.round("share", 9).alias("share"))


def english_frequencies(spark, d):  # noqa: ANN001, ANN201
    return stats.rune_frequencies(english(spark, d), "canon").select("idx", F.round("share", 9).alias("share"))


def ioc_by_doc(spark, d):  # noqa: ANN001, ANN201
    return spelled(spark, d).select("doc_id", F.length("canon").alias("n"), F.round(stats.ioc(F.col("canon")), 6).alias("ioc"))


def flagship(spark, d):  # noqa: ANN001, ANN201
    """The documents whose spelled text is farthest from even, longest first among ties."""
    return ioc_by_doc(spark, d).where("n >= 200").orderBy(F.desc("ioc"), F.desc("n"), "doc_id").limit(20)


def entropy_by_doc(spark, d):  # noqa: ANN001, ANN201
    return spelled(spark, d).select("doc_id", F.round(stats.entropy(F.col("canon")), 6).alias("bits"))


def doublets_by_doc(spark, d):  # noqa: ANN001, ANN201
    c = F.col("canon")
    return spelled(spark, d).select("doc_id", stats.doublets(c).alias("doublets"), F.round(stats.doublet_rate(c), 6).alias("rate"))


def periodic_ioc(spark, d):  # noqa: ANN001, ANN201
    """Every period of every cited sequence."""
    return stats.periods(cited(spark, d), "id", "canon", 2, LONG_PERIOD).withColumn("ioc", F.round("ioc", 6))


def chi2_vs_english(spark, d):  # noqa: ANN001, ANN201
    reference = [r[1] for r in stats.rune_frequencies(english(spark, d), "canon").orderBy("idx").collect()]  # 29 rows
    return cited(spark, d).select("id", F.round(stats.chi_squared(F.col("canon"), reference), 4).alias("chi2"))


def chi2_inf_cases(spark, d):  # noqa: ANN001, ANN201
    """A reference without the last symbol: texts with it are infinitely far."""
    return cited(spark, d).select("id", F.round(stats.chi_squared(F.col("canon"), [1 / 28] * 28 + [0.0]), 4).alias("chi2"))


def ngram_counts_n3(spark, d):  # noqa: ANN001, ANN201
    return stats.ngram_counts(spelled(spark, d), "canon", 3)


def repeats_min3(spark, d):  # noqa: ANN001, ANN201
    found = stats.repeats(cited(spark, d), "id", "canon", 3, 2)
    return found.select("id", "gram", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def kasiski_gaps(spark, d):  # noqa: ANN001, ANN201
    return stats.kasiski_gaps(cited(spark, d), "id", "canon", 3)


def find_needle(spark, d):  # noqa: ANN001, ANN201
    found = stats.positions_of(F.col("canon"), NEEDLE)
    return spelled(spark, d).where(F.contains("canon", F.lit(NEEDLE))).select("doc_id", F.array_join(F.transform(found, lambda p: p.cast("string")), ",").alias("positions"))


_MODELS: dict[tuple[str, str], str] = {}


def english_model(spark, d):  # noqa: ANN001, ANN201
    """The 4-gram model of the English documents in id order, as one text; fitted once per application, written to the shared folder and read by every query."""
    key = spark.sparkContext.applicationId, d
    if key not in _MODELS:
        place = shared_place(spark, "model")
        fitness.model(cut_lineage(english(spark, d)), "canon", 4, "doc_id").write.parquet(place)
        _MODELS[key] = place
    return spark.read.parquet(_MODELS[key])


def model_n4(spark, d):  # noqa: ANN001, ANN201
    return english_model(spark, d).select("gram", F.round("logp", 6).alias("logp"), F.round("floor", 6).alias("floor"))


def fitness_score(spark, d):  # noqa: ANN001, ANN201
    return fitness.score(cited(spark, d), "id", "canon", english_model(spark, d), 4).select("id", F.round("score", 5).alias("score"))


def fitness_windowed(spark, d):  # noqa: ANN001, ANN201
    return fitness.windowed(cited(spark, d), "id", "canon", english_model(spark, d), 100, 25, 4).select("id", "start", F.round("score", 5).alias("score"))


def fitness_windowed_max(spark, d):  # noqa: ANN001, ANN201
    """Each document's best window."""
    return fitness.best_window(spelled(spark, d), "doc_id", "canon", english_model(spark, d), 100, 25, 4).select("doc_id", F.round("best", 5).alias("best"))


def training_digest(spark, d):  # noqa: ANN001, ANN201
    """Digest of each language's spelled texts in id order, as a tree: at most 1,024 digests are joined at once."""
    level = spelled(spark, d).where("lang is not null").select(F.lower("lang").alias("lang"), F.col("doc_id").alias("at"), F.sha2(F.col("canon").cast("binary"), 256).alias("h"))
    for _ in range(2):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda s: s["h"]), "")
        level = level.groupBy("lang", F.expr("at div 1024").alias("at")).agg(F.sha2(joined.cast("binary"), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda s: s["h"]), "")
    return level.groupBy("lang").agg(F.sha2(joined.cast("binary"), 256).alias("digest"))


def training_sha256(spark, d):  # noqa: ANN001, ANN201
    """Digest and length of the English documents' symbols in id order, as one stream."""
    return spark.createDataFrame([fitness.training_sha256(english(spark, d), "canon", "doc_id")], "digest string, n long")


_MAP = "MAP {" + ", ".join(f"'{s}': '{A.CANON[i]}'" for s, i in A.SPELLINGS.items()) + "}"
SPELLED_SQL = f"""
lt as (select doc_id, lang, regexp_replace(upper(strip_accents(replace(replace(text, 'ß', 'ss'), chr(160), ' '))), '[^A-Z\\s]', '', 'g') u
       from documents where text is not null and not regexp_matches(text, '[{A.RUNES}]')),
spelled as (select doc_id, lang, coalesce(array_to_string(list_transform(regexp_extract_all(u, '{"|".join(A.MULTI)}|[A-Z]'), lambda k: ({_MAP})[k]), ''), '') canon from lt),
cited as (select id, canon from runes where canon is not null),
english as (select doc_id, canon from spelled where lower(lang) = 'en'),
ix as (select unnest(range(29)) idx)
"""
_W = "with " + SPELLED_SQL
_C = f"'{A.CANON}'"
_CNT = f"list_transform(range(29), lambda k: length(canon) - length(replace(canon, substring({_C}, k::int + 1, 1), '')))"
_GRAM = "(select {key}, unnest(list_transform(range(length(canon) - {n1}), lambda p: substring(canon, p::int + 1, {n}))) gram, unnest(range(length(canon) - {n1})) pos from {t} where length(canon) >= {n})"


def _grams(t: str, key: str, n: int) -> str:
    return _GRAM.format(t=t, key=key, n=n, n1=n - 1)


_IOC = "round(case when n < 2 then 0.0 else list_sum(list_transform(c, lambda v: v * (v - 1)))::double / (n * (n - 1)) * 29 end, 6)"
_MODEL = f"""oe as (select canon, lead(canon, 1) over o a, lead(canon, 2) over o b, lead(canon, 3) over o c from english where canon <> '' window o as (order by doc_id)),
  span as (select 0 doc_id, right(canon, 3) || left(coalesce(a, '') || coalesce(b, '') || coalesce(c, ''), 3) canon from oe),
  mc as (select gram, count(*) n from (select gram from {_grams('english', 'doc_id', 4)} union all select gram from {_grams('span', 'doc_id', 4)}) group by 1),
  mt as (select sum(n)::double t from mc), m as (select gram, log10(n / t) logp from mc, mt), fl as (select log10(1.0 / t) - 2.0 floor from mt)"""


def _chi(ref: str) -> str:
    return f"""select id, round(case when length(canon) = 0 or list_bool_or(list_transform(range(29), lambda i: c[i + 1] > 0 and p[i + 1] <= 0)) then 'inf'::double
    else list_sum(list_transform(range(29), lambda i: case when p[i + 1] > 0 then pow(c[i + 1] - p[i + 1] * length(canon), 2) / (p[i + 1] * length(canon)) else 0 end)) end, 4) chi2
    from (select id, canon, {_CNT} c, ({ref}) p from cited)"""


def _freq(t: str) -> str:
    return f"""select idx::int idx, round(coalesce(n / nullif(sum(n) over (), 0), 0.0), 9) as share from (
      select idx, sum(length(canon) - length(replace(canon, substring({_C}, idx::int + 1, 1), '')))::double n from ix, (select * from {t}) group by 1)"""


_SQLS = {
    "spell_documents": _W + "select doc_id, canon, length(canon)::int n from spelled",
    "spell_runes": _W + f"select doc_id, translate(canon, {_C}, '{A.RUNES}') runes from spelled",
    "unspell_documents": _W + f"select doc_id, case when canon = '' then '' else array_to_string(list_transform(string_split(canon, ''), lambda c: {list(A.PRIMARY)}[strpos({_C}, c)]), '') end latin from spelled",
    "canon_roundtrip": _W + f"""select id, translate(canon, {_C}, '{A.RUNES}') glyphs, true as same, list_sum(list_transform(string_split(canon, ''), lambda c: {list(A.PRIMES)}[strpos({_C}, c)]))::bigint primes,
       sha256(unhex(array_to_string(list_transform(string_split(canon, ''), lambda c: printf('%02x', strpos({_C}, c) - 1)), ''))) digest from cited""",
    "rune_counts": _W + f"select strpos({_C}, gram)::int - 1 as idx, count(*) n from {_grams('spelled', 'doc_id', 1)} group by 1",
    "rune_frequencies_cited": _W + _freq("cited"),
    "english_frequencies": _W + _freq("english"),
    "ioc_by_doc": _W + f"select doc_id, n::int n, {_IOC} ioc from (select doc_id, length(canon) n, {_CNT} c from spelled)",
    "flagship": _W + f"select doc_id, n::int n, {_IOC} ioc from (select doc_id, length(canon) n, {_CNT} c from spelled) where n >= 200 order by ioc desc, n desc, doc_id limit 20",
    "entropy_by_doc": _W + f"select doc_id, round(coalesce(list_sum(list_transform(list_filter(c, lambda v: v > 0), lambda v: -(v / n) * log2(v / n))), 0.0), 6) bits from (select doc_id, length(canon)::double n, {_CNT} c from spelled)",
    "doublets_by_doc": _W + """select doc_id, d::int doublets, round(case when n > 1 then d / (n - 1) else 0.0 end, 6) rate from (
      select doc_id, length(canon)::double n, coalesce(list_sum(list_transform(range(length(canon) - 1), lambda i: (substring(canon, i::int + 1, 1) = substring(canon, i::int + 2, 1))::int)), 0) d from spelled)""",
    "periodic_ioc": _W + f""", pd as (select unnest(range(2, 13))::int period), f as (select id, period, round(avg(ioc), 6) ioc from (select id, period, k, list_sum(list_transform(list(v), lambda v: v * (v - 1)))::double / (sum(v) * (sum(v) - 1)) * 29 ioc from (
      select id, period, pos % period k, gram, count(*) v from {_grams('cited', 'id', 1)}, pd group by all) group by all having sum(v) >= 2) group by all)
      select cited.id, pd.period, coalesce(f.ioc, 0.0) ioc from cited join pd on true left join f on f.id = cited.id and f.period = pd.period""",
    "chi2_vs_english": _W + f", fr as ({_freq('english').replace('round(coalesce(n / nullif(sum(n) over (), 0), 0.0), 9)', 'coalesce(n / nullif(sum(n) over (), 0), 0.0)')}) " + _chi("select list(share order by idx) from fr"),
    "chi2_inf_cases": _W + _chi("list_concat(list_transform(range(28), lambda i: 1.0::double / 28), [0.0::double])"),
    "ngram_counts_n3": _W + f"select gram, count(*) n from {_grams('spelled', 'doc_id', 3)} group by 1",
    "repeats_min3": _W + f"select id, gram, string_agg(pos::varchar, ',' order by pos) positions from {_grams('cited', 'id', 3)} group by 1, 2 having count(*) >= 2",
    "kasiski_gaps": _W + f"select gap::int gap, count(*) n from (select pos - lag(pos) over (partition by id, gram order by pos) gap from {_grams('cited', 'id', 3)}) where gap is not null group by 1",
    "find_needle": _W + f"select doc_id, string_agg(pos::varchar, ',' order by pos) positions from {_grams('spelled', 'doc_id', len(NEEDLE))} where gram = '{NEEDLE}' group by 1",
    "model_n4": _W + ", " + _MODEL + " select gram, round(logp, 6) logp, round(floor, 6) floor from m, fl",
    "fitness_score": _W + ", " + _MODEL + f" select id, round(avg(coalesce(logp, floor)), 5) score from {_grams('cited', 'id', 4)} left join m using (gram), fl group by 1",
    "fitness_windowed": _W + ", " + _MODEL + f""", v as (select id, pos, coalesce(logp, floor) x from {_grams('cited', 'id', 4)} left join m using (gram), fl),
      w as (select id, length(canon) len, unnest(case when length(canon) <= 100 then [0] else list_distinct(list_concat(range(0, length(canon) - 99, 25), [length(canon) - 100])) end) s from cited where length(canon) >= 4)
      select w.id, s::int as start, round(avg(x), 5) score from w join v on v.id = w.id and pos >= s and pos <= s + least(100, len) - 4 group by 1, 2""",
    "fitness_windowed_max": _W + ", " + _MODEL + f""", de as (select doc_id, canon from spelled),
      v as (select doc_id, pos, sum(coalesce(logp, floor)) over (partition by doc_id order by pos) u from {_grams('de', 'doc_id', 4)} left join m using (gram), fl),
      w as (select doc_id, length(canon) len, unnest(case when length(canon) <= 100 then [0] else list_distinct(list_concat(range(0, length(canon) - 99, 25), [length(canon) - 100])) end) s from de where length(canon) >= 4)
      select w.doc_id, round(max((e.u - coalesce(b.u, 0)) / (least(100, len) - 3)), 5) best from w join v e on e.doc_id = w.doc_id and e.pos = s + least(100, len) - 4 left join v b on b.doc_id = w.doc_id and b.pos = s - 1 group by 1""",
    "training_sha256": _W + f"""select sha256(unhex(string_agg(array_to_string(list_transform(string_split(canon, ''), lambda c: printf('%02x', strpos({_C}, c) - 1)), ''), '' order by doc_id))) digest, sum(length(canon))::bigint n from english where canon <> ''""",
    "training_digest": _W + """select lang, sha256(string_agg(h, '' order by a2)) digest from (select lang, a1 // 1024 a2, sha256(string_agg(h, '' order by a1)) h from (
       select lower(lang) lang, doc_id // 1024 a1, sha256(string_agg(sha256(canon), '' order by doc_id)) h from spelled where lang is not null group by 1, 2) group by 1, 2) group by 1""",
}
QUERIES = {name: globals()[name] for name in _SQLS}
ORACLES = dict(_SQLS)
