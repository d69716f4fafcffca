"""Queries of the keyed transforms over the cited sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeframe.functions import alphabet as A
from runeframe.operators import cipher as C
from runeframe.operators import fitness
from runeframe.plans.stats import _MODEL, SPELLED_SQL, cited, english_model

KEY = [23, 10, 1, 10, 9, 10, 16, 26]
#: A text's skips: positions 2 and 5 as far as it has them.
SKIPS = (2, 5)
LONGEST = 512
PRIME_BOUND = 20_000


def _texts(spark, d):  # noqa: ANN001, ANN202
    x = A.indices_of(F.col("canon"))
    return cited(spark, d).select("id", x.alias("x"), F.filter(F.array(*map(F.lit, SKIPS)), lambda s: s < F.length("canon")).alias("s"))


def _out(df, value):  # noqa: ANN001, ANN202
    return df.select("id", A.canon_of(value).alias("out"))


X, S = "x", "s"


def atbash(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.atbash(X))


def shift(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.shift_decrypt(X, 26, S))


def affine(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.affine_decrypt(X, 7, 11))


def vigenere_dec(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.vigenere_decrypt(X, KEY, S))


def vigenere_enc_interrupter(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.vigenere_encrypt(X, KEY, 0))


def beaufort(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.beaufort_decrypt(X, KEY, S))


def variant_beaufort(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.variant_beaufort_decrypt(X, KEY, S))


def running_key(spark, d):  # noqa: ANN001, ANN201
    """Running key: the squares by ordinal."""
    texts = _texts(spark, d)
    squares = F.transform(F.sequence(F.lit(0), F.lit(LONGEST)), lambda i: i * i)
    table_ = lambda n: spark.range(n).select(F.col("id").alias("ord"), (F.col("id") * F.col("id")).alias("k"))
    return _by_length(texts, C.running_key_decrypt(X, squares, S), table_)


def phi_prime(spark, d):  # noqa: ANN001, ANN201
    return _by_length(_texts(spark, d), C.phi_prime_decrypt(X, LONGEST, S), lambda n: C.keystream(C.primes_below(spark, C.prime_bound(n))))


def phi_prime_joined(spark, d):  # noqa: ANN001, ANN201
    """Every text less the primes minus one, symbol by symbol from the keystream's table, however long the text."""
    texts = _texts(spark, d)
    longest = texts.agg(F.max(F.size(X))).first()[0] or 0
    stream = C.keystream(C.primes_below(spark, C.prime_bound(longest)))
    return _out(C.stream_decrypt(texts, "id", X, stream, S), F.col("out"))


def _by_length(texts, short, stream):  # noqa: ANN001, ANN202
    """Texts up to ``LONGEST`` symbols inside their row, longer ones joined with their keystream as a table."""
    fits = F.size(X) <= LONGEST
    longest = texts.agg(F.max(F.size(X))).first()[0] or 0
    done = _out(texts.where(fits), short)
    if longest <= LONGEST:
        return done
    return done.unionAll(_out(C.stream_decrypt(texts.where(~fits), "id", X, stream(longest), S), F.col("out")))


def autokey_ct(spark, d):  # noqa: ANN001, ANN201
    return _out(_texts(spark, d), C.autokey_ct_decrypt(X, KEY, S))


def autokey_pt(spark, d):  # noqa: ANN001, ANN201
    return _out(C.autokey_pt_decrypt(_texts(spark, d), "id", "x", KEY, "s"), F.col("out"))


def primes_table(spark, d):  # noqa: ANN001, ANN201
    return C.keystream(C.primes_below(spark, PRIME_BOUND)).select(F.col("ord").cast("long").alias("ord"), "k")


def key_sweep_topk(spark, d):  # noqa: ANN001, ANN201
    """The best shift of every text, by fitness; texts without an n-gram have no score and no row."""
    return fitness.best_shift(cited(spark, d), "id", "canon", english_model(spark, d), 4)


_A = f"'{A.CANON}'"
_TX = f"with tx as (select id, length(canon)::int n, list_transform(string_split(canon, ''), lambda c: strpos({_A}, c)::int - 1) x, list_filter({list(SKIPS)}, lambda s: s < length(canon)) s from runes where canon is not null and canon <> '') "


def _sql(expr: str, skipped: bool = True) -> str:
    """``expr`` over x (symbol), o (key ordinal)."""
    body = expr.replace("{x}", "x[i::int + 1]").replace("{o}", "(i - len(list_filter(s, lambda q: q < i)))")
    value = f"((({body}) % 29) + 29) % 29"
    if skipped:
        value = f"case when list_contains(s, i) then x[i::int + 1] else {value} end"
    return _TX + f"select id, array_to_string(list_transform(range(n), lambda i: substring({_A}, ({value})::int + 1, 1)), '') as out from tx"


_K = str(KEY)
_PH = f"{[(p - 1) % 29 for p in C.first_primes(LONGEST)]}"
_SQLS = {
    "atbash": _sql("28 - {x}", False),
    "shift": _sql("{x} - 26"),
    "affine": _sql(f"({{x}} - 11) * {pow(7, -1, 29)}", False),
    "vigenere_dec": _sql(f"{{x}} - {_K}[({{o}} % 8)::int + 1]"),
    "vigenere_enc_interrupter": _TX + f"""select id, array_to_string(list_transform(range(n), lambda i: substring({_A}, (case when x[i::int + 1] = 0 then 0
       else (x[i::int + 1] + {_K}[(len(list_filter(x[1:i::int], lambda v: v <> 0)) % 8)::int + 1]) % 29 end)::int + 1, 1)), '') as out from tx""",
    "beaufort": _sql(f"{_K}[({{o}} % 8)::int + 1] - {{x}}"),
    "variant_beaufort": _sql(f"{{x}} + {_K}[({{o}} % 8)::int + 1]"),
    "running_key": _sql("{x} - ({o} * {o}) % 29"),
    "phi_prime_joined": _sql(f"{{x}} - {_PH}[{{o}}::int + 1]"),
    "phi_prime": _sql(f"{{x}} - {_PH}[{{o}}::int + 1]"),
    "autokey_ct": _TX + f"""select id, array_to_string(list_transform(range(n), lambda i: substring({_A}, (case when list_contains(s, i) then x[i::int + 1]
       else (x[i::int + 1] - list_concat({_K}, list_transform(list_filter(range(n), lambda q: not list_contains(s, q)), lambda q: x[q::int + 1]))[(i - len(list_filter(s, lambda q: q < i)))::int + 1] + 29) % 29 end)::int + 1, 1)), '') as out from tx""",
    "autokey_pt": _TX.replace("with ", "with recursive ") + f""", r as (select id, n, x, s, 0 i, []::int[] kept, []::int[] p from tx union all
       select id, n, x, s, i + 1, case when list_contains(s, i) then kept else list_append(kept, y) end, list_append(p, y)
       from (select *, case when list_contains(s, i) then x[i + 1] else ((x[i + 1] - list_concat({_K}, kept)[len(kept) + 1]) % 29 + 29) % 29 end y from r where i < n))
       select id, array_to_string(list_transform(p, lambda v: substring({_A}, v::int + 1, 1)), '') as out from r where i = n""",
    "primes_table": f"select row_number() over (order by p) - 1 as ord, p - 1 as k from (select unnest(range(2, {PRIME_BOUND})) p) a where not exists (select 1 from (select unnest(range(2, 142)) q) b where q < p and p % q = 0 and q * q <= p)",
    "key_sweep_topk": "with " + SPELLED_SQL + ", " + _MODEL + f""", tr as (select id, sh, array_to_string(list_transform(string_split(canon, ''), lambda c: substring({_A}, ((strpos({_A}, c) - 1 - sh + 29) % 29)::int + 1, 1)), '') canon
       from cited, (select unnest(range(29)) sh) where length(canon) >= 4),
       sc as (select id, sh, round(avg(coalesce(logp, floor)), 5) score from (select id, sh, unnest(list_transform(range(length(canon) - 3), lambda p: substring(canon, p::int + 1, 4))) gram from tr) left join m using (gram), fl group by 1, 2)
       select id, sh::int as shift, score from sc qualify row_number() over (partition by id order by score desc, sh) = 1""",
}
QUERIES = {name: globals()[name] for name in _SQLS}
ORACLES = dict(_SQLS)
