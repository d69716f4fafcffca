"""Keyed transforms over Z/29 on arrays of indices.

``skips`` are positions that pass through unreduced while the keystream holds: the key ordinal of
position i is i minus the number of skips before i, so no state is carried along the text. All
transforms are higher-order expressions inside one row, but for plaintext autokey, which is a
running alternating sum and uses a window over (text, residue).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runeframe.functions.alphabet import N
from runeframe.operators.prefix import running_totals

SUBTRACT, REVERSED, ADD = "subtract", "reversed", "add"
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {SUBTRACT: lambda x, k: x - k, REVERSED: lambda x, k: k - x, ADD: lambda x, k: x + k}


def mod(x: Column) -> Column:
    return F.pmod(x, F.lit(N))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, also where the body uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_key(key: list[int]) -> list[int]:
    """Key reduced to 0..28; an empty key is refused here and not when it is first used."""
    if not key:
        raise ValueError("the key is empty")
    return [k % N for k in key]


def ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")


def no_skips() -> Column:
    return F.array().cast("array<int>")


def _skipped(skips: Column, i: Column) -> Column:
    return F.array_contains(skips, i)


def _ordinal(skips: Column, i: Column) -> Column:
    return i - F.size(F.filter(skips, lambda s: s < i))


def in_range(text: Column, skips: Column, value: Column) -> Column:
    """``value``, or an error where a skip lies outside the text."""
    outside = F.exists(skips, lambda s: (s < 0) | (s >= F.size(text)))
    return F.when(outside, F.raise_error(F.lit("a skip lies outside the text"))).otherwise(value)


def apply_stream(text: Column, stream: Callable[[Column], Column], operation: str | Callable = SUBTRACT, skips: Column | None = None) -> Column:
    """Combines each symbol with ``stream(ordinal)``; a stream that gives NULL is exhausted, which is an error.

    ``operation`` names one of the fixed operations or is a function of two columns. NULL text
    gives NULL, an empty text an empty array.
    """
    skips = no_skips() if skips is None else F.array_distinct(skips)
    op = OPERATIONS[operation] if isinstance(operation, str) else operation

    def one(x: Column, i: Column) -> Column:
        k = stream(_ordinal(skips, i))
        return F.when(_skipped(skips, i), x).when(k.isNull(), F.raise_error(F.lit("the keystream is exhausted")).cast("int")).otherwise(mod(op(x, k)))

    return in_range(text, skips, F.transform(text, one))


def repeating(key: list[int] | Column) -> Callable[[Column], Column]:
    column = ints(normal_key(key)) if isinstance(key, list) else key
    return lambda ordinal: F.get(column, ordinal % F.size(column))


def from_array(stream: Column) -> Callable[[Column], Column]:
    return lambda ordinal: mod(F.get(stream, ordinal))


def _plain(text: Column, skips: Column | None, f: Callable[[Column], Column]) -> Column:
    """Unkeyed transforms; skips are not range-checked."""
    if skips is None:
        return F.transform(text, lambda x: mod(f(x)))
    return F.transform(text, lambda x, i: F.when(_skipped(skips, i), x).otherwise(mod(f(x))))


def shift_decrypt(text: Column, k: int, skips: Column | None = None) -> Column:
    return _plain(text, skips, lambda x: x - k)


def atbash(text: Column, skips: Column | None = None) -> Column:
    return _plain(text, skips, lambda x: (N - 1) - x)


def affine_decrypt(text: Column, a: int, b: int, skips: Column | None = None) -> Column:
    if a % N == 0:
        raise ValueError("a has no inverse")
    return _plain(text, skips, lambda x: (x - b) * pow(a, -1, N))


def vigenere_decrypt(text: Column, key: list[int], skips: Column | None = None) -> Column:
    return apply_stream(text, repeating(key), SUBTRACT, skips)


def beaufort_decrypt(text: Column, key: list[int], skips: Column | None = None) -> Column:
    return apply_stream(text, repeating(key), REVERSED, skips)


def variant_beaufort_decrypt(text: Column, key: list[int], skips: Column | None = None) -> Column:
    return apply_stream(text, repeating(key), ADD, skips)


def running_key_decrypt(text: Column, stream: Column, skips: Column | None = None) -> Column:
    return let(stream, lambda st: apply_stream(text, from_array(st), SUBTRACT, skips))


def phi_prime_decrypt(text: Column, longest: int, skips: Column | None = None) -> Column:
    """Running key of prime minus one; ``longest`` bounds the texts' lengths."""
    return running_key_decrypt(text, ints([(p - 1) % N for p in first_primes(longest)]), skips)


def vigenere_encrypt(text: Column, key: list[int], interrupter: int | None = 0) -> Column:
    """Adds the key; plaintext equal to the interrupter passes and holds the key (None: no interrupter)."""
    stream = repeating(key)
    if interrupter is None:
        return apply_stream(text, stream, ADD)
    # positions of the interrupter, by which later ordinals fall back
    at = F.filter(F.transform(text, lambda x, i: F.when(x == interrupter, i)), lambda i: i.isNotNull())
    return let(at, lambda held: apply_stream(text, stream, ADD, held))


def autokey_ct_decrypt(text: Column, key: list[int], skips: Column | None = None) -> Column:
    """Keystream: the key, then the ciphertext symbols that are not skipped."""
    skips = no_skips() if skips is None else skips
    kept = F.filter(text, lambda x, i: ~_skipped(skips, i))
    return let(F.concat(ints(normal_key(key)), kept), lambda st: apply_stream(text, from_array(st), SUBTRACT, skips))


def autokey_pt_decrypt(texts: DataFrame, key_col: str, text_col: str, key: list[int], skips: str | None = None) -> DataFrame:
    """``key_col, out``: keystream is the key, then the plaintext already found; skipped symbols do not enter it.

    With m key symbols, ordinals of one residue mod m form an alternating sum, so the plaintext is
    a window sum over (text, residue). Skips are not range-checked. NULL texts give no row, empty
    texts an empty array.
    """
    k, m = normal_key(key), len(key)
    skip = F.col(skips) if skips else no_skips()
    rows = texts.select(key_col, skip.alias("_s"), F.posexplode(text_col).alias("pos", "x")).select(key_col, "pos", "x", _skipped(F.col("_s"), F.col("pos")).alias("held"), _ordinal(F.col("_s"), F.col("pos")).alias("j"))
    sign = F.when(F.expr(f"(j div {m}) % 2 = 0"), 1).otherwise(-1)
    chain = Window.partitionBy(key_col, "held", F.col("j") % m).orderBy("pos")
    total = F.sum(sign * F.col("x")).over(chain)
    plain = F.when(F.col("held"), F.col("x")).otherwise(mod(sign * (total - F.get(ints(k), F.col("j") % m)))).cast("int")
    done = rows.select(key_col, "pos", plain.alias("y")).groupBy(key_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda s: s["y"]).alias("out"))
    return texts.where(F.col(text_col).isNotNull()).select(key_col).join(done, key_col, "left").withColumn("out", F.coalesce("out", no_skips()))


def first_primes(n: int) -> list[int]:
    """The first n primes, for streams that are literals."""
    found: list[int] = []
    bound = 16
    while len(found) < n:
        bound *= 2
        sieve = bytearray([1]) * bound
        for i in range(2, int(bound**0.5) + 1):
            if sieve[i]:
                sieve[i * i :: i] = bytes(len(range(i * i, bound, i)))
        found = [i for i in range(2, bound) if sieve[i]]
    return found[:n]


def primes_below(spark: SparkSession, bound: int) -> DataFrame:
    """``p``: primes below a bound as a table; composites are struck out by a distributed sieve."""
    roots = first_primes(max(1, int(bound**0.5)))
    roots = [p for p in roots if p * p < bound]
    numbers = spark.range(2, bound).toDF("p")
    if not roots:
        return numbers
    struck = spark.createDataFrame([(p,) for p in roots], "r long").select(F.explode(F.sequence(F.col("r") * F.col("r"), F.lit(bound - 1), F.col("r"))).alias("p")).distinct()
    return numbers.join(struck, "p", "left_anti")


def prime_bound(n: int) -> int:
    """A bound below which there are at least n primes."""
    return max(16, int(n * (math.log(n + 2) + math.log(math.log(n + 2)) + 2)) + 1)


def keystream(primes: DataFrame) -> DataFrame:
    """``ord, k``: prime minus one by ordinal, for joins of long texts with their keystream; numbered by range partitions."""
    numbered = running_totals(primes.select("p", F.lit(1).alias("one")), ["p"], "one", "ord")
    return numbered.select("ord", (F.col("p") - 1).alias("k"))


def stream_decrypt(texts: DataFrame, key_col: str, text_col: str, stream: DataFrame, skips: str | None = None) -> DataFrame:
    """``key_col, out``: texts of any length less a keystream table (``ord, k``), symbol by symbol; skipped positions stay and take no key.

    Symbols are joined with the stream by ordinal. A stream that ends before a text is an error; null texts have no row.
    """
    skip = F.col(skips) if skips else no_skips()
    rows = texts.select(key_col, skip.alias("_s"), F.posexplode(text_col).alias("pos", "x")).select(key_col, "pos", "x", _skipped(F.col("_s"), F.col("pos")).alias("held"), _ordinal(F.col("_s"), F.col("pos")).cast("long").alias("ord"))
    keyed = rows.join(stream.select(F.col("ord").cast("long").alias("ord"), "k"), "ord", "left")
    ended = F.raise_error(F.lit("keystream exhausted")).cast("int")
    plain = F.when(F.col("held"), F.col("x")).when(F.col("k").isNull(), ended).otherwise(mod(F.col("x") - F.col("k"))).cast("int")
    done = keyed.select(key_col, "pos", plain.alias("y")).groupBy(key_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda s: s["y"]).alias("out"))
    return texts.where(F.col(text_col).isNotNull()).select(key_col).join(done, key_col, "left").withColumn("out", F.coalesce("out", no_skips()))


def key_sweep(texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``key_col, shift, out``: every text under every of the 29 shifts."""
    tries = F.array(*(F.struct(F.lit(k).alias("shift"), shift_decrypt(F.col(text_col), k).alias("out")) for k in range(N)))
    return texts.select(key_col, F.inline(tries))
