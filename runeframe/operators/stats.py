"""Statistics of symbol streams held as canonical strings.

Per-text figures are higher-order expressions on the string, without a shuffle. Figures over a
corpus aggregate exploded n-grams with map-side partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.functions.alphabet import CANON, N


def counts(canon: Column) -> Column:
    """Array of 29 counts."""
    return F.array(*(F.length(canon) - F.length(F.replace(canon, F.lit(c), F.lit(""))) for c in CANON))


def _ioc_of(counted: Column, n: Column) -> Column:
    pairs = F.aggregate(counted, F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * (v - 1))
    n = n.cast("long")
    return F.when(n < 2, F.lit(0.0)).otherwise(pairs / F.greatest(n * (n - 1), F.lit(1)) * N)


def ioc(canon: Column) -> Column:
    """Coincidence index times 29; 0 below two symbols."""
    return _ioc_of(counts(canon), F.length(canon))


def coset(canon: Column, period: int, k: int) -> Column:
    """Every ``period``-th symbol from ``k`` on."""
    if period < 1:
        raise ValueError("period must be positive")
    head = F.substring(canon, k + 1, 2**30)
    return F.regexp_replace(head, f"(?s)(.).{{0,{period - 1}}}", "$1")


def periodic_ioc(canon: Column, period: int) -> Column:
    """Mean coincidence index of the cosets with two or more symbols; 0 if there is none."""
    if period < 1:
        raise ValueError("period must be positive")
    cosets = F.array(*(coset(canon, period, k) for k in range(period)))
    figures = F.transform(F.filter(cosets, lambda c: F.length(c) >= 2), ioc)
    return F.when(F.size(figures) > 0, F.aggregate(figures, F.lit(0.0), lambda a, v: a + v) / F.size(figures)).otherwise(F.lit(0.0))


def periods(texts: DataFrame, key: str, canon: str, least: int = 2, most: int = 12) -> DataFrame:
    """``key, period, ioc``: the coincidence index of every period of every text, as ``periodic_ioc`` gives it.

    All texts of an Arrow batch are counted at once, once per period: as expressions this would be
    one pass over the text per coset and symbol.
    """
    if not 1 <= least <= most:
        raise ValueError("need 1 <= least <= most")
    spans = np.arange(least, most + 1)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            of = np.repeat(np.arange(len(texts)), sizes)
            at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            symbol = indices("".join(texts))
            figures = np.zeros((len(texts), len(spans)))
            for j, period in enumerate(spans.tolist()):
                counted = np.bincount((of * period + at % period) * N + symbol, minlength=len(texts) * period * N).reshape(-1, N)
                size = counted.sum(1)
                coset = (counted * (counted - 1)).sum(1) / np.maximum(size * (size - 1), 1) * N
                several = (size >= 2).reshape(-1, period)
                figures[:, j] = (coset.reshape(-1, period) * several).sum(1) / np.maximum(several.sum(1), 1)
            take = pa.array(np.repeat(np.arange(len(texts)), len(spans)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.tile(spans, len(texts)), pa.int32()), pa.array(figures.ravel())], [key, "period", "ioc"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, canon).where(F.col(canon).isNotNull()).mapInArrow(run, f"{key} {kind}, period int, ioc double")


def indices(joined: str) -> np.ndarray:
    """Symbol indices of a canonical string."""
    at = np.full(256, -1, np.int64)
    at[np.frombuffer(CANON.encode(), np.uint8)] = np.arange(N)
    found = at[np.frombuffer(joined.encode(), np.uint8)]
    if (found < 0).any():
        raise ValueError("not a canonical string")
    return found


def entropy(canon: Column) -> Column:
    """Bits per symbol; 0 for an empty text."""
    n = F.greatest(F.length(canon), F.lit(1)).cast("double")
    bits = F.transform(F.filter(counts(canon), lambda v: v > 0), lambda v: -(v / n) * F.log2(v / n))
    return F.aggregate(bits, F.lit(0.0), lambda a, v: a + v)


def doublets(canon: Column) -> Column:
    """Number of positions that repeat the symbol before."""
    return F.size(F.regexp_extract_all(canon, F.lit(r"(?=(.)\1)"), F.lit(1)))


def doublet_rate(canon: Column) -> Column:
    n = F.length(canon)
    return F.when(n > 1, doublets(canon) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))


def chi_squared(canon: Column, reference: list[float]) -> Column:
    """Chi-squared against reference shares; infinite for an empty text or a symbol the reference lacks."""
    if len(reference) < N:
        raise ValueError(f"the reference needs {N} shares")
    n = F.length(canon)
    zipped = F.zip_with(counts(canon), F.array(*map(F.lit, reference)), lambda v, p: F.struct(v.alias("v"), p.alias("p")))
    impossible = F.exists(zipped, lambda z: (z["v"] > 0) & (z["p"] <= 0))
    terms = F.transform(F.filter(zipped, lambda z: z["p"] > 0), lambda z: F.pow(z["v"] - z["p"] * n, F.lit(2)) / (z["p"] * n))
    return F.when((n == 0) | impossible, F.lit(float("inf"))).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))


def ngrams(canon: Column, n: int) -> Column:
    """Array of the overlapping n-grams; empty for shorter texts. Linear in the text."""
    if n < 1:
        raise ValueError("n must be positive")
    return F.regexp_extract_all(canon, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))


def positions_of(canon: Column, needle: str) -> Column:
    """Array of all positions of a needle, overlapping ones included, from 0."""
    if not needle:
        raise ValueError("the needle is empty")
    quoted = "".join(c if c.isalnum() else "\\" + c for c in needle)
    parts = F.filter(F.split(canon, f"(?={quoted})"), lambda p: p != "")  # every part but perhaps the first starts with the needle
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when(F.startswith(p, F.lit(needle[0])), F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"]).alias("found")),
    )["found"]
    # the first part may start with the needle's first symbol without being a match
    return F.when(F.startswith(canon, F.lit(needle)), walked).otherwise(F.filter(walked, lambda i: i > 0))


def rune_counts(texts: DataFrame, canon: str) -> DataFrame:
    """``idx, n``: histogram over all texts; partial counts per text before the shuffle."""
    return (
        texts.select(F.posexplode(counts(F.col(canon))).alias("idx", "v"))
        .where("v > 0")
        .groupBy("idx")
        .agg(F.sum("v").alias("n"))
    )


def rune_frequencies(texts: DataFrame, canon: str) -> DataFrame:
    """``idx, share``: 29 rows, 0 for absent symbols and for an empty input."""
    sums = texts.agg(*(F.coalesce(F.sum(F.length(canon) - F.length(F.replace(canon, F.lit(c), F.lit("")))), F.lit(0)).alias(c) for c in CANON))
    total = sum((F.col(c) for c in CANON[1:]), F.col(CANON[0]))
    return sums.select(F.posexplode(F.array(*(F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in CANON))).alias("idx", "share"))


def ngram_counts(texts: DataFrame, canon: str, n: int) -> DataFrame:
    """``gram, n`` over all texts."""
    return texts.select(F.explode(ngrams(F.col(canon), n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def repeats(texts: DataFrame, key: str, canon: str, length: int = 3, least: int = 2) -> DataFrame:
    """``key, gram, positions``: n-grams of exactly ``length`` found ``least`` times or more in a text, overlaps included."""
    grams = texts.select(key, F.posexplode(ngrams(F.col(canon), length)).alias("pos", "gram"))
    return grams.groupBy(key, "gram").agg(F.array_sort(F.collect_list("pos")).alias("positions")).where(F.size("positions") >= least)


def kasiski_gaps(texts: DataFrame, key: str, canon: str, length: int = 3) -> DataFrame:
    """``gap, n``: distances between consecutive repetitions, over all texts."""
    grams = texts.select(key, F.posexplode(ngrams(F.col(canon), length)).alias("pos", "gram"))
    before = F.lag("pos").over(Window.partitionBy(key, "gram").orderBy("pos"))
    return grams.select((F.col("pos") - before).alias("gap")).where("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
