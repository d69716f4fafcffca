"""Language fitness: an n-gram model of spelled text, scores and sliding windows.

The model has at most 29^n rows, a bound that does not grow with the corpus, which is why it may
be broadcast. Scores over many windows of a text come from prefix sums, each n-gram looked up once.
The best window and the best shift of whole tables are found inside the row, in Arrow batches with
the model as an array: Spark has no expression that looks up a text's n-grams without exploding them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.functions.alphabet import CANON, N
from runeframe.operators.stats import indices, ngram_counts, ngrams
from runeframe.session import cut_lineage

FLOOR_PENALTY = 2.0
#: Models of up to this n are broadcast: at most 29^4 = 707,281 rows.
BROADCAST_N = 4


def boundaries(texts: DataFrame, canon: str, order: str, n: int) -> DataFrame:
    """``canon``: around each boundary between texts in order, up to ``n - 1`` symbols before it and as many after.

    Their n-grams are those of the concatenated texts that no text has alone, each once: they start
    in the text before the boundary. The symbols after it may come from several short texts. Texts
    are range-partitioned by ``order`` (unique); what follows a partition comes from one row of
    first symbols per partition.
    """
    m = n - 1
    edges = texts.where(F.length(canon) > 0).select(F.col(order).alias("o"), F.right(canon, F.lit(m)).alias("tail"), F.left(canon, F.lit(m)).alias("head"))
    ranged = cut_lineage(edges.repartitionByRange("o").withColumn("p", F.spark_partition_id()))
    inside = Window.partitionBy("p").orderBy("o")

    def following(value: str, window) -> Column:  # noqa: ANN001
        return F.left(F.array_join(F.collect_list(value).over(window.rowsBetween(1, m)), ""), F.lit(m))

    firsts = ranged.withColumn("k", F.row_number().over(inside)).where(F.col("k") <= m).groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "head"))), lambda s: s["head"]), "").alias("head"))
    after = firsts.select("p", following("head", Window.orderBy("p")).alias("after"))  # one row per partition
    follow = F.left(F.concat(following("head", inside), "after"), F.lit(m))
    return ranged.join(F.broadcast(after), "p").select(F.concat("tail", follow).alias("canon")).where(F.length("canon") >= n)


def model(texts: DataFrame, canon: str, n: int = 4, order: str | None = None) -> DataFrame:
    """``gram, logp, floor``: log10 shares of the n-grams, and the value of an n-gram that was never seen.

    With ``order`` the texts count as one text in that order, so n-grams span their boundaries.
    """
    counted = ngram_counts(texts, canon, n)
    if order is not None and n > 1:
        spanning = ngram_counts(boundaries(texts, canon, order, n), "canon", n)
        counted = counted.unionAll(spanning).groupBy("gram").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)  # read for the shares, the total and the floor, and counted once
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("gram", F.log10(F.col("n") / F.col("total")).alias("logp"), (F.log10(F.lit(1.0) / F.col("total")) - FLOOR_PENALTY).alias("floor"))


def training_sha256(texts: DataFrame, canon: str, order: str) -> tuple[str, int]:
    """SHA-256 over one byte per symbol of the texts in order, and the number of symbols.

    A running digest depends on order and cannot be taken in parts, so the texts stream through the
    driver one partition at a time and are never held together; ``training_digest`` of the
    queries is the distributed form.
    """
    digest, n = hashlib.sha256(), 0
    place = str.maketrans({c: chr(i) for i, c in enumerate(CANON)})
    for (text,) in texts.where(F.col(canon).isNotNull()).orderBy(order).select(canon).toLocalIterator():
        digest.update(text.translate(place).encode("latin-1"))
        n += len(text)
    return digest.hexdigest(), n


def _looked_up(grams: DataFrame, fitted: DataFrame, n: int) -> DataFrame:
    known = fitted.select("gram", "logp")
    floor = F.broadcast(fitted.agg(F.max("floor").alias("floor")))
    return grams.join(F.broadcast(known) if n <= BROADCAST_N else known, "gram", "left").join(floor).withColumn("value", F.coalesce("logp", "floor"))


def score(texts: DataFrame, key: str, canon: str, fitted: DataFrame, n: int = 4) -> DataFrame:
    """``key, score``: mean log10 share per n-gram; texts shorter than n have no score and no row."""
    if n < 1:
        raise ValueError("n must be positive")
    grams = texts.select(key, F.explode(ngrams(F.col(canon), n)).alias("gram"))
    # a text's n-grams stay in its task up to the partial mean, so one row per text is shuffled
    return _looked_up(grams, fitted, n).groupBy(key).agg(F.avg("value").alias("score"))


def windowed(texts: DataFrame, key: str, canon: str, fitted: DataFrame, size: int = 100, step: int = 25, n: int = 4) -> DataFrame:
    """``key, start, score``: scores of windows of ``size`` every ``step``, and of the last ``size`` symbols.

    Texts of at most ``size`` symbols have one window, texts shorter than n none. The windows
    come from a running sum over the text's n-grams.
    """
    if step < 1 or size < n:
        raise ValueError("step must be positive and size at least n")
    base = texts.select(key, F.length(canon).alias("len"), F.posexplode(ngrams(F.col(canon), n)).alias("pos", "gram"))
    along = Window.partitionBy(key).orderBy("pos")
    valued = _looked_up(base, fitted, n).withColumn("upto", F.sum("value").over(along))
    width = F.least(F.lit(size), F.col("len")) - (n - 1)
    last = F.greatest(F.col("len") - size, F.lit(0))
    start = F.col("pos") - width + 1
    before = F.coalesce(F.lag("upto", size - n + 1).over(along), F.lit(0.0))
    return valued.withColumn("start", start).withColumn("score", (F.col("upto") - before) / width).where((F.col("start") >= 0) & ((F.col("start") % step == 0) | (F.col("start") == last)) & (F.col("start") <= last)).select(key, "start", "score")


def _codes(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n-grams along the last axis."""
    last = x.shape[-1] - n + 1
    return sum(x[..., j : last + j] * N ** (n - 1 - j) for j in range(n))


def value_table(fitted: DataFrame, n: int) -> np.ndarray:
    """The value of every possible n-gram by its number; n is at most ``BROADCAST_N``, which bounds the rows collected."""
    if not 1 <= n <= BROADCAST_N:
        raise ValueError(f"n must be 1 to {BROADCAST_N}")
    known = fitted.select("gram", "logp", "floor").toArrow()
    values = np.full(N**n, known["floor"][0].as_py() if len(known) else np.nan)
    values[_codes(indices("".join(known["gram"].to_pylist())).reshape(-1, n), n)[:, 0]] = known["logp"].to_numpy()
    return values


def _per_text(texts: DataFrame, key: str, canon: str, n: int, handle, columns: str) -> DataFrame:  # noqa: ANN001
    """``key`` and the columns of ``handle(indices)`` for every text of at least n symbols."""
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, {columns}"

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            batch = batch.filter(pc.greater_equal(pc.binary_length(batch.column(1)), n))
            made = list(zip(*(handle(indices(t)) for t in batch.column(1).to_pylist())))
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m, t, from_pandas=True) for m, t in zip(made, types))], names)

    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in columns.split(", ")]
    return texts.select(key, canon).mapInArrow(run, schema)  # a filter on the length here would compute the text twice


def best_window(texts: DataFrame, key: str, canon: str, fitted: DataFrame, size: int = 100, step: int = 25, n: int = 4) -> DataFrame:
    """``key, best``: the highest score of the windows that ``windowed`` gives, without a shuffle."""
    if step < 1 or size < n:
        raise ValueError("step must be positive and size at least n")
    values = value_table(fitted, n)

    def best(x: np.ndarray) -> tuple[float]:
        upto = np.concatenate(([0.0], np.cumsum(values[_codes(x, n)])))
        width = min(size, len(x)) - n + 1
        last = max(len(x) - size, 0)
        starts = np.append(np.arange(0, last + 1, step), last)
        return (float(((upto[starts + width] - upto[starts]) / width).max()),)

    return _per_text(texts, key, canon, n, best, "best double")


def best_shift(texts: DataFrame, key: str, canon: str, fitted: DataFrame, n: int = 4, digits: int = 5) -> DataFrame:
    """``key, shift, score``: the shift whose decryption has the highest score to ``digits`` places, the smallest of equal ones."""
    values = value_table(fitted, n)
    shifts = np.arange(N)[:, None]

    def best(x: np.ndarray) -> tuple[int, float]:
        scores = np.round(values[_codes((x - shifts) % N, n)].mean(axis=1), digits)
        k = int(scores.argmax())
        return k, float(scores[k])

    return _per_text(texts, key, canon, n, best, "shift int, score double")
