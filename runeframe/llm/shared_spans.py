"""Long exact spans shared between records.

A span is shared if at least ``k`` characters of a text appear verbatim in a text of another
owner. Texts are cut so that every window of ``k`` characters meets all its copies in one place:
each window is assigned to the smallest hash of the ``m``-grams in it, runs of windows with the
same smallest hash form one piece, and pieces go to the shard of that hash. A shard builds an
FM-index over its distinct pieces (a wavelet matrix over the Burrows-Wheeler transform)
and streams its pieces through it by backward search, all positions at once: the search yields the
matching statistics up to ``k``, and windows that reach ``k`` with more than one owner are shared.

Exact copies are merged before the shuffle at both levels (texts and pieces), so a text quoted in
a third of all rows is one text. Pieces of one hash must be indexed together; a hash whose pieces
exceed a portion is split: its pieces are cut again by the two smallest hashes of each window, then
by three and so on, until every group fits or its windows hold no further hash to tell them apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeframe.session import cut_lineage


class RankBits:
    """A bit vector with constant-time counts of ones before a position."""

    __slots__ = ("words", "before")

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (16 - len(packed) % 8), dtype="<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbol counts before a position, one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[RankBits, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((RankBits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """FM-index of a text over small integers for patterns of up to ``depth`` symbols.

    Suffixes are sorted by their first ``depth`` symbols, which is all that backward search of
    such patterns needs.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        n = len(text)
        rank, span = text.astype(np.int64) + 1, 1
        while span < depth:
            step = min(span, depth - span)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:]
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1
            span += step
        self.suffixes = np.argsort(rank, kind="stable")
        self.tree = WaveletMatrix(text[self.suffixes - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of ``symbol`` + pattern from those of the pattern."""
        base = self.first[symbol]
        return base + self.tree.rank(symbol, lo), base + self.tree.rank(symbol, hi)


def shared_windows(pieces: list[str], low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
    """For each distinct piece the start positions of its windows of ``k`` characters found with another owner.

    ``low`` and ``high`` are the smallest and largest owner of a piece's copies.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    joined = "\0".join(pieces) + "\0"
    text = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    alphabet, codes = np.unique(text, return_inverse=True)  # the separator is the smallest, 0
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    piece_of = np.repeat(np.arange(len(pieces)), lengths + 1)
    index = FMIndex(codes.astype(np.int64), len(alphabet), k)
    windows = np.concatenate([np.arange(s, s + n - k + 1) for s, n in zip(starts.tolist(), lengths.tolist()) if n >= k] or [np.zeros(0, np.int64)])
    own = piece_of[windows]
    trivially = low[own] != high[own]
    active = windows[~trivially]
    lo, hi = np.zeros(len(active), np.int64), np.full(len(active), len(codes), np.int64)
    for j in range(1, k + 1):  # matching statistics: leave as soon as the match is the window itself only
        lo, hi = index.extend(codes[active + k - j], lo, hi)
        more = hi - lo > 1
        active, lo, hi = active[more], lo[more], hi[more]
    hit = windows[trivially]
    if len(active):
        first, inverse = np.unique(lo, return_inverse=True)
        last = np.zeros(len(first), np.int64)
        last[inverse] = hi
        edges = np.stack((first, last), 1).ravel()
        owners = piece_of[index.suffixes]
        pad = lambda a, v: np.append(a, v)  # noqa: E731  # reduceat wants every edge inside
        smallest = np.minimum.reduceat(pad(low[owners], 0), edges)[::2]
        largest = np.maximum.reduceat(pad(high[owners], 0), edges)[::2]
        hit = np.concatenate((hit, active[(smallest != largest)[inverse]]))
    hit = np.sort(hit)
    cut = np.searchsorted(hit, np.append(starts, len(codes)))
    return [hit[cut[i] : cut[i + 1]] - starts[i] for i in range(len(pieces))]


def _gram_hashes(texts: list[str], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``m``-grams of the joined texts, and the texts' starts and lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(codes) - m + 1
    grams = np.zeros(n, np.uint64)
    for j in range(m):
        grams = grams * np.uint64(0x100000001B3) + codes[j : j + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return grams, starts, lengths


def _pieces_of(texts: list[str], k: int, m: int, smallest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end and hash of each piece; every text has at least ``k`` characters.

    The hash of a window is made of the ``smallest`` smallest different hashes in it, fewer where it holds fewer.
    """
    grams, starts, lengths = _gram_hashes(texts, m)
    width = k - m + 1
    at = np.repeat(starts, lengths - k + 1) + np.concatenate([np.arange(x) for x in (lengths - k + 1).tolist()])
    of = np.repeat(np.arange(len(texts)), lengths - k + 1)
    if smallest == 1:
        least, span = grams, 1
        while span < width:  # sliding minimum by doubling
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        hashes = least[at]
    else:
        inside = np.sort(np.lib.stride_tricks.sliding_window_view(grams, width)[at], axis=1)
        first = np.ones(inside.shape, bool)
        first[:, 1:] = inside[:, 1:] != inside[:, :-1]
        order = np.cumsum(first, axis=1)
        hashes = np.zeros(len(at), np.uint64)
        for j in range(width):  # the same windows have the same hashes, so the same mixture
            used = first[:, j] & (order[:, j] <= smallest)
            mixed = (hashes ^ inside[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            hashes = np.where(used, mixed ^ (mixed >> np.uint64(31)), hashes)
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return of[begin], at[begin] - starts[of[begin]], at[end] - starts[of[begin]] + k, hashes[begin].view(np.int64)


def _cut(k: int, m: int, smallest: int = 1):  # noqa: ANN202
    """Cuts texts ``(k1, k2, off, text, low, high)`` into pieces; offsets go on from those given."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(3).to_pylist()
            of, a, b, h = _pieces_of(texts, k, m, smallest)
            take = pa.array(of)
            pieces = [texts[t][x:y] for t, x, y in zip(of.tolist(), a.tolist(), b.tolist())]
            off = np.asarray(batch.column(2))[of] + a
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(off, pa.int32()), pa.array(pieces, pa.string()), pa.array(h, pa.int64()), batch.column(4).take(take), batch.column(5).take(take)],
                ["k1", "k2", "off", "piece", "h", "low", "high"],
            )

    return run


def _search(k: int, portion: int):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        held: list[tuple] = []
        size = 0

        def flush():  # noqa: ANN202
            pieces, low, high = zip(*held)
            found = shared_windows(list(pieces), np.array(low, np.int64), np.array(high, np.int64), k)
            keep = [i for i, f in enumerate(found) if len(f)]
            return pa.RecordBatch.from_arrays([pa.array([pieces[i] for i in keep], pa.string()), pa.array([found[i] for i in keep], pa.list_(pa.int32()))], ["piece", "starts"])

        last = None
        for batch in batches:
            for h, piece, low, high in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= portion and h != last:  # the pieces of one hash stay together
                    yield flush()
                    held, size = [], 0
                held.append((piece, low, high))
                size += len(piece) + 1
                last = h
        if held:
            yield flush()

    return run


PIECES = "k1 long, k2 int, off int, piece string, h long, low long, high long"


def _settled(pieces: DataFrame, k: int, m: int, portion: int, salts: int) -> DataFrame:
    """The pieces, those of hashes with more than ``portion`` characters of different pieces cut again by more hashes.

    Only the hot hashes come to a decision here, and only their number reaches the driver.
    """
    pieces = cut_lineage(pieces)
    calm: list[DataFrame] = []
    for smallest in range(2, k - m + 2):
        sizes = pieces.select("h", "piece").distinct().groupBy("h").agg(F.sum(F.length("piece")).alias("size"))
        hot = cut_lineage(sizes.where(F.col("size") > portion).select("h"))
        if hot.isEmpty():
            break
        # a hot hash is one row on the small side, repeated per salt, so its pieces are not gathered
        spread = hot.select("h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("hot"))
        marked = pieces.withColumn("salt", F.pmod(F.xxhash64("k1", "off"), F.lit(salts)).cast("int")).join(spread, ["h", "salt"], "left")
        calm.append(marked.where("hot is null").select(*pieces.columns))
        again = marked.where("hot").select("k1", "k2", "off", "piece", "low", "high")
        pieces = cut_lineage(again.mapInArrow(_cut(k, m, smallest), PIECES))
    for part in calm:
        pieces = pieces.unionAll(part)
    return pieces


def shared_lengths(rows: DataFrame, id_col: str, text_col: str, owner_col: str, k: int = 24, m: int = 12, portion: int = 1 << 20, salts: int = 8) -> DataFrame:
    """``id, n_shared``: positions of each text in spans of at least ``k`` characters that another owner's text holds too.

    Only rows with ``n_shared`` > 0. Null texts and texts shorter than ``k`` share nothing; rows
    with a null owner count as one further owner; repeated rows are reported each; other columns
    are ignored. ``portion`` is the number of characters indexed at once, and of one hash.
    """
    if not 0 < m <= k:
        raise ValueError("need 0 < m <= k")
    text = F.col("text")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(owner_col).cast("long"), F.lit(-(2**63))).alias("owner")).where(F.length("text") >= k)
    keys = [F.xxhash64(text).alias("k1"), F.hash(text, F.lit("text")).alias("k2")]
    distinct = base.groupBy("text").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).select(*keys, "text", "low", "high")
    pieces = _settled(distinct.select("k1", "k2", F.lit(0).alias("off"), "text", "low", "high").mapInArrow(_cut(k, m), PIECES), k, m, portion, salts)
    merged = pieces.groupBy("h", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = merged.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(_search(k, portion), "piece string, starts array<int>")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    spans = (
        pieces.select("k1", "k2", "off", "piece", F.pmod("k1", F.lit(salts)).cast("int").alias("salt"))
        .join(shared.select("piece", "starts", salt), ["piece", "salt"])
        .select("k1", "k2", F.transform("starts", lambda s: s + F.col("off")).alias("starts"))
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))
    )
    # positions covered by windows [s, s + k): each window adds what the one before does not cover
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-(2**30)).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.lit(k) - F.greatest(acc["end"] - s, F.lit(0))).alias("n"), (s + k).alias("end")),
    )["n"]
    result = spans.select("k1", "k2", covered.cast("long").alias("n_shared"), salt)
    keyed = base.select("id", *keys, F.pmod("id", F.lit(salts)).cast("int").alias("salt"))
    return keyed.join(result, ["k1", "k2", "salt"]).select("id", "n_shared")
