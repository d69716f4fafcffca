"""Items of varying length in containers of fixed capacity.

The number of containers is a configuration linear program over the histogram of lengths: a
configuration is a multiset of lengths that fits, and each length must be covered as often as it
occurs. Every length has a price, and a knapsack dynamic program finds the dearest configuration.
Prices start as the lengths' share of a container. Configurations are made one after another, each
around the largest open length; its other lengths are priced over a draw of the open lengths, which
is widened until the configuration is worth a container within the stated gap; it is taken as often
as the open items allow, so that amounts are whole from the start, and multiplicative weights make
lengths cheaper as they are covered. If the outcome misses the program's bound by more than the
gap, the prices themselves are found by multiplicative weights over full pricing rounds, which also
raises the bound, and configurations are made by those prices; what is left of the rounding goes to
best fit.

Only the histogram, at most one row per length up to the capacity, reaches the driver. Items get
their container by their rank within their length; ranks are counted in groups sized from the
counts, so one very common length does not end up in one task.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runeframe.session import cut_lineage

#: How far the worth of a configuration, and the number of containers, may stay from the program's bound.
GAP = 0.002
#: Speed at which covered lengths lose weight, and the number of lengths a configuration is first sought among.
RATE, DRAW = 0.02, 48
#: Items of one length that are ranked in one group.
GROUP_ROWS = 100_000
#: Rows up to which a table made on the driver, or counted there, is broadcast.
BROADCAST_ROWS = 1_000_000


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, dict[int, int]]:
    """Best total value per capacity, and the best configuration (copies by length).

    ``value[l]`` is the value of an item of length l; 0 bars a length. Knapsack with repetition.
    """
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = best[c - 1 :: -1] + value[1 : c + 1]  # entry l-1: an item of length l on top of c - l
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], choice[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    config: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if choice[c]:
            config[int(choice[c])] += 1
            c -= int(choice[c])
        else:
            c -= 1
    return best, dict(config)


def price_open(lengths: np.ndarray, value: np.ndarray, copies: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest configuration of at most ``copies`` items of each length, long lengths first. Bounded knapsack, copies in powers of two."""
    best = np.zeros(capacity + 1)
    steps: list[tuple[np.ndarray, int, int]] = []
    for length, worth, left in zip(lengths.tolist(), value.tolist(), copies.tolist()):
        part = 1
        while left > 0 and min(part, left) * length <= capacity:
            part = min(part, left)
            size = part * length
            with_it = best[: capacity + 1 - size] + part * worth
            better = with_it > best[size:]
            best[size:] = np.where(better, with_it, best[size:])
            steps.append((better, length, part))
            left -= part
            part *= 2
    config: dict[int, int] = {}
    c = capacity
    for better, length, part in reversed(steps):
        if c >= part * length and better[c - part * length]:
            config[length] = config.get(length, 0) + part
            c -= part * length
    return config


@dataclass(frozen=True)
class Plan:
    """Containers as (configuration, how many), the program's lower bound on their number, and the share of all length placed by configurations."""

    configurations: list[tuple[dict[int, int], int]]
    lower_bound: float
    share: float = 1.0

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.configurations)


def prices(demand: np.ndarray, capacity: int, start: np.ndarray, rounds: int = 200, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Prices that bound the number of containers best, and the bound: the demand's worth where no configuration is worth more than 1.

    ``rounds`` pricing rounds only tighten the bound; every round's prices give a valid one.
    """
    weight, found, bound = start.copy(), start, 0.0
    for _ in range(rounds):
        best, config = price(weight, capacity)
        if float((demand * weight).sum() / best[capacity]) > bound:
            bound, found = float((demand * weight).sum() / best[capacity]), weight / best[capacity]
        lengths, copies = np.fromiter(config, np.int64), np.fromiter(config.values(), np.float64)
        amount = float((demand[lengths] / copies).min())
        weight[lengths] *= np.exp(-rate * amount * copies / demand[lengths])
    return found, bound


def configured(demand: np.ndarray, capacity: int, value: np.ndarray, largest_first: bool, gap: float = GAP) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Configurations with whole amounts, and the demand they leave.

    With ``largest_first`` each is made around the largest open length and nothing is left. Without,
    the dearest is sought, first those within the gap of the bound, then within five and fifteen
    times the gap; what no such configuration holds is left.
    """
    left, weight = demand.copy(), value.copy()
    draw = np.random.default_rng(0)
    top = price(value, capacity)[0][capacity]
    made: list[tuple[dict[int, int], int]] = []
    for slack in (gap,) if largest_first else (gap, 5 * gap, 15 * gap):
        while left.any():
            open_ = np.flatnonzero(left)
            first = int(open_[-1]) if largest_first else 0
            room, copies = capacity - first, left.copy()
            copies[first] -= 1
            open_ = open_[(open_ <= room) & (copies[open_] > 0)]
            copies = np.minimum(copies[open_], room // open_)
            width, config, worth = DRAW, {}, 0.0
            while len(open_):
                some = np.arange(len(open_))
                if width < len(open_):
                    pressing = weight[open_] * copies
                    some = draw.choice(len(open_), width, replace=False, p=pressing / pressing.sum())
                some = np.sort(some)[::-1]
                config = price_open(open_[some], weight[open_[some]], copies[some], room)
                worth = value[first] + sum(value[length] * k for length, k in config.items())
                if worth >= (1 - slack) * top or width >= len(open_):
                    break
                width *= 4
            if largest_first:
                config[first] = config.get(first, 0) + 1
            elif worth < (1 - slack) * top:
                break
            lengths, held = np.fromiter(config, np.int64), np.fromiter(config.values(), np.int64)
            n = int((left[lengths] // held).min())
            left[lengths] -= n * held
            weight[lengths] *= np.exp(-RATE * n * held / demand[lengths])
            made.append((config, n))
    return made, left


def solve(histogram: dict[int, int], capacity: int, gap: float = GAP) -> Plan:
    """Configurations that hold every item of the histogram (lengths 1 to capacity)."""
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        demand[length] += n
    if not demand.any():
        return Plan([], 0.0)
    sizes = np.arange(capacity + 1)
    volume = np.where(demand > 0, sizes / capacity, 0.0)
    total = int((demand * sizes).sum())
    made, _ = configured(demand, capacity, volume, True, gap)
    plan = Plan(made, total / capacity)
    if plan.containers > (1 + gap) * np.ceil(plan.lower_bound):
        value, bound = prices(demand, capacity, volume)
        bound = max(bound, plan.lower_bound)
        plans = [Plan(made, bound)]
        for largest_first in (True, False):
            made, left = configured(demand, capacity, value, largest_first, gap)
            plans.append(Plan(_best_fit(made, left, capacity), bound, 1 - int((left * sizes).sum()) / total))
        plan = min(plans, key=lambda p: p.containers)
    return plan


def _best_fit(configurations: list[tuple[dict[int, int], int]], left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over counts: the rest goes where the least room remains, else into new containers."""
    by_room: dict[int, list[list]] = defaultdict(list)
    full: list[tuple[dict[int, int], int]] = []

    def put(config: dict[int, int], n: int) -> None:
        room = capacity - sum(length * k for length, k in config.items())
        (by_room[room].append([config, n]) if room else full.append((config, n)))

    for config, n in configurations:
        put(config, n)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            rooms = [r for r in by_room if r >= length and by_room[r]]
            if rooms:
                groups = by_room[min(rooms)]
                config, there = groups[-1]
                take = min(n, there)
                groups.pop() if take == there else groups[-1].__setitem__(1, there - take)
                put(config | {length: config.get(length, 0) + 1}, take)
            else:
                each = min(n, capacity // length)
                take = n // each
                put({length: each}, take)
                n -= take * each
                continue
            n -= take
    return full + [(config, n) for groups in by_room.values() for config, n in groups]


def slots(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """``length, from_rank, to_rank, first_container, copies``: ranks of a length and the containers they fill, ``copies`` in each."""
    rows, used, base = [], defaultdict(int), 0
    for config, n in plan.configurations:
        for length, k in sorted(config.items()):
            rows.append((length, used[length], used[length] + n * k, base, k))
            used[length] += n * k
        base += n
    return rows


def packed(sizes: DataFrame, id_col: str, size_col: str, capacity: int = 2048, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``id, part, size, container``: every item in a container, as few containers as possible.

    An item larger than the capacity is split into parts of the capacity, each filling a container,
    and a rest that is packed as an item; other items have one part, 1. Items of size 0 or null
    take no room and lie in container 0. Ids must be unique; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    whole = F.expr(f"size div {capacity}").cast("int")
    items = sizes.select(F.col(id_col).cast("long").alias("id"), size.alias("size"))
    pieces = items.select(
        "id",
        F.inline(
            F.when(F.col("size") <= capacity, F.array(F.struct(F.lit(1).alias("part"), F.col("size").alias("length")))).otherwise(
                F.concat(
                    F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: F.struct(i.alias("part"), F.lit(capacity).cast("long").alias("length"))),
                    F.filter(F.array(F.struct((whole + 1).alias("part"), (F.col("size") % capacity).alias("length"))), lambda p: p["length"] > 0),
                )
            )
        ),
    )
    pieces = cut_lineage(pieces)
    histogram = {r[0]: r[1] for r in pieces.where("length > 0").groupBy("length").agg(F.count(F.lit(1))).collect()}
    plan = slots(solve(histogram, capacity))
    spark = sizes.sparkSession
    # as many groups per length as its count asks for; a row per length, so at most ``capacity`` rows
    many = {length: -(-n // group_rows) for length, n in histogram.items()}
    dealt = spark.createDataFrame(list(many.items()) or [(0, 1)], "length long, groups long")
    grouped = pieces.where("length > 0").join(F.broadcast(dealt), "length").select("id", "part", "length", F.pmod(F.xxhash64("id", "part"), "groups").alias("g"))
    before = grouped.groupBy("length", "g").agg(F.count(F.lit(1)).alias("n")).select("length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    ranked = grouped.withColumn("r", F.row_number().over(Window.partitionBy("length", "g").orderBy("id", "part")) - 1)
    placed = ranked.join(_sent(before, sum(many.values())), ["length", "g"]).withColumn("rank", F.col("r") + F.col("before"))
    table = spark.createDataFrame(plan or [(0, 0, 0, 0, 1)], "length long, a long, b long, base long, copies long")
    filled = (
        placed.join(_sent(table, len(plan)), "length")
        .where("rank >= a and rank < b")
        .select("id", "part", F.col("length").alias("size"), (F.col("base") + F.expr("(rank - a) div copies")).alias("container"))
    )
    return filled.unionAll(pieces.where("length = 0").select("id", "part", F.col("length").alias("size"), F.lit(0).cast("long").alias("container")))


def _sent(table: DataFrame, rows: int) -> DataFrame:
    """The table with a broadcast hint if its number of rows, known beforehand, is within the bound; else joined by shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
