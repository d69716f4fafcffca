"""Sessions and packed fields: definitions, edge cases, brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runeframe.operators.packed import Packing, Splitter, split_packed
from runeframe.operators.sessions import sessionize
from runeframe.plans.packed import LEAD, NUMBERS
from runeframe.plans.sessions import message_times


def brute_sessions(events, gap):
    out = []
    for k in {k for k, _ in events}:
        times = sorted(t for key, t in events if key == k)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > gap:
                out.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((k, run[0], run[-1], len(run)))
    return sorted(out)


def test_sessions_equal_brute_force(spark):
    rnd, base = random.Random(3), datetime(2020, 1, 1)
    events = [(rnd.choice("aaab"), base + timedelta(minutes=rnd.randint(0, 20_000))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in events], "ch string, at timestamp, k int, d int, open int")
    got = sorted((r["ch"], r["start_at"], r["end_at"], r["n_events"]) for r in sessionize(df, "ch", "at", 6 * 3600).collect())
    assert got == brute_sessions(events, timedelta(hours=6))


def test_exact_gap_does_not_split_and_ties_count(spark):
    t = datetime(2020, 1, 1)
    rows_ = [("a", t), ("a", t), ("a", t + timedelta(hours=6)), ("a", t + timedelta(hours=12, minutes=1)), ("a", None), (None, t)]
    got = sorted((r["start_at"], r["duration_s"], r["n_events"]) for r in sessionize(spark.createDataFrame(rows_, "k string, at timestamp"), "k", "at", 6 * 3600).collect())
    assert got == [(t, 21600, 3), (t + timedelta(hours=12, minutes=1), 0, 1)]


def test_sessions_of_nothing(spark):
    assert sessionize(spark.createDataFrame([], "k string, at timestamp"), "k", "at", 60).count() == 0


def test_message_times(spark, rows):
    data = [(1, "c", 1, "2020-01-01 10:00"), (9, "c", 1, "2020-01-01 10:00"), (2, "c", 2, "2020-01-01T10:05"), (3, "c", 3, "1/2/2020 3:04 PM"), (4, "c", 4, None), (5, "c", 5, "  "), (6, "c", 6, "13/40/2020 1:00 PM"), (7, None, 1, "2020-01-01 10:00"), (8, "c", None, "2020-01-01 10:06"), (10, "c", None, "2020-01-01 10:06")]
    got = message_times(spark.createDataFrame(data, "id long, channel string, seq int, ts string"))
    assert sorted(r["at"].isoformat()[:16] for r in got.collect()) == ["2020-01-01T10:00", "2020-01-01T10:05", "2020-01-01T10:06", "2020-01-01T10:06", "2020-01-02T15:04"]


def test_splitter_protects_quotes_and_known_values():
    split = Splitter(Packing(lead=LEAD, known=("Salt, Iron", "Quiet / Well")))
    assert split('Tags: "a, b" | \'c;d\'\t“e/f”; plain one,, , "say ""x""" / "it \\"y\\""') == ["a, b", "c;d", "e/f", "plain one", 'say "x"', 'it "y"']
    assert split("keys = Salt, Iron; quiet / well, x 'y") == ["Salt, Iron", "quiet / well", "x 'y"]
    assert split("pages: 40-48;; p17\n40") == ["40-48", "p17", "40"]
    assert split('cribs="open, b') == ['"open', "b"]
    assert split("KEYS:") == split("pages 28-55 and lines") == split(None) == split("") == []


def test_numbers_as_written():
    split = Splitter(NUMBERS)
    assert split('"05", 3;; 17:20-1\t\'0\'') == ["05", "3", "17", "20", "1", "0"]
    assert split("1​5 , 7") == ["15", "7"]
    assert split(" , ;") == []


def test_split_packed_rows(spark, rows):
    df = spark.createDataFrame([(1, "a,b", 5), (2, None, 5), (3, "", 5), (4, " , ", 5), (5, "a,b", 5), (6, "x" * 100_000 + ",y", 5)], "id long, t string, pos int")
    got = rows(split_packed(df, "id", "t", Packing()))
    assert got[:2] == [(1, 1, "a"), (1, 2, "b")] and (5, 2, "b") in got and (6, 2, "y") in got and len(got) == 6
    assert split_packed(df.limit(0), "id", "t", Packing()).count() == 0
    assert split_packed(df.where(F.lit(True)), "id", "t", Packing()).columns == ["id", "pos", "value"]
