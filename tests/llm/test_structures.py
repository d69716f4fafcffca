"""Conversations, shared spans, tokens, containers and stuffed pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runeframe.llm import conversations as CV
from runeframe.llm import packing as PK
from runeframe.llm import shared_spans as SS
from runeframe.llm import stuffing as ST
from runeframe.llm import tokens as TK


def test_pointer_jumping(spark, rows):
    data = [("a", i, i - 1 if i > 1 else None) for i in range(1, 101)]  # a long chain
    data += [("b", 1, None), ("b", 3, 2), ("b", 4, 3)]  # a hole
    data += [("c", 1, 3), ("c", 2, 1), ("c", 3, 2), ("c", 9, 3)]  # a cycle with a tail
    data += [(None, 1, None), ("d", None, None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in data], "g2 string, node int, par int, p int, s int")
    got = {(g, v): s for g, v, s in rows(CV.resolve_parents(df, "g2", "node", "par"))}
    assert len(got) == 107 and all(s == "whole" for (g, _), s in got.items() if g == "a")
    assert got["b", 1] == "whole" and got["b", 3] == got["b", 4] == "orphan"
    assert {got["c", v] for v in (1, 2, 3, 9)} == {"cycle"}
    assert CV.resolve_parents(df.limit(0), "g2", "node", "par").count() == 0


MEMBERS = [("ann", "user", 1), ("bot-x", "assistant", 1), ("sys", "system", 1)]
THREADS = {
    "good": [(1, "sys", "Thread opened."), (2, " ANN (pinned)", "why?"), (3, "bot-x", "so")],
    "repeated": [(2, "bot-x", "so"), (1, "ann", "why?"), (1, "ann", "why?")],
    "hole": [(1, "ann", "why?"), (3, "bot-x", "so")],
    "late start": [(2, "ann", "why?"), (3, "bot-x", "so")],
    "nameless": [(1, "ann", "why?"), (2, "bot-x", "so"), (3, None, "x")],
    "blank name": [(1, "ann", "why?"), (2, "bot-x", "so"), (3, " ​", "x")],
    "unanswered": [(1, "bot-x", "so"), (2, "ann", "why?")],
    "invisible answer": [(1, "ann", "why?"), (2, "bot-x", "​ ⁠")],
    "invisible question": [(1, "ann", None), (2, "bot-x", "so")],
    "unplaced": [(1, "ann", "why?"), (2, "bot-x", "so"), (None, "ann", "x")],
    "empty": [],
}


def test_threads(spark, rows):
    messages = [(i, c, s, a, b, 0) for i, (c, s, a, b) in enumerate((c, *r) for c, rs in THREADS.items() for r in rs)] + [(99, "page", 5, None, None, 0)]
    m = spark.createDataFrame(messages, "id long, channel string, seq int, author string, body string, handle int")
    c = spark.createDataFrame([(c, "thread", 0) for c in THREADS] + [("page", "page", 0), (None, "thread", 0)], "channel string, kind string, seq int")
    who = spark.createDataFrame(MEMBERS, "author string, speaker_role string, id int")
    states = {r["channel"]: r for r in CV.thread_states(m, c, who).collect()}
    assert set(states) == set(THREADS)
    assert {k for k, r in states.items() if not (r["broken"] or r["nameless"] or r["unanswered"])} == {"good", "repeated"}
    assert states["hole"]["broken"] and states["nameless"]["nameless"] and states["invisible answer"]["unanswered"] and states["empty"]["broken"]
    turns = [(r["channel"], r["seq"], r["role"]) for r in CV.conversations(m, c, who).orderBy("channel", "seq").collect()]
    assert turns == [("good", 1, "system"), ("good", 2, "user"), ("good", 3, "assistant"), ("repeated", 1, "user"), ("repeated", 2, "assistant")]
    assert CV.thread_states(m.limit(0), c.limit(0), who).count() == 0
    doubled = who.unionAll(spark.createDataFrame([("ANN", "system", 1), ("ann ", "zzz", 1)], who.schema))
    assert {r["role"] for r in CV.conversations(m, c, doubled).where("lower(author) like '%ann%'").collect()} == {"system"} or CV.conversations(m, c, doubled).count() == 0


def brute_shared(rows_, k):
    owners = {}
    for _, t, o in rows_:
        for j in range(len(t or "") - k + 1):
            owners.setdefault(t[j : j + k], set()).add(o)
    out = {}
    for i, t, o in rows_:
        hit = {p for j in range(len(t or "") - k + 1) if len(owners[t[j : j + k]]) > 1 for p in range(j, j + k)}
        if hit:
            out[i] = len(hit)
    return out


@pytest.mark.parametrize("portion", [1 << 20, 40])
def test_shared_spans_equal_brute_force(spark, portion):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    passage = word(60)
    data = [(i, word(rnd.randint(0, 50)) + (passage[rnd.randint(0, 20) :] if i % 3 == 0 else "") + word(5), rnd.randint(0, 9)) for i in range(40)]
    data += [(50, "a" * 70, 1), (51, "a" * 30, 2), (52, passage, None), (53, None, 1), (54, "", 1), (55, data[0][1], data[0][2]), (56, data[0][1], 77)]
    df = spark.createDataFrame([(*r, 0, 0) for r in data], "rid long, txt string, own long, h int, k1 int")
    got = {r[0]: r[1] for r in SS.shared_lengths(df, "rid", "txt", "own", 12, 6, portion, 2).collect()}
    assert got == brute_shared(data, 12) and got
    assert SS.shared_lengths(df.limit(0), "rid", "txt", "own", 12, 6).count() == 0


def test_hot_hashes_are_split():
    """One gram in every text makes one hash hot; its windows part by their further hashes, the result stays exact."""
    rnd = random.Random(15)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    texts = [word(9) + "qqqqqq" + word(9) for _ in range(200)]
    of, a, b, one = SS._pieces_of(texts, 12, 6)
    _, _, _, two = SS._pieces_of(texts, 12, 6, 2)
    group = lambda h: max(np.unique(h, return_counts=True)[1])
    assert group(two) < group(one)
    same = {}
    for smallest in (1, 2, 3, 7):  # equal windows always meet
        of, a, b, h = SS._pieces_of(texts, 12, 6, smallest)
        for t, x, y, key in zip(of.tolist(), a.tolist(), b.tolist(), h.tolist()):
            for j in range(x, y - 11):
                assert same.setdefault((smallest, texts[t][j : j + 12]), key) == key


def test_shared_spans_with_hot_hashes(spark):
    rnd = random.Random(16)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    data = [(i, word(8) + "a" * 9 + word(8), i % 7) for i in range(60)]
    df = spark.createDataFrame(data, "rid long, txt string, own long")
    assert {r[0]: r[1] for r in SS.shared_lengths(df, "rid", "txt", "own", 12, 6, 100, 2).collect()} == brute_shared(data, 12)


def test_fm_index_counts():
    rnd = np.random.default_rng(1)
    text = np.append(rnd.integers(1, 5, 400), 0)
    index = SS.FMIndex(text, 5, 6)
    joined = "".join(map(str, text))
    for _ in range(50):
        pattern = rnd.integers(1, 5, rnd.integers(1, 7))
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        needle = "".join(map(str, pattern))
        assert hi[0] - lo[0] == sum(joined.startswith(needle, i) for i in range(len(joined)))


@pytest.fixture(scope="module")
def vocabulary():
    return TK.Vocabulary(*TK.load(f"{TK.TOKENIZERS}/byte_bpe_50k.tiktoken"))


def test_tokens_equal_public_library(spark, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    want = tiktoken.Encoding("own", pat_str=TK.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rnd, encode, decode = random.Random(2), TK.Encoder(vocabulary), TK.Decoder(vocabulary.tokens)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ᚠᚢ", " ", "12", "!", "'s", "　", "日本", "👩‍💻", "\r\n", "<|endoftext|>", "\x1c", "\x85"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + ["x" * 40_000, "aeiou" * 9_000, " " * 3000]
    for t in texts:
        ids = np.frombuffer(encode(t), "<i4").tolist()
        assert ids == want(t) and decode(ids) == t


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "the cat", 0), (2, None, 0), (3, "", 0), (4, " ", 0), (5, "the cat", 0)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in TK.encoded(df, "doc_id", "text").collect()}
    assert got[1] == got[5] and len(got[1]) == 2 and got[2] == got[3] == [] and len(got[4]) == 1
    assert {r[0]: r[1] for r in TK.counted(df, "doc_id", "text").collect()} == {1: 2, 2: 0, 3: 0, 4: 1, 5: 2}
    assert TK.encoded(df.limit(0), "doc_id", "text").count() == 0
    back = TK.decoded(TK.encoded(df, "doc_id", "text").unionAll(spark.createDataFrame([(9, None)], "doc_id long, ids array<int>")), "doc_id", "ids")
    assert {r[0]: r[1] for r in back.collect()} == {1: "the cat", 2: "", 3: "", 4: " ", 5: "the cat", 9: None}


def check_packing(items, capacity, placed):
    load, parts = {}, {}
    for i, part, size, container in placed:
        load[container] = load.get(container, 0) + size
        parts.setdefault(i, []).append((part, size))
    assert max(load.values(), default=0) <= capacity
    assert set(parts) == {i for i, _ in items}
    for i, size in items:
        sizes = [s for _, s in sorted(parts[i])]
        assert sum(sizes) == (size or 0)
        assert len(sizes) == 1 if (size or 0) <= capacity else all(s == capacity for s in sizes[:-1])
    return len(load)


def test_containers(spark):
    rnd = random.Random(4)
    items = [(i, rnd.choice([0, 7, 13, 29, 40, 51, 99, 100, 101, 350])) for i in range(300)] + [(1000, None), (1001, 100), (1002, 200)] + [(2000 + i, 30) for i in range(200)]
    df = spark.createDataFrame([(*x, 0, 0) for x in items], "id long, n long, part int, length int")
    placed = [tuple(r) for r in PK.packed(df, "id", "n", 100, group_rows=50).collect()]
    used = check_packing(items, 100, placed)
    total = sum(s or 0 for _, s in items)
    assert used <= 1.12 * -(-total // 100)
    assert PK.packed(df.limit(0), "id", "n", 100).count() == 0


@pytest.mark.parametrize("histogram,best", [({60: 100, 40: 100}, 100), ({51: 10}, 10), ({34: 30, 33: 60}, 30), ({50: 40, 26: 40, 24: 40}, 40), ({100: 3}, 3), ({1: 250}, 3)])
def test_plans_reach_the_optimum(histogram, best):
    plan = PK.solve(histogram, 100)
    held = {}
    for config, n in plan.configurations:
        assert sum(length * k for length, k in config.items()) <= 100
        for length, k in config.items():
            held[length] = held.get(length, 0) + n * k
    assert held == histogram and plan.containers == best and plan.lower_bound <= best + 1e-6


def test_repeated_cover_equals_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40)))
        want = np.zeros(len(text), bool)
        for i in range(len(text) - 4):
            if text.find(text[i : i + 5], 0) != text.rfind(text[i : i + 5]):
                want[i : i + 5] = True
        assert ST.repeated_cover(text, 5).tolist() == want.tolist()


def unlike_histograms():
    rnd = np.random.default_rng(3)
    count = lambda lengths: {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    return {
        "mostly small": count(np.minimum(2048, 1 + rnd.gamma(1.2, 380, 10_000).astype(int))),
        "mostly small, a thousand times": {k: v * 1000 for k, v in count(np.minimum(2048, 1 + rnd.gamma(1.2, 380, 10_000).astype(int))).items()},
        "up to two thirds": count(rnd.integers(300, 1400, 20_000)),
        "about a third": count(rnd.integers(600, 760, 30_000)),
        "five lengths": {700: 100_000, 650: 70_000, 1000: 50_000, 30: 1000, 349: 40_000},
    }


@pytest.mark.parametrize("name,over", [("mostly small", 0.001), ("mostly small, a thousand times", 0.001), ("up to two thirds", 0.005), ("about a third", 0.006), ("five lengths", 0.01)])
def test_configurations_place_the_items(name, over):
    """Over nine tenths by configurations, close to the bound, on unlike histograms."""
    histogram = unlike_histograms()[name]
    plan = PK.solve(histogram, 2048)
    held = {}
    for config, n in plan.configurations:
        assert sum(length * k for length, k in config.items()) <= 2048
        for length, k in config.items():
            held[length] = held.get(length, 0) + n * k
    assert held == histogram
    assert plan.share > 0.9 and plan.containers <= (1 + over) * -(-plan.lower_bound // 1)


def test_links_equal_the_definition():
    """The longest suffix of each prefix that ends elsewhere too."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 50))) for some in ("ab", "abcdefghij ", "aé ᚠ\U0001f600") for _ in range(30)] + ["", "a", "aaaa", "ab" * 30]
    for t in texts:
        want = [max((k for k in range(1, i + 2) if any(t.endswith(t[i + 1 - k : i + 1], 0, j) for j in range(k, len(t) + 1) if j != i + 1)), default=0) for i in range(len(t))]
        assert ST.link_lengths(t).tolist() == want


def test_a_passage_repeated_far_apart():
    """One long passage given twice: its copies lie further apart than any block of 131,072 characters."""
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ,") for _ in range(131_072))
    assert ST.repeated_cover(passage + "\n" + passage).sum() >= 2 * len(passage)
    assert ST.is_stuffed(passage + "\n" + passage) and not ST.is_stuffed(passage)


SPAM = ["rune tattoo " * 40, "Tags: " + "decoder ring, prime dice, rune mug, lucky rune, " * 8, "\n".join(f"odd root {i} - www.quill-hound.test" for i in range(20)), "\n".join(f"[late seed](https://x{i}.test/a?id={i})" for i in range(20)), "#runemug #decoderring #codebook " * 10, "It is what the page says.\n" + "cheap gold rune, gold rune near me, best gold rune, " * 9]
FINE = [None, "", " ", "brb", "The hypothesis looks final at offset 163 and nobody checked it. " * 30, "Transcription notes, page 26\n" + "ᛞᛡ.ᛋᚦᚻ-ᛗᚪᚷᛝᛇ\n" * 40, "We list the primes of the page.\n" + "2663 2731 59 534 1551 1763 239 233\n" * 30, "cipher: a way of hiding what is said in a text\nkey: what is needed for reading it\n" * 15, "On a page with sense the reader finds what they need. " * 12 + "\nFurther reading:\n" + "\n".join(f"https://x.test/{i}" for i in range(6))]


def test_stuffed_pages(spark, rows):
    assert all(map(ST.is_stuffed, SPAM)) and not any(map(ST.is_stuffed, FINE))
    data = [(i, t, 0) for i, t in enumerate(SPAM + FINE)] + [(100, SPAM[0], 0), (101, "gold rune " * 20_000, 0)]
    df = spark.createDataFrame(data, "id long, t string, doc_id int")
    assert [r[0] for r in rows(ST.find_stuffed(df, "id", "t"))] == sorted([*range(len(SPAM)), 100, 101], key=lambda i: repr((i,)))
    assert ST.find_stuffed(df.where(F.lit(False)), "id", "t").count() == 0
