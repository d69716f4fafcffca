"""Queries over whole tables against the definitions, row by row."""

import random
from collections import Counter
from math import log10

import pytest
from test_symbols import spelled

from runeframe.functions import alphabet as A
from runeframe.plans import catalogue

WORDS = "the quick keeper of lantern wrote that every reader should begin with hidden door und dann weiter über eine alte seite".split()
N = A.N


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(29)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(k)) for k in (60, 45, 1, 30, 25, 8, 70)]
    docs = list(zip(range(7), texts, ("en", "EN", "en", "de", "fr", None, "es"))) + [(7, None, "de"), (8, "", "fr"), (9, "ab", "de")]
    runes = [(i, "".join(rnd.choice(A.CANON) for _ in range(n))) for i, n in enumerate((0, 1, 2, 3, 4, 5, 12, 23, 24, 59, 60, 140))] + [(12, spelled(texts[0])[:20]), (13, None)]
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(runes, "id long, canon string").write.parquet(f"{d}/runes.parquet")
    return str(d), {i: spelled(t) for i, t, _ in docs if t is not None}, [i for i, t, lang in docs if t is not None and lang and lang.lower() == "en"], {i: c for i, c in runes if c is not None}


def grams(text):
    return [text[i : i + 4] for i in range(len(text) - 3)]


def scorer(texts):
    counts = Counter(grams("".join(texts)))  # one text in order of the ids
    total = sum(counts.values())
    return lambda text: sum(log10(counts[g] / total) if counts[g] else log10(1 / total) - 2 for g in grams(text)) / (len(text) - 3)


def ioc(text):
    n = len(text)
    return sum(v * (v - 1) for v in Counter(text).values()) / (n * (n - 1)) * N


def run(spark, name, d):
    return [tuple(r) for r in catalogue.queries()[name](spark, d).collect()]


def test_shares_of_all_sequences(spark, tables):
    d, _, _, runes = tables
    counts = Counter("".join(runes.values()))
    assert dict(run(spark, "rune_frequencies_cited", d)) == {i: pytest.approx(counts[c] / counts.total(), abs=1e-8) for i, c in enumerate(A.CANON)}


def test_periods_of_all_sequences(spark, tables):
    d, _, _, runes = tables
    want = {}
    for i, c in runes.items():
        for p in range(2, 13):
            parts = [ioc(c[k::p]) for k in range(p) if len(c[k::p]) >= 2]
            want[i, p] = pytest.approx(sum(parts) / len(parts) if parts else 0.0, abs=2e-6)
    got = {(i, p): v for i, p, v in run(spark, "periodic_ioc", d)}
    assert got == want and len(got) == 11 * 13


def test_best_window_of_all_documents(spark, tables):
    d, docs, english, _ = tables
    score = scorer([docs[i] for i in english])
    want = {i: pytest.approx(max(score(t[s : s + 100]) for s in {*range(0, max(1, len(t) - 99), 25), max(0, len(t) - 100)}), abs=2e-5) for i, t in docs.items() if len(t) >= 4}
    got = dict(run(spark, "fitness_windowed_max", d))
    assert got == want and {0, 3, 4, 5, 6} <= set(got)


def test_best_shift_of_all_sequences(spark, tables):
    d, docs, english, runes = tables
    score = scorer([docs[i] for i in english])
    shifted = lambda c, k: "".join(A.CANON[(A.CANON.index(x) - k) % N] for x in c)
    want = {}
    for i, c in runes.items():
        if len(c) >= 4:
            value, k = max((round(score(shifted(c, k)), 5), -k) for k in range(N))
            want[i] = (-k, pytest.approx(value, abs=2e-5))
    got = {i: (k, v) for i, k, v in run(spark, "key_sweep_topk", d)}
    assert got == want and len(got) == 9


def test_runic_rows_with_printed_matter(spark, tmp_path, rows):
    a, b, c = A.RUNES[:3]
    data = [(1, f"{a}-{b}/{c}"), (2, f"note {a}\u200b{b}-7"), (3, f"\u201c{c}/{a}\u201d"), (4, "no runes"), (5, None)]
    spark.createDataFrame(data, "id long, raw string").write.parquet(f"{tmp_path}/runes.parquet")
    q = catalogue.queries()
    assert [r[:4] for r in rows(q["transcription_parse"](spark, str(tmp_path)))] == [(1, 0, 0, 1), (1, 1, 1, 1), (1, 2, 2, 2), (2, 0, 0, 1), (2, 1, 1, 1), (3, 0, 2, 1), (3, 1, 0, 2)]
    assert rows(q["transcription_printed"](spark, str(tmp_path))) == [(2, -1, 0, "note"), (2, 0, 0, "\u200b"), (2, 1, 0, "7"), (3, -1, 0, "\u201c"), (3, 1, 0, "\u201d")]
