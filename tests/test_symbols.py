"""Alphabet, statistics, fitness, keyed transforms and notation."""

import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runeframe.functions import alphabet as A
from runeframe.operators import cipher as C
from runeframe.operators import fitness, notation, stats

X = "x"


def of_one(spark, value, **columns):
    """The value of a column expression over a single row."""
    kinds = ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], kinds).select(value.alias("v")).first()[0]


def spelled(text):
    """Spelling from its definition: per word, the longest spelling at each place."""
    out = []
    for word in unicodedata.normalize("NFKD", text).upper().split():
        letters = [c for c in word if "A" <= c <= "Z"]
        while letters:
            size = next((len(s) for s in A.MULTI if "".join(letters[: len(s)]) == s), 1)
            out.append(A.CANON[A.SPELLINGS["".join(letters[:size])]])
            del letters[:size]
    return "".join(out)


def canon_of(indices):
    return "".join(A.CANON[i] for i in indices)


@pytest.mark.parametrize("text", ["wING SPAN", "Thea's gINger", "piano EOn", "quartz vex", "Crème brûlée ﬀ ½ ⅷ", "ｗｉｄｅ ｏｅ", "", " \u2003 ", "7 - 11", "IN\nG", "aeaea oeoe", "K" * 3000])
def test_spelling_follows_its_definition(spark, text):
    assert of_one(spark, A.spell(F.col("t")), t=text) == spelled(text)


def test_spelling_of_mixed_text_is_refused(spark):
    assert of_one(spark, A.spell(F.col("t")), t="owl ᛟ owl") is None and of_one(spark, A.spell(F.col("t")), t=None) is None


def test_three_forms_agree(spark):
    rnd = random.Random(41)
    for size in (0, 1, 29, 200):
        canon = canon_of(rnd.randrange(29) for _ in range(size))
        forms = of_one(spark, F.struct(A.canon_of(A.indices_of(F.col("c"))), A.canon_of_runes(A.runes_of(F.col("c"))), A.prime_sum(F.col("c")), A.unspell(F.col("c"), ".")), c=canon)
        assert forms[0] == forms[1] == canon
        assert forms[2] == sum(A.PRIMES[A.CANON.index(c)] for c in canon)
        assert forms[3] == ".".join(A.PRIMARY[A.CANON.index(c)] for c in canon)
    for value, column in ((A.indices_of(F.col("c")), {"c": "no!"}), (A.canon_of(F.col("c")), {"c": [4, 31]}), (A.canon_of(F.col("c")), {"c": [-2]})):
        with pytest.raises(Exception, match="canonical|0..28"):
            of_one(spark, value, **column)


def test_statistics_equal_their_formulas(spark):
    rnd, c = random.Random(42), F.col("c")
    reference = [rnd.random() for _ in range(29)]
    reference = [r / sum(reference) for r in reference]
    for size in (2, 3, 50, 400):
        text = canon_of(int(rnd.triangular(0, 28.9, 4)) for _ in range(size))
        n, seen = len(text), Counter(text)
        same = lambda t: sum(k * (k - 1) for k in Counter(t).values()) * 29 / (len(t) * (len(t) - 1)) if len(t) > 1 else 0.0
        got = of_one(spark, F.array(stats.ioc(c), stats.entropy(c), stats.doublet_rate(c), stats.chi_squared(c, reference), stats.periodic_ioc(c, 3)), c=text)
        want = [same(text), -sum(k / n * math.log2(k / n) for k in seen.values()), sum(a == b for a, b in zip(text, text[1:])) / (n - 1)]
        want.append(sum((seen[ch] - n * reference[i]) ** 2 / (n * reference[i]) for i, ch in enumerate(A.CANON)))
        assert got[:4] == pytest.approx(want)
        cosets = [same(text[i::3]) for i in range(3) if len(text[i::3]) > 1]
        assert got[4] == pytest.approx(sum(cosets) / len(cosets) if cosets else 0.0)


def test_statistics_of_nothing(spark):
    c = F.col("c")
    assert of_one(spark, F.array(stats.ioc(c), stats.entropy(c), stats.doublet_rate(c), stats.periodic_ioc(c, 2)), c="") == [0.0] * 4
    even = [1 / 29] * 29
    assert of_one(spark, stats.chi_squared(c, even), c="") == math.inf and of_one(spark, stats.chi_squared(c, even), c=A.CANON * 2) == pytest.approx(0)
    assert of_one(spark, stats.chi_squared(c, [0.0] + [1 / 28] * 28), c="ab") == math.inf
    for bad in (lambda: stats.periodic_ioc(c, 0), lambda: stats.coset(c, -2, 0), lambda: stats.ngrams(c, -1), lambda: stats.positions_of(c, ""), lambda: stats.chi_squared(c, even[1:])):
        with pytest.raises(ValueError):
            bad()


def test_positions_overlap(spark):
    rnd = random.Random(43)
    for _ in range(12):
        text, needle = ("".join(rnd.choice("pq") for _ in range(k)) for k in (rnd.randint(0, 14), rnd.randint(1, 3)))
        assert of_one(spark, stats.positions_of(F.col("c"), needle), c=text) == [i for i in range(len(text)) if text.startswith(needle, i)]


def test_repeats_and_their_gaps(spark, rows):
    text = "owlowlxowlw"
    df = spark.createDataFrame([(5, text)], "id int, c string")
    grams = Counter(text[i : i + 3] for i in range(len(text) - 2))
    want = {g: [i for i in range(len(text)) if text.startswith(g, i)] for g, k in grams.items() if k > 1}
    assert {g: p for _, g, p in rows(stats.repeats(df, "id", "c"))} == want
    gaps = Counter(b - a for p in want.values() for a, b in zip(p, p[1:]))
    assert dict(rows(stats.kasiski_gaps(df, "id", "c"))) == dict(gaps)


def test_a_planted_period_has_the_highest_index(spark):
    rnd, period = random.Random(44), 5
    text = canon_of((rnd.choice([2, 2, 2, 9, 20]) + (3, 17, 8, 0, 25)[i % period]) % 29 for i in range(1000))
    found = of_one(spark, F.array(*(stats.periodic_ioc(F.col("c"), p) for p in range(2, 10))), c=text)
    assert max(range(len(found)), key=found.__getitem__) + 2 == period


def test_fitness_prefers_language_and_windows_cover(spark):
    language = spelled("an owl sat over the orchard wall and told the gardener which of the lanterns would burn until the morning came " * 9)
    fitted = fitness.model(spark.createDataFrame([(language,)], "c string"), "c", 3)
    rnd = random.Random(45)
    noise = canon_of(rnd.randrange(29) for _ in range(260))
    texts = spark.createDataFrame([("language", language[33:290]), ("noise", noise), ("short", "qb")], "k string, c string")
    score = {r[0]: r[1] for r in fitness.score(texts, "k", "c", fitted, 3).collect()}
    assert score["language"] > score["noise"] + 1 and "short" not in score
    for length, size, step in ((200, 80, 20), (211, 80, 20), (50, 80, 20), (80, 80, 7)):
        df = spark.createDataFrame([("t", language[:length])], "k string, c string")
        starts = {r[1] for r in fitness.windowed(df, "k", "c", fitted, size, step, 3).collect()}
        assert starts == {*range(0, max(1, length - size + 1), step), max(0, length - size)}
        assert {p for s in starts for p in range(s, min(length, s + size))} == set(range(length))
    with pytest.raises(ValueError):
        fitness.windowed(texts, "k", "c", fitted, 2, 10, 3)


def skipping(values, skips, move):
    """Each value moved by ``move(value, j)``, j counting those that are not skipped."""
    out, j = [], 0
    for i, v in enumerate(values):
        out.append(v if i in skips else move(v, j) % 29)
        j += i not in skips
    return out


def test_transforms_equal_their_definitions(spark):
    rnd = random.Random(46)
    for size in (1, 7, 60):
        x, key = [rnd.randrange(29) for _ in range(size)], [rnd.randrange(29) for _ in range(4)]
        skips = sorted(rnd.sample(range(size), size // 3))
        passed = C.ints(skips)
        stream = [rnd.randrange(29) for _ in range(size)]
        assert of_one(spark, C.vigenere_decrypt(X, key, passed), x=x) == skipping(x, skips, lambda v, j: v - key[j % 4])
        assert of_one(spark, C.shift_decrypt(X, 11, passed), x=x) == skipping(x, skips, lambda v, j: v - 11)
        assert of_one(spark, C.atbash(X, passed), x=x) == skipping(x, skips, lambda v, j: 28 - v)
        assert of_one(spark, C.beaufort_decrypt(X, key), x=x) == [(key[i % 4] - v) % 29 for i, v in enumerate(x)]
        assert of_one(spark, C.running_key_decrypt(X, C.ints(stream)), x=x) == [(v - k) % 29 for v, k in zip(x, stream)]
        assert of_one(spark, C.affine_decrypt(X, 12, 5), x=[(12 * v + 5) % 29 for v in x]) == x
    assert [p - 1 for p in C.first_primes(7)] == [1, 2, 4, 6, 10, 12, 16]


def test_long_texts_join_their_keystream(spark, rows):
    rnd = random.Random(49)
    texts = [(k, [rnd.randrange(29) for _ in range(n)], [s for s in (2, 5) if s < n]) for k, n in enumerate((0, 1, 40, 700))] + [(9, None, [])]
    df = spark.createDataFrame(texts, "id int, x array<int>, s array<int>")
    stream = C.keystream(C.primes_below(spark, C.prime_bound(700)))
    ks = [p - 1 for p in C.first_primes(700)]
    assert [r[1] for r in rows(stream.orderBy("ord").limit(5))] == ks[:5] and stream.count() >= 700
    assert {r[0]: r[1] for r in C.stream_decrypt(df, "id", "x", stream, "s").collect()} == {k: skipping(x, s, lambda v, j: v - ks[j]) for k, x, s in texts if x is not None}
    with pytest.raises(Exception, match="exhausted"):
        C.stream_decrypt(df, "id", "x", stream.where("ord < 600")).collect()


def test_transforms_refuse(spark):
    for outside in (3, -2):
        with pytest.raises(Exception, match="outside"):
            of_one(spark, C.vigenere_decrypt(X, [8], C.ints([outside])), x=[4, 4, 4])
    with pytest.raises(Exception, match="exhausted"):
        of_one(spark, C.running_key_decrypt(X, C.ints([9])), x=[1, 1])
    for bad in (lambda: C.vigenere_decrypt(X, []), lambda: C.affine_decrypt(X, 58, 3)):
        with pytest.raises(ValueError):
            bad()


def test_round_trips(spark):
    rnd, key = random.Random(47), [14, 2, 27]
    plain = [rnd.randrange(29) for _ in range(77)]
    zeros = [i for i, v in enumerate(plain) if v == 0]
    secret = of_one(spark, C.vigenere_encrypt(X, key, 0), x=plain)
    assert of_one(spark, C.vigenere_decrypt(X, key, C.ints(zeros)), x=secret) == plain
    assert of_one(spark, C.vigenere_decrypt(X, key), x=of_one(spark, C.vigenere_encrypt(X, key, None), x=plain)) == plain
    by_plain = [(v + k) % 29 for v, k in zip(plain, key + plain)]
    df = spark.createDataFrame([("a", by_plain), ("b", []), ("c", None)], "id string, x array<int>")
    assert {r[0]: r[1] for r in C.autokey_pt_decrypt(df, "id", "x", key).collect()} == {"a": plain, "b": []}
    by_cipher = []
    for v in plain:
        by_cipher.append((v + (key + by_cipher)[len(by_cipher)]) % 29)
    assert of_one(spark, C.autokey_ct_decrypt(X, key), x=by_cipher) == plain


#: Texts, and the runs of each notation that are in them.
CITED = [
    ("he carved ᛋᛏᚪᚱ above the door, ᛗ below", [("runic", "ᛋᛏᚪᚱ")]),
    ("ᛟᚹᛚ\nᚾᛖᛋᛏ", [("runic", "ᛟᚹᛚ"), ("runic", "ᚾᛖᛋᛏ")]),
    ("ᛟᚹᛚ.ᚾᛖᛋᛏ-ᚪᛏ", [("runic", "ᛟᚹᛚ"), ("runic", "ᚾᛖᛋᛏ"), ("runic", "ᚪᛏ"), ("runic-joined", "ᛟᚹᛚ.ᚾᛖᛋᛏ-ᚪᛏ")]),
    ("ᛟᚹ;ᛚᛖ", [("runic", "ᛟᚹ"), ("runic", "ᛚᛖ")]),
    ("ᛟᚴᚹ", []),
    ("read O-W-L-S there", [("translit", "O-W-L-S")]),
    ("TH O R N EA", [("translit", "TH O R N EA")]),
    ("take A B or C D instead", []),
    ("17;4;28;0 it says", [("numeric", "17;4;28;0")]),
    ("(3 1 4) (1 5 9 2)", [("numeric", "1 5 9 2")]),
    ("9 8 7 6\n5 4 3 2", [("numeric", "9 8 7 6"), ("numeric", "5 4 3 2")]),
    ("5, -3, 8, -1, 4", []),
    ("12 29 12 40 12", []),
    ("2019 10 11", []),
    ("", []),
]


@pytest.mark.parametrize("text,found", CITED)
def test_extraction(spark, text, found):
    df = spark.createDataFrame([(8, text)], "id int, t string")
    assert [(r["notation"], r["raw"]) for r in notation.extract(df, "id", "t").collect()] == found


def test_a_sequence_counts_once_per_message(spark, rows):
    df = spark.createDataFrame([(1, "15 16 24 4 and ᛋᛏᚪᚱ, again ᛋᛏᚪᚱ"), (2, None), (3, "ᛋᛏᚪᚱ")], "id int, t string")
    assert [(r[0], r[1], r[3]) for r in rows(notation.indexed(df, "id", "t"))] == [(1, "runic", "pqye"), (3, "runic", "pqye")]


#: Queries by what they stand for; None where the reader refuses.
ASKED = [
    ("ᛋᛏᚪᚱ", ("pqye", "runic")), ("15 16 24 4", ("pqye", "numeric")), ("15-16-24-4", ("pqye", "numeric")), ("S-T-A-R", ("pqye", "translit")), ("s t a r", ("pqye", "translit")), ("7/0", ("ha", "numeric")),
    ("161244", None), ("77", None), ("29 1", None), ("4 -2 6", None), ("S-T-4", None), ("ᛋᛏ 24", None), ("ᛋ-T", None), ("an ᛟᚴᛟ", None), ("owlet?", None), ("", None), ("  ", None),
]


def test_query_sequences(spark):
    """The reader on the driver and its column form say the same."""
    df = spark.createDataFrame([(q,) for q, _ in ASKED], "q string")
    columns = {q: tuple(r) if r else None for q, r in df.select("q", notation.canonical_query_column(F.col("q"))).collect()}
    for query, want in ASKED:
        try:
            got = notation.canonical_query(query)
        except notation.UnreadableQuery:
            got = None
        assert got == want == columns[query], query


def test_ordered_model_spans_boundaries(spark, rows):
    """As if the texts were one, short and empty ones included, however they are partitioned."""
    rnd = random.Random(48)
    texts = [canon_of(rnd.randrange(4) for _ in range(rnd.choice([0, 1, 1, 2, 3, 9]))) for _ in range(60)]
    rounded = lambda df: [(g, round(p, 9), round(f, 9)) for g, p, f in rows(df)]
    whole = rounded(fitness.model(spark.createDataFrame([("".join(texts),)], "c string"), "c", 4))
    parts = list(enumerate(texts))
    rnd.shuffle(parts)
    assert rounded(fitness.model(spark.createDataFrame(parts, "o int, c string").repartition(3), "c", 4, "o")) == whole
