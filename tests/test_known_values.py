"""Known values of packed fields."""

import pytest

from runeframe.operators.packed import Packing, Splitter, split_packed
from runeframe.plans import packed


def test_too_many_headlines_are_refused(spark, tmp_path, monkeypatch):
    spark.range(12).selectExpr("concat('h', id) headline").write.parquet(f"{tmp_path}/sections.parquet")
    assert len(packed.headlines(spark, str(tmp_path))) == 12
    monkeypatch.setattr(packed, "MAX_KNOWN", 11)
    with pytest.raises(ValueError, match="known values"):
        packed.headlines(spark, str(tmp_path))


def best_segmentation(text, delimiters, known):
    """By trying every way to part a text: most characters in known values, then fewest values."""
    best = None

    def go(at, values, covered):
        nonlocal best
        if at > len(text):
            rank = (covered, -len(values))
            if best is None or rank > best[0]:
                best = rank, values
            return
        for end in range(at, len(text) + 1):
            if end < len(text) and text[end] not in delimiters:
                continue
            value = text[at:end].strip()
            if not any(c in delimiters for c in value):
                go(end + 1, values + [value] * bool(value), covered + len(value) * (value.lower() in known))
            elif value.lower() in known:
                go(end + 1, [*values, value], covered + len(value))

    go(0, [], 0)
    return best[1]


def test_dictionary_decides_the_cover():
    import random

    known, rnd = ("rail fence", "fence, owl", "owl", "rail", "skip search"), random.Random(3)
    split, plain = (Splitter(Packing(delimiters=", ", known=k)) for k in (known, ()))
    changed = 0
    for _ in range(200):
        text = rnd.choice([" ", ", "]).join(rnd.choice(["rail", "fence", "owl", "rail fence", "fence, owl", "skip search", "skip"]) for _ in range(rnd.randint(1, 4)))
        want = best_segmentation(text, ", ", known)
        assert split(text) == want, text
        changed += plain(text) != want
    assert changed > 30


def test_terms_stay_whole(spark, tmp_path, rows):
    spark.createDataFrame([("Rail Fence ",), ("skip search",), (None,)], "method string").write.parquet(f"{tmp_path}/experiments.parquet")
    spark.createDataFrame([("coset split",), (None,)], "cipher string").write.parquet(f"{tmp_path}/sections.parquet")
    data = [(1, "Keys: rail fence odd, skip  search; coset split/x"), (2, "no list of rail fence"), (3, None)]
    spark.createDataFrame(data, "id long, body string").write.parquet(f"{tmp_path}/messages.parquet")
    got = rows(packed.p6_terms(spark, str(tmp_path)))
    assert [v for _, _, v in got] == ["rail fence", "odd", "skip", "search", "coset split", "x"] and [p for _, p, _ in got] == list(range(1, 7))


def test_known_value_beside_a_character_that_grows(spark, rows):
    df = spark.createDataFrame([(1, "tags: a, b; \u0130"), (2, "tags: a, b; i")], "id long, body string")
    got = rows(split_packed(df, "id", "body", Packing(lead=packed.LEAD, known=("a, b",))).select("id", "pos", "value"))
    assert got == [(1, 1, "a, b"), (1, 2, "\u0130"), (2, 1, "a, b"), (2, 2, "i")]
