"""A small book of its own: views, lookups and the nine checks."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runeframe import cli
from runeframe.functions import alphabet as A
from runeframe.operators import verify
from runeframe.sources import corpus

RUNE = dict(zip(A.PRIMARY, A.RUNES))


def runes(*spellings):
    return "".join(RUNE[s] for s in spellings)


def backwards(text):
    return "".join(A.RUNES[28 - A.RUNES.index(c)] for c in text)


STAR, OWL, TREE = runes("S", "T", "A", "R"), runes("O", "W", "L"), runes("T", "R", "E", "E")


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    d: Path = tmp_path_factory.mktemp("book")
    lines = ["index,prime,rune,transliteration"] + [f"{i},{A.PRIMES[i]},{A.RUNES[i]},{A.TRANSLITERATIONS[i]}" for i in reversed(range(A.N))]
    (d / "alphabet.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (d / "transcription").mkdir()
    (d / "solutions").mkdir()
    pages = {"a": f"{backwards(STAR)}-{backwards(OWL)}./{OWL}", "b": f"{TREE}-{OWL} 12/&{STAR}", "c": ""}
    for page, raw in pages.items():
        (d / "transcription" / f"{page}.txt").write_text(raw, encoding="utf-8")
    (d / "solutions" / "one.md").write_text("star owl", encoding="utf-8")
    (d / "pages.csv").write_text('page,book_page,section,status,image,transcription,discord_channel,notes\na,1,7.1,solved,,transcription/a.txt,attic,"x, ""y"""\nb,2,7.10,unsolved,,transcription/b.txt,attic,\nc,3,,,,,,\n', encoding="utf-8")
    head = "section,first_page,first_rune,last_page,headline,headline_form,status,cipher,key,solution_file,notes"
    (d / "sections.csv").write_text(f"{head}\n7.1,a,0,a,STAR,english,solved,mirror,,solutions/one.md,\n7.10,a,7,b,{OWL},runic,unsolved,,,,\n7.2,b,7,b,,,unsolved,,,,\n", encoding="utf-8")
    (d / "sentences.csv").write_text(f"sentence_id,section,runes,english\n1,7.1,{backwards(STAR)},star\n2,7.1,{backwards(OWL)},owl\n3,7.10,{OWL} {TREE},\n", encoding="utf-8")
    return str(d)


@pytest.fixture(scope="module")
def loaded(spark, book):
    return corpus.load(spark, corpus.Places.under(book, f"{book}/alphabet.csv"))


def canon(text):
    return "".join(A.CANON[A.RUNES.index(c)] for c in text)


def test_one_corpus_per_application(spark, book, loaded):
    assert corpus.load(spark, corpus.Places.under(book, f"{book}/alphabet.csv")) is loaded


def test_texts_of_sections_and_pages(loaded):
    assert {r["section"]: r["canon"] for r in loaded.texts().collect()} == {"7.1": canon(backwards(STAR + OWL)), "7.10": canon(OWL + TREE + OWL), "7.2": canon(STAR)}
    assert {r["page"]: r["n"] for r in loaded.texts("page").collect()} == {"a": 10, "b": 11, "c": 0}
    assert tuple(loaded.unsolved().first()) == (canon(OWL + TREE + OWL + STAR), 14)


def test_lookups(loaded):
    assert loaded.section("7.10").first()["headline"] == OWL and loaded.page("a").first()["notes"] == 'x, "y"'
    assert [r["page"] for r in loaded.pages_of("7.1").collect()] == ["a"] and [r["page"] for r in loaded.pages_in_channel("attic").collect()] == ["a", "b"]
    assert [r["section"] for r in loaded.of_status(False).collect()] == ["7.10", "7.2"] and [r["section"] for r in loaded.of_status(True).collect()] == ["7.1"]
    assert [r["english"] for r in loaded.sentences_of("7.1").collect()] == ["star", "owl"]
    assert {r[0]: r[1] for r in loaded.solutions().collect()} == {"7.1": "star owl", "7.10": None, "7.2": None}
    for bad in (lambda: loaded.section("7.3"), lambda: loaded.page("z"), lambda: loaded.pages_of("7")):
        with pytest.raises(KeyError):
            bad()


def pins(loaded):
    from runeframe.sources.transcriptions import corpus_digest

    stream = bytes(A.CANON.index(c) for c in canon(OWL + TREE + OWL + STAR))
    return {"digest": corpus_digest(loaded.places.files()), "unsolved_sections": ["7.10", "7.2"], "unsolved_length": 14, "unsolved_digest": hashlib.sha256(stream).hexdigest(), "printed_characters": 2, "exact_sentences": 2, "long_sentences": 0, "headlines": 2, "sentence_sections": 2, "invertible": {"7.1": [-1, 28]}, "gaps": {"7.10": 3}}


def test_nine_checks(loaded, tmp_path):
    (tmp_path / "pins.json").write_text(json.dumps(pins(loaded)), encoding="utf-8")
    found = {r["name"]: r for r in verify.corpus_checks(loaded, verify.Pins.read(str(tmp_path / "pins.json"))).collect()}
    assert len(found) == 9 and all(r["passed"] for r in found.values()), found
    assert cli.main(["verify", "--book", str(Path(loaded.places.pages).parent), "--pins", str(tmp_path / "pins.json")]) == 0


WRONG = {"digest": "0", "unsolved_sections": ["7.2"], "unsolved_length": 15, "unsolved_digest": "0", "printed_characters": 3, "exact_sentences": 3, "gaps": {}, "invertible": {"7.1": [-1, 27]}}


def test_every_pin_can_fail(loaded, tmp_path):
    (tmp_path / "pins.json").write_text(json.dumps(pins(loaded) | WRONG), encoding="utf-8")
    found = {r["name"]: r["passed"] for r in verify.corpus_checks(loaded, verify.Pins.read(str(tmp_path / "pins.json"))).collect()}
    assert found.pop("spans") is True and len(found) == 8 and not any(found.values()), found


def test_training_texts_in_order(spark, loaded, tmp_path):
    from runeframe.operators import fitness

    (tmp_path / "b.txt").write_text("tree", encoding="utf-8")
    (tmp_path / "a.txt").write_text("owl tree", encoding="utf-8")
    told = [r["canon"] for r in loaded.training(after=[(str(tmp_path), "*.txt")]).orderBy("o").collect()]
    assert told == [canon(STAR), canon(OWL), canon(OWL + TREE), canon(TREE)]
    fitted = fitness.model(loaded.training(after=[(str(tmp_path), "*.txt")]), "canon", 3, "o")
    whole = "".join(told)
    assert {r["gram"] for r in fitted.collect()} == {whole[i : i + 3] for i in range(len(whole) - 2)}
    stream = bytes(A.CANON.index(c) for c in whole)
    assert fitness.training_sha256(loaded.training(after=[(str(tmp_path), "*.txt")]), "canon", "o") == (hashlib.sha256(stream).hexdigest(), len(stream))


def test_absent_tables_are_skipped(spark, book, loaded):
    places = corpus.Places(**{**loaded.places.__dict__, "sentences": book + "/none.csv"})
    found = {r["name"]: r["passed"] for r in verify.corpus_checks(corpus.Corpus(spark, places), verify.Pins()).collect()}
    assert found["sentences"] is None and found["speller exact"] is None and found["corpus files"] is None and found["spans"] is True


def test_base_sixty(spark):
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWX"
    df = spark.createDataFrame([("00 01 10 1a XX ?0",), ("",)], "t string")
    got = [r[0] for r in df.select(corpus.base60(F.filter(F.split("t", " "), lambda g: g != ""), digits)).collect()]
    assert got == [[0, 1, 60, 70, 3599, None], []]
    with pytest.raises(ValueError):
        corpus.base60(F.col("t"), "0123")
