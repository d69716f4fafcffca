"""Exports, rune rows, index, search, log, drift checks and streams."""

import json
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runeframe.functions import alphabet as A
from runeframe.operators import runetext, search, textindex, verify
from runeframe.sources import exports, explog, indexstore, transcriptions

HALL = """Guild: Orchard Keepers
Topic: whatever comes
Channel:  Rooms / lantern hall

[11/2/2017 11:58 PM] wren
the night shift starts

and goes on in a second paragraph

[11/3/2017 12:00 AM] moss-7 (pinned)
carved over the door: ᛋᛏᚪᚱ
and beside it 15 16 24 4 26 15

[11/3/2017 1:15 PM] tarn
{Embed}
A title
https://pics.example/tree.png

back in my own words
[11/3/2017 1:16 PM] nobody, quoted in a paragraph

[13/40/2017 1:16 PM] on no such day
the end

[11/4/2017 9:00 AM] wren
{Reactions}
:owl: (2)
"""


@pytest.fixture(scope="module")
def exported(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    (folder / "hall.txt").write_bytes(HALL.encode())
    (folder / "attic.txt").write_bytes("\r\n[7/9/2018 6:30 AM] finch\r\n  dust  \r\n".encode())
    (folder / "zero.txt").write_text("Guild: Orchard Keepers\nChannel: nothing here\n", encoding="utf-8")
    return str(folder)


def test_exports_become_messages(spark, exported):
    parsed = exports.parse_exports(exports.read_exports(spark, exported)).orderBy("id").collect()
    shown = [(r["id"], r["channel"], r["channel_name"], r["seq"], r["ts"], r["author"], r["pinned"], r["line"]) for r in parsed]
    assert shown == [
        (1, "attic", "attic", 1, "2018-07-09 06:30", "finch", False, 2),
        (2, "hall", "Rooms / lantern hall", 1, "2017-11-02 23:58", "wren", False, 5),
        (3, "hall", "Rooms / lantern hall", 2, "2017-11-03 00:00", "moss-7", True, 10),
        (4, "hall", "Rooms / lantern hall", 3, "2017-11-03 13:15", "tarn", False, 14),
        (5, "hall", "Rooms / lantern hall", 4, "2017-11-04 09:00", "wren", False, 25),
    ]
    assert [(r["body"], r["extra"]) for r in parsed] == [
        ("dust", ""),
        ("the night shift starts\nand goes on in a second paragraph", ""),
        ("carved over the door: ᛋᛏᚪᚱ\nand beside it 15 16 24 4 26 15", ""),
        ("back in my own words\n[11/3/2017 1:16 PM] nobody, quoted in a paragraph\n[13/40/2017 1:16 PM] on no such day\nthe end", "{Embed}\nA title\nhttps://pics.example/tree.png"),
        ("", "{Reactions}\n:owl: (2)"),
    ]


def test_one_long_file_takes_time_in_proportion_to_its_lines(spark):
    n = 100_000
    long = spark.range(n).select(F.concat(F.lit("[7/9/2018 6:30 AM] finch\nsaid "), F.col("id").cast("string"), F.lit("\n{Embed}\nlink\n\n")).alias("t"), "id")
    file = long.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda m: m["t"]), "").alias("content")).select(F.lit("/x/long.txt").alias("path"), "content")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # a whole file carried beside each line takes many times that
    stop.start()
    try:
        parsed = exports.parse_exports(file)
        got = parsed.agg(F.count("*"), F.max("line"), F.sum((F.col("body") == F.concat(F.lit("said "), (F.col("seq") - 1).cast("string"))).cast("int")), F.countDistinct("id"), F.max("extra")).first()
    finally:
        stop.cancel()
    assert tuple(got) == (n, 5 * n - 4, n, n, "{Embed}\nlink")


@pytest.mark.parametrize("bound", [0, exports.BROADCAST_ROWS])
def test_odd_lines_of_an_export(spark, monkeypatch, bound):
    monkeypatch.setattr(exports, "BROADCAST_ROWS", bound)
    block = "\n".join(f"line {i}" for i in range(20_000))
    texts = {
        "/x/a.txt": "[2/29/2019 1:00 AM] no such day\n\n[2/29/2020 1:00 AM] wren\nb\n[1/1/2020 1:00 AM] no blank above\n\u00a0\u2028\n[٢/1/2020 1:00 AM] other digits\n{X}\ny",
        "/x/b.txt": f"Channel:  long \r\n\r[1/1/2020 1:00 PM] moss (pinned)\r{{Embed}}\n{block}\n\nend",
        "/x/c.txt": "x\n[1/1/2020 1:00 PM] nobody\n",
        "/x/d.txt": "[1/1/2020 1:00 PM] last",
    }
    parsed = exports.parse_exports(spark.createDataFrame(list(texts.items()), ["path", "content"])).orderBy("id").collect()
    assert [(r["id"], r["channel"], r["channel_name"], r["author"], r["pinned"], r["seq"], r["line"], r["body"], r["extra"]) for r in parsed] == [
        (1, "a", "a", "wren", False, 1, 3, "b\n[1/1/2020 1:00 AM] no blank above\n[٢/1/2020 1:00 AM] other digits", "{X}\ny"),
        (2, "b", "long", "moss", True, 1, 3, "end", "{Embed}\n" + block),
        (3, "d", "d", "last", False, 1, 1, "", ""),
    ]


def test_a_file_of_another_encoding_fails(spark, tmp_path):
    (tmp_path / "old.txt").write_bytes("[7/9/2018 6:30 AM] finch\nné".encode("latin-1"))
    with pytest.raises(Exception, match="UTF-8"):
        exports.read_exports(spark, str(tmp_path)).collect()


def test_an_index_replaces_the_last_one_only_when_whole(spark, exported, tmp_path, rows):
    place = tmp_path / "index"
    version = indexstore.build(spark, exported, str(place))
    with pytest.raises(Exception):
        indexstore.build(spark, str(tmp_path / "absent"), str(place))
    assert (place / indexstore.POINTER).read_text() == version
    found = indexstore.load(spark, str(place), "runes").select("notation", "canon", "n")
    assert rows(found) == [("numeric", "pqye0p", 6), ("runic", "pqye", 4)]
    now, then = exports.fingerprints(spark, exported), indexstore.load(spark, str(place), "provenance")
    assert exports.stale(then, now).isEmpty()
    longer = now.withColumn("bytes", F.when(F.col("file") == "hall.txt", 1).otherwise(F.col("bytes")))
    assert rows(exports.stale(then.where("file <> 'attic.txt'"), longer.where("file <> 'zero.txt'"))) == [("attic.txt", "added"), ("hall.txt", "changed"), ("zero.txt", "removed")]


ROOM = ["owls at dusk", "dusk owls", "a lantern burned", "naïve reading of the carving", "carving, reading, carving", "one two three four five owls", None]


@pytest.fixture(scope="module")
def room(spark):
    columns = "id long, channel string, seq int, ts string, author string, pinned boolean, body string, line int"
    data = [(10 + i, "room", i + 1, f"2017-11-03 1{i}:30", ("Wren", "tarn")[i % 2], False, t, 3 * i) for i, t in enumerate(ROOM)]
    data += [(30, "shed", 1, "2018-01-01 08:00", "finch", True, "owls elsewhere", 4), (31, "shed", 2, "2018-01-02 08:00", "finch", False, "lantern", 8)]
    return search.archive(spark.createDataFrame(data, columns))


MATCHES = [
    ("owls", {10, 11, 15, 30}), ("lant*", {12, 31}), ("owls lantern", set()), ("lantern OR dusk", {10, 11, 12, 31}), ("owls NOT dusk", {15, 30}), ('"owls at"', {10}), ('"at owls"', set()), ("NAIVE", {13}),
    ("^dusk", {11}), ("^owls", {10, 30}), ("reading + of", {13}), ("(lantern OR owls) NOT (dusk OR elsewhere)", {12, 15, 31}), ("NEAR(owls dusk, 1)", {10, 11}), ("NEAR(one five, 2)", set()), ("NEAR(one five, 3)", {15}),
    ("NEAR(one two three four five owls, 3)", set()), ("NEAR(one two three four five owls, 4)", {15}), ("NEAR(five owls one three two four, 4)", {15}), ('NEAR("two three" owls five one "three four", 4)', {15}), ("nowhere", set()),
]


@pytest.mark.parametrize("query,ids", MATCHES)
def test_query_language(room, query, ids):
    tree, searched, fell_back = textindex.parse(query)
    assert (searched, fell_back) == (query, False)
    assert {r["id"] for r in room.where(tree.matches(textindex.tokens(F.col("body")))).collect()} == ids


@pytest.mark.parametrize("query,searched", [("owls (", '"owls"'), ("AND dusk", '"AND" "dusk"'), ("dusk OR", '"dusk" "OR"'), ("NEAR(a", '"NEAR" "a"')])
def test_what_is_no_query_is_searched_as_words(query, searched):
    assert textindex.parse(query)[1:] == (searched, True)


BAD_DATES = ["soon", "17", "2017-2", "2017-00", "2017-04-31", "2017-11-3", "2017/11/03", "2017-11-03 10:00", "0000"]


@pytest.mark.parametrize("value", BAD_DATES)
def test_dates_that_do_not_exist(value):
    for side in ("since", "until"):
        with pytest.raises(textindex.InvalidQuery, match=side):
            search.Filters(**{side: value})


def test_refused_searches(room):
    for bad in (lambda: textindex.parse("!?"), lambda: textindex.parse(""), lambda: textindex.parse("lamp-post"), lambda: textindex.parse("body: owls"), lambda: textindex.parse("-owls"), lambda: search.text_hits(room, "owls", limit=-1)):
        with pytest.raises(textindex.InvalidQuery):
            bad()
    assert not textindex.parse('"lamp-post" owls')[2]
    assert search.Filters(since="2016-02-29", until="2017") and search.Filters(since="2017-11")


def test_text_hits_filter_and_rank(room):
    ids = lambda *a, **k: {r["id"] for r in search.text_hits(room, *a, **k).collect()}
    assert ids("owls") == {10, 11, 15, 30} and all(r["score"] < 0 for r in search.text_hits(room, "owls").collect())
    assert len(ids("owls", limit=2)) == 2
    assert ids("owls", search.Filters(author="FIN")) == {30} and ids("owls", search.Filters(channel="room", author="wr")) == {10}
    assert ids("owls", search.Filters(since="2018")) == {30} and ids("owls", search.Filters(until="2017-11")) == {10, 11, 15}


def test_neighbourhoods_need_time_and_place(room):
    around = {r["id"]: r["text"].split("\n") for r in textindex.neighbourhoods(room).collect()}
    assert around[12] == [t for t in ROOM[:5]] and around[10] == ROOM[:3]
    assert around[30] == ["owls elsewhere"] and around[31] == ["lantern"]
    assert around[16] == [*ROOM[4:6], ""]


def test_blocks_merge_and_json_keeps_its_keys(spark, room):
    hits = spark.createDataFrame([(10, "room", 1, 3, None), (12, "room", 3, 1, "why"), (16, "room", 7, 2, None), (31, "shed", 2, 4, None)], "id long, channel string, seq int, rank int, note string")
    blocks = search.context_blocks(room, hits, 1).orderBy("rank", "channel", "block").collect()
    assert [(b["channel"], b["rank"], b["first_seq"], b["last_seq"]) for b in blocks] == [("room", 1, 1, 4), ("room", 1, 6, 7), ("shed", 4, 1, 2)]
    assert [(m["seq"], m["matched"], m["note"]) for m in blocks[0]["messages"]] == [(1, True, None), (2, False, None), (3, True, "why"), (4, False, None)]
    keys = set()
    for chosen in (hits, hits.limit(0)):
        shown = json.loads(search.result_json(search.context_blocks(room, chosen, 1), "q", chosen.count(), searched='"q"').first()["json"])
        keys.add(tuple(sorted(shown)))
        assert shown["hits"] == chosen.count() and len(shown["conversations"]) == (3 if shown["hits"] else 0)
        for c in shown["conversations"]:
            assert {"channel", "channel_name", "file", "messages"} <= set(c) and c["file"] == c["channel"] + ".txt"
    assert keys == {("conversations", "hits", "indices", "notation", "query", "searched")}


def test_long_bodies_are_cut_where_asked(spark):
    long = spark.createDataFrame([(1, "c", 1, "2017-11-03 10:00", "wren", False, "owl " * 1000, 1)], "id long, channel string, seq int, ts string, author string, pinned boolean, body string, line int")
    hits = spark.createDataFrame([(1, "c", 1, 1)], "id long, channel string, seq int, rank int")
    for chars, shown in ((600, 600), (2000, 2000), (None, 4000)):
        m = search.context_blocks(search.archive(long), hits, 1, chars).first()["messages"][0]
        assert len(m["body"]) == shown and m["truncated"] == (shown < 4000)


def test_stored_index_answers_like_the_archive(spark, room, tmp_path, rows):
    indexstore.write_search(room, str(tmp_path / "s"))
    store = indexstore.SearchStore(spark, str(tmp_path / "s"))
    rounded = lambda df: sorted((r["id"], r["channel"], r["seq"], round(r["score"], 9)) for r in df.collect())
    for query, _ in MATCHES[1::3]:
        assert rounded(store.text_hits(query)) == rounded(search.text_hits(room, query)), query
    for filters in (search.Filters(author="fin"), search.Filters(since="2018"), search.Filters(channel="room", until="2017")):
        assert rounded(store.text_hits("owls OR lantern", filters)) == rounded(search.text_hits(room, "owls OR lantern", filters))
    hits = store.text_hits("owls").withColumn("rank", F.lit(1))
    assert store.context_blocks(hits, 1).count() == search.context_blocks(room, hits, 1).count()


def test_sequence_search(spark, room):
    runs = spark.createDataFrame([(1, 10, "runic", "ᛋᛏᚪᚱ   so", "pqye", 4), (2, 10, "numeric", "15 16 24 4 9", "pqyej", None), (3, 12, "translit", "S-T-A", "pqy", 3)], "id long, msg_id long, notation string, raw string, canon string, n int")
    found = search.sequence_hits(room, runs, "S-T-A").collect()
    assert [(r["id"], r["n"], r["note"]) for r in found] == [(10, 5, "numeric: 15 16 24 4 9"), (12, 3, "translit: S-T-A")]
    with pytest.raises(textindex.InvalidQuery):
        search.sequence_hits(room, runs, "15 16")


def test_pages_become_rune_rows(spark, rows):
    pages = spark.createDataFrame([("one", "§ᛋᛏ-ᚪ/ᚱ 7:3 ᛟ&\nᚹ"), ("two", "x1ᛚ.ᛖ"), ("blank", " "), ("null", None)], "page string, raw string")
    runes, printed, leading = transcriptions.parse_pages(pages)
    assert [r[1:] for r in rows(runes.where("page = 'one'"))] == [(0, 15, 1, 1, ""), (1, 16, 1, 2, "-"), (2, 24, 1, 3, "/"), (3, 4, 2, 1, ""), (4, 22, 2, 2, "&"), (5, 7, 2, 3, "")]
    assert rows(printed) == [("one", 3, 0, "7:3"), ("two", -1, 0, "x1")]
    assert dict(rows(leading)) == {"one": "§", "two": "", "blank": "", "null": ""}
    parts = runetext.words(runes, "page", printed).where("page = 'one'").orderBy("part").collect()
    assert [w["indices"] for w in parts] == [[15, 16], [24, 4], [22], [7]]
    moved, shifted = runetext.concat(runes, "page", "page", printed, leading)
    assert [r["idx"] for r in moved.orderBy("pos").collect()] == [15, 16, 24, 4, 22, 7, 20, 18]
    assert {(r["page"], r["anchor"]) for r in shifted.collect()} == {("one", 3), ("two", 5)}
    with pytest.raises(Exception, match="outside the alphabet"):
        transcriptions.parse_pages(spark.createDataFrame([("p", "ᛟᚴ")], "page string, raw string"))[0].collect()


def test_slices_follow_sequences(spark):
    runes = spark.createDataFrame([("p", i, i * 3 % 29, 1, i + 1, "-") for i in range(9)], "page string, pos int, idx int, line int, col int, marks_after string")
    values = [i * 3 % 29 for i in range(9)]
    for start, stop, step in ((2, 7, 1), (None, None, -1), (None, -2, 3), (-4, None, 1), (7, 0, -2), (6, 3, 1), (0, 100, 4), (None, None, 1)):
        got = runetext.slice_rows(runes, "page", start, stop, step).orderBy("pos").collect()
        assert [r["idx"] for r in got] == values[slice(start, stop, step)], (start, stop, step)
        assert {r["marks_after"] for r in got} <= ({"-"} if step == 1 else {""})


def test_sections_reach_from_start_to_start(spark, rows):
    runes = spark.createDataFrame([(p, i) for p in ("leaf-1", "leaf-2", "leaf-3") for i in range(4)], "page string, pos int")
    starts = spark.createDataFrame([("leaf-1", 2, "4.1"), ("leaf-3", 1, "4.10")], "page string, first_rune int, section string")
    assert [r[2] for r in rows(runetext.sections_by_offset(runes, F.col("page"), starts))] == [None] * 2 + ["4.1"] * 7 + ["4.10"] * 3


def test_tables_keep_section_ids(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_text('section,notes\n4.1,"a ""b"", c"\n4.10,\n', encoding="utf-8")
    assert rows(transcriptions.read_csv(spark, str(tmp_path / "t.csv"), "section string, notes string")) == [("4.1", 'a "b", c'), ("4.10", "")]


def test_log_entries(spark, tmp_path):
    path, known = str(tmp_path / "deep" / "log.jsonl"), {"4.1", "4.10"}
    entries, bad = explog.read_log(spark, path)
    assert entries.isEmpty() and bad.isEmpty() and explog.next_id(entries).first()[0] == 1
    with ThreadPoolExecutor(5) as pool:
        ids = list(pool.map(lambda k: explog.add(path, known, "4.10", f"sweep {k}", "running", '{"from": 2}' if k % 2 else "by hand"), range(5)))
    assert sorted(ids) == [1, 2, 3, 4, 5]
    assert explog.add(path, known, explog.ALL_SECTIONS, "two\u2028lines", "promising", coverage="half", notes="ü") == 6
    entries, bad = explog.read_log(spark, path)
    assert entries.count() == 6 and bad.isEmpty() and explog.next_id(entries).first()[0] == 7
    assert explog.searching(entries, "SWEEP").count() == 5 and explog.searching(entries, "coverage").count() == 6
    assert [r["id"] for r in explog.matching(entries, known, "all", "promising").collect()] == [6]


def test_log_refuses(spark, tmp_path):
    path, known = str(tmp_path / "log.jsonl"), {"4.1"}
    for section, verdict in (("4.2", "running"), ("4.1", "perhaps"), ("", "running")):
        with pytest.raises(explog.LogError):
            explog.add(path, known, section, "m", verdict)
    assert not (tmp_path / "log.jsonl").exists()
    assert explog.add(path, known, "4.1", "m", "solved") == 1
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n[1]\n{cut off\n")
    assert [(r["line"], r["raw"]) for r in explog.read_log(spark, path)[1].orderBy("line").collect()] == [(3, "[1]"), (4, "{cut off")]
    with pytest.raises(explog.LogError, match="3, 4"):
        explog.add(path, known, "4.1", "m", "running")
    for section, verdict in (("9.9", None), (None, "perhaps")):
        with pytest.raises(explog.LogError):
            explog.matching(explog.read_log(spark, path)[0], known, section, verdict)


def test_known_sections_come_from_their_table(spark, tmp_path):
    columns = [c.split()[0] for c in transcriptions.SECTIONS.split(", ")]
    rows_ = [",".join([s] + ["", "0"] + [""] * (len(columns) - 3)) for s in ("4.1", "4.10")]
    (tmp_path / "sections.csv").write_text("\n".join([",".join(columns), *rows_]) + "\n", encoding="utf-8")
    assert explog.known_sections(spark, str(tmp_path / "sections.csv")) == {"4.1", "4.10"}


def test_checks_do_not_pass_over_nothing(spark):
    table = A.alphabet(spark)
    assert all(r["passed"] for r in verify.report([verify.alphabet_check(table), verify.spelling_check(table)]).collect())
    assert not verify.check("nothing", table.limit(0), F.lit(False)).first()["passed"]
    assert not verify.check("too few", table, F.lit(False), exactly=30).first()["passed"]
    assert verify.skipped(spark, "sentences", "no table").first()["passed"] is None
    wrong = spark.createDataFrame([("A STAR", "ypqye"), ("STAR", "pqyx")], "english string, canon string")
    assert [r["passed"] for r in (verify.speller_check(wrong.limit(1)).first(), verify.speller_check(wrong).first())] == [True, False]


def test_streams_equal_batches(spark, tmp_path):
    from runeframe.streaming import archive as S

    data = [(i, datetime(2021, 1, 1 + i // 40, i % 24), i % 3) for i in range(200)] + [(5, datetime(2021, 1, 1, 5), 2)]
    spark.createDataFrame(data, "id long, at timestamp, who int").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: S.read_table_stream(spark, str(tmp_path), "", "id long, at timestamp, who int")
    assert S.run_available(S.once(stream(), ["id"], "at", "30 days")).count() == 200
    counted = S.run_available(S.counts(stream(), "at", "who", "1 day"), "complete")
    assert counted.agg(F.sum("n")).first()[0] == 201


def test_solutions_training_and_digest(spark, tmp_path, rows):
    for name, text in (("key.md", "A STAR"), ("notes.txt", "owls\nat dusk"), ("area.txt", "x")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert rows(transcriptions.read_solutions(spark, str(tmp_path))) == [("key.md", "A STAR")]
    texts = transcriptions.training_texts(spark, [(str(tmp_path), "*.md"), (str(tmp_path), "*.txt")])
    assert [r["text"] for r in texts.orderBy("o").collect()] == ["A STAR", "x", "owls\nat dusk"]
    paths = [str(tmp_path / n) for n in ("area.txt", "key.md")]
    assert transcriptions.corpus_digest(paths) != transcriptions.corpus_digest(paths[::-1]) and len(transcriptions.corpus_digest(paths)) == 64
