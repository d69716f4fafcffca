"""Command line: index exports, search an index, keep the experiment log, run the drift checks.

Exit codes: 0 for a run that went well, hits or not; 2 for a bad query or a missing index; 1 for
an index build without exports.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runeframe.functions.alphabet import CANON, alphabet
from runeframe.operators import search, verify
from runeframe.operators.notation import UnreadableQuery, canonical_query
from runeframe.operators.textindex import InvalidQuery, parse
from runeframe.session import local_session
from runeframe.sources import corpus, explog, exports, indexstore


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="runeframe", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="build and publish an index of a folder of exports")
    index.add_argument("exports")
    index.add_argument("folder")
    find = sub.add_parser("search", help="search an index by text or by a sequence")
    find.add_argument("folder")
    find.add_argument("query", nargs="?")
    find.add_argument("--runes")
    find.add_argument("--channels", action="store_true")
    for name in ("channel", "author", "since", "until"):
        find.add_argument(f"--{name}")
    find.add_argument("--limit", type=int, default=search.LIMIT)
    find.add_argument("--window", type=int, default=search.WINDOW)
    find.add_argument("--chars", type=int, default=search.CHARS, help="characters of a body that are shown")
    find.add_argument("--full", action="store_true", help="show whole bodies")
    find.add_argument("--json", action="store_true")
    find.add_argument("--exports", help="warn where the index is older than these exports")
    log = sub.add_parser("log", help="add, list or search log entries")
    log.add_argument("path")
    log.add_argument("action", choices=("add", "list", "search"))
    log.add_argument("term", nargs="?")
    for name in ("section", "method", "verdict", "params", "coverage", "notes"):
        log.add_argument(f"--{name}")
    log.add_argument("--sections", default="", help="known sections: their table (a .csv file), or ids separated by commas")
    log.add_argument("--json", action="store_true")
    drift = sub.add_parser("verify", help="run the drift checks of the built-in tables, and of a corpus")
    drift.add_argument("--book", help="folder of the corpus")
    drift.add_argument("--alphabet", help="its alphabet table")
    drift.add_argument("--pins", help="JSON file of what it is known to hold")
    return top.parse_args(argv)


def render_blocks(blocks: DataFrame) -> str:
    """Blocks as text: ``>`` marks hits, cut bodies end in dots. A search's limit bounds the blocks."""
    out = []
    for b in blocks.orderBy("rank", "channel", "block").collect():
        out.append(f"== {b['channel']} {b['first_seq']}-{b['last_seq']}")
        for m in b["messages"]:
            out.append(f"{'>' if m['matched'] else ' '} {m['line']} {m['ts']} {m['author']}: {m['body'] or '(no text)'}{' ...' if m['truncated'] else ''}" + (f"  [{m['note']}]" if m["note"] else ""))
    return "\n".join(out) or "no hits"


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    if bool(a.query) + bool(a.runes) + a.channels != 1:
        raise InvalidQuery("give a query, a sequence or the channel list, and one of them only")
    if a.limit < 1 or a.window < 0 or a.chars < 1:
        raise InvalidQuery("limit and chars must be positive, window must not be negative")
    store = indexstore.search_store(spark, a.folder)
    messages = store.table("messages")
    if a.exports:
        for r in exports.stale(indexstore.load(spark, a.folder, "provenance"), exports.fingerprints(spark, a.exports)).collect():
            print(f"warning: {r['file']} was {r['state']} since the index was built", file=sys.stderr)
    if a.channels:
        summary = search.channel_summary(messages).orderBy(F.desc("n"), "channel")
        print("\n".join(summary.toJSON().collect() if a.json else (f"{r['n']:>8} {r['channel']} {r['first_ts']} .. {r['last_ts']}" for r in summary.collect())))
        return 0
    filters = search.Filters(a.channel, a.author, a.since, a.until)
    notation, indices, searched = None, None, None
    if a.runes:
        canon, notation = canonical_query(a.runes)
        indices = [CANON.index(c) for c in canon]
        print(f"query: {len(canon)} symbols, read as {notation}: {' '.join(map(str, indices))}", file=sys.stderr)
        hits, order = search.sequence_hits(messages, indexstore.load(spark, a.folder, "runes"), a.runes, filters, a.limit), [F.desc("n"), F.col("id")]
    else:
        _, searched, fell_back = parse(a.query)
        if fell_back:
            print(f"note: searched {searched} instead; every word is required", file=sys.stderr)
        hits, order = store.text_hits(a.query, filters, a.limit), [F.col("score"), F.col("id")]
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).cache()
    blocks = store.context_blocks(ranked, a.window, None if a.full else a.chars)
    print(search.result_json(blocks, a.runes or a.query, ranked.count(), notation, indices, searched).first()["json"] if a.json else render_blocks(blocks))
    return 0


def _log(spark: SparkSession, a: argparse.Namespace) -> int:
    known = explog.known_sections(spark, a.sections) if a.sections.endswith(".csv") else {s for s in a.sections.split(",") if s}
    if a.action == "add":
        print(f"logged #{explog.add(a.path, known, a.section or '', a.method or '', a.verdict or 'running', a.params, a.coverage or '', a.notes or '')}")
        return 0
    entries, bad = explog.read_log(spark, a.path)
    for r in bad.toLocalIterator():
        print(f"warning: unreadable line {r['line']}: {r['raw'][:60]!r}", file=sys.stderr)
    entries = explog.matching(entries, known or None, a.section, a.verdict)
    if a.action == "search":
        entries = explog.searching(entries, a.term or "")
    none = True
    for r in entries.orderBy("id").toLocalIterator():  # a partition at a time
        none = False
        print(r["raw"] if a.json else f"#{r['id']} {r['ts']} {r['section']} {r['verdict']}: {r['method']} {r['notes'] or ''}")
    if none:
        print("no entries")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = local_session(spark__ui__showConsoleProgress="false")
    try:
        if a.command == "index":
            if not os.path.isdir(a.exports):
                print(f"no folder {a.exports}", file=sys.stderr)
                return 1
            print(indexstore.build(spark, a.exports, a.folder))
            return 0
        if a.command == "search":
            return _search(spark, a)
        if a.command == "log":
            return _log(spark, a)
        table = alphabet(spark)
        checks = [verify.alphabet_check(table), verify.spelling_check(table)]
        if a.book:
            loaded = corpus.load(spark, corpus.Places.under(a.book, a.alphabet or os.path.join(a.book, "alphabet.csv")))
            checks += [verify.alphabet_check(loaded.alphabet), verify.corpus_checks(loaded, verify.Pins.read(a.pins) if a.pins else verify.Pins())]
        results = verify.report(checks).collect()
        for r in results:
            print(f"{'SKIP' if r['passed'] is None else 'PASS' if r['passed'] else 'FAIL'} {r['name']}: {r['detail']}")
        return int(any(r["passed"] is False for r in results))
    except (InvalidQuery, UnreadableQuery, explog.LogError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
