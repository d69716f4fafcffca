"""Chat exports as text files to message rows.

A header line opens a message; it counts only after a blank line and with a time that exists.
Lines in braces open an extra block, which a blank line ends. As a header stands behind a blank
line, nothing carries over from message to message: a file is cut at its headers, and each message
is read by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.operators.prefix import running_totals
from runeframe.session import cut_lineage, shared_place

#: Lines at the head of a file that may name the channel, and files whose first ids are broadcast at most.
HEAD, BROADCAST_ROWS = 6, 500_000
#: Fixed patterns of the grammar over a whole text: dots, starts and ends in Unix mode, white space of any kind.
SHAPE = r"\[\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M\] \S"
#: A blank line, or the start of the file, before a line of a header's shape.
OPENING = rf"(?dmU)(\A|^[^\S\n]*\n)(?={SHAPE})"
#: A line in braces and what follows it up to a blank line. Possessive, so that no length exhausts the stack.
EXTRA = r"(?dmU)^\{[A-Z][A-Za-z ]*\}$(?:\n[^\S\n]*\S.*)*+"
STAMP, AUTHOR = r"^\[([^\]]*)\]", r"(?d)^\[[^\]]*\] (.*)"
BLANKS = r"(?U)\n\s*\n"
PINNED = r"\s*\(pinned\)$"


def read_exports(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content``: whole files; a file that is not UTF-8 fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    text = F.decode("content", "UTF-8")
    broken = F.encode(text, "UTF-8") != F.col("content")
    return files.select("path", F.when(~broken, text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))).alias("content"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """``file, bytes, sha256`` of each export."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(text, STAMP, 1), F.lit("M/d/yyyy h:mm a"))


def _texts(files: DataFrame) -> DataFrame:
    """``path, channel, channel_name, seq, line, text``: each message's lines, from its header on.

    Line ends are made one kind first, so a carriage return is free to mark the headers. Every step
    goes over a file once: nothing of a whole file may be asked for per line, or held beside its rows.
    """
    plain = files.select("path", _stem(F.col("path")).alias("channel"), F.regexp_replace("content", "\r\n?", "\n").alias("all"))
    named = F.filter(F.split(F.substring_index("all", "\n", HEAD), "\n"), lambda ln: F.startswith(ln, F.lit("Channel:")))
    name = _trimmed(F.regexp_replace(F.get(named, F.lit(0)), r"^[^:]*:", ""))
    shaped = plain.select("path", "channel", F.coalesce(name, F.col("channel")).alias("channel_name"), F.split(F.regexp_replace("all", OPENING, "$1\r"), "\r").alias("parts"))
    # a header's shape with an impossible time opens nothing, so its mark goes
    marked = F.transform("parts", lambda t, i: F.when((i > 0) & _time(t).isNotNull(), F.concat(F.lit("\r"), t)).otherwise(t))
    marks = shaped.select("path", "channel", "channel_name", F.array_join(marked, "").alias("all"))
    texts = F.filter(F.split("all", "\r"), lambda _, i: i > 0)
    lines = F.array_compact(F.transform(F.split("all", "\n"), lambda ln, i: F.when(F.startswith(ln, F.lit("\r")), i + 1)))
    found = marks.select("path", "channel", "channel_name", F.posexplode(F.arrays_zip(texts.alias("text"), lines.alias("line"))).alias("at", "m"))
    return found.select("path", "channel", "channel_name", (F.col("at") + 1).alias("seq"), "m.line", "m.text")


def parse_exports(files: DataFrame) -> DataFrame:
    """``id, channel, channel_name, ts, author, pinned, body, extra, seq, line`` from ``path, content``.

    Ids run over channels in order of their names, then lines. Blank lines are dropped, so paragraphs join with
    one line end; after a blank line, text behind an extra block is body again. A header-shaped
    line with an impossible time is body wherever it stands. Files without a message give no row.
    The messages are written once to the shared folder, as ids need the counts of all files.
    """
    author, behind = F.regexp_extract("text", AUTHOR, 1), F.regexp_replace("text", r"^[^\n]*\n?", "")
    messages = _texts(files).select(
        "path", "channel", "channel_name", F.date_format(_time(F.col("text")), "yyyy-MM-dd HH:mm").alias("ts"), F.regexp_replace(author, PINNED, "").alias("author"), author.rlike(PINNED).alias("pinned"),
        _trimmed(F.regexp_replace(F.regexp_replace(behind, EXTRA, ""), BLANKS, "\n")).alias("body"), _trimmed(F.array_join(F.regexp_extract_all(behind, F.lit(EXTRA), F.lit(0)), "\n")).alias("extra"), "seq", "line"
    )
    spark = files.sparkSession
    place = shared_place(spark, "exports")
    messages.write.parquet(place)
    done = spark.read.schema(messages.schema).parquet(place)
    # counts per file give each file's first id
    sizes = done.groupBy("channel", "path").agg(F.count(F.lit(1)).alias("k"))
    first = cut_lineage(running_totals(sizes, ["channel", "path"], "k").select("path", "before"))
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    return done.join(first, "path").select((F.col("before") + F.col("seq")).alias("id"), *(c for c in done.columns if c != "path"))


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """``file, state``: exports ``added``, ``removed`` or ``changed`` against the indexed fingerprints; sizes are compared before digests."""
    a, b = indexed.alias("a"), current.alias("b")
    both = a.join(b, F.col("a.file") == F.col("b.file"), "full")
    changed = (F.col("a.bytes") != F.col("b.bytes")) | (F.col("a.sha256") != F.col("b.sha256"))
    state = F.when(F.col("a.file").isNull(), "added").when(F.col("b.file").isNull(), "removed").when(changed, "changed")
    return both.select(F.coalesce("a.file", "b.file").alias("file"), state.alias("state")).where("state is not null")
