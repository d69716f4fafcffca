"""Index tables on disk, published by switching one pointer, and searches that read them.

A build writes a new version beside the old one; readers follow the pointer, so a failed build
leaves the old index as it was.

The search tables are sorted by what they are asked for: postings by term, documents by id,
messages by channel and position. A search filters postings by its terms, which prunes files and
row groups, joins the documents of the candidates, and decides and scores those alone.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.operators.notation import indexed
from runeframe.operators import search as S
from runeframe.operators import textindex as TI
from runeframe.operators.search import archive
from runeframe.operators.textindex import neighbourhoods
from runeframe.sources.exports import fingerprints, parse_exports, read_exports

TABLES = ("messages", "runes", "provenance")
SEARCH = "search"
POINTER = "_CURRENT"


def build(spark: SparkSession, exports: str, folder: str) -> str:
    """Builds an index of the exports under ``folder`` and publishes it; returns the version."""
    version = f"v-{uuid.uuid4().hex}"
    base = f"{folder}/{version}"
    parse_exports(read_exports(spark, exports)).write.parquet(f"{base}/messages")
    messages = spark.read.parquet(f"{base}/messages")
    found = indexed(messages, "id", "body").withColumn("id", F.monotonically_increasing_id())
    found.write.parquet(f"{base}/runes")
    write_search(archive(messages), f"{base}/{SEARCH}")
    fingerprints(spark, exports).write.parquet(f"{base}/provenance")
    publish(folder, version)
    return version


def write_search(messages: DataFrame, folder: str) -> None:
    """Writes the search tables of an archive (one row per channel and position).

    ``own`` and ``around``: postings of messages and of neighbourhoods; ``docs``: both token
    strings with what filters need; ``messages``: what is shown; ``figures``: number and mean length of the neighbourhoods.
    """
    placed = messages.where("channel is not null and seq is not null")
    placed.repartitionByRange("channel", "seq").sortWithinPartitions("channel", "seq").write.parquet(f"{folder}/messages")
    placed = placed.sparkSession.read.parquet(f"{folder}/messages")
    own = placed.select("id", "channel", "seq", "ts", "author", TI.tokens(F.col("body")).alias("own"))
    around = neighbourhoods(placed).select("id", TI.tokens(F.col("text")).alias("around"))
    docs = own.join(around, "id").withColumn("dl", TI.token_count(F.col("around")))
    docs.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/docs")
    docs = placed.sparkSession.read.parquet(f"{folder}/docs")
    for name in ("own", "around"):
        words = F.filter(F.split(name, " "), lambda w: w != "")
        counted = docs.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        counted.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{folder}/{name}")
    docs.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl")).write.parquet(f"{folder}/figures")


class SearchStore:
    """Searches over the written tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _postings(self, name: str, phrase: TI.Phrase) -> DataFrame:
        """``id, tf`` of the documents that hold every word of a phrase; for a single word ``tf`` is its count."""
        words, term = list(dict.fromkeys(phrase.words)), F.col("term")
        last = phrase.words[-1]
        hit, found = F.lit(False), []
        for w in words:
            here = term.startswith(w) if phrase.prefix and w == last else term == w
            hit = hit | here
            found.append(F.max(here.cast("int")))
        grouped = self.table(name).where(hit).groupBy("id").agg(F.sum("tf").alias("tf"), sum(found[1:], found[0]).alias("words"))
        return grouped.where(F.col("words") == len(words)).select("id", "tf")

    def _needed(self, node) -> list[TI.Phrase]:  # noqa: ANN001
        """Phrases of which every match holds at least one."""
        if isinstance(node, TI.Phrase):
            return [node]
        if isinstance(node, TI.Near):
            return [node.phrases[0]]
        if node.op == "or":
            return self._needed(node.left) + self._needed(node.right)
        return self._needed(node.left)

    def candidates(self, name: str, tree) -> DataFrame:  # noqa: ANN001
        """``id`` of the documents that can match."""
        parts = [self._postings(name, p).select("id") for p in dict.fromkeys(self._needed(tree))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out.distinct() if len(parts) > 1 else out

    def matching(self, query: str) -> DataFrame:
        """``id`` of the messages that match by themselves."""
        tree, _, _ = TI.parse(query)
        return self.table("docs").select("id", "own").join(self.candidates("own", tree), "id", "left_semi").where(tree.matches(F.col("own"))).select("id")

    def _documents_with(self, phrase: TI.Phrase) -> DataFrame:
        """One row: the number of neighbourhoods with a phrase."""
        found = self._postings("around", phrase)
        if len(phrase.words) > 1 or phrase.opens:
            found = self.table("docs").select("id", "around").join(found, "id", "left_semi").where(phrase.matches(F.col("around")))
        return found.agg(F.count(F.lit(1)).alias("df"))

    def text_hits(self, query: str, filters: S.Filters | None = None, limit: int = S.LIMIT) -> DataFrame:
        """``id, channel, seq, score`` as ``search.text_hits`` gives over the archive."""
        S._limits(limit)
        tree, _, _ = TI.parse(query)
        docs = self.table("docs").join(self.candidates("own", tree), "id", "left_semi").where(tree.matches(F.col("own")) & tree.matches(F.col("around")))
        found = docs.where((filters or S.Filters()).condition()).select("id", "channel", "seq", "around", "dl")
        phrases = list(dict.fromkeys(TI.ranked_phrases(tree)))
        # figures of the corpus: one row each, joined as single rows
        figures = self.table("figures")
        for i, p in enumerate(phrases):
            figures = figures.join(self._documents_with(p).withColumnRenamed("df", f"df{i}"))
        scored = found.join(F.broadcast(figures)).select("id", "channel", "seq", TI.bm25([p.count(F.col("around")) for p in phrases], [F.col(f"df{i}") for i in range(len(phrases))]).alias("score"))
        return scored.orderBy("score", "id").limit(limit)

    def context_blocks(self, hits: DataFrame, window: int = S.WINDOW, chars: int | None = S.CHARS) -> DataFrame:
        """Blocks around hits, whose number the search's limit bounds; only their channels' row groups are read."""
        channels = [r[0] for r in hits.select("channel").distinct().collect()]
        return S.context_blocks(self.table("messages").where(F.col("channel").isin(channels)), hits, window, chars)


def publish(folder: str, version: str) -> None:
    pointer = Path(folder) / POINTER
    fresh = pointer.with_name(f"{POINTER}.{version}")
    fresh.write_text(version, encoding="utf-8")
    os.replace(fresh, pointer)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the published version."""
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
    version = (Path(folder) / POINTER).read_text(encoding="utf-8").strip()
    return spark.read.parquet(f"{folder}/{version}/{name}")


def search_store(spark: SparkSession, folder: str) -> SearchStore:
    """The search tables of the published version."""
    version = (Path(folder) / POINTER).read_text(encoding="utf-8").strip()
    return SearchStore(spark, f"{folder}/{version}/{SEARCH}")
