"""Tokens, postings, neighbourhood documents and ranked full-text search.

A text's tokens are kept as one string with a blank before, between and after them, so that terms,
prefixes and phrases are tested and counted by string functions inside the row. Postings are only
made where they are to be stored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.session import cut_lineage

K1, B = 1.2, 0.75
CONTEXT_ROWS, CONTEXT_GAP_S = 2, 6 * 3600
#: Positions per block of a channel; blocks, not channels, are the window's partitions.
BLOCK = 4096


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose to a plain letter and marks, and those plain letters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)
        if len(base) > 1 and unicodedata.category(base[0])[0] == "L" and all(unicodedata.category(c) == "Mn" for c in base[1:]):
            pairs.append((ch, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: str) -> list[str]:
    """Tokens of a text on the driver, as ``tokens`` makes them."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    return re.findall(r"[^\W_]+", plain)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case without diacritics: ``" a b "``; a single blank for none, NULL as none."""
    plain = F.regexp_replace(F.lower(F.translate(text, *_accents())), r"\p{Mn}+", "")
    words = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{Co}]+", " "))
    return F.when(F.coalesce(words, F.lit("")) == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def token_count(joined: Column) -> Column:
    return F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) - 1


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf``. A document's tokens lie in one task, so partial counts leave one row per pair to shuffle."""
    words = F.filter(F.split(tokens(F.col(text_col)), " "), lambda w: w != "")
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def neighbourhoods(messages: DataFrame, rows: int = CONTEXT_ROWS, gap_s: int = CONTEXT_GAP_S) -> DataFrame:
    """``id, text``: each message's text with those at most ``rows`` positions and ``gap_s`` seconds away.

    ``messages``: ``id, channel, seq, at, body`` with unique positions. Channels are cut into
    blocks of positions that overlap by ``rows``, so a long channel is many partitions. A message
    without time has only itself; null bodies count as empty.
    """
    block = F.expr(f"seq div {BLOCK}")
    edge = F.array_distinct(F.array(block, F.expr(f"(seq - {rows}) div {BLOCK}"), F.expr(f"(seq + {rows}) div {BLOCK}")))
    placed = messages.select("id", "channel", "seq", F.col("at").cast("long").alias("t"), F.coalesce("body", F.lit("")).alias("body"), block.alias("own"), F.explode(edge).alias("block"))
    near = Window.partitionBy("channel", "block").orderBy("seq").rangeBetween(-rows, rows)
    around = F.collect_list(F.struct("seq", "t", "body")).over(near)
    seen = placed.select("id", "seq", "t", "own", "block", around.alias("around")).where("own = block")
    kept = F.filter("around", lambda a: (a["seq"] == F.col("seq")) | (F.abs(a["t"] - F.col("t")) <= gap_s))
    return seen.select("id", F.array_join(F.transform(F.array_sort(kept), lambda a: a["body"]), "\n").alias("text"))


# -- query language -------------------------------------------------------------------------


class InvalidQuery(ValueError):
    """A query with nothing to search for."""


@dataclass(frozen=True)
class Phrase:
    """Words in a row; the last may be a prefix, the first may have to open the text."""

    words: tuple[str, ...]
    prefix: bool = False
    opens: bool = False

    def pattern(self) -> str:
        return " " + " ".join(self.words) + ("" if self.prefix else " ")

    def matches(self, joined: Column) -> Column:
        return F.startswith(joined, F.lit(self.pattern())) if self.opens else F.contains(joined, F.lit(self.pattern()))

    def count(self, joined: Column) -> Column:
        """Occurrences; overlapping ones count."""
        return self.matches(joined).cast("int") if self.opens else F.regexp_count(joined, F.lit(f"(?={self.pattern()})"))

    def starts(self, words: Column) -> Column:
        """Places in an array of words at which the phrase begins."""
        size, last = len(self.words), self.words[-1]

        def here(i: Column) -> Column:
            ends = F.get(words, i + size - 1)
            whole = F.startswith(ends, F.lit(last)) if self.prefix else ends == last
            for k, w in enumerate(self.words[:-1]):
                whole = whole & (F.get(words, i + k) == w)
            return whole & (i == 0) if self.opens else whole

        places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, here)


@dataclass(frozen=True)
class Near:
    """Any number of phrases, each ending at most ``distance`` words before the one that starts last."""

    phrases: tuple[Phrase, ...]
    distance: int

    def matches(self, joined: Column) -> Column:
        words = F.filter(F.split(joined, " "), lambda w: w != "")
        starts = [p.starts(words) for p in self.phrases]

        def within(places: Column, reach: int, at: Column) -> Column:
            return F.exists(places, lambda i: (i <= at) & (i + reach >= at))

        def last(at: Column) -> Column:
            near = F.lit(True)
            for p, places in zip(self.phrases, starts):
                near = near & within(places, len(p.words) + self.distance, at)
            return near

        every = F.lit(True)
        for p in self.phrases:  # the cheap test first
            every = every & p.matches(joined)
        return F.when(every, F.exists(F.flatten(F.array(*starts)), last)).otherwise(False)


@dataclass(frozen=True)
class Bool:
    op: str
    left: object
    right: object

    def matches(self, joined: Column) -> Column:
        a, b = self.left.matches(joined), self.right.matches(joined)
        return {"and": lambda: a & b, "or": lambda: a | b, "not": lambda: a & ~b}[self.op]()


def ranked_phrases(node) -> list[Phrase]:  # noqa: ANN001
    """The phrases that score; what stands right of NOT does not."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return ranked_phrases(node.left) + ([] if node.op == "not" else ranked_phrases(node.right))


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()+^*,])|([\w]+))', re.U)


class _Parser:
    """OR binds loosest, then AND, then NOT; terms side by side are joined by AND."""

    def __init__(self, query: str) -> None:
        self.items: list[str] = []
        at = 0
        text = query.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise SyntaxError(f"unexpected {text[at:at + 5]!r}")
            self.items.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self, wanted: str | None = None) -> str:
        item = self.peek()
        if item is None or (wanted is not None and item != wanted):
            raise SyntaxError(f"expected {wanted or 'a term'}")
        self.at += 1
        return item

    def whole(self):  # noqa: ANN201
        node = self.either()
        if self.peek() is not None:
            raise SyntaxError(f"unexpected {self.peek()!r}")
        return node

    def either(self):  # noqa: ANN201
        node = self.both()
        while self.peek() == "OR":
            self.take()
            node = Bool("or", node, self.both())
        return node

    def both(self):  # noqa: ANN201
        node = self.unless()
        while self.peek() == "AND":
            self.take()
            node = Bool("and", node, self.unless())
        return node

    def unless(self):  # noqa: ANN201
        node = self.side_by_side()
        while self.peek() == "NOT":
            self.take()
            node = Bool("not", node, self.side_by_side())
        return node

    def side_by_side(self):  # noqa: ANN201
        node = self.single()
        while self.peek() is not None and self.peek() not in ("OR", "AND", "NOT", ")"):
            node = Bool("and", node, self.single())
        return node

    def single(self):  # noqa: ANN201
        if self.peek() == "(":
            self.take()
            node = self.either()
            self.take(")")
            return node
        if self.peek() == "NEAR" and self.items[self.at + 1 : self.at + 2] == ["("]:
            self.take()
            self.take("(")
            phrases, distance = [], 10
            while self.peek() not in (")", ",", None):
                phrases.append(self.phrase())
            if self.peek() == ",":
                self.take()
                distance = int(self.take())
            self.take(")")
            if not phrases:
                raise SyntaxError("NEAR without a phrase")
            return Near(tuple(phrases), distance) if len(phrases) > 1 else phrases[0]
        return self.phrase()

    def phrase(self) -> Phrase:
        opens = self.peek() == "^"
        if opens:
            self.take()
        words: list[str] = []
        while True:
            item = self.take()
            if item in ("AND", "OR", "NOT") or (len(item) == 1 and not item.isalnum() and item != "_"):
                raise SyntaxError(f"unexpected {item!r}")
            words += fold(item[1:-1].replace('""', '"') if item[0] == '"' else item)
            if self.peek() != "+":
                break
            self.take()
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        if not words:
            raise SyntaxError("a phrase without words")
        return Phrase(tuple(words), prefix, opens)


#: Outside quotes: a column filter, or a hyphen before a word, which is read as one.
_COLUMN = re.compile(r"\w+\s*:|-\s*(?=\w)")


def parse(query: str) -> tuple[object, str, bool]:
    """``(tree, query searched, fell back)``.

    A query that is not valid in the query language is searched as its quoted words, all required.
    A column filter is refused, as the index of texts and that of neighbourhoods share no column,
    and so is a query without any word.
    """
    bare = re.sub(r'"(?:[^"]|"")*"', " ", query)
    if named := _COLUMN.search(bare):
        raise InvalidQuery(f"no such column: {named[0].strip(' :-') or bare[named.end() :].split()[0]} in {query!r}; quote words with a hyphen or colon")
    try:
        return _Parser(query).whole(), query, False
    except (SyntaxError, ValueError):
        kept = [w for w in re.split(r"\W+", query) if fold(w)]
    if not kept:
        raise InvalidQuery(f"nothing searchable in {query!r}")
    every = reduce(lambda a, b: Bool("and", a, b), (Phrase(tuple(fold(w))) for w in kept))
    return every, '"' + '" "'.join(kept) + '"', True


def ranked(docs: DataFrame, id_col: str, joined_col: str, tree) -> DataFrame:  # noqa: ANN001
    """``id, score``: BM25 of the matching documents, negated so that the best is the smallest.

    Corpus figures (documents, mean length, documents per phrase) come from one aggregation to a
    single row; a phrase in more than half of the documents keeps a small positive weight.
    """
    phrases = list(dict.fromkeys(ranked_phrases(tree)))
    joined = F.col(joined_col)
    # one narrow row per document, written once: both the figures and the scores read it
    base = cut_lineage(docs.select(F.col(id_col).alias("id"), token_count(joined).alias("dl"), *(p.count(joined).alias(f"tf{i}") for i, p in enumerate(phrases)), tree.matches(joined).alias("hit")))
    figures = base.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(phrases))))
    score = bm25([F.col(f"tf{i}") for i in range(len(phrases))], [F.col(f"df{i}") for i in range(len(phrases))])
    return base.where("hit").join(F.broadcast(figures)).select("id", score.alias("score"))


def bm25(tfs: list[Column], dfs: list[Column]) -> Column:
    """BM25 of a document, negated so that the best is the smallest, from counts of its phrases and of the documents that hold them.

    ``dl``, ``docs`` and ``avgdl`` are columns. A phrase in more than half of the documents keeps a small positive weight.
    """
    score = F.lit(0.0)
    for tf, df in zip(tfs, dfs):
        ratio = (F.col("docs") - df + 0.5) / (df + 0.5)
        idf = F.greatest(F.log(F.greatest(ratio, F.lit(1e-300))), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return -score
