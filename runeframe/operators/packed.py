"""Several values packed in one field: one row per value with its position.

Dictionary-guided segmentation. A field is cut at delimiters, but two kinds of stretches are
taken whole with the delimiters inside them: quoted values, and values of a dictionary of known
whole values found by a multi-pattern automaton. Where stretches compete, dynamic programming
picks the cover with most characters in known or quoted values, and among those the fewest values.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed characters: opening quote to closing quote, and those that show nothing on screen.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")


@dataclass(frozen=True)
class Packing:
    """How values are packed.

    ``delimiters``: the characters that part values. ``other_than_digits``: every character but
    digits parts values (number lists). ``lead``: a pattern the text must start with, values come
    after it. ``known``: whole values that may hold delimiters.
    """

    delimiters: str = ",;|/\t\n\r"
    other_than_digits: bool = False
    lead: str | None = None
    known: tuple[str, ...] = field(default=())


class Splitter:
    """Splits texts by one ``Packing``; built once per task."""

    def __init__(self, packing: Packing) -> None:
        self.p = packing
        self.lead = re.compile(packing.lead) if packing.lead else None
        self.parts = re.compile(r"\D" if packing.other_than_digits else "[" + re.escape(packing.delimiters) + "]")
        self.automaton = None
        if packing.known:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for value in packing.known:
                if value.strip():
                    self.automaton.add_word(value.strip().lower(), len(value.strip()))
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[str]:
        if text is None:
            return []
        if self.lead:
            m = self.lead.match(text)
            if not m:
                return []
            text = text[m.end() :]
        elif self.p.other_than_digits:
            text = INVISIBLE.sub("", text)
        cuts = [m.start() for m in self.parts.finditer(text)]
        cuts.append(len(text))
        known = self._known_spans(text)
        if not known and not any(q in text for q in QUOTES):
            return [v for a, b in zip([0, *(c + 1 for c in cuts)], cuts) if (v := text[a:b].strip())]
        return self._best_cover(text, cuts, known)

    def _known_spans(self, text: str) -> dict[int, list[int]]:
        """Ends of the known values by their start."""
        found: dict[int, list[int]] = {}
        if self.automaton is not None:
            low = text.lower()
            if len(low) != len(text):  # a character whose lower case is longer stays, so that offsets hold
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for end, size in self.automaton.iter(low):
                found.setdefault(end + 1 - size, []).append(end + 1)
        return found

    def _quoted(self, text: str, at: int) -> tuple[int, str] | None:
        """End and inner value of the quoted value opening at ``at``; a doubled or escaped quote stands for one."""
        close = QUOTES.get(text[at])
        if close is None:
            return None
        out, i, n = [], at + 1, len(text)
        while i < n:
            ch = text[i]
            if ch == "\\" and i + 1 < n and text[i + 1] in (close, "\\"):
                out.append(text[i + 1])
                i += 2
            elif ch == close:
                if text[i + 1 : i + 2] == close:
                    out.append(close)
                    i += 2
                else:
                    return i + 1, "".join(out)
            else:
                out.append(ch)
                i += 1
        return None

    def _best_cover(self, text: str, cuts: list[int], known: dict[int, list[int]]) -> list[str]:
        n, is_cut = len(text), set(cuts)

        def after_blanks(i: int) -> int:
            while i < n and i not in is_cut and text[i].isspace():
                i += 1
            return i

        next_cut, k = {}, 0
        for i in range(n + 1):
            while cuts[k] < i:
                k += 1
            next_cut[i] = cuts[k]
        # best[i]: (known characters, -values, value taken, its end) for the text from field start i on
        best: dict[int, tuple[int, int, str, int]] = {n + 1: (0, 0, "", n + 1)}
        for start in reversed([0, *(c + 1 for c in cuts[:-1])]):
            at, options = after_blanks(start), []
            plain = next_cut[start]
            value = text[start:plain].strip()
            options.append((0, value, plain))
            if at < n and at not in is_cut:
                if q := self._quoted(text, at):
                    end, inner = after_blanks(q[0]), q[1].strip()
                    if end in is_cut:
                        options.append((end - at, inner, end))
                for stop in known.get(at, ()):
                    end = after_blanks(stop)
                    if end in is_cut:
                        options.append((stop - at, text[at:stop], end))
            best[start] = max(
                ((covered + best[end + 1][0], best[end + 1][1] - bool(value), value, end + 1) for covered, value, end in options),
                key=lambda o: (o[0], o[1], o[3]),
            )
        out, at = [], 0
        while at <= n:
            _, _, value, at = best[at]
            if value:
                out.append(value)
        return out


def split_packed(df: DataFrame, id_col: str, text_col: str, packing: Packing) -> DataFrame:
    """``id, pos, value``: one row per non-empty value of ``text_col``, positions from 1.

    Null, empty and blank texts and texts without the lead give no rows; a quote that never
    closes is ordinary text; repeated rows are split each. Other columns are ignored.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        split = Splitter(packing)
        for batch in batches:
            ids, pos, values = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, value in enumerate(split(text), 1):
                    ids.append(i)
                    pos.append(k)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(values, pa.string())], ["id", "pos", "value"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, schema)
