"""Texts as rune rows: words and lines, concatenation, slices, and sections by offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.operators.prefix import last_before, running_totals


def is_word_end(marks: Column, printed_here: Column | None = None) -> Column:
    """Any mark but a bare line end closes a word, and so does a printed run."""
    ends = (F.coalesce(marks, F.lit("")) != "") & (F.replace(F.coalesce(marks, F.lit("")), F.lit("/"), F.lit("")) != "")
    return ends if printed_here is None else ends | F.coalesce(printed_here, F.lit(False))


def split_on(runes: DataFrame, key: str, ends: Column) -> DataFrame:
    """``key, part, canon_idx, start, n``: stretches of rune rows closed by ``ends``; positions are those of ``pos``."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = runes.withColumn("part", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    return parts.groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda s: s["idx"]).alias("indices"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))


def words(runes: DataFrame, key: str, printed: DataFrame | None = None) -> DataFrame:
    """Words of each text; ``printed`` (``key, anchor``) also ends words."""
    if printed is None:
        return split_on(runes, key, is_word_end(F.col("marks_after")))
    anchors = printed.select(key, F.col("anchor").alias("pos"), F.lit(True).alias("printed")).distinct()
    return split_on(runes.join(anchors, [key, "pos"], "left"), key, is_word_end(F.col("marks_after"), F.col("printed")))


def lines(runes: DataFrame, key: str) -> DataFrame:
    """Printed lines of each text."""
    return split_on(runes, key, F.contains(F.coalesce("marks_after", F.lit("")), F.lit("/")))


def concat(parts: DataFrame, key: str, order: str, printed: DataFrame | None = None, leading: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rune rows of texts set one after the other, with positions over the whole.

    ``parts``: ``key, pos, idx, marks_after``; ``order`` sorts the texts. A text's printed runs move
    with it (one before its first rune is anchored to the rune before it), and its leading marks
    are appended to the marks of the rune before. Offsets are sums over texts, not over runes.
    """
    texts = parts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    if leading is not None:
        texts = leading.select(key, "leading_marks").join(texts, key, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    offsets = running_totals(texts, ["o", key], "n", "offset")
    moved = parts.join(offsets.select(key, "offset"), key).withColumn("pos", F.col("pos") + F.col("offset")).drop("offset")
    if leading is not None:
        carried = offsets.where("leading_marks <> '' and offset > 0").groupBy((F.col("offset") - 1).alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "leading_marks"))), lambda s: s["leading_marks"]), "").alias("carried"))
        moved = moved.join(carried, "pos", "left").withColumn("marks_after", F.concat("marks_after", F.coalesce("carried", F.lit("")))).drop("carried")
    shifted = None
    if printed is not None:
        shifted = printed.join(offsets.select(key, "offset"), key).withColumn("anchor", F.col("anchor") + F.col("offset")).drop("offset")
    return moved, shifted


def slice_rows(runes: DataFrame, key: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows of a slice, renumbered from 0; a step other than 1 blanks the marks, as they no longer follow their rune."""
    if step == 0:
        raise ValueError("step must not be zero")
    size = F.max("pos").over(Window.partitionBy(key)) + 1

    def bound(value: int | None, absent: Column) -> Column:
        if value is None:
            return absent
        at = F.lit(value) if value >= 0 else size + value
        return F.least(F.greatest(at, F.lit(0 if step > 0 else -1)), size if step > 0 else size - 1)

    first = bound(start, F.lit(0) if step > 0 else size - 1)
    last = bound(stop, size if step > 0 else F.lit(-1))
    placed = runes.withColumn("_a", first).withColumn("_b", last)
    inside = (F.col("pos") >= F.col("_a")) & (F.col("pos") < F.col("_b")) if step > 0 else (F.col("pos") <= F.col("_a")) & (F.col("pos") > F.col("_b"))
    kept = placed.where(inside & ((F.col("pos") - F.col("_a")) % step == 0))
    new = ((F.col("pos") - F.col("_a")) / step).cast("int")
    marks = F.col("marks_after") if step == 1 else F.lit("")
    return kept.withColumn("pos", new).withColumn("marks_after", marks).drop("_a", "_b")


def sections_by_offset(runes: DataFrame, order: Column, starts: DataFrame) -> DataFrame:
    """Each rune with the last section that starts at or before it: an as-of join.

    ``starts``: ``page, first_rune, section``, one row per section. Starts are joined to their rune
    by equality and carried forward along the page order, in two levels: inside a page by window,
    and from page to page by range partitions over one row per page. ``asof_sections`` takes starts
    that have no rune row of their own.
    """
    marked = runes.join(starts.select("page", F.col("first_rune").alias("pos"), "section"), ["page", "pos"], "left").withColumn("o", order)
    inside = Window.partitionBy("page").orderBy("pos")
    local = marked.withColumn("own", F.last("section", ignorenulls=True).over(inside))
    pages = local.groupBy("page").agg(F.min("o").alias("o"), F.max_by("own", "pos").alias("ends_in"))
    carried = last_before(pages, ["o", "page"], "ends_in", "from_before").select("page", "from_before")
    return local.join(carried, "page").withColumn("section", F.coalesce("own", "from_before")).drop("own", "from_before", "o")


def asof_sections(points: DataFrame, starts: DataFrame, page: str, pos: str) -> DataFrame:
    """``points`` with ``section``: the last start at or before each point in the order of pages and positions; null before the first.

    ``starts``: ``page, first_rune, section``. Both sides are one stream in order, so no point is
    compared with more than the start before it, whatever the number of starts. Points with a null
    page or position have no section.
    """
    marks = starts.select(F.col("page").alias("_pg"), F.col("first_rune").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"), F.col("section").alias("_s"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_row"))
    rows = points.select(F.col(page).alias("_pg"), F.col(pos).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_n"), F.lit(None).cast("string").alias("_s"), F.struct("*").alias("_row"))
    placed = rows.where(F.col(page).isNotNull() & F.col(pos).isNotNull())
    found = last_before(marks.unionAll(placed.select(*marks.columns)), ["_pg", "_at", "_kind", "_n"], "_s", "section").where("_kind = 1").select("_row.*", "section")
    return found.unionAll(points.where(F.col(page).isNull() | F.col(pos).isNull()).withColumn("section", F.lit(None).cast("string")))


def section_after(sections: DataFrame, order: str) -> DataFrame:
    """Each section with the next one in order."""
    return sections.withColumn("next_section", F.lead("section").over(Window.orderBy(order)))


def first_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, at``: first position where two renderings differ or one ends; null where they agree."""
    both = a.select(key, "pos", F.col("idx").alias("x")).join(b.select(key, "pos", F.col("idx").alias("y")), [key, "pos"], "full")
    return both.groupBy(key).agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("pos"))).alias("at"))
