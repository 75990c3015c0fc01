"""Lines, spacing and columns of pages from the places of their words.

Items are rows (doc_id, page, n, text, x, y, width, height); y grows upwards, n is the order in the source. Lines are windows
and aggregates by page; columns are told from one pass over the items of a page in order of x. No task holds more than a page besides what it sorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
#: How far apart in y a line's items are at most, gaps that are a blank and two, and the gap between paragraphs in line heights.
SAME_LINE, BLANK, TWO_BLANKS, PARAGRAPH = 2.0, 3.0, 30.0, 1.5
#: Least gap between columns, width of a column, and items in one.
COLUMN_GAP, COLUMN_WIDTH, COLUMN_ITEMS = 40.0, 100.0, 5


def _script(text: Column) -> Column:
    """Whether three tenths of a text or more are Tibetan."""
    return F.regexp_count(text, F.lit(r"[\x{0F00}-\x{0FFF}]")) >= 0.3 * F.greatest(F.char_length(text), F.lit(1))


def lines(items: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, line, y, text, paragraph): the lines of each page from the top, numbered from 1; paragraph: a wider gap is above it.

    Items follow each other in a line while the next one down is within SAME_LINE. Between items stands nothing if they touch or are
    closer than BLANK, or if both are Tibetan and a tsek is between them, else one blank, or two from a gap over TWO_BLANKS on.
    Items with a null text or place are left out; those at one place keep the order of n.
    """
    real = items.where("text is not null and x is not null and y is not null").na.fill(0.0, ["width", "height"])
    down = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "n")
    begins = F.coalesce(F.lag("y").over(down) - F.col("y") > SAME_LINE, F.lit(True))
    placed = real.withColumn("_b", begins.cast("int")).withColumn("line", F.sum("_b").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys, "line").orderBy("x", "n")
    before, end = F.lag("text").over(along), F.lag(F.col("x") + F.col("width")).over(along)
    gap = F.col("x") - end
    tsek = _script(before) & _script(F.col("text")) & (before.endswith("་") | F.col("text").startswith("་"))
    blank = F.when(end.isNull() | (gap < BLANK) | tsek, "").when(gap > TWO_BLANKS, "  ").otherwise(" ")
    joined = placed.select(*keys, "line", "x", "n", "y", "height", F.concat(blank, "text").alias("t")).groupBy(*keys, "line")
    made = joined.agg(F.max("y").alias("y"), F.avg("height").alias("height"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "n", "t"))), lambda s: s["t"]), "").alias("text"))
    page = Window.partitionBy(*keys)
    wide = F.lag("y").over(page.orderBy("line")) - F.col("y") > F.avg("height").over(page) * PARAGRAPH
    return made.select(*keys, F.col("line").cast("int").alias("line"), "y", "text", F.coalesce(wide & (F.avg("height").over(page) > 0), F.lit(False)).alias("paragraph"))


def _spread(left: np.ndarray, right: np.ndarray, items: np.ndarray) -> tuple[int, int, float, float, float]:
    """Columns that hold enough items, those of them that are narrow, the least gap between neighbours, and the variance and the most of
    their items, over the mean squared and the mean."""
    held = items >= COLUMN_ITEMS
    order = np.argsort(left[held], kind="stable")
    left, right, items = left[held][order], right[held][order], items[held][order]
    if not len(items):
        return 0, 0, 0.0, 0.0, 0.0
    mean = float(items.mean())
    gap = float((left[1:] - right[:-1]).min()) if len(items) > 1 else 0.0
    return len(items), int((right - left < COLUMN_WIDTH).sum()), gap, float(items.var()) / (mean * mean), float(items.max()) / mean


def _by_strips(x: np.ndarray, end: np.ndarray) -> tuple[float, int, int, bool]:
    """How sure strips are, their columns, narrow ones, and whether the page is one column; x in order, end: where items end."""
    fit: list[tuple[float, float]] = []
    if x[-1] > x[0]:
        for k in (2, 3):
            strip = np.minimum(np.floor((x - x[0]) / ((x[-1] - x[0]) / k)), k - 1)
            at = [x[strip == i] for i in range(k)]
            at = [a for a in at if len(a)]
            if min((np.diff([a.mean() for a in at])), default=1e9) >= COLUMN_GAP:
                fit = [(a[0], a[-1]) for a in at]
            elif k == 2:  # three strips count only where two are apart
                break
    if len(fit) < 2:
        return 0.9, 1, int(x[-1] - x[0] < COLUMN_WIDTH), True
    near = [np.abs(x - (low + high) / 2) <= (high - low) / 2 + COLUMN_GAP / 2 for low, high in fit]
    near = [n for n in near if n.any()]
    n, narrow, gap, uneven, _ = _spread(np.array([x[i].min() for i in near]), np.array([end[i].max() for i in near]), np.array([i.sum() for i in near]))
    sure = 0.0 if n == 0 else 0.9 if n == 1 else 0.4 * (1 - min(uneven, 1.0)) + 0.6 * min(gap / COLUMN_GAP, 1.0)
    return sure, n, narrow, False


def _by_gaps(x: np.ndarray, end: np.ndarray) -> tuple[float, int, int, bool]:
    """The same by gaps."""
    size = x[1:] - end[:-1]
    wide = size >= COLUMN_GAP
    if not wide.any():
        return 0.85, 1, int(end.max() - x[0] < COLUMN_WIDTH), True
    size, at = size[wide], end[:-1][wide] + size[wide] / 2
    cuts = np.sort(at[np.lexsort((at, -size))[:2]])
    left, right = np.array([x[0], *cuts]), np.array([*cuts, end.max()])
    n, narrow, _, _, most = _spread(left, right, np.array([((x >= a) & (end <= b)).sum() for a, b in zip(left, right, strict=True)]))
    balance = 1 - min(most - 1, 0.5) / 0.5
    sure = 0.0 if n == 0 else 0.85 if n == 1 else 0.5 * min(float(size.mean()) / (COLUMN_GAP * 2), 1.0) + 0.5 * balance
    return sure, n, narrow, False


def _layout(x: np.ndarray, width: np.ndarray) -> tuple[str, int, float]:
    """(method, columns, confidence) of a page whose items are in order of x."""
    ways = {"gaps": _by_gaps(x, x + width), "strips": _by_strips(x, x + width)}
    method = max(ways, key=lambda m: ways[m][0])  # the first of equals
    sure, columns, narrow, whole = ways[method]
    sure *= 0.8**narrow * (0.7 if whole and len(x) < COLUMN_ITEMS else 1.0)
    return (method, 1, 0.8) if sure < 0.5 and columns > 1 else (method, columns, sure)


def column_layout(items: DataFrame) -> DataFrame:
    """(doc_id, page, method, columns, confidence) of each page by the surer of two ways; of equals by gaps.

    strips: as many equal strips of x, up to three, as have centres COLUMN_GAP apart; sure by even numbers of items (.4) and gaps (.6).
    gaps: cut in the middle of the two widest gaps between neighbours in x of COLUMN_GAP or more; sure by the gaps' width and the even
    numbers of items, half each. A column has COLUMN_ITEMS items at least. One column is .9 and .85 sure; each that is narrower than
    COLUMN_WIDTH takes a fifth away, and what is then under .5 sure is one column, .8 sure.
    """
    own = items.where("text is not null and x is not null and y is not null").select(*PAGE, "n", F.col("x").cast("double").alias("x"), F.coalesce("width", F.lit(0.0)).cast("double").alias("width"))
    placed = own.withColumn("r", F.row_number().over(Window.partitionBy(*PAGE).orderBy("x", "n"))).select(*PAGE, "r", "x", "width")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages follow each other, each in order of x; r is 1 where one begins."""
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            first = np.flatnonzero(t["r"].to_numpy() == 1)
            x, width = (np.split(t[c].to_numpy(), first[1:]) for c in ("x", "width"))
            method, columns, sure = zip(*map(_layout, x, width), strict=True)
            ids = [t[c].take(pa.array(first)).combine_chunks() for c in PAGE]
            return pa.RecordBatch.from_arrays([*ids, pa.array(method), pa.array(columns, pa.int32()), pa.array(sure, pa.float64())], names=[*PAGE, "method", "columns", "sure"])

        for b in batches:
            begin = np.flatnonzero(b.column("r").to_numpy() == 1)
            if len(begin) and held or len(begin) > 1:
                held.append(b.slice(0, begin[-1]))
                yield made()
                held[:] = [b.slice(begin[-1])]
            else:
                held.append(b)
        if held and sum(map(len, held)):
            yield made()

    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in PAGE)
    return placed.mapInArrow(laid, f"{kinds}, method string, columns int, sure double").select(*PAGE, "method", "columns", F.round("sure", 6).alias("confidence"))
