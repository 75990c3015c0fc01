"""Divergence of sources: how far each source's words are from the other sources of its language, and which words do it.

1. Words are counted by (lang, source, term) inside the tasks first, then over all; a language keeps the terms that occur in
   at least MIN_DOCS of its documents, each with its sparse vector of (source, count).
2. Terms of a language with the same vector are one column with a multiplicity.
3. A term's difference between two sources is split by which of them have it. With f0 for two zero counts,
   sum over terms = f0 * V + sum over terms in g of (f(g,0) - f0) + sum over terms in h of (f(0,h) - f0)
   + sum over terms in both of (f(g,h) - f(g,0) - f(0,h) + f0). The last sum takes each pair of a column's sources once per
   column, times its multiplicity; the two before it take each (source, count) once, times the terms that have it.
4. A group's top terms lie in its ten columns of highest difference (ties: smallest first term); only those are ranked
   term by term.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved

MIN_DOCS, TOP = 10, 10
#: Distinct (lang, source, term) that a task holds before it hands its counts on.
HELD = 400_000
#: What is no letter and below 0x80 becomes a blank, A-Z become a-z.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed inside a task only. Null lang, source and text are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurs, has) in held.items():
                n = len(occurs)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(occurs), pa.binary()).cast(pa.string())]
                sums = [pa.array(x, pa.int64()) for x in (list(occurs.values()), [has[t] for t in occurs])]
                yield pa.RecordBatch.from_arrays([*columns, *sums], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = text.encode().translate(_CLEAN).split()
                occurs, has = held.setdefault((lang, source), (Counter(), Counter()))
                occurs.update(terms)
                has.update(set(terms))
            if sum(len(o) for o, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    whole = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return whole.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, vector, total): the terms in min_docs documents of a language at least, with their (source, n) by source."""
    sums = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "vector", "total")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)), in two steps that stay in longs up to 9 * 10**13 words."""
    a, m = f"(({count} + 2) * 100000)", f"({total} + 2 * {terms})"
    return F.expr(f"if({m} = 0, 0L, 1 + ({a} div {m}) * 10000 + ({a} % {m} * 10000) div {m})")


def difference(p: str, q: str) -> str:
    """floor((p-q)**2 / (p+q)); shares are under 2 * 10**9, so that squares stay in longs."""
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) that docs has, even without terms.

    Part `pair`: item is each other source of the language, value the sum over the kept terms of the difference between
    both shares; all ranks. Part `term`: item is a kept term that the group has and that has a larger share there than in
    the language, value the difference of these; ranks up to top. Ranks go by value descending, then item by its bytes.
    A language without kept terms has pairs of value 0 and no terms. Every row is a document, repeated ones too; null text,
    lang and source count as ''. An empty table gives no rows; other columns are not read.
    """
    kept = saved(kept_terms(docs, min_docs))
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_total"))
    cell = kept.select("lang", F.explode("vector").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("source_total"), F.count(F.lit(1)).alias("has"))
    groups = seen.join(of_lang, "lang", "left").join(cell, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "source_total", "has"])
    groups = saved(groups.withColumn("p0", share("0", "source_total", "v")))

    columns = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m"), F.min("term").alias("first"), F.first("total").alias("total"))
    columns = saved(columns.withColumn("column", F.monotonically_increasing_id()))
    entries = columns.select("lang", "column", "m", "first", "total", F.explode("vector").alias("c")).select("lang", "column", "m", "first", "total", "c.source", "c.n").join(groups, ["lang", "source"])
    entries = saved(entries.withColumn("p", share("n", "source_total", "v")).select("lang", "column", "m", "first", "source", "p", "p0", "n", share("total", "lang_total", "v").alias("q")))

    # Terms that both sources have.
    lists = entries.groupBy("lang", "column", "m").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("x"))
    both = lists.select("lang", "m", "x", F.posexplode("x").alias("at", "a")).select("lang", "m", "a", F.explode(F.expr("slice(x, at + 2, size(x))")).alias("b"))
    more = " ".join((difference("a.p", "b.p"), "-", difference("a.p", "b.p0"), "-", difference("a.p0", "b.p"), "+", difference("a.p0", "b.p0")))
    both = both.groupBy("lang", F.col("a.source").alias("g"), F.col("b.source").alias("h")).agg(F.sum(F.expr(f"m * ({more})")).alias("x"))
    # Terms that one source has, against each other source of the language as if it had none.
    pairs = groups.select("lang", F.col("source").alias("g"), "v", F.col("p0").alias("g0")).join(groups.select("lang", F.col("source").alias("h"), F.col("p0").alias("h0")), "lang").where("g <> h")
    counts = entries.groupBy("lang", F.col("source").alias("g"), "p").agg(F.sum("m").alias("m"))
    alone = pairs.join(counts, ["lang", "g"]).groupBy("lang", "g", "h").agg(F.sum(F.expr(f"m * ({difference('p', 'h0')} - {difference('g0', 'h0')})")).alias("x"))
    base = pairs.select("lang", "g", "h", F.expr(f"if(v = 0, 0L, v * {difference('g0', 'h0')})").alias("x"))
    turned = lambda t: t.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "x")
    sums = base.unionByName(both).unionByName(turned(both)).unionByName(alone).unionByName(turned(alone)).groupBy("lang", "g", "h").agg(F.sum("x").alias("value"))
    by_value = lambda *by: Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    of_pairs = sums.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value").withColumn("rank", F.row_number().over(by_value("lang", "source")))

    # Top terms, from the top columns.
    scored = entries.where("p > q").select("lang", "source", "column", F.col("first").alias("item"), F.expr(difference("p", "q")).alias("value"))
    chosen = scored.withColumn("r", F.row_number().over(by_value("lang", "source"))).where(F.col("r") <= top).select("lang", "source", "column", "value")
    wanted = columns.select("column", "vector").join(chosen, "column")
    terms = kept.join(wanted, ["lang", "vector"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    of_terms = terms.withColumn("rank", F.row_number().over(by_value("lang", "source"))).where(F.col("rank") <= top)
    return of_pairs.unionByName(of_terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
