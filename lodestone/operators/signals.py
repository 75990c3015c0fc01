"""What speaks for and against two entities being one: signals, their weighted sum, and what to say about it.

Pairs are rows with the two entities as structs a and b; candidate pairs come from blocks (see resolution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import best_of_variants, mean_known, set_overlap, similarity_class, year_similarity
from lodestone.session import materialised

#: Weights of the signals; one that is exactly .5 says nothing and counts half.
WEIGHTS = {"name": 0.5, "date": 0.2, "location": 0.15, "relationship": 0.1, "attribute": 0.05}
SAID = {"very_high": "Very likely the same entity", "high": "Likely the same entity", "medium": "Possibly the same entity", "low": "Probably different entities"}
ADVICE = {"very_high": "auto_merge", "high": "review", "medium": "manual_check", "low": "ignore"}


def _both(field: str) -> tuple[Column, Column]:
    return F.col(f"a.{field}"), F.col(f"b.{field}")


def _same(field: str) -> Column:
    a, b = _both(field)
    return F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("double"))


def date_signal() -> Column:
    """Mean over births and deaths known on both sides; .5 without any."""
    known = lambda f: F.when(F.col(f"a.{f}").isNotNull() & F.col(f"b.{f}").isNotNull(), year_similarity(*_both(f)))
    return mean_known(known("birth"), known("death"))


def location_signal() -> Column:
    """Persons: shared affiliations of all. Places: .8 for one region, .6 for one country. Else, and where nothing is known, .5."""
    kind = F.when(F.col("a.type") == F.col("b.type"), F.col("a.type"))
    places = F.when(_same("region") == 1, 0.8).when(_same("country") == 1, 0.6).otherwise(0.5)
    return F.when(kind == "person", F.coalesce(set_overlap(*_both("affiliations")), F.lit(0.5))).when(kind == "place", places).otherwise(0.5)


def attribute_signal() -> Column:
    """Persons: mean of gender, traditions and roles as far as known. Places: of kind and region. Else .5."""
    kind = F.when(F.col("a.type") == F.col("b.type"), F.col("a.type"))
    return F.when(kind == "person", mean_known(_same("gender"), set_overlap(*_both("traditions")), set_overlap(*_both("roles")))).when(kind == "place", mean_known(_same("place_type"), _same("region"))).otherwise(0.5)


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with signals, probability, class, advice, reason and warnings.

    a and b have id, type, names (array), birth, death, affiliations, traditions, roles (arrays), gender, region, country,
    place_type and verified; any may be null. Names that are null or empty on one side count as unlike.
    """
    signals = {"name": F.coalesce(best_of_variants(*_both("names")), F.lit(0.0)), "date": date_signal(), "location": location_signal(), "relationship": F.lit(0.5), "attribute": attribute_signal()}
    out = pairs.withColumn("signals", F.struct(*[F.round(c, 9).alias(k) for k, c in signals.items()]))
    s = lambda k: F.col(f"signals.{k}")
    weight = {k: F.when(s(k) == 0.5, w / 2).otherwise(w) for k, w in WEIGHTS.items()}
    overall = sum((s(k) * w for k, w in weight.items()), F.lit(0.0)) / sum(weight.values(), F.lit(0.0))
    overall = F.when((s("name") > 0.98) & (overall < 0.9) & (s("date") > 0) & (s("location") > 0), 0.92).otherwise(overall)
    out = out.withColumn("probability", F.round(overall, 6))
    level = F.when(similarity_class(F.col("probability")).isin("low", "none"), "low").otherwise(similarity_class(F.col("probability")))
    out = out.withColumn("class", level)
    told = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("class"))
    person = F.col("a.type") == "person"
    parts = [
        F.when(s("name") >= 0.95, "very similar names").when(s("name") >= 0.85, "similar names").when(s("name") >= 0.7, "moderately similar names"), F.when(s("date") >= 0.85, "matching time periods").when(s("date") < 0.3, "different time periods"),
        F.when(s("location") >= 0.7, "shared locations"), F.when(s("attribute") >= 0.7, "similar attributes"),
    ]
    reason = F.array_join(F.array_compact(F.array(*parts)), ", ")
    warnings = {
        "different_periods": (s("name") > 0.85) & (s("date") < 0.3) & person, "different_places": (s("name") > 0.85) & (s("location") < 0.3), "no_dates": (s("date") == 0.5) & person, "no_places": s("location") == 0.5,
        "unverified": (s("name") > 0.95) & ~F.coalesce("a.verified", F.lit(False)) & ~F.coalesce("b.verified", F.lit(False)),
    }
    return out.withColumns({
        "advice": told(ADVICE), "reason": F.concat(told(SAID), F.lit(" ("), F.when(reason == "", "based on available data").otherwise(reason), F.lit(")")),
        "warnings": F.array_compact(F.array(*[F.when(c, k) for k, c in warnings.items()])),
    })


#: How bad a conflict in a field is.
SEVERITIES = {"birth": "high", "death": "high", "type": "high", "gender": "medium", "traditions": "low", "region": "medium"}


def conflicts(pairs: DataFrame) -> DataFrame:
    """(id1, id2, field, severity, value1, value2, advice): fields known on both sides that differ."""
    found = [F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.struct(F.lit(f).alias("field"), F.lit(v).alias("severity"), F.col(f"a.{f}").cast("string").alias("value1"), F.col(f"b.{f}").cast("string").alias("value2"))) for f, v in SEVERITIES.items() if f != "traditions"]
    out = pairs.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.array_compact(F.array(*found)).alias("c"))
    advice = F.when(F.col("c.severity") == "high", "check_sources").when(F.col("c.severity") == "medium", "keep_more_confident").otherwise("keep_both")
    return out.select("id1", "id2", F.explode("c").alias("c")).select("id1", "id2", "c.*", advice.alias("advice"))


def last_primaries(merges: DataFrame) -> DataFrame:
    """(duplicate, primary) with the primary that a chain of merges (primary, duplicate) ends in, by doubled steps.

    Of several primaries of one duplicate the smallest counts; merges into itself and null ids do not. Where merges go round in a
    circle, the smallest of the circle stays.
    """
    step = merges.where("primary <> duplicate").groupBy("duplicate").agg(F.min("primary").alias("primary"))
    step = materialised(step.select("duplicate", "primary", F.least("duplicate", "primary").alias("low")))
    left, rounds = step.count(), 0
    while (1 << rounds) <= left:  # as many doublings as the longest chain, or circle, can need
        on = step.select(F.col("duplicate").alias("primary"), F.col("primary").alias("next"), F.col("low").alias("more"))
        step = materialised(step.join(on, "primary", "left").select("duplicate", F.coalesce("next", "primary").alias("primary"), F.least("low", "more").alias("low"), F.col("next").isNotNull().alias("on")))
        rounds += 1
        if step.where("on").isEmpty():
            break
    # What still leads on is in a circle or leads into one; from inside the least of the way is that of the circle.
    inside = step.select(F.col("primary").alias("duplicate")).join(step, "duplicate", "left_semi").distinct()
    circle = step.join(inside, "duplicate", "left_semi").select(F.col("duplicate").alias("primary"), F.col("low").alias("least"))
    return step.join(circle, "primary", "left").select("duplicate", F.coalesce("least", "primary").alias("primary")).where("primary <> duplicate")


def merge_applied(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, history, edge_history) after the merges (primary, duplicate) of known nodes, chains of merges to their ends.

    Duplicates stay as rows of merge_status merged; their edges move to the last primary. Of edges (id, src, predicate, dst,
    confidence) that then say the same, one that was there before stays, else the most confident, then the smallest id; edges that then
    join a node with itself go. history has each duplicate's status before; edge_history has each edge that moved or went: as it was,
    where it went, and whether it stayed.
    """
    known = merges.join(nodes.select(F.col("id").alias("primary")), "primary", "left_semi").join(nodes.select(F.col("id").alias("duplicate")), "duplicate", "left_semi")
    gone = materialised(last_primaries(known).select(F.col("duplicate").alias("id"), "primary"))
    history = nodes.join(gone, "id").select(F.col("id").alias("duplicate"), "primary", F.col("merge_status").alias("before"))
    after = nodes.join(gone.withColumn("_gone", F.lit(True)).drop("primary"), "id", "left").withColumn("merge_status", F.when(F.col("_gone"), "merged").otherwise(F.col("merge_status"))).select(*nodes.columns)
    to = lambda c: gone.select(F.col("id").alias(c), F.col("primary").alias(f"new_{c}"))
    # An edge is carried once; what it was is put together again from its old ends. One pass over edges that say the same tells which stays.
    there = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left").withColumn("_own", F.col("new_src").isNull() & F.col("new_dst").isNull())
    placed = there.withColumns({"new_src": F.coalesce("new_src", "src"), "new_dst": F.coalesce("new_dst", "dst")})
    first = F.row_number().over(Window.partitionBy("new_src", "predicate", "new_dst").orderBy(F.desc("_own"), -F.col("confidence"), "id")) == 1
    moved = materialised(placed.withColumn("stayed", first & F.coalesce((F.col("new_src") != F.col("new_dst")) | F.col("_own"), F.lit(False))))
    now = {"src": F.col("new_src").alias("src"), "dst": F.col("new_dst").alias("dst")}
    stays = moved.where("stayed").select(*[now.get(c, F.col(c)) for c in edges.columns])
    return after, stays, history, moved.where("not _own or not stayed").select("id", F.struct(*edges.columns).alias("before"), "new_src", "new_dst", "stayed")


def merge_undone(nodes: DataFrame, edges: DataFrame, history: DataFrame, edge_history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the duplicates and edges of a merge's histories as they were before it.

    An edge that stayed is put back where it still is as the merge left it; one that a later merge moved or took away is left to that
    merge's own undoing. An edge that went is there again. To undo several merges, the last one goes first.
    """
    back = history.select(F.col("duplicate").alias("id"), F.col("before"))
    restored = nodes.join(back.withColumn("_back", F.lit(True)), "id", "left").withColumn("merge_status", F.when(F.col("_back"), F.col("before")).otherwise(F.col("merge_status"))).select(*nodes.columns)
    both = edges.withColumn("_there", F.lit(True)).join(edge_history.select("id", "before", "new_src", "new_dst", "stayed"), "id", "full_outer")
    same = F.col("stayed") & (F.col("src") == F.col("new_src")) & (F.col("dst") == F.col("new_dst"))
    old = F.coalesce(same, F.lit(False)) | F.col("_there").isNull()
    return restored, both.where("_there or not stayed").select(*[F.when(old, F.col(f"before.{c}")).otherwise(F.col(c)).alias(c) for c in edges.columns])
