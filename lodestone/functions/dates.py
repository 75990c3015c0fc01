"""Years out of texts and of the sixty-year calendar, as column expressions; dates relative to a person need a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements and animals of the sixty-year cycle, the cycle's first year.
ELEMENTS = ("fire", "earth", "iron", "water", "wood")
ANIMALS = ("rabbit", "dragon", "snake", "horse", "sheep", "monkey", "bird", "dog", "pig", "mouse", "ox", "tiger")
FIRST_CYCLE = 1027
#: Share of a century that its early, middle and late years stand for.
PARTS = {"early": 20, "mid": 50, "late": 80}
#: Eras by their names, with first and last year and how sure these are.
ERAS = [
    (("Tibetan Empire", "Imperial Period", "Early Period"), 618, 842, 0.9), (("Reign of Songsten Gampo", "Songtsen Gampo", "Srong-btsan sgam-po"), 617, 650, 0.85), (("Reign of Trisong Detsen", "Khri-srong lde-btsan", "Tri Songdetsen"), 755, 797, 0.9),
    (("Era of Fragmentation", "Dark Age", "Period of Fragmentation"), 842, 978, 0.8), (("Later Diffusion of Buddhism", "Phyi dar", "Second Diffusion"), 978, 1204, 0.85), (("Early Kadam Period", "Kadam Founding"), 1042, 1150, 0.9),
    (("Sakya Period", "Sakya Dominance", "Sa-skya Period"), 1268, 1354, 0.9), (("Phagmodrupa Dynasty", "Phag-mo-gru", "Phagdru"), 1354, 1435, 0.85), (("Rinpung Period", "Rin-spungs"), 1435, 1565, 0.8), (("Tsangpa Dynasty", "gTsang Dynasty"), 1565, 1642, 0.85),
    (("Ganden Phodrang", "dGa'-ldan pho-brang", "Dalai Lama Government"), 1642, 1959, 0.95), (("Reign of Fifth Dalai Lama", "Great Fifth"), 1642, 1682, 0.95), (("Rimé Movement", "Ris-med", "Non-sectarian Movement"), 1850, 1950, 0.9),
]


def cycle_year(cycle: Column, year: Column) -> Column:
    return FIRST_CYCLE + (cycle - 1) * 60 + (year - 1)


def year_to_cycle(year: Column) -> Column:
    """Struct of the cycle's number and the year in it; null before the first cycle."""
    past = year - FIRST_CYCLE
    return F.when(past >= 0, F.struct((F.floor(past / 60) + 1).alias("cycle"), (past % 60 + 1).alias("year")))


def element_animal(year_in_cycle: Column) -> Column:
    i = (year_in_cycle - 1).cast("int")
    sign = F.concat_ws("-", F.element_at(F.array(*map(F.lit, ELEMENTS)), F.floor(i / 4).cast("int") % 5 + 1), F.element_at(F.array(*map(F.lit, ANIMALS)), i % 12 + 1))
    return F.when(year_in_cycle.isNotNull(), sign)


def age(birth: Column, year: Column) -> Column:
    """Years from birth to a year; null where a year is unknown or before birth."""
    return F.when(year >= birth, year - birth)


def _signs() -> dict[str, int]:
    """The first year in a cycle of each element and animal."""
    out: dict[str, int] = {}
    for i in range(60):
        out.setdefault(f"{ELEMENTS[i // 4 % 5]} {ANIMALS[i % 12]}", i + 1)
    return out


def sign_year(text: Column, near: Column | None = None) -> Column:
    """Struct (year, confidence) of an element and animal in a text: the occurrence nearest to a year, else the last before 1500."""
    t = F.lower(F.coalesce(text, F.lit("")))
    sign = F.concat_ws(" ", F.regexp_extract(t, r"\b(" + "|".join(ELEMENTS) + r")\b", 1), F.regexp_extract(t, r"\b(" + "|".join(ANIMALS) + r")\b", 1))
    known = F.create_map(*[F.lit(x) for pair in _signs().items() for x in pair])
    base = FIRST_CYCLE - 1 + F.try_element_at(known, sign)
    last = base + F.floor((F.lit(1499) - base) / 60) * 60
    near = F.lit(None).cast("long") if near is None else near
    year = F.when(near.isNotNull(), base + F.floor((near - base) / 60.0 + 0.5) * 60).otherwise(last).cast("long")
    return F.when(base.isNotNull(), F.struct(year.alias("year"), F.when(near.isNotNull(), 0.8).otherwise(0.6).alias("confidence")))


def named_cycle_year(text: Column) -> Column:
    """Struct (year, confidence) of "Nth rabjung" in a text: the year of its element and animal in that cycle, else the cycle's middle;
    null for no cycle from 1 to 17."""
    t = F.lower(F.coalesce(text, F.lit("")))
    cycle = F.nullif(F.regexp_extract(t, r"(\d{1,2})(?:th|st|nd|rd)?\s+rabjung", 1), F.lit("")).cast("long")
    sign = F.concat_ws(" ", F.regexp_extract(t, r"\b(" + "|".join(ELEMENTS) + r")\b", 1), F.regexp_extract(t, r"\b(" + "|".join(ANIMALS) + r")\b", 1))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in _signs().items() for x in pair]), sign)
    first = cycle_year(cycle, F.lit(1))
    return F.when(cycle.between(1, 17), F.struct(F.coalesce(first + known - 1, first + 29).cast("long").alias("year"), F.when(known.isNotNull(), 0.9).otherwise(0.5).alias("confidence")))


def era_year(text: Column) -> Column:
    """Struct (year, confidence) of an era named in a text: its middle, or a fifth from its start (early, beginning) or end (late, end)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    early, late = t.contains("early") | t.contains("beginning"), t.contains("late") | t.contains("end")
    eras = F.array(*[F.struct(F.array(*[F.lit(n.lower()) for n in names]).alias("names"), F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(sure).alias("sure")) for names, first, last, sure in ERAS])
    named = F.filter(eras, lambda e: F.exists(e["names"], lambda n: F.contains(t, n)))

    def told(e: Column) -> Column:
        fifth = F.floor((e["last"] - e["first"]) / 5)
        year = F.when(early, e["first"] + fifth).when(late, e["last"] - fifth).otherwise(F.floor((e["first"] + e["last"]) / 2))
        return F.struct(year.cast("long").alias("year"), F.round(e["sure"] * F.when(early | late, 0.8).otherwise(0.7), 6).alias("confidence"))

    return F.get(F.transform(F.slice(named, 1, 1), told), F.lit(0))


def resolve_date(text: Column, near: Column | None = None) -> Column:
    """Struct (year, rule, confidence) of a date's text, else null. In order: a year from 600 to 2100, a year of a cycle (by number, or
    by element and animal, or its middle), an element and animal, an era, a season of a year, a part of a century."""
    t = F.lower(F.trim(text))
    direct = F.nullif(F.regexp_extract(t, r"^(?:c\. ?)?(\d{3,4})(?: ?(?:bce|bc|ce|ad))?$", 1), F.lit("")).cast("long")
    number = lambda pattern, g: F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).cast("long")
    cyc = r"^rabjung (\d+),? year (\d+)$"
    cycle = cycle_year(number(cyc, 1), number(cyc, 2))
    cen = r"(?:(early|mid|late)[ -]*)?\b(\d{1,2})(?:st|nd|rd|th)? +century"
    part = F.regexp_extract(t, cen, 1)
    shift = F.when(part == "early", PARTS["early"]).when(part == "late", PARTS["late"]).otherwise(PARTS["mid"])
    century = (number(cen, 2) - 1) * 100 + shift
    season = number(r"(spring|summer|fall|autumn|winter) +of +(\d{3,4})", 2)
    found = lambda y, rule, c: F.when(y.isNotNull(), F.struct(y.cast("long").alias("year"), F.lit(rule).alias("rule"), (F.lit(c) if isinstance(c, float) else c).alias("confidence")))
    sign, era, named = sign_year(t, near), era_year(t), named_cycle_year(t)
    return F.coalesce(
        found(F.when(direct.between(600, 2100), direct), "direct", 1.0), found(cycle, "cycle", 0.9), found(named["year"], "cycle", named["confidence"]), found(sign["year"], "element-animal", sign["confidence"]), found(era["year"], "era", era["confidence"]), found(season, "season", 0.95), found(century, "century", 0.6)
    )


def relative_dates(texts: DataFrame, persons: DataFrame) -> DataFrame:
    """texts (id, text) with rel (year, rule, confidence) of dates told by another's life; null where no person (name, birth, death) fits.

    After a death, before a birth, so many years after either. The person is found by the whole name, whatever its case; of
    several of one name the earliest born counts. "At age N" is told by the text's own person: at_age().
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rules = {
        "years_after": r"(?i)(\d+)\s+years?\s+after\s+(.+?)\s+(died|was born|birth)", "after_death": r"(?i)()after\s+(.+?)\s+(died|passed away|passed)", "before_birth": r"(?i)()before\s+(.+?)\s+(was born|birth)",
    }
    rule = None
    for name, pattern in rules.items():
        rule = F.when(t.rlike(pattern), name) if rule is None else rule.when(t.rlike(pattern), name)
    at = lambda g: F.coalesce(*[F.when(F.col("_rule") == n, F.regexp_extract(t, p, g)) for n, p in rules.items()])
    told = texts.withColumn("_rule", rule).withColumns({"_n": at(1).try_cast("long"), "_who": F.lower(F.trim(at(2))), "_what": F.lower(at(3))})
    first = persons.where("name is not null").groupBy(F.lower(F.trim("name")).alias("_who")).agg(F.min_by(F.struct("birth", "death"), F.struct(F.coalesce("birth", F.lit(9999)), "death")).alias("_p"))
    out = told.join(first, "_who", "left")
    birth, death = F.col("_p.birth"), F.col("_p.death")
    year = F.when(F.col("_rule") == "after_death", death + 1).when(F.col("_rule") == "before_birth", birth - 1).when(F.col("_rule") == "years_after", F.when(F.col("_what") == "died", death).otherwise(birth) + F.col("_n"))
    rel = F.when(year.isNotNull(), F.struct(year.cast("long").alias("year"), F.col("_rule").alias("rule"), F.when(F.col("_rule") == "years_after", 0.75).otherwise(0.7).alias("confidence")))
    return out.withColumn("rel", rel).select(*texts.columns, "rel")


def at_age(text: Column, birth: Column) -> Column:
    """The year of "at age N" for a person born in a year; null without either."""
    return birth + F.nullif(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"at age (\d+)", 1), F.lit("")).cast("long")
