"""Relations out of texts: rule matches with their places, mentions resolved to entities, confidences, edges and their inverses.

Rules are lines of a small table, so that they can be chosen by predicate or category and own ones added. Texts are matched
where they lie; resolving joins the distinct mentions, not the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import edit_similarity, normalised
from lodestone.operators.graph import INVERSES
from lodestone.session import materialised

NAME = r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"


@dataclass(frozen=True)
class Rule:
    predicate: str
    pattern: str
    """Its groups subject and object are numbers of the pattern's groups; details name other groups."""
    confidence: float
    category: str = "general"
    subject: int = 1
    object: int = 2
    details: tuple[tuple[str, int], ...] = ()
    needs: tuple[str, ...] = ()
    """Words without which a text has no match."""


#: Relations by what is said between and after two names, with their confidence. S and O are the names,
#: PLACE a third one, TEACHING some words, YEARS a duration, YEAR a date; all else is a regular expression.
RELATIONS = {
    "teaching": r"""
        teacher_of .90 S taught O
        teacher_of .88 S instructed O
        teacher_of .87 S trained O
        teacher_of .92 S transmitted (?:the )?(?:teachings?|lineage) to O
        teacher_of .85 S gave (?:teachings?|instructions?) to O
        student_of .90 S studied under O
        student_of .92 S was a (?:student|disciple|pupil) of O
        student_of .82 S learned from O
        student_of .88 S received (?:teachings?|instructions?|training) from O
        student_of .85 S trained (?:with|under) O
        student_of .93 S studied (?:with|under) O for YEARS
        student_of .91 S spent YEARS (?:studying )?(?:with|under) O
        student_of .90 S's (?:principal )?(?:teacher|master|guru|lama) was O
        teacher_of .88 S's (?:main )?(?:students?|disciples?) (?:included|were) O
        teacher_of .93 S ordained O
        student_of .93 S (?:was ordained by|received ordination from) O
        teacher_of .92 S taught O the TEACHING(?=[.,;])
        student_of .91 S received the TEACHING (?:teachings?|transmission) from O
        student_of .92 S studied (?:with|under) O at PLACE
        teacher_of .90 S taught O at PLACE
        student_of .85 S (?:was )?(?:mentored|guided) by O
        teacher_of .85 S (?:mentored|guided) O
        student_of .87 S (?:was an? )?apprentice (?:of|to) O
        student_of .80 S served (?:as (?:a )?(?:student|attendant) to )?O
        student_of .88 S received (?:an? )?empowerments? from O
        teacher_of .88 S gave (?:an? )?empowerments? to O""",
    "authorship": r"""
        wrote .90 S wrote (?:the )?O(?=[.,;]| in | at | during )
        wrote .91 S composed (?:the )?O(?=[.,;]| in | at | during )
        wrote .92 S authored (?:the )?O(?=[.,;]| in | at | during )
        wrote .88 S penned (?:the )?O(?=[.,;]| in | at | during )
        wrote .92 O was (?:written|composed|authored) by S
        wrote .80 O is attributed to S
        wrote .93 S (?:wrote|composed) (?:the )?O in YEAR
        wrote .92 S (?:wrote|composed) (?:the )?O at PLACE
        translated .91 S translated (?:the )?O(?=[.,;]| from )
        translated .93 S translated (?:the )?O from (?:Sanskrit|Chinese|Pali)
        translated .92 O was translated by S
        translated .91 S rendered (?:the )?O into Tibetan
        wrote .93 S,? (?:the )?author of (?:the )?O,
        wrote .88 S's (?:famous |renowned )?(?:work|text|treatise|commentary) O
        compiled .89 S compiled (?:the )?O
        compiled .89 O was compiled by S
        wrote .90 S (?:revealed|discovered) (?:the )?O terma
        wrote .87 S (?:wrote|composed) a commentary on (?:the )?O
        wrote .82 S produced (?:the )?O
        wrote .83 S created (?:the )?O
        wrote .88 S and PLACE (?:co-)?(?:wrote|authored|composed) (?:the )?O
        wrote .90 O,? a work (?:by|of) S""",
    "places": r"""
        lived_at .90 S lived at O
        lived_at .90 S resided (?:at|in) O
        lived_at .85 S stayed at O
        lived_at .88 S (?:dwelt|dwelled) (?:at|in) O
        lived_at .92 S (?:lived|resided|stayed) at O for YEARS
        lived_at .91 S spent YEARS at O
        abbot_of .93 S was (?:the )?abbot of O
        abbot_of .92 S served as abbot of O
        founded .93 S founded O
        founded .92 S established O
        founded .88 S built O
        founded .93 S was founded by O
        founded .95 S founded O in YEAR
        visited .87 S visited O
        visited .85 S traveled to O
        visited .90 S made (?:a )?pilgrimage to O
        visited .82 S went (?:on pilgrimage )?to O
        born_in .94 S was born (?:in|at) O
        died_in .94 S died (?:in|at) O
        lived_at .89 S (?:was )?(?:in )?retreat at O
        lived_at .86 S (?:meditated|practiced) at O""",
    "texts": r"""
        commentary_on .93 S is a commentary on (?:the )?O
        commentary_on .92 S,? a commentary on (?:the )?O
        commentary_on .88 S (?:explains|elucidates|expounds) (?:the )?O
        commentary_on .89 S comments on (?:the )?O
        cites .90 S cites (?:the )?O
        cites .90 S quotes (?:the )?O
        cites .88 S references (?:the )?O
        cites .82 S mentions (?:the )?O
        part_of .92 S is part of (?:the )?O
        part_of .90 S (?:appears|is included) in (?:the )?O
        part_of .91 S belongs to (?:the )?O collection
        contains .90 S contains (?:the )?O
        contains .89 S includes (?:the )?O
        cites .86 S (?:is )?based on (?:the )?O
        cites .84 S draws (?:on|from) (?:the )?O
        refuted .88 S refutes (?:the )?O""",
    "events": r"""
        attended .90 S attended (?:the )?O
        attended .88 S participated in (?:the )?O
        attended .87 S was present at (?:the )?O
        attended .86 S took part in (?:the )?O
        organized .91 S organized (?:the )?O
        organized .90 S convened (?:the )?O
        sponsored .89 S sponsored (?:the )?O
        sponsored .89 S was sponsored by O
        attended .92 S (?:gave|delivered) (?:teachings?|a teaching) at (?:the )?O
        attended .90 S taught at (?:the )?O
        organized .88 S hosted (?:the )?O
        attended .87 S performed (?:the )?O (?:ceremony|ritual)
        attended .90 S presided over (?:the )?O
        attended .91 S received (?:the )?O (?:empowerment|initiation)
        attended .83 S witnessed (?:the )?O""",
    "transmission": r"""
        received_transmission .93 S received (?:the )?TEACHING (?:transmission|lineage) from O
        received_transmission .90 S obtained (?:the )?TEACHING (?:teachings?|lineage) from O
        transmitted_to .93 S transmitted (?:the )?TEACHING to O
        transmitted_to .88 S passed (?:on )?(?:the )?TEACHING to O
        gave_empowerment .92 S gave (?:the )?TEACHING empowerment to O
        gave_empowerment .91 S bestowed (?:the )?TEACHING (?:empowerment|initiation) (?:upon|on) O
        gave_empowerment .92 S received (?:the )?TEACHING empowerment from O
        incarnation_of .93 S (?:is|was) (?:the )?(?:reincarnation|tulku) of O
        incarnation_of .91 S (?:is|was) recognized as (?:the )?(?:rebirth|incarnation) of O
        incarnation_of .88 S,? the (?P<object>\d+)(?:st|nd|rd|th) incarnation
        received_transmission .87 S (?:is|was) (?:a )?lineage holder of (?:the )?O
        student_of .90 S (?:was|is) (?:the )?(?:heart )?(?:son|disciple) of O""",
    "institutions": r"""
        member_of .89 S was a (?:monk|member|resident) (?:at|of) O
        member_of .85 S belonged to O
        member_of .87 S joined O
        patron_of .91 S was (?:a )?patron of O
        patron_of .89 S patronized O
        patron_of .82 S supported O
        patron_of .88 S was supported by O
        member_of .86 S served as (?:a )?(?:teacher|scholar|administrator) at O
        member_of .84 S was affiliated with O
        member_of .78 S was associated with O""",
    "family": r"""
        parent_of .94 S was the (?:father|mother|parent) of O
        child_of .94 S was the (?:son|daughter|child) of O
        parent_of .92 S's (?:son|daughter|child) O
        sibling_of .92 S (?:and|&) O were (?:brothers|sisters|siblings)
        sibling_of .93 S was the (?:brother|sister) of O
        spouse_of .91 S (?:married|wed) O
        spouse_of .93 S was (?:the )?(?:wife|husband|spouse) of O
        child_of .88 S was the (?:nephew|niece) of O""",
    "further": r"""
        teacher_of .85 O was (?:taught|instructed|initiated) by S
        founded .90 O was (?:established|built) by S
        lived_at .80 S (?:lived|stayed) in O
        successor_of .85 S (?:succeeded|was the successor of) O
        debated_with .80 S debated (?:with )?O""",
}
_SLOTS = {"S": ("subject", NAME[1:-1]), "O": ("object", NAME[1:-1]), "PLACE": ("place", NAME[1:-1]), "TEACHING": ("teaching", r"[A-Za-z]+(?: [A-Za-z]+)*?"), "YEARS": ("duration", r"\d+ years?"), "YEAR": ("date", r"\d{3,4}")}


def said(category: str, line: str) -> Rule:
    """The rule of a line of RELATIONS."""
    predicate, confidence, form = line.split(maxsplit=2)
    pattern = re.sub(r"\b(?:S|O|PLACE|TEACHING|YEARS|YEAR)\b", lambda m: f"(?P<{_SLOTS[m[0]][0]}>{_SLOTS[m[0]][1]})", form)
    groups = re.compile(pattern).groupindex
    fixed, depth = "", 0
    for c in re.sub(r"\(\?[=P].*", " ", form) if "(?=" in form or "(?P" in form else form:  # what stands outside of all brackets
        depth += (c == "(") - (c == ")")
        fixed += c if not depth and c != ")" else " "
    needs = tuple(w for w in re.findall(r"[a-z]+(?![a-z?])", re.sub(r"'s|\b[A-Z]+\b|[A-Z]\w+", " ", fixed)) if len(w) > 1)
    details = tuple((n, g) for n, g in groups.items() if n not in ("subject", "object"))
    return Rule(predicate, pattern, float(confidence), category, groups["subject"], groups["object"], details, needs)


RULES: tuple[Rule, ...] = tuple(said(c, line) for c, lines in RELATIONS.items() for line in lines.strip().split("\n"))


def chosen(rules: tuple[Rule, ...] = RULES, predicates: list[str] | None = None, categories: list[str] | None = None) -> tuple[Rule, ...]:
    return tuple(r for r in rules if (predicates is None or r.predicate in predicates) and (categories is None or r.category in categories))


def matches(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, predicate, subject, object, confidence, quote, position, stop, category, details) of docs (doc_id, text): every match
    of every rule; case counts. A rule's matches do not overlap; those of different rules may.

    position is the quote's own place, from 1, stop that of its last character; details is a map of what else the rule names
    (duration, date, place, teaching). A text is read once for its words, then by the rules alone whose words it has. A document's
    matches are in the order of position, then rule. Null and empty texts have none; every row of docs counts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern), frozenset(r.needs)) for r in rules]
        for b in batches:
            row, found = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = set(re.findall(r"[a-z]+", text)) if text else set()
                own = []
                for k, (rule, pattern, needs) in enumerate(compiled):
                    if text and needs <= words:
                        own += [(m.start(), k, rule, m) for m in pattern.finditer(text)]
                for at, _, rule, m in sorted(own, key=lambda x: x[:2]):
                    row.append(i)
                    found.append((rule.predicate, m[rule.subject], m[rule.object], rule.confidence, m[0], at + 1, m.end(), rule.category, [(n, m[g]) for n, g in rule.details if m[g] is not None]))
            types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
            columns = zip(*found, strict=True) if found else [[]] * len(types)
            names = ["predicate", "subject", "object", "confidence", "quote", "position", "stop", "category", "details"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    schema = f"doc_id {kind}, predicate string, subject string, object string, confidence double, quote string, position int, stop int, category string, details map<string, string>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _most_edits(length: Column) -> Column:
    """Edits that a name of this length can be away from one that is over .8 like it: fewer than a fifth of the longer length."""
    return F.greatest(F.ceil(length / 4) - 1, F.lit(0)).cast("int")


def _segments(norm: Column) -> Column:
    """(length, i, piece): a name cut into one part more than the edits it can be away; one part at least is then unchanged."""
    n = F.char_length(norm)
    s = _most_edits(n) + 1
    cut = lambda i: F.floor(i * n / s).cast("int")
    return F.transform(F.sequence(F.lit(0), s - 1), lambda i: F.struct(n.alias("length"), i.alias("i"), F.substring(norm, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))


def _probes(norm: Column) -> Column:
    """(length, i, piece): what stands in a mention where the parts of names of each possible length can stand."""
    n = F.char_length(norm)

    def of_length(length: Column) -> Column:
        k = _most_edits(length)
        cut = lambda i: F.floor(i * length / (k + 1)).cast("int")
        places = lambda i: F.filter(F.sequence(cut(i) - k, cut(i) + k), lambda at: (at >= 0) & (at + cut(i + 1) - cut(i) <= n))
        return F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.transform(places(i), lambda at: F.struct(length.alias("length"), i.alias("i"), F.substring(norm, at + 1, cut(i + 1) - cut(i)).alias("piece")))))

    away = _most_edits(n)
    lengths = F.sequence(F.greatest(n - away, F.lit(1)), n + away)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def resolved_mentions(mentions: DataFrame, entities: DataFrame, over: float = 0.8) -> DataFrame:
    """(mention, id, how, score): the entity of each distinct mention; mentions that no entity fits are left out.

    entities (id, name, confidence). An equal name counts first, then an equal normalised name, else the likeliest by edits, more
    than over (.8 or more). Names that are so alike share a part, in about the same place, of one of them cut into one part more
    than they can have edits; they are looked for by these parts, which loses none. Of equals the more confident, then the smaller id.
    """
    if over < 0.8:
        raise ValueError("names less alike than .8 would be missed")
    own = mentions.where("mention is not null").select("mention").distinct().withColumn("norm", normalised(F.col("mention")))
    known = entities.where("name is not null").select("id", "name", "confidence", normalised(F.col("name")).alias("norm"))
    best = lambda df: df.groupBy("mention").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), -F.col("confidence"), "id")).alias("b"))
    pick = lambda df, how: best(df).select("mention", "b.id", F.lit(how).alias("how"), F.round("b.score", 6).alias("score"))
    exact = pick(own.join(known.withColumnRenamed("name", "mention").drop("norm"), "mention").withColumn("score", F.lit(1.0)), "exact")
    rest = own.join(exact, "mention", "left_anti")
    variant = pick(rest.where("norm <> ''").join(known, "norm").withColumn("score", F.lit(1.0)), "variant")
    rest = rest.join(variant, "mention", "left_anti").where("norm <> ''")
    names = known.where("norm <> ''").groupBy("norm").agg(F.min_by(F.struct("id", "confidence"), F.struct(-F.col("confidence"), "id")).alias("e"))
    posted = names.select(F.col("norm").alias("other"), "e", F.explode(_segments(F.col("norm"))).alias("s"))
    asked = rest.select("mention", "norm", F.explode(_probes(F.col("norm"))).alias("s"))
    close = asked.join(posted, "s").select("mention", "norm", "other", "e").distinct()
    scored = close.select("mention", "e.id", "e.confidence", edit_similarity(F.col("norm"), F.col("other")).alias("score")).where(F.col("score") > over)
    return exact.unionByName(variant).unionByName(pick(scored, "similar"))


def edges(found: DataFrame, entities: DataFrame, review_under: float = 0.6) -> DataFrame:
    """(doc_id, src, predicate, dst, confidence, needs_review, inverse) of matches whose ends are both known, and their inverses.

    Confidence is the rule's times the mean of both entities' confidences.
    """
    found = materialised(found)  # the rules are matched once, then both ends are looked up
    ends = found.select(F.explode(F.array("subject", "object")).alias("mention"))
    who = resolved_mentions(ends, entities).select("mention", "id").join(entities.select("id", F.col("confidence").alias("sure")), "id")
    side = lambda name, to: who.select(F.col("mention").alias(name), F.col("id").alias(to), F.col("sure").alias(f"sure_{to}"))
    both = found.join(side("subject", "src"), "subject").join(side("object", "dst"), "object").where("src <> dst")
    out = both.withColumn("confidence", F.round(F.col("confidence") * (F.col("sure_src") + F.col("sure_dst")) / 2, 6))
    known = F.create_map(*[F.lit(x) for pair in INVERSES.items() for x in pair])
    forth = out.select("doc_id", "src", "predicate", "dst", "confidence", F.lit(False).alias("inverse"))
    back = out.where(F.col("predicate").isin(list(INVERSES))).select("doc_id", F.col("dst").alias("src"), F.element_at(known, F.col("predicate")).alias("predicate"), F.col("src").alias("dst"), "confidence", F.lit(True).alias("inverse"))
    return forth.unionByName(back).withColumn("needs_review", F.col("confidence") < review_under)


def with_evidence(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (doc_id, quote, confidence, ...) with supported: whether the quote stands in the text; where not, confidence times .8.

    Claims without a document in docs are left out; so are those without a subject or an object.
    """
    at = claims.where("subject is not null and object is not null").join(docs.select("doc_id", "text"), "doc_id")
    holds = F.coalesce(F.contains(F.lower("text"), F.lower("quote")), F.lit(False))
    return at.withColumns({"supported": holds, "confidence": F.round(F.col("confidence") * F.when(holds, 1.0).otherwise(0.8), 6)}).drop("text")


#: What a text is asked for beside plain rules when it has many of these.
COMPLEX = (r"\b(?:who|which|whose|whom)\b", r"\b(?:although|however|because|while)\b", r";", r"\b(?:he|she|they)\b")


def complexity(docs: DataFrame) -> DataFrame:
    """(doc_id, score, route): signs of complex sentences for each 100 words; from 2 on texts go to a model, else rules will do."""
    t = F.lower(F.coalesce("text", F.lit("")))
    signs = sum((F.regexp_count(t, F.lit(p)) for p in COMPLEX), F.lit(0))
    score = F.round(100.0 * signs / F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1)), 6)
    return docs.select("doc_id", score.alias("score"), F.when(score >= 2, "model").otherwise("rules").alias("route"))
