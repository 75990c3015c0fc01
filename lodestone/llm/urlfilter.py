"""Allow or block by url: host and path rules, and gradient-boosted trees for urls without a rule.

All in DataFrame functions. The trees learn from labelled urls by lexical features: lengths, depth, digit share, entropy,
parameters and statistics of host suffixes and path heads (how often labelled urls with that suffix are blocked). The
labels are what rules say, so a suffix that a rule names would only repeat the rule, and stand for one verdict wherever no
rule fits: such suffixes have no statistics, neither in learning nor in judging. What is left to learn from are the other
suffixes, path heads and the url's own form.

A bounded sample of distinct labelled urls is put into a table; half of it gives the suffix statistics, the other half the
trees. Each level of a tree is one aggregation: sums of gradients and curvatures by node, feature and bin. The model is a
column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, saved, without

#: (verdict, host, path) of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
STATS = ("suffix1", "suffix2", "head")


@dataclass
class Fit:
    """sample_rows: distinct labelled urls learned from, at most about; drawn by a hash of the url, each counting once."""

    sample_rows: int = 16000
    trees: int = 12
    depth: int = 3
    rate: float = 0.4
    bins: int = 16
    smooth: float = 4.0
    leaf: float = 1.0


@dataclass
class Trees:
    prior: float = -10.0
    trees: list = field(default_factory=list)
    """Nested (feature, threshold, low side, high side), or a leaf's value."""


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or url."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _count(text: Column, what: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, what, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; of the empty text 0."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def lexical(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (url, host, path, ...) with the features x0, x1, ... and the keys of the statistics; null for a rule's own host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    features = [
        F.char_length(url), F.char_length(host), F.char_length(path), _count(path, "/"), _count(host, r"\."), _count(url, "[0-9]") / size, _count(host, "[0-9-]"),
        entropy(host), F.when(query == "", 0).otherwise(1 + _count(query, "&")), F.char_length(query), F.when(url.startswith("https"), 1).otherwise(0),
    ]
    named = sorted({h for _, h, _ in rules})
    hidden = lambda suffix: F.when(~suffix.isin(named), suffix)
    keys = {"suffix1": hidden(F.substring_index(host, ".", -1)), "suffix2": hidden(F.substring_index(host, ".", -2)), "head": F.element_at(F.split(F.concat(path, F.lit("/ ")), "/", 3), 2)}
    return urls.withColumns({f"x{i}": f.cast("double") for i, f in enumerate(features)} | keys)


N_LEXICAL = 11
N_FEATURES = N_LEXICAL + 2 * len(STATS)


def with_stats(featured: DataFrame, stats: DataFrame, prior: float) -> DataFrame:
    """The suffix statistics beside each row: blocked share and log of the number of labelled urls."""
    out = featured
    for i, kind in enumerate(STATS):
        own = stats.where(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("rate").alias(f"x{N_LEXICAL + 2 * i}"), F.col("seen").alias(f"x{N_LEXICAL + 2 * i + 1}"))
        out = out.join(F.broadcast(own), kind, "left")  # at most sample_rows rows
    return out.fillna(prior, [f"x{N_LEXICAL + 2 * i}" for i in range(len(STATS))]).fillna(0.0, [f"x{N_LEXICAL + 2 * i + 1}" for i in range(len(STATS))])


def suffix_stats(sample: DataFrame, prior: float, smooth: float) -> DataFrame:
    """(kind, key, rate, seen): blocked share, drawn to the prior, and log of the count by suffix."""
    keyed = sample.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in STATS])).alias("s")).where("s.key is not null")
    per = keyed.groupBy("s.kind", "s.key").agg(F.sum("y").alias("blocked"), F.count(F.lit(1)).alias("n"))
    return per.select("kind", "key", ((F.col("blocked") + smooth * prior) / (F.col("n") + smooth)).alias("rate"), F.log2(F.col("n") + 1.0).alias("seen"))


def margin(trees: Trees, x) -> Column:
    """The log odds of a block; x gives a feature's column."""

    def value(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        return F.when(x(node[0]) <= node[1], value(node[2])).otherwise(value(node[3]))

    return sum((value(t) for t in trees.trees), F.lit(trees.prior))


def boost(table: DataFrame, params: Fit) -> Trees:
    """Trees for table (y, x0, x1, ...), a small one; each level is one aggregation in one task."""
    one = table.coalesce(1)
    base = one.agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not base["n"] or not 0 < base["y"] < base["n"]:
        return Trees(10.0 if base["y"] else -10.0)
    names = [f"x{i}" for i in range(N_FEATURES)]
    grid = [k / params.bins for k in range(1, params.bins)]
    edges = one.agg(*[F.percentile_approx(c, grid, 10000).alias(c) for c in names]).first()
    edges = [sorted(set(edges[c])) for c in names]
    binned = saved(one.select("y", F.array(*[sum(((F.col(c) > e).cast("int") for e in edges[i]), F.lit(0)) for i, c in enumerate(names)]).alias("b"))).coalesce(1)
    bin_of = lambda i: F.col("b")[i]
    found = Trees(math.log(base["y"] / (base["n"] - base["y"])))
    shadow = Trees(found.prior)  # the same trees over bins
    for _ in range(params.trees):
        p = 1 / (1 + F.exp(-margin(shadow, bin_of)))
        rows = binned.select("b", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"))
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, tuple[float, float]] = {}
        for level in range(params.depth):
            got = rows.withColumn("node", _walk(splits, 1, bin_of)).where(f"node >= {1 << level}").select("node", "g", "h", F.posexplode("b").alias("f", "bin"))
            sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in got.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes * features * bins rows
                sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
            for node, by in sums.items():
                best = _best(by, params.leaf)
                if best:
                    splits[node] = best[:2]
                    leaves[2 * node], leaves[2 * node + 1] = best[2], best[3]
        if not splits:
            break
        weight = lambda node: params.rate * leaves[node][0] / (leaves[node][1] + params.leaf)
        tree = lambda node, at: (splits[node][0], at(*splits[node]), tree(2 * node, at), tree(2 * node + 1, at)) if node in splits else weight(node)
        shadow.trees.append(tree(1, lambda f, b: b))
        found.trees.append(tree(1, lambda f, b: edges[f][b]))
    return found


def _walk(splits: dict, node: int, bin_of) -> Column:
    if node not in splits:
        return F.lit(node)
    f, b = splits[node]
    return F.when(bin_of(f) <= b, _walk(splits, 2 * node, bin_of)).otherwise(_walk(splits, 2 * node + 1, bin_of))


def _best(by: dict[int, dict[int, tuple[float, float]]], leaf: float):
    """The split (feature, bin, sums of the low side, sums of the high side) that gains most; None if none gains."""
    score = lambda g, h: g * g / (h + leaf)
    best, most = None, 1e-3
    for f in sorted(by):
        bins = sorted(by[f])
        g, h = (math.fsum(by[f][b][k] for b in bins) for k in (0, 1))
        low_g = low_h = 0.0
        for b in bins[:-1]:
            low_g, low_h = low_g + by[f][b][0], low_h + by[f][b][1]
            gain = score(low_g, low_h) + score(g - low_g, h - low_h) - score(g, h)
            if min(low_h, h - low_h) >= 0.5 and gain > most + 1e-9:
                best, most = (f, b, (low_g, low_h), (g - low_g, h - low_h)), gain
    return best


def learn(labelled: DataFrame, params: Fit | None = None, rules=RULES) -> tuple[Trees, DataFrame, float]:
    """Trees, suffix statistics and the blocked share from labelled rows (url, host, path, y: 1 for block, else 0)."""
    params = params or Fit()
    n = labelled.count()
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "url"), F.lit(1_000_003)) < min(1.0, params.sample_rows / max(1, n)) * 1_000_003
    distinct = labelled.where(drawn).groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("y").alias("y"))
    sample = saved(lexical(distinct, rules))
    base = sample.agg(F.avg("y").alias("y")).first()["y"]
    prior = 0.5 if base is None else float(base)
    half = F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2))
    stats = saved(suffix_stats(sample.where(half == 0), prior, params.smooth).coalesce(1))
    return boost(saved(with_stats(sample.where(half == 1), stats, prior).select("y", *[f"x{i}" for i in range(N_FEATURES)]).coalesce(1)), params), stats, prior


def judged(pages: DataFrame, rules=RULES, params: Fit | None = None) -> DataFrame:
    """pages with _host, _path, _rule, _verdict, _p_block: rules decide first, then the trees, learned from what rules decide.

    Null and odd urls have an empty host and path, no rule and the trees' verdict. Without urls that rules decide, or where
    these all have one verdict, the trees give that verdict, or allow. Repeated rows are judged alike; columns of pages with
    the result's names give way.
    """
    pages = without(pages, "_host", "_path", "_rule", "_verdict", "_p_block")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    few = pages.select("url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("say", verdict)
    trees, stats, prior = learn(few.where("say is not null").select("url", "host", "path", (F.col("say") == "block").cast("int").alias("y")), params, rules)
    own = {c: f"_own_{i}" for i, c in enumerate(pages.columns)}
    renamed = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col("url"))
    parsed = renamed.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    featured = with_stats(lexical(parsed, rules), stats, prior)
    p = 1 / (1 + F.exp(-margin(trees, lambda i: F.col(f"x{i}"))))
    return featured.withColumns({"_rule": rule, "_p_block": p}).select(
        *[F.col(n).alias(c) for c, n in own.items()], F.col("host").alias("_host"), F.col("path").alias("_path"), "_rule", F.coalesce(verdict, F.when(F.col("_p_block") >= 0.5, "block").otherwise("allow")).alias("_verdict"), "_p_block"
    )


def url_report(pages: DataFrame, rules=RULES, params: Fit | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for each row of pages.

    A null url, or one without ://, has an empty host and path, no rule and the trees' verdict; every row counts, with a
    null or repeated id too.
    """
    out = judged(pages.select("page_id", "url"), rules, params)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"), F.round("_p_block", 6).alias("p_block"))
