"""URL filter: rules first, then gradient-boosted trees over lexical features, in DataFrame operations only.

A rule fits its host and all subdomains where the path starts as the rule's does; the longest wins.
URLs that a rule fits are the labelled ones: trees learn from a bounded number of them (``LEARN_ROWS``,
chosen by a hash of the URL), and judge the rest.  Features are lengths, depths, the share of digits, the
entropy of the host's characters, parameters, and statistics over all labelled URLs of two affixes, the host's
suffix and the path's first segment: block share and frequency of every value, in a table that Spark broadcasts if it is small.

Learning is histogram boosting: values become bins by the sample's quantiles, and equal rows of bins are counted.  These counts, at
most one for each sampled URL, come to the driver once; there, each level of a tree sums gradients by node, feature and bin, and the sums
choose the splits.  The statistics of both affixes are one aggregation.

Defined results: null URLs and URLs without ``://`` have empty host and path, no rule, and are judged like any other by
the trees (a null as the empty string); without labelled URLs all is allowed, with one label all gets it; repeated URLs are judged alike; ties between
splits go to the first feature and cut; URLs of any length are read whole; an empty table has no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common


class Rule(NamedTuple):
    host: str
    path: str
    blocks: bool


#: The rules of the query.
RULES = (Rule("com", "/", False), Rule("example.com", "/en/", True), Rule("www.example.com", "/en/", False), Rule("net", "/es/", True), Rule("net", "/fr/", True))
LEARN_ROWS, BINS = 20_000, 16
AFFIXES = ("suffix", "section")
TREES, DEPTH, RATE, SMOOTH = 8, 2, 0.6, 1.0
FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_share", "host_entropy", "parameters", "hyphens", "suffix_blocked", "suffix_share", "section_blocked", "section_share")


# -- parts and rules --------------------------------------------------------------------------


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and whether it blocks; null if none does."""
    name, blocks = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        blocks = F.when(fits, F.lit(rule.blocks)).otherwise(blocks)
    return name, blocks


# -- features ---------------------------------------------------------------------------------


def entropy(text: Column) -> Column:
    """Bits a character."""
    size = F.length(text)
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total + F.when(c == "", 0.0).otherwise((size - F.length(F.replace(text, c, F.lit("")))) / size * -F.log2((size - F.length(F.replace(text, c, F.lit("")))) / size)))


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, ...) with the features of the URL alone, and its affixes."""
    url = F.coalesce("url", F.lit(""))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_depth": F.regexp_count("host", F.lit(r"\.")).cast("double"),
            "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "digit_share": F.coalesce(F.try_divide(digits, F.length(url)), F.lit(0.0)),
            "host_entropy": F.when(F.col("host") == "", 0.0).otherwise(entropy(F.col("host"))),
            "parameters": F.when(query == "", 0.0).otherwise(1.0 + F.regexp_count(query, F.lit("&"))),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "section": F.regexp_extract("path", "^/([^/]*)/", 1),
        }
    )


class Model(NamedTuple):
    """affixes: a table of values, block shares and frequencies for each; cuts by feature; trees as nested (feature, bin, left, right) or leaf values."""

    affixes: dict[str, DataFrame]
    usual: float
    cuts: dict[str, list[float]]
    base: float
    trees: list[object]

    def margin(self) -> Column:
        return F.expr(" + ".join([f"{self.base!r}D", *map(tree_value, self.trees)]))


def with_affixes(urls: DataFrame, model: Model) -> DataFrame:
    for affix in AFFIXES:
        blocked, share = f"{affix}_blocked", f"{affix}_share"
        if affix not in model.affixes:
            urls = urls.withColumns({blocked: F.lit(model.usual), share: F.lit(0.0)})
            continue
        urls = urls.join(model.affixes[affix], affix, "left")
        urls = urls.withColumns({blocked: F.coalesce(blocked, F.lit(model.usual)), share: F.coalesce(share, F.lit(0.0))})
    return urls


def binned(urls: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """A column bin_<feature> for each: how many cuts the value is above."""
    return urls.withColumns({f"bin_{f}": F.expr(" + ".join(["0", *[f"CAST({f} > {float(c)!r}D AS INT)" for c in cuts[f]]])) for f in FEATURES})


def tree_value(tree: object) -> str:
    """A tree as SQL over the bins."""
    if isinstance(tree, float):
        return f"{tree!r}D"
    feature, cut, left, right = tree
    return f"CASE WHEN bin_{feature} <= {cut} THEN {tree_value(left)} ELSE {tree_value(right)} END"


# -- learning ---------------------------------------------------------------------------------


def affix_tables(labelled: DataFrame) -> tuple[DataFrame, int, int]:
    """which, value, n and k (labelled and blocked URLs) of every value of both affixes, and the sums of n and k."""
    counts = labelled.groupingSets([["suffix"], ["section"]], "suffix", "section").agg(F.grouping("suffix").alias("which"), F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("k"))
    found = common.written(counts.select("which", F.when(F.col("which") == 0, F.col("suffix")).otherwise(F.col("section")).alias("value"), "n", "k"), "affixes")
    n, k = found.where("which = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    return found, n, k


def train(labelled: DataFrame) -> Model:
    """Learns from labelled (url, host, path, blocked), as lexical() returns them."""
    counts, n, k = affix_tables(labelled)
    if k in (0, n):
        return Model({}, 0.5, {f: [] for f in FEATURES}, 10.0 if n and k == n else -10.0, [])
    affixes = {affix: counts.where(F.col("which") == i).select(F.col("value").alias(affix), ((F.col("k") + 1) / (F.col("n") + 2)).alias(f"{affix}_blocked"), (F.col("n") / n).alias(f"{affix}_share")) for i, affix in enumerate(AFFIXES)}
    model = Model(affixes, k / n, {}, math.log(k / (n - k)), [])
    share = min(1.0, 1.2 * LEARN_ROWS / n)
    rank = common.hash_rank("url")
    sample = common.written(with_affixes(labelled.withColumn("rank", rank).where(F.col("rank") < share), model).orderBy("rank", "url").limit(LEARN_ROWS).select("blocked", *FEATURES), "urls")
    levels = [i / BINS for i in range(1, BINS)]
    found = sample.agg(*[F.percentile_approx(f, levels, 10_000).alias(f) for f in FEATURES]).first()
    model = model._replace(cuts={f: sorted(set(found[f])) for f in FEATURES})
    bins = [f"bin_{f}" for f in FEATURES]
    # at most LEARN_ROWS rows of small numbers
    cells = binned(sample, model.cuts).groupBy("blocked", *bins).agg(F.count("*").alias("n")).orderBy("blocked", *bins).collect()
    common.discard(sample)
    rows = [Cell(float(r["blocked"]), r["n"], tuple(r[b] for b in bins)) for r in cells]
    margins = [model.base] * len(rows)
    for _ in range(TREES):
        model.trees.append(grow(rows, margins))
    return model


class Cell(NamedTuple):
    """Equal rows of the sample: their label, how many they are, and the bin of each feature."""

    label: float
    n: int
    bins: tuple[int, ...]


def grow(cells: list[Cell], margins: list[float]) -> object:
    """One more tree, whose values are added to the margins of the cells.  A level sums gradients and curvatures by node, feature and bin; the splits with the largest gain are chosen."""
    slopes = []
    for cell, margin in zip(cells, margins, strict=True):
        chance = 1 / (1 + math.exp(-margin))
        slopes.append((cell.n * (cell.label - chance), cell.n * chance * (1 - chance)))
    splits: dict[int, tuple[str, int]] = {}
    members = {0: list(range(len(cells)))}
    for level in range(DEPTH):
        below: dict[int, list[int]] = {}
        for node in [m for m in members if m >= (1 << level) - 1]:
            split = best_split(histogram(cells, slopes, members[node]))
            if split is None:
                continue
            splits[node] = split
            place = FEATURES.index(split[0])
            for i in members[node]:
                below.setdefault(2 * node + (1 if cells[i].bins[place] <= split[1] else 2), []).append(i)
        members |= below

    def nested(node: int) -> object:
        if node in splits:
            return (*splits[node], nested(2 * node + 1), nested(2 * node + 2))
        value = RATE * sum(slopes[i][0] for i in members[node]) / (sum(slopes[i][1] for i in members[node]) + SMOOTH)
        for i in members[node]:
            margins[i] += value
        return value

    return nested(0)


def histogram(cells: list[Cell], slopes: list[tuple[float, float]], members: list[int]) -> dict[str, dict[int, tuple[float, float]]]:
    """Sums of gradients and curvatures of some cells, by feature and bin."""
    out: dict[str, dict[int, tuple[float, float]]] = {}
    for place, feature in enumerate(FEATURES):
        bins = out[feature] = {}
        for i in members:
            g, h = bins.get(cells[i].bins[place], (0.0, 0.0))
            bins[cells[i].bins[place]] = (g + slopes[i][0], h + slopes[i][1])
    return out


def best_split(by_feature: dict[str, dict[int, tuple[float, float]]]) -> tuple[str, int] | None:
    """The feature and the last bin of the left side with the largest gain, if any gains."""
    best, best_gain = None, 1e-6
    for feature, bins in by_feature.items():
        g_all, h_all = sum(g for g, _ in bins.values()), sum(h for _, h in bins.values())
        gl = hl = 0.0
        for cut in sorted(bins)[:-1]:
            gl, hl = gl + bins[cut][0], hl + bins[cut][1]
            gr, hr = g_all - gl, h_all - hl
            gain = gl * gl / (hl + SMOOTH) + gr * gr / (hr + SMOOTH) - g_all * g_all / (h_all + SMOOTH)
            if gain > best_gain * (1 + 1e-9):
                best, best_gain = (feature, cut), gain
    return best


# -- use --------------------------------------------------------------------------------------


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row for each page: id, host, path, rule and verdict."""
    host, path = parts(F.col("url"))
    urls = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    name, blocks = fitting(rules, F.col("host"), F.col("path"))
    known = lexical(urls.withColumns({"rule": name, "blocked": blocks}))
    model = train(known.where("blocked is not null"))
    judged = binned(with_affixes(known, model), model.cuts)
    blocked = F.coalesce(F.col("blocked"), model.margin() > 0)
    return judged.select(F.col("page_id").alias(id_column), "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_url_filter: the verdict on every page of the table."""
    return judge(common.read(spark, sf_dir, "pages"))
