"""URL filtering: longest-suffix rules first, gradient-boosted trees on lexical features for the rest.

Labels. URLs that a rule decides carry its verdict. URLs that no rule fits count as weak allows: a rule that blocks a folder of a
suffix says by its narrowness that the suffix as a whole isn't blocked, and without them the trees would block all of it. At
most SAMPLE of either by hash, and SEEDS made-up URLs that show what no rule speaks of: machine-made hosts, long chains of
hyphens, digits and parameters against ordinary ones. A caller's own labels take the place of the weak allows.

Features: lengths, depth, digit ratio, entropy, parameter counts, hyphens, and suffix statistics: how many of all pages share the
last label or the last two labels of a host, and the smoothed share of them that the rules block. All pages are counted, and every
suffix of LEAST pages or more has its numbers; the numbers of a rarer one say little, and it counts as never seen.

A quarter of the hosts is held out. The threshold is the lowest that reaches PRECISION there, and never below a chance of one half;
if none does, the trees block nothing. `quality` gives the held-out figures.

A null or a URL without "://" has an empty host and path and no rule; the method judges it like any other. Repeated pages are judged
each, alike; an empty table gives an empty result."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.boosting import Boosted, auc, calibrated, fit, platt

#: (host, path, verdict); a host stands for its subdomains too.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SAMPLE, SEEDS = 4000, 1200
#: The most frequent suffixes, which are joined by broadcast; pages from which on a suffix has numbers; pages that a suffix's rate is drawn towards the mean with; precision on held-out hosts.
SUFFIXES, LEAST, SMOOTHING, PRECISION = 10_000, 20, 50.0, 0.95
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits for each character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


NAMES = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "host_entropy", "path_entropy", "parameters", "query_length", "name_length", "vowels", "longest_run", "secure", "suffix_pages", "suffix_blocked", "domain_pages", "domain_blocked")


def suffixes_of(host: Column) -> list[Column]:
    """The last label, the last two labels."""
    return [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)]


@dataclass(frozen=True)
class Known:
    """(s, n, rate) of suffixes over all pages: their pages and the smoothed share of them that a rule blocks. often: the SUFFIXES most
    frequent ones; every: all of them, or None where `often` has all. mean: that share of all pages."""

    often: DataFrame
    every: DataFrame | None
    mean: float


def suffixes(decided: DataFrame) -> Known:
    blocked = F.coalesce((F.col("r.verdict") == "block").cast("double"), F.lit(0.0))
    mean = decided.agg(F.coalesce(F.avg(blocked), F.lit(0.0))).first()[0]
    each = decided.select(F.explode(F.array_distinct(F.array(*suffixes_of(F.col("host"))))).alias("s"), blocked.alias("b"))
    counts = each.groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("b").alias("b"))
    rate = (F.col("b") + F.lit(SMOOTHING * mean)) / (F.col("n") + SMOOTHING)
    kept = counts.where(F.col("n") >= LEAST)
    numbers = lambda x: x.select("s", F.log1p("n").alias("n"), rate.alias("rate"))
    more = kept.limit(SUFFIXES + 1).count() > SUFFIXES
    return Known(numbers(kept.orderBy(F.desc("n"), "s").limit(SUFFIXES)), numbers(kept) if more else None, mean)


def with_suffixes(d: DataFrame, known: Known) -> DataFrame:
    """d (host) with st_: the numbers of its two suffixes. Those that aren't among the most frequent come by a shuffle; rows that have
    theirs already are dealt evenly there, by keys that no host has."""
    names = d.columns
    of = lambda table, *to: table.select(*(F.col(c).alias(n) for c, n in zip(("s", "n", "rate"), to, strict=True)))
    for i, s in enumerate(suffixes_of(F.col("host"))):
        d = d.join(F.broadcast(of(known.often, f"s{i}_", f"n{i}_", f"rate{i}_")), s == F.col(f"s{i}_"), "left")
        if known.every is not None:
            asked = F.when(F.col(f"s{i}_").isNull(), s).otherwise(F.concat(F.lit("/"), F.xxhash64(*names).cast("string")))
            d = d.withColumn("asked_", asked).join(of(known.every, "s_", "n_", "rate_"), F.col("asked_") == F.col("s_"), "left")
            d = d.withColumns({f"n{i}_": F.coalesce(f"n{i}_", "n_"), f"rate{i}_": F.coalesce(f"rate{i}_", "rate_")}).drop("asked_", "s_", "n_", "rate_")
    return d.select(*names, F.array(*(c for i in range(2) for c in (F.coalesce(f"n{i}_", F.lit(0.0)), F.coalesce(f"rate{i}_", F.lit(known.mean))))).alias("st_"))


def features(url: Column, host: Column, path: Column, stats: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    count = lambda c, chars: (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.length(b).cast("double")), F.lit(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    name = F.coalesce(F.when(F.size(labels) >= 3, F.get(labels, F.size(labels) - 3)), host)
    runs = F.transform(F.split(host, r"[.\-]"), lambda x: F.length(x))
    lexical = F.array(
        F.length(url).cast("double"),
        F.length(host).cast("double"),
        F.length(path).cast("double"),
        count(path, "/"),
        count(host, "."),
        ratio(count(url, "0123456789"), url),
        ratio(count(host, "0123456789"), host),
        count(host, "-"),
        _entropy(host),
        _entropy(path),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
        F.length(query).cast("double"),
        F.length(name).cast("double"),
        ratio(count(name, "aeiou"), name),
        F.coalesce(F.array_max(runs), F.lit(0)).cast("double"),
        F.when(url.startswith("https"), 1.0).otherwise(0.0),
    )
    return F.concat(lexical, stats)


def seeds(n: int = SEEDS) -> list[tuple[str, int]]:
    """(url, 1 to block), the same each time: every second one has a machine-made host, many hyphens or many parameters."""
    r, out = random.Random(77), []
    word = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s"]) for _ in range(r.randint(1, 4)))
    code = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(9, 20)))
    for i in range(n):
        bad = i % 2
        if bad:
            name = r.choice([code(), f"{code()}-{code()}", "-".join(word() for _ in range(r.randint(4, 7))), f"{word()}{r.randint(1000, 99999)}-{word()}{r.randint(10, 999)}"])
        else:
            name = r.choice([word(), word(), word() + word(), f"{word()}-{word()}", f"{word()}{r.randint(1, 99)}"])
        host = r.choice(["", "", "www.", "m.", "blog.", "shop.", "news."]) + name + r.choice(["", "", f".{word()}"]) + "." + r.choice([*["com"] * 6, *["org", "net"] * 3, "info", "io", "de", "fr", "es", "it", "ru", "co.uk", "biz"])
        folders = [r.choice([*["en"] * 4, "de", "fr", "es", "it", "ru"])] * r.randint(0, 1) + [r.choice([word(), str(r.randint(1, 99999)), "index", "article"]) for _ in range(r.randint(0, 4))]
        pairs = [r.choice(["id", "page", "q", "ref", "utm_source", "lang"]) + "=" + r.choice([word(), code(), str(r.randint(1, 999))]) for _ in range(r.choice([0, 0, 1, 2, *[5, 7] * bad]))]
        out.append((f"http{r.choice(['', 's'])}://{host}/{'/'.join(folders)}{r.choice(['', '/', '.html', '.php'])}{'?' * bool(pairs)}{'&'.join(pairs)}{r.choice(['', '', '#' + word()])}", bad))
    return out


@dataclass(frozen=True)
class Fitted:
    """trees; what a margin must reach; Platt's two numbers; held-out figures: hosts, urls, auc, precision and recall at the threshold."""

    trees: Boosted
    threshold: float
    scale: tuple[float, float]
    quality: dict[str, float]


def decided(pages: DataFrame) -> DataFrame:
    """pages' page_id and url with host, path and r (the rule that fits and its verdict, or null)."""
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return d.withColumn("r", rule_for(F.col("host"), F.col("path")))


def fitted(rows: DataFrame, known: Known, labelled: DataFrame | None = None, sample: int = SAMPLE) -> Fitted:
    """rows: of decided(); known: of suffixes(); labelled: (url, block 0 or 1) in place of the weak allows."""
    host, path = host_and_path(F.col("url"))
    by_hash = lambda d: d.orderBy(F.xxhash64("url"), "url", "block").limit(sample)
    some = rows.where("url is not null")
    train = by_hash(some.where("r is not null").select("url", (F.col("r.verdict") == "block").cast("int").alias("block")))
    other = some.where("r is null").select("url", F.lit(0).alias("block")) if labelled is None else labelled.where("url is not null and block is not null").select("url", F.col("block").cast("int").alias("block"))
    made = json.dumps([{"url": u, "block": y} for u, y in seeds()])
    own = rows.sparkSession.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(made), "array<struct<url:string,block:int>>")))
    d = with_suffixes(train.unionByName(by_hash(other)).unionByName(own).select("url", "block", host.alias("host")), known)
    d = d.select("host", "url", "block", features(F.col("url"), host, path, F.col("st_")).alias("x"))
    got = d.orderBy(F.xxhash64("url"), "url", "block").select(F.pmod(F.xxhash64("host"), F.lit(4)).alias("part"), "host", "block", "x").collect()  # 2 * SAMPLE + SEEDS rows at most
    x, y = np.array([r["x"] for r in got], dtype=float), np.array([float(r["block"]) for r in got])
    held = np.array([r["part"] == 0 for r in got])
    trees = fit(x[~held], y[~held], trees=40, depth=3)
    margin, truth = trees.margin(x[held]), y[held]
    a, b = platt(margin, truth)
    half = -b / a if a > 0 else float("inf")
    threshold = calibrated(margin, truth, PRECISION, half)
    passed = margin >= threshold
    figures = {"urls": float(held.sum()), "hosts": float(len({r["host"] for r, h in zip(got, held, strict=True) if h})), "auc": auc(margin, truth), "precision": float(truth[passed].mean()) if passed.any() else float("nan"), "recall": float(truth[passed].sum() / max(truth.sum(), 1))}
    return Fitted(trees, threshold, (a, b), figures)


def judged(pages: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the chance of a block, as calibrated on held-out hosts)."""
    rows = decided(pages)
    known = suffixes(rows)
    model = fitted(rows, known, labelled, sample)
    d = with_suffixes(rows, known)
    d = d.select("page_id", "host", "path", "r", features(F.col("url"), F.col("host"), F.col("path"), F.col("st_")).alias("x"))
    d = d.select("page_id", "host", "path", "r", model.trees.column(F.col("x")).alias("margin"))
    verdict = F.coalesce(F.col("r")["verdict"], F.when(F.col("margin") >= F.lit(model.threshold), "block").otherwise("allow"))
    a, b = model.scale
    return d.select("page_id", "host", "path", F.col("r")["rule"].alias("rule"), verdict.alias("verdict"), (1 / (1 + F.exp(-(F.lit(a) * F.col("margin") + F.lit(b))))).alias("score"))
