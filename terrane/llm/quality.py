"""Quality rules as weak supervision: each rule votes good, bad or abstains; expectation-maximisation estimates how
often each is right without labels, and the posterior probability of a good document replaces "all rules must pass".

All features are built-in functions over whole texts. The model's statistics are counts of vote patterns over all
documents, at most 3 ** rules (2 for a rule with two outcomes) of them, whatever the corpus size; so the estimation itself runs at the driver.

Features are computed once and written to the shared folder beside the columns that are carried on; estimating and judging
read them there.

Nulls and texts without words: zero words, base_failed. Ties and repeated rows need no rule: each row is judged by itself.
An empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import whole, written

BLANK = r"[\x20\x09-\x0D]+"
N, SYMBOLS = 8, "#*$%&|<>"

#: name: (bad if, good if), over the features; neither: the rule abstains. A rule for one defect never votes good.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 20", "n_words >= 50"),
    "word_length": ("word_chars > 15 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "sentences": ("n_words >= 50 and 200 * n_stops < n_words", "50 * n_stops >= n_words and 3 * n_stops <= n_words"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "false"),
    "variety": ("n_words >= 50 and 10 * n_distinct < n_words", "false"),
    "lines": ("n_dup_lines > 2 and 4 * n_dup_lines > n_lines", "false"),
    "symbols": ("4 * n_symbols > n_words", "false"),
    "density": ("20 * n_symbols > word_chars", "false"),
    "letters": ("100 * n_letters < 60 * word_chars", "false"),
    "capitals": ("2 * n_upper > n_letters", "false"),
    "shouting": ("n_words >= 20 and 4 * n_stops > n_words", "false"),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_stops"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_features(docs: DataFrame, carried: list[str]) -> DataFrame:
    """row_ (the carried columns), a struct `q_` of the features. Long arrays live only within a row."""
    t = whole(docs["text"])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    d = docs.select(F.struct(*(docs[c] for c in carried)).alias("row_"), t.alias("t"), F.filter(F.split(t, BLANK), lambda x: x != "").alias("w"))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("c", F.when(F.size("w") >= N, F.transform("w", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    window = lambda x, i: F.xxhash64(x, *(F.get(F.col("c"), i + k) for k in range(1, N)))
    d = d.withColumn("h", F.transform(F.slice("c", 1, F.greatest(F.size("c") - N + 1, F.lit(0))), window))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    same = lambda k: F.get(F.col("s"), k)["x"]
    twice = F.transform("s", lambda s, k: F.when((same(k - 1) == s["x"]) | (same(k + 1) == s["x"]), s["i"]))
    d = d.withColumn("p", F.sort_array(F.array_compact(twice)))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("p", start, lambda acc, i: F.struct((i + N).alias("end"), (acc["n"] + i + N - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"])
    letters = F.length("t") - F.length(_without(F.col("t"), upper + upper.lower()))
    q = {
        "n_words": F.size("w"),
        "word_chars": F.length(_without(F.col("t"), " \t\n\x0b\x0c\r")),
        "n_symbols": F.length("t") - F.length(_without(F.col("t"), SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("p") > 0, covered).otherwise(0),
        "n_lines": F.size("lines"),
        "n_upper": F.length("t") - F.length(_without(F.col("t"), upper)),
        "n_letters": letters,
        "n_distinct": F.size(F.array_distinct("w")),
        "n_stops": F.length("t") - F.length(_without(F.col("t"), ".!?。")),
    }
    return d.select("row_", F.struct(*(c.cast("long").alias(n) for n, c in q.items())).alias("q_"))


def votes(q: str = "q_") -> Column:
    """One character for each rule: 0 bad, 1 good, - abstains."""
    prefixed = {}
    for name, pair in RULES.items():
        for f in sorted(FEATURES, key=len, reverse=True):
            pair = tuple(" ".join(f"{q}.{w}" if w == f else w for w in p.split()) for p in pair)
        prefixed[name] = pair
    return F.concat(*(F.expr(f"case when {bad} then '0' when {good} then '1' else '-' end") for bad, good in prefixed.values()))


Rates = list[tuple[dict[str, float], dict[str, float]]]
#: How often a rule votes 0, 1 or abstains on a bad and on a good document, before any data.
PRIOR, START = 0.8, ({"0": 0.3, "1": 0.2, "-": 0.5}, {"0": 0.02, "1": 0.48, "-": 0.5})


class LabelModel:
    """Rules are independent given the class; abstaining counts as an outcome, as a defect's absence says something too."""

    def __init__(self, prior: float, rates: Rates) -> None:
        self.prior, self.rates = prior, rates

    def weights(self) -> list[dict[str, float]]:
        return [{v: math.log(good[v] / bad[v]) for v in "01-"} for bad, good in self.rates]

    def base(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def log_odds(self, pattern: str) -> float:
        return self.base() + sum(w[v] for v, w in zip(pattern, self.weights(), strict=True))

    def column(self, pattern: Column) -> Column:
        odds = F.lit(self.base())
        for k, w in enumerate(self.weights()):
            v = F.substring(pattern, k + 1, 1)
            odds = odds + F.when(v == "1", F.lit(w["1"])).when(v == "0", F.lit(w["0"])).otherwise(F.lit(w["-"]))
        return 1 / (1 + F.exp(-odds))


def estimate(counts: Mapping[str, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts. As many pseudo-votes as a hundredth of the documents hold the rates
    near their start, so that the classes can't change places."""
    n, rules = sum(counts.values()), len(RULES)
    model = LabelModel(PRIOR, [START] * rules)
    if not n:
        return model
    held = max(10.0, n / 100)
    for _ in range(rounds):
        good, votes_of = 0.0, [tuple({v: held * s[v] for v in "01-"} for s in START) for _ in range(rules)]
        weights, base = model.weights(), model.base()
        for pattern, c in sorted(counts.items()):
            odds = base + sum(w[v] for v, w in zip(pattern, weights, strict=True))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good += c * p
            for k, v in enumerate(pattern):
                votes_of[k][0][v] += c * (1 - p)
                votes_of[k][1][v] += c * p
        rates = [tuple({v: x / sum(side.values()) for v, x in side.items()} for side in pair) for pair in votes_of]
        new = LabelModel((good + PRIOR * held) / (n + held), rates)
        done = max(abs(a[v] - b[v]) for x, y in zip(rates, model.rates, strict=True) for a, b in zip(x, y, strict=True) for v in "01-") < 1e-9
        model = new
        if done:
            break
    return model


def fitted(featured: DataFrame) -> LabelModel:
    """From v_, the votes, of all rows; the patterns that reach the driver are 2 ** 8 * 3 ** 3 at most."""
    return estimate({r["v_"]: r["n"] for r in featured.groupBy("v_").agg(F.count(F.lit(1)).alias("n")).collect()})


def judged(docs: DataFrame, carried: list[str] | None = None, model: LabelModel | None = None) -> DataFrame:
    """row_ (the carried columns, by default all), q_, base_failed, posterior, kept."""
    d = written(with_features(docs, docs.columns if carried is None else carried).withColumn("v_", votes()))
    model = model or fitted(d)
    q = F.col("q_")
    failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    d = d.select("row_", "q_", failed.alias("base_failed"), model.column(F.col("v_")).alias("posterior"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def report(docs: DataFrame) -> DataFrame:
    q = F.col("q_")
    return judged(docs, ["doc_id"]).select(F.col("row_")["doc_id"].alias("doc_id"), *(q[c].alias(c) for c in FEATURES[:5]), "base_failed", "posterior", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns."""
    return judged(docs).where("kept").select(*(F.col("row_")[c].alias(c) for c in docs.columns))
