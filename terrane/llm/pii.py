"""Personal data: high-recall generators propose overlapping spans, boosted trees score them by format and context,
and a threshold calibrated on held-out sentence forms selects those that join the base spans.

Base spans (email, ip, card, phone) are matches that pass a checksum or a count; they always stay. Generators look for
what the base misses: spelled-out addresses, defanged or version-6 ip numbers (shortened ones too), cards in other groupings,
national phone numbers. The trees are fitted on EXAMPLES labelled sentences made by a fixed rule, not on the corpus, and run as
one expression. Every generator has forms of true spans and of look-alikes; whole forms are held out, Platt's method turns margins
on them into chances, and the threshold is the lowest that reaches PRECISION there, never below a chance of one half.

Patterns are written so that no text makes them slow: a run of characters is tried from its start only, and repeats
that can't give back are possessive. Nulls are empty texts without spans; repeated rows are searched each; of proposals
that overlap, the one with the better score stays, the earlier of equals. An empty table gives an empty result."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import spans
from terrane.llm.boosting import Boosted, calibrated, fit, platt
from terrane.llm.common import whole

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals: kind, a literal that every match holds (texts without it aren't searched), pattern. They may overlap each other and the
#: base spans.
GENERATORS = (
    ("email", "", _LOCAL + r"(?:\x20at\x20|\x20?(?:\(at\)|\[at\]|\{at\})\x20?)[A-Za-z0-9-]++(?:(?:\x20dot\x20|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\.)[A-Za-z0-9-]++)++"),
    ("ip", "[.]", r"(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9])"),
    ("ip", ":", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ip", "::", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){1,6}(?::[0-9A-Fa-f]{1,4}+){1,6}(?![0-9A-Za-z:])"),
    ("card", "", r"(?<![0-9])[0-9]{4}(?:[.\x20_/]{1,2}[0-9]{4}){3}(?![0-9])"),
    ("card", "", r"(?<![0-9])[0-9]{4}[.\x20_/-]{1,2}[0-9]{6}[.\x20_/-]{1,2}[0-9]{5}(?![0-9])"),
    ("phone", "", r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|0[0-9]{1,3}|[0-9]{3})[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9])"),
)
#: Labelled sentences; the forms marked as held out are for the threshold alone.
EXAMPLES, PRECISION, CONTEXT = 3000, 0.95, 24
CUES = {"email": r"(?i)mail|contact|write|reach|send", "ip": r"(?i)\bip\b|host|server|address|login", "card": r"(?i)card|visa|pay|credit|debit", "phone": r"(?i)phone|call|tel|mobile|fax|dial|whatsapp"}
_DIGITS = "0123456789"


def _count(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def _octets(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


KEEP = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.length(_digits(m)).between(14, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def base_spans(d: DataFrame, t: str = "t") -> DataFrame:
    """Adds a column of spans for each kind."""
    names = d.columns
    d = d.select(*names, *(spans.hits(F.col(t), BASE[k]).alias(f"h_{k}") for k in KINDS))
    return d.select(*names, *(spans.located(F.col(t), F.col(f"h_{k}"), BASE[k], KEEP[k]).alias(k) for k in KINDS))


def proposals(d: DataFrame, t: str = "t") -> DataFrame:
    """Adds `g_`: array<struct<start,end,kind:int,x:array<double>>>, x the features of format and context."""
    names = d.columns
    d = d.select(*names, *((F.when(F.contains(F.col(t), F.lit(needed)), spans.hits(F.col(t), p)).otherwise(F.array().cast("array<string>")) if needed else spans.hits(F.col(t), p)).alias(f"g{i}") for i, (_, needed, p) in enumerate(GENERATORS)))

    def proposed(i: int, kind: str, pattern: str) -> Column:
        at = spans.located(F.col(t), F.col(f"g{i}"), pattern, lambda m: F.lit(True))
        return F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), _features(F.col(t), s["start"], s["end"], i, kind).alias("x")))

    every = [proposed(i, kind, p) for i, (kind, _, p) in enumerate(GENERATORS)]
    return d.select(*names, F.concat(*every).alias("g_"))


def _features(t: Column, start: Column, end: Column, generator: int, kind: str) -> Column:
    m = F.substring(t, start + 1, end - start)
    before = F.substring(t, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    after = F.substring(t, end + 1, F.lit(CONTEXT))
    digits = _digits(m)
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.array(
        F.lit(float(generator)),
        F.length(m).cast("double"),
        F.length(digits).cast("double"),
        _count(m, " ./-_"),
        flag(_luhn(F.when(digits == "", "1").otherwise(digits))),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        flag(before.rlike(CUES[kind])),
        flag(after.rlike(CUES[kind])),
        flag(before.rlike(r"(?i)(?:version|order|isbn|no\.?|number|page|section|item|figure|id|ref)[:#.\x20]*$")),
        flag(before.rlike(r"[A-Za-z0-9.]$")),
        flag(after.rlike(r"^[A-Za-z0-9]")),
        flag(m.rlike(r"(?i)\b(?:com|org|net|edu|io|de|fr|es)$")),
        flag(m.rlike(r"[\[({]")),
        flag(m.rlike(r"^\(?0")),
        _count(m, "abcdefABCDEF"),
        flag(m.rlike("^[0-9]{3}[^0-9]+[0-9]{3}[^0-9]+[0-9]{4}$")),
        flag(before.rlike(r"(?i)(?:\bin|\bfrom|\bto|between|years?|and|of|:\x20*[0-9]+|[0-9],?)\x20*$")),
    )


def forms(r: random.Random) -> list[tuple[int, int, bool, object]]:
    """(generator, label, held out, a maker of (cue, span)). Forms of one generator differ in cues and in how they are written."""
    d = lambda k: "".join(r.choice(_DIGITS) for _ in range(k))
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 8)))
    hexed = lambda: f"{r.randrange(65536):x}"
    top = lambda: r.choice(["com", "org", "net", "io", "de"])
    year = lambda: str(r.randint(1900, 2030))

    def luhn(good: bool, first: str = "3456", size: int = 16) -> str:
        while True:
            s = r.choice(first) + d(size - 1)
            total = sum(x if (size - i) % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, s)))
            if (total % 10 == 0) == good:
                return s

    def cut(s: str, sizes: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return sep.join(out)

    def quad(lo: int, hi: int) -> str:
        return "[.]".join(str(r.randint(lo, hi)) for _ in range(4))

    def short(make: object) -> str:
        a, b = r.randint(1, 3), r.randint(1, 3)
        return ":".join(make() for _ in range(a)) + "::" + ":".join(make() for _ in range(b))

    amex = lambda good: luhn(good, "3", 15)
    return [
        (0, 1, False, lambda: (r.choice(["mail", "contact", "write to", ""]), f"{word()}{r.choice(['', '.' + word()])} {r.choice(['at', '(at)'])} {word()}{r.choice([' dot ', '.'])}{top()}")),
        (0, 1, False, lambda: (r.choice(["reach me:", "send it to", "email"]), f"{word()}[at]{word()}[dot]{top()}")),
        (0, 1, True, lambda: (r.choice(["questions to", "my address is"]), f"{word()} (at) {word()} (dot) {top()}")),
        (0, 0, False, lambda: (r.choice(["we met", "she looked", "it was held", "sold"]), f"{word()} at {word()}.{word()}")),
        (0, 0, False, lambda: (r.choice(["arrived", "stop", ""]), f"{word()} at {word()} dot {word()}")),
        (0, 0, True, lambda: (r.choice(["he stayed", "they play"]), f"{word()} at {word()}.{word()}")),
        (1, 1, False, lambda: (r.choice(["host", "server", "ip", ""]), quad(1, 255))),
        (1, 1, True, lambda: (r.choice(["login from", "traffic of", "blocked"]), quad(1, 255))),
        (1, 0, False, lambda: (r.choice(["section", "version", "page", "item"]), quad(256, 999))),
        (1, 0, True, lambda: (r.choice(["release", "figure", "number"]), quad(256, 999))),
        (2, 1, False, lambda: (r.choice(["host", "ip", "address", ""]), ":".join(hexed() for _ in range(8)))),
        (2, 1, True, lambda: (r.choice(["route to", "ping"]), ":".join(hexed() for _ in range(8)))),
        (3, 1, False, lambda: (r.choice(["host", "ip", "address", "server"]), short(hexed))),
        (3, 1, False, lambda: (r.choice(["ping", ""]), "fe80::" + ":".join(hexed() for _ in range(r.randint(1, 4))))),
        (3, 1, True, lambda: (r.choice(["route to", "login from"]), f"2001:db8::{hexed()}:{hexed()}")),
        (3, 0, False, lambda: (r.choice(["call", "use", "the class", ""]), short(lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 4)))))),
        (3, 0, False, lambda: (r.choice(["at", "score", "ratio"]), f"{r.randint(1, 9)}::{r.randint(1, 9)}")),
        (3, 0, True, lambda: (r.choice(["include", "in the module"]), "".join(r.choice("abcdef") for _ in range(4)) + "::" + "".join(r.choice("abcdef") for _ in range(3)))),
        (4, 1, False, lambda: (r.choice(["card", "pay with", "visa", ""]), cut(luhn(True), (4, 4, 4, 4), r.choice([". ", "/", "_", "."])))),
        (4, 1, True, lambda: (r.choice(["charge", "billed to"]), cut(luhn(True), (4, 4, 4, 4), r.choice(["/", "_", "."])))),
        (4, 0, False, lambda: (r.choice(["order", "ref", "number", "in", ""]), cut(luhn(False), (4, 4, 4, 4), r.choice([". ", "/", "_", "."])))),
        (4, 0, False, lambda: (r.choice(["the years", "between", "from"]), "/".join(year() for _ in range(4)))),
        (4, 0, True, lambda: (r.choice(["parcel", "serial"]), cut(luhn(False), (4, 4, 4, 4), r.choice(["/", "_", "."])))),
        (5, 1, False, lambda: (r.choice(["card", "amex", "pay with", ""]), cut(amex(True), (4, 6, 5), r.choice([".", "/", "_", ". "])))),
        (5, 1, True, lambda: (r.choice(["charge", "credit"]), cut(amex(True), (4, 6, 5), r.choice(["/", "."])))),
        (5, 0, False, lambda: (r.choice(["order", "ref", "part"]), cut(amex(False), (4, 6, 5), r.choice([".", "/", "_", "-"])))),
        (5, 0, True, lambda: (r.choice(["parcel", "account"]), cut(amex(False), (4, 6, 5), r.choice(["/", "-"])))),
        (6, 1, False, lambda: (r.choice(["call", "phone", "tel", "mobile:", "fax"]), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}"]))),
        (6, 1, False, lambda: (r.choice(["office", "ask for us:", ""]), f"({d(3)}) {d(3)}-{d(4)}")),
        (6, 1, True, lambda: (r.choice(["dial", "whatsapp", "ring me on"]), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}"]))),
        (6, 0, False, lambda: (r.choice(["order", "isbn", "ref", "id", "page"]), r.choice([f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(4)}-{d(5)}", f"{d(3)}/{d(4)}/{d(4)}"]))),
        (6, 0, False, lambda: (r.choice(["in the years", "between", "from", "weights of"]), f"{d(3)} {year()} {year()}")),
        (6, 0, False, lambda: (r.choice(["rows", "the values", "counted"]), f"{d(3)} {d(3)} {d(3)}")),
        (6, 0, True, lambda: (r.choice(["item", "figures", "lot"]), r.choice([f"{d(3)} {d(3)} {d(3)}", f"{d(3)}/{d(3)}/{d(4)}"]))),
    ]


def examples(n: int = EXAMPLES) -> list[tuple[str, int, int, int, int, bool]]:
    """(sentence, start, end, label, generator, held out), the same each time."""
    r = random.Random(20240501)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 8)))
    made, out = forms(r), []
    for i in range(n):
        generator, label, held, make = made[i % len(made)]
        cue, span = make()
        head = " ".join([*(word() for _ in range(r.randint(0, 4))), *([cue] if cue else [])])
        head += " " if head else ""
        out.append((f"{head}{span} {word()} {word()}", len(head), len(head) + len(span), label, generator, held))
    return out


@dataclass(frozen=True)
class Fitted:
    """trees; what a margin must reach; held-out figures by kind: proposals, precision and recall."""

    trees: Boosted
    threshold: float
    quality: dict[str, tuple[int, float, float]]


@cache
def _model(key: object) -> Fitted:
    spark = SparkSession.getActiveSession()
    rows = json.dumps([{"i": i, "t": t, "a": a, "b": b, "y": y, "h": h} for i, (t, a, b, y, _, h) in enumerate(examples())])
    made = spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(rows), "array<struct<i:int,t:string,a:int,b:int,y:int,h:boolean>>")))
    d = proposals(made)
    d = d.select("i", "a", "b", "y", "h", F.explode("g_").alias("g")).where("g.start < b and g.end > a").select("i", "y", "h", "g.kind", "g.x").orderBy("i", "x")
    got = d.collect()  # a few rows for each of EXAMPLES sentences
    x, y, held = np.array([r["x"] for r in got]), np.array([float(r["y"]) for r in got]), np.array([r["h"] for r in got])
    kind = np.array([r["kind"] for r in got])
    trees = fit(x[~held], y[~held], trees=40, depth=3)
    margin, truth = trees.margin(x[held]), y[held]
    a, b = platt(margin, truth)
    threshold = calibrated(margin, truth, PRECISION, -b / a if a > 0 else float("inf"))
    passed, quality = margin >= threshold, {}
    for k, name in enumerate(KINDS):
        of = kind[held] == k
        right = float(truth[of & passed].sum())
        quality[name] = (int(of.sum()), right / max((of & passed).sum(), 1), right / max(truth[of].sum(), 1))
    return Fitted(trees, threshold, quality)


def model() -> Fitted:
    return _model(id(SparkSession.getActiveSession().sparkContext))


def selected(base: Column, candidates: Column) -> Column:
    """Of candidates (start, end, kind, score), those that overlap no base span and no better candidate next to them."""
    kind = "array<struct<start:int,end:int,kind:int>>"
    every = F.sort_array(F.concat(F.transform(base, lambda s: F.struct(s["start"], s["end"], F.lit(-1).alias("kind"), F.lit(0.0).alias("score"))), F.transform(candidates, lambda s: F.struct(s["start"], s["end"], s["kind"], s["score"]))))
    last = "struct<start:int,end:int,kind:int,score:double>"
    start = F.struct(F.lit(0).alias("taken"), F.lit(None).cast(last).alias("open"), F.array().cast(kind).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        open_, base_ = acc["open"], s["kind"] < 0
        clear = open_.isNull() | (open_["end"] <= s["start"])
        done = F.when(open_.isNotNull() & clear, F.concat(acc["out"], F.array(F.struct(open_["start"].alias("start"), open_["end"].alias("end"), open_["kind"].alias("kind"))))).otherwise(acc["out"])
        free = ~base_ & (acc["taken"] <= s["start"]) & (clear | (s["score"] > open_["score"]))
        now = F.when(free, s.cast(last)).when(base_ | clear, F.lit(None).cast(last)).otherwise(open_)
        return F.struct(F.when(base_, F.greatest(acc["taken"], s["end"])).otherwise(acc["taken"]).alias("taken"), now.alias("open"), done.cast(kind).alias("out"))

    return F.aggregate(every, start, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["open"]["start"].alias("start"), acc["open"]["end"].alias("end"), acc["open"]["kind"].alias("kind"))))))


def found(docs: DataFrame) -> DataFrame:
    """row_, t, a column of base spans for each kind, and `more_`: array<struct<start,end,kind:int>> of the method's spans."""
    made = model()
    trees, threshold = made.trees, made.threshold
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row_"), whole(docs["text"]).alias("t"))
    d = proposals(base_spans(d))
    scored = F.transform("g_", lambda g: F.struct(g["start"], g["end"], g["kind"], trees.column(g["x"]).alias("score")))
    d = d.select("row_", "t", *KINDS, F.filter(scored, lambda g: g["score"] >= F.lit(threshold)).alias("c_"))
    more = F.when(F.size("c_") > 0, selected(F.concat(*KINDS), F.col("c_"))).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int>>"))
    return d.select("row_", "t", *KINDS, more.alias("more_"))


def all_spans() -> Column:
    more = F.transform("more_", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind")))
    return F.sort_array(F.concat(spans.ordered({k: F.col(k) for k in KINDS}), more))


def report(docs: DataFrame) -> DataFrame:
    d = found(docs.select("doc_id", "text")).select(F.col("row_")["doc_id"].alias("doc_id"), *KINDS, spans.ordered({k: F.col(k) for k in KINDS}).alias("base_"), all_spans().alias("all_"))
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(spans.joined(F.col("base_")).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("all_")).alias("spans"), F.size("all_").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """All rows and columns; every span in `text` replaced by mark."""
    d = found(docs).withColumn("all_", all_spans())
    return d.select(*(F.when(F.size("all_") > 0, spans.redacted(F.col("t"), F.col("all_"), mark)).otherwise(F.col("row_")[c]).alias(c) if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns))
