"""Secret scanning behind a trigram index (after Cox, 2012).

Each rule's regex is parsed into a Boolean query over trigrams that any match must contain. The index holds, for each
document, which of the rules' trigrams occur: the posting lists, kept as bitmaps beside the rows they point to, so
that lists are intersected by bitwise AND where the text lies and no text is shuffled. `postings` gives the same index as
(trigram, doc_id) rows. Only candidates of a rule are verified with its regex; a rule without mandatory trigrams is
verified on every document.

Nulls are empty texts without spans. Every repeated row is scanned by itself."""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce
from re import _constants as op

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import spans
from terrane.llm.common import whole


@dataclass(frozen=True)
class Rule:
    """pattern: Java and Python agree on it. check: what a match must satisfy besides, as a regex that finds in it."""

    kind: str
    pattern: str
    check: str = ""
    fold: bool = False  # letters in either case


#: The first three are the base; each further kind only adds spans.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", r"[A-Za-z0-9+/_.=-]{8}", True),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{16}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ ){0,2}PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"(?:ghp_|gho_|ghu_|ghs_|ghr_|glpat-)[A-Za-z0-9_-]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")

#: A query: None (no mandatory trigram), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def _and(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(strings: set[str]) -> Query:
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _literals(items: list) -> tuple[list, Query]:
    """Runs of the sets of strings that a sequence spells out: [set or None (anything)], and other mandatory queries."""
    runs: list = [{""}]
    more: list[Query] = []
    for code, arg in items:
        sets: set[str] | None = None
        if code is op.LITERAL:
            sets = {chr(arg)}
        elif code is op.IN and len(arg) <= 4 and all(c is op.LITERAL for c, _ in arg):
            sets = {chr(a) for _, a in arg}
        elif code in (op.SUBPATTERN, op.BRANCH):
            branches = arg[1] if code is op.BRANCH else [arg[3]]
            spelled = [_literals(list(b)) for b in branches]
            if all(len(r) == 1 for r, _ in spelled):
                sets = set().union(*(r[0] for r, _ in spelled))
            else:
                more.append(_or([_query(r, q) for r, q in spelled]))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, body = arg
            r, q = _literals(list(body))
            if len(r) == 1 and high <= 1:
                sets = r[0] | {""} if low == 0 else r[0]
            elif low:
                more.append(_query(r, q))
        elif code in (op.ASSERT, op.ASSERT_NOT, op.AT):
            continue
        if sets is None or len(runs[-1]) * len(sets) > 16:
            runs += [{""}]
        else:
            runs[-1] = {a + b for a in runs[-1] for b in sets}
    return runs, _and(more)


def _query(runs: list, more: Query) -> Query:
    return _and([*(_grams(r) for r in runs), more])


def trigram_query(rule: Rule) -> Query:
    runs, more = _literals(list(sre.parse(rule.pattern)))
    query = _query(runs, more)

    def lowered(q: Query) -> Query:
        return q if q is None else q.lower() if isinstance(q, str) else (q[0], tuple(map(lowered, q[1])))

    return lowered(query)


def _leaves(q: Query) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*map(_leaves, q[1]))


class Index:
    """Bits of the trigrams that some rule needs, 62 to a long."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.queries = {r.kind: trigram_query(r) for r in rules}
        self.trigrams = sorted(set().union(*map(_leaves, self.queries.values())))

    def bitmaps(self, lowered: Column) -> Column:
        words = []
        for at in range(0, max(len(self.trigrams), 1), 62):
            bits = [F.when(F.contains(lowered, F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(self.trigrams[at : at + 62])]
            words.append(reduce(Column.bitwiseOR, bits, F.lit(0).cast("long")))
        return F.array(*words)

    def candidate(self, kind: str, bitmaps: Column) -> Column:
        def ask(q: Query) -> Column:
            if isinstance(q, str):
                return F.get(bitmaps, F.lit(self.trigrams.index(q) // 62)).bitwiseAND(F.lit(1 << self.trigrams.index(q) % 62)) != 0
            if q[0] == "and" and all(isinstance(x, str) for x in q[1]):  # intersection of posting lists: one AND for each word
                masks: dict[int, int] = {}
                for x in q[1]:
                    i = self.trigrams.index(x)
                    masks[i // 62] = masks.get(i // 62, 0) | 1 << i % 62
                return reduce(Column.__and__, [F.get(bitmaps, F.lit(w)).bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items()])
            return reduce(Column.__and__ if q[0] == "and" else Column.__or__, map(ask, q[1]))

        query = self.queries[kind]
        return F.lit(True) if query is None else ask(query)

    def postings(self, docs: DataFrame) -> DataFrame:
        """(trigram, doc_id) of the trigrams that rules need."""
        bits = docs.select("doc_id", self.bitmaps(F.lower(whole(F.col("text")))).alias("b_"))
        some = F.array(*(F.when(F.get("b_", F.lit(i // 62)).bitwiseAND(F.lit(1 << i % 62)) != 0, F.lit(t)) for i, t in enumerate(self.trigrams)))
        return bits.select(F.explode(F.array_compact(some)).alias("trigram"), "doc_id")


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """row_ (the row's own columns), t (its text), an array column of spans for each rule's kind."""
    index = Index(rules)
    t = whole(docs["text"])
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row_"), t.alias("t")).withColumn("b_", index.bitmaps(F.lower("t")))
    none = F.array().cast("array<string>")
    d = d.select("row_", "t", *(F.when(index.candidate(r.kind, F.col("b_")), spans.hits(F.col("t"), r.pattern)).otherwise(none).alias(f"hits_{r.kind}") for r in rules))
    keep = lambda r: (lambda m: _passes(r, m))
    return d.select("row_", "t", *(spans.located(F.col("t"), F.col(f"hits_{r.kind}"), r.pattern, keep(r)).alias(r.kind) for r in rules))


def _passes(rule: Rule, match: Column) -> Column:
    if rule.kind == "assign":  # its value is what comes after the first sign and quotes
        return F.length(F.regexp_extract(match, r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?(.*)$", 1)) >= 8
    return match.rlike(rule.check) if rule.check else F.lit(True)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    d = found(docs.select("doc_id", "text"), rules)
    d = d.select(F.col("row_")["doc_id"].alias("doc_id"), *(r.kind for r in rules), spans.ordered({k: F.col(k) for k in BASE}).alias("base_"), spans.ordered({r.kind: F.col(r.kind) for r in rules}).alias("all_"))
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(spans.joined(F.col("base_")).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("all_")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; secrets in `text` replaced by mark, n_chars (where there is one) counted anew."""
    d = found(docs, rules).withColumn("all_", spans.ordered({r.kind: F.col(r.kind) for r in rules}))
    row = {c: F.col("row_")[c] for c in docs.columns}
    d = d.select("row_", "all_", F.when(F.size("all_") > 0, spans.redacted(F.col("t"), F.col("all_"), mark)).otherwise(F.col("row_")["text"]).alias("text_"))
    row["text"] = F.col("text_")
    if "n_chars" in row:
        row["n_chars"] = F.when(F.size("all_") > 0, F.length("text_").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return d.select(*(c.alias(n) for n, c in row.items()))
