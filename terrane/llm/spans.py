"""Match positions from built-in functions: pieces between matches give each match's start in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


def hits(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, found: Column, pattern: str, keep: Callable[[Column], Column], extra: Callable[[Column], dict[str, Column]] | None = None, extra_type: str = "") -> Column:
    """array<struct<start,end,...>> of the matches in `found` that pass keep(match); empty without matches.

    One pass keeps the position as a running sum, so its cost follows the number of matches."""
    kind = f"array<struct<start:int,end:int{extra_type}>>"
    empty = F.from_json(F.lit("[]"), kind)
    sized = F.zip_with(F.split(text, pattern, -1), found, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["h"])
        span = F.struct(start.alias("start"), end.alias("end"), *((c.alias(n) for n, c in extra(x["h"]).items()) if extra else ()))
        more = F.when(x["h"].isNotNull() & keep(x["h"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), more.cast(kind).alias("out"))

    run = F.aggregate(sized, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, run).otherwise(empty)


def ordered(kinds: dict[str, Column]) -> Column:
    """All spans of all kinds by start, then by the kinds' order here: array<struct<start,k,end,kind>>."""

    def tagged(c: Column, k: int, name: str) -> Column:
        return F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(name).alias("kind")))

    return F.sort_array(F.concat(*(tagged(c, k, name) for k, (name, c) in enumerate(kinds.items()))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """text with every span, or run of overlapping spans, replaced by mark. spans: sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))
