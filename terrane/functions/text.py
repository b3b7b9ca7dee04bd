"""Parsers of dirty listing text as built-in column expressions: null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import fixed

# Letters that the fold replaces before decomposition.
LETTERS = {"ə": "e", "Ə": "e", "ı": "i", "İ": "i", "ö": "o", "Ö": "o", "ü": "u", "Ü": "u", "ç": "c", "Ç": "c", "ş": "s", "Ş": "s", "ğ": "g", "Ğ": "g"}


@cache
def _fold_table() -> tuple[str, str]:
    """Each character whose compatibility decomposition is one base character with marks; marks themselves vanish."""
    table = dict(LETTERS)
    for low, high in ((0x00A0, 0x0250), (0x0370, 0x0460), (0x1E00, 0x2000), (0x2070, 0x20A0), (0xFF01, 0xFF5F)):
        for c in map(chr, range(low, high)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(plain) == 1 and plain != c:
                table.setdefault(c, plain)
    marks = "".join(map(chr, range(0x0300, 0x0370)))
    return "".join(table) + marks, "".join(table.values())


def transliterate(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(c, *_fold_table()))


def normalize_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(transliterate(c), "[^a-z0-9]+", "_"), F.lit("_"))


def fold_name(name: str) -> str:
    """normalize_name for a column's name, at the driver."""
    text = unicodedata.normalize("NFKD", name.translate(str.maketrans(LETTERS)))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    return "_".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text).split())


def parse_number(c: Column) -> Column:
    """A number ahead of words without digits, commas, points or signs is read at once; the rest by what follows, with the same result there."""
    c = c.cast("string")
    plain = F.regexp_extract(c, r"^(-?[0-9]++(?:\.[0-9]++)?+)(?:\s*+[^0-9.,\s-][^0-9.,]*+)?+\s*+$", 1)
    return F.when(plain != "", plain.try_cast("double")).otherwise(_parse_number(c))


def _parse_number(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), r"(?U)[\s  ]", "")
    grouped = s.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")
    comma = F.contains(s, F.lit(",")) & ~F.contains(s, F.lit("."))
    s = F.when(grouped, F.replace(s, F.lit(","), F.lit(""))).when(comma, F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
    return F.nullif(F.regexp_extract(s, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def parse_floor(c: Column) -> tuple[Column, Column]:
    """(floor, total)."""
    numbers = F.regexp_extract_all(c.cast("string"), F.lit(r"-?\d+"), F.lit(0))
    return tuple(F.get(numbers, F.lit(i)).try_cast("double") for i in (0, 1))


def parse_land(c: Column) -> Column:
    """In sot (100 square metres)."""
    x, s = parse_number(c), transliterate(c)
    hectares = s.rlike(r"(^|\s)ha(\s|$)") | s.endswith("ha")
    return F.when(hectares, x * 100.0).when(F.contains(s, F.lit("m2")) | F.contains(s, F.lit("kv")), x / 100.0).otherwise(x)


def parse_area(c: Column) -> Column:
    x = parse_number(c)
    return F.when(F.contains(transliterate(c), F.lit("sot")), x * 100.0).otherwise(x)


def parse_yes_no(c: Column) -> Column:
    s = F.trim(transliterate(c.cast("string")))
    tokens = F.split(F.trim(F.regexp_replace(F.replace(s, F.lit(","), F.lit(" ")), r"\s+", " ")), " ")
    words = lambda w: F.array(*map(F.lit, w))
    no = F.arrays_overlap(tokens, words(fixed.NO)) | s.endswith("siz") | s.endswith("suz")
    with_ = F.exists(tokens, lambda t: t.rlike("^(" + "|".join(fixed.YES_STEMS) + ")(li|lu)$"))
    return F.when(s == "", F.lit(None)).when(no, 0.0).when(F.arrays_overlap(tokens, words(fixed.YES)) | with_, 1.0)


def parse_currency(value: Column, price: Column | None = None) -> Column:
    """Never null: AZN by default."""

    def of(c: Column) -> Column:
        s = transliterate(c)
        has = lambda *w: F.coalesce(s.rlike("|".join(w)), F.lit(False))
        return F.when(has("usd", r"\$", "dollar"), "USD").when(has("eur", "€", "avro"), "EUR").when(has("rub", "₽"), "RUB").when(has("azn", "₼", "manat"), "AZN")

    return F.coalesce(of(value), *([of(price)] if price is not None else []), F.lit("AZN"))


def rate(currency: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in fixed.RATES.items() for x in kv)), currency)


def parse_attributes(c: Column) -> Column:
    """map<string,string> of a JSON object, a list of {name|key, value}, a quoted literal, or 'k: v' pairs. Later keys win. Null for an object or list that doesn't parse."""
    s = F.trim(c)
    quoted = literal_to_json(s)
    as_map = lambda x: F.when(x.startswith("{"), F.from_json(x, "map<string,string>"))

    def as_list(x: Column) -> Column:
        items = F.filter(F.from_json(x, "array<struct<name:string,key:string,value:string>>"), lambda i: F.coalesce(i["name"], i["key"]).isNotNull())
        return F.when(x.startswith("["), _entries(F.transform(items, lambda i: F.struct(F.coalesce(i["name"], i["key"]).alias("key"), i["value"].alias("value")))))

    parts = F.filter(F.split(s, r"[;\n|]"), lambda p: F.contains(p, F.lit(":")))
    pairs = _entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value"))))
    return F.coalesce(as_map(s), as_list(s), as_map(quoted), as_list(quoted), F.when(~s.rlike(r"^[\[{]"), pairs))


#: A string in single quotes, one in double quotes, or a word: the tokens of a quoted literal that JSON spells in another way.
_TOKEN = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[A-Za-z]++"""
_WORDS = {"True": "true", "False": "false", "None": "null"}


def literal_to_json(c: Column) -> Column:
    """A literal of dictionaries, lists, quoted strings, numbers, True, False and None as JSON. What is no such literal comes
    out as something that doesn't parse."""
    words = F.create_map(*(F.lit(x) for kv in _WORDS.items() for x in kv))

    def token(t: Column) -> Column:
        inner = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("\\'"), F.lit("'"))
        double = F.concat(F.lit('"'), F.regexp_replace(inner, r'(?<!\\)"', r'\\"'), F.lit('"'))
        return F.when(t.startswith("'"), double).otherwise(F.coalesce(F.try_element_at(words, t), t))

    between, tokens = F.split(c, _TOKEN, -1), F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.zip_with(between, tokens, lambda a, t: F.concat(a, F.coalesce(token(t), F.lit("")))), "")


def _entries(pairs: Column) -> Column:
    """Like map_from_entries, but the last of equal keys wins."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def district(extra_info: Column, location: Column) -> Column:
    def of(c: Column) -> Column:
        return F.get(F.filter(F.transform(F.split(c, r"\*"), lambda t: F.trim(t)), lambda t: t.endswith(" r.")), F.lit(0))

    return transliterate(F.coalesce(of(extra_info), of(location)))


def tags(extra_info: Column, location: Column) -> Column:
    """Distinct folded tags of the first source that isn't blank, sorted, joined by |. Never null."""
    source = F.coalesce(F.nullif(F.trim(extra_info), F.lit("")), F.nullif(F.trim(location), F.lit("")))
    parts = F.filter(F.transform(F.split(source, r"\*"), lambda t: F.trim(transliterate(t))), lambda t: t != "")
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(parts)), "|"), F.lit(""))


def tidy(c: Column) -> Column:
    """Folded category text; blank is null."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"\s*/\s*", "/")
    return F.nullif(F.trim(transliterate(s)), F.lit(""))


def keyword(description: Column, words: list[str]) -> Column:
    s = transliterate(F.coalesce(description, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(s, F.lit(w))
    return out.cast("double")


def split_labels(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[|]"), lambda x: x != "")


def location_label(key: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in fixed.LOCATION_KINDS.items() for x in kv))
    name, kind = F.regexp_extract(key, r"^(.+) (\S+)$", 1), F.try_element_at(kinds, F.regexp_extract(key, r"^(.+) (\S+)$", 2))
    return F.when((name != "") & kind.isNotNull(), F.concat(F.initcap(name), F.lit(" ("), kind, F.lit(")"))).otherwise(F.initcap(key))


def base_feature(name: Column) -> Column:
    """'district=x' and 'rooms_missing' to the feature they come from; both areas are one."""
    base = F.regexp_replace(F.regexp_replace(name, "=.*$", ""), "_missing$", "")
    return F.when(base.isin("area_m2", "log_area"), "area").otherwise(base)
