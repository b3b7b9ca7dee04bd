"""Queries of the text parsers and the cleaning pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrane.functions import fixed, numeric, text
from terrane.operators import clean
from terrane.plans.registry import Tables, query

NUMBERS = """SELECT l_orderkey * 8 + l_linenumber AS k, CASE l_partkey % 8 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' m²') WHEN 1 THEN concat(CAST(CAST(floor(l_extendedprice) AS INT) AS STRING), ' 000') WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ',5') WHEN 3 THEN concat('1,', CAST(CAST(l_quantity AS INT) + 100 AS STRING), ',000') WHEN 4 THEN 'n/a' WHEN 5 THEN CAST(NULL AS STRING) WHEN 6 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING), ' .5') ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), '-15') END AS raw FROM lineitem"""


@query(f"""WITH r AS ({NUMBERS}), s AS (SELECT k, raw, regexp_replace(raw, '\\s', '', 'g') AS t FROM r),
u AS (SELECT k, raw, CASE WHEN regexp_matches(t, '^-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?$') THEN replace(t, ',', '') WHEN contains(t, ',') AND NOT contains(t, '.') THEN replace(t, ',', '.') ELSE t END AS t FROM s)
SELECT k, raw, TRY_CAST(NULLIF(regexp_extract(t, '-?\\d+(\\.\\d+)?'), '') AS DOUBLE) AS value FROM u""")
def parse_numbers(t: Tables) -> DataFrame:
    return t.sql(NUMBERS, "lineitem").withColumn("value", text.parse_number(F.col("raw")))


FLOORS = """SELECT l_orderkey * 8 + l_linenumber AS k, CASE l_partkey % 5 WHEN 0 THEN concat(CAST(l_linenumber AS STRING), ' / ', CAST(l_suppkey % 20 AS STRING)) WHEN 1 THEN CAST(l_linenumber AS STRING) WHEN 2 THEN concat('-', CAST(l_linenumber AS STRING), '/9') WHEN 3 THEN 'x' ELSE CAST(NULL AS STRING) END AS raw FROM lineitem"""


@query(f"WITH r AS ({FLOORS}) SELECT k, TRY_CAST(regexp_extract_all(raw, '-?\\d+')[1] AS DOUBLE) AS floor, TRY_CAST(regexp_extract_all(raw, '-?\\d+')[2] AS DOUBLE) AS total FROM r")
def parse_floor(t: Tables) -> DataFrame:
    floor, total = text.parse_floor(F.col("raw"))
    return t.sql(FLOORS, "lineitem").select("k", floor.alias("floor"), total.alias("total"))


LAND = """SELECT p_partkey AS k, concat(CAST(p_size AS STRING), CASE p_partkey % 5 WHEN 0 THEN ' sot' WHEN 1 THEN ' m²' WHEN 2 THEN ' ha' WHEN 3 THEN ' kv' ELSE '' END) AS raw, concat(CAST(p_size AS STRING), CASE p_partkey % 2 WHEN 0 THEN ' SOT' ELSE ' m²' END) AS area FROM part"""


@query(f"WITH r AS ({LAND}) SELECT k, CAST(regexp_extract(raw, '\\d+') AS DOUBLE) * CASE WHEN contains(raw, 'ha') THEN 100.0 ELSE 1.0 END / CASE WHEN contains(raw, 'm²') OR contains(raw, 'kv') THEN 100.0 ELSE 1.0 END AS land, CAST(regexp_extract(area, '\\d+') AS DOUBLE) * CASE WHEN contains(lower(area), 'sot') THEN 100.0 ELSE 1.0 END AS area FROM r")
def parse_land_area(t: Tables) -> DataFrame:
    return t.sql(LAND, "part").select("k", text.parse_land(F.col("raw")).alias("land"), text.parse_area(F.col("area")).alias("area"))


YES = """SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'var' WHEN 1 THEN 'Yoxdur' WHEN 2 THEN 'Çıxarış var' WHEN 3 THEN 'Təmirli' WHEN 4 THEN 'Təmirsiz' WHEN 5 THEN 'Nəsimili' WHEN 6 THEN ' ' WHEN 7 THEN CAST(NULL AS STRING) ELSE 'bəli, var' END AS raw FROM orders"""


@query(f"WITH r AS ({YES}) SELECT k, CASE raw WHEN 'var' THEN 1.0::DOUBLE WHEN 'Çıxarış var' THEN 1.0::DOUBLE WHEN 'Təmirli' THEN 1.0::DOUBLE WHEN 'bəli, var' THEN 1.0::DOUBLE WHEN 'Yoxdur' THEN 0.0::DOUBLE WHEN 'Təmirsiz' THEN 0.0::DOUBLE END AS yes FROM r")
def parse_yes_no(t: Tables) -> DataFrame:
    return t.sql(YES, "orders").select("k", text.parse_yes_no(F.col("raw")).alias("yes"))


MONEY = """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'USD' WHEN 1 THEN '€' WHEN 2 THEN 'Manat' WHEN 3 THEN 'avro' WHEN 4 THEN 'rub.' ELSE CAST(NULL AS STRING) END AS cur, concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), CASE o_orderkey % 2 WHEN 0 THEN ' $' ELSE '' END) AS price FROM orders"""


@query(f"WITH r AS ({MONEY}), c AS (SELECT k, price, CASE cur WHEN 'USD' THEN 'USD' WHEN '€' THEN 'EUR' WHEN 'Manat' THEN 'AZN' WHEN 'avro' THEN 'EUR' WHEN 'rub.' THEN 'RUB' ELSE CASE WHEN contains(price, '$') THEN 'USD' ELSE 'AZN' END END AS currency FROM r) SELECT k, currency, round(CAST(regexp_extract(price, '\\d+') AS DOUBLE) * CASE currency WHEN 'USD' THEN 1.70::DOUBLE WHEN 'EUR' THEN 1.97::DOUBLE WHEN 'RUB' THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END, 4) AS azn FROM c")
def parse_currency(t: Tables) -> DataFrame:
    d = t.sql(MONEY, "orders").withColumn("currency", text.parse_currency(F.col("cur"), F.col("price")))
    return d.select("k", "currency", F.round(text.parse_number(F.col("price")) * text.rate(F.col("currency")), 4).alias("azn"))


NAMES = "SELECT p_partkey AS k, concat(' ', p_name, ' -- ', CASE p_partkey % 3 WHEN 0 THEN 'Otaq Sayı' WHEN 1 THEN 'Binanın növü' ELSE 'İpoteka' END, '!') AS raw FROM part"


@query(f"WITH r AS ({NAMES}) SELECT k, trim(regexp_replace(lower(strip_accents(replace(replace(raw, 'İ', 'I'), 'ı', 'i'))), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM r")
def normalize_names(t: Tables) -> DataFrame:
    return t.sql(NAMES, "part").select("k", text.normalize_name(F.col("raw")).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS from_json, CAST(json_extract_string(props, '$.k') AS BIGINT) AS from_pairs FROM events")
def parse_json_attrs(t: Tables) -> DataFrame:
    pairs = F.regexp_replace(F.regexp_replace("props", r'[{}"]', ""), ",", ";")
    value = lambda c: F.try_element_at(text.parse_attributes(c), F.lit("k")).cast("bigint")
    return t.events.select("event_id", value(F.col("props")).alias("from_json"), value(pairs).alias("from_pairs"))


TAGGED = "SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(p_type, ' m.* ', p_brand, ' r.*', p_type, ' m.') END AS extra, concat(p_brand, ' r.') AS location FROM part"


@query(f"""WITH r AS ({TAGGED}) SELECT k, CASE WHEN trim(coalesce(extra, '')) = '' THEN lower(location) ELSE lower(trim(string_split(extra, '*')[2])) END AS district,
CASE WHEN trim(coalesce(extra, '')) = '' THEN lower(location) ELSE array_to_string(list_sort(list_distinct(list_transform(string_split(extra, '*'), lambda x: lower(trim(x))))), '|') END AS tags FROM r""")
def extract_tags(t: Tables) -> DataFrame:
    return t.sql(TAGGED, "part").select("k", text.district(F.col("extra"), F.col("location")).alias("district"), text.tags(F.col("extra"), F.col("location")).alias("tags"))


@query("WITH w AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part) SELECT tag, count(*) AS n FROM w WHERE tag <> '' GROUP BY tag")
def tag_counts(t: Tables) -> DataFrame:
    labels = F.array_distinct(text.split_labels(F.replace(F.col("p_name"), F.lit(" "), F.lit("|"))))
    return t.part.select(F.explode(labels).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, sum(CASE WHEN contains(lower(text), 'the ') OR contains(lower(text), 'der ') THEN 1.0 ELSE 0.0 END)::DOUBLE AS with_article, count(*) AS n FROM documents GROUP BY lang")
def keyword_flags(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.sum(text.keyword(F.col("text"), ["the ", "der "])).alias("with_article"), F.count(F.lit(1)).alias("n"))


TIDY = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_mktsegment, ' /  Bağ  evi ') WHEN 1 THEN '   ' WHEN 2 THEN 'Köhnə   tikili' ELSE concat(lower(c_mktsegment), ' q.') END AS raw FROM customer"


@query(f"WITH r AS ({TIDY}), s AS (SELECT k, raw, NULLIF(trim(regexp_replace(regexp_replace(lower(strip_accents(replace(raw, 'ə', 'e'))), '\\s+', ' ', 'g'), '\\s*/\\s*', '/', 'g')), '') AS category FROM r) SELECT k, category, CASE WHEN k % 4 = 3 THEN concat(upper(left(category, 1)), substr(category, 2, length(category) - 4), ' (settlement)') END AS label FROM s")
def tidy_categories(t: Tables) -> DataFrame:
    d = t.sql(TIDY, "customer").withColumn("category", text.tidy(F.col("raw")))
    return d.select("k", "category", F.when(F.col("k") % 4 == 3, text.location_label(F.col("category"))).alias("label"))


@query("SELECT band, count(*) AS n, round(min(o_totalprice), 2) AS low, round(sum(round_even(o_totalprice / 100.0, 0)::DOUBLE * 100.0), 0) AS hundreds FROM (SELECT o_totalprice, CASE WHEN o_totalprice < 75000 THEN '<75k' WHEN o_totalprice < 125000 THEN '75k–125k' WHEN o_totalprice < 200000 THEN '125k–200k' WHEN o_totalprice < 350000 THEN '200k–350k' WHEN o_totalprice < 600000 THEN '350k–600k' ELSE '600k+' END AS band FROM orders) GROUP BY band")
def price_bands(t: Tables) -> DataFrame:
    d = t.orders.select("o_totalprice", numeric.band(F.col("o_totalprice")).alias("band"))
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.sum(numeric.to_hundreds(F.col("o_totalprice"))), 0).alias("hundreds"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t: Tables) -> DataFrame:
    d = t.events.withColumns({"key": F.col("user_id").cast("string"), "at": F.col("ts").cast("string")})
    return d.withColumn("last", clean.latest(d, "key", "at", ["event_id"])).where("last").select("user_id", "event_id", "event_type")


#: Dirty listings made of lineitem: repeated keys, dirty numbers, categories out of scope. Both engines read this text.
LISTINGS = """SELECT concat('/items/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS estate_rel_url, CAST(l_shipdate AS DATE) AS day, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_extendedprice AS ep, l_discount AS di, l_tax AS tx, l_returnflag AS rf, l_linestatus AS ls,
CASE WHEN l_partkey % 50 = 0 THEN CAST(NULL AS STRING) WHEN l_partkey % 47 = 0 THEN '1' ELSE concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), ' ') END AS price,
CASE l_suppkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'AZN' ELSE CAST(NULL AS STRING) END AS currency,
CASE WHEN l_partkey % 31 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' sot') ELSE concat(CAST(CAST(l_quantity AS INT) * 3 AS STRING), ' m²') END AS area,
CAST(l_partkey % 25 AS STRING) AS rooms, concat(CAST(l_partkey % 14 - 3 AS STRING), ' / ', CAST(l_suppkey % 70 AS STRING)) AS floor, concat('4', CAST(l_suppkey % 3 AS STRING), '.5') AS lat, '49.9' AS lng,
CASE l_linenumber WHEN 1 THEN 'Yeni tikili' WHEN 2 THEN 'Köhnə  tikili' WHEN 3 THEN 'Həyət evi / Bağ evi' WHEN 4 THEN 'Torpaq' ELSE 'yeni tikili' END AS kateqoriya,
CASE l_returnflag WHEN 'A' THEN 'Təmirli' WHEN 'N' THEN 'yoxdur' ELSE CAST(NULL AS STRING) END AS repair FROM lineitem"""
ORDER = ["day", "pk", "sk", "q", "ep", "di", "tx", "rf", "ls"]
_STAGED = f"""WITH raw AS ({LISTINGS}),
keyed AS (SELECT *, row_number() OVER (PARTITION BY estate_rel_url ORDER BY day DESC, pk DESC, sk DESC, q DESC, ep DESC, di DESC, tx DESC, rf DESC, ls DESC) = 1 AS latest FROM raw),
parsed AS (SELECT *, CASE WHEN currency = 'USD' THEN 'USD' ELSE 'AZN' END AS cur, CAST(trim(price) AS DOUBLE) * CASE WHEN currency = 'USD' THEN 1.70::DOUBLE ELSE 1.0::DOUBLE END AS price_azn,
CAST(string_split(area, ' ')[1] AS DOUBLE) * CASE WHEN contains(area, 'sot') THEN 100.0 ELSE 1.0 END AS area_m2, CAST(rooms AS DOUBLE) AS r, CAST(string_split(floor, ' / ')[1] AS DOUBLE) AS f, CAST(string_split(floor, ' / ')[2] AS DOUBLE) AS tf, CAST(lat AS DOUBLE) AS la, CAST(lng AS DOUBLE) AS ln,
CASE kateqoriya WHEN 'Torpaq' THEN 'torpaq' WHEN 'Köhnə  tikili' THEN 'kohne tikili' WHEN 'Həyət evi / Bağ evi' THEN 'heyet evi/bag evi' ELSE 'yeni tikili' END AS category, CASE repair WHEN 'Təmirli' THEN 1.0 WHEN 'yoxdur' THEN 0.0 END AS rep FROM keyed),
before AS (SELECT *, CASE WHEN NOT latest THEN 0 WHEN category = 'torpaq' THEN 1 WHEN NOT coalesce(price_azn > 0, false) THEN 2 WHEN NOT coalesce(area_m2 > 0, false) THEN 3 ELSE 4 END AS b FROM parsed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY b, price_azn, area_m2, r, f, tf, la, ln, category ORDER BY day, pk, sk, q, ep, di, tx, rf, ls) AS near, row_number() OVER (PARTITION BY b, cur, price_azn, area_m2, r, f, tf, la, ln, rep, category ORDER BY day, pk, sk, q, ep, di, tx, rf, ls) AS same FROM before),
staged AS (SELECT *, CASE WHEN b < 4 THEN b WHEN same > 1 THEN 4 WHEN near > 1 THEN 5 WHEN price_azn NOT BETWEEN 5000 AND 15000000 THEN 6 WHEN area_m2 NOT BETWEEN 10 AND 3000 THEN 7 WHEN price_azn / area_m2 NOT BETWEEN 30 AND 25000 THEN 8 ELSE 9 END AS step FROM ranked)"""
_CLEANED = f"""{_STAGED}, kept AS (SELECT cur AS currency, price_azn, area_m2, CASE WHEN r BETWEEN 1 AND 20 THEN r END AS rooms, CASE WHEN tf < 1 OR tf > 60 THEN NULL ELSE tf END AS total_floors, f, CASE WHEN la BETWEEN 38.3 AND 41.95 AND ln BETWEEN 44.7 AND 50.9 THEN la END AS lat, CASE WHEN la BETWEEN 38.3 AND 41.95 AND ln BETWEEN 44.7 AND 50.9 THEN ln END AS lng, category, rep AS repair FROM staged WHERE step = 9),
final AS (SELECT *, CASE WHEN f < -2 OR (total_floors IS NOT NULL AND f > total_floors) THEN NULL ELSE f END AS floor FROM kept)"""


def listings(t: Tables) -> DataFrame:
    d = t.sql(LISTINGS, "lineitem")
    return d.withColumn("scraped_at", F.col("day").cast("string"))


@query(f"{_CLEANED} SELECT currency, round(price_azn, 4) AS price_azn, area_m2, rooms, floor, total_floors, lat, lng, category, repair::DOUBLE AS repair FROM final")
def clean_listings(t: Tables) -> DataFrame:
    d = clean.clean(listings(t), ORDER)
    return d.select("currency", F.round("price_azn", 4).alias("price_azn"), "area_m2", "rooms", "floor", "total_floors", "lat", "lng", "category", "repair")


@query(f"{_STAGED} SELECT s.k::INTEGER AS step_no, s.name AS step, count(*) FILTER (WHERE step >= s.k) AS n_rows FROM staged, (VALUES {', '.join(f'({k}, {n!r})' for k, n in enumerate(clean.STEPS))}) s(k, name) GROUP BY ALL")
def cleaning_log(t: Tables) -> DataFrame:
    return clean.cleaning_log(listings(t), ORDER)


@query(f"{_CLEANED} SELECT unnest(['rooms', 'floor', 'total_floors', 'lat']) AS \"column\", unnest([round_even(avg((rooms IS NULL)::INT), 4)::DOUBLE, round_even(avg((floor IS NULL)::INT), 4)::DOUBLE, round_even(avg((total_floors IS NULL)::INT), 4)::DOUBLE, round_even(avg((lat IS NULL)::INT), 4)::DOUBLE]) AS share FROM final")
def missing_share(t: Tables) -> DataFrame:
    return clean.missing_share(clean.clean(listings(t), ORDER).select("rooms", "floor", "total_floors", "lat"))
