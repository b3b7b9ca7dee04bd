"""Generated listing tables: a clean one for models, a dirty one for the cleaning. Rows follow from their number alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.numeric import uniform


def _u(name: int) -> Column:
    return uniform(name, F.col("id"))


def _pick(name: int, values: list[str | None]) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), F.floor(_u(name) * len(values)).cast("int"))


def homes(spark: SparkSession, n: int) -> DataFrame:
    """row_id, area, rooms, price: price grows with area, with noise."""
    d = spark.range(n).withColumn("area", 30 + F.floor(_u(1) * 170)).withColumn("rooms", 1 + F.floor(F.col("area") / 45 + _u(2) * 2))
    price = F.exp(F.lit(7.0) + F.ln("area") + (_u(3) - 0.5) * 0.4 + F.col("rooms") * 0.03)
    return d.select(F.col("id").alias("row_id"), F.col("area").cast("double").alias("area"), F.col("rooms").cast("double").alias("rooms"), price.alias("price"))


def listings(spark: SparkSession, n: int) -> DataFrame:
    """All strings, as scraped: missing and absurd prices, sot areas, repeats with a later scrape, out-of-scope rows."""
    d = spark.range(n).withColumn("rep", F.explode(F.when(_u(9) < 0.1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    area = (30 + F.floor(_u(1) * 170)).cast("int")
    price = F.floor(area * (900 + _u(3) * 2500)).cast("long")
    grouped = F.concat(F.floor(price / 1000).cast("string"), F.lit(" "), F.lpad((price % 1000).cast("string"), 3, "0"))
    out = {
        "price": F.when(_u(4) < 0.005, F.lit(None)).when(_u(4) < 0.01, "1").otherwise(grouped),
        "currency": F.when(_u(5) < 0.08, "USD").otherwise("AZN"),
        "unit_price": F.lit("2 150 AZN/m²"),
        "estate_rel_url_x": F.concat(F.lit("/items/"), F.col("id").cast("string")),
        "datetime_scrape_x": F.when(F.col("rep") == 1, "2023-06-18 07:45:00").otherwise("2023-05-02 19:20:00"),
        "location": _pick(6, ["Nəsimi r.", "Yasamal r.", "28 May m.", "Xırdalan ş."]),
        "extra_info": _pick(7, ["28 May m.* Nəsimi r.", "Elmlər m.* Yasamal r.", None]),
        "city": _pick(8, ["Bakı", "Bakı", "Bakı", "Xırdalan"]),
        "Kateqoriya": _pick(10, ["Yeni tikili", "Köhnə tikili", "Həyət evi / Bağ evi", "Torpaq"]),
        "Sahə": F.when(_u(11) < 0.005, "7 900 m²").otherwise(F.concat(area.cast("string"), F.lit(" m²"))),
        "Otaq sayı": F.when(_u(12) < 0.04, F.lit(None)).otherwise((1 + F.floor(area / 45)).cast("string")),
        "Mərtəbə": F.when(_u(13) < 0.005, "17 / 6").otherwise(F.concat((1 + F.floor(_u(14) * 9)).cast("string"), F.lit(" / 9"))),
        "Təmir": _pick(15, ["var", "yoxdur", None]),
        "lat": F.when(_u(16) < 0.03, F.lit(None)).otherwise(F.round(40.3 + _u(17) * 0.2, 5).cast("string")),
        "lng": F.when(_u(16) < 0.03, F.lit(None)).otherwise(F.round(49.7 + _u(18) * 0.4, 5).cast("string")),
        "description": _pick(19, ["metro yaxınlığı. mebel", "dəniz mənzərəsi", "təcili satılır", None]),
        "owner_name": F.lit("x"),
        "vip": F.lit("true"),
    }
    return d.select(*(c.cast("string").alias(k) for k, c in out.items()))
