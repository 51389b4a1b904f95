"""Rasters out of plain tables, by formulas that SQL has too: the inputs of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(e: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5 + 0.5))).cast("int")


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 gray image of each embedding: img_id (bigint), width, height, x, y, v."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("img_id", F.lit(8).alias("width"), F.lit(8).alias("height"), (F.col("p") % 8).cast("int").alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), _q(F.col("e")).alias("v"))


def gray_rgba(px: DataFrame) -> DataFrame:
    """Gray as opaque RGBA."""
    v = F.col("v")
    return px.select("img_id", "width", "height", "x", "y", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))


def rgba4(spark: SparkSession, sf_dir: str, mixed_alpha: bool = False) -> DataFrame:
    """A 4x4 RGBA image of each embedding; mixed_alpha makes some pixels opaque and some void."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    c = [_q(F.get("embedding", F.col("k") * 4 + i)).alias(n) for i, n in enumerate("rgba")]
    px = e.select("img_id", F.lit(4).alias("width"), F.lit(4).alias("height"), (F.col("k") % 4).cast("int").alias("x"), F.floor(F.col("k") / 4).cast("int").alias("y"), *c)
    if mixed_alpha:
        m = (F.col("x") + F.col("y")) % 4
        px = px.withColumn("a", F.when(m == 0, 255).when(m == 2, 0).otherwise(F.col("a")))
    return px


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sparse images of 50 x 83 from lineitem, one a pair of flags."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("img_id"),
        (F.col("l_quantity") - 1).cast("int").alias("x"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("y"),
    ).agg(
        F.least(F.lit(255), F.count("*") * 40).cast("int").alias("r"),
        F.least(F.lit(255), F.floor(F.max("l_extendedprice") / 400)).cast("int").alias("g"),
        (F.sum("l_linenumber") % 256).cast("int").alias("b"),
    )
    return g.select("img_id", F.lit(50).alias("width"), F.lit(83).alias("height"), "x", "y", "r", "g", "b", F.lit(255).alias("a"))


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dense class images of 24 x 31 from events: img_id, width, height, x (hour), y (day), n, class."""
    ev = table(spark, sf_dir, "events")
    n = ev.groupBy("event_type", F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y")).agg(F.count("*").alias("n"))
    grid = ev.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("x")).select("event_type", "x", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("y"))
    both = grid.join(n, ["event_type", "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select(F.col("event_type").alias("img_id"), F.lit(24).alias("width"), F.lit(31).alias("height"), "x", "y", "n", F.least("n", F.lit(2)).cast("int").alias("class"))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as animations: anim_id, frame, delay_ms (0 is no delay given)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("anim_id"), F.col("turn").alias("frame"), (F.length("text") % 200).cast("int").alias("delay_ms"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour texts of six notations: p_partkey, css."""
    k = F.col("p_partkey")
    v = (k * 2654435761) % 16777216
    six = F.lpad(F.lower(F.hex(v)), 6, "0")
    r, g, b = F.shiftright(v, 16), F.shiftright(v, 8).bitwiseAND(F.lit(255)), v.bitwiseAND(F.lit(255))
    names = F.array(*[F.lit(x) for x in ("black", "white", "red", "tomato", "gray", "transparent", "none")])
    css = (
        F.when(k % 6 == 0, F.concat(F.lit("#"), six))
        .when(k % 6 == 1, F.concat(F.lit("#"), F.substring(six, 1, 3)))
        .when(k % 6 == 2, F.concat(F.lit(" #"), F.upper(six), F.lit("80")))
        .when(k % 6 == 3, F.concat(F.lit("rgb("), r, F.lit(", "), g, F.lit(", "), b, F.lit(")")))
        .when(k % 6 == 4, F.concat(F.lit("rgba("), r, F.lit(" "), g, F.lit(" "), (b % 101), F.lit("% / 50%)")))
        .otherwise(F.get(names, (k % 7).cast("int")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", css.alias("css"))
