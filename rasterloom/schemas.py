"""Schemas of the relations. A raster is a set of pixel rows; width and height travel with every pixel, so no operator joins to learn them."""

from pyspark.sql import types as T

PIXEL = T.StructType(
    [T.StructField("img_id", T.StringType(), False), *[T.StructField(c, T.IntegerType(), False) for c in ("width", "height", "x", "y", "r", "g", "b", "a")]]
)
#: One encoded or packed image a row.
RASTER = T.StructType(
    [T.StructField("img_id", T.StringType(), False), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())]
)
COMPONENT = "img_id string, comp int, class int, area long, x0 int, y0 int, x1 int, y1 int"
CHANNELS = ("r", "g", "b", "a")
