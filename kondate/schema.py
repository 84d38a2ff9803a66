"""Row types of the catalog."""

from __future__ import annotations

from pyspark.sql import types as T

TEXTS = ("id", "store", "name", "category", "unit", "url", "checked", "note")
NUMBERS = ("p", "f", "c", "kcal", "price")

PRODUCT = T.StructType([T.StructField(k, T.StringType()) for k in TEXTS] + [T.StructField(k, T.DoubleType()) for k in NUMBERS] + [T.StructField("auto", T.BooleanType())])
#: A bundle with its owner, as a line holds it.
BUNDLE = T.StructType([T.StructField("owner", T.StringType()), T.StructField("catalog", T.ArrayType(PRODUCT)), T.StructField("favorites", T.ArrayType(T.StringType())), T.StructField("cart", T.MapType(T.StringType(), T.DoubleType()))])
PAGE = "url string, html string"
_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())])
_HEADING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("offset", T.IntegerType())])
#: Not as text, since workers that import a UDF of this type have no session to read it with.
PARSED = T.StructType([T.StructField("title", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(_LINK)), T.StructField("headings", T.ArrayType(_HEADING)), T.StructField("fault", T.StringType())])
POI = "type string, id string, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
CART = "cart_id string, product_id string, qty double"
FAVORITE = "user_id string, product_id string"
FRONTIER = "store string, url string, depth int, seq long"
OUTCOME = "store string, url string, kind string, outcome string, reason string, seq long"
