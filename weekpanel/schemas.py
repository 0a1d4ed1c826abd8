"""Explicit schemas: no source is ever read with inference, so county codes keep their leading zeros."""

from pyspark.sql import types as T

# Column names and orders of the files that are read and written.


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LONG, TEXT, DOUBLE, WHEN = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType()

_MESSAGE_FIELDS = (
    ("message_id", LONG),
    ("user_id", LONG),
    ("message", TEXT),
    ("created_at", TEXT),
    ("location", TEXT),
    ("coordinates", TEXT),
)

MESSAGES_RAW = _struct(*_MESSAGE_FIELDS)
MESSAGES_KEYED = _struct(("user_year_week", TEXT), *_MESSAGE_FIELDS)
USER_COUNTY = _struct(("user_id", LONG), ("cnty", TEXT))
SAMPLED = _struct(
    ("user_year_week", TEXT),
    ("user_id", LONG),
    ("message_id", LONG),
    ("message", TEXT),
    ("created_at", WHEN),
    ("location", TEXT),
    ("coordinates", TEXT),
    ("fips", TEXT),
)
USER_WEEK_EMBEDDINGS = _struct(
    ("user_year_week", TEXT),
    ("user_id", LONG),
    ("message_count", LONG),
    ("embedding", T.ArrayType(T.ArrayType(DOUBLE))),
    ("fips", TEXT),
)
SCORES = _struct(
    ("user_year_week", TEXT),
    ("user_id", LONG),
    ("fips", TEXT),
    ("dep_score", DOUBLE),
    ("anx_score", DOUBLE),
    ("scaled_dep_score", DOUBLE),
    ("scaled_anx_score", DOUBLE),
)
USER_WEIGHTS = _struct(("user_id", LONG), ("weight", DOUBLE), ("cnty", TEXT))
COUNTY_EMBEDDINGS = _struct(
    ("fips", TEXT), ("embedding", T.ArrayType(DOUBLE)), ("weighted_embedding", T.ArrayType(DOUBLE))
)
MODEL = _struct(
    ("target", TEXT),
    ("pos", T.IntegerType()),
    ("feature", TEXT),
    ("mean", DOUBLE),
    ("scale", DOUBLE),
    ("coef", DOUBLE),
    ("intercept", DOUBLE),
)
FEATURE_TABLE = _struct(
    ("id", LONG), ("group_id", TEXT), ("value", DOUBLE), ("feat", TEXT), ("group_norm", DOUBLE)
)
