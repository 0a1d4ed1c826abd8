"""The library's inputs, derived from the given tables by SQL that both engines run as it stands."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from weekpanel import session
from weekpanel.operators.score import Model, collect_models
from weekpanel.plans import cleaning

# Bands that fit the given events, whose user-weeks hold at most some 30 messages.
ACTIVE = (5, 14)
SUPER_FROM = 15
EDGES = {"1-4": (1, 4), "5-14": ACTIVE, "15+": (SUPER_FROM, None)}
BATCH_LIMIT = 100
N_LAYERS, DIM = 4, 16
YEAR = 2024

# Null ids, duplicate ids with different rows, retweets, URLs, mentions.
MESSAGES = """
SELECT CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 11 = 1 THEN event_id - 1 ELSE event_id END AS message_id,
 user_id,
 CASE event_id % 8 WHEN 0 THEN 'RT @user' || CAST(user_id AS STRING) || ': ' || event_type
  WHEN 1 THEN 'see http://ex.com/' || CAST(event_id AS STRING)
  WHEN 2 THEN 'hi @user' || CAST(user_id AS STRING) || ' ' || event_type
  ELSE event_type || ' ' || props END AS message,
 ts AS created_at, event_type AS location, props AS coordinates FROM {events}
"""

# The same with a text time: some null, some that are no time.
MESSAGES_TEXT = f"""
SELECT message_id, user_id, message,
 CASE WHEN message_id % 103 = 7 THEN NULL WHEN message_id % 101 = 5 THEN 'junk' ELSE CAST(created_at AS STRING) END
  AS created_at, location, coordinates FROM ({MESSAGES}) m
"""

# Ready-made keys with the week first.
MESSAGES_KEYED = f"""
SELECT CAST(year(created_at) AS STRING) || '_' || lpad(CAST(weekofyear(created_at) AS STRING), 2, '0') || ':'
 || CAST(user_id AS STRING) AS user_year_week, message_id, user_id, message, created_at, location, coordinates
 FROM ({MESSAGES}) m
"""

# Whole texts of documents and conversations as messages: long, with every kind of character.
LONG_MESSAGES = """
SELECT doc_id AS message_id, doc_id % 50 AS user_id, text AS message FROM {documents}
UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, conv_id % 50, text || ' @' || role || ' a@b.com' FROM {conversations}
UNION ALL SELECT 2000000000 + page_id, page_id % 50, 'see ' || url FROM {pages}
UNION ALL SELECT 3000000000 + page_id, page_id % 50, 'RT @' || split_part(url, '/', 3) || ': ' || html FROM {pages}
"""

# Documents as cleaned messages of 400 user-weeks of 100 users; ids in a run, and far apart for every third document.
DELIVERED = """
SELECT CAST(2024 AS STRING) || '_' || lpad(CAST(1 + doc_id % 4 AS STRING), 2, '0') || ':' || CAST(doc_id % 100 AS STRING) AS user_year_week,
 doc_id % 100 AS user_id, CASE WHEN doc_id % 3 = 0 THEN 1000000007 * doc_id ELSE doc_id END AS message_id, text AS message,
 CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at, lang AS location, source AS coordinates,
 lpad(CAST(1001 + doc_id % 70 AS STRING), 5, '0') AS fips FROM {documents}
"""

# Valid, four-digit and non-numeric codes; every tenth row names no user, so some users are not mapped.
USER_COUNTY = """
SELECT CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_custkey END AS user_id, CASE WHEN c_custkey % 13 = 0 THEN CAST(1001 + c_nationkey AS STRING)
 WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE lpad(CAST(1001 + 2 * c_nationkey AS STRING), 5, '0') END AS cnty
 FROM {customer}
"""

# The same, but some users have two counties.
USER_COUNTIES = (
    USER_COUNTY
    + """UNION ALL SELECT c_custkey, lpad(CAST(1003 + 2 * c_nationkey AS STRING), 5, '0') FROM {customer} WHERE c_custkey % 19 = 3
"""
)

# The same with null codes and codes that lost their leading zero.
COUNTY_CODES = """
SELECT c_custkey AS user_id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(1001 + c_nationkey AS STRING)
 WHEN 2 THEN 'n/a' WHEN 3 THEN lpad(CAST(c_nationkey AS STRING), 6, '0')
 ELSE lpad(CAST(1001 + 2 * c_nationkey AS STRING), 5, '0') END AS fips FROM {customer}
"""

# A third of the rows name no user, so a third of the users have no weight; some weights are null, and some users have two.
USER_WEIGHTS = """
SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS user_id,
 CASE WHEN c_custkey % 11 = 4 THEN NULL ELSE CAST(0.5 + (c_custkey % 7) * 0.25 AS DOUBLE) END AS weight FROM {customer}
UNION ALL SELECT c_custkey, CAST(0.75 AS DOUBLE) FROM {customer} WHERE c_custkey % 23 = 5
"""

_EMBEDDINGS = """
SELECT CAST(2024 AS STRING) || '_' || lpad(CAST(vec_id % 4 + 1 AS STRING),2,'0') || ':' || CAST(vec_id AS STRING) AS user_year_week,
 vec_id AS user_id, CAST(10 + vec_id % 20 AS BIGINT) AS message_count, @@ AS embedding,
 lpad(CAST(1001 + 2 * label AS STRING), 5, '0') AS fips FROM {embeddings}
"""
# The whole vector: four layers of a quarter each; every 25th row has one layer of all components.
_LAYERS_SPARK = f"""CASE WHEN vec_id % 25 = 0 THEN array(embedding)
 ELSE array({",".join(f"slice(embedding,{1 + i * DIM},{DIM})" for i in range(N_LAYERS))}) END"""
_LAYERS_DUCKDB = f"""CASE WHEN vec_id % 25 = 0 THEN [embedding]
 ELSE [{",".join(f"embedding[{1 + i * DIM}:{(i + 1) * DIM}]" for i in range(N_LAYERS))}] END"""
EMBEDDINGS_SPARK = _EMBEDDINGS.replace("@@", _LAYERS_SPARK)
EMBEDDINGS_DUCKDB = _EMBEDDINGS.replace("@@", _LAYERS_DUCKDB)

# One embedding per event, with the week and the county of its user.
MESSAGE_VECTORS = """
SELECT e.event_id AS message_id, e.user_id, e.user_year_week, v.embedding,
 lpad(CAST(1001 + 2 * c.c_nationkey AS STRING), 5, '0') AS fips, CAST(1 + c.c_custkey % 4 AS DOUBLE) AS weight
 FROM (SELECT event_id, user_id, event_id % (SELECT count(*) FROM {embeddings}) AS vec_id,
  CAST(year(ts) AS STRING) || '_' || lpad(CAST(weekofyear(ts) AS STRING), 2, '0') || ':' || CAST(user_id AS STRING)
   AS user_year_week FROM {events}) e
 JOIN {embeddings} v ON v.vec_id = e.vec_id JOIN {customer} c ON c.c_custkey = e.user_id
"""

# Model of 17 features per target; the last does not exist in a layer of 16.
_MODEL = """
SELECT '@target' AS target, CAST(i AS INT) AS pos, CAST(i AS STRING) || 'me' AS feature,
 CAST(0.001 * i AS DOUBLE) AS mean, CAST(1 + 0.01 * i AS DOUBLE) AS scale,
 CAST(@coef AS DOUBLE) AS coef, CAST(@intercept AS DOUBLE) AS intercept FROM range(17) AS r(i)
"""


def _model(target: str, coef: str, intercept: str) -> str:
    return _MODEL.replace("@target", target).replace("@coef", coef).replace("@intercept", intercept)


MODEL = (
    _model("dep_score", "((i % 5) - 2) * 0.1", "2.5")
    + " UNION ALL "
    + _model("anx_score", "((i % 3) - 1) * 0.2", "1.25")
)

# County vectors by label. Missing counties: other codes without their leading zero, each of them many times.
BASE_COUNTIES = """
SELECT lpad(CAST(1001 + 2 * label AS STRING), 5, '0') AS fips, vec_id, embedding FROM {embeddings}
"""
MISSING_COUNTIES = """
SELECT CAST(1002 + 2 * label AS STRING) AS fips, vec_id, embedding FROM {embeddings}
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Common table expressions of the oracle, in the order in which they build on each other.
SQL_INPUTS = {
    "messages": MESSAGES,
    "messages_text": MESSAGES_TEXT,
    "messages_keyed": MESSAGES_KEYED,
    "long_messages": LONG_MESSAGES,
    "documents_sent": DELIVERED,
    "user_county": USER_COUNTY,
    "user_counties": USER_COUNTIES,
    "county_codes": COUNTY_CODES,
    "user_weights": USER_WEIGHTS,
    "user_weeks": EMBEDDINGS_DUCKDB,
    "message_vectors": MESSAGE_VECTORS,
    "model": MODEL,
    "base_counties": BASE_COUNTIES,
    "missing_counties": MISSING_COUNTIES,
}


def duckdb_text(template: str) -> str:
    return template.format(**{name: name for name in TABLES}).strip()


class Inputs:
    """The adapters as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = session.apply(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, template: str) -> DataFrame:
        used = {name: self.table(name) for name in TABLES if "{" + name + "}" in template}
        return self.spark.sql(template, **used) if used else self.spark.sql(template)

    @cached_property
    def messages(self) -> DataFrame:
        return self.sql(MESSAGES)

    @cached_property
    def messages_text(self) -> DataFrame:
        return self.sql(MESSAGES_TEXT)

    @cached_property
    def messages_keyed(self) -> DataFrame:
        return self.sql(MESSAGES_KEYED)

    @cached_property
    def long_messages(self) -> DataFrame:
        return self.sql(LONG_MESSAGES)

    @cached_property
    def documents_sent(self) -> DataFrame:
        return self.sql(DELIVERED)

    @cached_property
    def user_county(self) -> DataFrame:
        return self.sql(USER_COUNTY)

    @cached_property
    def user_counties(self) -> DataFrame:
        return self.sql(USER_COUNTIES)

    @cached_property
    def county_codes(self) -> DataFrame:
        return self.sql(COUNTY_CODES)

    @cached_property
    def user_weights(self) -> DataFrame:
        return self.sql(USER_WEIGHTS)

    @cached_property
    def user_weeks(self) -> DataFrame:
        return self.sql(EMBEDDINGS_SPARK)

    @cached_property
    def message_vectors(self) -> DataFrame:
        return self.sql(MESSAGE_VECTORS)

    @cached_property
    def models(self) -> dict[str, Model]:
        return collect_models(self.sql(MODEL))

    @cached_property
    def base_counties(self) -> DataFrame:
        return self.sql(BASE_COUNTIES)

    @cached_property
    def missing_counties(self) -> DataFrame:
        return self.sql(MISSING_COUNTIES)

    def cleaned(self, **options) -> DataFrame:
        """Cleaned messages with ready-made keys."""
        return cleaning.clean_messages(self.messages_keyed, self.user_county, **options)
