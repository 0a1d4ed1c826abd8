"""One query per operator, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import ACTIVE, BATCH_LIMIT, DIM, EDGES, N_LAYERS, SUPER_FROM, YEAR, Inputs
from checks.oracle import KEYED, MASKED, RETWEET, SAMPLED, URL, with_chains
from weekpanel import schemas
from weekpanel.fixed_values import SCORE_FEATURES
from weekpanel.operators import activity, batches, calendar, clean, embed, features, membership, ranking, rollup, score, sketches
from weekpanel.plans import cleaning, county_weeks, feature_export, incremental, panel, scoring
from weekpanel.session import shared_folder, stage
from weekpanel.sources import readers, writers
from weekpanel.sources.deliveries import Deliveries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEY = "user_year_week"
SCORE_COLUMNS = ("dep_score", "anx_score", "scaled_dep_score", "scaled_anx_score")
PRIOR_BEFORE = "2024-01-11 00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], Callable]:
    """Register a query over :class:`Inputs` under ``name`` with its oracle."""

    def register(run: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, folder: run(Inputs(spark, folder))
        if sql is not None:
            ORACLE[name] = with_chains(sql)
        return run

    return register


# -- output forms that both engines share ---------------------------------------------------------------------------


def rounded(col: str | Column) -> Column:
    return F.round(col, 6) + F.lit(0.0)


def r6(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def sampled(df: DataFrame) -> DataFrame:
    """The columns of a batch; time without zone, as the given tables have it."""
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def components(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """One row per component, so that arrays are compared as numbers."""
    exploded = df.select(*keys, F.posexplode(col).alias("pos", "value"))
    return exploded.withColumn("value", rounded(F.col("value").cast("double")))


def scratch(t: Inputs, label: str) -> str:
    folder = shared_folder(t.spark)
    return f"{folder}/checks-{t.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def prior(t: Inputs) -> DataFrame:
    """An earlier delivery: the cleaned messages up to a date, one batch per week."""
    early = t.cleaned().filter(F.col("created_at") < F.lit(PRIOR_BEFORE))
    return stage(early.withColumn("batch", (F.weekofyear("created_at") - 1).cast("bigint")), "prior")


def layered(t: Inputs) -> DataFrame:
    return embed.valid_layers(t.user_weeks, N_LAYERS, DIM)


def vectors_of(t: Inputs) -> DataFrame:
    return embed.flatten_layers(embed.pick_layer(layered(t)))


def scores_of(t: Inputs) -> DataFrame:
    return scoring.score_user_weeks(t.user_weeks, t.models, n_layers=N_LAYERS, dim=DIM)


def weighted_of(t: Inputs) -> DataFrame:
    return county_weeks.weighted_scores(scores_of(t), t.user_weights)


def homes_of(t: Inputs) -> DataFrame:
    """Scores beside the home county of their user."""
    return scores_of(t).join(t.user_county, "user_id", "left").select(KEY, "user_id", "fips", "cnty")


def county_means(t: Inputs) -> DataFrame:
    return embed.mean_embedding(t.base_counties, ["fips"]).select("fips", "embedding")


def missing_counties(t: Inputs) -> DataFrame:
    """Raw copies, every other one without a vector; of the others of a county all are equal."""
    rows = t.missing_counties.withColumn("embedding", F.col("embedding").cast("array<double>"))
    first = features.dedupe_counties(rows, order=["vec_id"])
    empty = rows.select("fips", F.array().cast("array<double>").alias("embedding"))
    return first.select("fips", "embedding").unionByName(empty)


# -- sources and sinks ----------------------------------------------------------------------------------------------


@query(
    "read_messages",
    "SELECT user_year_week, message_id, user_id, message, created_at, location, coordinates FROM messages_keyed",
)
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "keyed")
    writers.write_csv(t.messages_keyed.withColumn("created_at", F.col("created_at").cast("string")), path, header=False)
    return sampled(clean.parse_created_at(readers.read_messages(t.spark, path, keyed=True)))


@query(
    "read_messages_raw",
    "SELECT message_id, user_id, message, TRY_CAST(created_at AS TIMESTAMP) AS created_at, location, coordinates FROM messages_text",
)
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "raw")
    writers.write_csv(t.messages_text, path, header=False)
    return sampled(clean.parse_created_at(readers.read_messages(t.spark, f"{path}/*.csv", keyed=False)))


@query("read_user_county", "SELECT user_id, cnty FROM user_county")
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "counties")
    writers.write_csv(t.user_county, path)
    return readers.read_user_county(t.spark, path)


@query(
    "read_scores",
    f"SELECT user_year_week, user_id, fips, {', '.join(f'{r6(c)} AS {c}' for c in SCORE_COLUMNS)} FROM scores",
)
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "scores")
    writers.write_csv(scores_of(t), path, files=1)
    return readers.read_scores(t.spark, path).withColumns({c: rounded(c) for c in SCORE_COLUMNS})


@query("read_weights", "SELECT user_id, weight FROM user_weights")
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "weights")
    writers.write_csv(t.user_weights, path)
    return readers.read_weights(t.spark, path)


@query(
    "read_embeddings",
    f"""SELECT user_year_week, CAST(layer AS INT) AS layer, CAST(generate_subscripts(part, 1) - 1 AS INT) AS pos,
 {r6('unnest(part)')} AS value FROM (SELECT user_year_week, unnest(embedding) AS part,
 generate_subscripts(embedding, 1) - 1 AS layer FROM user_weeks) u""",
)
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "embeddings")
    t.user_weeks.write.parquet(path)
    layers = readers.read_embeddings(t.spark, f"{path}/*.parquet").select(KEY, F.posexplode("embedding").alias("layer", "part"))
    return components(layers, [KEY, "layer"], "part")


def delivered(t: Inputs) -> DataFrame:
    """All cleaned messages, one batch per week, written and read again."""
    path = scratch(t, "batches")
    writers.write_batches(t.cleaned().withColumn("batch", (F.weekofyear("created_at") - 1).cast("bigint")), path)
    return readers.read_batches(t.spark, path)


@query("read_batches", f"SELECT {SAMPLED}, CAST(week(created_at) - 1 AS BIGINT) AS batch FROM cleaned")
def _(t: Inputs) -> DataFrame:
    return sampled(delivered(t))


@query(
    "write_batches",
    "SELECT batch, count(*) AS messages, count(DISTINCT user_year_week) AS user_weeks FROM assigned JOIN cleaned USING (user_year_week) GROUP BY batch",
)
def _(t: Inputs) -> DataFrame:
    path, cleaned = scratch(t, "batches"), t.cleaned()
    counts = activity.week_counts(cleaned).filter(activity.in_band(F.col("message_count"), *ACTIVE))
    writers.write_batches(batches.batch_members(cleaned, batches.assign_batches(counts, BATCH_LIMIT)), path)
    return batches.batch_summary(readers.read_batches(t.spark, path))


@query("write_superusers", "SELECT user_id FROM heavy")
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "heavy")
    writers.write_superusers(activity.superusers(t.cleaned(texts=False), SUPER_FROM), path)
    return t.spark.read.parquet(path)


@query("write_week_counts", "SELECT user_year_week, message_count FROM counts")
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "counts")
    writers.write_week_counts(activity.week_counts(t.cleaned(texts=False)), path)
    return t.spark.read.schema("user_year_week string, message_count bigint").option("header", True).csv(path)


@query(
    "write_corrected_timestamps",
    "SELECT message_id, created_at FROM cleaned",
)
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "times")
    writers.write_batches(t.cleaned().withColumn("batch", F.lit(0)), path)
    return sampled(readers.read_batches(t.spark, path)).select("message_id", "created_at")


# -- filters, projections, scalar functions -------------------------------------------------------------------------


@query("require_keys", f"SELECT message_id, user_id, message, created_at FROM messages_text WHERE {KEYED}")
def _(t: Inputs) -> DataFrame:
    return clean.require_keys(t.messages_text).select("message_id", "user_id", "message", "created_at")


@query("mask_mentions", f"SELECT message_id, user_id, {MASKED} AS message FROM long_messages")
def _(t: Inputs) -> DataFrame:
    return clean.mask_mentions(t.long_messages)


@query("drop_retweets", f"SELECT message_id, user_id, message FROM long_messages WHERE NOT {RETWEET}")
def _(t: Inputs) -> DataFrame:
    return clean.drop_retweets(t.long_messages)


@query("drop_urls", f"SELECT message_id, user_id, message FROM long_messages WHERE NOT {URL}")
def _(t: Inputs) -> DataFrame:
    return clean.drop_urls(t.long_messages)


@query("county_valid", "SELECT user_id, fips FROM county_codes WHERE regexp_matches(fips, '^[0-9]{5}$')")
def _(t: Inputs) -> DataFrame:
    return clean.county_valid(t.county_codes)


@query("county_invalid", "SELECT user_id, fips FROM county_codes WHERE NOT regexp_matches(fips, '^[0-9]{5}$')")
def _(t: Inputs) -> DataFrame:
    return clean.county_invalid(t.county_codes)


@query("county_short", "SELECT user_id, fips FROM county_codes WHERE regexp_matches(fips, '^[0-9]{1,4}$')")
def _(t: Inputs) -> DataFrame:
    return clean.county_short(t.county_codes)


@query(
    "parse_created_at",
    "SELECT message_id, user_id, TRY_CAST(created_at AS TIMESTAMP) AS created_at FROM messages_text",
)
def _(t: Inputs) -> DataFrame:
    return sampled(clean.parse_created_at(t.messages_text)).select("message_id", "user_id", "created_at")


@query(
    "calendar_parts",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_only, CAST(year(o_orderdate) AS INT) AS year,
 CAST(week(o_orderdate) AS INT) AS week FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    parts = calendar.calendar_parts(t.table("orders"), col="o_orderdate")
    return parts.select("o_orderkey", F.col("date_only").cast("string").alias("date_only"), "year", "week")


@query(
    "calendar_parts_iso",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_only, CAST(isoyear(o_orderdate) AS INT) AS year,
 CAST(week(o_orderdate) AS INT) AS week FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    parts = calendar.calendar_parts(t.table("orders"), "iso", "o_orderdate")
    return parts.select(
        "o_orderkey", F.col("date_only").cast("string").alias("date_only"), F.col("year").cast("int").alias("year"), "week"
    )


@query("in_year", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1997")
def _(t: Inputs) -> DataFrame:
    return calendar.in_year(t.table("orders"), 1997, "o_orderdate").select("o_orderkey", "o_orderdate")


ORDERS_KEYED = "o_orderkey, o_custkey AS user_id, year(o_orderdate) AS year, week(o_orderdate) AS week FROM orders"


def order_weeks(t: Inputs) -> DataFrame:
    return calendar.calendar_parts(t.table("orders").withColumnRenamed("o_custkey", "user_id"), col="o_orderdate")


@query(
    "build_key",
    f"""SELECT o_orderkey, CAST(user_id AS VARCHAR) || ':' || CAST(year AS VARCHAR) || '-' || CAST(week AS VARCHAR)
 AS user_year_week FROM (SELECT {ORDERS_KEYED}) o""",
)
def _(t: Inputs) -> DataFrame:
    return calendar.build_key(order_weeks(t)).select("o_orderkey", KEY)


@query(
    "build_key_week_first",
    f"""SELECT o_orderkey, CAST(year AS VARCHAR) || '_' || lpad(CAST(week AS VARCHAR), 2, '0') || ':'
 || CAST(user_id AS VARCHAR) AS user_year_week FROM (SELECT {ORDERS_KEYED}) o""",
)
def _(t: Inputs) -> DataFrame:
    return calendar.build_key(order_weeks(t), calendar.WEEK_FIRST).select("o_orderkey", KEY)


@query(
    "split_key",
    f"""SELECT o_orderkey, user_id AS key_user, CAST(year AS INT) AS key_year, CAST(week AS INT) AS key_week
 FROM (SELECT {ORDERS_KEYED}) o""",
)
def _(t: Inputs) -> DataFrame:
    keyed = calendar.build_key(order_weeks(t))
    return calendar.split_key(keyed).select("o_orderkey", "key_user", "key_year", "key_week")


@query(
    "split_key_week_first",
    """SELECT message_id, user_id AS key_user, CAST(year(created_at) AS INT) AS key_year, CAST(week(created_at) AS INT) AS key_week
 FROM messages_keyed""",
)
def _(t: Inputs) -> DataFrame:
    return calendar.split_key(t.messages_keyed, calendar.WEEK_FIRST).select("message_id", "key_user", "key_year", "key_week")


@query(
    "county_week_key",
    "SELECT message_id, split_part(user_year_week, ':', 1) || '_' || fips AS year_week_county FROM unique_messages",
)
def _(t: Inputs) -> DataFrame:
    return calendar.county_week_key(t.cleaned(county=None)).select("message_id", "year_week_county")


@query(
    "county_week_key_user_first",
    f"""SELECT o_orderkey, CAST(year AS VARCHAR) || '-' || CAST(week AS VARCHAR) || '_' || c_nationkey AS year_week_county
 FROM (SELECT {ORDERS_KEYED}) o JOIN customer ON c_custkey = user_id""",
)
def _(t: Inputs) -> DataFrame:
    homes = t.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("string").alias("fips"))
    keyed = calendar.build_key(order_weeks(t)).join(homes, "user_id")
    return calendar.county_week_key(keyed, layout=calendar.USER_FIRST).select("o_orderkey", "year_week_county")


@query(
    "rename_columns",
    "SELECT user_year_week, user_id, fips AS group_id, weight AS user_weight FROM scores LEFT JOIN user_weights USING (user_id)",
)
def _(t: Inputs) -> DataFrame:
    weighted = rollup.attach_weights(scores_of(t), t.user_weights).drop(*SCORE_COLUMNS)
    return weighted.select(KEY, "user_id", F.col("fips").alias("group_id"), F.col("weight").alias("user_weight"))


@query("valid_layers", "SELECT user_year_week, user_id, message_count, fips FROM valid_weeks")
def _(t: Inputs) -> DataFrame:
    return layered(t).select(KEY, "user_id", "message_count", "fips")


@query(
    "pick_layer",
    "SELECT user_year_week, CAST(CASE WHEN len(vector) > 0 THEN 1 ELSE 0 END AS INT) AS layers, CAST(len(vector) AS INT) AS width FROM picked",
)
def _(t: Inputs) -> DataFrame:
    picked = embed.pick_layer(t.user_weeks)
    return picked.select(KEY, F.size("layers").alias("layers"), F.size(F.flatten("layers")).alias("width"))


@query(
    "flatten_layers",
    f"""SELECT user_year_week, CAST(generate_subscripts(vector, 1) - 1 AS INT) AS pos, {r6('unnest(vector)')} AS value
 FROM picked WHERE len(vector) > 0""",
)
def _(t: Inputs) -> DataFrame:
    return components(embed.flatten_layers(embed.pick_layer(t.user_weeks)), [KEY], "vector")


def per_target(t: Inputs, run: Callable[[DataFrame, score.Model], DataFrame]) -> DataFrame:
    """What ``run`` makes of the vectors with each model, under the model's target."""
    vectors = vectors_of(t)
    return reduce(DataFrame.unionByName, [rollup.labelled(run(vectors, m), name, "target") for name, m in t.models.items()])


@query("align_features", f"SELECT target, user_year_week, pos, {r6('value')} AS value FROM aligned")
def _(t: Inputs) -> DataFrame:
    aligned = per_target(t, lambda vectors, model: score.align_features(vectors, model.features))
    return components(aligned, ["target", KEY], "aligned")


def standardised(vectors: DataFrame, model: score.Model) -> DataFrame:
    return score.standardise(score.align_features(vectors, model.features), model.mean, model.scale)


@query("standardise", f"SELECT target, user_year_week, pos, {r6('value')} AS value FROM standardised")
def _(t: Inputs) -> DataFrame:
    return components(per_target(t, standardised), ["target", KEY], "standardised")


@query(
    "ridge_score",
    f"""SELECT 'dep_score' AS target, user_year_week, {r6('dep_score')} AS score FROM raw_scores
 UNION ALL SELECT 'anx_score', user_year_week, {r6('anx_score')} FROM raw_scores""",
)
def _(t: Inputs) -> DataFrame:
    scored = per_target(t, lambda vectors, m: score.ridge_score(standardised(vectors, m), m.coef, m.intercept))
    return scored.select("target", KEY, rounded("score").alias("score"))


RAW_SCORES = f"SELECT user_year_week, user_id, fips, {r6('dep_score')} AS dep_score, {r6('anx_score')} AS anx_score FROM raw_scores"


def raw_rounded(df: DataFrame) -> DataFrame:
    return df.select(KEY, "user_id", "fips", rounded("dep_score").alias("dep_score"), rounded("anx_score").alias("anx_score"))


@query("fused_score", RAW_SCORES)
def _(t: Inputs) -> DataFrame:
    return raw_rounded(score.fused_scores(vectors_of(t), t.models, arrow=False))


@query(
    "fused_score_float",
    "SELECT user_year_week, round(CAST(CAST(dep_score AS FLOAT) AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS dep_score FROM raw_scores",
)
def _(t: Inputs) -> DataFrame:
    scored = score.fused_scores(vectors_of(t), t.models, as_float=True)
    return scored.select(KEY, (F.round(F.col("dep_score").cast("double"), 4) + F.lit(0.0)).alias("dep_score"))


@query("fused_score_arrow", RAW_SCORES)
def _(t: Inputs) -> DataFrame:
    return raw_rounded(score.fused_scores(vectors_of(t), t.models, arrow=True))


@query(
    "minmax_scale",
    """SELECT event_id, round(5 * (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6)
 + CAST(0 AS DOUBLE) AS scaled FROM events""",
)
def _(t: Inputs) -> DataFrame:
    scaled = score.minmax_scale(t.table("events").select("event_id", "value"), {"value": "scaled"})
    return scaled.select("event_id", rounded("scaled").alias("scaled"))


@query("default_weight", "SELECT user_id, coalesce(weight, 1.0) AS weight FROM user_weights")
def _(t: Inputs) -> DataFrame:
    return rollup.default_weight(t.user_weights)


@query("county_fallback", "SELECT user_year_week, user_id, fips, coalesce(cnty, fips) AS cnty FROM home_counties")
def _(t: Inputs) -> DataFrame:
    return rollup.county_fallback(homes_of(t))


@query("county_mismatch", "SELECT user_year_week, user_id, fips, cnty FROM home_counties WHERE fips <> cnty")
def _(t: Inputs) -> DataFrame:
    return rollup.county_mismatch(homes_of(t))


@query(
    "county_mismatch_sample",
    "SELECT user_year_week, user_id, fips, cnty FROM home_counties WHERE fips <> cnty ORDER BY user_id, user_year_week, cnty LIMIT 5",
)
def _(t: Inputs) -> DataFrame:
    return rollup.county_mismatch_sample(homes_of(t), ["user_id", KEY, "cnty"])


LONG_SCORES = f"""SELECT user_id, year_week_county, fips, user_weight, feat, {r6('feat_score')} AS feat_score FROM melted"""


@query("melt_scores", LONG_SCORES)
def _(t: Inputs) -> DataFrame:
    return rollup.melt_scores(weighted_of(t)).withColumn("feat_score", rounded("feat_score"))


@query("pad_county", "SELECT user_id, lpad(fips, 5, '0') AS fips FROM county_codes")
def _(t: Inputs) -> DataFrame:
    return features.pad_county(t.county_codes)


@query(
    "explode_features",
    f"""SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, {r6('unnest(embedding)')} AS value FROM embeddings""",
)
def _(t: Inputs) -> DataFrame:
    rows = features.explode_features(t.table("embeddings"), "embedding", "vec_id")
    return rows.select("vec_id", F.col("index").alias("pos"), rounded(F.col("value").cast("double")).alias("value"))


@query(
    "feature_names",
    """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR) || 'me' AS feat, unnest(embedding) AS value,
 unnest(embedding) AS group_norm FROM embeddings""",
)
def _(t: Inputs) -> DataFrame:
    rows = features.feature_names(features.explode_features(t.table("embeddings"), "embedding", "vec_id"))
    return rows.select("vec_id", "feat", "value", "group_norm")


@query("constant_column", "SELECT c_custkey, 'DEP_SCORE' AS feat FROM customer")
def _(t: Inputs) -> DataFrame:
    return rollup.labelled(t.table("customer").select("c_custkey"), "DEP_SCORE")


# -- joins ----------------------------------------------------------------------------------------------------------


@query("attach_county", "SELECT message_id, user_id, message, cnty AS fips FROM messages JOIN user_county USING (user_id)")
def _(t: Inputs) -> DataFrame:
    return clean.attach_county(t.messages, t.user_county).select("message_id", "user_id", "message", "fips")


@query(
    "attach_county_several",
    "SELECT message_id, user_id, message, cnty AS fips FROM messages JOIN user_counties USING (user_id)",
)
def _(t: Inputs) -> DataFrame:
    return clean.attach_county(t.messages, t.user_counties).select("message_id", "user_id", "message", "fips")


@query("keep_band", f"SELECT {SAMPLED} FROM cleaned WHERE user_year_week IN (SELECT user_year_week FROM active)")
def _(t: Inputs) -> DataFrame:
    cleaned = t.cleaned()
    weeks = activity.week_counts(cleaned).filter(activity.in_band(F.col("message_count"), *ACTIVE))
    return sampled(activity.keep_band(cleaned, weeks))


@query("drop_superusers", f"SELECT {SAMPLED} FROM cleaned WHERE user_id NOT IN (SELECT user_id FROM heavy)")
def _(t: Inputs) -> DataFrame:
    cleaned = t.cleaned()
    return sampled(activity.drop_superusers(cleaned, activity.superusers(cleaned, SUPER_FROM)))


@query("superusers", "SELECT user_id FROM heavy")
def _(t: Inputs) -> DataFrame:
    return activity.superusers(t.cleaned(texts=False), SUPER_FROM)


@query("drop_existing", f"SELECT {SAMPLED} FROM cleaned WHERE message_id NOT IN (SELECT message_id FROM prior)")
def _(t: Inputs) -> DataFrame:
    return sampled(batches.drop_existing(t.cleaned(), prior(t)))


@query("combine_targets", RAW_SCORES)
def _(t: Inputs) -> DataFrame:
    vectors = vectors_of(t)
    one, other = (score.fused_scores(vectors, {target: t.models[target]}) for target in ("dep_score", "anx_score"))
    return raw_rounded(score.combine_targets(one, other, "anx_score"))


@query(
    "attach_weights",
    "SELECT user_year_week, user_id, fips, weight FROM scores LEFT JOIN user_weights USING (user_id)",
)
def _(t: Inputs) -> DataFrame:
    return rollup.attach_weights(scores_of(t), t.user_weights).select(KEY, "user_id", "fips", "weight")


@query("batch_members", f"SELECT {SAMPLED}, batch FROM cleaned JOIN assigned USING (user_year_week)")
def _(t: Inputs) -> DataFrame:
    cleaned = t.cleaned()
    counts = activity.week_counts(cleaned).filter(activity.in_band(F.col("message_count"), *ACTIVE))
    return sampled(batches.batch_members(cleaned, batches.assign_batches(counts, BATCH_LIMIT)))


# -- aggregations ---------------------------------------------------------------------------------------------------


@query("week_counts", "SELECT user_year_week, message_count FROM counts")
def _(t: Inputs) -> DataFrame:
    return activity.week_counts(t.cleaned(texts=False))


BAND_SQL = """CASE WHEN message_count BETWEEN 1 AND 4 THEN '1-4' WHEN message_count BETWEEN 5 AND 14 THEN '5-14'
 WHEN message_count >= 15 THEN '15+' END"""


@query("band", f"SELECT user_year_week, message_count, {BAND_SQL} AS band FROM counts")
def _(t: Inputs) -> DataFrame:
    return activity.band(activity.week_counts(t.cleaned(texts=False)), EDGES)


@query(
    "band_totals",
    f"""SELECT {BAND_SQL} AS band, count(*) AS user_weeks, CAST(sum(message_count) AS BIGINT) AS messages
 FROM counts GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return activity.band_totals(activity.band(activity.week_counts(t.cleaned(texts=False)), EDGES))


@query(
    "band_report",
    f"""SELECT {BAND_SQL} AS band, count(DISTINCT user_year_week) AS user_weeks, count(*) AS messages,
 count(DISTINCT user_id) AS users, count(DISTINCT fips) AS counties FROM cleaned JOIN counts USING (user_year_week) GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return panel.band_report(t.cleaned(texts=False), EDGES)


def stats_sql(source: str) -> str:
    pairs = {"messages": "message_id", "user_weeks": KEY, "users": "user_id", "counties": "fips"}
    return "SELECT " + ", ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM {source}) d) AS {n}" for n, c in pairs.items())


@query("panel_stats", stats_sql("masked_located"))
def _(t: Inputs) -> DataFrame:
    return activity.panel_stats(cleaning.located_messages(t.messages_keyed, t.user_county, order="mask_first"))


@query(
    "panel_stats_embeddings",
    """SELECT count(DISTINCT message_id) AS messages, count(DISTINCT user_year_week) AS user_weeks,
 count(DISTINCT user_id) AS users, count(DISTINCT fips) AS counties FROM message_vectors""",
)
def _(t: Inputs) -> DataFrame:
    return activity.panel_stats(t.message_vectors)


@query(
    "panel_stats_two_columns",
    "SELECT count(DISTINCT message_id) + max(CASE WHEN message_id IS NULL THEN 1 ELSE 0 END) AS messages,"
    " count(DISTINCT user_id) AS users FROM messages",
)
def _(t: Inputs) -> DataFrame:
    return activity.panel_stats(t.messages.select("message_id", "user_id"))


@query("approx_panel_stats", "SELECT 4 AS within_a_tenth")
def _(t: Inputs) -> DataFrame:
    sketched, exact = activity.approx_panel_stats(t.cleaned()), activity.panel_stats(t.cleaned())
    near = [F.abs(F.col(f"s.{c}") - F.col(f"e.{c}")) <= 0.1 * F.col(f"e.{c}") for c in exact.columns]
    return sketched.alias("s").join(exact.alias("e")).select(sum(n.cast("int") for n in near).alias("within_a_tenth"))


@query(
    "funnel",
    f"""SELECT 'read' AS stage, count(*) AS row_count FROM messages_keyed
 UNION ALL SELECT 'keyed', count(*) FROM messages_keyed WHERE {KEYED}
 UNION ALL SELECT 'located', count(*) FROM messages_keyed JOIN user_county USING (user_id) WHERE {KEYED}
 UNION ALL SELECT 'without_retweets', count(*) FROM messages_keyed JOIN user_county USING (user_id) WHERE {KEYED} AND NOT {RETWEET}
 UNION ALL SELECT 'without_urls', count(*) FROM located
 UNION ALL SELECT 'unique', count(*) FROM unique_messages
 UNION ALL SELECT 'county_valid', count(*) FROM cleaned""",
)
def _(t: Inputs) -> DataFrame:
    return cleaning.cleaning_funnel(t.messages_keyed, t.user_county)


@query(
    "county_match_counts",
    f"""SELECT 'in_year' AS stage, count(*) AS row_count FROM messages_text WHERE {KEYED}
  AND year(TRY_CAST(created_at AS TIMESTAMP)) = {YEAR}
 UNION ALL SELECT 'matched', count(*) FROM messages_text JOIN user_county USING (user_id) WHERE {KEYED}
  AND year(TRY_CAST(created_at AS TIMESTAMP)) = {YEAR}""",
)
def _(t: Inputs) -> DataFrame:
    return cleaning.county_match_counts(t.messages_text, t.user_county, YEAR)


@query(
    "county_null_counts",
    """SELECT count(*) FILTER (cnty IS NULL) AS null_before, count(*) FILTER (coalesce(cnty, fips) IS NULL) AS null_after
 FROM home_counties""",
)
def _(t: Inputs) -> DataFrame:
    return rollup.county_null_counts(homes_of(t))


@query(
    "global_min_max",
    f"""SELECT {r6('min(dep_score)')} AS min_dep_score, {r6('max(dep_score)')} AS max_dep_score,
 {r6('min(anx_score)')} AS min_anx_score, {r6('max(anx_score)')} AS max_anx_score FROM raw_scores""",
)
def _(t: Inputs) -> DataFrame:
    raw = scoring.raw_scores(t.user_weeks, t.models, n_layers=N_LAYERS, dim=DIM)
    bounds = score.global_min_max(raw, ["dep_score", "anx_score"])
    return bounds.select(*[rounded(c).alias(c) for c in bounds.columns])


ROLLUP_STATS = {
    "wavg_score": "sum(feat_score * user_weight) / sum(user_weight)",
    "avg_score": "avg(feat_score)",
    "std_score": "stddev_pop(feat_score)",
}
# By the definition: the mean first, then the squares around it.
WEIGHTED_STD = "sqrt(sum(user_weight * (feat_score - around) ** 2) / sum(user_weight))"
AROUND = "sum(feat_score * user_weight) OVER (PARTITION BY year_week_county, feat) / sum(user_weight) OVER (PARTITION BY year_week_county, feat)"


def rollup_sql(stats: Mapping[str, str], table: str = "melted") -> str:
    columns = ", ".join(f"{r6(sql)} AS {name}" for name, sql in stats.items())
    source = f"(SELECT *, {AROUND} AS around FROM {table}) m" if "around" in columns else table
    return f"SELECT year_week_county, feat, {columns}, count(DISTINCT user_id) AS N_users FROM {source} GROUP BY year_week_county, feat"


def rolled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in df.columns if c.endswith("_score") or c == "std_score_wt"})


@query("county_week_rollup", rollup_sql(ROLLUP_STATS))
def _(t: Inputs) -> DataFrame:
    return rolled(rollup.county_week_rollup(rollup.melt_scores(weighted_of(t))))


@query("write_csv_single", rollup_sql(ROLLUP_STATS))
def _(t: Inputs) -> DataFrame:
    path = scratch(t, "rollup")
    weeks = rollup.county_week_rollup(rollup.melt_scores(weighted_of(t)))
    writers.write_csv(weeks, path, header=True, files=1)
    return rolled(t.spark.read.schema(weeks.schema).option("header", True).csv(path))


@query("weighted_std", rollup_sql({**ROLLUP_STATS, "std_score_wt": WEIGHTED_STD}))
def _(t: Inputs) -> DataFrame:
    return rolled(rollup.county_week_rollup(rollup.melt_scores(weighted_of(t)), weighted_std=True))


# Every fifth score of a user is missing.
GAPS = "(SELECT * REPLACE (CASE WHEN user_id % 5 = 2 THEN NULL ELSE feat_score END AS feat_score) FROM melted) g"


def with_gaps(t: Inputs) -> DataFrame:
    score_or_none = F.when(F.col("user_id") % 5 != 2, F.col("feat_score"))
    return rollup.melt_scores(weighted_of(t)).withColumn("feat_score", score_or_none)


@query("weighted_std_null_scores", rollup_sql({**ROLLUP_STATS, "std_score_wt": WEIGHTED_STD}, GAPS))
def _(t: Inputs) -> DataFrame:
    return rolled(rollup.county_week_rollup(with_gaps(t), weighted_std=True))


# A score that is missing takes its weight with it; its user still counts.
DROPPED = f"(SELECT * REPLACE (CASE WHEN feat_score IS NOT NULL THEN user_weight END AS user_weight) FROM {GAPS}) h"


@query("weighted_std_null_scores_dropped", rollup_sql({**ROLLUP_STATS, "std_score_wt": WEIGHTED_STD}, DROPPED))
def _(t: Inputs) -> DataFrame:
    return rolled(rollup.county_week_rollup(with_gaps(t), null_weights="drop", weighted_std=True))


@query("rollup_group_count", "SELECT count(*) AS groups FROM (SELECT DISTINCT year_week_county, feat FROM melted) g")
def _(t: Inputs) -> DataFrame:
    return rollup.rollup_group_count(rollup.county_week_rollup(rollup.melt_scores(weighted_of(t))))


@query("surplus_duplicates", "SELECT count(*) - count(DISTINCT fips) AS surplus FROM county_codes")
def _(t: Inputs) -> DataFrame:
    return features.surplus_duplicates(t.county_codes)


@query(
    "surplus_duplicates_null_as_key",
    "SELECT count(*) - count(DISTINCT fips) - max(CASE WHEN fips IS NULL THEN 1 ELSE 0 END) AS surplus FROM county_codes",
)
def _(t: Inputs) -> DataFrame:
    return features.surplus_duplicates(t.county_codes, null_keys="one")


def mean_sql(keys: str, value: str) -> str:
    return f"SELECT {keys}, CAST(pos AS INT) AS pos, {r6(value)} AS value FROM vector_parts GROUP BY {keys}, pos"


@query("mean_embedding_user_week", mean_sql("user_year_week", "avg(value)"))
def _(t: Inputs) -> DataFrame:
    return components(embed.mean_embedding(t.message_vectors, [KEY]), [KEY], "embedding")


@query("mean_embedding_user_county", mean_sql("user_id, fips", "avg(value)"))
def _(t: Inputs) -> DataFrame:
    return components(embed.mean_embedding(t.message_vectors, ["user_id", "fips"]), ["user_id", "fips"], "embedding")


WEEK_COUNTY = "split_part(user_year_week, ':', 1) || '_' || fips"


@query(
    "mean_embedding_county_week",
    f"""SELECT {WEEK_COUNTY} AS year_week_county, CAST(pos AS INT) AS pos, {r6('avg(value)')} AS value
 FROM vector_parts GROUP BY 1, pos""",
)
def _(t: Inputs) -> DataFrame:
    keyed = calendar.county_week_key(t.message_vectors)
    return components(embed.mean_embedding(keyed, ["year_week_county"]), ["year_week_county"], "embedding")


@query("weighted_mean_embedding", mean_sql("fips", "sum(value * weight) / sum(weight)"))
def _(t: Inputs) -> DataFrame:
    means = embed.weighted_mean_embedding(t.message_vectors, ["fips"], "weight")
    return components(means, ["fips"], "weighted_embedding")


@query(
    "mean_embedding_layered",
    f"""SELECT fips, CAST(layer AS INT) AS layer, CAST(pos AS INT) AS pos, {r6('avg(value)')} AS value FROM (
 SELECT fips, layer, generate_subscripts(part, 1) - 1 AS pos, unnest(part) AS value FROM (
  SELECT fips, generate_subscripts(embedding, 1) - 1 AS layer, unnest(embedding) AS part FROM valid_weeks) a) b
 GROUP BY fips, layer, pos""",
)
def _(t: Inputs) -> DataFrame:
    means = embed.mean_embedding(layered(t), ["fips"], layered=True)
    return components(means.select("fips", F.posexplode("embedding").alias("layer", "part")), ["fips", "layer"], "part")


@query("message_count", "SELECT user_year_week, count(*) AS message_count FROM message_vectors GROUP BY user_year_week")
def _(t: Inputs) -> DataFrame:
    return embed.mean_embedding(t.message_vectors, [KEY]).select(KEY, "message_count")


# -- order, sets, duplicates, batches -------------------------------------------------------------------------------


@query(
    "number_rows",
    "SELECT row_number() OVER (ORDER BY user_id, ts, event_id) AS id, event_id, user_id FROM events",
)
def _(t: Inputs) -> DataFrame:
    return ranking.number_rows(t.table("events"), ["user_id", "ts", "event_id"]).select("id", "event_id", "user_id")


@query(
    "running_start",
    """SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY source, doc_id) - n_chars AS BIGINT) AS start FROM documents""",
)
def _(t: Inputs) -> DataFrame:
    sizes = t.table("documents").select("source", "doc_id", "n_chars")
    return ranking.running_start(sizes, ["source", "doc_id"], F.col("n_chars")).select("doc_id", "n_chars", "start")


@query(
    "sort_weeks_by_count",
    "SELECT user_year_week, message_count FROM counts ORDER BY message_count, user_year_week",
)
def _(t: Inputs) -> DataFrame:
    return ranking.sort_weeks_by_count(activity.week_counts(t.cleaned(texts=False)))


@query("sample_rows", "SELECT user_year_week, message_count FROM counts ORDER BY message_count DESC, user_year_week LIMIT 20")
def _(t: Inputs) -> DataFrame:
    return ranking.sample_rows(activity.week_counts(t.cleaned(texts=False)), [F.col("message_count").desc(), F.col(KEY)], 20)


@query(
    "extremes",
    f"""SELECT part, user_year_week, {r6('dep_score')} AS dep_score FROM (
 SELECT *, row_number() OVER (ORDER BY dep_score, user_year_week) - 1 AS n, count(*) OVER () AS total FROM raw_scores) s
 JOIN (SELECT unnest(['lowest', 'middle', 'highest']) AS part) p
 ON (part = 'lowest' AND n < 10) OR (part = 'middle' AND n >= total // 2 - 5 AND n < total // 2 + 5)
 OR (part = 'highest' AND n >= total - 10)""",
)
def _(t: Inputs) -> DataFrame:
    raw = scoring.raw_scores(t.user_weeks, t.models, n_layers=N_LAYERS, dim=DIM)
    return ranking.extremes(raw, "dep_score", [KEY]).select("part", KEY, rounded("dep_score").alias("dep_score"))


@query(
    "union_years",
    "SELECT user_year_week, user_id, message_count FROM user_weeks UNION ALL SELECT user_year_week, user_id, message_count FROM valid_weeks",
)
def _(t: Inputs) -> DataFrame:
    return embed.union_years(t.user_weeks, layered(t)).select(KEY, "user_id", "message_count")


@query("union_targets", LONG_SCORES)
def _(t: Inputs) -> DataFrame:
    weighted = weighted_of(t)
    one, other = (rollup.melt_scores(weighted, {feat: col}) for feat, col in SCORE_FEATURES.items())
    return rollup.union_targets(one, other).withColumn("feat_score", rounded("feat_score"))


@query(
    "union_counties",
    """SELECT lpad(fips, 5, '0') AS fips, vec_id FROM base_counties UNION ALL SELECT lpad(fips, 5, '0'), vec_id FROM missing_counties""",
)
def _(t: Inputs) -> DataFrame:
    return features.union_counties(t.base_counties, t.missing_counties).select("fips", "vec_id")


@query(
    "subtract",
    "SELECT user_year_week FROM counts EXCEPT SELECT user_year_week FROM active",
)
def _(t: Inputs) -> DataFrame:
    counts = activity.week_counts(t.cleaned(texts=False))
    active = counts.filter(activity.in_band(F.col("message_count"), *ACTIVE))
    return features.set_difference(counts.select(KEY), active.select(KEY))


@query("distinct_values", "SELECT DISTINCT user_id, fips FROM unique_messages")
def _(t: Inputs) -> DataFrame:
    return activity.distinct_values(t.cleaned(county=None), ["user_id", "fips"])


@query("dedupe_messages", f"SELECT {SAMPLED} FROM unique_messages")
def _(t: Inputs) -> DataFrame:
    return sampled(t.cleaned(county=None))


@query("dedupe_counties", "SELECT fips, min(vec_id) AS vec_id FROM missing_counties GROUP BY fips")
def _(t: Inputs) -> DataFrame:
    return features.dedupe_counties(t.missing_counties, order=["vec_id"]).select("fips", "vec_id")


@query("assign_batches", "SELECT user_year_week, message_count, batch FROM assigned")
def _(t: Inputs) -> DataFrame:
    counts = activity.week_counts(t.cleaned(texts=False)).filter(activity.in_band(F.col("message_count"), *ACTIVE))
    return batches.assign_batches(counts, BATCH_LIMIT)


@query(
    "assign_batches_drop_tail",
    "SELECT user_year_week, message_count, batch FROM assigned WHERE batch < (SELECT max(batch) FROM assigned)",
)
def _(t: Inputs) -> DataFrame:
    counts = activity.week_counts(t.cleaned(texts=False)).filter(activity.in_band(F.col("message_count"), *ACTIVE))
    return batches.assign_batches(counts, BATCH_LIMIT, drop_tail=True)


@query("next_batch_number", "SELECT CAST(max(week(created_at)) AS BIGINT) AS next_batch FROM cleaned")
def _(t: Inputs) -> DataFrame:
    return batches.next_batch_number(delivered(t))


@query(
    "batch_summary",
    """SELECT batch, count(*) AS messages, count(DISTINCT user_year_week) AS user_weeks
 FROM fresh JOIN fresh_assigned USING (user_year_week) GROUP BY batch""",
)
def _(t: Inputs) -> DataFrame:
    return batches.batch_summary(fresh_batches(t))


# -- composite jobs -------------------------------------------------------------------------------------------------


@query("clean_messages", f"SELECT {SAMPLED} FROM cleaned")
def _(t: Inputs) -> DataFrame:
    return sampled(t.cleaned())


@query("clean_messages_mask_first", f"SELECT {SAMPLED} FROM masked_cleaned")
def _(t: Inputs) -> DataFrame:
    return sampled(t.cleaned(order="mask_first"))


@query("clean_messages_invalid_county", f"SELECT {SAMPLED} FROM unique_messages WHERE NOT regexp_matches(fips, '^[0-9]{{5}}$')")
def _(t: Inputs) -> DataFrame:
    return sampled(t.cleaned(county="invalid"))


@query("clean_messages_without_texts", "SELECT user_year_week, user_id, message_id, created_at, fips FROM cleaned")
def _(t: Inputs) -> DataFrame:
    return sampled(t.cleaned(texts=False))


@query("clean_messages_raw", f"SELECT {SAMPLED} FROM text_cleaned")
def _(t: Inputs) -> DataFrame:
    return sampled(cleaning.clean_messages(t.messages_text, t.user_county, year=YEAR))


@query("activity_panel", f"SELECT {SAMPLED} FROM panel")
def _(t: Inputs) -> DataFrame:
    return sampled(panel.activity_panel(t.cleaned(), ACTIVE, SUPER_FROM))


@query(
    "activity_panel_stats",
    """SELECT count(*) AS messages, count(DISTINCT user_year_week) AS user_weeks, count(DISTINCT user_id) AS users,
 count(DISTINCT fips) AS counties FROM panel""",
)
def activity_report(t: Inputs) -> DataFrame:
    return panel.activity_report(t.cleaned(texts=False), ACTIVE, SUPER_FROM)


@query(
    "activity_panel_with_heavy_users",
    f"SELECT {SAMPLED} FROM masked_cleaned WHERE user_year_week IN (SELECT user_year_week FROM masked_cleaned GROUP BY ALL"
    f" HAVING count(*) BETWEEN {ACTIVE[0]} AND {ACTIVE[1]})",
)
def _(t: Inputs) -> DataFrame:
    return sampled(panel.activity_panel(t.cleaned(order="mask_first"), ACTIVE, None))


def fresh_batches(t: Inputs) -> DataFrame:
    return incremental.incremental_batches(
        t.cleaned(), prior(t), active=ACTIVE, super_from=SUPER_FROM, limit=BATCH_LIMIT
    )


@query("incremental_batches", f"SELECT {SAMPLED}, batch FROM fresh JOIN fresh_assigned USING (user_year_week)")
def _(t: Inputs) -> DataFrame:
    return sampled(fresh_batches(t))


@query(
    "write_increment",
    """SELECT batch, count(*) AS messages, count(DISTINCT user_year_week) AS user_weeks FROM (
 SELECT batch, user_year_week FROM prior
 UNION ALL SELECT batch, user_year_week FROM fresh JOIN fresh_assigned USING (user_year_week)) b GROUP BY batch""",
)
def _(t: Inputs) -> DataFrame:
    path, options = scratch(t, "increments"), {"active": ACTIVE, "super_from": SUPER_FROM, "limit": BATCH_LIMIT}
    writers.write_batches(prior(t), path)
    for _ in range(2):  # the second run finds nothing new
        incremental.write_increment(t.cleaned(), path, **options)
    return batches.batch_summary(readers.read_batches(t.spark, path))


def store_of(t: Inputs) -> Deliveries:
    """A store that holds the earlier delivery."""
    store = Deliveries(t.spark, scratch(t, "store"))
    store.write(prior(t))
    return store


@query(
    "write_increment_restarted",
    """SELECT batch, count(*) AS messages, count(DISTINCT user_year_week) AS user_weeks FROM (
 SELECT batch, user_year_week FROM prior
 UNION ALL SELECT batch, user_year_week FROM fresh JOIN fresh_assigned USING (user_year_week)) b GROUP BY batch""",
)
def _(t: Inputs) -> DataFrame:
    """A run that wrote all its files and broke off before its record; the next run; a run that finds nothing new."""
    store = store_of(t)
    writers.write_batches(fresh_batches(t), store.folder_of("000001-broken", "data"))
    for _ in range(2):
        incremental.deliver(t.cleaned(), store.path, active=ACTIVE, super_from=SUPER_FROM, limit=BATCH_LIMIT)
    return batches.batch_summary(store.messages())


@query("delivered_messages", f"SELECT {SAMPLED}, batch FROM prior UNION ALL SELECT {SAMPLED}, batch FROM fresh JOIN fresh_assigned USING (user_year_week)")
def _(t: Inputs) -> DataFrame:
    store = store_of(t)
    incremental.deliver(t.cleaned(), store.path, active=ACTIVE, super_from=SUPER_FROM, limit=BATCH_LIMIT)
    return sampled(store.messages())


@query("drop_indexed", f"SELECT {SAMPLED} FROM cleaned WHERE message_id NOT IN (SELECT message_id FROM prior)")
def _(t: Inputs) -> DataFrame:
    return sampled(membership.drop_indexed(t.cleaned(), store_of(t).ids()))


@query(
    "delivered_statistics",
    """SELECT 'all' AS batches, count(*) AS messages, count(DISTINCT fips) AS counties, TRUE AS user_weeks_near, TRUE AS users_near
 FROM prior UNION ALL SELECT 'first', count(*), count(DISTINCT fips), TRUE, TRUE FROM prior WHERE batch = 0""",
)
def _(t: Inputs) -> DataFrame:
    """Sketches within three standard errors of the exact counts."""
    store, out = store_of(t), []
    for label, chosen in (("all", None), ("first", [0])):
        rows = store.messages() if chosen is None else store.messages().filter(F.col("batch").isin(chosen))
        exact = activity.panel_stats(rows)
        near = [
            (F.abs(F.col(c) - exact.select(c).scalar()) <= sketches.ERROR * exact.select(c).scalar()).alias(f"{c}_near")
            for c in ("user_weeks", "users")
        ]
        out.append(store.statistics(chosen).select(F.lit(label).alias("batches"), "messages", "counties", *near))
    return reduce(DataFrame.unionByName, out)


DAYS = 1 << 40  # no user-week is too busy


def documents_store(t: Inputs) -> Deliveries:
    """A store of two runs: the English documents as one batch, then all others."""
    store, rows = Deliveries(t.spark, scratch(t, "documents")), t.documents_sent
    store.write(rows.filter(F.col("location") == "en").withColumn("batch", F.lit(0)))
    incremental.deliver(rows, store.path, active=(1, DAYS), super_from=None, limit=BATCH_LIMIT)
    return store


@query(
    "deliver_documents",
    f"""SELECT message_id, user_year_week, batch, message FROM sent_first
 UNION ALL SELECT message_id, user_year_week, batch, message FROM documents_sent JOIN sent_assigned USING (user_year_week)
 WHERE location <> 'en' OR location IS NULL""",
)
def _(t: Inputs) -> DataFrame:
    return documents_store(t).messages().select("message_id", KEY, "batch", "message")


@query(
    "deliver_documents_statistics",
    "SELECT count(*) AS messages, count(DISTINCT fips) AS counties, 400 AS most_user_weeks, 100 AS most_users FROM documents_sent",
)
def _(t: Inputs) -> DataFrame:
    """Sketches of so few values are exact."""
    told = documents_store(t).statistics()
    return told.select("messages", "counties", F.greatest("user_weeks", F.lit(400)).cast("int").alias("most_user_weeks"), F.greatest("users", F.lit(100)).cast("int").alias("most_users"))


@query("attach_county_split", "SELECT message_id, m.user_id, cnty AS fips FROM messages m JOIN user_counties c ON m.user_id = c.user_id")
def _(t: Inputs) -> DataFrame:
    rows = t.messages.select("message_id", "user_id")
    return clean.attach_county(rows, t.user_counties, split_hot=True).select("message_id", "user_id", "fips")


@query("attach_weights_split", "SELECT user_year_week, user_id, weight FROM scores LEFT JOIN user_weights USING (user_id)")
def _(t: Inputs) -> DataFrame:
    return rollup.attach_weights(scores_of(t), t.user_weights, split_hot=True).select(KEY, "user_id", "weight")


@query(
    "before_after_report",
    """SELECT 'kept' AS heavy_users, count(*) AS messages, count(DISTINCT user_year_week) AS user_weeks,
 count(DISTINCT user_id) AS users, count(DISTINCT fips) AS counties FROM cleaned JOIN active USING (user_year_week)
 UNION ALL SELECT 'removed', count(*), count(DISTINCT user_year_week), count(DISTINCT user_id), count(DISTINCT fips) FROM panel""",
)
def _(t: Inputs) -> DataFrame:
    return panel.before_after_report(t.cleaned(texts=False), ACTIVE, SUPER_FROM)


@query(
    "quarantine",
    f"""SELECT 'broken' AS kind, count(*) AS records FROM messages_keyed WHERE message_id % 10 = 3
 UNION ALL SELECT 'messages', count(*) FROM messages_keyed WHERE message_id % 10 <> 3 OR message_id IS NULL""",
)
def _(t: Inputs) -> DataFrame:
    """Every tenth message is written with an id that is no number."""
    path, aside = scratch(t, "broken"), scratch(t, "quarantine")
    marred = F.when(F.col("message_id") % 10 == 3, F.concat(F.lit("no"), F.col("message_id"))).otherwise(F.col("message_id").cast("string"))
    text = t.messages_keyed.withColumns({"message_id": marred, "created_at": F.col("created_at").cast("string")})
    writers.write_csv(text, path, header=False)
    fine = writers.write_quarantine(readers.read_checked(t.spark, path), aside)
    counts = [fine.agg(F.count("*").alias("records")).withColumn("kind", F.lit("messages"))]
    counts.append(t.spark.read.parquet(aside).agg(F.count("*").alias("records")).withColumn("kind", F.lit("broken")))
    return counts[0].unionByName(counts[1]).select("kind", "records")


@query(
    "write_scores",
    f"SELECT user_year_week, user_id, fips, {', '.join(f'{r6(c)} AS {c}' for c in SCORE_COLUMNS)} FROM scores",
)
def _(t: Inputs) -> DataFrame:
    years = [scratch(t, "year") for _ in range(2)]
    for k, path in enumerate(years):
        t.user_weeks.filter(F.col("user_id") % 2 == k).write.parquet(path)
    path = scratch(t, "scores")
    scoring.write_scores(t.spark, [f"{year}/*.parquet" for year in years], t.models, path, n_layers=N_LAYERS, dim=DIM)
    return readers.read_scores(t.spark, path).withColumns({c: rounded(c) for c in SCORE_COLUMNS})


@query("write_county_weeks", rollup_sql({**ROLLUP_STATS, "std_score_wt": WEIGHTED_STD}))
def _(t: Inputs) -> DataFrame:
    scores, weights, path = (scratch(t, label) for label in ("scores", "weights", "county-weeks"))
    writers.write_csv(scores_of(t), scores)
    writers.write_csv(t.user_weights, weights)
    weeks = county_weeks.write_county_weeks(t.spark, scores, weights, path, weighted_std=True)
    return rolled(t.spark.read.schema(weeks.schema).option("header", True).csv(path))


@query(
    "county_diagnostics",
    """SELECT count(*) FILTER (cnty IS NULL) AS null_before, count(*) FILTER (coalesce(cnty, fips) IS NULL) AS null_after,
 count(*) FILTER (fips <> cnty) AS differing FROM home_counties""",
)
def _(t: Inputs) -> DataFrame:
    return county_weeks.county_diagnostics(scores_of(t), t.user_county)


@query(
    "score_user_weeks",
    f"SELECT user_year_week, user_id, fips, {', '.join(f'{r6(c)} AS {c}' for c in SCORE_COLUMNS)} FROM scores",
)
def _(t: Inputs) -> DataFrame:
    columns = [f.name for f in schemas.SCORES.fields]
    return scores_of(t).select(*columns).withColumns({c: rounded(c) for c in SCORE_COLUMNS})


@query(
    "score_user_weeks_built_in",
    f"SELECT user_year_week, user_id, fips, {', '.join(f'{r6(c)} AS {c}' for c in SCORE_COLUMNS)} FROM scores",
)
def _(t: Inputs) -> DataFrame:
    scored = scoring.score_user_weeks(t.user_weeks, t.models, n_layers=N_LAYERS, dim=DIM, arrow=False)
    return scored.select(*[f.name for f in schemas.SCORES.fields]).withColumns({c: rounded(c) for c in SCORE_COLUMNS})


@query("county_week_scores", rollup_sql({**ROLLUP_STATS, "std_score_wt": WEIGHTED_STD}))
def _(t: Inputs) -> DataFrame:
    return rolled(county_weeks.county_week_scores(scores_of(t), t.user_weights, weighted_std=True))


FEATURE_ROWS = f"""SELECT row_number() OVER (ORDER BY fips, pos) AS id, fips AS group_id, {r6('value')} AS value,
 CAST(pos AS VARCHAR) || 'me' AS feat, {r6('value')} AS group_norm FROM county_rows"""


@query("county_feature_table", FEATURE_ROWS)
def _(t: Inputs) -> DataFrame:
    table = feature_export.county_feature_table(county_means(t), missing_counties(t), "embedding")
    return table.withColumns({c: rounded(c) for c in ("value", "group_norm")})


@query("write_feature_table", FEATURE_ROWS)
def _(t: Inputs) -> DataFrame:
    base, missing, path = (scratch(t, label) for label in ("base", "missing", "features"))
    county_means(t).write.parquet(base)
    missing_counties(t).write.parquet(missing)
    feature_export.write_feature_table(t.spark, f"{base}/*.parquet", f"{missing}/*.parquet", path, "embedding")
    table = t.spark.read.schema(schemas.FEATURE_TABLE).csv(path)
    return table.withColumns({c: rounded(c) for c in ("value", "group_norm")})


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return activity_report(Inputs(spark, folder))
