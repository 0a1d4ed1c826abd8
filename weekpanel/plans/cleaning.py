"""Raw or keyed messages to a cleaned panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel import schemas
from weekpanel.functions import text
from weekpanel.operators import activity, calendar, clean

COUNTY_FILTERS = {"valid": clean.county_valid, "invalid": clean.county_invalid}
ORDERS = ("filter_first", "mask_first")
TEXTS = ("message", "location", "coordinates")


def located_messages(
    messages: DataFrame,
    user_county: DataFrame,
    *,
    order: str = "filter_first",
    year: int | None = None,
    key_year: str = "calendar",
    layout: str = calendar.USER_FIRST,
) -> DataFrame:
    """Messages with keys, parsed time, masked text and county, before duplicates and counties are judged.

    ``order="filter_first"`` looks for retweets in the text as written. ``order="mask_first"`` masks mentions
    before, which leaves nothing for the retweet pattern to find: all retweets stay in. Messages without a
    ready-made key get one from their time; ``year`` keeps one calendar year.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    rows = clean.require_keys(messages)
    if order == "filter_first":
        rows = clean.mask_mentions(clean.drop_urls(clean.drop_retweets(rows)))
    else:
        rows = clean.drop_urls(clean.drop_retweets(clean.mask_mentions(rows)))
    rows = clean.parse_created_at(rows)
    if year is not None:
        rows = calendar.in_year(rows, year)
    if "user_year_week" not in messages.columns:
        rows = calendar.build_key(calendar.calendar_parts(rows, key_year), layout)
    located = clean.attach_county(rows, user_county)
    return located.select(*[f.name for f in schemas.SAMPLED.fields if f.name in located.columns])


def clean_messages(
    messages: DataFrame, user_county: DataFrame, *, county: str | None = "valid", texts: bool = True, **options
) -> DataFrame:
    """One row per message id with a county, in the columns of a sampled batch.

    Counties are judged after the duplicates: the other way round, a user with a valid and an invalid county
    could keep a different copy. The map is reduced to the county that would survive for each user, so messages
    are not multiplied by counties. They are shuffled twice at most: by user where the map is too large to
    broadcast, and by message id. ``options`` are those of :func:`located_messages`.

    With ``texts=False`` the same rows come without message, location and coordinates. Duplicates are settled
    by the short columns first, so the texts are not needed for it: a job that only counts never masks or
    shuffles them.
    """
    located = located_messages(messages, clean.first_county(user_county), **options)
    unique = clean.dedupe_messages(located if texts else located.drop(*TEXTS))
    return unique if county is None else COUNTY_FILTERS[county](unique)


FUNNEL = ("read", "keyed", "located", "without_retweets", "without_urls")


def cleaning_funnel(messages: DataFrame, user_county: DataFrame, *, county: str = "valid") -> DataFrame:
    """Rows after each step of :func:`clean_messages` in its default order: seven counts from one pass.

    Each row is tagged with the furthest step that it reaches. Rows that pass all filters are grouped by message id, the
    others by their tag alone, so map tasks add up the rows that drop out and only ids are shuffled. The group of a
    message knows the county of its survivor: the one with the earliest time, then the smallest user and county, as
    :func:`clean.dedupe_messages` has it. The county join multiplies messages by the counties of their user; those rows
    are counted, not built. All counts are aggregates, so tasks that run again do not count twice.
    """
    if county not in COUNTY_FILTERS:
        raise ValueError(f"county must be one of {tuple(COUNTY_FILTERS)}")
    located = messages.select("message_id", "user_id", "message", "created_at").join(
        clean.county_map(user_county), "user_id", "left"
    )
    told = located.select(
        "message_id",
        F.col("cnty").alias("fips"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.struct(*_nulls_last(F.col("created_at").try_cast("timestamp"), F.col("user_id"), F.col("cnty"))).alias("order"),
        F.when(~_all_present(clean.MESSAGE_KEYS), 0)
        .when(F.col("copies").isNull(), 1)
        .when(F.coalesce(text.is_retweet(F.col("message")), F.lit(True)), 2)
        .when(F.coalesce(text.has_url(F.col("message")), F.lit(True)), 3)
        .otherwise(4)
        .alias("step"),
    )
    message = F.when(F.col("step") == 4, F.col("message_id")).alias("message")
    grouped = told.groupBy("step", message).agg(
        F.count("*").alias("rows"), F.sum("copies").alias("copies"), F.min_by("fips", "order").alias("fips")
    )
    judged = text.is_county(F.col("fips"))
    unique = F.col("step") == 4
    counts = {
        name: F.sum(F.when(F.col("step") >= step, F.col("rows" if step < 2 else "copies"))) for step, name in enumerate(FUNNEL)
    }
    counts |= {"unique": F.count_if(unique), f"county_{county}": F.count_if(unique & (judged if county == "valid" else ~judged))}
    totals = grouped.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in counts.items()])
    pairs = [F.struct(F.lit(name).alias("stage"), F.col(name).alias("row_count")) for name in counts]
    return totals.select(F.inline(F.array(*pairs)))


def _nulls_last(*values: Column) -> list[Column]:
    """Fields of a struct whose smallest value is the first in ascending order with nulls last."""
    named = [(v.isNull().alias(f"no_{k}"), v.alias(f"value_{k}")) for k, v in enumerate(values)]
    return [field for pair in named for field in pair]


def _all_present(cols: tuple[str, ...]) -> Column:
    present = F.lit(True)
    for col in cols:
        present = present & F.col(col).isNotNull()
    return present


def county_match_counts(messages: DataFrame, user_county: DataFrame, year: int) -> DataFrame:
    """Rows of one year before and after the county join."""
    rows = calendar.in_year(clean.parse_created_at(clean.require_keys(messages)), year)
    return activity.funnel({"in_year": rows, "matched": rows.join(clean.county_counts(user_county), "user_id")}, {"matched": "copies"})
