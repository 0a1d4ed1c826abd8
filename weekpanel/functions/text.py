"""Expressions over message texts and county codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekpanel.fixed_values import (
    COUNTY_PATTERN,
    COUNTY_WIDTH,
    MENTION_MASK,
    MENTION_PATTERN,
    RETWEET_PATTERN,
    SHORT_COUNTY_PATTERN,
    URL_PATTERN,
)

# Whether a URL is present is settled by one character after the scheme. Without the final repeat the answer is
# the same, and the regex engine does not recurse once per URL character: with it, a URL of some 2,000
# characters overflows the stack of a task.
_URL_PRESENT = URL_PATTERN.removesuffix("+")


def masked_mentions(message: Column) -> Column:
    """Mask mentions; the regex runs only where there is an ``@`` at all."""
    masked = F.regexp_replace(message, MENTION_PATTERN, MENTION_MASK)
    return F.when(F.contains(message, F.lit("@")), masked).otherwise(message)


def is_retweet(message: Column) -> Column:
    return message.rlike(RETWEET_PATTERN)


def has_url(message: Column) -> Column:
    return message.rlike(_URL_PRESENT)


def is_county(code: Column) -> Column:
    return code.cast("string").rlike(COUNTY_PATTERN)


def is_short_county(code: Column) -> Column:
    return code.cast("string").rlike(SHORT_COUNTY_PATTERN)


def padded_county(code: Column) -> Column:
    """Left-pad with zeros to five characters. Longer codes are cut to five."""
    return F.lpad(code.cast("string"), COUNTY_WIDTH, "0")
