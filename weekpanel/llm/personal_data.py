"""Operator 8: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans that the fixed patterns find: e-mail and IP addresses, card and phone numbers. A fifth kind has
seeds among the tokens: secrets, which are long values of letters and digits that a name such as ``token`` or
``password`` is given, and credentials with a published prefix. Every seed, and every other identifier-like token (one
with a digit or an ``@``, without a name and a ``=`` or ``:`` before it), is an instance with lexical patterns: the two
words before it, the word before it with its shape, and the words on both sides, other identifiers included. Digit tokens with one
blank between them are such a token together too, beside each of them alone; where both are found, the longer span is
taken. Patterns and instances form a graph. In each round a
pattern's confidence in a kind is the score of its instances over their number and one, and an instance that is no
seed scores 1 - the product of (1 - confidence) over its patterns, as long as a pattern is supported by ``SUPPORT``
instances and sure to ``USEFUL``. In the end an occurrence is personal data when its instance scores ``ACCEPT`` and a
pattern of this occurrence is sure to ``SURE``. Base spans always stay; what overlaps one is no candidate. Seeds of
secrets are spans that the method adds, as are the secrets found beside them, such as short ones after the same words.

The patterns run over whole texts once, and only matches and the few words around them are kept. Counts over patterns
and instances are aggregated on the map side; joins have staged tables on both sides, so that a hot pattern can be split.

Defined results: null counts as the empty text; positions are code points, ends exclusive; documents without spans
have counts of zero and empty strings; repeated rows are all returned; an empty table gives no rows; further columns
are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.shared import Staging, whole_text

#: Fixed values. Each finds what its plain form finds; possessive quantifiers and looks behind keep long runs of
#: characters from being scanned again from each of them, or from filling a task's stack.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
SECRET = "secret"
TOKEN = "token"
#: A token with a digit or an @, from its first to its last character.
TOKEN_PATTERN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = "run"
#: Two digit tokens or more with one blank between them; the first may begin with two letters, as in account numbers.
_GROUP = r"[0-9](?:[0-9()+/-]|\.(?=[0-9]))*+"
_GROUP_END = r"""(?=[\])>"'.,;:!?]*+(?:[\x20\x09-\x0D]|\z))"""
RUN_PATTERN = (
    r"""(?<![^\x20\x09-\x0D])["'(<\[+]*+(?:[A-Za-z]{2})?+""" + _GROUP + rf"(?:\x20[+(]*+{_GROUP}{_GROUP_END})++"
)
#: What stands before a token's value: quotes and brackets, and a name that is given the value.
_OPEN = r"""["'(<\[]*+"""
NAME_PATTERN = rf"""^{_OPEN}([A-Za-z_][A-Za-z_.-]*+["']?[:=](?!/){_OPEN})"""
LEAD_PATTERN = rf"""^{_OPEN}(?:[A-Za-z_][A-Za-z_.-]*+["']?[:=](?!/){_OPEN})?+"""
#: Fixed values. Names that are given secrets, what a secret looks like where it is given one, and published prefixes.
SECRET_NAMES = r"(?:token|secret|password|passwd|passphrase|credentials?|(?:api|access|private|auth)[_-]?key)"
SECRET_BEFORE = rf"""(?i){SECRET_NAMES}["']?\s*[:=]\s*{_OPEN}$"""
SECRET_FORM = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}$"
SECRET_PREFIXES = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})$"
#: Characters on each side of a match that are kept to take the neighbouring words from.
AROUND = 64
#: So many matches on each side make up those characters: a match and what parts it from the next are two at least.
NEIGHBOURS = AROUND // 2

ROUNDS = 3
SUPPORT = 3.0
USEFUL = 0.5
SURE = 0.75
ACCEPT = 0.8


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Matches in text order: the code points since the match before, the match, and what is around it."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # A piece, the match after it, and the piece after that; the last piece has no match.
    zipped = F.arrays_zip(pieces, found, F.slice(pieces, F.lit(2), F.size(pieces)))
    zipped = zipped.cast("array<struct<before:string,value:string,after:string>>")

    def one(x: Column, place: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            place.alias("place"),
            F.char_length(x["before"]).alias("gap"),
            x["value"].alias("value"),
            F.right(x["before"], F.lit(AROUND)).alias("before"),
            F.left(x["after"], F.lit(AROUND)).alias("after"),
        )

    return F.filter(F.transform(zipped, one), lambda m: m["value"].isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, digit: Column) -> Column:
        value = F.when(total["odd"], digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)
        return F.struct((total["sum"] + value).alias("sum"), (~total["odd"]).alias("odd"))

    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d: d.cast("int"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(each, start, add, lambda t: t["sum"] % 10 == 0)


def _valid(kind: Column, value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = _digits(value)
    count = F.char_length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(count.between(16, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", count.between(8, 15))
        .otherwise(F.lit(True))
    )


def _located(docs: DataFrame, staging: Staging) -> DataFrame:
    """Staged: every match with its place; at least one row per document, without a kind where nothing matches."""
    text = whole_text()
    nothing = F.array().cast(
        "array<struct<kind:string,place:int,gap:int,value:string,before:string,after:string>>"
    )
    digit = text.rlike("[0-9]")
    parts = [F.when(text.contains("@"), _matches(text, "email", PATTERNS["email"])).otherwise(nothing)]
    parts += [F.when(digit, _matches(text, k, PATTERNS[k])).otherwise(nothing) for k in ("ip", "card")]
    parts += [F.when(digit & text.contains("+"), _matches(text, "phone", PATTERNS["phone"])).otherwise(nothing)]
    parts += [F.when(digit | text.contains("@"), _matches(text, TOKEN, TOKEN_PATTERN)).otherwise(nothing)]
    parts += [F.when(text.rlike(r"[0-9]\x20[+(]*[0-9]"), _matches(text, RUN, RUN_PATTERN)).otherwise(nothing)]
    # The number first: given beside the explode, it would number the matches.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.concat(*parts).alias("matches"),
    ).select("row", "doc_id", F.explode_outer("matches").alias("match"))
    rows = staging.write(rows.select("row", "doc_id", "match.*"), "matches")
    length = F.char_length("value")
    in_order = Window.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + length).over(in_order.rowsBetween(Window.unboundedPreceding, 0))

    def joined(*pieces: Column, first: int, last: int) -> Column:
        return F.array_join(F.collect_list(F.concat(*pieces)).over(in_order.rowsBetween(first, last)), "")

    # The pieces end at the matches beside; the text itself goes on with those.
    earlier = joined(F.col("before"), F.right("value", F.lit(AROUND)), first=-NEIGHBOURS, last=-1)
    later = joined(F.left("value", F.lit(AROUND)), F.col("after"), first=1, last=NEIGHBOURS)
    placed = rows.withColumns({
        "end": end,
        "before": F.right(F.concat(earlier, "before"), F.lit(AROUND)),
        "after": F.left(F.concat("after", later), F.lit(AROUND)),
    }).withColumn("start", F.col("end") - length)
    return staging.write(placed.drop("gap", "place"), "located")


# -- patterns and instances -------------------------------------------------------------------------------------------


def _occurrences(located: DataFrame, base: DataFrame, staging: Staging) -> DataFrame:
    """Staged: base spans and other tokens with their instance and patterns; kind is null for those that are no seeds."""
    opening = F.regexp_extract("value", LEAD_PATTERN, 0)
    lead, quote = F.char_length(opening), F.regexp_extract(opening, "[\"']$", 0)
    trimmed = F.regexp_extract("value", rf"""{LEAD_PATTERN}(.*?)[\])>"'.,;:!?]*$""", 1)
    # A value that begins with a quote ends with it.
    trimmed = F.when(quote != "", F.split_part(trimmed, quote, F.lit(1))).otherwise(trimmed)
    name = F.regexp_extract("value", NAME_PATTERN, 1)
    tokens = located.filter(F.col("kind").isin(TOKEN, RUN)).select(
        "row", (F.col("start") + lead).alias("start"), trimmed.alias("value"),
        F.concat("before", name).alias("before"), "after",
    )
    tokens = tokens.withColumn("end", F.col("start") + F.char_length("value")).filter("value RLIKE '[0-9@]'")
    tokens = staging.write(tokens, "tokens")
    spans = base.select("row", F.col("start").alias("_start"), F.col("end").alias("_end"))
    apart = tokens.join(
        spans, (tokens["row"] == spans["row"]) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")),
        "left_anti",
    )
    named = F.col("before").rlike(SECRET_BEFORE) & F.col("value").rlike(SECRET_FORM)
    secret = F.when(named | F.col("value").rlike(SECRET_PREFIXES), F.lit(SECRET))
    both = apart.withColumn("kind", secret).unionByName(
        base.select("row", "start", "value", "before", "after", "end", "kind")
    )
    before = F.split(F.lower(F.trim(F.translate("before", "\t\n\r\x0b\x0c", "     "))), " +")
    after = F.split(F.lower(F.trim(F.translate("after", "\t\n\r\x0b\x0c", "     "))), " +")
    last, last_two = F.element_at(before, -1), F.array_join(F.slice(before, -2, 2), " ")
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), r"\p{L}+", "a")
    patterns = F.array(
        F.when(F.size(before) > 1, F.concat(F.lit("two "), last_two)),
        F.when(last != "", F.concat_ws(" ", F.lit("shape"), last, shape)),
        F.when((last != "") & (F.element_at(after, 1) != ""), F.concat_ws(" ", F.lit("sides"), last, F.element_at(after, 1))),
    )
    return staging.write(
        both.select(
            "row", "start", "end", "kind", F.xxhash64(F.lower("value")).alias("instance"),
            F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"),
        ),
        "occurrences",
    )


def _confidences(occurrences: DataFrame, staging: Staging, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Staged (pattern, kind, confidence) and (instance, kind, score), after the rounds."""
    edges = occurrences.select(F.explode("patterns").alias("pattern"), "instance").distinct()
    # Patterns that cannot have the support are of no use, and most are met once.
    sizes = staging.write(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT), "sizes")
    edges = staging.write(edges.join(sizes, "pattern"), "edges")
    seeds = occurrences.filter("kind IS NOT NULL").select("instance", "kind").distinct()
    seeds = staging.write(seeds.withColumn("score", F.lit(1.0)), "seeds")
    scores = seeds
    for turn in range(rounds):
        support = F.sum("score")
        by_pattern = edges.join(scores, "instance").groupBy("pattern", "n", "kind").agg(support.alias("support"))
        by_pattern = by_pattern.withColumn("confidence", F.col("support") / (F.col("n") + 1))
        useful = by_pattern.filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= USEFUL))
        patterns = staging.write(useful.select("pattern", "kind", "confidence"), f"patterns-{turn}")
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.99))))
        found = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        found = staging.write(found, f"found-{turn}").join(seeds.select("instance"), "instance", "left_anti")
        scores = staging.write(seeds.unionByName(found), f"scores-{turn}")
        staging.drop(f"found-{turn}", *([f"patterns-{turn - 1}", f"scores-{turn - 1}"] if turn else []))
    return patterns, scores


def _discovered(occurrences: DataFrame, staging: Staging, rounds: int) -> DataFrame:
    """row, start, end, kind of seeds of secrets and of occurrences that high-confidence patterns take for personal data."""
    patterns, scores = _confidences(occurrences, staging, rounds)
    sure = staging.write(patterns.filter(F.col("confidence") >= SURE), "sure")
    accepted = staging.write(scores.filter(F.col("score") >= ACCEPT), "accepted")
    open_ = occurrences.filter("kind IS NULL").drop("kind").withColumn("pattern", F.explode("patterns")).drop("patterns")
    told = open_.join(sure, "pattern").join(accepted, ["instance", "kind"])
    best = F.max(F.struct("confidence", "score", "kind"))["kind"]
    found = told.groupBy("row", "start", "end").agg(best.alias("kind"))
    found = found.unionByName(occurrences.filter(F.col("kind") == SECRET).select("row", "start", "end", "kind"))
    # A run and its tokens lie within each other or apart.
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.max("end").over(earlier) >= F.col("end"), F.lit(False))
    return found.withColumn("_within", within).filter(~F.col("_within")).drop("_within")


# -- the operator -----------------------------------------------------------------------------------------------------


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (spans beyond the base) and n_spans (all of them) per
    document."""
    staging = Staging(docs.sparkSession, "personal-data")
    located = _located(docs, staging)
    base = located.filter(F.col("kind").isin(*KINDS)).filter(_valid(F.col("kind"), F.col("value")))
    base = staging.write(base, "base")
    occurrences = _occurrences(located, base, staging)
    found = _discovered(occurrences, staging, rounds)

    order = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind"))

    def span(is_base: bool) -> Column:
        return F.struct(order.alias("order"), "start", "end", "kind", F.lit(is_base).alias("base"))

    nobody = F.lit(None).cast("bigint").alias("doc_id")
    every = located.groupBy("row").agg(F.max("doc_id").alias("doc_id"))
    every = every.select("row", "doc_id", F.lit(None).cast(_SPAN).alias("span"))
    spans = every.unionByName(base.select("row", nobody, span(True).cast(_SPAN).alias("span")))
    spans = spans.unionByName(found.select("row", nobody, span(False).cast(_SPAN).alias("span")))
    listed = spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list("span")).alias("spans")
    )  # a document's own spans

    def text(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")

    return listed.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_found"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


_SPAN = "struct<order:bigint,start:bigint,end:bigint,kind:string,base:boolean>"
