"""Common table expressions of the oracle: the chains that several queries start from."""

from __future__ import annotations

import re

from checks.adapters import (
    ACTIVE,
    BATCH_LIMIT,
    DIM,
    N_LAYERS,
    SQL_INPUTS,
    SUPER_FROM,
    YEAR,
    duckdb_text,
)

# The patterns and column names of the library, as SQL.
RETWEET = r"regexp_matches(message, '^RT @\w+:')"
URL = (
    "regexp_matches(message, "
    r"'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+')"
)
MASKED = r"regexp_replace(message, '@\w+', '<USER>', 'g')"
SAMPLED = "user_year_week, user_id, message_id, message, created_at, location, coordinates, fips"
KEYED = "user_id IS NOT NULL AND message_id IS NOT NULL AND created_at IS NOT NULL"


def _deduped(source: str) -> str:
    return f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY
 created_at NULLS LAST, user_id, fips NULLS LAST, user_year_week NULLS LAST, message, location, coordinates) AS place
 FROM {source}) d WHERE place = 1"""


def _batched(weeks: str, start: str) -> str:
    """The greedy walk, one user-week at a time."""
    return f"""SELECT user_year_week, message_count, batch FROM (WITH RECURSIVE
 ordered AS (SELECT *, row_number() OVER (ORDER BY message_count, user_year_week) AS n FROM {weeks}),
 walk AS (SELECT n, user_year_week, message_count, CAST({start} AS BIGINT) AS batch, CAST(message_count AS BIGINT) AS used
   FROM ordered WHERE n = 1
  UNION ALL SELECT o.n, o.user_year_week, o.message_count,
   CASE WHEN w.used + o.message_count > {BATCH_LIMIT} THEN w.batch + 1 ELSE w.batch END,
   CAST(CASE WHEN w.used + o.message_count > {BATCH_LIMIT} THEN o.message_count ELSE w.used + o.message_count END AS BIGINT)
   FROM walk w JOIN ordered o ON o.n = w.n + 1)
 SELECT * FROM walk) b"""


def _scored(target: str) -> str:
    return f"""SELECT user_year_week, user_id, fips, sum(value * coef) + max(intercept) AS {target}
 FROM standardised WHERE target = '{target}' GROUP BY ALL"""


CHAINS = {
    **{name: duckdb_text(text) for name, text in SQL_INPUTS.items()},
    "located": f"""SELECT user_year_week, user_id, message_id, {MASKED} AS message, created_at, location, coordinates, cnty AS fips
 FROM messages_keyed JOIN user_county USING (user_id) WHERE {KEYED} AND NOT {RETWEET} AND NOT {URL}""",
    "unique_messages": _deduped("located"),
    "cleaned": "SELECT * FROM unique_messages WHERE regexp_matches(fips, '^[0-9]{5}$')",
    "masked": f"""SELECT user_year_week, user_id, message_id, {MASKED} AS message, created_at, location, coordinates
 FROM messages_keyed WHERE {KEYED}""",
    "masked_located": f"""SELECT {SAMPLED.replace('fips', 'cnty AS fips')} FROM masked JOIN user_county USING (user_id)
 WHERE NOT {RETWEET} AND NOT {URL}""",
    "masked_unique": _deduped("masked_located"),
    "masked_cleaned": "SELECT * FROM masked_unique WHERE regexp_matches(fips, '^[0-9]{5}$')",
    "text_located": f"""SELECT CAST(user_id AS VARCHAR) || ':' || CAST(year(created_at) AS VARCHAR) || '-'
  || CAST(week(created_at) AS VARCHAR) AS user_year_week, user_id, message_id, {MASKED} AS message, created_at, location,
  coordinates, cnty AS fips
 FROM (SELECT message_id, user_id, message, TRY_CAST(created_at AS TIMESTAMP) AS created_at, location, coordinates
  FROM messages_text WHERE {KEYED}) t JOIN user_county USING (user_id)
 WHERE year(created_at) = {YEAR} AND NOT {RETWEET} AND NOT {URL}""",
    "text_unique": _deduped("text_located"),
    "text_cleaned": "SELECT * FROM text_unique WHERE regexp_matches(fips, '^[0-9]{5}$')",
    "counts": "SELECT user_year_week, count(message_id) AS message_count FROM cleaned GROUP BY user_year_week",
    "heavy": f"""SELECT DISTINCT user_id FROM cleaned JOIN counts USING (user_year_week)
 WHERE message_count >= {SUPER_FROM}""",
    "active": f"SELECT * FROM counts WHERE message_count BETWEEN {ACTIVE[0]} AND {ACTIVE[1]}",
    "panel": f"""SELECT {SAMPLED} FROM cleaned WHERE user_year_week IN (SELECT user_year_week FROM active)
 AND user_id NOT IN (SELECT user_id FROM heavy)""",
    "prior": """SELECT *, CAST(week(created_at) - 1 AS BIGINT) AS batch FROM cleaned
 WHERE created_at < TIMESTAMP '2024-01-11 00:00:00'""",
    "fresh": "SELECT * FROM panel WHERE message_id NOT IN (SELECT message_id FROM prior)",
    "fresh_counts": "SELECT user_year_week, count(message_id) AS message_count FROM fresh GROUP BY user_year_week",
    "sent_first": f"SELECT {SAMPLED}, CAST(0 AS BIGINT) AS batch FROM documents_sent WHERE location = 'en'",
    "sent_counts": """SELECT user_year_week, count(*) AS message_count FROM documents_sent WHERE location <> 'en' OR location IS NULL
 GROUP BY user_year_week""",
    "sent_assigned": _batched("sent_counts", "1"),
    "assigned": _batched("active", "0"),
    "fresh_assigned": _batched("fresh_counts", "(SELECT max(batch) + 1 FROM prior)"),
    "valid_weeks": f"SELECT * FROM user_weeks WHERE len(embedding) = {N_LAYERS} AND len(embedding[1]) = {DIM}",
    "picked": """SELECT user_year_week, user_id, message_count, fips,
 CASE WHEN len(embedding) >= 2 THEN embedding[len(embedding) - 1] ELSE [] END AS vector FROM user_weeks""",
    "aligned": """SELECT v.user_year_week, v.user_id, v.fips, m.target, m.pos, m.mean, m.scale, m.coef, m.intercept,
 CAST(coalesce(v.embedding[len(v.embedding) - 1][m.pos + 1], 0) AS DOUBLE) AS value FROM valid_weeks v, model m""",
    "standardised": "SELECT * EXCLUDE (value), (value - mean) / scale AS value FROM aligned",
    "dep": _scored("dep_score"),
    "anx": _scored("anx_score"),
    "raw_scores": "SELECT dep.*, anx.anx_score FROM dep JOIN anx USING (user_year_week)",
    "scores": """SELECT *,
 5 * (dep_score - min(dep_score) OVER ()) / (max(dep_score) OVER () - min(dep_score) OVER ()) AS scaled_dep_score,
 5 * (anx_score - min(anx_score) OVER ()) / (max(anx_score) OVER () - min(anx_score) OVER ()) AS scaled_anx_score
 FROM raw_scores""",
    "weighted": """SELECT s.*, coalesce(w.weight, 1.0) AS user_weight,
 split_part(s.user_year_week, ':', 1) || '_' || s.fips AS year_week_county
 FROM scores s LEFT JOIN user_weights w USING (user_id)""",
    "home_counties": """SELECT s.user_year_week, s.user_id, s.fips, c.cnty FROM scores s LEFT JOIN user_county c USING (user_id)""",
    "melted": """SELECT user_id, year_week_county, fips, user_weight, 'DEP_SCORE' AS feat, scaled_dep_score AS feat_score
 FROM weighted UNION ALL SELECT user_id, year_week_county, fips, user_weight, 'ANX_SCORE', scaled_anx_score FROM weighted""",
    "vector_parts": """SELECT message_id, user_id, user_year_week, fips, weight, unnest(embedding) AS value,
 generate_subscripts(embedding, 1) - 1 AS pos FROM message_vectors""",
    "county_means": """SELECT fips, pos, avg(value) AS value FROM (SELECT fips, unnest(embedding) AS value,
 generate_subscripts(embedding, 1) - 1 AS pos FROM base_counties) p GROUP BY fips, pos""",
    "missing_unique": """SELECT fips, embedding FROM (SELECT *, row_number() OVER (PARTITION BY fips ORDER BY vec_id) AS place
 FROM missing_counties) m WHERE place = 1""",
    "county_rows": """SELECT fips, pos, value FROM county_means UNION ALL
 SELECT lpad(fips, 5, '0'), generate_subscripts(embedding, 1) - 1, CAST(unnest(embedding) AS DOUBLE) FROM missing_unique""",
}


def with_chains(sql: str) -> str:
    """Prefix ``sql`` with the chains it names, directly or through others, in the order of their definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CHAINS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+m\b", text):
                needed.add(name)
                visit(CHAINS[name])

    visit(sql)
    ctes = ",\n".join(f"{name} AS ({CHAINS[name]})" for name in CHAINS if name in needed)
    return f"WITH {ctes}\n{sql.strip()}" if ctes else sql.strip()
