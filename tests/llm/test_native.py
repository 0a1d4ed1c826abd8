"""Sharding, exact duplicates and personal data, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from weekpanel.llm import exact_dedup, personal_data, sharding
from weekpanel.llm.queries import ORACLE, QUERIES
from weekpanel.llm.shared import Staging

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, digest string"
A_TO_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def docs(spark, rows):
    """Documents beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", 99, "y") for d, t in rows], SCHEMA)


ROWS = [(5, "b" * 50), (1, "É same"), (2, "É SAME"), (3, "é same"), (4, None), (7, ""), (7, ""), (None, "É Same")]
ROWS += [(100 + k, "hot" if k % 3 == 0 else f"text {k % 40} " * (k % 17)) for k in range(400)]


def test_shards_are_contiguous_and_even(spark):
    got = sharding.contiguous_shards(docs(spark, ROWS).repartition(5)).collect()
    assert len(got) == len(ROWS)
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in got)
    texts = defaultdict(list)
    for d, t in ROWS:
        texts[d].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append((r["size"], r["text_crc32"]))
    assert {d: sorted(x) for d, x in texts.items()} == {d: sorted(x) for d, x in found.items()}
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert all(abs(s - sum(sizes.values()) / 8) <= 2 * largest for s in sizes.values())


def test_shards_of_whole_documents_agree_with_the_slim_rows(spark):
    frame = docs(spark, ROWS)
    slim = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.contiguous_shards(frame).collect()}
    whole = sharding.with_shards(frame)
    assert whole.columns == [*frame.columns, "shard_"]
    for r in whole.collect():
        assert r["shard"] == 99
        assert r["shard_"] == slim[r["doc_id"], zlib.crc32((r["text"] or "").encode())]


def test_equal_rows_are_cut_like_any_others(spark):
    """1,000 rows that are equal in everything, others beside them, and three that share a cut key but not their columns."""
    rows = [(5, "same text")] * 1_000 + [(k, "a") for k in range(5)] + [(9, "b" * 40)] * 40
    frame = docs(spark, rows).repartition(6)
    got = sharding.contiguous_shards(frame).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and sorted(sizes) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(s - sum(sizes.values()) / 8) <= 41 for s in sizes.values())
    whole = sharding.with_shards(frame.drop("shard")).collect()
    counted = Counter((r["doc_id"], r["text"], r["shard"]) for r in whole)
    slim = Counter((r["doc_id"], r["size"], r["shard"]) for r in got)
    assert {(d, len(t) + 1, s): n for (d, t, s), n in counted.items()} == dict(slim)


def test_rows_of_a_cut_key_keep_their_columns(spark):
    rows = [(1, "x", str(k)) for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(5)
    whole = sharding.with_shards(frame).collect()
    assert sorted(r["tag"] for r in whole) == sorted(t for _, _, t in rows)
    assert set(Counter(r["shard"] for r in whole).values()) <= {112, 113}


@pytest.mark.parametrize("counters", [1, 3, 1000])
def test_copies_whatever_the_number_of_counters(spark, counters, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 16)
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[(t or "").translate(A_TO_Z)].append(d)
    got = defaultdict(list)
    for r in exact_dedup.mark_copies(docs(spark, ROWS).repartition(7), counters).collect():
        got[r["text_sha256"]].append(r)
    assert set(got) == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    for text, ids in groups.items():
        rows = got[hashlib.sha256(text.encode()).hexdigest()]
        best = max((d for d in ids if d is not None), default=None)
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]


def test_misra_gries_names_every_frequent_digest(spark, monkeypatch):
    from weekpanel.llm.shared import Staging

    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 8)
    staging = Staging(spark, "test")
    rows = staging.write(exact_dedup.digests(docs(spark, ROWS).repartition(3)), "rows")
    named = exact_dedup.frequent_candidates(rows, staging, counters=4).collect()
    assert len(named) <= 4
    assert hashlib.sha256(b"hot").digest() in {bytes(r["digest"]) for r in named}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }
            if fine[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "é😀 a@b.c, 1.2.3.4 é 4111 1111 1111 1111 +1 (234) 567-8901.", "a@b.c_d@e.f", "256.1.1.1 001.2.3.4",
    "1.2.3.4.5.6.7.8", "4111-1111-1111-1112", "%-1)9@9.b(+a)b)(9bb%21@\n1\nb@b", "+1", "+12345678", "++123 456 789",
    "x " * 3000 + "a@b.cd", "1 " * 3000, "9" * 5000, "+" + "1" * 3000,
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[2])]
    got = personal_data.personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for d, text in rows:
        spans, row = base_spans(text), by_id[d]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["spans"] == listed
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]


def test_patterns_of_seeds_find_identifiers_that_no_base_pattern_knows(spark):
    cards = []
    number = 4000000000000000
    while len(cards) < 12:
        number += 137
        if luhn(str(number)):
            cards.append(number)
    rows = [(k, f"w{k} my card {c} expires soon") for k, c in enumerate(cards)]
    rows += [(100, "u my card 5550123456789010 expires soon"), (200, "code 12345 is nothing")]
    got = {r["doc_id"]: r for r in personal_data.personal_data(docs(spark, rows)).collect()}
    assert (got[100]["n_card"], got[100]["spans"], got[100]["n_found"]) == (0, "card:10:26", 1)
    assert got[200]["spans"] == ""


def test_identifiers_in_groups_and_after_numbers_are_found_whole(spark):
    phones = [(k, f"w{k} please call me at +1 555 867 {5300 + k} today") for k in range(12)]
    spaced, after_date = "u please call me at 555 867 5309 today", "on 2021-03-04 at 12:30 call me at 555 867 5309. So"
    cards = [n for n in range(4000000000000000, 4000000000002000) if luhn(str(n))][:12]
    cards = [(20 + k, f"ref 77 card {n} ends") for k, n in enumerate(cards)]
    after_number = "ref 77 card 5550123456789010 ends"
    between = "paid 77 5550 1234 5678 9010, 12 times"
    rows = [*phones, *cards, (100, spaced), (101, after_date), (102, after_number), (103, between)]
    got = {r["doc_id"]: r for r in personal_data.personal_data(docs(spark, rows)).collect()}

    def span(kind, text, value):
        return f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"

    assert got[100]["spans"] == span("phone", spaced, "555 867 5309")
    assert got[101]["spans"] == span("phone", after_date, "555 867 5309")
    assert got[102]["spans"] == span("card", after_number, "5550123456789010")
    assert got[103]["spans"] == ""


def test_secrets_are_seeds_and_lead_to_those_that_look_like_none(spark):
    values = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(8)]
    rows = [(k, f"é{k} 😀 token = \"{v}\" w{k}") for k, v in enumerate(values)]
    short = (100, 'u token = "hun7er2"### 12 x')
    joined = (101, "set API_KEY='" + values[0][:30] + "', then")
    prefixed = (102, "use AKIA" + "Q7" * 8 + " here")
    clean = [(200, f"commit {values[1][::-1]} is merged"), (201, "token = abc"), (202, "see https://a.b/token=1 or id=5"), (203, None)]
    got = {r["doc_id"]: r for r in personal_data.personal_data(docs(spark, [*rows, short, joined, prefixed, *clean])).collect()}

    def span(text, value):
        return f"secret:{text.index(value)}:{text.index(value) + len(value)}"

    for (d, text), value in zip(rows, values, strict=True):
        assert (got[d]["spans"], got[d]["n_found"], got[d]["n_spans"]) == (span(text, value), 1, 1)
        assert got[d]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[100]["spans"] == span(short[1], "hun7er2")
    assert got[101]["spans"] == span(joined[1], values[0][:30])
    assert got[102]["spans"] == span(prefixed[1], "AKIA" + "Q7" * 8)
    assert [got[d]["spans"] for d, _ in clean] == [""] * 4


def test_secrets_of_the_given_documents_are_found_and_others_left_alone(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in personal_data.personal_data(given).collect()}
    planted = {}
    for row in given.select("doc_id", "text").collect():
        planted[row["doc_id"]] = [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', row["text"] or "")]
    assert sum(map(len, planted.values())) > 0
    caught = 0
    for d, spans in planted.items():
        listed = got[d]["spans"].split(",")
        caught += sum(f"secret:{a}:{b}" in listed for a, b in spans)
        assert spans or "secret" not in got[d]["spans"]
    assert caught >= 0.9 * sum(map(len, planted.values()))


def test_words_around_a_match_are_those_of_the_text(spark):
    texts = ["a 1 b@c.de 22 4111 1111 1111 1111, 3 +1 (234) 567-8901 x", "7 " * 60, "DE89 3704 0044 05 is 2021-01-02 x", "x1y 2 3"]
    found = personal_data._located(docs(spark, list(enumerate(texts))), Staging(spark, "around")).collect()
    assert {"run", "token"} <= {r["kind"] for r in found}
    for r in found:
        text = texts[r["doc_id"]]
        assert r["value"] == text[r["start"] : r["end"]]
        assert (r["before"], r["after"]) == (text[: r["start"]][-64:], text[r["end"] :][:64])
    runs = {(r["doc_id"], r["value"]) for r in found if r["kind"] == "run"}
    assert {(2, "DE89 3704 0044 05"), (3, "2 3")} <= runs and (1, texts[1].strip()) in runs


@pytest.mark.parametrize("run", [sharding.contiguous_shards, exact_dedup.mark_copies, personal_data.personal_data])
def test_an_empty_table_gives_no_rows(spark, run):
    assert run(docs(spark, []).filter("false")).count() == 0


def test_exact_copies_agree_with_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = connection.execute(ORACLE["op6_exact_dedup"]).fetchdf()
    got = QUERIES["op6_exact_dedup"](spark, folder).select(*want.columns).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_no_python_runs_on_the_main_path(spark, physical_plan):
    frame = docs(spark, ROWS[:20])
    for run in (sharding.contiguous_shards, exact_dedup.mark_copies, personal_data.personal_data):
        plan = physical_plan(run(frame))
        assert not re.search("Python|Pandas|MapInArrow", plan)
