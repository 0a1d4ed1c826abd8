import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weekpanel import schemas, session
from weekpanel.operators import batches
from weekpanel.sources import readers, writers

TIME = dt.datetime(2019, 2, 3, 4, 5, 6)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")


def test_quotes_commas_and_nulls_in_messages(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        '2019_05:42,1,42,"says ""hi"", twice",2019-02-03 04:05:06,here,\n'
        '2019_05:42,x,42,plain,,,"[1,2]"\n'
        "2019_05:42,3\n",
        encoding="utf-8",
    )
    rows = readers.read_messages(spark, str(tmp_path / "*.csv")).collect()
    assert tuple(rows[0]) == ("2019_05:42", 1, 42, 'says "hi", twice', "2019-02-03 04:05:06", "here", None)
    assert tuple(rows[1]) == ("2019_05:42", None, 42, "plain", None, None, "[1,2]")
    assert tuple(rows[2])[:3] == ("2019_05:42", 3, None)


def test_raw_messages_by_glob(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text(f"{i},7,text,2021-01-01 00:00:00,,\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("9,9,no,,,\n", encoding="utf-8")
    df = readers.read_messages(spark, str(tmp_path / "*.csv"), keyed=False)
    assert df.schema == schemas.MESSAGES_RAW
    assert sorted(r["message_id"] for r in df.collect()) == [0, 1, 2]


def test_county_codes_keep_zeros_and_lose_blanks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('cnty,extra,user_id\n01001,x,1\n 01003 ,x,2\n,x,3\n1005,x,bad\n"01007\t",x,5\n', encoding="utf-8")
    rows = readers.read_user_county(spark, str(tmp_path / "m.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, "01001"), (2, "01003"), (3, None), (None, "1005"), (5, "01007")]


def test_weights_with_and_without_county(spark, tmp_path):
    (tmp_path / "w.csv").write_text("user_id,weight\n1,0.5\n2,\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("user_id,weight,cnty\n1,0.5,01001\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_weights(spark, str(tmp_path / "w.csv")).collect()] == [(1, 0.5), (2, None)]
    assert tuple(readers.read_weights(spark, str(tmp_path / "c.csv")).first()) == (1, 0.5, "01001")


def test_scores_round_trip(spark, folder):
    rows = [("2019_05:42", 42, "01001", 1.5, 2.5, 0.1, None)]
    writers.write_csv(spark.createDataFrame(rows, schemas.SCORES), folder, files=1)
    assert len(glob.glob(f"{folder}/*.csv")) == 1
    assert [tuple(r) for r in readers.read_scores(spark, folder).collect()] == rows


def test_csv_without_header_and_append(spark, folder):
    df = spark.createDataFrame([(1, "a,b"), (2, 'c"d')], "id int, t string")
    writers.write_csv(df, folder, header=False, files=1)
    writers.write_csv(df, folder, header=False, files=1)
    read = spark.read.schema("id int, t string").option("escape", '"').csv(folder)
    assert sorted(map(tuple, read.collect())) == [(1, "a,b"), (1, "a,b"), (2, 'c"d'), (2, 'c"d')]


def sample(spark, first, last, batch):
    rows = [(f"2019_05:{i}", i, i, "m", TIME, None, None, "01001", batch) for i in range(first, last)]
    return spark.createDataFrame(rows, StructType([*schemas.SAMPLED.fields, StructField("batch", LongType())]))


def test_batches_round_trip_and_append(spark, folder):
    assert readers.read_batches(spark, folder).count() == 0
    assert batches.next_batch_number(readers.read_batches(spark, folder)).first()[0] == 0
    writers.write_batches(sample(spark, 0, 5, 0).union(sample(spark, 5, 9, 1)), folder)
    writers.write_batches(sample(spark, 9, 12, 2), folder)
    read = readers.read_batches(spark, folder)
    assert read.columns == [*schemas.SAMPLED.fieldNames(), "batch"]
    assert {r["batch"]: r["messages"] for r in batches.batch_summary(read).collect()} == {0: 5, 1: 4, 2: 3}
    assert batches.next_batch_number(read).first()[0] == 3
    assert {r["created_at"] for r in read.collect()} == {TIME}


def test_one_directory_per_batch(spark, folder):
    writers.write_batches(sample(spark, 0, 50, 0).union(sample(spark, 50, 90, 7)), folder)
    assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{folder}/batch=*")} == {"batch=0", "batch=7"}


def test_a_large_batch_is_split_over_files(spark, folder, settings):
    settings(spark__sql__adaptive__advisoryPartitionSizeInBytes="64kb")
    rows = spark.range(0, 60_000, 1, 12).withColumn("batch", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(99))
    writers.write_batches(rows.select(F.col("id").alias("message_id"), F.sha2(F.col("id").cast("string"), 256).alias("message"), "batch"), folder)
    files = {b: len(glob.glob(f"{folder}/batch={b}/*.parquet")) for b in (0, 99)}
    assert files[99] > 3 >= files[0]
    assert spark.read.parquet(folder).count() == 60_000


def test_old_times_are_written_as_they_are(spark, folder):
    old = spark.createDataFrame([(dt.datetime(1500, 1, 1),)], "created_at timestamp").withColumn("batch", F.lit(0))
    writers.write_batches(old, folder)
    assert spark.read.parquet(folder).first()["created_at"] == dt.datetime(1500, 1, 1)
    assert spark.conf.get("spark.sql.parquet.int96RebaseModeInWrite") == "CORRECTED"


def test_heavy_users_and_week_counts(spark, tmp_path):
    users = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "user_id long, t string")
    writers.write_superusers(users, str(tmp_path / "heavy"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "heavy")).collect()) == [1, 2]
    counts = spark.createDataFrame([("a", 3)], "user_year_week string, message_count long")
    writers.write_week_counts(counts, str(tmp_path / "counts"))
    read = spark.read.option("header", True).csv(str(tmp_path / "counts"))
    assert [tuple(r) for r in read.collect()] == [("a", "3")]


def test_model_table_round_trip(spark, folder):
    rows = [("dep_score", 0, "0me", 0.0, 1.0, 2.0, 2.5)]
    spark.createDataFrame(rows, schemas.MODEL).write.parquet(folder)
    assert [tuple(r) for r in readers.read_model(spark, folder).collect()] == rows


def test_embeddings_of_several_globs(spark, tmp_path):
    rows = [("a", 1, 5, [[1.0], [2.0]], "01001")]
    for year in ("y1", "y2"):
        spark.createDataFrame(rows, schemas.USER_WEEK_EMBEDDINGS).write.parquet(str(tmp_path / year))
    df = readers.read_embeddings(spark, str(tmp_path / "y1" / "*.parquet"), str(tmp_path / "y2" / "*.parquet"))
    assert df.count() == 2
    assert df.schema["embedding"].dataType.simpleString() == "array<array<double>>"


def test_other_read_errors_are_not_swallowed(spark, tmp_path):
    (tmp_path / "batch=0").mkdir()
    (tmp_path / "batch=0" / "part.parquet").write_text("not parquet", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)parquet"):
        readers.read_batches(spark, str(tmp_path)).collect()


def test_staged_tables_lie_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    staged = session.stage(spark.range(5).withColumn("x", F.lit(None).cast("string")), "probe")
    assert staged.count() == 5
    assert all(shared in f for f in staged.inputFiles())


def test_a_file_folder_that_a_cluster_shares_is_taken(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://head:7077")
    staged = session.stage(spark.range(5), "probe")
    assert staged.count() == 5
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in staged.inputFiles())


def test_a_folder_that_loses_rows_is_refused(spark, monkeypatch, tmp_path):
    session.require_shared(spark, f"file://{tmp_path}/shared")
    (tmp_path / "own").write_text("no folder", encoding="utf-8")
    with pytest.raises(ValueError, match="own"):
        session.require_shared(spark, f"file://{tmp_path}/own")
    frame = type(spark.range(1))
    count = frame.count
    monkeypatch.setattr(frame, "count", lambda df: count(df.limit(1)))  # what most tasks wrote is not seen
    with pytest.raises(ValueError, match="own"):
        session.require_shared(spark, f"file://{tmp_path}/shared")


def _settings(monkeypatch, spark, **given):
    """``spark.conf.get`` answers as given, None for what is not set; the master is that of a cluster."""
    conf = type(spark.conf)
    get = conf.get

    def answer(self, key, *default):
        return given[key] if key in given else get(self, key, *default)

    monkeypatch.setattr(conf, "get", answer)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://head:7077")
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)


def test_a_cluster_without_a_checkpoint_folder_stages_in_the_warehouse(spark, monkeypatch, tmp_path):
    _settings(monkeypatch, spark, **{"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": f"file://{tmp_path}/tables"})
    staged = session.stage(spark.range(5), "probe")
    assert staged.count() == 5
    assert all(f"{tmp_path}/tables" in f for f in staged.inputFiles())


def test_the_warehouse_is_taken_for_a_checkpoint_folder_that_is_not_shared(spark, monkeypatch, tmp_path):
    (tmp_path / "own").write_text("no folder", encoding="utf-8")
    own, tables = f"file://{tmp_path}/own", f"file://{tmp_path}/tables"
    _settings(monkeypatch, spark, **{"spark.checkpoint.dir": own, "spark.sql.warehouse.dir": tables})
    assert session.shared_folder(spark) == tables
    _settings(monkeypatch, spark, **{"spark.checkpoint.dir": f"{own}/x", "spark.sql.warehouse.dir": f"{own}/y"})
    with pytest.raises(ValueError, match="share"):
        session.shared_folder(spark)


def test_the_temporary_folder_of_one_machine_is_the_same_for_every_process(spark, monkeypatch, tmp_path):
    _settings(monkeypatch, spark, **{"spark.checkpoint.dir": None})
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    monkeypatch.setattr(session, "_LOCAL_FOLDERS", {})
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(session.tempfile, "tempdir", "/proc/self/cwd")  # each process has another working directory
    assert session.shared_folder(spark).startswith(f"{os.path.realpath(tmp_path)}/")


def test_shuffle_sizing():
    assert session.shuffle_partitions(0) == 8
    assert session.shuffle_partitions(10 * 2**40) == 10_240
    assert session.shuffle_partitions(1000 * 2**40) == session.MOST_REDUCERS


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,weight\n1,0.5\n")
    (tmp_path / "b.csv").write_text("weight,user_id\n0.25,2\n")
    with pytest.raises(Exception, match="header"):
        readers.read_weights(spark, str(tmp_path)).collect()


def test_broken_records_are_told_apart_and_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        '2019_05:42,1,42,"says ""hi"", twice",2019-02-03 04:05:06,here,\n'
        "2019_05:42,x,42,wrong type,,,\n"
        "2019_05:42,3\n"
        "2019_05:42,4,42,too many,,,,,,\n"
        '2019_05:42,5,42,"two\nlines",2019-02-03 04:05:06,,\n',
        encoding="utf-8",
    )
    (tmp_path / "b.csv").write_text("2019_05:7,6,7,fine,,,\n", encoding="utf-8")
    checked = readers.read_checked(spark, str(tmp_path / "*.csv"))
    report = {r["source_file"]: (r["messages"], r["broken"]) for r in writers.quarantine_report(checked).collect()}
    assert report == {"a.csv": (1, 5), "b.csv": (1, 0)}
    fine = writers.write_quarantine(checked, str(tmp_path / "quarantine"))
    assert fine.columns == schemas.MESSAGES_KEYED.fieldNames()
    assert sorted(r["message_id"] for r in fine.collect()) == [1, 6]
    aside = spark.read.parquet(str(tmp_path / "quarantine")).collect()
    assert {r["source_file"] for r in aside} == {"a.csv"} and len(aside) == 5
    assert {"2019_05:42,3", "2019_05:42,x,42,wrong type,,,"} < {r["broken_record"] for r in aside}
    whole = readers.read_checked(spark, str(tmp_path / "*.csv"), multi_line=True)
    report = {r["source_file"]: (r["messages"], r["broken"]) for r in writers.quarantine_report(whole).collect()}
    assert report == {"a.csv": (2, 3), "b.csv": (1, 0)}
    texts = {r["message_id"]: r["message"] for r in writers.write_quarantine(whole, str(tmp_path / "q2")).collect()}
    assert texts[5] == "two\nlines"
