"""Readers of messages, maps, scores, weights, embeddings, models and earlier batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel import schemas
from weekpanel.session import stage

_BLANKS = " \t\r\n"
Paths = "str | list[str]"


def read_messages(spark: SparkSession, path: Paths, keyed: bool = True) -> DataFrame:
    """Headerless CSV with quotes doubled inside quotes; columns by position. ``path`` may hold globs."""
    schema = schemas.MESSAGES_KEYED if keyed else schemas.MESSAGES_RAW
    return spark.read.schema(schema).option("header", False).option("quote", '"').option("escape", '"').csv(path)


#: Columns of :func:`read_checked` beside those of the messages: the record as it stands if it did not parse, and its file.
RECORD, FILE = "broken_record", "source_file"


def read_checked(spark: SparkSession, path: Paths, keyed: bool = True, multi_line: bool = False) -> DataFrame:
    """Messages as :func:`read_messages` reads them, with the records that do not parse told apart.

    A record with too few or too many fields, or with a value of the wrong type, keeps its text in ``broken_record``,
    where :func:`read_messages` would leave nulls; it is null for the others. ``source_file`` names the file. Texts with
    line ends inside quotes need ``multi_line``, which reads a file in one task; without it each of their lines is a
    broken record, so they are counted and not lost. What is read is staged: the parser judges only the columns that a
    query asks for, and here all of them count, once.
    """
    kept = schemas.MESSAGES_KEYED if keyed else schemas.MESSAGES_RAW
    schema = T.StructType([*kept.fields, T.StructField(RECORD, T.StringType(), True)])
    reader = spark.read.schema(schema).option("header", False).option("quote", '"').option("escape", '"')
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).option("multiLine", multi_line)
    return stage(reader.csv(path).select(*kept.fieldNames(), RECORD, F.col("_metadata.file_name").alias(FILE)), "checked")


def read_user_county(spark: SparkSession, path: Paths) -> DataFrame:
    """CSV with a header: user and county. Codes stay text and lose surrounding blanks and line ends."""
    return _headed_csv(spark, path, schemas.USER_COUNTY)


def read_scores(spark: SparkSession, path: Paths) -> DataFrame:
    return _headed_csv(spark, path, schemas.SCORES)


def read_weights(spark: SparkSession, path: Paths) -> DataFrame:
    """CSV with a header: user, weight and, if the file has it, county."""
    return _headed_csv(spark, path, schemas.USER_WEIGHTS, optional=("cnty",))


def read_embeddings(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of one or more globs, with the types the files declare."""
    return spark.read.parquet(*paths)


def read_model(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet model table: one row per target and feature."""
    return spark.read.schema(schemas.MODEL).parquet(*paths)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches written so far, with their ``batch``; no rows where nothing has been written yet."""
    schema = T.StructType([*schemas.SAMPLED.fields, T.StructField("batch", T.LongType(), True)])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _headed_csv(spark: SparkSession, path: Paths, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns are found by their names in the header and typed afterwards; a value of the wrong type is null.

    All files must have the header of the first: with ``enforceSchema`` off, Spark holds each file's against it and
    fails on one that differs, where it would otherwise take values by position.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    names = reader.csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType(), True) for name in names])
    raw = reader.schema(text).option("enforceSchema", False).csv(path)

    def typed(field: T.StructField) -> Column:
        value = F.btrim(F.col(field.name), F.lit(_BLANKS))
        return value if isinstance(field.dataType, T.StringType) else value.try_cast(field.dataType)

    fields = [f for f in schema.fields if f.name in raw.columns or f.name not in optional]
    return raw.select(*[typed(f).alias(f.name) for f in fields])
