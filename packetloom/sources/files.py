"""Readers and writers for the file formats of the application."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("payload", T.StringType(), True),
        T.StructField("label", T.StringType(), True),
    ]
)


# How a missing value is written; an empty text stays an empty text.
NULL = "\\N"

# Encodings that Spark's text sources take themselves.
_NATIVE = {"UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"}


def _recode(source: str, target: str):
    @F.pandas_udf("string")
    def recode(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else s.encode(source).decode(target))

    return recode


def _recode_strings(df: DataFrame, source: str, target: str) -> DataFrame:
    recode = _recode(source, target)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: recode(F.col(c)) for c in names})


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, *, encoding: str = "UTF-8"
) -> DataFrame:
    """CSV with header and quoted multi-line fields, declared schema.

    Korean encodings (EUC-KR, CP949) are read byte by byte and decoded in
    Arrow batches, since Spark's own reader does not take them.
    """
    native = encoding.upper() in _NATIVE
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", NULL)
        .option("encoding", encoding if native else "ISO-8859-1")
        .csv(path)
    )
    return df if native else _recode_strings(df, "iso-8859-1", encoding)


def write_csv(df: DataFrame, path: str, *, encoding: str = "UTF-8") -> None:
    native = encoding.upper() in _NATIVE
    out = df if native else _recode_strings(df, encoding, "iso-8859-1")
    (
        out.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("encoding", encoding if native else "ISO-8859-1")
        .option("emptyValue", "")
        .option("nullValue", NULL)
        .csv(path)
    )


def read_json_field(
    spark: SparkSession, path: str, field: str, record: T.StructType | str
) -> DataFrame:
    """The records of an array field, one row each.

    One document per file is read whole, so a large corpus should come as
    many files or as JSON lines with one array per line.
    """
    text = record if isinstance(record, str) else record.simpleString()
    docs = spark.read.schema(f"{field} array<{text}>").json(path, multiLine=True)
    return docs.select(F.inline(field))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object per line; characters stay as they are."""
    df.write.json(path)


def nested_records(df: DataFrame, field: str) -> DataFrame:
    """Rows as ``{field: [record]}`` documents, one per line.

    A document per record keeps the write parallel; ``read_json_field`` and the
    line reader take documents with any number of records.
    """
    return df.select(F.array(F.struct(*df.columns)).alias(field))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``path, text``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


# Markup that html_text takes out and the entities it resolves.
_DROPPED = r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
_BREAKS = r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/article|/section)\b[^>]*>"
_TAGS = r"<[^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(c):
    """Readable text of a page: markup out, entities resolved, blanks tidied."""
    out = F.regexp_replace(c, _DROPPED, " ")
    out = F.regexp_replace(F.regexp_replace(out, _BREAKS, "\n"), _TAGS, " ")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))
