"""File sources and sinks: uploaded documents and programs to text, reports to tables."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.service import MAX_BYTES, accepted, extension

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, mode: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, text, error): files of a folder as text; kinds that the mode doesn't take are left out.

    Files over max_bytes, and those that can't be read, have an error and no text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(accepted(F.col("path"), F.lit(mode)))
    ext, small = extension(F.col("path")), F.col("length") <= max_bytes
    content = F.when(small, F.col("content"))
    plain = files.filter(~ext.isin(".docx", ".pdf")).select("path", "length", decoded(content).alias("text"))
    rich = files.filter(ext.isin(".docx", ".pdf")).select("path", "length", rich_text(content, ext).alias("text"))
    fault = F.when(F.col("length") > max_bytes, "file too large").when(F.col("text").isNull(), "cannot extract text")
    return plain.unionByName(rich).withColumn("error", fault)


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def docx_text(data: bytes) -> str | None:
    """Paragraphs of a Word file, tables and headers left out."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p")).strip()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return None


def pdf_text(data: bytes) -> str | None:
    """Pages of a PDF file, where a reader for them is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages).strip()
    except Exception:  # readers raise many kinds on broken files
        return None


@F.pandas_udf(StringType())
def rich_text(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else docx_text(c) if e == ".docx" else pdf_text(c) for c, e in zip(content, ext, strict=True)])


def object_keys(user_id: Column, name: Column, content: Column) -> Column:
    """users/<id>/<hash of the content>_<name>: the same file of a user has the same key, and is one object."""
    return F.concat(F.lit("users/"), user_id.cast("string"), F.lit("/"), F.md5(content), F.lit("_"), F.regexp_replace(name, r"[/\\\\]", "_"))


def write_objects(files: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Stores uploaded files (user_id, name, content) as rows (user_id, key, name, content) in folders by user.

    Returns (user_id, name, key, error) of all of them; files over max_bytes are not stored and have an error and no key.
    """
    key, fits = object_keys(F.col("user_id"), F.col("name"), F.col("content")), F.octet_length("content") <= max_bytes
    files.filter(fits).select("user_id", key.alias("key"), "name", "content").write.mode("append").partitionBy("user_id").parquet(path)
    return files.select("user_id", "name", F.when(fits, key).alias("key"), F.when(~fits, "file too large").alias("error"))


def write_reports(reports: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append reports as Parquet or JSON lines."""
    reports.write.mode("append").format(kind).save(path)


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database by JDBC; give partitionColumn and bounds to read in parallel."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
