"""Import and export of cards: JSON lines, CSV, Markdown; blob codecs; compaction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions import scalars as S

IMPORT_SCHEMA = "id string, text string, fact string, evidence string, timestamp double, tags array<string>, source_tokens bigint, embedding array<float>, access_count bigint, last_access double, superseded_by string, _bad string"


def export_frame(cards: DataFrame) -> DataFrame:
    """The exported form: text, metadata, vector norm and dimension."""
    return cards.selectExpr("id", "fact as text", "evidence", "timestamp", "tags", "struct(source_tokens, access_count, last_access, superseded_by) as metadata", f"if(embedding is null, null, {S.norm('embedding')}) as vector_norm", "coalesce(size(embedding), 0) as dim")


def write_jsonl(cards: DataFrame, path: str) -> None:
    export_frame(cards).write.mode("overwrite").json(path)


def csv_frame(cards: DataFrame) -> DataFrame:
    return cards.selectExpr("id", "fact", "array_join(tags, '|') as tags", "timestamp", "source_tokens", "access_count", f"format_string('%.6f', {S.norm('embedding')}) as vector_norm")


def write_csv(cards: DataFrame, path: str) -> None:
    csv_frame(cards).write.mode("overwrite").csv(path, header=True)


def markdown_frame(cards: DataFrame) -> DataFrame:
    return cards.selectExpr("concat('## ', id, '\\n\\n', coalesce(fact, ''), '\\n\\n- tags: ', array_join(tags, ', '), '\\n- accesses: ', access_count, '\\n') as value")


def write_markdown(cards: DataFrame, path: str) -> None:
    markdown_frame(cards).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid cards (id and a text or fact), with defaults, and the count of lines that were skipped."""
    raw = spark.read.schema(IMPORT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = "_bad is null and id is not null and coalesce(text, fact) is not null"
    cards = raw.where(ok).selectExpr("id", "coalesce(text, fact) as fact", "coalesce(evidence, '') as evidence", "coalesce(timestamp, 0D) as timestamp", "coalesce(tags, array()) as tags", "coalesce(source_tokens, 0) as source_tokens", "embedding", "coalesce(access_count, 0) as access_count", "coalesce(last_access, 0D) as last_access", "superseded_by")
    return cards, raw.where(f"not ({ok})").agg(F.count("*").alias("skipped"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those with their ids; of several new ones with an id the latest by timestamp."""
    last = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), F.col("timestamp")).alias("x")).select("id", "x.*")
    return old.join(last.select("id"), "id", "left_anti").unionByName(last.select(*old.columns))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_float32(blob: pd.Series) -> pd.Series:
    """Packed little-endian float32 to an array; null stays null, a cut value is dropped."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.BinaryType())
def pack_float32(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.BinaryType())
def pack_int8(values: pd.Series) -> pd.Series:
    """8-bit values to bytes."""
    return values.map(lambda v: None if v is None else np.asarray(v, "i1").tobytes())


@F.pandas_udf(T.ArrayType(T.ByteType()))
def unpack_int8(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "i1"))


def import_counts(old: DataFrame, cards: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row for an import of cards into old: imported, updated (of these, ids that were there), skipped lines."""
    there = cards.select("id").distinct().join(old.select("id", F.lit(1).alias("was")).distinct(), "id", "left")
    return there.agg(F.count("*").alias("imported"), F.count("was").alias("updated")).withColumn("skipped", skipped.scalar())


def parse_tags(col: str) -> str:
    """SQL: a JSON list of tags; anything else is an empty list."""
    return f"coalesce(from_json({col}, 'array<string>'), cast(array() as array<string>))"


def compact(current: DataFrame, path: str, version: int) -> str:
    """Write a snapshot of the current view to a directory of its own, then the pointer file that names it: readers see the old snapshot or the new one."""
    target = f"{path}/snapshot_v={version:08d}"
    current.write.mode("errorifexists").parquet(target)
    spark = current.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    # names sort by version, and a pointer is complete or not there: the newest one counts
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/_current_{version:08d}")
    pointer.getFileSystem(conf).create(pointer, False).close()
    return target


def current_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that the newest pointer file names."""
    jvm, folder = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    version = max(n.removeprefix("_current_") for n in names if n.startswith("_current_"))
    return spark.read.parquet(f"{path}/snapshot_v={version}")
