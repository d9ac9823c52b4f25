"""Card schema, liveness, and views that turn the fixture tables into cards, edges and touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, fact string, evidence string, timestamp double, tags array<string>, source_tokens bigint, embedding array<float>, access_count bigint, last_access double, superseded_by string, stability double, importance double, archived double, scope string"
EDGE_SCHEMA = "source_id string, target_id string, relation_type string, weight double, created_at double, scope string"
AS_OF = 1706659200.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def padded(number: str) -> str:
    """SQL for a number as text with zeros before it up to six characters; longer ones stay whole, where lpad(x, 6, '0') would cut them."""
    return f"lpad({number}, greatest(6, length({number})), '0')"


def live(cards: DataFrame, archived_too: bool = False) -> DataFrame:
    """Cards that are neither superseded nor (unless asked for) archived."""
    out = cards.where("superseded_by is null")
    return out if archived_too else out.where("coalesce(archived, 0) = 0")


def cards_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(
        f"concat('v', {padded('vec_id')}) as id", "concat('vector ', vec_id) as fact", "'' as evidence", "1704067200D + vec_id * 600 as timestamp", "array(concat('label=', label)) as tags", "0L as source_tokens", "embedding",
        "vec_id % 5 as access_count", "1704067200D + vec_id * 600 + (vec_id % 7) * 86400 as last_access", f"if(vec_id % 17 = 0, concat('v', {padded('vec_id + 1')}), null) as superseded_by",
        "1D + (vec_id % 4) * 0.5D as stability", "(vec_id % 3) / 2D as importance", "if(vec_id % 23 = 0, 1704067200D, 0D) as archived", "concat('user_id=', label % 3) as scope", "vec_id", "label",
    )


def cards_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(f"concat('d', {padded('doc_id')}) as id", "text as fact", "'' as evidence", "array(lang, source) as tags", "1704067200D + doc_id * 60 as timestamp", "concat('lang=', lang) as scope", "doc_id")


def cards_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card for each user of the touch log."""
    t = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "unix_micros(cast(ts as timestamp)) / 1000000D as at")
    return t.groupBy("user_id").agg(F.count("*").alias("access_count"), F.min("at").alias("timestamp"), F.max("at").alias("last_access"), F.expr("max_by(event_type, struct(at, event_id))").alias("last_type"))
