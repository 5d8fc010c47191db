"""The vocabulary mapping as two small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatprep.operators.vocabulary import draft_to_target, target_to_draft
from chatprep.sources.files import complete

D2T = "draft_id int, token_id bigint, d2t_offset bigint"
T2D = "token_id bigint, in_draft boolean"


def save_mapping(top: DataFrame, target_size: int, path: str, token: str = "token_id") -> bool:
    """Write both mappings unless they are there; True when written."""
    spark = top.sparkSession
    if complete(spark, f"{path}/t2d"):
        return False
    d2t = draft_to_target(top, token)
    d2t.selectExpr("cast(draft_id as int) draft_id", "cast(token_id as bigint) token_id", "cast(d2t_offset as bigint) d2t_offset").write.mode("overwrite").parquet(f"{path}/d2t")
    stored = spark.read.schema(D2T).parquet(f"{path}/d2t")
    target_to_draft(spark, stored, target_size).write.mode("overwrite").parquet(f"{path}/t2d")
    return True


def load_mapping(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(D2T).parquet(f"{path}/d2t"), spark.read.schema(T2D).parquet(f"{path}/t2d")
