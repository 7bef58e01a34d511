"""Size statistics of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import token_counts, tokens


def doc_stats(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, max_depth, has_cdata)."""
    sizes = docs.select(id_col, F.octet_length(content_col).cast("long").alias("n_bytes"), F.contains(F.col(content_col).cast("string"), F.lit("<![CDATA[")).alias("has_cdata"))
    deep = tokens(docs, id_col, content_col).groupBy(id_col).agg(F.count("*").alias("n_tokens"), F.max(F.when(F.col("tok") != "=", F.col("depth"))).alias("max_depth"))
    return sizes.join(deep, id_col, "left").select(id_col, "n_bytes", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "max_depth", "has_cdata")


__all__ = ["doc_stats", "token_counts"]
