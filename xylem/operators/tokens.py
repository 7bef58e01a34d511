"""Structural tokens: the characters `<`, `/` and `=` that carry structure, outside CDATA."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKENS, byte_view, mask_cdata


def tokens(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Rows (id, off, tok, depth).  `<` opens, `/` closes (before `>` or after `<`), `=` begins a double-quoted value.

    Documents are dealt by id once; every later window uses that partitioning.
    """
    binary = docs.schema[content_col].dataType.typeName() == "binary"
    masked = mask_cdata(byte_view(F.col(content_col), binary))
    pieces = docs.repartition(id_col).select(id_col, F.posexplode(F.split(masked, TOKENS)).alias("_i", "_piece"))
    order = Window.partitionBy(id_col).orderBy("_i")
    piece = F.col("_piece")
    tok = (
        F.when(piece.rlike(r"\A<(?!/)") & (piece != "<"), "<")
        .when(F.startswith(piece, F.lit('="')), "=")
        .when(F.startswith(piece, F.lit("/>")) | (F.startswith(piece, F.lit("/")) & F.endswith(F.lag("_piece").over(order), F.lit("<"))), "/")
    )
    placed = pieces.select(id_col, "_i", (F.sum(F.length(piece)).over(order) - F.length(piece)).alias("off"), tok.alias("tok"))
    sign = F.when(F.col("tok") == "<", 1).when(F.col("tok") == "/", -1).otherwise(0)
    depth = F.sum(sign).over(order) - F.when(F.col("tok") == "<", 1).otherwise(0)
    return placed.select(id_col, "off", "tok", depth.cast("int").alias("depth")).where(F.col("tok").isNotNull())


def token_counts(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Tokens of each kind for each document, without dealing or exploding anything."""
    binary = docs.schema[content_col].dataType.typeName() == "binary"
    masked = mask_cdata(byte_view(F.col(content_col), binary))
    count = lambda pattern: F.regexp_count(F.col("_m"), F.lit(pattern)).cast("long")
    return docs.select(id_col, masked.alias("_m")).select(id_col, count("<(?!/|$)").alias("n_open"), (count("</|/>")).alias("n_close"), count('="').alias("n_value"))
