"""Validity: UTF-8 and well-formedness, as verdicts per document and as an error table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structure import paired, tags


class MalformedXmlError(ValueError):
    """A document is not valid UTF-8, or its tags do not match."""


def utf8_flags(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Rows (id, utf8_ok).  A null content is not valid."""
    return docs.select(id_col, F.coalesce(F.is_valid_utf8(F.col(content_col).cast("string")), F.lit(False)).alias("utf8_ok"))


def errors(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content", skip_misc: bool = False) -> DataFrame:
    """Rows (id, kind, off): utf8, stray_close, unclosed, mismatch, unterminated."""
    bad_bytes = utf8_flags(docs, id_col, content_col).where(~F.col("utf8_ok")).select(id_col, F.lit("utf8").alias("kind"), F.lit(0).cast("long").alias("off"))
    readable = docs.where(F.is_valid_utf8(F.col(content_col).cast("string")))
    rows = paired(tags(readable, id_col, content_col, skip_misc), id_col)
    kind = (
        F.when(F.col("depth") < 0, "stray_close")
        .when(F.col("tag") == "", "unterminated")
        .when((F.col("kind") == "open") & ((F.col("next_kind") != "close") | F.col("next_kind").isNull()), "unclosed")
        .when((F.col("kind") == "open") & (F.col("next_name") != F.col("_name")), "mismatch")
    )
    found = rows.select(id_col, kind.alias("kind"), "off").where(F.col("kind").isNotNull())
    return found.unionByName(bad_bytes)


def verdicts(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content", skip_misc: bool = False) -> DataFrame:
    """Rows (id, status): ok, malformed or no_tokens, for each document."""
    bad = errors(docs, id_col, content_col, skip_misc).select(id_col).distinct().withColumn("_bad", F.lit(True))
    has_tag = F.coalesce(F.contains(F.col(content_col).cast("string"), F.lit("<")), F.lit(False))
    status = F.when(F.col("_bad"), "malformed").when(~F.col("_has"), "no_tokens").otherwise("ok")
    return docs.select(id_col, has_tag.alias("_has")).join(bad, id_col, "left").select(id_col, status.alias("status"))


def well_formed(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content", strict: bool = False, skip_misc: bool = False) -> DataFrame:
    """The documents without errors; strict raises MalformedXmlError if there are others."""
    bad = errors(docs, id_col, content_col, skip_misc)
    if strict and (first := bad.limit(1).collect()):
        raise MalformedXmlError(f"document {getattr(first[0][id_col], 'id', first[0][id_col])}: {first[0]['kind']} at byte {first[0]['off']}")
    return docs.join(bad.select(id_col).distinct(), id_col, "left_anti")
