"""Matches: spans and text of the elements that a path selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import START_TAG, decode_entities, from_bytes


def matches(selected: DataFrame, id_col: str = "doc_id", docs: DataFrame | None = None, content_col: str = "content", entities: bool = False) -> DataFrame:
    """Rows (id, match_no from 1, start_off, end_off, raw, text).  With docs, raw of elements that have children is cut from
    the documents, for the final matches only; otherwise it is null."""
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("start_off")).cast("long")
    out = selected.select(id_col, number.alias("match_no"), "start_off", "end_off", "close_off", "raw", "text")
    if docs is not None:
        binary = docs.schema[content_col].dataType.typeName() == "binary"
        # a document meets its matches once, whatever their number; slices of bytes cost their own length only
        need = out.where(F.col("raw").isNull()).groupBy(id_col).agg(F.collect_list(F.struct(*[c for c in out.columns if c not in (id_col, "raw")])).alias("_matches"))
        content = F.col(content_col) if binary else F.encode(F.col(content_col), "UTF-8")
        need = need.join(docs.select(id_col, content.alias("_c")), id_col)
        view = lambda m: F.decode(F.substr("_c", (m["start_off"] + 1).cast("int"), (m["close_off"] - m["start_off"]).cast("int")), "ISO-8859-1")
        inner = lambda m: from_bytes(F.regexp_replace(view(m), START_TAG, ""))
        need = need.select(id_col, F.explode(F.transform("_matches", lambda m: m.withField("raw", inner(m)))).alias("_m")).select(id_col, "_m.*")
        out = out.where(F.col("raw").isNotNull()).unionByName(need)
    text = F.col("text")
    return out.select(id_col, "match_no", "start_off", "end_off", "raw", (decode_entities(text) if entities else text).alias("text"))


def match_counts(selected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return selected.groupBy(id_col).agg(F.count("*").alias("n_matches"))


def preview(found: DataFrame, id_col: str = "doc_id", n: int = 10) -> DataFrame:
    """The first n matches by document and place."""
    return found.orderBy(id_col, "match_no").limit(n)
