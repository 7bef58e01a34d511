"""From documents to elements: depth, pairing, parents, siblings, attributes and text.

One regular expression cuts a document into tags, each with the character data and CDATA after it.  All that follows is
windows within a document, and documents are dealt by id once, so the plan has one exchange however many windows a
query keeps; Catalyst drops those whose columns it does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NAME, PIECES, START_TAG, attributes, byte_view, from_bytes, mask_misc, unwrap

ELEMENT_COLUMNS = ("elem_id", "parent_id", "depth", "name", "sibling_idx", "sibling_count", "start_off", "close_off", "end_off", "self_closing", "attrs", "text", "raw")


def tags(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content", skip_misc: bool = False) -> DataFrame:
    """One row per tag: id, off, kind (open, close, empty), depth, name, piece, tag (the start tag)."""
    binary = docs.schema[content_col].dataType.typeName() == "binary"
    view = byte_view(F.col(content_col), binary)
    view = mask_misc(view) if skip_misc else view
    pieces = docs.repartition(id_col).select(id_col, F.posexplode(F.regexp_extract_all(view, F.lit(PIECES), F.lit(0))).alias("_i", "piece"))
    order = Window.partitionBy(id_col).orderBy("_i")
    piece = F.col("piece")
    found = pieces.select(id_col, "_i", (F.sum(F.length(piece)).over(order) - F.length(piece)).alias("off"), "piece", F.regexp_extract(piece, START_TAG, 0).alias("tag"))
    is_tag = F.startswith(piece, F.lit("<")) & ~F.startswith(piece, F.lit("<![CDATA["))
    kind = F.when(~is_tag, F.lit(None)).when(F.startswith(piece, F.lit("</")), "close").when(F.endswith("tag", F.lit("/>")), "empty").otherwise("open")
    found = found.withColumn("kind", kind).where(F.col("kind").isNotNull())
    sign = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = F.sum(sign).over(order) - F.when(F.col("kind") == "open", 1).otherwise(0)
    return found.select(id_col, "off", "kind", depth.cast("int").alias("depth"), F.regexp_extract(piece, NAME, 1).alias("_name"), "piece", "tag")


def paired(tag_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds, in document and depth: the next tag's offset, kind and name, and the parent's offset.

    At one depth an open tag's partner is the next tag.  An element's parent is the tag before it if that one opens; otherwise the
    tag before closes a sibling, whose parent it shares.
    """
    order = Window.partitionBy(id_col).orderBy("off")
    level = Window.partitionBy(id_col, "depth").orderBy("off")
    before = F.when((F.lag("kind").over(order) == "open") & (F.col("kind") != "close"), F.lag("off").over(order))
    out = tag_rows.withColumns({"_before": before, "_next_in_doc": F.lead("off").over(order)})
    return out.withColumns({
        "next_off": F.lead("off").over(level),
        "next_kind": F.lead("kind").over(level),
        "next_name": F.lead("_name").over(level),
        "parent_id": F.last("_before", ignorenulls=True).over(level),
    })


def elements(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content", skip_misc: bool = False) -> DataFrame:
    """One row per element: id and ELEMENT_COLUMNS.  text is that of leaves, unwrapped; raw their bytes as they stand (a
    whole tag for an empty element).  Both are null for other elements.  Malformed documents give what pairs; see `validate`."""
    rows = paired(tags(docs, id_col, content_col, skip_misc), id_col).where(F.col("kind") != "close")
    empty = F.col("kind") == "empty"
    leaf = (F.col("kind") == "open") & (F.col("next_off") == F.col("_next_in_doc"))
    data = F.substr("piece", F.length("tag") + 1)
    out = rows.select(
        id_col,
        F.col("off").alias("elem_id"),
        F.when(F.col("depth") > 0, F.col("parent_id")).alias("parent_id"),
        "depth",
        from_bytes(F.col("_name")).alias("name"),
        F.col("off").alias("start_off"),
        F.when(empty, F.col("off") + F.length("tag") - 2).when(F.col("next_kind") == "close", F.col("next_off")).alias("close_off"),
        F.when(empty, F.col("off") + F.length("tag")).when(F.col("next_kind") == "close", F.col("next_off") + F.length("_name") + 3).alias("end_off"),
        empty.alias("self_closing"),
        attributes(F.col("tag")).alias("attrs"),
        F.when(leaf, from_bytes(unwrap(data))).alias("text"),
        F.when(leaf, from_bytes(data)).when(empty, from_bytes(F.col("tag"))).alias("raw"),
    )
    siblings = Window.partitionBy(id_col, "parent_id", "depth", "name")
    out = out.withColumns({
        "sibling_idx": (F.row_number().over(siblings.orderBy("start_off")) - 1).cast("int"),
        "sibling_count": F.count("*").over(siblings).cast("int"),
    })
    return out.select(id_col, *ELEMENT_COLUMNS)
