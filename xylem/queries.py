"""The registered queries over the star schema as XML, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import corpora
from .engine import Documents as _Documents
from .operators import validate
from .operators.tokens import token_counts
from .sources.documents import shared_path
from .sources.large import large_path


def Documents(df: DataFrame, **options) -> _Documents:  # noqa: N802
    """The corpora have unique ids."""
    return _Documents(df, unique_ids=True, **options)


def _qty() -> Column:
    return F.col("text").cast("double").alias("l_quantity")


def _orders(path: str, with_quantity: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Documents(corpora.orders_xml(spark, sf_dir)).xpath(path)
        return found.select(F.col("doc_id").alias("o_orderkey"), *[_qty()] * with_quantity)

    return run


def _key_of_part() -> Column:
    return F.regexp_extract("raw", 'key="([0-9]+)"', 1).cast("long").alias("p_partkey")


def _parts(path: str):
    return lambda spark, sf: Documents(corpora.parts_xml(spark, sf)).xpath(path).select(_key_of_part())


def utf8_valid_documents(spark, sf):
    return validate.utf8_flags(corpora.read(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.col("utf8_ok").alias("ok"))


def utf8_invalid_flagged(spark, sf):
    bad = F.array(*[F.unhex(F.lit(x)) for x in ("C328", "E28228", "EDA080", "F8808080")])
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.get(bad, (F.col("doc_id") % 4).cast("int")))).otherwise(F.encode("text", "UTF-8"))
    docs = corpora.read(spark, sf, "documents").select("doc_id", content.alias("content"))
    return validate.utf8_flags(docs).select("doc_id", F.col("utf8_ok").alias("ok"))


def token_counts_pages(spark, sf):
    return token_counts(corpora.pages(spark, sf))


def token_table_pages(spark, sf):
    rows = Documents(corpora.pages(spark, sf)).tokens()
    return rows.groupBy("doc_id", "tok").agg(F.count("*").alias("n"))


def cdata_masked_tokens(spark, sf):
    rows = Documents(corpora.documents_xml(spark, sf)).tokens()
    return rows.groupBy("doc_id").agg(F.count_if(F.col("tok") == "<").alias("n_open"), F.count_if(F.col("tok") == "/").alias("n_close"), F.count_if(F.col("tok") == "=").alias("n_value"))


def depth_histogram(spark, sf):
    e = Documents(corpora.geography_xml(spark, sf)).elements()
    return e.groupBy(F.col("depth").cast("long").alias("depth"), "name").agg(F.count("*").alias("n"))


def pair_spans_parts(spark, sf):
    e = Documents(corpora.parts_xml(spark, sf)).elements().where(F.col("name") == "part")
    return e.select(_key_of_part(), (F.col("end_off") - F.col("start_off")).cast("long").alias("n_bytes"))


def wellformed_flags(spark, sf):
    docs = corpora.orders_xml(spark, sf)
    k, c = F.col("doc_id") % 11, F.col("content")
    damaged = (
        F.when(k == 0, F.concat(c, F.lit("</order>")))
        .when(k == 1, F.concat(F.lit("<x>"), c))
        .when(k == 2, F.concat(F.lit("<x>"), c, F.lit("</y>")))
        .when(k == 3, F.concat(F.lit("<a><b>"), c, F.lit("</a></b>")))
        .when(k == 4, F.concat(F.lit("<a>"), c, F.lit("</a >")))
        .when(k == 5, F.concat(c, F.lit("<a/>"), c))
        .otherwise(c)
    )
    v = validate.verdicts(docs.withColumn("content", damaged))
    return v.select("doc_id", (F.col("status") == "ok").alias("ok"))


def malformed_kinds(spark, sf):
    """Errors of all orders: every fifth is damaged, the others are sound and must have none."""
    docs = corpora.orders_xml(spark, sf)
    kinds = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("</z>"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<z>"), "content")).otherwise(F.concat(F.lit("<z>"), "content", F.lit("</zz>")))
    content = F.when(F.col("doc_id") % 5 == 0, kinds).otherwise(F.col("content"))
    return validate.errors(docs.withColumn("content", content)).groupBy("kind").agg(F.count("*").alias("n"))


def match_preview_top10(spark, sf):
    from .operators.matches import preview

    found = Documents(corpora.orders_xml(spark, sf)).xpath("/order/item/qty")
    return preview(found).select(F.col("doc_id").alias("o_orderkey"), "match_no", _qty())


def match_count_by_doc(spark, sf):
    return Documents(corpora.orders_xml(spark, sf)).counts("/order/item").select(F.col("doc_id").alias("o_orderkey"), F.col("n_matches").cast("long").alias("n_matches"))


def match_text_utf8(spark, sf):
    return Documents(corpora.documents_xml(spark, sf)).xpath("/doc/body").select("doc_id", "text")


def match_raw_nested(spark, sf):
    found = Documents(corpora.geography_xml(spark, sf)).xpath("/region/nation/customer[bal>9000]", raw=True)
    return found.select(F.regexp_extract("raw", "<bal>(.*)</bal>", 1).cast("double").alias("c_acctbal"))


def attrs_map(spark, sf):
    e = Documents(corpora.geography_xml(spark, sf)).elements().where("name = 'customer'")
    return e.select(F.col("attrs")["key"].cast("long").alias("c_custkey"), F.col("attrs")["seg"].alias("c_mktsegment"))


def doc_stats(spark, sf):
    s = Documents(corpora.orders_xml(spark, sf)).stats()
    return s.select("doc_id", "n_bytes", "n_tokens", F.col("max_depth").cast("long").alias("max_depth"), "has_cdata")


#: Orders in a part of the large document, which a task reads whole; some 25 MB.
PART_ORDERS = 1 << 16


def _large_orders(spark: SparkSession, sf: str, content: Column | None = None, seen: Observation | None = None) -> str:
    """Orders as one document, written in parts to the shared folder; they follow each other as roots, which the data model allows.
    seen: gets the document's bytes as n."""
    path = shared_path(spark, "large")
    docs = corpora.orders_xml(spark, sf).select(F.col("content") if content is None else content)
    docs = docs if seen is None else docs.observe(seen, F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + 1).alias("n"))
    docs.write.option("lineSep", "\n").option("compression", "lz4").option("maxRecordsPerFile", PART_ORDERS).text(path)
    return path


def _large_path(spark: SparkSession, sf: str, xpath: str, content: Column | None = None) -> DataFrame:
    seen = Observation()
    path = _large_orders(spark, sf, content, seen)
    return large_path(spark, path, xpath, in_parts=True, length=seen.get["n"])


def large_doc_path(spark, sf):
    """Orders as one document, its parts scanned in splits."""
    return _large_path(spark, sf, "/order/item/qty").select(_qty())


def large_doc_cdata(spark, sf):
    """The same document, the child whose text is CDATA."""
    return _large_path(spark, sf, "/order/item/price").select(F.col("text").cast("double").alias("l_extendedprice"))


def large_doc_stray(spark, sf):
    """The same with ends of CDATA sections in plain text, and beginnings within sections."""
    content = F.replace(F.replace("content", F.lit("</qty>"), F.lit(" ]]> </qty>")), F.lit("<![CDATA["), F.lit("<![CDATA[<![CDATA[</x>"))
    return _large_path(spark, sf, "/order/item/qty", content.alias("content")).select(F.regexp_extract("text", r"^(\S+) \]\]> $", 1).cast("double").alias("l_quantity"))


def _large(path: str):
    """A path with predicates over the one large document."""
    return lambda spark, sf: _large_path(spark, sf, path).select(_qty())


def repeated_ids(spark, sf):
    """Orders whose ids are one of seven, or null: each row is a document of its own."""
    docs = corpora.orders_xml(spark, sf).withColumn("doc_id", F.expr("nullif(doc_id % 7, 6)"))
    return _Documents(docs).xpath("/order/item/qty").select("doc_id", "match_no", _qty())


def repeated_rows(spark, sf):
    """Each of these documents stands twice: verdicts and matches do too."""
    docs = corpora.geography_xml(spark, sf)
    both = _Documents(docs.unionAll(docs))
    counts = both.counts("/region/nation/customer").groupBy("doc_id").agg(F.count("*").alias("documents"), F.min("n_matches").alias("n_matches"))
    return counts.join(both.verdicts().where("status = 'ok'").groupBy("doc_id").agg(F.count("*").alias("sound")), "doc_id")


def verdict_kinds(spark, sf):
    """Orders, some replaced by plain text or damaged, by verdict."""
    content = F.when(F.col("doc_id") % 9 == 0, "plain text").when(F.col("doc_id") % 9 == 1, F.concat("content", F.lit("</order>"))).otherwise(F.col("content"))
    docs = Documents(corpora.orders_xml(spark, sf).withColumn("content", content))
    return docs.verdicts().groupBy("status").agg(F.count("*").alias("n"))


def misc_skipped(spark, sf):
    """With prolog and comments, which are accepted here."""
    content = F.concat(F.lit('<?xml version="1.0"?><!-- <order> -->'), "content")
    found = Documents(corpora.orders_xml(spark, sf).withColumn("content", content), skip_misc=True).valid().xpath("/order/item/qty")
    return found.select(F.col("doc_id").alias("o_orderkey"), _qty())


def entities_decoded(spark, sf):
    rows = corpora.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<p>&lt;&amp;amp; "), "p_type", F.lit(" &quot;&apos;&gt;</p>")).alias("content"))
    return Documents(rows).xpath("/p", entities=True).select(F.col("doc_id").alias("p_partkey"), "text")


def join_equals_window(spark, sf):
    """Matches of a predicate path that the two plans do not share; none are expected."""
    docs = Documents(corpora.orders_xml(spark, sf))
    a = docs.select("/order[@status='F']/item[flag=R]/qty", "join").select("doc_id", "elem_id")
    b = docs.select("/order[@status='F']/item[flag=R]/qty", "window").select("doc_id", "elem_id")
    return a.exceptAll(b).unionAll(b.exceptAll(a))


QUERIES = {
    "utf8_valid_documents": utf8_valid_documents,
    "utf8_invalid_flagged": utf8_invalid_flagged,
    "token_counts_pages": token_counts_pages,
    "token_table_pages": token_table_pages,
    "cdata_masked_tokens": cdata_masked_tokens,
    "depth_histogram": depth_histogram,
    "pair_spans_parts": pair_spans_parts,
    "wellformed_flags": wellformed_flags,
    "malformed_kinds": malformed_kinds,
    "path_child": _orders("/order/item/qty"),
    "path_root": _orders("/order", False),
    "path_self_closing": _parts("/parts/part"),
    "path_trailing_slash": _orders("order/item/qty/"),
    "path_no_match": _orders("/order/item/nothing"),
    "attr_eq": _orders("/order[@status='F']/item/qty"),
    "attr_ne": _orders("/order[@status!='F']/item/qty"),
    "attr_lt": _parts("/parts/part[@size<'10']"),
    "attr_gt": _parts("/parts/part[@size>'40']"),
    "attr_le": _parts("/parts/part[@size<='10']"),
    "attr_ge": _parts("/parts/part[@size>='40']"),
    "attr_eq_leaf": _parts("/parts/part[@brand='Brand#4']"),
    "attr_prefix_compat": lambda spark, sf: Documents(corpora.parts_xml(spark, sf)).xpath("/parts/part[@brand='Brand#1']", affix_compat=True).select(_key_of_part()),
    "child_eq": _orders("/order/item[flag=R]/qty"),
    "child_ne": _orders("/order/item[flag!=R]/qty"),
    "child_lt": _orders("/order/item[qty<10]/qty"),
    "child_gt": _orders("/order/item[qty>40]/qty"),
    "child_le": _orders("/order/item[qty<=10]/qty"),
    "child_ge": _orders("/order/item[qty>=40]/qty"),
    "child_eq_cdata": _orders("/order/item[price>50000]/qty"),
    "index_first": _orders("/order/item[0]/qty"),
    "index_n": _orders("/order/item[2]/qty"),
    "index_root": _orders("/order[0]", False),
    "attr_then_index": _orders("/order[@status='O']/item[1]/qty"),
    "index_then_index": _orders("/order[0]/item[1]/qty[0]"),
    "child_then_index": _orders("/order/item[flag=A]/qty[0]"),
    "two_attr_preds": _orders("/order[@status='F']/item[@no='1']/qty"),
    "two_child_preds": lambda spark, sf: Documents(corpora.accounts_xml(spark, sf)).xpath("/customer[seg=BUILDING]/order[status=F]/key").select(F.col("text").cast("long").alias("o_orderkey")),
    "position_gt": _orders("/order/item[position()>2]/qty"),
    "last_minus": _orders("/order/item[last()-1]/qty"),
    "last_item": _orders("/order/item[last()]/qty"),
    "match_preview_top10": match_preview_top10,
    "match_count_by_doc": match_count_by_doc,
    "match_text_utf8": match_text_utf8,
    "match_raw_nested": match_raw_nested,
    "attrs_map": attrs_map,
    "doc_stats": doc_stats,
    "large_doc_path": large_doc_path,
    "large_doc_cdata": large_doc_cdata,
    "large_doc_stray": large_doc_stray,
    "large_doc_attr": _large("/order[@status='F']/item/qty"),
    "large_doc_child": _large("/order/item[flag=R]/qty"),
    "large_doc_index": _large("/order/item[2]/qty"),
    "large_doc_last": _large("/order[@status!='F']/item[last()-1]/qty"),
    "repeated_ids": repeated_ids,
    "repeated_rows": repeated_rows,
    "verdict_kinds": verdict_kinds,
    "misc_skipped": misc_skipped,
    "entities_decoded": entities_decoded,
    "join_equals_window": join_equals_window,
}

_LINES = "SELECT o_orderkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_NUMBERED = """SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag) - 1 AS i,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _numbered(where: str) -> str:
    return f"SELECT o_orderkey, l_quantity FROM ({_NUMBERED}) WHERE {where}"


ORACLES = {
    "utf8_valid_documents": "SELECT doc_id, text IS NOT NULL AS ok FROM documents",
    "utf8_invalid_flagged": "SELECT doc_id, doc_id % 7 <> 0 AS ok FROM documents",
    "token_counts_pages": """SELECT page_id AS doc_id, len(regexp_extract_all(html, '<[^/]')) AS n_open,
        len(regexp_extract_all(html, '</')) + len(regexp_extract_all(html, '/>')) AS n_close, len(regexp_extract_all(html, '="')) AS n_value FROM pages""",
    "token_table_pages": """SELECT * FROM (SELECT page_id AS doc_id, '<' AS tok, len(regexp_extract_all(html, '<[^/]')) AS n FROM pages
        UNION ALL SELECT page_id, '/', len(regexp_extract_all(html, '</')) + len(regexp_extract_all(html, '/>')) FROM pages
        UNION ALL SELECT page_id, '=', len(regexp_extract_all(html, '="')) FROM pages) WHERE n > 0""",
    "cdata_masked_tokens": "SELECT doc_id, 2::BIGINT AS n_open, 2::BIGINT AS n_close, 2::BIGINT AS n_value FROM documents",
    "depth_histogram": """SELECT 0::BIGINT AS depth, 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 1, 'nation', count(*) FROM nation
        UNION ALL SELECT 2, 'customer', count(*) FROM customer UNION ALL SELECT 3, 'bal', count(*) FROM customer""",
    "pair_spans_parts": """SELECT p_partkey, strlen('<part key="' || p_partkey || '" brand="' || p_brand || '" type="' || p_type || '" size="' || p_size || '"/>') AS n_bytes FROM part""",
    "wellformed_flags": "SELECT o_orderkey AS doc_id, o_orderkey % 11 NOT IN (0, 1, 2, 3) AS ok FROM orders",
    "malformed_kinds": """SELECT kind, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'stray_close' WHEN 1 THEN 'unclosed' ELSE 'mismatch' END AS kind
        FROM orders WHERE o_orderkey % 5 = 0) GROUP BY kind""",
    "path_child": _LINES,
    "path_root": "SELECT o_orderkey FROM orders",
    "path_self_closing": "SELECT p_partkey FROM part",
    "path_trailing_slash": _LINES,
    "path_no_match": _LINES + " WHERE false",
    "attr_eq": _LINES + " WHERE o_orderstatus = 'F'",
    "attr_ne": _LINES + " WHERE o_orderstatus <> 'F'",
    "attr_lt": "SELECT p_partkey FROM part WHERE p_size < 10",
    "attr_gt": "SELECT p_partkey FROM part WHERE p_size > 40",
    "attr_le": "SELECT p_partkey FROM part WHERE p_size <= 10",
    "attr_ge": "SELECT p_partkey FROM part WHERE p_size >= 40",
    "attr_eq_leaf": "SELECT p_partkey FROM part WHERE p_brand = 'Brand#4'",
    "attr_prefix_compat": "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')",
    "child_eq": _LINES + " WHERE l_returnflag = 'R'",
    "child_ne": _LINES + " WHERE l_returnflag <> 'R'",
    "child_lt": _LINES + " WHERE l_quantity < 10",
    "child_gt": _LINES + " WHERE l_quantity > 40",
    "child_le": _LINES + " WHERE l_quantity <= 10",
    "child_ge": _LINES + " WHERE l_quantity >= 40",
    "child_eq_cdata": _LINES + " WHERE l_extendedprice > 50000",
    "index_first": _numbered("i = 0"),
    "index_n": _numbered("i = 2"),
    "index_root": "SELECT o_orderkey FROM orders",
    "attr_then_index": _numbered("i = 1 AND o_orderstatus = 'O'"),
    "index_then_index": _numbered("i = 1"),
    "child_then_index": _LINES + " WHERE l_returnflag = 'A'",
    "two_attr_preds": _LINES + " WHERE o_orderstatus = 'F' AND l_linenumber = 1",
    "two_child_preds": "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'",
    "position_gt": _numbered("i + 1 > 2"),
    "last_minus": _numbered("i = n - 2"),
    "last_item": _numbered("i = n - 1"),
    "match_preview_top10": f"SELECT o_orderkey, (i + 1)::BIGINT AS match_no, l_quantity FROM ({_NUMBERED}) ORDER BY o_orderkey, i LIMIT 10",
    "match_count_by_doc": "SELECT l_orderkey AS o_orderkey, count(*) AS n_matches FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    "match_text_utf8": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "match_raw_nested": "SELECT c_acctbal FROM customer WHERE c_acctbal > 9000",
    "attrs_map": "SELECT c_custkey, c_mktsegment FROM customer",
    "doc_stats": """WITH c AS (SELECT l_orderkey, count(*) AS n, sum(strlen('<item no="' || l_linenumber || '"><qty></qty><flag>' || l_returnflag || '</flag><price><![CDATA[]]></price></item>'
          || l_quantity::VARCHAR || l_extendedprice::VARCHAR)) AS bytes FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey AS doc_id, (strlen('<order key="' || o_orderkey || '" status="' || o_orderstatus || '" priority="' || o_orderpriority || '"')
          + CASE WHEN n IS NULL THEN 2 ELSE 1 + bytes + strlen('</order>') END)::BIGINT AS n_bytes,
          (5 + coalesce(n, 0) * 9)::BIGINT AS n_tokens, CASE WHEN n IS NULL THEN 0 ELSE 2 END::BIGINT AS max_depth, n IS NOT NULL AS has_cdata
        FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
    "large_doc_path": "SELECT l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "large_doc_cdata": "SELECT l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "large_doc_stray": "SELECT l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "large_doc_attr": "SELECT l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    "large_doc_child": "SELECT l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
    "large_doc_index": f"SELECT l_quantity FROM ({_NUMBERED}) WHERE i = 2",
    "large_doc_last": f"SELECT l_quantity FROM ({_NUMBERED}) WHERE i = n - 2 AND o_orderstatus <> 'F'",
    "repeated_ids": f"SELECT nullif(o_orderkey % 7, 6) AS doc_id, (i + 1)::BIGINT AS match_no, l_quantity FROM ({_NUMBERED})",
    "repeated_rows": """SELECT n_regionkey AS doc_id, 2::BIGINT AS documents, count(*) AS n_matches, 2::BIGINT AS sound
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""",
    "verdict_kinds": "SELECT CASE o_orderkey % 9 WHEN 0 THEN 'no_tokens' WHEN 1 THEN 'malformed' ELSE 'ok' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "misc_skipped": _LINES,
    "entities_decoded": """SELECT p_partkey, '<&amp; ' || p_type || ' "''>' AS text FROM part""",
    "join_equals_window": "SELECT 0::BIGINT AS doc_id, 0::BIGINT AS elem_id WHERE false",
}
