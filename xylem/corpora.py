"""XML views over the star schema, and small documents for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<order key status priority><item no><qty/><flag/><price CDATA/></item>...</order>; items in the order of all their columns."""
    item = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    xml = lambda i: F.concat(F.lit('<item no="'), i["no"], F.lit('"><qty>'), i["qty"].cast("string"), F.lit("</qty><flag>"), i["flag"], F.lit("</flag><price><![CDATA["), i["price"].cast("string"), F.lit("]]></price></item>"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat(F.lit('<order key="'), "o_orderkey", F.lit('" status="'), "o_orderstatus", F.lit('" priority="'), "o_orderpriority", F.lit('"'))
    body = F.when(F.col("items").isNull(), "/>").otherwise(F.concat(F.lit(">"), F.array_join(F.transform("items", xml), ""), F.lit("</order>")))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(head, body).alias("content"))


def geography_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region: region > nation > customer > bal."""
    customer = read(spark, sf_dir, "customer").withColumn("x", F.concat(F.lit('<customer key="'), "c_custkey", F.lit('" seg="'), "c_mktsegment", F.lit('"><bal>'), F.col("c_acctbal").cast("string"), F.lit("</bal></customer>")))
    per_nation = customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "x"))), lambda c: c["x"]), "").alias("cs"))
    nation = read(spark, sf_dir, "nation").join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("x", F.concat(F.lit('<nation name="'), "n_name", F.lit('">'), F.coalesce("cs", F.lit("")), F.lit("</nation>")))
    per_region = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "x"))), lambda c: c["x"]), "").alias("ns"))
    region = read(spark, sf_dir, "region").join(per_region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return region.select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit('<region name="'), "r_name", F.lit('">'), F.coalesce("ns", F.lit("")), F.lit("</region>")).alias("content"))


def accounts_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<customer key><seg/><order><status/><key/></order>...</customer>; orders by key."""
    order = F.concat(F.lit("<order><status>"), "o_orderstatus", F.lit("</status><key>"), "o_orderkey", F.lit("</key></order>"))
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", order.alias("x")))), lambda o: o["x"]), "").alias("os"))
    rows = read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit('<customer key="'), "c_custkey", F.lit('"><seg>'), "c_mktsegment", F.lit("</seg>"), F.coalesce("os", F.lit("")), F.lit("</customer>")).alias("content"))


PART_GROUP = 50


def parts_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of up to PART_GROUP self-closing parts, by key."""
    x = F.concat(F.lit('<part key="'), "p_partkey", F.lit('" brand="'), "p_brand", F.lit('" type="'), "p_type", F.lit('" size="'), "p_size", F.lit('"/>'))
    parts = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / PART_GROUP).cast("long").alias("doc_id"), F.struct("p_partkey", x.alias("x")).alias("p"))
    rows = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"]), "").alias("body"))
    return rows.select("doc_id", F.concat(F.lit("<parts>"), "body", F.lit("</parts>")).alias("content"))


def documents_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<doc id lang><body>CDATA</body></doc>; `]]>` in a text is split over two sections."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('<doc id="'), "doc_id", F.lit('" lang="'), F.coalesce("lang", F.lit("")), F.lit('"><body><![CDATA['), text, F.lit("]]></body></doc>")).alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
