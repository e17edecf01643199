"""Graphs that the registered queries run on, derived from whole driver tables, and the same graphs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.graph import EvidenceGraph, Topology
from lodestone.plans.loop import number_rows
from lodestone.scratch import drop, materialize

ROOT, NATION, CUSTOMER, SUPPLIER, PART = 0, 100, 1_000_000_000, 2_000_000_000, 3_000_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _topology(e: DataFrame, vertices: DataFrame, directed: bool = True) -> Topology:
    return Topology(materialize(vertices.select(F.col("node").cast("long").alias("node")).distinct(), "vertices"), materialize(e, "edges"), directed)


def _tree(spark: SparkSession, parts: list[DataFrame]) -> Topology:
    """Of (src, dst) rows below the root; the child names its edge."""
    e = parts[0]
    for p in parts[1:]:
        e = e.unionByName(p)
    e = e.select(F.col("dst").cast("long").alias("edge"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return _topology(e, e.select(F.col("dst").alias("node")).unionByName(spark.range(1).select(F.col("id").alias("node"))))


def _upper(spark: SparkSession, d: str) -> list[DataFrame]:
    region = table(spark, d, "region").select(F.lit(ROOT).alias("src"), (F.col("r_regionkey") + 1).alias("dst"))
    return [region, table(spark, d, "nation").select((F.col("n_regionkey") + 1).alias("src"), (F.col("n_nationkey") + NATION).alias("dst"))]


def nations(spark: SparkSession, d: str) -> Topology:
    """The root, the regions and the nations."""
    return _tree(spark, _upper(spark, d))


def geography(spark: SparkSession, d: str) -> Topology:
    """A tree: the root 0, regions 1 + key, nations, then customers and suppliers; edges lead away from the root."""
    customer = table(spark, d, "customer").select((F.col("c_nationkey") + NATION).alias("src"), (F.col("c_custkey") + CUSTOMER).alias("dst"))
    supplier = table(spark, d, "supplier").select((F.col("s_nationkey") + NATION).alias("src"), (F.col("s_suppkey") + SUPPLIER).alias("dst"))
    return _tree(spark, [*_upper(spark, d), customer, supplier])


GEOGRAPHY = f"""ge AS (SELECT dst AS edge, src, dst FROM (
  SELECT {ROOT}::BIGINT AS src, (r_regionkey + 1)::BIGINT AS dst FROM region UNION ALL
  SELECT (n_regionkey + 1)::BIGINT, (n_nationkey + {NATION})::BIGINT FROM nation UNION ALL
  SELECT (c_nationkey + {NATION})::BIGINT, (c_custkey + {CUSTOMER})::BIGINT FROM customer UNION ALL
  SELECT (s_nationkey + {NATION})::BIGINT, (s_suppkey + {SUPPLIER})::BIGINT FROM supplier)),
gv AS (SELECT dst AS node FROM ge UNION SELECT {ROOT})"""


def supply(spark: SparkSession, d: str) -> Topology:
    """Undirected: suppliers and the parts of their line items, one edge per pair."""
    e = table(spark, d, "lineitem").select((F.col("l_suppkey") + SUPPLIER).alias("src"), (F.col("l_partkey") + PART).alias("dst")).distinct()
    e = materialize(number_rows(e, ["src", "dst"], "edge").select("edge", "src", "dst"), "supply")
    return _topology(e, e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))), False)


SUPPLY = f"""se AS (SELECT DISTINCT l_suppkey + {SUPPLIER} AS src, l_partkey + {PART} AS dst FROM lineitem),
sv AS (SELECT src AS node FROM se UNION SELECT dst FROM se)"""


def transitions(spark: SparkSession, d: str) -> Topology:
    """Users of successive events in the order of (ts, event_id); w is the event's whole value."""
    placed = number_rows(table(spark, d, "events").select("ts", "event_id", F.col("user_id").alias("src"), F.floor(F.abs("value")).cast("long").alias("w")), ["ts", "event_id"], "edge")
    ev = materialize(placed.drop("ts", "event_id"), "ordered")
    drop(placed)
    e = ev.join(ev.select((F.col("edge") - 1).alias("edge"), F.col("src").alias("dst")), "edge").select("edge", "src", "dst", "w")
    t = _topology(e, ev.select(F.col("src").alias("node")))
    drop(ev)
    return t


TRANSITIONS = """te AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS edge, user_id AS src,
  lead(user_id) OVER (ORDER BY ts, event_id) AS dst, floor(abs(value))::BIGINT AS w FROM events) WHERE dst IS NOT NULL),
tv AS MATERIALIZED (SELECT DISTINCT user_id AS node FROM events)"""


def type_flow(spark: SparkSession, d: str) -> Topology:
    """Event types in alphabetical order as nodes 0, 1, ...; an edge per pair, from each user's event to their next: how often (n)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    types = number_rows(ev.select("event_type").distinct(), ["event_type"], "node")
    step = ev.withColumn("next", F.lead("event_type").over(w)).where("next is not null").groupBy("event_type", "next").agg(F.count("*").alias("n"))
    e = step.join(types.select("event_type", F.col("node").alias("src")), "event_type").join(types.select(F.col("event_type").alias("next"), F.col("node").alias("dst")), "next")
    return _topology(number_rows(e.select("src", "dst", "n"), ["src", "dst"], "edge").select("edge", "src", "dst", "n"), types)


TYPE_FLOW = """fy AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS node FROM (SELECT DISTINCT event_type FROM events)),
fe AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge, src, dst, n FROM (
  SELECT a.node AS src, b.node AS dst, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) x
  JOIN fy a ON a.event_type = x.event_type JOIN fy b ON b.event_type = x.nxt GROUP BY 1, 2))"""


def order_chains(spark: SparkSession, d: str) -> Topology:
    """Each customer's orders in the order of (date, key): an edge to the next, w the whole price of the later order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.floor("o_totalprice").cast("long").alias("p"))
    e = o.select(F.col("o_orderkey").alias("edge"), F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"), F.lead("p").over(w).alias("w")).where("dst is not null")
    return _topology(e, o.select(F.col("o_orderkey").alias("node")))


CHAINS = """oe AS (SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER c AS dst, lead(floor(o_totalprice)::BIGINT) OVER c AS w, o_custkey AS cust,
  row_number() OVER c - 1 AS place, floor(o_totalprice)::BIGINT AS p FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)))"""


def evidence(spark: SparkSession, d: str) -> EvidenceGraph:
    """Users and event types as named nodes; an edge for each distinct (user, type, day), with the event as evidence."""
    ev = table(spark, d, "events")
    none = F.lit(None).cast("string")
    span = F.lit(None).cast("struct<file:string,start:struct<line:bigint,column:bigint>,end:struct<line:bigint,column:bigint>>")
    users = ev.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id"), F.lit("service").alias("kind"))
    types = ev.select(F.concat(F.lit("t:"), F.col("event_type")).alias("id"), F.lit("topic").alias("kind"))
    nodes = users.unionByName(types).select("id", F.col("id").alias("label"), "kind", none.alias("language"), span.alias("span"), none.alias("attributes"))
    confidence = F.when(F.col("value") >= 100, "exact").when(F.col("value") >= 50, "high").when(F.col("value") >= 10, "medium").otherwise("low")
    kind = F.when(F.col("event_type") == "purchase", "writes").when(F.col("event_type") == "error", "fails").otherwise("publishes")
    provenance = F.struct(F.lit("events").alias("extractor"), F.when(F.col("event_type") == "view", "parsed").otherwise("runtime").alias("evidence"), confidence.alias("confidence"), span.alias("span"), F.date_format("ts", "yyyy-MM-dd").alias("detail"))
    edges = ev.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("source"), F.concat(F.lit("t:"), F.col("event_type")).alias("target"), kind.alias("kind"), provenance.alias("provenance"), none.alias("attributes"))
    return EvidenceGraph.from_parts(nodes, edges)


EVIDENCE = """vn AS (SELECT id, kind, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT 'u:' || user_id AS id, 'service' AS kind FROM events UNION SELECT 't:' || event_type, 'topic' FROM events)),
ve AS (SELECT *, row_number() OVER (ORDER BY source, target, kr, ck, er, cr, detail) - 1 AS edge FROM (SELECT DISTINCT 'u:' || user_id AS source, 't:' || event_type AS target,
  CASE event_type WHEN 'purchase' THEN 'writes' WHEN 'error' THEN 'fails' ELSE 'publishes' END AS kind,
  CASE event_type WHEN 'purchase' THEN 13 WHEN 'error' THEN 18 ELSE 9 END AS kr, CASE event_type WHEN 'error' THEN 'fails' ELSE '' END AS ck,
  CASE event_type WHEN 'view' THEN 5 ELSE 10 END AS er, CASE event_type WHEN 'view' THEN 'parsed' ELSE 'runtime' END AS evidence,
  CASE WHEN value >= 100 THEN 0 WHEN value >= 50 THEN 1 WHEN value >= 10 THEN 2 ELSE 3 END AS cr,
  CASE WHEN value >= 100 THEN 'exact' WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS confidence,
  strftime(ts, '%Y-%m-%d') AS detail FROM events))"""
