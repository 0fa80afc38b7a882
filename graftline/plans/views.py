"""Domain tables derived from the star-schema tables of a data folder, in Spark and in SQL.

Taxonomy: regions over nations over customers and suppliers; market segments over customers as a
second parent; brands and types over parts. Every customer is a mention: retrieved are the customer
itself, the suppliers of its orders (score: share of the customer's spending), and its nation, which
comes first for even keys and last for odd ones. Gold are the customer's nation edge and leaf edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import NULL_ID
from ..session import ensure_checkpoint_dir


class Tables:
    """The tables of a folder by name; derived ones that several steps of a plan read are
    checkpointed: every use of a cached one would carry its whole plan along."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._kept = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def kept(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            ensure_checkpoint_dir(self.spark)
            self._kept[name] = make().checkpoint()
        return self._kept[name]


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(t: Tables) -> DataFrame:
    """(parent, child) of the taxonomy."""
    return t.kept("edges", lambda: _edges(t))


def _edges(t: Tables) -> DataFrame:
    e = lambda df, p, c: df.select(p.alias("parent"), c.alias("child"))
    root = F.lit("ROOT")
    part = t.part.select("p_partkey", "p_brand", "p_type")
    customer = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    parts = [
        e(t.region, root, _id("R", "r_regionkey")), e(t.nation, _id("R", "n_regionkey"), _id("N", "n_nationkey")), e(customer, _id("N", "c_nationkey"), _id("C", "c_custkey")),
        e(t.supplier, _id("N", "s_nationkey"), _id("S", "s_suppkey")), e(customer.select("c_mktsegment").distinct(), root, _id("SEG:", "c_mktsegment")), e(customer, _id("SEG:", "c_mktsegment"), _id("C", "c_custkey")),
        e(part.select("p_brand").distinct(), root, _id("B:", "p_brand")), e(part, _id("B:", "p_brand"), _id("P", "p_partkey")), e(part.select("p_type").distinct(), root, _id("T:", "p_type")), e(part, _id("T:", "p_type"), _id("P", "p_partkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def titles(t: Tables) -> DataFrame:
    """(id, title): names with a semantic tag; segments, brands and types have none stored."""
    n = lambda df, i, c, tag: df.select(i.alias("id"), F.concat(F.col(c), F.lit(f" ({tag})")).alias("title"))
    out = n(t.region, _id("R", "r_regionkey"), "r_name", "region")
    for p in (n(t.nation, _id("N", "n_nationkey"), "n_name", "nation"), n(t.customer, _id("C", "c_custkey"), "c_name", "customer"), n(t.supplier, _id("S", "s_suppkey"), "s_name", "supplier"), n(t.part, _id("P", "p_partkey"), "p_name", "part")):
        out = out.unionByName(p)
    return out


def concepts(t: Tables) -> DataFrame:
    e = edges(t)
    return t.kept("concepts", lambda: e.select(F.col("parent").alias("id")).unionByName(e.select(F.col("child").alias("id"))).distinct())


def below(t: Tables) -> DataFrame:
    """(id), repeats included: of the concepts without children all are here, so that to tell leaves from the
    rest these will do in place of ``concepts``, which would be made and written first."""
    return edges(t).select(F.col("child").alias("id"))


def mentions(t: Tables) -> DataFrame:
    return t.customer.select(_id("M", "c_custkey").alias("mention_id"), F.col("c_name").alias("mention"))


def retrieved(t: Tables) -> DataFrame:
    """(mention_id, concept_id, score, rank), scores rounded before they are ranked by."""
    return t.kept("retrieved", lambda: _retrieved(t))


def _retrieved(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey")
    spent = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    # All is made, summed and ranked within the part of the rows that has the customer.
    per = spent.repartition("o_custkey").groupBy("o_custkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("s")).withColumn("w", F.sum("s").over(Window.partitionBy("o_custkey")))
    shares = per.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"), _id("S", "l_suppkey").alias("concept_id"), F.round(F.col("s") / F.col("w"), 4).alias("score"))
    own = c.select("c_custkey", _id("C", "c_custkey").alias("concept_id"), F.lit(1.0).alias("score"))
    nation = c.select("c_custkey", _id("N", "c_nationkey").alias("concept_id"), F.when(F.col("c_custkey") % 2 == 0, 2.0).otherwise(0.0).alias("score"))
    order = Window.partitionBy("c_custkey").orderBy(F.desc("score"), F.asc("concept_id"))
    ranked = shares.unionByName(own).unionByName(nation).withColumn("rank", F.row_number().over(order))
    return ranked.select(_id("M", "c_custkey").alias("mention_id"), "concept_id", "score", "rank")


def gold(t: Tables) -> DataFrame:
    c = t.customer
    up = c.select(_id("M", "c_custkey").alias("mention_id"), _id("N", "c_nationkey").alias("parent_id"), _id("C", "c_custkey").alias("child_id"))
    return up.unionByName(c.select(_id("M", "c_custkey").alias("mention_id"), _id("C", "c_custkey").alias("parent_id"), F.lit(NULL_ID).alias("child_id")))


SQL_EDGES = """edges AS (
  SELECT 'ROOT' AS parent, 'R' || r_regionkey AS child FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 'ROOT', 'SEG:' || c_mktsegment FROM customer UNION ALL SELECT 'SEG:' || c_mktsegment, 'C' || c_custkey FROM customer
  UNION ALL SELECT DISTINCT 'ROOT', 'B:' || p_brand FROM part UNION ALL SELECT 'B:' || p_brand, 'P' || p_partkey FROM part
  UNION ALL SELECT DISTINCT 'ROOT', 'T:' || p_type FROM part UNION ALL SELECT 'T:' || p_type, 'P' || p_partkey FROM part)"""

SQL_TITLES = """titles AS (
  SELECT 'R' || r_regionkey AS id, r_name || ' (region)' AS title FROM region UNION ALL SELECT 'N' || n_nationkey, n_name || ' (nation)' FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name || ' (customer)' FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name || ' (supplier)' FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name || ' (part)' FROM part)"""

SQL_CONCEPTS = "concepts AS (SELECT parent AS id FROM edges UNION SELECT child FROM edges)"

SQL_RETRIEVED = """spent AS (SELECT o_custkey, l_suppkey, l_extendedprice AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)),
found AS (
  SELECT 'M' || p.o_custkey AS mention_id, 'S' || p.l_suppkey AS concept_id, round(p.s / w.w, 4) AS score
  FROM (SELECT o_custkey, l_suppkey, sum(x) AS s FROM spent GROUP BY ALL) p JOIN (SELECT o_custkey, sum(x) AS w FROM spent GROUP BY ALL) w USING (o_custkey)
  UNION ALL SELECT 'M' || c_custkey, 'C' || c_custkey, 1.0 FROM customer
  UNION ALL SELECT 'M' || c_custkey, 'N' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE 0.0 END FROM customer),
retrieved AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, concept_id) AS rank FROM found)"""

SQL_SEEDS = """by_concept AS (
  SELECT child AS concept_id, parent AS parent_id, child AS child_id FROM edges UNION SELECT parent, parent, child FROM edges
  UNION SELECT u.child, u.parent, d.child FROM edges u JOIN edges d ON d.parent = u.child UNION SELECT id, id, 'SCTID_NULL' FROM concepts),
seeds AS (SELECT DISTINCT mention_id, parent_id, child_id FROM retrieved JOIN by_concept USING (concept_id))"""

SQL_ENRICHED = """ends AS (
  SELECT mention_id, parent_id AS e FROM seeds WHERE child_id <> 'SCTID_NULL' UNION SELECT mention_id, child_id FROM seeds WHERE child_id <> 'SCTID_NULL'),
grow AS (SELECT * FROM seeds WHERE child_id <> 'SCTID_NULL' UNION ALL SELECT s.* FROM seeds s WHERE child_id = 'SCTID_NULL' AND EXISTS (SELECT 1 FROM ends WHERE ends.mention_id = s.mention_id AND ends.e = s.parent_id)),
lift AS (SELECT g.mention_id, u.parent AS parent_id, g.child_id FROM grow g JOIN edges u ON u.child = g.parent_id),
lower AS (SELECT g.mention_id, g.parent_id, d.child AS child_id FROM grow g JOIN edges d ON d.parent = g.child_id),
both_ways AS (SELECT g.mention_id, u.parent AS parent_id, d.child AS child_id FROM grow g JOIN edges u ON u.child = g.parent_id JOIN edges d ON d.parent = g.child_id),
enriched AS (SELECT * FROM seeds UNION SELECT * FROM lift UNION SELECT * FROM lower UNION SELECT * FROM both_ways)"""

SQL_GOLD = """gold AS (SELECT 'M' || c_custkey AS mention_id, 'N' || c_nationkey AS parent_id, 'C' || c_custkey AS child_id FROM customer
  UNION ALL SELECT 'M' || c_custkey, 'C' || c_custkey, 'SCTID_NULL' FROM customer)"""


def sql_scored(pool: str = "enriched") -> str:
    return f"""scored AS (SELECT p.*, (coalesce(a.score, 0) + CASE WHEN p.child_id = 'SCTID_NULL' THEN 0 ELSE coalesce(b.score, 0) END) / 2 AS score
  FROM {pool} p LEFT JOIN retrieved a ON a.mention_id = p.mention_id AND a.concept_id = p.parent_id LEFT JOIN retrieved b ON b.mention_id = p.mention_id AND b.concept_id = p.child_id)"""


def sql_ranked(k: int, leaf_rule: bool = True) -> str:
    lead = "CASE WHEN s.child_id = 'SCTID_NULL' AND s.mention_id IN (SELECT mention_id FROM leafy) THEN 0 ELSE 1 END" if leaf_rule else "0"
    return f"""leafy AS (SELECT mention_id FROM retrieved WHERE rank = 1 AND concept_id IN (SELECT id FROM concepts) AND concept_id NOT IN (SELECT parent FROM edges)),
ranked AS (SELECT * FROM (SELECT s.mention_id, s.parent_id, s.child_id, s.score, row_number() OVER (PARTITION BY s.mention_id ORDER BY {lead}, s.score DESC, s.parent_id, s.child_id) AS rank FROM scored s) WHERE rank <= {k})"""


SQL_POOL = ", ".join([SQL_EDGES, SQL_CONCEPTS, SQL_RETRIEVED, SQL_SEEDS, SQL_ENRICHED])
