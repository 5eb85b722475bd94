"""Claim-graph views of the test tables: the same rules in Spark and, as CTE text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claims from events: topic = event_type, source = user_id, text = event_type and props."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as claim_id", "event_type as topic", "user_id as source", "ts", "element_at(array('META', 'PRIMARY', 'SECONDARY', 'CONTEXTUAL'), cast(event_id % 4 as int) + 1) as claim_type",
        "event_id % 3 as n_citations", "(event_id % 100) / 100.0D as confidence", "event_id % 10 = 7 as excluded", "concat(event_type, ' ', coalesce(props, '')) as claim_text",
        "value > 50 as fear", "event_id % 5 = 0 as anger", "event_id % 7 = 0 as urgency", "value > 80 as intense",
    )


EVENTS = """claims as (select event_id as claim_id, event_type as topic, user_id as source, ts,
  case event_id % 4 when 0 then 'META' when 1 then 'PRIMARY' when 2 then 'SECONDARY' else 'CONTEXTUAL' end as claim_type,
  event_id % 3 as n_citations, cast(event_id % 100 as double) / 100 as confidence, event_id % 10 = 7 as excluded,
  event_type || ' ' || coalesce(props, '') as claim_text,
  value > 50 as fear, event_id % 5 = 0 as anger, event_id % 7 = 0 as urgency, value > 80 as intense from events)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges from lineitem: supplier to part, type by return flag, weight by quantity."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as src", "1000000 + l_partkey as dst", "case l_returnflag when 'A' then 'CITES' when 'N' then 'SUPPORTS' else 'CONTRADICTS' end as rel_type", "l_quantity / 50 as weight", "l_orderkey as doc")


EDGES = """edges as (select l_suppkey as src, 1000000 + l_partkey as dst,
  case l_returnflag when 'A' then 'CITES' when 'N' then 'SUPPORTS' else 'CONTRADICTS' end as rel_type, l_quantity / 50 as weight, l_orderkey as doc from lineitem)"""


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges among suppliers that share an order, in line order: src and dst are suppliers, so paths go on."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    y = x.selectExpr("l_orderkey", "l_linenumber - 1 as l_linenumber", "l_suppkey as dst")
    both = x.join(y, ["l_orderkey", "l_linenumber"]).where("l_suppkey <> dst")
    return both.groupBy(F.col("l_suppkey").alias("src"), "dst").agg(F.count("*").cast("double").alias("weight"), F.max(F.expr("case l_returnflag when 'A' then 'CITES' when 'N' then 'SUPPORTS' else 'CONTRADICTS' end")).alias("rel_type"))


RING = """ring as (select a.l_suppkey as src, b.l_suppkey as dst, cast(count(*) as double) as weight,
  max(case a.l_returnflag when 'A' then 'CITES' when 'N' then 'SUPPORTS' else 'CONTRADICTS' end) as rel_type
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_suppkey <> b.l_suppkey group by 1, 2)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of topics: topic = region, location = nation, with a fixed latitude and longitude, dates from the nation's orders."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    dates = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts"))
    return nation.join(dates, F.col("n_nationkey") == F.col("c_nationkey"), "left").selectExpr("n_regionkey as topic", "n_name as location", "cast((n_nationkey * 37) % 140 - 70 as double) as lat", "cast((n_nationkey * 73) % 360 - 180 as double) as lon", "first_ts", "last_ts")


PLACES = """places as (select n_regionkey as topic, n_name as location, cast((n_nationkey * 37) % 140 - 70 as double) as lat, cast((n_nationkey * 73) % 360 - 180 as double) as lon, first_ts, last_ts
  from nation left join (select c_nationkey, min(o_orderdate) as first_ts, max(o_orderdate) as last_ts from customer join orders on c_custkey = o_custkey group by 1) d on n_nationkey = c_nationkey)"""


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations among event claims (topic, src, dst): a claim with k citations cites the claims at half and at a third of its id."""
    c = event_claims(spark, sf_dir)
    return c.selectExpr("topic", "claim_id as src", "explode(slice(array(claim_id div 2, claim_id div 3), 1, n_citations)) as dst")


CITES = """cites as (select topic, claim_id as src, claim_id // 2 as dst from claims where n_citations >= 1 union all select topic, claim_id, claim_id // 3 from claims where n_citations >= 2)"""


def claim_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of event claims: topic, source, embedding; a claim's vector is that of its id."""
    return event_claims(spark, sf_dir).join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "claim_id"), "claim_id").select("claim_id", "topic", "source", "embedding")


VECTORS = """vectors as (select claim_id, topic, source, cast(embedding as double[]) as embedding from claims join embeddings on vec_id = claim_id)"""
