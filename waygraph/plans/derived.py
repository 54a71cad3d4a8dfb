"""A road network derived from the orders, lineitem and part tables, in whole-number arithmetic.

The same text is used by the queries (through Spark SQL) and by their checks in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODE = "l_partkey * 10 + l_suppkey % 10"

WAYS = """
select o_orderkey as way_id,
  case o_orderpriority when '1-URGENT' then 'motorway' when '2-HIGH' then 'primary' when '3-MEDIUM' then 'tertiary'
       when '4-NOT SPECIFIED' then 'residential' else 'footway' end as highway,
  case when o_orderkey % 13 = 0 then '-1' when o_orderstatus = 'F' then 'yes' when o_orderstatus = 'O' then 'no' end as oneway,
  case when o_orderkey % 17 = 0 then 'roundabout' end as junction
from orders
"""

REFS = f"""
select l_orderkey as way_id, {NODE} as node_id,
  row_number() over (partition by l_orderkey
                     order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as pos,
  count(*) over (partition by l_orderkey) as len
from lineitem
"""

NODES = f"""
select distinct {NODE} as id,
  cast(-23500000 + (({NODE}) * 7919) % 1000003 as int) as lat_udeg,
  cast(-46600000 + (({NODE}) * 104729) % 999983 as int) as lon_udeg,
  case p_size when 1 then 'gate' when 2 then 'bollard' when 3 then 'kerb' end as barrier
from lineitem join part on p_partkey = l_partkey
"""

#: Requests: two points for each customer, "lon,lat;lon,lat".
REQUESTS = """
select c_custkey as request_id,
  -23500000 + (c_custkey * 7919) % 1000003 as lat_a, -46600000 + (c_custkey * 104729) % 999983 as lon_a,
  -23500000 + (c_custkey * 15485863) % 1000003 as lat_b, -46600000 + (c_custkey * 32452843) % 999983 as lon_b
from customer
"""

#: Boxes in Web-Mercator metres, one for each supplier.
BOXES = """
select s_suppkey as box_id,
  cast(-5187000 + (s_suppkey * 7919) % 100000 as double) as bx1, cast(-2690000 + (s_suppkey * 104729) % 100000 as double) as by1,
  cast(-5187000 + (s_suppkey * 7919) % 100000 + 2000 as double) as bx2, cast(-2690000 + (s_suppkey * 104729) % 100000 - 3000 as double) as by2
from supplier
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in ("orders", "lineitem", "part", "customer", "supplier") if f" {t}" in sql]
    for t in names:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ways, refs, nodes)."""
    return derived(spark, sf_dir, WAYS), derived(spark, sf_dir, REFS), derived(spark, sf_dir, NODES)
