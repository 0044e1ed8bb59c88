"""Relational tables seen as property graphs.

The derivations are plain SQL over the tables in braces, so that an oracle can
start from the same graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import KG

STAR_NODES = """
select concat('region:', r_regionkey) as id, r_name as label, 'docs/regions/readme.md' as source_file, 'package' as node_type, cast(r_regionkey as int) as community from {region}
union all select concat('nation:', n_nationkey), case when n_nationkey % 9 = 0 then 'lib' else n_name end, concat('crates/geo_', n_regionkey, '/src/lib.rs'), 'module', cast(n_nationkey as int) from {nation}
union all select concat('customer:', c_custkey), c_name, concat('src/sales/customer_', c_custkey % 7, '.py'), 'class', cast(c_nationkey as int) from {customer}
union all select concat('supplier:', s_suppkey), s_name, concat('vendor/supply/supplier_', s_suppkey % 5, '.go'), 'struct', cast(s_nationkey as int) from {supplier}
union all select concat('part:', p_partkey), case when p_partkey % 50 = 0 then concat('.part', p_partkey, '()') when p_partkey % 50 = 1 then concat('part_', p_partkey % 3, '.go') else p_name end,
  case when p_partkey % 50 = 1 then concat('src/parts/part_', p_partkey % 3, '.go') when p_partkey % 10 = 3 then concat('src/tests/part_', p_partkey % 3, '_test.go') else concat('src/parts/part_', p_partkey % 4, '.go') end,
  'function', case when p_partkey % 25 = 24 then null else cast(p_partkey % 25 as int) end from {part}
union all select concat('order:', o_orderkey), concat('Order', o_orderkey), concat('src/orders/order_', o_orderkey % 11, '.rs'), 'method', cast(c_nationkey as int) from {orders} join {customer} on o_custkey = c_custkey
"""

STAR_EDGES = """
select concat('nation:', n_nationkey) as source, concat('region:', n_regionkey) as target, 'contains' as relation, 'EXTRACTED' as confidence, cast(1.0 as double) as confidence_score,
  cast(1.0 as double) as weight, cast(n_nationkey as bigint) as edge_seq from {nation}
union all select concat('customer:', c_custkey), concat('nation:', c_nationkey), 'references', 'EXTRACTED', cast(1.0 as double), cast(1.0 as double), cast(1000000000000 + c_custkey as bigint) from {customer}
union all select concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'references', 'INFERRED', cast(0.7 as double), cast(0.5 as double), cast(2000000000000 + s_suppkey as bigint) from {supplier}
union all select concat('order:', o_orderkey), concat('customer:', o_custkey), 'uses', 'EXTRACTED', cast(1.0 as double), cast(1.0 as double), cast(3000000000000 + o_orderkey as bigint) from {orders}
union all select concat('order:', l_orderkey), concat('part:', l_partkey), 'calls', case l_returnflag when 'N' then 'EXTRACTED' when 'R' then 'INFERRED' else 'AMBIGUOUS' end,
  cast(case l_returnflag when 'N' then 1.0 when 'R' then 0.7 else 0.4 end as double), cast(l_quantity as double) / cast(50.0 as double), cast(4000000000000 + l_orderkey * 100 + l_linenumber as bigint) from {lineitem}
union all select distinct concat('part:', l_partkey), concat('supplier:', l_suppkey), 'imports', 'EXTRACTED', cast(1.0 as double), cast(1.0 as double), cast(5000000000000 + l_partkey * 1000000 + l_suppkey as bigint) from {lineitem}
"""

_PAIRS = "select distinct concat('part:', l_partkey)", "from {lineitem}\n"
#: The same edges; pairs of part and supplier are made distinct as numbers, before they are written out as ids.
STAR_EDGES_BY_KEY = STAR_EDGES.replace(_PAIRS[0], _PAIRS[0].replace("distinct ", "")).removesuffix(_PAIRS[1]) + "from (select distinct l_partkey, l_suppkey from {lineitem}) as pairs\n"

RING_EDGES = """
select concat('part:', p_partkey) as source, concat('part:', (p_partkey * 7 + 3) % n) as target, 'calls' as relation, p_partkey as edge_seq
from {part} cross join (select count(*) as n from {part}) as c
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables in braces."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """The same query for an engine where the tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def star(spark: SparkSession, sf_dir: str) -> KG:
    """Regions, nations, customers, suppliers, parts and orders, and how rows refer to each other."""
    return KG(derived(spark, sf_dir, STAR_NODES), derived(spark, sf_dir, STAR_EDGES_BY_KEY))


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation of the parts: disjoint directed cycles."""
    return derived(spark, sf_dir, RING_EDGES)
