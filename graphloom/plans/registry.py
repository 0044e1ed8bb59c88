"""Registered queries of the graph engine and their SQL counterparts.

Each query is a function of a session and a folder of tables. SQL is standard
and made of the same derived graph, but none of the operators' code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import quality as Q
from graphloom.functions import text as X
from graphloom.graph import KG, is_file_node, is_method_stub
from graphloom.operators import analyze as A
from graphloom.operators import build as B
from graphloom.operators import code, community, docs, embed, export, imports, iterate, search, semantic, termindex, traverse
from graphloom.operators.components import connected_components
from graphloom.sources import files, nodelink, web
from graphloom.sources.tables import RING_EDGES, STAR_EDGES, STAR_NODES, derived, oracle, ring, star, table
from graphloom.streaming import watch

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_NODES, _EDGES = oracle(STAR_NODES), oracle(STAR_EDGES)
_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Nodes and edges of the relational graph, both directions, degrees, and quality of the paths that occur in it.
G = f"""with n as ({_NODES}), e as ({_EDGES}),
sym as (select source as src, target as dst, weight from e union all select target, source, weight from e),
d0 as (select src as id, count(*) as degree from (select src, dst from sym) group by src),
d as (select n.id, coalesce(d0.degree, 0)::bigint as degree from n left join d0 on n.id = d0.id),
q as (select n.*, split_part(source_file, '/', -1) as fname,
  (case when source_file like '%/tests/%' or source_file like '%\\_test.go' escape '\\' or lower(label) like 'test%' or contains(lower(label), 'mock') or contains(id, 'mock') then 0.58::float else 1::float end)
  * (case when source_file like 'vendor/%' then 0.35::float else 1::float end) * (case when source_file like 'docs/%' then 1.25::float else 1::float end) as priority from n),
k as (select q.*, d.degree, (priority < 0.75::float) as low, (label = fname) as is_file,
  ((label like '.%' and label like '%()') or (label like '%()' and d.degree <= 1)) as is_stub from q join d on q.id = d.id)
"""


def _star(fn):
    return lambda spark, sf: fn(star(spark, sf))


# -- aggregates and top-k -----------------------------------------------------------------------------------------

query(
    "god_nodes",
    G
    + """select id, case when label in ('lib','mod','main','index','init') then
      case when source_file like '%/src/%' then split_part(split_part(source_file, '/src/', 1), '/', -1) || '::' || label else split_part(source_file, '/', -2) || '::' || label end
      else label end as label, degree, community from k
    where not is_file and not is_stub and ((not low and label not like '.%' and node_type not in ('package', 'module')) or (node_type = 'module' and label in ('lib','mod','main','index','init')))
    order by degree desc, label, id limit 25""",
)(_star(lambda kg: A.god_nodes(kg, 25)))

query(
    "surprising_connections",
    G
    + """select source, target, relation, (2.0 * (coalesce(a.community, -1) <> coalesce(b.community, -1))::int + (a.source_file <> b.source_file)::int
      + case confidence when 'AMBIGUOUS' then 3.0 when 'INFERRED' then 1.5 else 0.0 end)::double as score, edge_seq
    from e join k a on a.id = e.source join k b on b.id = e.target where not a.is_file and not b.is_file and not a.is_stub and not b.is_stub and not a.low and not b.low
    order by score desc, edge_seq limit 200""",
)(_star(lambda kg: A.surprising_connections(kg, 200)))

query(
    "community_bridges",
    G
    + """, r as (select a.id, a.label, a.community, coalesce(b.community, a.community) as theirs from sym join k a on a.id = sym.src join k b on b.id = sym.dst where a.community is not null and not a.is_file)
    select id, label, community, count(*)::bigint as total_edges, sum((theirs <> community)::int)::bigint as cross_edges, sum((theirs <> community)::int)::double / count(*) as bridge_ratio,
      list_sort(list_distinct(list_append(list(theirs), community))) as communities_touched
    from r group by id, label, community having sum((theirs <> community)::int) > 0 order by bridge_ratio desc, id limit 200""",
)(_star(lambda kg: A.community_bridges(kg, 200)))

query(
    "cohesion",
    G
    + """, s as (select community, count(*) as size from n where community is not null group by 1),
    h as (select a.community, count(*) as hits from e join n a on a.id = e.source join n b on b.id = e.target where a.community = b.community group by 1)
    select s.community, size::bigint as size, coalesce(hits, 0)::bigint as hits, round(case when size <= 1 then 1.0 else coalesce(hits, 0) / (size * (size - 1) / 2.0) end, 9)::double as cohesion from s left join h on s.community = h.community""",
)(_star(lambda kg: A.cohesion(kg).withColumn("cohesion", F.round("cohesion", 9))))

query(
    "graph_stats",
    G
    + """select (select count(*) from n)::bigint as node_count, (select count(*) from e)::bigint as edge_count, (select count(distinct community) from n)::bigint as community_count,
      (select max(degree) from d)::bigint as max_degree, (select printf('%.2f', sum(degree)::double / count(*)) from d) as avg_degree""",
)(_star(A.graph_stats))

query("type_histogram", G + "select node_type as value, count(*)::bigint as n from n group by 1")(_star(lambda kg: A.histogram(kg.nodes, "node_type")))
query("relation_histogram", G + "select relation as value, count(*)::bigint as n from e group by 1 order by n desc, value limit 15")(_star(lambda kg: A.histogram(kg.edges, "relation", 15)))
query("confidence_breakdown", G + "select confidence, count(*)::bigint as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as percent from e group by 1")(_star(A.confidence_breakdown))
query(
    "community_summary", G + ", m as (select n.community, n.label, n.id, degree from n join d on n.id = d.id where community is not null) select community, count(*)::bigint as size, arg_max(label, (degree, id)) as representative from m group by 1"
)(_star(A.community_summary))
query(
    "community_links",
    G + "select least(x.community, y.community) as a, greatest(x.community, y.community) as b, count(*)::bigint as n from e join n x on x.id = source join n y on y.id = target where x.community <> y.community group by 1, 2",
)(_star(A.community_links))
_DIR = "regexp_extract({f}, '^(.*)/[^/]*$', 1)"
query("architecture_summary", G + f"select {_DIR.format(f='source_file')} as dir, count(*)::bigint as n from n group by 1")(_star(A.architecture_summary))
query(
    "architecture_links",
    G
    + f", f as (select id, {_DIR.format(f='source_file')} as dir from n) select least(x.dir, y.dir) as a, greatest(x.dir, y.dir) as b, count(*)::bigint as n from e join f x on x.id = source join f y on y.id = target where x.dir <> y.dir group by 1, 2",
)(_star(A.architecture_links))
query("get_community", G + "select n.id, label, degree from n join d on n.id = d.id where community = 3")(_star(lambda kg: A.get_community(kg, 3)))
query(
    "get_node",
    G + "select n.id, label, source_file, node_type, degree, (select list_sort(list(distinct dst)) from sym where src = 'nation:3') as neighbors from n join d on n.id = d.id where n.id = 'nation:3'",
)(_star(lambda kg: A.get_node(kg, "nation:3")))
query("wiki_hubs", G + "select id, degree from d where degree >= (select floor(greatest(avg(degree) * 2, 3)) from d)")(_star(A.wiki_hubs))
query(
    "html_prune",
    G
    + """, r as (select n.id, community, degree from n join d on n.id = d.id), c as (select least(count(distinct community), 25) as slots from r),
    t as (select id, 0 as tier, degree from r order by degree desc, id limit (select 100 - slots from c)),
    b as (select id, 1 as tier, degree from (select *, row_number() over (partition by community order by degree desc, id) as rn from r where community is not null) where rn = 1 and id not in (select id from t))
    select id from (select * from t union all select * from b order by tier, degree desc, id limit 100)""",
)(_star(lambda kg: A.html_prune(kg, 100)))
query(
    "community_labels",
    G
    + """, c as (select community, label, id, case when node_type in ('function', 'class', 'struct') then 3 when node_type = 'module' then 1 when node_type = 'file' then 0 else 2 end as r,
      (label not in ('lib', 'super::*', 'main', 'mod', 'tests') and not contains(label, '::') and not low and label not like '.%' and node_type not in ('package', 'module')) as telling from k where community is not null),
    x as (select community, coalesce(arg_max(label, (r, id)) filter (telling), arg_min(label, id)) as label from c group by 1)
    select community, case when row_number() over (partition by label order by community) > 1 then label || ' (' || community || ')' else label end as label from x""",
)(_star(A.community_labels))
query(
    "entrypoints",
    G + "select id, label, source_file, trunc(degree * priority::double * 100)::bigint as score from k where not is_file and not is_stub and not low and label not like '.%' and node_type not in ('package', 'module') order by score desc, id limit 12",
)(_star(A.entrypoints))
_SECTIONS = """select concat('doc:', doc_id) as id, concat(case doc_id % 6 when 0 then 'Purpose of ' when 1 then 'How it works: ' when 2 then 'Goals and Architecture ' else '' end, lang, ' ', source) as label,
  concat(case doc_id % 4 when 0 then 'docs/' when 1 then 'src/docs/' when 2 then 'src/' else '.planning/' end, case doc_id % 5 when 0 then 'README.md' when 1 then 'a_project.md' when 2 then 'PRODUCT.md' else 'notes.md' end) as source_file,
  case when doc_id % 11 = 0 then 'class' else 'concept' end as node_type, doc_id % 7 as level, text from {documents}"""


@query(
    "project_documents",
    f"""with d as ({oracle(_SECTIONS)}), p as (select *, lower(source_file) as path, lower(label) as low from d where node_type = 'concept' and level <= 3)
    select id, label, source_file, (case when path like '%product.md' or path like '%readme.md' or contains(path, 'project.md') then 20 else 0 end
      + case when contains(low, 'purpose') or contains(low, 'goal') then 30 else 0 end + case when contains(low, 'architecture') or contains(low, 'how it works') then 15 else 0 end - level)::int as rank, text as doc_text
    from p where path like '%/readme.md' or path like '%/product.md' or path like 'docs/%' or contains(path, '/docs/') or path like '.planning/%' order by rank desc, source_file, label, id limit 8""",
)
def project_documents(spark: SparkSession, sf: str) -> DataFrame:
    nodes = derived(spark, sf, _SECTIONS).withColumn("extra", F.create_map(F.lit("doc_level"), F.col("level").cast("string"), F.lit("doc_text"), F.col("text")))
    return A.project_documents(KG(nodes, None)).withColumn("rank", F.col("rank").cast("int"))


query(
    "key_communities",
    G
    + """, b as (select community, round(sum(priority::double), 4) as priority from k where community is not null group by 1 order by 2 desc, 1 limit 8),
    m as (select community, id, row_number() over (partition by community order by degree desc, id)::int as place from k where community is not null)
    select b.community, priority, place, id from m join b on m.community = b.community where place <= 8""",
)(_star(A.key_communities))
query(
    "source_quality",
    G + "select id, round(priority::double, 6) as priority, low from q join (select id as i, low from k) on id = i",
)(_star(lambda kg: Q.annotate(kg.nodes).select("id", F.round(F.col("source_priority").cast("double"), 6).alias("priority"), Q.is_low_signal().alias("low"))))
query("file_and_stub_nodes", G + "select id, is_file, is_stub from k where is_file or is_stub")(_star(lambda kg: kg.with_degree().select("id", is_file_node().alias("is_file"), is_method_stub().alias("is_stub")).where("is_file or is_stub")))
query("isolated_nodes", G + "select id, label from n where id not in (select source from e where relation = 'calls') and id not in (select target from e where relation = 'calls') and label <> split_part(source_file, '/', -1)")(
    _star(lambda kg: A.isolated_nodes(KG(kg.nodes, kg.edges.where("relation = 'calls'"))))
)
query("thin_communities", G + "select community, count(*)::bigint as size from n where community is not null group by 1 having count(*) < 760")(_star(lambda kg: A.thin_communities(kg, 760)))
query(
    "question_categories",
    G
    + """, many as (select src, count(distinct n.community) as c from sym join n on n.id = dst where n.community is not null group by 1 having count(distinct n.community) >= 3),
    gods as (select id, label, source_file, degree from k where not is_file and not is_stub and ((not low and label not like '.%' and node_type not in ('package', 'module')) or (node_type = 'module' and label in ('lib','mod','main','index','init')))),
    named as (select id, degree, case when label in ('lib','mod','main','index','init') then
      case when source_file like '%/src/%' then split_part(split_part(source_file, '/src/', 1), '/', -1) || '::' || label else split_part(source_file, '/', -2) || '::' || label end else label end as label from gods),
    top as (select * from named order by degree desc, label, id limit 5), inf as (select source as i from e where confidence = 'INFERRED' union select target from e where confidence = 'INFERRED'),
    s as (select community, count(*) as size from n where community is not null group by 1),
    h as (select a.community, count(*) as hits from e join n a on a.id = e.source join n b on b.id = e.target where a.community = b.community group by 1),
    c as (select s.community, size, coalesce(hits, 0) / (size * (size - 1) / 2.0::double) as co from s left join h on s.community = h.community where size > 1)
    select 2 as rank, 'bridge_node' as category, 0::bigint as seq, id as subject, 'How does ''' || id || ''' relate to ' || c || ' different communities?' as question from k join many on src = id where not is_file and not low
    union all select 3, 'verification', -degree, id, 'Can you verify the inferred relationships of ''' || label || ''' (degree ' || degree || ')?' from top where id in (select i from inf)
    union all select 4, 'isolated_node', 0, id, 'What role does ''' || label || ''' play? It has no connections in the graph.' from k where degree = 0 and not is_file
    union all select 5, 'low_cohesion', community, community::varchar, 'Why is ''community-' || community || ''' (' || size || ' nodes) loosely connected (cohesion ' || printf('%.2f', co) || ')? Should it be split?' from c where co < 0.3""",
)(_star(lambda kg: A.suggest_questions(kg, top_n=1 << 30).where("rank > 1")))
query("degrees", G + "select id, degree from d")(_star(lambda kg: kg.degrees()))
query(
    "suggest_questions",
    G
    + """, amb as (select 1 as rank, 'ambiguous_relationship' as category, edge_seq as seq, source as subject,
      'What is the exact relationship between ''' || source || ''' and ''' || target || '''? (marked as ' || relation || ')' as question from e where confidence = 'AMBIGUOUS')
    select * from amb order by rank, seq, subject, question limit 50""",
)(_star(lambda kg: A.suggest_questions(kg, top_n=50)))
query(
    "temporal_risk",
    G
    + """, churn as (select 'src/sales/customer_' || o_custkey % 7 || '.py' as source_file, o_orderdate::date as d from orders),
    per as (select source_file, count(*)::bigint as change_count, max(d) as last_modified from churn group by 1),
    f as (select source_file, max(degree) as degree from n join d on n.id = d.id group by 1), m as (select max(degree) as most from f),
    r as (select per.*, degree, most, greatest(1, date_diff('day', last_modified, date '2000-01-01'))::int as age_days from per join f on per.source_file = f.source_file cross join m)
    select source_file, change_count, last_modified, age_days, round(change_count::double / age_days, 9) as churn_rate, round(change_count::double / age_days * degree / most, 9) as risk_score from r where change_count::double * degree > 0 order by risk_score desc, source_file limit 10""",
)(
    lambda spark, sf: A.temporal_risk(
        table(spark, sf, "orders").select(F.concat(F.lit("src/sales/customer_"), F.col("o_custkey") % 7, F.lit(".py")).alias("source_file"), F.col("o_orderdate").alias("changed_on")), star(spark, sf), "2000-01-01"
    )
)

# -- building and comparing ---------------------------------------------------------------------------------------

_DUP = f"(select *, row_number() over (order by id) as node_seq from ({_NODES}))"


@query("merge_nodes", f"with n as ({_NODES}) select id, label from n")
def merge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    kg = star(spark, sf)
    late = kg.nodes.select("id", F.concat("label", F.lit("'")).alias("label"), F.lit(2).alias("node_seq"))
    return B.merge_nodes(late.unionByName(kg.nodes.select("id", "label", F.lit(1).alias("node_seq")))).select("id", "label")


@query(
    "drop_dangling",
    f"with e as ({_EDGES}) select source, target, edge_seq from e where not (relation = 'calls' and edge_seq % 10 = 0)",
)
def drop_dangling(spark: SparkSession, sf: str) -> DataFrame:
    kg = star(spark, sf)
    bad = kg.edges.withColumn("target", F.when((F.col("relation") == "calls") & (F.col("edge_seq") % 10 == 0), F.concat("target", F.lit("?"))).otherwise(F.col("target")))
    return B.drop_dangling(bad, kg.nodes).select("source", "target", "edge_seq")


@query("dedup_edges", f"with e as ({_EDGES}) select source, target, relation, min(edge_seq) as edge_seq from e group by 1, 2, 3")
def dedup_edges(spark: SparkSession, sf: str) -> DataFrame:
    return B.dedup_results(star(spark, sf).nodes.withColumn("node_seq", F.lit(1)), star(spark, sf).edges)[1].select("source", "target", "relation", "edge_seq")


def _snapshots(spark: SparkSession, sf: str) -> tuple[KG, KG]:
    kg = star(spark, sf)
    key = F.substring_index("id", ":", -1).cast("long")
    old = KG(kg.nodes.where(key % 10 != 1), kg.edges.where(F.col("edge_seq") % 7 != 0))
    new = KG(kg.nodes.where(key % 10 != 2), kg.edges.where(F.col("edge_seq") % 5 != 0))
    return old, new


_SNAP = f"""with n as ({_NODES}), e as ({_EDGES}), o as (select id from n where split_part(id, ':', 2)::bigint % 10 <> 1), w as (select id from n where split_part(id, ':', 2)::bigint % 10 <> 2),
oe as (select source, target, relation from e where edge_seq % 7 <> 0), we as (select source, target, relation from e where edge_seq % 5 <> 0)
"""
query(
    "graph_diff",
    _SNAP
    + """select 'added' as change, 'node' as kind, id, null::varchar as target, null::varchar as relation from (select id from w except select id from o)
    union all select 'removed', 'node', id, null, null from (select id from o except select id from w)
    union all select 'added', 'edge', source, target, relation from (select * from we except select * from oe) union all select 'removed', 'edge', source, target, relation from (select * from oe except select * from we)""",
)(lambda spark, sf: B.diff(*_snapshots(spark, sf)))
query(
    "graph_diff_lines",
    _SNAP
    + """select '+ node ' || id as line from (select id from w except select id from o) union all select '- node ' || id from (select id from o except select id from w)
    union all select '+ edge ' || source || ' --' || relation || '--> ' || target from (select * from we except select * from oe) union all select '- edge ' || source || ' --' || relation || '--> ' || target from (select * from oe except select * from we)""",
)(lambda spark, sf: B.diff_lines(*_snapshots(spark, sf)).select("line"))
query(
    "graph_diff_summary",
    _SNAP + "select (select count(*) from o)::bigint as old_nodes, (select count(*) from w)::bigint as new_nodes, (select count(*) from oe)::bigint as old_edges, (select count(*) from we)::bigint as new_edges",
)(lambda spark, sf: B.diff_summary(*_snapshots(spark, sf)))

# -- traversals and iterations ------------------------------------------------------------------------------------

_BFS = (
    "with recursive"
    + G[4:]
    + """, reach(id, depth) as (select 'supplier:1', 0 union select dst, depth + 1 from reach join sym on src = id where depth < 2),
b as (select id, min(depth)::int as depth from reach group by 1)
"""
)
query("bfs", _BFS + "select id, depth from b")(_star(lambda kg: traverse.bfs(kg, ["supplier:1"], 2)))
query("bfs_edges", _BFS + "select src, dst from sym join b on src = id where depth < 2")(_star(lambda kg: traverse.bfs_edges(kg, ["supplier:1"], 2)))
query(
    "get_neighbors",
    _BFS + ", x as (select dst as id, count(*) * 2 as c from sym where src = 'supplier:1' group by 1) select b.id, depth, coalesce(c, 0)::bigint as edge_count from b left join x on b.id = x.id where b.id <> 'supplier:1'",
)(_star(lambda kg: traverse.neighbors(kg, "supplier:1", 2)))


#: Depth first from nation:1 and part:1, two steps: part:1 is popped first, then its neighbours, then nation:1.
_DFS = (
    G
    + """, s as (select distinct src, dst from sym where src <> dst), start as (select * from (values ('part:1'), ('nation:1')) as v(id)),
c1 as (select dst as id, 1 as depth, 'part:1' as parent from s where src = 'part:1' and dst not in (select id from start)),
g1 as (select dst as id, 2 as depth, min(src) as parent from s join c1 on src = c1.id where dst not in (select id from start union all select id from c1) group by dst),
c2 as (select dst as id, 1 as depth, 'nation:1' as parent from s where src = 'nation:1' and dst not in (select id from start union all select id from c1 union all select id from g1)),
g2 as (select dst as id, 2 as depth, min(src) as parent from s join c2 on src = c2.id where dst not in (select id from start union all select id from c1 union all select id from g1 union all select id from c2) group by dst),
t as (select id, 0 as depth, null as parent from start union all select * from c1 union all select * from g1 union all select * from c2 union all select * from g2)
"""
)
_DFS_STARTS = ["nation:1", "part:1"]
query("dfs", _DFS + "select id, depth, parent from t")(_star(lambda kg: traverse.dfs_tree(kg, _DFS_STARTS, 2).select("id", "depth", "parent")))
query("dfs_edges", _DFS + "select src, dst from sym join t on src = id where depth < 2")(_star(lambda kg: traverse.steps_of(kg, traverse.dfs_tree(kg, _DFS_STARTS, 2), 2)))


_SMALL = G + ", s as (select src, dst from sym where src not like 'order%' and dst not like 'order%' and src not like 'part%' and dst not like 'part%' and src not like 'cust%' and dst not like 'cust%')"


@query(
    "simple_paths",
    "with recursive"
    + _SMALL[4:]
    + """, p(pos, path) as (select 'nation:1', ['nation:1'] union all select dst, list_append(path, dst) from p join s on src = pos where pos <> 'region:1' and not list_contains(path, dst) and len(path) < 6)
    select path, len(path)::int as nodes from p where pos = 'region:1' order by nodes, path limit 50""",
)
def simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    kg = star(spark, sf)
    small = KG(kg.nodes.where("node_type in ('module', 'struct', 'package')"), kg.edges.where("(relation = 'contains') or source like 'supplier%' and target like 'nation%'"))
    return traverse.simple_paths(small, "nation:1", "region:1", 4)


@query(
    "shortest_path",
    "with recursive" + G[4:] + ", r(pos, step) as (select 'nation:1', 0 union select dst, step + 1 from r join sym on src = pos where step < 5 and pos <> 'nation:2') select (min(step) + 1)::int as nodes from r where pos = 'nation:2'",
)
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    path = traverse.shortest_path(star(spark, sf), "nation:1", "nation:2")
    return spark.createDataFrame([(len(path) if path else None,)], "nodes int")


_PR = f"""with recursive n as ({_NODES}), e as ({_EDGES}), sym as (select source as src, target as dst from e union all select target, source from e),
deg as (select src, count(*) as k from sym group by 1), l as (select sym.src, sym.dst, count(*)::double / any_value(k) as w from sym join deg on sym.src = deg.src group by 1, 2),
c as (select count(*)::double as n from n),
r(step, id, score) as (select 0, id, 1.0::double / c.n from n, c union all
  select any_value(r.step) + 1, l.dst, 0.15::double / any_value(c.n) + 0.85::double * sum(r.score * l.w) from r join l on r.id = l.src, c where r.step < {{rounds}} group by l.dst)
"""


query("pagerank_five_rounds", _PR.format(rounds=5) + "select id, round(score, 10) as score from r where step = 5")(_star(lambda kg: iterate.pagerank(kg, rounds=5, tolerance=0.0).select("id", F.round("score", 10).alias("score"))))

@query("pagerank", _PR.format(rounds=20) + "select id, round(score, 10) as score, k as degree from r join deg on src = id where step = 20")
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    ranked = iterate.pagerank(star(spark, sf), rounds=20)
    return ranked.select("id", F.round("score", 10).alias("score"), "degree")


_RING = oracle(RING_EDGES)
_ORBIT = f"with recursive g as ({_RING}), o(start, pos, step) as (select source, source, 0 from g union select start, g.target, step + 1 from o join g on g.source = o.pos where step < 64)"
query("connected_components", _ORBIT + " select start as node, min(pos) as component from o group by 1")(lambda spark, sf: connected_components(ring(spark, sf).select(F.col("source").alias("src"), F.col("target").alias("dst"))))
query("strong_components", _ORBIT + " select start as id, min(pos) as component from o group by 1")(lambda spark, sf: iterate.strong_components(ring(spark, sf)))
query(
    "detect_cycles",
    _ORBIT + ", c as (select start, count(distinct pos) as n, min(pos) as least from o group by 1) select least as first_node, any_value(n)::int as length, round(1.0::double / any_value(n), 9) as severity from c where n > 1 group by 1",
)(lambda spark, sf: iterate.cycles(KG(ring(spark, sf).select(F.col("source").alias("id")), ring(spark, sf)), 1_000_000).select(F.col("nodes")[0].alias("first_node"), F.size("nodes").alias("length"), F.round("severity", 9).alias("severity")))


# Costs are 1 at least, so a path of at most four in all has at most four steps.
@query(
    "weighted_path",
    "with recursive"
    + G[4:]
    + """, c as (select source as src, target as dst, 1 / weight as cost from e where confidence_score >= 0.5 union all select target, source, 1 / weight from e where confidence_score >= 0.5),
    r(pos, total) as (select 'supplier:1', 0::double union select dst, total + cost from r join c on src = pos where total + cost <= 4) select round(min(total), 9) as total from r where pos = 'supplier:2'""",
)
def weighted_path(spark: SparkSession, sf: str) -> DataFrame:
    found = traverse.weighted_path(star(spark, sf), "supplier:1", "supplier:2", 0.5)
    return spark.createDataFrame([(round(found[0], 9) if found else None,)], "total double")


@query("communities")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return community.cluster(star(spark, sf))


@query("label_propagation")
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return community.propagate(star(spark, sf))


query(
    "affected_communities",
    G
    + """, hit as (select id from n where source_file = 'vendor/supply/supplier_1.go'), near as (select id from hit union select dst from sym join hit on src = id)
    select distinct community from n where id in (select id from near) and community is not null""",
)(_star(lambda kg: community.affected(kg, kg.membership(), ["vendor/supply/supplier_1.go"])))


@query("random_walks")
def random_walks(spark: SparkSession, sf: str) -> DataFrame:
    kg = star(spark, sf)
    return embed.walks(KG(kg.nodes.where("node_type in ('module', 'package')"), kg.edges.where("relation = 'contains'")), 2, 5)


@query("node_embeddings")
def node_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embed.node_vectors(star(spark, sf))


query(
    "similar_pairs",
    """with v as (select vec_id, embedding from embeddings order by vec_id limit 500), x as (select a.vec_id as node_a, b.vec_id as node_b, list_dot_product(a.embedding::double[], b.embedding::double[])
      / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))) as s from v a join v b on a.vec_id < b.vec_id)
    select node_a, node_b, round(s, 6) as similarity from x where round(s, 6) > 0.3 order by similarity desc, node_a, node_b limit 20""",
)(lambda spark, sf: embed.similar_pairs(table(spark, sf, "embeddings"), "vec_id", 20, 0.3))

# -- search -------------------------------------------------------------------------------------------------------

_QUESTION = "Where is the Customer order handler used?"
_HIT = "greatest(case when lower(label) = '{t}' then 4.0 when contains(lower(label), '{t}') then 2.5 else 0 end, case when lower(id) = '{t}' then 3.0 when contains(lower(id), '{t}') then 1.8 else 0 end, case when contains(lower(source_file), '{t}') then 0.8 else 0 end)::double"
_TYPE = "case when node_type in ('function', 'method') then 1.3 when node_type in ('struct', 'class') then 1.1 when node_type = 'module' then 0.9 when node_type = 'package' then 0.45 else 1.0 end::double"
_SCORES = (
    G
    + f""", s as (select id, degree, priority, node_type, {_HIT.format(t="customer")} as a, {_HIT.format(t="order")} as b from k)
    select id, round((a + b + ((a > 0)::int + (b > 0)::int) / 2.0::double) * priority::double * {_TYPE} + ln(1 + degree) * 0.05, 6) as score from s where a + b > 0"""
)
query("score_nodes", _SCORES)(_star(lambda kg: search.score_nodes(kg, search.question_terms(_QUESTION)).withColumn("score", F.round("score", 6))))


@query("score_nodes_by_postings", _SCORES)
def score_nodes_by_postings(spark: SparkSession, sf: str) -> DataFrame:
    kg = star(spark, sf)
    index = termindex.term_index(kg.nodes, "id", search.NAME_COLUMNS)
    return search.score_nodes(kg, search.question_terms(_QUESTION), index=index).withColumn("score", F.round("score", 6))


_NAME_TERMS = ("customer", "lib", "00017", "ue", "nothing_like_it")


@query(
    "term_weights_by_postings",
    f"with n as ({_NODES}), t as (" + " union all ".join(f"select '{t}' as term, count(*) filter (contains(lower(label), '{t}') or contains(lower(id), '{t}') or contains(lower(source_file), '{t}'))::bigint as df, count(*) as n from n" for t in _NAME_TERMS)
    + ") select term, df, round(least(greatest(ln((n + 1.0::double) / (df + 1.0::double)), 0.25), 2.75), 6) as weight from t",
)
def term_weights_by_postings(spark: SparkSession, sf: str) -> DataFrame:
    nodes = star(spark, sf).nodes
    index = termindex.term_index(nodes, "id", search.NAME_COLUMNS)
    return search.indexed_weights(index, nodes, [search.Term(t, False) for t in _NAME_TERMS]).withColumn("weight", F.round("weight", 6))


_SEED_TYPE = "case when node_type in ('function', 'method') then 1.25 when node_type in ('struct', 'class') then 1.1 when node_type = 'module' then 0.45 when node_type = 'package' then 0.65 else 1.0 end::double"
_SEED = "(case when lower(label) = '{t}' then 5.0 when contains(lower(label), '{t}') then 3.0 else 0 end + case when lower(id) = '{t}' then 4.0 when contains(lower(id), '{t}') then 2.5 else 0 end + case when contains(lower(source_file), '{t}') then 0.8 else 0 end)::double"
query(
    "query_scores",
    G
    + f""", s as (select id, degree, priority, node_type, {_SEED.format(t="supplier")} as a from k)
    select id, round(a * priority::double * {_SEED_TYPE} - ln(1 + degree) * 0.08, 6) as score from s""",
)(_star(lambda kg: search.query_scores(kg, ["supplier"]).select("id", F.round("score", 6).alias("score"))))
_IDF = " union all ".join(
    f"select '{t}' as term, count(*) filter (contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t}'))::bigint as df, count(*) as n from documents" for t in ("license", "password", "thing", "und")
)
query("term_weights", f"select term, df, round(least(greatest(ln((greatest(n, 1) + 1.0::double) / (df + 1.0::double)), 0.25), 2.75), 6) as weight from ({_IDF})")(
    lambda spark, sf: search.term_weights(table(spark, sf, "documents"), [search.Term(t, False) for t in ("license", "password", "thing", "und")]).withColumn("weight", F.round("weight", 6))
)


_WORD_HIT = "greatest(case when lower(label) = '{t}' then 4.0 when contains(lower(label), '{t}') then 2.6 else 0 end, case when lower(id) = '{t}' then 3.2 when contains(lower(id), '{t}') then 2.0 else 0 end, case when contains(lower(source_file), '{t}') then 1.25 else 0 end, case when contains(lower(text), '{t}') then 0.55 else 0 end)::double"
_PLACES = """select id, ('0x' || substr(md5(g), 1, 8))::bigint % 64 as place, sum(case when substr(md5(g), 9, 1) >= '8' then 1 else -1 end)::double as s
    from (select id, unnest(list_concat([w], case when length(w) > 2 then list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) else [] end)) as g from (select id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from {t})) group by 1, 2"""
_UNIT = "select id, place, (s / sqrt(sum(s * s) over (partition by id)))::float::double as x from ({p})"


@query(
    "hybrid_search",
    G
    + f""", idx as (select id, label || chr(10) || id || chr(10) || 'type: ' || node_type || chr(10) || 'file: ' || source_file as text from n),
    v as ({_UNIT.format(p=_PLACES.format(t="idx"))}), ask as (select 'q' as id, '{_QUESTION}' as text), a as ({_UNIT.format(p=_PLACES.format(t="ask"))}),
    dot as (select v.id, sum(v.x * a.x) as d from v join a on v.place = a.place group by 1), len as (select id, sqrt(sum(x * x)) as l from v group by 1), qlen as (select sqrt(sum(x * x)) as ql from a),
    w as (select least(greatest(ln((count(*) + 1.0::double) / (count(*) filter (contains(lower(text), 'customer')) + 1.0::double)), 0.25), 2.75) as w1, least(greatest(ln((count(*) + 1.0::double) / (count(*) filter (contains(lower(text), 'order')) + 1.0::double)), 0.25), 2.75) as w2 from idx),
    kx as (select k.*, idx.text from k join idx on k.id = idx.id),
    r as (select kx.id, label, source_file, node_type, degree, priority, coalesce(d / (l * ql), 0.0::double) as sem, w1, w2, {_WORD_HIT.format(t="customer")} as h1, {_WORD_HIT.format(t="order")} as h2,
      (w1 >= 1 and (contains(lower(label), 'customer') or contains(lower(id), 'customer'))) or (w2 >= 1 and (contains(lower(label), 'order') or contains(lower(id), 'order'))) as exact
      from kx join (select id as i, l from len) on i = kx.id left join (select id as j, d from dot) on j = kx.id cross join qlen cross join w),
    m as (select *, least(5.0::double, (h1 * w1 + h2 * w2) / (w1 + w2) + (case when h1 > 0 then w1 else 0 end + case when h2 > 0 then w2 else 0 end) / (w1 + w2) * 1.2) as lex,
      priority::double * (case when source_file like 'docs/%' then 0.68 else 1.0 end)::double * (case when not exact and (source_file like '%/tests/%' or source_file like '%\\_test.go' escape '\\' or lower(label) like 'test%' or contains(lower(label), 'mock')) then 0.58 else 1.0 end)::double as f from r)
    select id as node_id, label, source_file, round((sem * 0.36::double + lex * 0.60::double + ln(1 + degree) * 0.015::double) * least(greatest(case when exact then greatest(f, 0.72::double) else f end, 0.03::double), 2.5::double), 6) as score,
      round(sem, 6) as semantic_score, round(lex, 6) as lexical_score from m where score > 0 order by score desc, node_id limit 20""",
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    kg = star(spark, sf)
    index = embed.encode_text(search.index_text(kg.nodes))
    vector = embed.encode_text(spark.createDataFrame([(_QUESTION,)], "text string")).first()["embedding"]
    return search.hybrid(kg, index, _QUESTION, list(vector), 20)


query(
    "lexical_seeds",
    G
    + f""", s as (select id, degree, priority, node_type, {_HIT.format(t="supplier")} as a, {_SEED.format(t="supplier")} as b from k),
    r as (select id, node_type, round((a + 1) * priority::double * {_TYPE} + ln(1 + degree) * 0.05, 9) as rank, b * priority::double * {_SEED_TYPE} - ln(1 + degree) * 0.08 as score from s where a > 0)
    select id, rank from r where score > 0 or node_type not in ('file', 'module', 'package') order by rank desc, id limit 6""",
)(_star(lambda kg: search.lexical_seeds(kg, ["supplier"])))


@query("query_graph")
def query_graph(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.tools import Tools

    kg = star(spark, sf)
    encoder = lambda text: list(embed.encode_text(spark.createDataFrame([(text,)], "text string")).first()["embedding"])
    found = Tools(kg, embed.encode_text(search.index_text(kg.nodes)), encoder).query_graph(_QUESTION, 800)
    return spark.createDataFrame([(i, n) for i, n in enumerate(found["nodes"])], "place int, id string")


query(
    "subgraph_text",
    f"with e as ({_EDGES}), l as (select edge_seq as ord, source || ' --' || relation || '--> ' || target as line from e), u as (select *, coalesce(sum(strlen(line) + 1) over (order by ord rows between unbounded preceding and 1 preceding), 0) as used from l) select ord, line from u where used < 2000",
)(_star(lambda kg: traverse.subgraph_text(kg.edges.select(F.col("edge_seq").alias("ord"), F.concat("source", F.lit(" --"), "relation", F.lit("--> "), "target").alias("line")), 500)))
query("index_text", f"with n as ({_NODES}) select id as node_id, label || chr(10) || id || chr(10) || 'type: ' || node_type || chr(10) || 'file: ' || source_file as text from n")(_star(lambda kg: search.index_text(kg.nodes)))

# -- text and column functions ------------------------------------------------------------------------------------

_DOCS = lambda fn: lambda spark, sf: fn(table(spark, sf, "documents"))
query(
    "make_id",
    r"select p_partkey, lower(trim(regexp_replace(trim(p_name, '_.') || '_' || trim(p_brand, '_.') || '_' || trim(p_type, '_.'), '[^\p{L}\p{N}]+', '_', 'g'), '_')) as node_id from part",
)(lambda spark, sf: table(spark, sf, "part").select("p_partkey", X.make_id("p_name", "p_brand", "p_type").alias("node_id")))
query("word_counts", r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as words from documents")(_DOCS(lambda d: d.select("doc_id", X.word_count("text").alias("words"))))
query("token_estimates", "select doc_id, ceil(strlen(text) / 4.0)::bigint as tokens from documents")(_DOCS(lambda d: d.select("doc_id", X.estimate_tokens("text").alias("tokens"))))
query(
    "escapes",
    r"""select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) as xml,
    md5(replace(replace(replace(replace(text, '\', '\\'), '''', '\'''), chr(10), '\n'), chr(13), '\r')) as cypher, md5(case when length(text) > 100 then substring(text, 1, 100) || '…' else text end) as cut from documents""",
)(_DOCS(lambda d: d.select("doc_id", F.md5(X.xml_escape("text")).alias("xml"), F.md5(X.cypher_escape("text")).alias("cypher"), F.md5(X.truncate_chars("text", 100)).alias("cut"))))
query("content_hash", "select doc_id, sha256(text) as sha256 from documents")(_DOCS(lambda d: d.select("doc_id", X.content_hash("text").alias("sha256"))))
query(
    "compact_text",
    r"""with x as (select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)) as t from documents)
    select doc_id, md5(case when length(t) > 1600 then substring(t, 1, 1600) || '…' else t end) as compact from x""",
)(_DOCS(lambda d: d.select("doc_id", F.md5(X.compact_text("text", 1600)).alias("compact"))))
query(
    "content_flags",
    r"""with x as (select doc_id, text, list_filter(list_slice(string_split(text, chr(10)), 1, 20), lambda l: regexp_replace(l, '\s+', '', 'g') <> '') as ls from documents)
    select doc_id, (select bool_or(contains(translate(substring(text, 1, 4096), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) from (values ('code generated'), ('auto-generated'), ('autogenerated'), ('automatically generated'), ('do not edit'), ('do not modify'), ('generated by'), ('@generated'), ('<auto-generated'), ('eslint-disable'), ('tslint:disable')) v(p)) as generated,
    coalesce(len(ls) > 0 and (floor(list_sum(list_transform(ls, lambda l: strlen(l))) / len(ls)) > 500 or (floor(list_sum(list_transform(ls, lambda l: strlen(l))) / len(ls)) > 220 and length(regexp_replace(text, '[^{};,:()]', '', 'g'))::double / greatest(length(text), 1) > 0.18)), false) as minified from x""",
)(_DOCS(lambda d: d.select("doc_id", Q.looks_generated("text").alias("generated"), Q.looks_minified("text").alias("minified"))))
query(
    "plain_chunks",
    r"""with c as (select 'corpus/doc_' || doc_id || '.txt' as path, unnest(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: strlen(l) > 40), 1, 12)) as chunk,
      generate_subscripts(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: strlen(l) > 40), 1, 12), 1)::int as part, doc_id from documents)
    select path, part, 'doc_' || doc_id || case when part > 1 then ' part ' || part else '' end as label, 'corpus_doc_' || doc_id || '_txt_text_' || part || '_doc_' || doc_id || case when part > 1 then '_part_' || part else '' end as id,
      case when length(chunk) > 1600 then substring(chunk, 1, 1600) || '…' else chunk end as doc_text from c""",
)(_DOCS(lambda d: docs.plain_chunks(d.select(F.format_string("corpus/doc_%d.txt", "doc_id").alias("path"), "text"), "\n")))
query(
    "markdown_sections",
    """with d as (select 'doc_' || doc_id || '.md' as path, doc_id from documents)
    select path, 3::int as line, 1::int as level, 'Part ' || doc_id as title from d union all select path, 9::int, 2::int, 'Second' from d""",
)(
    _DOCS(
        lambda d: docs.headings(
            d.select(
                F.format_string("doc_%d.md", "doc_id").alias("path"),
                F.format_string("intro\n\n# Part %d #\n%s\n```\n# not a heading\n```\n# install things\n## `Second`\nend\n", "doc_id", F.regexp_replace("text", r"[\n\r#`~]", " ")).alias("text"),
            )
        ).select("path", "line", "level", "title")
    )
)
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'))"
query("page_text", rf"select page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, md5({_STRIP}) as body from pages")(
    lambda spark, sf: web.page_markdown(table(spark, sf, "pages")).select("page_id", "url", "title", F.md5("body").alias("body"))
)
query(
    "url_routes",
    r"select page_id, case when contains(lower(url), 'arxiv.org') then 'arxiv' when regexp_matches(lower(url), '^https?://(www\.)?(twitter\.com|x\.com)/') then 'tweet' when regexp_replace(lower(url), '[?#].*$', '') like '%.pdf' then 'pdf' else 'webpage' end as route from pages",
)(lambda spark, sf: table(spark, sf, "pages").select("page_id", web.route().alias("route")))
query("page_links", r"""select page_id, regexp_extract(url, '^\w+://([^/:?#]+)', 1) as host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) as href from pages""")(lambda spark, sf: web.links(table(spark, sf, "pages")))
query("safe_urls")(lambda spark, sf: table(spark, sf, "pages").select("page_id", web.safe_url("url").alias("safe")))
query(
    "cosine",
    """with q as (select embedding::double[] as v from embeddings where vec_id = (select min(vec_id) from embeddings)) select vec_id, round(list_dot_product(embedding::double[], v) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v, v))), 6) as similarity from embeddings, q""",
)(
    lambda spark, sf: table(spark, sf, "embeddings")
    .crossJoin(F.broadcast(table(spark, sf, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("v"))))
    .select("vec_id", F.round(X.cosine("embedding", "v"), 6).alias("similarity"))
)

# -- files --------------------------------------------------------------------------------------------------------

_PATHS = """select case p_partkey % 12 when 0 then 'src/app/main_' || p_partkey || '.py' when 1 then 'node_modules/lib/x' || p_partkey || '.js' when 2 then 'docs/guide_' || p_partkey || '.md' when 3 then '.hidden/a' || p_partkey || '.py'
  when 4 then 'config/db-password.' || p_partkey || '.yml' when 5 then 'keys/server' || p_partkey || '.pem' when 6 then 'secrets/x' || p_partkey || '.txt' when 7 then 'img/i' || p_partkey || '.PNG' when 8 then '.planning/p' || p_partkey || '.md'
  when 9 then 'src/secret_resolver' || p_partkey || '.rs' when 10 then 'paper/p' || p_partkey || '.pdf' else 'my_venv/z' || p_partkey || '.py' end as path, p_partkey as k, p_size as s from {part}"""
_P = f"with f as ({oracle(_PATHS)})"
query("noise_pruned", _P + " select path from f where not (path like 'node_modules/%' or path like '.hidden/%' or path like 'my_venv/%')")(lambda spark, sf: derived(spark, sf, _PATHS).where(~files.in_noise()).select("path"))
query("sensitive_files", _P + " select path from f where path like 'config/db-password.%' or path like '%.pem' or path like 'secrets/%' or path like 'src/secret_resolver%'")(lambda spark, sf: derived(spark, sf, _PATHS).where(files.is_sensitive()).select("path"))
query(
    "file_types",
    _P + " select path, case when path like '%.py' or path like '%.js' or path like '%.rs' then 'code' when path like '%.pdf' then 'paper' when path like '%.md' or path like '%.txt' then 'document' when lower(path) like '%.png' then 'image' end as file_type from f",
)(lambda spark, sf: derived(spark, sf, _PATHS).select("path", files.classify().alias("file_type")))
query("ignored_files", _P + " select path, (path like '%.md' and path not like '.planning/%') or path like 'img/%' as ignored from f")(
    lambda spark, sf: files.ignored(derived(spark, sf, _PATHS), ["*.md", "img/"], ["!/.planning/*.md"]).select("path", "ignored")
)
_MAN = _P + ", now as (select path, md5(k || ':' || s) as h from f where k % 9 <> 0), old as (select path, case when k % 5 = 0 then 'x' else md5(k || ':' || s) end as h from f where k % 7 <> 0)"


def _manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = derived(spark, sf, _PATHS).withColumn("sha256", F.md5(F.concat("k", F.lit(":"), "s").cast("binary"))).withColumn("file_type", F.lit("code")).withColumn("sensitive", F.lit(False))
    return f.where("k % 9 <> 0"), f.where("k % 7 <> 0").withColumn("sha256", F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("sha256")))


query(
    "file_changes",
    _MAN + " select coalesce(now.path, old.path) as path, case when old.path is null then 'added' when now.path is null then 'deleted' when now.h = old.h then 'same' else 'changed' end as change from now full join old on now.path = old.path",
)(lambda spark, sf: files.changes(*_manifests(spark, sf)))
query("cache_misses", _MAN + " select path from now where not exists (select 1 from old where old.path = now.path and old.h = now.h)")(lambda spark, sf: files.cache_misses(*_manifests(spark, sf)).select("path"))
query("manifest_update", _MAN + " select path, h as sha256 from now union all select path, h from old where path not in (select path from now)")(lambda spark, sf: files.updated_manifest(*_manifests(spark, sf)).select("path", "sha256"))

# -- code and replies ---------------------------------------------------------------------------------------------


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("x = readd("), F.lit("f"), (F.col("p_partkey") * 7 + 3) % 50, F.lit(" ("), F.lit("1)) + g"), (F.col("p_partkey") * 3 + 1) % 50, F.lit("(2)"))
    return table(spark, sf, "part").select(F.concat(F.lit("src/m"), F.floor(F.col("p_partkey") / 50), F.lit(".py")).alias("path"), F.concat(F.lit("n"), "p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "f").otherwise("g"), F.col("p_partkey") % 50).alias("name"), body.alias("body"))


_FN = """with f as (select 'src/m' || (p_partkey // 50) || '.py' as path, 'n' || p_partkey as id, (case when p_partkey % 2 = 0 then 'f' else 'g' end) || (p_partkey % 50) as name,
'x = readd(f' || ((p_partkey * 7 + 3) % 50) || ' (1)) + g' || ((p_partkey * 3 + 1) % 50) || '(2)' as body from part)"""
query("calls_by_word", _FN + r" select distinct a.path, a.id as source, b.id as target from f a join f b on a.path = b.path and a.id <> b.id where regexp_matches(a.body, '\b' || b.name || '\s*\(')")(lambda spark, sf: code.calls_by_word(_functions(spark, sf)))
query("calls_by_part", _FN + " select distinct a.path, a.id as source, b.id as target from f a join f b on a.path = b.path and a.id <> b.id where contains(lower(a.body), lower(b.name) || '(')")(lambda spark, sf: code.calls_by_part(_functions(spark, sf)))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("from pkg.m"), (k * 7 + 3) % 100, F.lit(" import Part"), (k * 7 + 3) % 100, F.lit("\n\nclass Part"), k, F.lit(":\n    def size(self):\n        return load()\n\ndef load():\n    return "), F.col("p_size"), F.lit("\n"))
    return table(spark, sf, "part").select(F.concat(F.lit("pkg/m"), k, F.lit(".py")).alias("path"), text.alias("text"))


query(
    "extract_python",
    """with p as (select p_partkey as k, 'pkg_m' || p_partkey || '_py' as f from part)
    select f as source, f || '_part' || k as target, 'defines' as relation from p union all select f || '_part' || k, f || '_part' || k || '_size', 'defines' from p union all select f, f || '_load', 'defines' from p
    union all select f || '_part' || k || '_size', f || '_load', 'calls' from p union all select f, f || '_import_pkg_m' || (k * 7 + 3) % 100 || '_part' || (k * 7 + 3) % 100, 'imports' from p""",
)(lambda spark, sf: code.extract(_sources(spark, sf))[1].select("source", "target", "relation"))


@query(
    "resolve_imports",
    """with f as (select p_partkey as k, (p_partkey * 7 + 3) % 100 as j from part), kinds as (select * from (values ('thing'), ('make')) as v(kind))
    select concat('web_m', k, '_ts_', a.kind, k) as source, concat('web_m', j, '_ts_', b.kind, j) as target, 'uses' as relation, 0.8::double as confidence_score
    from f cross join kinds a cross join kinds b where j in (select p_partkey from part) and j <> k""",
)
def resolve_imports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("import { Thing } from 'm"), (k * 7 + 3) % 100, F.lit("';\nexport class Thing"), k, F.lit(" {}\nfunction make"), k, F.lit("() { return 1; }\n"))
    src = table(spark, sf, "part").select(F.concat(F.lit("web/m"), k, F.lit(".ts")).alias("path"), text.alias("text"))
    nodes, edges = code.extract(src)
    return imports.resolve_cross_file(nodes, edges).select("source", "target", "relation", "confidence_score")


query(
    "parse_replies",
    """select 'doc' || doc_id as source_file, 'doc' || doc_id || '_alpha' as source, 'doc' || doc_id || '_beta' as target, 'related_to' as relation from documents""",
)(
    _DOCS(
        lambda d: semantic.parse_replies(
            d.select(
                F.concat(F.lit("doc"), "doc_id").alias("path"),
                F.lit('Here:\n```json\n{"entities": [{"name": "Alpha", "type": "Concept"}, {"name": "Beta"}], "relationships": [{"source": "Alpha", "target": "Beta"}]}\n```\n').alias("reply"),
            )
        )[1].select("source_file", "source", "target", "relation")
    )
)

# -- sinks and streams --------------------------------------------------------------------------------------------

query(
    "nodelink_roundtrip",
    f"with n as ({_NODES}) select id, label, community from n where id like 'nation:%'",
)(lambda spark, sf: nodelink.parse(_document(spark, sf)).nodes.select("id", "label", "community"))


def _document(spark: SparkSession, sf: str) -> DataFrame:
    kg = star(spark, sf)
    part = KG(kg.nodes.where("id like 'nation:%'"), kg.edges.where("source like 'nation:%'"))
    rows = nodelink.lines(part).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), ", ").alias("rows"))
    one = rows.groupBy().agg(F.max(F.when(F.col("part") == "nodes", F.col("rows"))).alias("n"), F.max(F.when(F.col("part") == "links", F.col("rows"))).alias("l"))
    return one.select(F.concat(F.lit('{"nodes": ['), "n", F.lit('], "links": ['), "l", F.lit("]}")).alias("value"))


query(
    "graphml",
    G
    + """select 'n' || id as ord, '<node id="' || id || '"><data key="label">' || replace(replace(label, '&', '&amp;'), '''', '&apos;') || '</data><data key="type">' || node_type || '</data></node>' as line from n
    union all select 'x' || lpad(edge_seq::varchar, 20, '0'), '<edge source="' || source || '" target="' || target || '"><data key="relation">' || relation || '</data><data key="weight">' || weight::varchar || '</data></edge>' from e""",
)(_star(export.graphml))
query(
    "cypher",
    G
    + r"""select 'n' || id as ord, 'CREATE (' || replace(id, ':', '_') || ':' || upper(substring(node_type, 1, 1)) || substring(node_type, 2) || ' {id: ''' || id || ''', label: ''' || replace(label, '''', '\''') || '''})' as line from n
    union all select 'x' || lpad(edge_seq::varchar, 20, '0'), 'CREATE (' || replace(source, ':', '_') || ')-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(' || replace(target, ':', '_') || ')' from e""",
)(_star(export.cypher))
query("graphml_nodes", G + """select 'n' || id as ord, '<node id="' || id || '"><data key="label">' || replace(replace(label, '&', '&amp;'), '''', '&apos;') || '</data><data key="type">' || node_type || '</data></node>' as line from n""")(
    _star(lambda kg: export.graphml(kg).where("ord like 'n%'"))
)
query("cypher_nodes", G + r"""select 'n' || id as ord, 'CREATE (' || replace(id, ':', '_') || ':' || upper(substring(node_type, 1, 1)) || substring(node_type, 2) || ' {id: ''' || id || ''', label: ''' || replace(label, '''', '\''') || '''})' as line from n""")(
    _star(lambda kg: export.cypher(kg).where("ord like 'n%'"))
)
query(
    "community_pages",
    G
    + """, m as (select id, community from n where community is not null), pg as (select 'community_' || community || '.html' as file, '1' as kind, count(*)::bigint as lines from m group by community
    union all select 'community_' || a.community || '.html', '2', count(*)::bigint from e join m a on source = a.id join m b on target = b.id where a.community = b.community group by a.community
    union all select 'index.html', '1', count(distinct community)::bigint from m union all select 'index.html', '3', count(distinct community)::bigint from m
    union all select 'index.html', '2', count(distinct (least(a.community, b.community), greatest(a.community, b.community)))::bigint from e join m a on source = a.id join m b on target = b.id where a.community <> b.community)
    select * from pg union all select distinct file, x, 1 from pg, (values ('0'), ('9')) as t(x)""",
)(_star(lambda kg: export.split_html(kg).groupBy("file", F.substring("ord", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))))
query("svg_circle", f"with n as ({_NODES}), r as (select id, label, row_number() over (order by id) - 1 as i from n), m as (select *, count(*) over () as c from r) select id, label, round(400 + 350 * cos(i * 2 * pi() / c - pi() / 2), 3) as x, round(400 + 350 * sin(i * 2 * pi() / c - pi() / 2), 3) as y from m")(_star(export.circle))
query(
    "vault_notes",
    f"""with n as ({_NODES}), e as ({_EDGES}),
    c as (select *, trim(regexp_replace(label, '[/\\\\:*?"<>|]', '_', 'g'), ' .') as t from n),
    f as (select *, case when t = '' then 'untitled' else t end as base from c),
    i as (select *, row_number() over (partition by lower(base) order by id) as k from f),
    m as (select *, case when k > 1 then base || '_' || (k - 1) else base end as name from i),
    l as (select distinct src, '- ' || relation || ' [[' || name || ']]' as line from (select source as src, target as dst, relation from e union all select target, source, relation from e) join m on m.id = dst),
    g as (select src, string_agg(line, chr(10) order by line) as links from l group by src)
    select name || '.md' as file, '---' || chr(10) || 'type: ' || node_type || chr(10) || 'file: ' || source_file || chr(10) || '---' || chr(10) || chr(10) || '# ' || label || chr(10) || chr(10) || coalesce(links, '') as text from m left join g on src = id""",
)(_star(export.vault))
query("wiki_pages")(_star(lambda kg: export.wiki(kg).select("file", F.md5("text").alias("digest"))))
query(
    "debounced_events",
    """with s as (select ts, case when lag(ts) over (order by ts) >= ts - interval 3 second and lag(ts) over (order by ts) + interval 3 second > ts then 0 else 1 end as fresh from events), g as (select ts, sum(fresh) over (order by ts rows unbounded preceding) as burst from s)
    select min(ts) as start, max(ts) + interval 3 second as "end", count(*)::bigint as n from g group by burst""",
)(lambda spark, sf: watch.debounced(table(spark, sf, "events")))
query("changed_paths", _P + " select path from f where not (contains(path, 'node_modules'))")(lambda spark, sf: derived(spark, sf, _PATHS).where(~watch.is_ignored()).select("path"))


@query("event_transitions", "with t as (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as after from events) select event_type as source, after as target, count(*)::bigint as n from t where after is not null group by 1, 2")
def event_transitions(spark: SparkSession, sf: str) -> DataFrame:
    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), after.alias("target")).where("target is not null")
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
