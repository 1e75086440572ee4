"""Taxonomies and tag decoding, on the tree region - nation - customer and a second parent for some customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, taxonomy
from ..session import landed
from ..sources.taxonomy import nodes_and_edges
from .base import query, table

# Tags: a root, regions, nations, customers; every 10th customer has a second parent, the next region.
TREE_SQL = """
nodes as (
  select 'root' as id, 'Everything' as name, 0 as ord union all select 'r' || r_regionkey, r_name, 1 + r_regionkey from region
  union all select 'n' || n_nationkey, n_name, 10 + n_nationkey from nation union all select 'c' || c_custkey, c_name, 100 + c_custkey from customer),
edges as (
  select 'r' || r_regionkey as child_id, 'root' as parent_id, 0 as ord from region union all select 'n' || n_nationkey, 'r' || n_regionkey, 0 from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, 0 from customer union all select 'c' || c_custkey, 'r' || (c_nationkey % 5), 1 from customer where c_custkey % 10 = 0)
"""


def tree(spark, sf_dir):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = spark.range(1).select(F.lit("root").alias("id"), F.lit("Everything").alias("name"), F.lit(0).cast("long").alias("ord"))
    for rows, p, key, name, base in ((region, "r", "r_regionkey", "r_name", 1), (nation, "n", "n_nationkey", "n_name", 10), (customer, "c", "c_custkey", "c_name", 100)):
        nodes = nodes.unionByName(rows.select(s(p, key).alias("id"), F.col(name).alias("name"), (F.col(key) + base).cast("long").alias("ord")))
    edge = lambda rows, child, parent, ord_=0: rows.select(child.alias("child_id"), parent.alias("parent_id"), F.lit(ord_).alias("ord"))
    edges = edge(region, s("r", "r_regionkey"), F.lit("root")).unionByName(edge(nation, s("n", "n_nationkey"), s("r", "n_regionkey"))).unionByName(edge(customer, s("c", "c_custkey"), s("n", "c_nationkey")))
    second = customer.where("c_custkey % 10 = 0").select(s("c", "c_custkey").alias("child_id"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("parent_id"), F.lit(1).alias("ord"))
    return nodes, edges.unionByName(second)


WALK_SQL = f"""with recursive {TREE_SQL}, walk(id, path, ords) as (
  select 'root', cast([] as varchar[]), cast([] as integer[]) union all
  select e.child_id, list_append(w.path, n.name), list_prepend(e.ord, w.ords) from walk w join edges e on e.parent_id = w.id join nodes n on n.id = w.id)
"""


@query("taxonomy_paths", f"""{WALK_SQL} select id, array_to_string(path, ' > ') as path from walk where id <> 'root'""")
def taxonomy_paths(spark, sf_dir):
    return taxonomy.paths(*tree(spark, sf_dir), "root").select("id", F.array_join("path", " > ").alias("path"))


TAGS_SQL = f"""{WALK_SQL}, best as (select id, arg_min(path, struct_pack(n := len(path), o := ords)) as path, count(distinct path) as path_count from walk where id <> 'root' group by id),
tags as (select n.id, n.name, array_to_string(b.path, ' > ') as path_string, coalesce(len(b.path), 0) as depth, coalesce(b.path_count, 1) as path_count,
  coalesce((select arg_min(parent_id, ord) from edges e where e.child_id = n.id), '') as parent_id, n.id not in (select parent_id from edges) as is_leaf
  from nodes n left join best b on b.id = n.id where n.id <> 'root')
"""


def tags(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    return taxonomy.summary(nodes, edges, "root").where("id <> 'root'").withColumn("path_count", F.col("path_count").cast("int"))


def located(spark, sf_dir):
    return taxonomy.located(*tree(spark, sf_dir), "root").where("id <> 'root'")


def first_parents(spark, sf_dir):
    return landed(taxonomy.first_parents(*tree(spark, sf_dir)).where("id <> 'root'"), "tags")  # read by several steps of a query


@query("tag_enrich", f"""{TAGS_SQL} select id, name, path_string, cast(depth as integer) as depth, cast(path_count as integer) as path_count, parent_id, is_leaf from tags""")
def tag_enrich(spark, sf_dir):
    return tags(spark, sf_dir).select("id", "name", "path_string", "depth", "path_count", "parent_id", "is_leaf")


@query("taxonomy_path_counts", f"""{WALK_SQL} select id, count(*) as n_paths, cast(max(len(path)) as integer) as longest from walk where id <> 'root' group by id""")
def taxonomy_path_counts(spark, sf_dir):
    return taxonomy.path_counts(*tree(spark, sf_dir), "root").withColumn("n_paths", F.col("n_paths").cast("long"))


@query("taxonomy_stats", f"""{TAGS_SQL} select count(*) as n_tags, count(*) filter (where is_leaf) as n_leaves, count(*) filter (where not is_leaf) as n_branches, cast(coalesce(max(depth), 0) as integer) as max_depth from tags""")
def taxonomy_stats(spark, sf_dir):
    return taxonomy.stats(located(spark, sf_dir))


@query("taxonomy_order", f"""{TAGS_SQL} select id, row_number() over (order by depth, name, id) as place from tags""")
def taxonomy_order(spark, sf_dir):
    from pyspark.sql import Window

    t = landed(located(spark, sf_dir).select("id", "depth", "name"), "tags")  # read twice
    own = Window.partitionBy("depth").orderBy("name", "id")
    sizes = t.groupBy("depth").agg(F.count("*").alias("n"))  # a row for each depth
    before = sizes.select("depth", (F.sum("n").over(Window.orderBy("depth")) - F.col("n")).alias("before"))
    return t.withColumn("k", F.row_number().over(own)).join(F.broadcast(before), "depth").select("id", (F.col("before") + F.col("k")).alias("place"))


@query("root_detect", f"""with recursive {TREE_SQL}, tops as (select id, ord from nodes where id not in (select child_id from edges where parent_id <> 'root')),
down(root, node) as (select id, id from tops union select d.root, e.child_id from down d join edges e on e.parent_id = d.node where e.parent_id <> 'root')
select root, n_nodes from (select d.root, count(distinct node) as n_nodes, min(t.ord) as o from down d join tops t on t.id = d.root group by d.root) order by n_nodes desc, o limit 1""")
def root_detect(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    return taxonomy.root_of(nodes, edges.where("parent_id <> 'root'"))


@query("taxonomy_within", f"""with recursive {TREE_SQL}, down(node) as (select 'r1' union select e.child_id from down d join edges e on e.parent_id = d.node)
select id, name from nodes where id in (select node from down)""")
def taxonomy_within(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    return taxonomy.within(nodes, edges, "r1").select("id", "name")


@query("tag_family", f"""with recursive {TREE_SQL}, down(root, node, depth) as (select id, id, 0 from nodes where id in ('root', 'r2') union select d.root, e.child_id, d.depth + 1 from down d join edges e on e.parent_id = d.node where d.depth < 2)
select root, node, cast(min(depth) as integer) as depth from down group by root, node""")
def tag_family(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    return taxonomy.family(edges, nodes.where("id in ('root', 'r2')").select("id"))


@query("ancestor_closure", f"""with recursive {TREE_SQL}, up(node, ancestor) as (select id, id from nodes where id like 'c%' union select u.node, e.parent_id from up u join edges e on e.child_id = u.ancestor where e.ord = 0)
select node, ancestor from up where node <> ancestor""")
def ancestor_closure(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    return taxonomy.ancestors(edges.where("ord = 0"), nodes.where("id like 'c%'").select("id"))


@query("adjacency_merge", f"""with {TREE_SQL} select parent_id, count(distinct child_id) as n_children from edges group by parent_id""")
def adjacency_merge(spark, sf_dir):
    # each tag tells its first parents, and each parent all its children: most edges are told twice
    nodes, edges = tree(spark, sf_dir)
    other = lambda own, far: edges.groupBy(F.col(own).alias("id")).agg(F.collect_list(F.struct(F.col(far).alias("id"), F.lit("").alias("name"))).alias("told"))
    parents, children = other("child_id", "parent_id").withColumnRenamed("told", "parents"), other("parent_id", "child_id").withColumnRenamed("told", "children")
    tags = nodes.join(parents, "id", "left").join(children, "id", "left").withColumns({"parents": F.slice("parents", 1, 1), "description": F.lit(""), "aliases": F.array().cast("array<string>")})
    return nodes_and_edges(tags)[1].groupBy("parent_id").agg(F.count("*").alias("n_children"))


# Scores: twenty scenes for each event type; an event scores a customer, a nation and a region, some of them too low to open their children.
SCORE_SQL = """scores as (
  select scene, tag_id, max(score) as score from (
    select event_type || user_id % 20 as scene, 'c' || (event_id % (select count(*) from customer) + 1) as tag_id, (event_id * 7919 % 1000) / 1000.0 as score from events
    union all select event_type || user_id % 20, 'n' || (event_id % 25), (event_id * 31 % 900) / 1000.0 from events union all select event_type || user_id % 20, 'r' || (event_id % 5), 0.5 + event_id % 5 * 0.05 from events) group by scene, tag_id)
"""


def scores(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").count()
    i, scene = F.col("event_id"), F.concat("event_type", (F.col("user_id") % 20).cast("string"))
    one = lambda tag, score: F.struct(tag.alias("tag_id"), score.alias("score"))
    named = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    every = e.select(scene.alias("scene"), F.inline(F.array(one(named("c", i % n + 1), i * 7919 % 1000 / 1000), one(named("n", i % 25), i * 31 % 900 / 1000), one(named("r", i % 5), F.lit(0.5) + i % 5 * 0.05))))
    return every.groupBy("scene", "tag_id").agg(F.max("score").alias("score"))


@query("flat_decode", f"""with {SCORE_SQL} select scene, tag_id, score, rank from (select *, row_number() over (partition by scene order by score desc, tag_id) as rank from scores where score >= 0.5) where rank <= 40""")
def flat_decode(spark, sf_dir):
    return decode.flat(scores(spark, sf_dir), "scene", 40, 0.5).withColumn("rank", F.col("rank").cast("long"))


DECODED_SQL = f"""{TAGS_SQL}, {SCORE_SQL}, judged as (
  select s.scene, s.tag_id, s.score, (t.parent_id = '' or coalesce(p.score, 0) >= 0.60) and s.score >= case when t.is_leaf then 0.78 else 0.60 end as direct,
    max(s.score) over f >= 0.78 and max(s.score) over f - s.score <= 0.08 and row_number() over (f order by s.score desc, s.tag_id) <= 2 as wins
  from scores s join tags t on t.id = s.tag_id left join scores p on p.scene = s.scene and p.tag_id = t.parent_id window f as (partition by s.scene, t.parent_id)),
decoded as (select scene, tag_id, score, case when direct then 'direct' else 'competition' end as decode_type from judged where (direct or wins) and score >= 0.3)
"""


def decoded(spark, sf_dir):
    t = first_parents(spark, sf_dir)
    return decode.hierarchical(scores(spark, sf_dir), t, "scene", least=0.3), t


@query("hier_decode", f"""{DECODED_SQL} select d.scene, d.tag_id, t.name as tag_name, t.path_string as path, round(d.score, 4) as score, d.decode_type, row_number() over (partition by d.scene order by d.score desc, d.tag_id) as rank from decoded d join tags t on t.id = d.tag_id""")
def hier_decode(spark, sf_dir):
    return decode.predictions(decoded(spark, sf_dir)[0], located(spark, sf_dir)).select("scene", "tag_id", "tag_name", "path", "score", "decode_type", F.col("rank").cast("long").alias("rank"))


@query("decode_support", f"""{DECODED_SQL}, up(node, ancestor) as (select distinct tag_id, tag_id from decoded union select u.node, t.parent_id from up u join tags t on t.id = u.ancestor where t.parent_id <> '')
select distinct d.scene, u.ancestor as tag_id from decoded d join up u on u.node = d.tag_id where u.ancestor <> u.node and not exists (select 1 from decoded x where x.scene = d.scene and x.tag_id = u.ancestor)""")
def decode_support(spark, sf_dir):
    found, t = decoded(spark, sf_dir)
    return decode.supporting(found, t, "scene")


@query("decode_by_type", f"""{DECODED_SQL} select scene, count(*) filter (where decode_type = 'direct') as n_direct, count(*) filter (where decode_type = 'competition') as n_competition from decoded group by scene""")
def decode_by_type(spark, sf_dir):
    return decode.by_type(decoded(spark, sf_dir)[0], ["scene"])


@query("group_by_ancestor", f"""{TAGS_SQL}, long as (select id, path_string || ' > ' || name || ' > x' as path from tags)
select case when len(string_split(path, ' > ')) > 3 then string_split(path, ' > ')[3] else 'shallow' end as group_name, count(*) as n_tags from long group by 1""")
def group_by_ancestor(spark, sf_dir):
    t = located(spark, sf_dir).select(F.col("id").alias("tag_id"), F.concat_ws(" > ", "path_string", "name", F.lit("x")).alias("path"))
    return decode.by_ancestor(t, []).select("group_name", "n_tags")
