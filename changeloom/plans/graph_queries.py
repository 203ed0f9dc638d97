"""Traversals of the part graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.operators import graph, relational
from changeloom.plans.registry import query, table
from changeloom.plans.standins import EDGES_SQL, edges, longs, owners


@query(f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.id) SELECT id FROM r")
def reach_dependents(spark, sf_dir):
    seeds = spark.range(1, 2)
    return graph.reach(edges(spark, sf_dir), seeds, reverse=True).select("id")


@query(f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS origin, p_partkey AS id, 0 AS hops FROM part WHERE p_size = 50 UNION SELECT r.origin, e.dst, r.hops + 1 FROM r JOIN edges e ON e.src = r.id WHERE r.hops < 8) SELECT origin, id, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY 1, 2")
def reach_bounded_hops(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("id"))
    return longs(graph.reach(edges(spark, sf_dir), seeds, max_hops=8, keyed=True), "hops").select("origin", "id", "hops")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS src, p_partkey AS id, 0 AS hops FROM part WHERE p_size = 1 UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN edges e ON e.src = r.id WHERE r.hops < 12)
SELECT src, id AS dst, CAST(min(hops) AS BIGINT) AS hops FROM r JOIN part ON p_partkey = id AND p_size = 2 GROUP BY 1, 2
""")
def shortest_path_len(spark, sf_dir):
    parts, e = table(spark, sf_dir, "part"), edges(spark, sf_dir)
    seeds = parts.where("p_size = 1").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("id"))
    found = graph.reach(e, seeds, max_hops=12, keyed=True)
    ends = parts.where("p_size = 2").select(F.col("p_partkey").alias("id"))
    return longs(found.join(ends, "id").select(F.col("origin").alias("src"), F.col("id").alias("dst"), "hops"), "hops")


#: Pairs of nodes of which the first reaches the second by an edge or more.
CLOSURE_SQL = "closure AS (SELECT src AS a, dst AS b FROM {0} UNION SELECT c.a, e.dst FROM closure c JOIN {0} e ON e.src = c.b)"


@query(f"""
WITH RECURSIVE {EDGES_SQL}, {CLOSURE_SQL.format("edges")}
SELECT x.a AS id, min(x.b) AS "group" FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a GROUP BY x.a
""")
def import_cycles(spark, sf_dir):
    return graph.cycle_groups(edges(spark, sf_dir))


@query(f"""
WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS id FROM part WHERE p_size = 50 UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.id JOIN part p ON p.p_partkey = r.id WHERE p.p_brand <> 'Brand#11' AND p.p_size <> 10) SELECT id FROM r
""")
def closure_with_barrier(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    barrier = parts.where("p_brand = 'Brand#11' OR p_size = 10").select(F.col("p_partkey").alias("id"))
    seeds = parts.where("p_size = 50").select(F.col("p_partkey").alias("id"))
    return graph.reach(edges(spark, sf_dir), seeds, barrier=barrier).select("id")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, up AS (SELECT src, dst FROM edges WHERE src < dst OR src % 7 = 0), {CLOSURE_SQL.format("up")},
behind AS (SELECT a AS id FROM closure WHERE a = b UNION SELECT c.b FROM closure c JOIN closure d ON d.a = c.a AND d.b = c.a),
l AS (SELECT p_partkey AS id, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT id FROM behind) UNION SELECT u.dst, l.level + 1 FROM l JOIN up u ON u.src = l.id WHERE u.dst NOT IN (SELECT id FROM behind))
SELECT id, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY id UNION ALL SELECT id, NULL FROM behind
""")
def topo_levels(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return longs(graph.topo_levels(edges(spark, sf_dir).where("src < dst OR src % 7 = 0"), nodes), "level")


@query(f"""
WITH {EDGES_SQL}, d AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id)
SELECT id, fan_in, fan_out FROM d
""")
def node_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem), d AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id),
t AS (SELECT CAST(greatest(6, ceil(count(*) * 0.1)) AS BIGINT) AS threshold FROM d)
SELECT id, fan_in, fan_out, threshold FROM d, t WHERE fan_in >= threshold OR fan_out >= threshold
""")
def hub_degree(spark, sf_dir):
    e = relational.dealt(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")), "src", "dst").distinct()
    return longs(graph.hubs(e, share=0.1), "threshold")


@query(f"WITH {EDGES_SQL} SELECT src AS id, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges")
def component_neighbours(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir))


@query(f"""
WITH {EDGES_SQL} SELECT owner, id, fan_in, rank FROM (SELECT p_brand AS owner, dst AS id, count(*) AS fan_in, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, dst) AS rank FROM edges JOIN part ON dst = p_partkey GROUP BY 1, 2) WHERE rank <= 3
""")
def key_files(spark, sf_dir):
    return longs(graph.key_nodes(edges(spark, sf_dir), owners(spark, sf_dir)), "rank").select("owner", "id", "fan_in", "rank")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 1 AND 5 UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.id) SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM r)
""")
def untested_sources(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return parts.select("id").join(graph.reach(edges(spark, sf_dir), parts.where("p_size BETWEEN 1 AND 5").select("id")), "id", "left_anti")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, base AS (SELECT src, dst FROM edges WHERE src % 5 <> 0), added AS (SELECT src, dst FROM edges WHERE src % 5 = 0),
{CLOSURE_SQL.format("base")}, back AS (SELECT dst AS origin, dst AS id FROM added UNION SELECT b.origin, e.dst FROM back b JOIN edges e ON e.src = b.id),
near AS (SELECT dst AS origin, dst AS id, 0 AS hops FROM added UNION SELECT b.origin, e.dst, b.hops + 1 FROM near b JOIN edges e ON e.src = b.id WHERE b.hops < 12),
fresh AS (SELECT a.src, a.dst FROM added a JOIN back b ON b.origin = a.dst AND b.id = a.src WHERE NOT (EXISTS (SELECT 1 FROM closure c WHERE c.a = a.src AND c.b = a.dst) AND EXISTS (SELECT 1 FROM closure c WHERE c.a = a.dst AND c.b = a.src)))
SELECT f.src, f.dst, CAST(min(n.hops) + 1 AS BIGINT) AS length FROM fresh f LEFT JOIN near n ON n.origin = f.dst AND n.id = f.src GROUP BY 1, 2
""")
def new_cycles(spark, sf_dir):
    e = cut(edges(spark, sf_dir), "edges")
    return longs(graph.new_cycles(e.where("src % 5 <> 0"), e), "length")


@query("""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+(/[^/?#]+)?)', 1) AS folder, count(*) AS pages FROM pages GROUP BY 1
""")
def folder_clusters(spark, sf_dir):
    parts = F.split(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/+")
    folder = F.array_join(F.slice(F.filter(parts, lambda s: s != ""), 1, 2), "/")
    return table(spark, sf_dir, "pages").groupBy(folder.alias("folder")).agg(F.count("*").alias("pages"))


@query("""
SELECT l_partkey AS src, l_suppkey AS dst, CAST(sum(greatest(1, n)) AS BIGINT) AS weight FROM (
    SELECT l_partkey, l_suppkey, l_orderkey, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def edge_weights(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("lines"))
    return longs(graph.edge_weights(uses), "weight")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS origin, p_partkey AS id, 0 AS hops FROM part WHERE p_size = 50 UNION SELECT r.origin, e.dst, r.hops + 1 FROM r JOIN edges e ON e.src = r.id WHERE r.hops < 6),
best AS (SELECT origin, id, min(hops) AS hops FROM r GROUP BY 1, 2)
SELECT b.origin, b.id, CAST(b.hops AS BIGINT) AS hops, min(p.id) AS via FROM best b LEFT JOIN edges e ON e.dst = b.id AND b.hops > 0
LEFT JOIN best p ON p.origin = b.origin AND p.id = e.src AND p.hops = b.hops - 1 GROUP BY 1, 2, 3
""")
def reach_via(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("id"))
    return longs(graph.reach(edges(spark, sf_dir), seeds, max_hops=6, keyed=True, via=True), "hops").select("origin", "id", "hops", "via")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, tests AS (SELECT p_partkey AS id FROM part WHERE p_size <= 3), support AS (SELECT p_partkey AS id FROM part WHERE p_size = 4),
r AS (SELECT id AS origin, id, 0 AS hops FROM tests UNION SELECT r.origin, e.dst, r.hops + 1 FROM r JOIN edges e ON e.src = r.id WHERE e.dst NOT IN (SELECT id FROM tests) AND r.hops < 60),
best AS (SELECT origin, id, min(hops) AS hops FROM r WHERE hops > 0 AND id NOT IN (SELECT id FROM support) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops, origin) AS n FROM best)
SELECT id, count(*) AS n_tests, CAST(min(hops) AS BIGINT) AS min_hops, array_to_string(list(origin ORDER BY n) FILTER (WHERE n <= 5), ',') AS tests FROM ranked GROUP BY id
""")
def test_reach(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    found = graph.reach_of_tests(edges(spark, sf_dir), parts.where("p_size <= 3").select("id"), parts.where("p_size = 4").select("id"), parts.where("p_size > 4").select("id"), first=5)
    return longs(found.withColumn("tests", F.array_join(F.transform("tests", lambda x: x.cast("string")), ",")), "min_hops")


@query(f"""
WITH {EDGES_SQL}, e AS (SELECT a.p_brand AS src_owner, b.p_brand AS dst_owner, src, dst, weight, row_number() OVER (PARTITION BY a.p_brand, b.p_brand ORDER BY weight DESC, src, dst) AS n
    FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand)
SELECT src_owner, dst_owner, CAST(sum(weight) AS BIGINT) AS weight, string_agg(src || '>' || dst, ',' ORDER BY n) FILTER (WHERE n <= 3) AS samples FROM e GROUP BY 1, 2
""")
def card_edges(spark, sf_dir):
    return longs(graph.card_edges(edges(spark, sf_dir), owners(spark, sf_dir)).withColumn("samples", F.array_join("samples", ",")), "weight")


CHAIN_SQL = "SELECT CAST(o_custkey AS STRING) AS chain, CAST(o_orderkey AS STRING) AS id, CAST(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 3 WHEN o_orderkey % 17 = 0 THEN -1 ELSE (SELECT max(b.o_orderkey) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey) END AS STRING) AS dep FROM orders a WHERE o_custkey < 400"


def _chains(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_custkey < 400")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    dep = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") + 3).when(F.col("o_orderkey") % 17 == 0, -1).otherwise(before)
    found = rows.select(F.col("o_custkey").cast("string").alias("chain"), F.col("o_orderkey").cast("string").alias("id"), dep.cast("string").alias("dep"))
    return found.select("chain", "id"), found.where("dep IS NOT NULL")


@query(f"""
WITH RECURSIVE c AS ({CHAIN_SQL}), ids AS (SELECT chain, id FROM c), deps AS (SELECT c.* FROM c WHERE (chain, dep) IN (SELECT chain, id FROM ids)),
up AS (SELECT chain, id, dep FROM deps UNION SELECT u.chain, u.id, d.dep FROM up u JOIN deps d ON d.chain = u.chain AND d.id = u.dep),
stuck AS (SELECT chain, id FROM up WHERE id = dep UNION SELECT u.chain, u.id FROM up u JOIN up v ON v.chain = u.chain AND v.id = u.dep AND v.dep = u.dep)
SELECT i.chain, i.id, (s.id IS NOT NULL) AS stuck FROM ids i LEFT JOIN stuck s ON s.chain = i.chain AND s.id = i.id
""")
def chain_order(spark, sf_dir):
    found = graph.chain_order(*_chains(spark, sf_dir))
    return found.select("chain", "id", F.col("position").isNull().alias("stuck"))


@query(f"""
WITH c AS ({CHAIN_SQL}), deps AS (SELECT * FROM c WHERE dep IS NOT NULL),
heads AS (SELECT chain, id FROM c WHERE (chain, id) NOT IN (SELECT chain, dep FROM deps)), roots AS (SELECT chain, id FROM c WHERE dep IS NULL)
SELECT chain, 'missing-parent' AS problem, id FROM deps WHERE (chain, dep) NOT IN (SELECT chain, id FROM c)
UNION ALL SELECT chain, 'several-heads', id FROM heads WHERE chain IN (SELECT chain FROM heads GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT chain, 'several-roots', id FROM roots WHERE chain IN (SELECT chain FROM roots GROUP BY 1 HAVING count(*) > 1)
""")
def chain_problems(spark, sf_dir):
    return graph.chain_problems(*_chains(spark, sf_dir))
