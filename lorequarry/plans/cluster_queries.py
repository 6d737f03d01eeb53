"""Queries on clusters of shards, polysemy and contests, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, contests, polysemy
from . import fixtures as fix
from .queries import query

# --- Clusters: parts as concepts with one or two parents and as a tree of tasks, lines as shards

_PATHS = """c AS (SELECT p_partkey AS id, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0),
t AS (SELECT p_partkey AS id, (p_partkey - 1) // 2 AS parent FROM part WHERE p_partkey > 0),
up AS (SELECT id, parent AS ancestor FROM c UNION SELECT up.id, c.parent FROM up JOIN c ON c.id = up.ancestor),
above AS (SELECT id, parent AS ancestor FROM t UNION SELECT above.id, t.parent FROM above JOIN t ON t.id = above.ancestor)"""

_COVERAGE = f"""WITH RECURSIVE {_PATHS},
s AS (SELECT l_orderkey AS source, l_partkey AS task, l_suppkey AS concept, s_nationkey AS jurisdiction, l_returnflag = 'R' AND l_linenumber = 1 AS authority FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
m AS (SELECT 'subtree' AS axis, task AS k, authority AS a FROM s UNION ALL SELECT 'subtree', ancestor, authority FROM s JOIN above ON id = task
  UNION ALL SELECT 'doctrine', concept, authority FROM s UNION ALL SELECT 'doctrine', ancestor, authority FROM s JOIN up ON id = concept),
k AS (SELECT 'subtree' AS axis, p_partkey AS k, p_partkey NOT IN (SELECT parent FROM t) AS leaf FROM part UNION ALL SELECT 'doctrine', p_partkey, p_partkey NOT IN (SELECT parent FROM c) FROM part),
r AS (SELECT 'source' AS axis, source AS k, true AS leaf, count(*) AS n, count(*) FILTER (authority) AS n_authorities FROM s GROUP BY source
  UNION ALL SELECT 'jurisdiction', jurisdiction, true, count(*), count(*) FILTER (authority) FROM s WHERE jurisdiction IS NOT NULL GROUP BY jurisdiction
  UNION ALL SELECT k.axis, k.k, k.leaf, count(m.k), count(*) FILTER (m.a) FROM k LEFT JOIN m ON m.axis = k.axis AND m.k = k.k GROUP BY ALL)
SELECT axis, CAST(k AS VARCHAR) AS cluster, leaf, n, n_authorities, leaf AND n_authorities = 0 AS gap FROM r"""


def _concepts(spark, sf):
    p = fix.table(spark, sf, "part").where("p_partkey > 0")
    return p.selectExpr("p_partkey AS id", "p_partkey div 2 AS parent").unionByName(p.where("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "p_partkey div 3 AS parent"))


@query("", _COVERAGE)
def cluster_coverage(spark, sf):
    tasks = fix.table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey > 0 THEN (p_partkey - 1) div 2 END AS parent")
    lines, suppliers = fix.table(spark, sf, "lineitem"), fix.table(spark, sf, "supplier")
    shards = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left").selectExpr("l_orderkey AS source", "l_partkey AS task", "l_suppkey AS concept", "s_nationkey AS jurisdiction", "l_returnflag = 'R' AND l_linenumber = 1 AS authority")
    return clusters.coverage(shards, tasks, _concepts(spark, sf))


@query("", f"WITH RECURSIVE {_PATHS} SELECT id, ancestor FROM up")
def concept_closure(spark, sf):
    return clusters.closure(_concepts(spark, sf))


@query("", f"""WITH RECURSIVE {_PATHS}, p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
own AS (SELECT * FROM up UNION SELECT p_partkey, p_partkey FROM part),
shared AS (SELECT a, b, x.ancestor FROM p JOIN own x ON x.id = a JOIN own y ON y.id = b AND y.ancestor = x.ancestor)
SELECT a, b, ancestor FROM shared s WHERE NOT EXISTS (SELECT 1 FROM shared o JOIN up ON up.id = o.ancestor WHERE o.a = s.a AND o.b = s.b AND up.ancestor = s.ancestor)""")
def lowest_shared_concepts(spark, sf):
    """Where the concept of a line and that of its supplier meet."""
    pairs = fix.table(spark, sf, "lineitem").selectExpr("l_partkey AS a", "l_suppkey AS b")
    concepts = _concepts(spark, sf)
    return clusters.lowest_shared(pairs, clusters.closure(concepts), concepts)


# --- Polysemy: what nations say of parts; nations of a region are compatible


def _said(spark, sf):
    lines, suppliers, nations = (fix.table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    n = nations.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(n, "s_nationkey").select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("iri"), F.col("n_name").alias("framework"), F.col("l_returnflag").alias("axiom"))


def _compatible(spark, sf):
    n = fix.table(spark, sf, "nation").select("n_name", "n_regionkey")
    return n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey").select("a", "b")


@query("", """WITH s AS (SELECT l_partkey AS k, n_name AS f, n_regionkey AS r, l_returnflag AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT concat('part/', a.k) AS iri, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT concat(a.f, '|', b.f)) AS BIGINT) AS frameworks FROM s a JOIN s b ON b.k = a.k AND a.f < b.f AND a.r <> b.r AND a.x <> b.x GROUP BY a.k""")
def polysemy_conflicts(spark, sf):
    found = polysemy.conflicts(_said(spark, sf), _compatible(spark, sf))
    return found.groupBy("iri").agg(F.sum("n").cast("long").alias("pairs"), F.count("*").alias("frameworks"))


@query()
def sense_forks(spark, sf):
    return polysemy.forks(_said(spark, sf), _compatible(spark, sf)).withColumn("frameworks", F.array_join("frameworks", "|"))


# --- Contests: events as votes on users

ARBITERS = ("r0", "r1", "r2")


@query("", """WITH e AS (SELECT user_id AS id, ts, event_id AS seq, concat('r', event_id % 11) AS actor, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'contest' WHEN event_type = 'error' THEN 'withdraw'
    WHEN value > 80 THEN 'resolve' WHEN value > 40 THEN 'fork' ELSE 'accept_aporia' END AS action, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN NULL ELSE event_type END AS position FROM events),
f AS (SELECT *, action IN ('resolve', 'fork', 'accept_aporia') AND actor IN ('r0', 'r1', 'r2') AS closes FROM e),
g AS (SELECT *, coalesce(count(*) FILTER (closes) OVER (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS round, count(*) FILTER (closes) OVER (PARTITION BY id) AS rounds FROM f),
v AS (SELECT id, round - rounds AS back, actor, arg_max(action, row(ts, seq)) AS action, arg_max(position, row(ts, seq)) AS position FROM g WHERE action IN ('contest', 'withdraw') GROUP BY ALL),
y AS (SELECT id, back, position, count(*) AS n FROM v WHERE action = 'contest' AND back >= -1 GROUP BY ALL),
z AS (SELECT id, sum(n) FILTER (back = 0) AS o, sum(n) FILTER (back = -1) AS j FROM y GROUP BY id),
w AS (SELECT id, CASE WHEN count(*) = 1 THEN min(position) END AS position FROM (SELECT *, max(n) OVER (PARTITION BY id) AS most FROM y WHERE back = -1) WHERE n = most GROUP BY id),
c AS (SELECT id, action, position FROM g WHERE closes AND round = rounds - 1),
s AS (SELECT i.id, coalesce(z.o, 0) AS o, coalesce(z.j, 0) AS j, c.action, coalesce(c.position, w.position) AS p FROM (SELECT DISTINCT id FROM e) i LEFT JOIN z ON z.id = i.id LEFT JOIN w ON w.id = i.id LEFT JOIN c ON c.id = i.id),
r AS (SELECT *, CASE WHEN o > 0 THEN 'contested' WHEN action IS NULL THEN 'uncontested' WHEN action = 'fork' THEN 'distinguished' WHEN action = 'resolve' AND j >= 2 AND p IS NOT NULL THEN 'resolved' ELSE 'aporetic' END AS status FROM s)
SELECT id, status, CASE WHEN status = 'resolved' THEN p END AS position, CAST(CASE WHEN o > 0 THEN o ELSE j END AS BIGINT) AS votes FROM r""")
def contest_states(spark, sf):
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "click", "purchase"), "contest").when(kind == "error", "withdraw").when(F.col("value") > 80, "resolve").when(F.col("value") > 40, "fork").otherwise("accept_aporia")
    position = F.when(~((kind == "signup") & (F.col("event_id") % 2 == 0)), kind)
    events = fix.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("r"), (F.col("event_id") % 11).cast("string")).alias("actor"), action.alias("action"), position.alias("position"))
    return contests.states(events, ARBITERS, 2)
