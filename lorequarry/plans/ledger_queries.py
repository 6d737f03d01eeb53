"""Queries on shapes and edit logs, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import edits, shapes
from ..streaming import hypotheses
from . import fixtures as fix
from .queries import query

_DOUBLE = "http://www.w3.org/2001/XMLSchema#double"
_STRING = "http://www.w3.org/2001/XMLSchema#string"

#: Each of the seven kinds of rules, one of them conditional and one inverse.
CONSTRAINTS = (
    shapes.Constraint("order", "Order", "status", least=1, one_of=("O", "F")),
    shapes.Constraint("order", "Order", "customer", least=1, most=1, node_kind="iri", value_class="Customer"),
    shapes.Constraint("order", "Order", "priority", pattern="^[1-3]-"),
    shapes.Constraint("order", "Order", "total", datatype=_DOUBLE),
    shapes.Constraint("closed", "Order", "closed", least=1, when_path="status", when_value="F"),
    shapes.Constraint("customer", "Customer", "customer", inverse=True, least=1),
)


def _order_triples(spark, sf):
    """Orders and customers as a graph: some orders have no customer, or two, or a nation in its place."""
    o, c, n = (fix.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    named = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    iri = lambda p, v: F.struct(F.lit(p).alias("p"), v.alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"))
    text = lambda p, v, kind=None: F.struct(F.lit(p).alias("p"), v.cast("string").alias("o"), F.lit("literal").alias("kind"), (F.lit(_STRING) if kind is None else kind).alias("datatype"))
    customer = F.when(key % 83 == 0, named("nation/", F.col("o_custkey") % 25)).otherwise(named("customer/", F.col("o_custkey")))
    of_order = [
        iri(shapes.TYPE, F.lit("Order")), text("status", F.col("o_orderstatus")), text("priority", F.col("o_orderpriority")),
        text("total", F.col("o_totalprice"), F.when(key % 101 == 0, _STRING).otherwise(_DOUBLE)), F.when(key % 89 != 0, iri("customer", customer)),
        F.when(key % 97 == 0, iri("customer", named("customer/", F.col("o_custkey") + 1))), F.when(key % 71 != 0, text("closed", F.col("o_orderdate"))),
    ]
    orders = o.select(named("order/", key).alias("s"), F.explode(F.array_compact(F.array(*of_order))).alias("t")).select("s", "t.*")
    customers = c.select(named("customer/", F.col("c_custkey")).alias("s"), iri(shapes.TYPE, F.lit("Customer")).alias("t")).select("s", "t.*")
    nations = n.select(named("nation/", F.col("n_nationkey")).alias("s"), iri(shapes.TYPE, F.lit("Nation")).alias("t")).select("s", "t.*")
    return orders.unionByName(customers).unionByName(nations)


_SHAPES = """WITH x AS (SELECT o_orderkey AS k, concat('order/', o_orderkey) AS s, o_orderstatus AS st, o_orderpriority AS pr,
    list_distinct(list_filter([CASE WHEN o_orderkey % 89 <> 0 THEN CASE WHEN o_orderkey % 83 = 0 THEN concat('nation/', o_custkey % 25) ELSE concat('customer/', o_custkey) END END, CASE WHEN o_orderkey % 97 = 0 THEN concat('customer/', o_custkey + 1) END], lambda v: v IS NOT NULL)) AS cs FROM orders),
c AS (SELECT concat('customer/', c_custkey) AS s FROM customer),
v AS (SELECT s, unnest(cs) AS v FROM x)
SELECT 'order' AS shape, 'status' AS path, 'one_of' AS rule, s, CAST(1 AS BIGINT) AS n FROM x WHERE st NOT IN ('O', 'F')
UNION ALL SELECT 'order', 'customer', 'least', s, 0 FROM x WHERE len(cs) < 1
UNION ALL SELECT 'order', 'customer', 'most', s, len(cs) FROM x WHERE len(cs) > 1
UNION ALL SELECT 'order', 'customer', 'value_class', s, count(*) FROM v WHERE v NOT IN (SELECT s FROM c) GROUP BY s
UNION ALL SELECT 'order', 'priority', 'pattern', s, 1 FROM x WHERE NOT regexp_matches(pr, '^[1-3]-')
UNION ALL SELECT 'order', 'total', 'datatype', s, 1 FROM x WHERE k % 101 = 0
UNION ALL SELECT 'closed', 'closed', 'least', s, 0 FROM x WHERE k % 71 = 0 AND st = 'F'
UNION ALL SELECT 'customer', 'customer', 'least', s, 0 FROM c WHERE s NOT IN (SELECT v FROM v)"""


@query("", _SHAPES)
def shape_violations(spark, sf):
    return shapes.violations(_order_triples(spark, sf), CONSTRAINTS)


_EDITS = """e AS (SELECT user_id AS id, event_type AS field, event_id AS seq, ts AS tm, CAST(value AS VARCHAR) AS new_value,
  CASE WHEN event_id % 1000 = 7 THEN 'tampered' ELSE CAST(lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS VARCHAR) END AS old_value FROM events)"""


def _edits(spark, sf):
    """Events as edits of a user's fields; a few say that something else had been there."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    old = F.when(F.col("event_id") % 1000 == 7, F.lit("tampered")).otherwise(F.lag("value").over(w).cast("string"))
    return fix.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("field"), old.alias("old_value"), F.col("value").cast("string").alias("new_value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def _current(log):
    return log.groupBy("id", "field").agg(F.max_by("new_value", F.struct("at", "seq")).alias("value"))


# what a forward replay gives, but where the first edit undone was tampered with
@query("", f"""WITH {_EDITS}, k AS (SELECT DISTINCT id, field FROM e),
b AS (SELECT id, field, arg_max(CAST(new_value AS DOUBLE), row(tm, seq)) AS v FROM e WHERE tm <= TIMESTAMP '2024-01-16 00:00:00' GROUP BY ALL),
a AS (SELECT id, field, arg_min(seq, row(tm, seq)) AS seq FROM e WHERE tm > TIMESTAMP '2024-01-16 00:00:00' GROUP BY ALL)
SELECT k.id, k.field, CASE WHEN a.seq % 1000 = 7 THEN NULL ELSE round(b.v, 6) END AS value, coalesce(a.seq % 1000 = 7, false) AS tampered FROM k LEFT JOIN b ON b.id = k.id AND b.field = k.field LEFT JOIN a ON a.id = k.id AND a.field = k.field""")
def edits_as_of(spark, sf):
    """The state in the middle of the month, by undoing later edits; the twin replays from the beginning."""
    log = _edits(spark, sf)
    state = edits.state_before(_current(log), log, F.lit("2024-01-16 00:00:00").cast("timestamp"))
    return state.select("id", "field", F.round(F.expr("try_cast(value as double)"), 6).alias("value"), F.coalesce(F.col("value") == "tampered", F.lit(False)).alias("tampered"))


@query("", f"WITH {_EDITS} SELECT id, field, seq, 'gap' AS problem FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY tm, seq) AS r FROM e) WHERE seq % 1000 = 7 AND r > 1 UNION ALL SELECT id, field, seq, 'immutable' FROM e WHERE field = 'signup'")
def broken_edits(spark, sf):
    log = _edits(spark, sf)
    return edits.broken_links(_current(log), log, ["signup"]).select("id", "field", "seq", "problem")


# an event a step, from each user's first on
@query("", """WITH RECURSIVE e AS (SELECT user_id AS id, ts AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'demote' ELSE 'propose' END AS act,
  ts + to_days(CAST(CASE WHEN event_id % 50 = 0 THEN 90 ELSE 1 + event_id % 4 END AS INTEGER)) AS until FROM events WHERE event_type NOT IN ('purchase', 'error') OR (event_id % 4 <> 0 AND event_id % 5 <> 0)),
r AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, CAST('expired' AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS deadline, CAST(NULL AS TIMESTAMP) AS tm, CAST(NULL AS TIMESTAMP) AS gone, false AS fired FROM e
UNION ALL SELECT id, n, CASE WHEN NOT fired THEN was WHEN act = 'promote' THEN 'attested' ELSE 'hypothesis' END, CASE WHEN NOT fired THEN deadline WHEN act <> 'promote' THEN until END, tm, gone, fired
  FROM (SELECT *, (act = 'propose' AND was = 'expired') OR (act = 'promote' AND was = 'hypothesis') OR (act = 'demote' AND was = 'attested') AS fired
    FROM (SELECT e.*, CASE WHEN r.deadline <= e.tm THEN 'expired' ELSE r.status END AS was, CASE WHEN r.deadline <= e.tm THEN r.deadline END AS gone, CASE WHEN r.deadline > e.tm THEN r.deadline END AS deadline FROM r JOIN e ON e.id = r.id AND e.n = r.n + 1) x) y),
c AS (SELECT id, tm AS t, status, deadline FROM r WHERE fired UNION ALL SELECT id, gone, 'expired', NULL FROM r WHERE gone IS NOT NULL
UNION ALL SELECT id, deadline, 'expired', NULL FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS k FROM r) z WHERE k = 1 AND deadline IS NOT NULL)
SELECT id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS since, status, strftime(deadline, '%Y-%m-%d %H:%M:%S.%f') AS deadline FROM c""")
def hypothesis_changes(spark, sf):
    """Events as a log of hypotheses, one a user: purchases promote, errors demote, all others propose."""
    e, k = fix.table(spark, sf, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "purchase", "promote").when(F.col("event_type") == "error", "demote").otherwise("propose")
    role = F.when(k % 4 == 0, "extractor").otherwise("reviewer")
    log = e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), k.alias("seq"), action.alias("action"), role.alias("role"), F.when(k % 5 != 0, k.cast("string")).alias("citation"), F.when(k % 50 != 0, 1 + k % 4).alias("ttl_days"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return hypotheses.changes(log).select("id", shown("at").alias("since"), "status", shown("deadline").alias("deadline"))
