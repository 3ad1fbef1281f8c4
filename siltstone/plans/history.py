"""Queries on ordered histories: parts as symbols, orders as commits, the order's key as its position."""

from pyspark.sql import functions as F

from siltstone.functions.stats import running
from siltstone.operators import lineage as L
from siltstone.plans.registry import query

DEP = """
li AS (SELECT l_partkey AS name, l_orderkey AS oid, l_orderkey AS pos, l_linenumber AS kind FROM lineitem),
d AS (SELECT name, min(pos) AS definer FROM li WHERE kind = 1 GROUP BY name),
dep AS (SELECT DISTINCT li.name, d.definer, li.oid AS user FROM li JOIN d USING (name) WHERE kind > 1 AND d.definer < li.pos)"""


def _deps(t):
    li = t("lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("oid"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("kind"))
    return L.dependencies(li.filter("kind = 1"), li.filter("kind > 1"))


@query(f"WITH {DEP} SELECT * FROM dep")
def dependency_edges(t):
    return _deps(t)


@query(f"""WITH {DEP} SELECT name, definer, user FROM dep WHERE name NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
AND name NOT IN (SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_retailprice > 2000))""")
def broken_dependencies(t):
    part = t("part")
    final = part.filter("p_size > 5").select(F.col("p_partkey").alias("name"))
    alive = part.join(part.filter("p_retailprice > 2000").select("p_brand").distinct(), "p_brand", "left_semi").select(F.col("p_partkey").alias("name"))
    return L.broken(_deps(t), final, alive)


@query("""SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS n_commits, min(l_orderkey) AS first, max(l_orderkey) AS last, count(*) FILTER (l_returnflag = 'R') AS n_escalated,
CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'manual' WHEN count(DISTINCT l_orderkey) >= 4 THEN 'holistic' WHEN count(DISTINCT l_orderkey) >= 3 THEN 'squash' ELSE 'default' END AS advice
FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2""")
def conflict_chains(t):
    return L.chains(t("lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey", F.col("l_returnflag") == "R")


@query("""WITH s AS (SELECT l_partkey AS name, max(struct_pack(p := l_orderkey, b := l_quantity)) AS m FROM lineitem GROUP BY 1)
SELECT name, m.b AS step_body, p_size::DOUBLE AS final_body FROM s JOIN part ON p_partkey = name WHERE m.b <> p_size""")
def evolution_gaps(t):
    steps = t("lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("pos"), F.col("l_quantity").alias("body"))
    return L.last_change(steps, t("part").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("double").alias("body")))


@query("""SELECT name, count(*) AS n_steps, string_agg(step, '>' ORDER BY pos) AS path FROM (SELECT l_partkey AS name, l_orderkey AS pos, max(l_returnflag) AS step FROM lineitem GROUP BY ALL) GROUP BY name HAVING count(*) >= 2""")
def evolution_chains(t):
    steps = t("lineitem").groupBy(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("pos")).agg(F.max("l_returnflag").alias("step"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda s: s["step"]), ">")
    return steps.groupBy("name").agg(F.count(F.lit(1)).alias("n_steps"), path.alias("path")).filter("n_steps >= 2")


@query("""WITH m AS (SELECT l_suppkey AS file, l_partkey AS name, max(struct_pack(p := l_orderkey, gone := (l_returnflag = 'R')::INT)) AS last, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT file, count(*) FILTER (last.gone = 0) AS n_added, count(*) FILTER (last.gone = 1) AS n_removed, sum(n)::BIGINT AS n_touches FROM m GROUP BY file""")
def branch_intent(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("pos"), "l_returnflag")
    return L.net_intent(rows, "file", "name", "pos", F.col("l_returnflag") == "R")


SPANS = """
a AS (SELECT event_id AS a_id, user_id, event_id AS a_lo, event_id + 40 AS a_hi FROM events WHERE event_type = 'purchase'),
b AS (SELECT event_id AS b_id, user_id, event_id - 25 AS b_lo, event_id AS b_hi FROM events WHERE event_type = 'error')"""


@query(f"WITH {SPANS} SELECT user_id, a_id, b_id FROM a JOIN b USING (user_id) WHERE a_lo <= b_hi AND a_hi >= b_lo")
def overlapping_spans(t):
    e = t("events")
    a = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), F.col("event_id").alias("a_lo"), (F.col("event_id") + 40).alias("a_hi"))
    b = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("b_id"), (F.col("event_id") - 25).alias("b_lo"), F.col("event_id").alias("b_hi"))
    return L.overlaps(a, b, ["user_id"], 64).select("user_id", "a_id", "b_id")


@query("""SELECT l.event_id, l.user_id, r.event_id::DOUBLE AS near, r.value AS near_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.event_id >= r.event_id""")
def nearest_before(t):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id")
    return L.as_of(left, e.filter("event_type = 'view'"), ["user_id"], "event_id", "value").select("event_id", "user_id", F.col("near").cast("double").alias("near"), "near_value")


@query("""SELECT l.event_id, l.user_id, r.event_id::DOUBLE AS near, r.value AS near_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.event_id <= r.event_id""")
def nearest_after(t):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id")
    return L.as_of(left, e.filter("event_type = 'view'"), ["user_id"], "event_id", "value", forward=True).select("event_id", "user_id", F.col("near").cast("double").alias("near"), "near_value")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE - DATE '2024-01-01' AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
SELECT user_id, min(day)::INT AS start, max(day)::INT AS end, count(*) AS n FROM g GROUP BY user_id, g""")
def runs_of_days(t):
    days = t("events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    return L.islands(days, ["user_id"], "day")


@query("""SELECT o_orderkey, o_custkey, count(*) OVER w - 1 AS n_before, count(*) OVER (PARTITION BY o_custkey) - count(*) OVER w AS n_after FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def commits_around(t):
    rows = running(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], {"n": F.lit(1)})
    return rows.select("o_orderkey", "o_custkey", (F.col("n") - 1).alias("n_before"), (F.col("n_all") - F.col("n")).alias("n_after"))


@query("""WITH f AS (SELECT o_orderkey, o_custkey AS path, o_orderstatus AS shape, o_orderpriority AS kind FROM orders)
SELECT a.c_custkey AS path, min(f.o_orderkey) AS reused FROM customer a JOIN f ON f.path = a.c_custkey WHERE (a.c_mktsegment = 'BUILDING' OR f.shape = 'F') AND (a.c_acctbal < 0 OR f.kind LIKE '1%') GROUP BY ALL""")
def exact_reuse(t):
    """First stored row with the same key; an empty key on one side matches anything."""
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("shape"), F.col("o_orderpriority").alias("kind"))
    asked = t("customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("F").alias("want_shape"), F.when(F.col("c_acctbal") < 0, "").otherwise("1").alias("want_kind"))
    fits = ((F.col("want_shape") == "") | (F.col("want_shape") == F.col("shape"))) & ((F.col("want_kind") == "") | F.col("kind").startswith("1"))
    return asked.join(o, "c_custkey").filter(fits).groupBy(F.col("c_custkey").alias("path")).agg(F.min("o_orderkey").alias("reused"))


@query("""WITH o AS (SELECT l_partkey AS name, l_orderkey AS pos, l_linenumber AS kind FROM lineitem),
d AS (SELECT kind, name, min(pos) AS first_pos FROM o WHERE kind <= 2 GROUP BY ALL)
SELECT d.kind, d.name, d.first_pos, min(o.pos) AS needed_by FROM d JOIN o ON o.name = d.name AND o.pos > d.first_pos AND o.kind > 2 GROUP BY ALL""")
def future_obligations(t):
    o = t("lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("kind"))
    d = o.filter("kind <= 2").groupBy("kind", "name").agg(F.min("pos").alias("first_pos"))
    # from the last position to the first, with what is asked just ahead of its own: the nearest use so far is the next one
    asked = d.select("name", "kind", "first_pos", (-F.col("first_pos") - 0.5).alias("at"), F.lit(None).cast("long").alias("near"))
    later = o.filter("kind > 2").select("name", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("first_pos"), (-F.col("pos")).cast("double").alias("at"), (-F.col("pos")).alias("near"))
    rows = running(asked.unionByName(later), ["name"], ["at"], {"next": F.col("near")}, largest=True)
    return rows.filter("kind IS NOT NULL AND next IS NOT NULL").select("kind", "name", "first_pos", (-F.col("next")).alias("needed_by"))
