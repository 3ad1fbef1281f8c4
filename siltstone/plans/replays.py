"""Queries on sessions and replays: users of the event table as sessions, claims of line items as recorded verdicts."""

from pyspark.sql import functions as F

from siltstone.operators import decisions as D
from siltstone.operators import sessions as S
from siltstone.plans.registry import query
from siltstone.plans.rules import CLAIMS, ROUTE, _claims


@query("""WITH e AS (SELECT user_id, floor(value / 20)::BIGINT AS unit, event_id AS seq, event_type AS k FROM events),
a AS (SELECT user_id, unit, max(seq) FILTER (k = 'purchase') AS accept_seq, count(*) FILTER (k = 'view') AS attempts, max(seq) FILTER (k = 'error') AS f FROM e GROUP BY ALL),
c AS (SELECT e.user_id, e.unit, max(seq) AS candidate_seq FROM e JOIN a USING (user_id, unit) WHERE k = 'view' AND seq < accept_seq GROUP BY ALL)
SELECT user_id, unit, accept_seq, coalesce(candidate_seq, -1) AS candidate_seq, attempts, coalesce(f < accept_seq, true) AS verified FROM a LEFT JOIN c USING (user_id, unit) WHERE accept_seq IS NOT NULL""")
def session_projection(t):
    e = t("events").withColumn("unit", F.floor(F.col("value") / 20))
    kind = lambda k: F.col("event_type") == k
    return S.projected(e, "user_id", "unit", "event_id", kind("purchase"), kind("view"), kind("error"))


@query(f"""WITH {CLAIMS}, k AS (SELECT l_suppkey, l_partkey, min({ROUTE}) AS recorded, max({ROUTE}) AS replayed FROM v GROUP BY ALL) SELECT * FROM k WHERE recorded <> replayed""")
def replay_mismatches(t):
    routed = _claims(t).withColumn("route", D.route(F.col("origin"), F.col("kind"), F.col("c"), F.col("p"), F.col("ev")))
    keys = ["l_suppkey", "l_partkey"]
    return S.mismatches(routed.groupBy(*keys).agg(F.min("route").alias("route")), routed.groupBy(*keys).agg(F.max("route").alias("route")), keys, "route")


@query("SELECT user_id, event_type || ':' || floor(value)::BIGINT AS hash, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_contents(t):
    return S.repeats(t("events"), ["user_id"], F.concat_ws(":", "event_type", F.floor("value")))


@query("""WITH s AS (SELECT user_id, event_id AS lo, event_id + 40 * (event_id % 3) AS hi FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.lo <= e.event_id + 5 AND s.hi >= e.event_id) THEN 'frontier' WHEN event_type = 'view' THEN 'unchanged' ELSE 'keep' END AS disposition FROM events e""")
def comment_frontier(t):
    rows = t("events").select("event_id", "user_id", "event_type", F.col("event_id").alias("lo"), (F.col("event_id") + 5).alias("hi"))
    spans = t("events").filter("event_type = 'error'").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 40 * (F.col("event_id") % 3)).alias("hi"))
    return S.frontier(rows, spans, "user_id", "lo", "hi", F.when(F.col("event_type") == "view", "unchanged")).select("event_id", "disposition")
