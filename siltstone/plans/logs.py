"""Queries on event journals."""

from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.sources import histories as H
from siltstone.sources.scratch import scratch
from siltstone.streaming import journal as J
from siltstone.streaming import state as S


@query("""WITH s AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
SELECT user_id, step, count(*) FILTER (event_type = 'view') AS n_views, count(*) FILTER (event_type = 'purchase') AS n_accepted, count(*) FILTER (event_type = 'error') AS n_escalated FROM s WHERE step > 0 GROUP BY ALL""")
def journal_steps(t):
    kind = lambda k: F.col("event_type") == k
    return J.by_step(t("events"), "user_id", "event_id", kind("signup"), {"n_views": kind("view"), "n_accepted": kind("purchase"), "n_escalated": kind("error")})


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.windowed(e, "ts", "6 hours", None, ["event_type"], "value").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * k AS s FROM events, (SELECT unnest([0, 1]) AS k))
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.windowed(e, "ts", "12 hours", "6 hours", ["event_type"], "value").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOUR, true)::INT AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.sessions_of(e, "user_id", "ts", "4 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT user_id, count(*) AS n, sum((json_extract(props, '$.k')::INT) % 3) FILTER (event_type <> 'view')::BIGINT AS n_regressed, max(event_id) AS last_commit FROM events GROUP BY 1""")
def drift_totals(t):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("event_type") != "view", k)), F.lit(0)).alias("n_regressed"), F.max("event_id").alias("last_commit"))


@query("""SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20""")
def first_advisories(t):
    return t("events").filter("event_type = 'error'").orderBy("event_id").limit(20).select("event_id", "event_type", "user_id")


@query("""SELECT user_id, max(value) AS best, count(*) AS n FROM events GROUP BY 1""")
def best_per_user(t):
    return J.best_so_far(t("events"), ["user_id"], "value", "event_id").select("user_id", "best", "n")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'reading' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'escalated' ELSE event_type END AS status FROM events""")
def event_status(t):
    names = F.create_map(*[F.lit(x) for kv in {"view": "reading", "purchase": "accepted", "error": "escalated"}.items() for x in kv])
    return t("events").select("event_id", F.coalesce(names[F.col("event_type")], F.col("event_type")).alias("status"))


CHANGES = "c AS (SELECT user_id AS history, event_id AS place, event_type AS path, CASE WHEN event_id % 5 = 0 THEN '' ELSE (floor(value / 10)::INT)::VARCHAR END AS blob FROM events)"


def _recorded(t):
    """Events as the changes of a user's files, recorded and read back."""
    blob = F.when(F.col("event_id") % 5 != 0, F.floor(F.col("value") / 10).cast("int").cast("string"))
    root = scratch(t.spark, "histories")
    H.record(t("events").select(F.col("user_id").cast("string").alias("history"), F.col("event_id").cast("long").alias("place"), F.col("event_type").alias("path"), blob.alias("blob")), root)
    return H.recorded(t.spark, root)


@query(f"""WITH {CHANGES}, p AS (SELECT DISTINCT history, place AS old, place + 400 AS new FROM c WHERE place % 7 = 0),
s AS (SELECT p.history, old, new, path, coalesce(arg_max(blob, place) FILTER (place <= old), '') AS a, arg_max(blob, place) AS b, max(place) AS last FROM p JOIN c ON p.history = c.history AND place <= new GROUP BY ALL)
SELECT history::VARCHAR AS history, old, new, path, CASE WHEN a = '' THEN 'added' WHEN b = '' THEN 'deleted' ELSE 'modified' END AS change FROM s WHERE last > old AND a <> b""")
def changed_paths(t):
    """What differs between two places of recorded histories."""
    rows = _recorded(t)
    return H.changed_paths(rows, rows.filter("place % 7 = 0").select("history", F.col("place").alias("old"), (F.col("place") + 400).alias("new")))


@query(f"""WITH {CHANGES}, a AS (SELECT DISTINCT c.history, c.place + 3 AS place, k.path FROM c, (SELECT DISTINCT path FROM c) k WHERE c.place % 3 = 0),
s AS (SELECT a.history, a.place, a.path, arg_max(blob, c.place) AS b FROM a LEFT JOIN c ON a.history = c.history AND a.path = c.path AND c.place <= a.place GROUP BY ALL)
SELECT history::VARCHAR AS history, place, path, nullif(b, '') AS blob, CASE WHEN b <> '' THEN sha1(b) END AS digest FROM s""")
def blobs_at(t):
    """The content of every path at places of recorded histories."""
    rows = _recorded(t)
    asked = rows.filter("place % 3 = 0").select("history", (F.col("place") + 3).alias("place")).distinct()
    kinds = [r["path"] for r in rows.select("path").distinct().collect()]  # the few types of events
    return H.blobs_at(rows, asked.select("*", F.explode(F.array(*map(F.lit, kinds))).alias("path")))


@query("SELECT user_id::VARCHAR AS session, event_type AS item, count(*) AS n FROM events GROUP BY ALL")
def carried_counts(t):
    """Items counted over two passes of a stream, stopped and started again between them; the state is carried over."""
    root, sink, checkpoint = (scratch(t.spark, n) for n in ("passes", "carried", "stream"))
    rows = t("events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("item"), (F.col("event_id") % 3).alias("third"))
    for part in (rows.filter("third = 0"), rows.filter("third <> 0")):
        part.select("session", "item").write.mode("append").parquet(root)
        stream = t.spark.readStream.schema("session string, item string").parquet(root)
        S.pass_over(t.spark, S.carried(stream, "session", "item"), sink, checkpoint)
    return t.spark.read.schema(S.COUNTS).parquet(sink).groupBy("session", "item").agg(F.max("n").alias("n"))
