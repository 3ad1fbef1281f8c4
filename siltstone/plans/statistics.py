"""Queries on distributions, fits and designed experiments."""

from pyspark.sql import functions as F

from siltstone.functions import stats as S
from siltstone.operators import calibration as C
from siltstone.operators import design as D
from siltstone.plans.registry import query
from siltstone.sources.scratch import scratch


def _r(df, n=6, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("""WITH b AS (SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean, median(value) AS mid FROM events GROUP BY 1),
m AS (SELECT event_type, median(abs(value - mid)) AS mad FROM events JOIN b USING (event_type) GROUP BY 1)
SELECT event_type, n, low, high, round(mean, 6) AS mean, round(mid, 6) AS mid, round(mad, 6) AS mad, round(mad * 1.4826, 6) AS mad_scaled FROM b JOIN m USING (event_type)""")
def spread_by_type(t):
    return _r(S.spread(t("events"), ["event_type"], "value"), 6, "mean", "mid", "mad", "mad_scaled")


@query("""SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def percentiles_by_type(t):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return t("events").groupBy("event_type").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.99).alias("p99"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS kept, round(avg(value), 6) AS trimmed_mean FROM r WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1""")
def trimmed_means(t):
    rows = S.trimmed(t("events"), ["event_type"], "value", 0.1, "event_id")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("value"), 6).alias("trimmed_mean"))


KS = """c AS (SELECT event_type, value, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM {rows} GROUP BY ALL),
g AS (SELECT event_type, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value), p AS (PARTITION BY event_type))
SELECT event_type, round(max(gap), 6) AS ks FROM g GROUP BY 1"""


@query("WITH " + KS.format(rows="events"))
def ks_by_type(t):
    return _r(S.ks(t("events"), ["event_type"], "value", F.col("user_id") % 2 == 0), 6, "ks")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type, user_id % 2) AS n FROM events),
t AS (SELECT * FROM r WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05)), """ + KS.format(rows="t"))
def trimmed_ks(t):
    e = t("events").withColumn("half", F.col("user_id") % 2)
    return _r(S.ks(S.trimmed(e, ["event_type", "half"], "value", 0.05, "event_id"), ["event_type"], "value", F.col("half") == 0), 6, "ks")


@query("""WITH a AS (SELECT l_partkey, list(l_tax) FILTER (l_returnflag = 'R') AS a, list(l_tax) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1),
d AS (SELECT l_partkey, unnest(a) AS x, b FROM a), e AS (SELECT l_partkey, x - unnest(b) AS d FROM d)
SELECT l_partkey, round(median(d), 6) + 0.0::DOUBLE AS shift FROM e GROUP BY 1""")
def median_shift(t):
    rows = t("lineitem").filter("l_returnflag IN ('R', 'A')")
    return S.shift(rows, ["l_partkey"], "l_tax", F.col("l_returnflag") == "R").withColumn("shift", F.round("shift", 6) + 0.0)  # no negative zero


@query("""WITH r AS (SELECT event_type, value AS s, user_id % 3 = 0 AS r, event_id FROM events),
n AS (SELECT *, lead(s) OVER w AS nx, lead(r) OVER w AS other FROM r WINDOW w AS (PARTITION BY event_type ORDER BY s, event_id)),
g AS (SELECT event_type, (s + nx) / 2 AS mid FROM n WHERE other <> r AND nx > s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY nx - s DESC, s) = 1),
m AS (SELECT event_type, median(s) FILTER (r) AS a, median(s) FILTER (NOT r) AS b FROM r GROUP BY 1)
SELECT event_type, round(coalesce(mid, (a + b) / 2), 6) AS threshold FROM m LEFT JOIN g USING (event_type)""")
def gap_threshold(t):
    return _r(S.gap_threshold(t("events"), ["event_type"], "value", F.col("user_id") % 3 == 0, "event_id"), 6, "threshold")


# the fit at a point is the largest, over starts up to it, of the least mean from there to an end at or behind it
FIT = """p AS (SELECT floor(n_chars / 50)::DOUBLE AS x, sum(quality)::DOUBLE AS s, count(*)::DOUBLE AS w FROM documents JOIN labels USING (doc_id) GROUP BY 1),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS s, sum(w) OVER (ORDER BY x) AS w, s AS s0, w AS w0 FROM p),
m AS (SELECT a.i AS a, b.i AS b, (b.s - a.s + a.s0) / (b.w - a.w + a.w0) AS mean FROM c a JOIN c b ON a.i <= b.i),
e AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m),
fit AS (SELECT c.x, max(e.least) AS fitted FROM c JOIN e ON e.a <= c.i AND e.b = c.i GROUP BY c.x)"""


def _by_size(t):
    return t("documents").join(t("labels"), "doc_id").withColumn("size", F.floor(F.col("n_chars") / 50))


@query(f"WITH {FIT} SELECT x, round(fitted, 6) AS fitted FROM fit")
def isotonic_quality(t):
    """Share of good labels by length, fitted to rise with it."""
    return _r(S.pooled(_by_size(t), "size", "quality"), 6, "fitted")


@query(f"""WITH {FIT}, q AS (SELECT part_key, part_key % 97 / 1.7 AS x FROM (SELECT p_partkey AS part_key FROM part)),
n AS (SELECT part_key, x, (SELECT max(f.x) FROM fit f WHERE f.x <= q.x) AS x0, (SELECT min(f.x) FROM fit f WHERE f.x >= q.x) AS x1 FROM q)
SELECT part_key, round(CASE WHEN x0 IS NULL THEN b.fitted WHEN x1 IS NULL OR x0 = x1 THEN a.fitted ELSE a.fitted + (b.fitted - a.fitted) / (x1 - x0) * (n.x - x0) END, 6) AS fitted
FROM n LEFT JOIN fit a ON a.x = x0 LEFT JOIN fit b ON b.x = x1""")
def isotonic_at_new_points(t):
    """The same fit read at places between, on and beyond its points."""
    asked = t("part").select(F.col("p_partkey").alias("part_key"), (F.col("p_partkey") % 97 / 1.7).alias("at"))
    return _r(S.evaluated(asked, "at", S.pooled(_by_size(t), "size", "quality")), 6, "fitted").select("part_key", "fitted")


@query()
def robust_isotonic_quality(t):
    """The same fit when a few labels may be wrong."""
    d = t("documents").join(t("labels"), "doc_id").withColumn("size", F.floor(F.col("n_chars") / 50))
    return _r(S.pooled_robust(d, "size", "quality"), 4, "fitted")


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 8) AS p, round(CASE WHEN abs((value - 50) / 10) <= 1.345 THEN 0.5 * ((value - 50) / 10) ** 2 ELSE 1.345 * (abs((value - 50) / 10) - 0.6725) END, 8) AS loss FROM events")
def sigmoid_and_huber(t):
    z = (F.col("value") - 50) / 10
    return t("events").select("event_id", F.round(S.sigmoid(z), 8).alias("p"), F.round(S.huber(z, 1.345), 8).alias("loss"))


@query("""WITH s AS (SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0), c AS (SELECT event_type, value FROM events WHERE event_id % 2 = 1),
n AS (SELECT event_type, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT event_type, value, count(*) AS m FROM c GROUP BY ALL), u AS (SELECT event_type, value, m, NULL AS event_id FROM k UNION ALL SELECT event_type, value, 0, event_id FROM s),
r AS (SELECT *, sum(m) OVER (PARTITION BY event_type ORDER BY value) AS upto FROM u)
SELECT event_type, event_id AS id, round((n - upto + 1) / (n + 1), 6) AS p FROM r JOIN n USING (event_type) WHERE event_id IS NOT NULL""")
def conformal_ranks(t):
    e = t("events")
    return _r(C.conformal(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["event_type"], "event_id", "value"), 6, "p")


RISK = "round(1 / (1 + exp(-(-1 + 0.02 * value + 0.3 * (user_id % 2)::INT))), 9)"


@query(f"""WITH r AS (SELECT event_id, value, user_id, event_type = 'purchase' AS y, row_number() OVER (ORDER BY ts, event_id) * 2 <= count(*) OVER () AS first FROM events),
c AS (SELECT round(CASE WHEN y THEN 1 - {RISK} ELSE {RISK} END, 9) AS s FROM r WHERE NOT first), o AS (SELECT event_id, value, {RISK} AS s FROM r WHERE first),
k AS (SELECT s, count(*) AS m FROM c GROUP BY 1), u AS (SELECT s, m, NULL AS event_id, NULL AS value FROM k UNION ALL SELECT s, 0, event_id, value FROM o), n AS (SELECT *, sum(m) OVER (ORDER BY s) AS upto FROM u)
SELECT event_id AS id, round((t.n - upto + 1) / (t.n + 1), 6) AS p, (t.n - upto + 1) / (t.n + 1) < 0.1 OR value > 95 AS escalate FROM n, (SELECT count(*) AS n FROM c) t WHERE event_id IS NOT NULL""")
def conformal_escalation(t):
    """A model that was saved and loaded ranks the first half of the events against the second; low p-values and high values are escalated."""
    rows = C.halves(t("events"), ["ts", "event_id"]).withColumns({"odd": F.col("user_id") % 2, "y": F.col("event_type") == "purchase"})
    path = scratch(t.spark, "model")
    probability = F.round(C.risk([0.02, 0.3], -1.0, C.feature(F.col("value")), C.feature(F.col("odd"))), 9)
    C.save_model(t.spark, path, [0.02, 0.3], -1.0, ["value", "odd"], rows.filter("half = 1").select(F.round(C.nonconformity(probability, F.col("y")), 9).alias("score")), alpha=0.1, entropy_threshold=95.0)
    model = C.load_model(t.spark, path, conformal_only=True)
    own = rows.filter("half = 0").withColumn("score", F.round(C.predicted(rows, model), 9))
    ranks = C.conformal(own, model["scores"], [], "event_id", "score").join(own.select(F.col("event_id").alias("id"), "value"), "id")
    return ranks.select("id", F.round("p", 6).alias("p"), C.escalates(F.col("p"), model["alpha"], F.col("value"), model["entropy_threshold"]).alias("escalate"))


@query("""SELECT event_type, value AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, ceil(0.9 * (count(*) OVER (PARTITION BY event_type) - 1)) + 1 AS k FROM events) WHERE i = k""")
def upper_quantiles(t):
    return C.upper_quantile(t("events"), ["event_type"], "value", 0.9)


@query("""WITH c AS (SELECT least(floor(value / 100 * 20 + 1e-9), 20)::BIGINT AS cell, (event_type = 'purchase')::INT AS y FROM events), g AS (SELECT unnest(range(1, 20)) AS cell)
SELECT g.cell / 20 AS threshold, round(coalesce(2 * (SELECT sum(y) FROM c WHERE c.cell >= g.cell) / nullif((SELECT count(*) FROM c WHERE c.cell >= g.cell) + (SELECT sum(y) FROM c), 0), 0), 6) AS f1 FROM g""")
def threshold_grid(t):
    e = t("events").select((F.col("value") / 100).alias("s"), (F.col("event_type") == "purchase").alias("y"))
    return _r(C.best_threshold(e, "s", "y"), 6, "f1")


@query("""WITH x AS (SELECT event_type, median(value) FILTER (user_id % 2 = 0) AS a, median(value) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1),
y AS (SELECT event_type, any_value(a) - any_value(b) AS median_shift, median(abs(value - a)) FILTER (user_id % 2 = 0) AS ma, median(abs(value - b)) FILTER (user_id % 2 = 1) AS mb FROM events JOIN x USING (event_type) GROUP BY 1)
SELECT event_type, round(median_shift, 6) AS median_shift, round(ma / mb, 6) AS mad_ratio, abs(median_shift) > 2 * greatest(1.345 * mb, 0.001) AS location_drift, NOT (ma / mb BETWEEN 0.5 AND 2) AS spread_drift FROM y""")
def calibration_drift(t):
    e = t("events")
    return _r(C.drift(e.filter("user_id % 2 = 0"), e.filter("user_id % 2 = 1"), ["event_type"], "value"), 6, "median_shift", "mad_ratio")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-(0.1 + 0.02 * l_quantity - 3 * l_discount + 0.5 * (l_returnflag = 'R')::INT))), 6) AS risk FROM lineitem""")
def logistic_risk(t):
    p = C.risk([0.02, -3.0, 0.5], 0.1, C.feature(F.col("l_quantity")), C.feature(F.col("l_discount")), C.feature(F.col("l_returnflag") == "R"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(p, 6).alias("risk"))


@query()
def logistic_fit(t):
    """Weights of a balanced logistic model of good labels on length and language."""
    d = t("documents").join(t("labels"), "doc_id").withColumns({"size": F.log1p("n_chars"), "english": F.col("lang") == "en"})
    weights, bias = C.fit_logistic(d, ["size", "english"], "quality")
    return t.spark.createDataFrame([(n, round(w, 4)) for n, w in [("size", weights[0]), ("english", weights[1]), ("bias", bias)]], "feature string, weight double")


SIX = ["quantity", "discount", "tax", "extendedprice", "partkey", "suppkey"]
BOUNDS = "g AS (SELECT l_returnflag, " + ", ".join(f"min(l_{f})::DOUBLE AS {f}_low, max(l_{f})::DOUBLE AS {f}_high" for f in SIX) + " FROM lineitem GROUP BY 1)"


def _bounds(t, factors):
    end = lambda f, how, name: how(F.col(f"l_{f}")).cast("double").alias(f"{f}_{name}")
    return t("lineitem").groupBy("l_returnflag").agg(*[x for f in factors for x in (end(f, F.min, "low"), end(f, F.max, "high"))])


@query(f"WITH {BOUNDS} SELECT l_returnflag, run::INT AS run, " + ", ".join(f"CASE WHEN run >= 8 THEN ({f}_low + {f}_high) / 2 WHEN run & {1 << i} > 0 THEN {f}_high ELSE {f}_low END AS {f}" for i, f in enumerate(SIX[:3])) + " FROM g, range(0, 10) r(run)")
def full_factorial(t):
    """All runs between the least and greatest values of three factors in each class of rows, and two at their middle."""
    return D.settings(_bounds(t, SIX[:3]), SIX[:3], 2)


SIGNS = ", ".join(f"CASE WHEN run & {1 << i} > 0 THEN 1 ELSE -1 END AS s{i}" for i in range(4))


@query(f"WITH {BOUNDS}, r AS (SELECT run::INT AS run, {SIGNS} FROM range(0, 16) x(run)), q AS (SELECT *, s0 * s1 * s2 AS s4, s1 * s2 * s3 AS s5 FROM r) SELECT l_returnflag, run, " + ", ".join(f"CASE WHEN s{i} = 1 THEN {f}_high ELSE {f}_low END AS {f}" for i, f in enumerate(SIX)) + " FROM g, q")
def fractional_factorial(t):
    """Sixteen runs between the least and greatest values of six factors in each class of rows."""
    return D.settings(_bounds(t, SIX), SIX, fractional=True)


@query("""WITH r AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END AS quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS returned, CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END AS discount, l_extendedprice AS s FROM lineitem),
u AS (UNPIVOT r ON quantity, returned, discount INTO NAME factor VALUE level),
e AS (SELECT factor, avg(s) FILTER (level = 1) AS hi, avg(s) FILTER (level = -1) AS lo, var_samp(s) FILTER (level = 1) AS vh, var_samp(s) FILTER (level = -1) AS vl, least(count(*) FILTER (level = 1), count(*) FILTER (level = -1)) AS n FROM u GROUP BY 1)
SELECT factor, round(hi - lo, 4) AS effect, round((hi - lo) / sqrt((vh + vl) / 2 / n), 4) AS t, CASE WHEN hi - lo > 1e-9 THEN 'high' WHEN hi - lo < -1e-9 THEN 'low' ELSE 'none' END AS better FROM e""")
def factor_effects(t):
    yes = lambda c: F.when(c, 1).otherwise(-1)
    runs = t("lineitem").select(yes(F.col("l_quantity") > 25).alias("quantity"), yes(F.col("l_returnflag") == "R").alias("returned"), yes(F.col("l_discount") > 0.05).alias("discount"), F.col("l_extendedprice").alias("s"))
    return _r(D.effects(runs, ["quantity", "returned", "discount"], "s"), 4, "effect", "t")
