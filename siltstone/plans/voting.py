"""Queries on samples that vote: documents of a source as samples, turns of a conversation as claims."""

from pyspark.sql import functions as F

from siltstone.functions.text import fact, squeezed
from siltstone.operators import consensus as C
from siltstone.operators import metrics as M
from siltstone.plans.registry import query

NORM = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))"
GROUPS = f"g AS (SELECT lang, md5({NORM}) AS norm, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY ALL)"


@query(f"WITH {GROUPS} SELECT *, row_number() OVER (PARTITION BY lang ORDER BY size DESC, first) AS place FROM g")
def clusters_by_language(t):
    return C.clusters(t("documents"), ["lang"], squeezed(F.col("text")), "doc_id")


@query(f"""WITH {GROUPS} SELECT lang, sum(size)::BIGINT AS n, count(*) AS n_clusters, round(max(size) / sum(size), 6) AS agreement,
round(CASE WHEN sum(size) > 1 THEN greatest(0, -sum(size / n * log2(size / n)) / log2(any_value(n))) ELSE 0 END, 6) AS entropy
FROM (SELECT *, sum(size) OVER (PARTITION BY lang) AS n FROM g) GROUP BY lang""")
def entropy_by_language(t):
    out = C.entropy(C.clusters(t("documents"), ["lang"], squeezed(F.col("text")), "doc_id"), ["lang"])
    return out.withColumns({"agreement": F.round("agreement", 6), "entropy": F.round("entropy", 6)})


@query(f"""WITH g AS (SELECT source, md5({NORM}) AS norm, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT g.source, first, norm, size, coalesce(quality, 0)::DOUBLE AS consistency, (n_chars % 97)::DOUBLE AS confidence, n_chars AS length
FROM g JOIN documents d ON d.doc_id = g.first AND d.source = g.source LEFT JOIN labels l ON l.doc_id = first
QUALIFY row_number() OVER (PARTITION BY g.source ORDER BY size DESC, consistency DESC, confidence DESC, length, first) = 1""")
def winners_by_source(t):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return C.winners(d, ["source"], squeezed(F.col("text")), "doc_id", F.coalesce("quality", F.lit(0)).cast("double"), (F.col("n_chars") % 97).cast("double"), F.col("n_chars"))


FACTS = r"""f AS (SELECT conv_id % 50 AS grp, conv_id, turn AS key, regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'))), '[.,;:]+$', '') AS val FROM conversations)"""


def _facts(t):
    return t("conversations").select((F.col("conv_id") % 50).alias("grp"), "conv_id", F.col("turn").alias("key"), fact(F.col("text")).alias("val"))


@query(f"""WITH {FACTS}, c AS (SELECT grp, key, val, count(*) AS same FROM f GROUP BY ALL), s AS (SELECT *, same / sum(same) OVER (PARTITION BY grp, key) AS share FROM c)
SELECT conv_id, count(*) AS n, round(avg(share), 6) AS consistency FROM f JOIN s USING (grp, key, val) GROUP BY conv_id""")
def consistency_per_member(t):
    shares = C.fact_shares(_facts(t), "grp", "conv_id", "key", "val")
    return shares.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("consistency"))


@query(f"""WITH {FACTS}, c AS (SELECT grp, key, val, count(*) AS same FROM f GROUP BY ALL),
p AS (SELECT grp, key, max(same) AS top, sum(same) AS n, count(*) AS vals FROM c GROUP BY ALL)
SELECT grp, round(avg(top / n), 6) AS aggregate, count(*) FILTER (WHERE vals > 1 AND (n - top) * 3 >= n) AS n_low FROM p GROUP BY grp""")
def consistency_per_group(t):
    return C.consistency(_facts(t), "grp", "key", "val").withColumn("aggregate", F.round("aggregate", 6))


OUTCOMES = """o AS (SELECT CASE WHEN source = 'src19' THEN NULL ELSE source END AS mech,
  CASE WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'escalated' ELSE 'rejected' END AS outcome,
  CASE WHEN toxic IS NOT NULL THEN true END AS probed, toxic = 0 AS applies, CASE WHEN n_chars % 3 > 0 THEN n_chars % 3 = 1 END AS tested
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH {OUTCOMES}, k AS (SELECT *, coalesce(mech, '') AS mechanism, coalesce(mech, '') = '' AS legacy, mech IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') AS listed FROM o),
a AS (SELECT mechanism, count(*) FILTER (outcome = 'accepted' AND NOT legacy) AS accepted, count(*) FILTER (outcome = 'escalated' AND NOT legacy) AS escalated,
 count(*) FILTER (outcome = 'accepted' AND listed AND probed AND NOT applies) AS later_probe_failures,
 count(*) FILTER (outcome = 'accepted' AND listed AND NOT tested) AS later_test_failures, count(*) FILTER (legacy) AS legacy FROM k GROUP BY mechanism)
SELECT *, round(coalesce(accepted / nullif(accepted + escalated, 0), 0), 6) AS accept_rate FROM a""")
def mechanism_metrics(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    mod = F.col("n_chars") % 3
    o = d.select(
        F.when(F.col("source") != "src19", F.col("source")).alias("mech"),
        F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "escalated").otherwise("rejected").alias("outcome"),
        F.when(F.col("toxic").isNotNull(), F.lit(True)).alias("probed"),
        (F.col("toxic") == 0).alias("applies"),
        F.when(mod > 0, mod == 1).alias("tested"),
    )
    return M.by_mechanism(o, [f"src{i}" for i in range(6)], "mech", "outcome", "probed", "applies", "tested").withColumn("accept_rate", F.round("accept_rate", 6))


RUNS = "r AS (SELECT l_returnflag || l_linestatus AS setting, l_orderkey % 500 AS c, l_quantity > 20 AS good, l_tax AS proxy, CASE WHEN l_discount > 0.01 THEN l_quantity END AS latency FROM lineitem)"
PER = "p AS (SELECT setting, c, count(*) AS reps, count(*) FILTER (good) AS good, sum(proxy) AS proxy, avg(coalesce(latency, 0)) AS latency FROM r GROUP BY ALL)"
SCORES = """s AS (SELECT setting, count(*) AS n_cases, count(*) FILTER (good * 2 > reps) AS n_correct, round(avg(good / reps), 6) AS agreement, round(avg(CASE WHEN good >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k,
round(avg(CASE WHEN good = reps THEN 1.0 ELSE 0.0 END), 6) AS pass_all_k, round(sum(proxy / reps), 5) AS proxy_sum, round(avg(latency), 5) AS mean_latency FROM p GROUP BY setting)"""


def _scores(t):
    li = t("lineitem")
    r = li.select(F.concat("l_returnflag", "l_linestatus").alias("setting"), (F.col("l_orderkey") % 500).alias("c"), (F.col("l_quantity") > 20).alias("good"), F.col("l_tax").alias("proxy"), F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("latency"))
    out = M.replicated(r, "setting", "c", F.col("good"), "proxy", "latency")
    return out.withColumns({c: F.round(c, n) for c, n in {"agreement": 6, "pass_at_k": 6, "pass_all_k": 6, "proxy_sum": 5, "mean_latency": 5}.items()})


@query(f"WITH {RUNS}, {PER}, {SCORES} SELECT * FROM s")
def replicated_settings(t):
    return _scores(t)


@query(f"WITH {RUNS}, {PER}, {SCORES} SELECT setting[1:1] AS flag, setting, row_number() OVER (PARTITION BY setting[1:1] ORDER BY n_correct DESC, proxy_sum DESC, mean_latency, setting) AS rank FROM s QUALIFY rank <= 1")
def best_setting_per_flag(t):
    s = _scores(t).withColumns({"flag": F.substring("setting", 1, 1), "pos": F.col("setting")})
    return M.best_settings(s, ["flag"], 1).select("flag", "setting", "rank")


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_quantity * l_discount), 3) AS preserved, sum(l_quantity) AS total, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS coverage
FROM lineitem WHERE l_quantity > 0 GROUP BY ALL""")
def coverage_by_month(t):
    li = t("lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_quantity") * F.col("l_discount")).alias("p"), F.col("l_quantity").alias("q"))
    return M.coverage(li, ["month"], "p", "q").withColumns({"preserved": F.round("preserved", 3), "coverage": F.round("coverage", 6)})


@query("""WITH a AS (SELECT event_type AS v, count(*) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS v, count(*) AS y FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(bool_and(coalesce(x, 0) = coalesce(y, 0)), true) AS same, count(*) FILTER (coalesce(x, 0) <> coalesce(y, 0)) AS n_different FROM a FULL JOIN b USING (v)""")
def histograms_equal(t):
    e = t("events")
    return M.same_histogram(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "event_type")


@query("""SELECT source, lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_pass, count(*) FILTER (quality = 0) AS n_fail, grouping(source)::INT * 2 + grouping(lang)::INT AS level
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""")
def verdict_totals(t):
    d = t("documents").select("doc_id", "source", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_pass"), F.count_if(F.col("quality") == 0).alias("n_fail"), (F.grouping("source").cast("int") * 2 + F.grouping("lang").cast("int")).alias("level"))
