"""Queries on decision tables and validators."""

from pyspark.sql import functions as F

from siltstone.operators import decisions as D
from siltstone.operators import validators as V
from siltstone.plans.registry import query

VERDICT = "CASE k % 6 WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'UNGROUNDED_NEW_CLAIM' WHEN 2 THEN 'UNVERIFIABLE_INHERITED_CLAIM' WHEN 3 THEN 'NON_CHECKABLE' WHEN 4 THEN 'SUPPORTED' END"
CLAIMS = f"""
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'inherited' WHEN 'A' THEN 'synthesized' ELSE 'uncertain' END AS origin,
 CASE l_suppkey % 4 WHEN 0 THEN 'invariant' WHEN 1 THEN 'rationale' WHEN 2 THEN 'security' ELSE 'ordering' END AS kind, {VERDICT.replace("k", "l_partkey")} AS c, {VERDICT.replace("k", "l_linenumber")} AS p, l_quantity > 25 AS ev FROM lineitem),
r AS (SELECT *, CASE c WHEN 'CONTRADICTED' THEN 5 WHEN 'UNGROUNDED_NEW_CLAIM' THEN 4 WHEN 'UNVERIFIABLE_INHERITED_CLAIM' THEN 3 WHEN 'NON_CHECKABLE' THEN 2 WHEN 'SUPPORTED' THEN 1 ELSE 0 END AS pc,
 CASE p WHEN 'CONTRADICTED' THEN 5 WHEN 'UNGROUNDED_NEW_CLAIM' THEN 4 WHEN 'UNVERIFIABLE_INHERITED_CLAIM' THEN 3 WHEN 'NON_CHECKABLE' THEN 2 WHEN 'SUPPORTED' THEN 1 ELSE 0 END AS pp FROM x),
v AS (SELECT *, coalesce(CASE WHEN pc >= pp THEN c ELSE p END, 'NON_CHECKABLE') AS v FROM r)"""
ROUTE = """CASE WHEN c IS NULL AND p IS NULL THEN 'abstain'
 WHEN origin = 'synthesized' THEN CASE WHEN v IN ('SUPPORTED', 'NON_CHECKABLE') THEN 'accept' ELSE 'comment_counterexample' END
 WHEN origin = 'inherited' THEN CASE WHEN v = 'CONTRADICTED' THEN CASE WHEN kind IN ('invariant', 'security') AND c = 'CONTRADICTED' AND ev THEN 'code_reopen' ELSE 'comment_counterexample' END
   WHEN v = 'UNVERIFIABLE_INHERITED_CLAIM' THEN CASE WHEN kind = 'rationale' THEN 'preserve_and_audit' ELSE 'human_review' END WHEN v = 'UNGROUNDED_NEW_CLAIM' THEN 'human_review' ELSE 'accept' END
 WHEN v = 'CONTRADICTED' THEN 'comment_counterexample' WHEN v IN ('UNGROUNDED_NEW_CLAIM', 'UNVERIFIABLE_INHERITED_CLAIM') THEN 'human_review' ELSE 'accept' END"""


def _verdict(k):
    out = None
    for i, v in enumerate(D.VERDICTS):
        out = F.when(k % 6 == i, v) if out is None else out.when(k % 6 == i, v)
    return out


def _claims(t):
    origin = F.when(F.col("l_returnflag") == "R", "inherited").when(F.col("l_returnflag") == "A", "synthesized").otherwise("uncertain")
    s = F.col("l_suppkey") % 4
    kind = F.when(s == 0, "invariant").when(s == 1, "rationale").when(s == 2, "security").otherwise("ordering")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", origin.alias("origin"), kind.alias("kind"), _verdict(F.col("l_partkey")).alias("c"), _verdict(F.col("l_linenumber")).alias("p"), (F.col("l_quantity") > 25).alias("ev"))


def _routed(t):
    return _claims(t).withColumn("route", D.route(F.col("origin"), F.col("kind"), F.col("c"), F.col("p"), F.col("ev")))


@query(f"WITH {CLAIMS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, {ROUTE} AS route FROM v")
def verdict_routes(t):
    return _routed(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.strictest(F.col("c"), F.col("p")).alias("v"), "route")


@query(f"WITH {CLAIMS}, q AS (SELECT l_suppkey, {ROUTE} AS route FROM v) SELECT l_suppkey, count(*) FILTER (route = 'accept') AS n_accept, count(*) FILTER (route = 'human_review') AS n_review, count(*) > 0 AND bool_and(route = 'accept') AS can_accept FROM q GROUP BY 1")
def case_acceptance(t):
    n = lambda r: F.count_if(F.col("route") == r)
    return _routed(t).groupBy("l_suppkey").agg(n("accept").alias("n_accept"), n("human_review").alias("n_review"), ((F.count(F.lit(1)) > 0) & F.every(F.col("route") == "accept")).alias("can_accept"))


@query(f"WITH {CLAIMS}, q AS (SELECT {ROUTE} AS route, v FROM v) SELECT route, v, count(*) AS n FROM q GROUP BY ALL")
def route_histogram(t):
    return _routed(t).groupBy("route", D.strictest(F.col("c"), F.col("p")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT *, l_quantity::INT AS size, l_returnflag = 'R' AS def, l_linenumber = 1 AS line, l_linestatus = 'F' AS sym, l_discount > 0.08 AS high, l_tax = 0 AS keeper, l_partkey % 5 AS modified, l_suppkey % 3 AS renamed FROM lineitem),
b AS (SELECT *, (size >= 20)::INT + def::INT + sym::INT + line::INT + high::INT + keeper::INT + (def AND modified >= 3)::INT AS strong, renamed > 0 AND modified = 0 AS pure, def OR line OR sym OR size >= 8 AS one FROM s)
SELECT CASE WHEN strong >= 2 AND pure THEN 'medium' WHEN strong >= 2 THEN 'hard' WHEN one AND pure THEN 'easy' WHEN one THEN 'medium' ELSE 'easy' END AS band, count(*) AS n FROM b GROUP BY 1""")
def difficulty_bands(t):
    c = F.col
    b = D.band(c("l_quantity").cast("int"), c("l_returnflag") == "R", c("l_linenumber") == 1, c("l_linestatus") == "F", c("l_discount") > 0.08, c("l_tax") == 0, c("l_partkey") % 5, c("l_suppkey") % 3)
    return t("lineitem").groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount > 0.08 AS hard, l_tax = 0.08 AS human, l_returnflag = 'R' AS warned, l_linenumber % 4 AS retries, l_suppkey % 3 AS critic, l_discount * 10 AS entropy, 1 - l_tax AS agreement, CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 11) / 10.0 END AS coverage FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN human AND retries < 1 THEN 'retry' WHEN human THEN 'escalate' WHEN hard AND retries < 2 THEN 'retry' WHEN hard THEN 'escalate' WHEN entropy > 0.65 OR agreement < 0.93 THEN 'escalate'
 WHEN warned AND critic < CASE WHEN coverage IS NULL OR coverage >= 0.9 THEN 3 WHEN coverage >= 0.5 THEN 2 ELSE 1 END THEN 'retry' ELSE 'accept' END AS action FROM s""")
def risk_decisions(t):
    c = F.col
    coverage = F.when(c("l_partkey") % 4 > 0, (c("l_partkey") % 11) / 10)
    act = D.decide(c("l_discount") > 0.08, c("l_tax") == 0.08, c("l_returnflag") == "R", c("l_linenumber") % 4, c("l_suppkey") % 3, c("l_discount") * 10, 1 - c("l_tax"), coverage, critic=3, max_entropy=0.65, min_agreement=0.93)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", act.alias("action"))


@query("""SELECT doc_id, round(least(1.0, 0.5 * coalesce(toxic, 0) + 0.2 * (n_chars < 100)::INT + 0.3 * contains(text, '###')::INT + 0.3 * (1 - coalesce(quality, 1)) + 0.1 * (n_chars % 3)), 6) AS risk FROM documents LEFT JOIN labels USING (doc_id)""")
def risk_scores(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    s = D.risk_score(F.col("toxic") == 1, F.col("n_chars") < 100, F.col("text").contains("###"), F.col("quality") == 1, F.col("n_chars") % 3)
    return d.select("doc_id", F.round(s, 6).alias("risk"))


@query(r"""SELECT doc_id, (length(trim(text)) = 0)::INT + regexp_matches(text, '(^|\n)(<<<<<<<|=======|>>>>>>>)')::INT + (coalesce(toxic, 0) = 1)::INT + regexp_matches(text, '[A-Z]+!!')::INT AS n_hard,
 (len(list_distinct(string_split(text, chr(10)))) * 2 < len(string_split(text, chr(10))))::INT AS n_warning FROM documents LEFT JOIN labels USING (doc_id)""")
def document_checks(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    out = V.checked(d, V.text_rules(F.col("text"), F.coalesce(F.col("toxic") == 1, F.lit(False)), ["[A-Z]+!!"]))
    return out.select("doc_id", "n_hard", "n_warning")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS first, max(l_partkey) AS last FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_definitions(t):
    return V.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("""WITH b AS (SELECT DISTINCT user_id, value::INT % 20 AS k FROM events WHERE event_type = 'error' AND event_id <= 5000), a AS (SELECT user_id, value::INT % 20 AS k, event_id FROM events WHERE event_type = 'error' AND event_id > 5000)
SELECT user_id, k AS key, min(event_id) AS event_id FROM a WHERE (user_id, k) NOT IN (SELECT user_id, k FROM b) GROUP BY ALL""".replace("value::INT", "floor(value)::INT"))
def new_errors(t):
    e = t("events").filter("event_type = 'error'")
    return V.new_errors(e.filter("event_id <= 5000"), e.filter("event_id > 5000"), ["user_id"], F.floor("value").cast("int") % 20, "event_id")


@query("SELECT o_orderkey, n, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'several' END AS label FROM (SELECT o_orderkey, (o_totalprice > 100000)::INT + (o_orderstatus = 'F')::INT + (o_orderpriority LIKE '1%')::INT AS n FROM orders)")
def check_reasons(t):
    got = F.size(D.reasons(large=F.col("o_totalprice") > 100000, closed=F.col("o_orderstatus") == "F", urgent=F.col("o_orderpriority").startswith("1")))
    return t("orders").select("o_orderkey", got.alias("n"), F.when(got == 1, "one").when(got > 1, "several").alias("label"))
