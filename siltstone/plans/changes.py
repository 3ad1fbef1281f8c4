"""Queries on what became of named bodies, on plans and on items over versions."""

from pyspark.sql import functions as F

from siltstone.operators import changes as C
from siltstone.operators import pairing as P
from siltstone.plans.registry import query


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS kind FROM part)
SELECT kind, k AS name, -1 AS old_name, CASE WHEN k % 7 = 0 THEN 'removed' WHEN k % 3 = 0 THEN 'signature_changed' ELSE 'body_changed' END AS change FROM p WHERE k % 7 = 0 OR (k % 5 > 0 AND (k % 3 = 0 OR k % 4 = 0))
UNION ALL SELECT kind, k, -1, 'removed' FROM p WHERE k % 5 = 0 AND k % 7 > 0 AND k % 4 = 0
UNION ALL SELECT kind, k + 10000000, CASE WHEN k % 4 = 0 THEN -1 ELSE k END, CASE WHEN k % 4 = 0 THEN 'added' ELSE 'renamed' END FROM p WHERE k % 5 = 0 AND k % 7 > 0
UNION ALL SELECT kind, -1 - k, -1, 'added' FROM p WHERE k % 11 = 0""")
def change_classes(t):
    """Parts that change their size or text, get another key (with or without a change), go or come."""
    k = F.col("p_partkey")
    body = F.concat(F.lit("b"), k)
    parts = t("part").select(F.col("p_brand").alias("kind"), k.alias("name"), F.col("p_size").alias("signature"), body.alias("body"), k.alias("k"))
    n = F.col("k")
    later = parts.filter(n % 7 > 0).withColumns({"name": F.when(n % 5 == 0, n + 10_000_000).otherwise(n), "signature": F.when((n % 3 == 0) & (n % 5 > 0), F.col("signature") + 100).otherwise(F.col("signature")), "body": F.when(n % 4 == 0, F.concat(F.lit("new"), "body")).otherwise(F.col("body"))})
    later = later.unionByName(parts.filter(n % 11 == 0).withColumns({"name": -1 - n, "body": F.concat(F.lit("c"), n)})).drop("k")
    shape = lambda df: df.select("kind", "name", "body", F.array("body").alias("words"))
    out = C.change_classes(parts.drop("k"), later, P.renames(shape(parts), shape(later), min_words=1))
    return out.withColumn("old_name", F.coalesce("old_name", F.lit(-1)))


@query()
def matched_in_turn(t):
    """Documents' vectors of even id and where they live on among those of odd id: under their name, with their body, or near by."""
    e = t("embeddings").select(F.col("label").alias("kind"), F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 2).alias("half"), F.col("embedding").alias("vec"))
    rows = e.select("kind", "id", "half", "vec", F.concat(F.lit("x"), "half", F.lit(" y"), "half").alias("body"))
    named = lambda df: df.drop("half").withColumn("words", F.split("body", " "))
    old = rows.filter("id % 2 = 0").withColumn("name", F.col("half"))
    new = rows.filter("id % 2 = 1").withColumns({"name": F.when(F.col("half") % 3 == 0, F.col("half")).otherwise(-1 - F.col("half")), "body": F.when(F.col("half") % 3 == 1, F.col("body")).otherwise(F.concat(F.lit("v"), "id", F.lit(" w"), "id"))})
    return C.matched_in_turn(named(old), named(new), sure=0.4, maybe=0.25)


@query(r"""WITH c AS (SELECT conv_id AS scope, turn AS item, coalesce(role, '') AS role, turn % 4 AS k, coalesce(text, '') AS text FROM conversations),
a AS (SELECT scope, item + (k = 3)::INT AS item, CASE WHEN k = 2 AND scope % 2 = 0 THEN 'delete' WHEN k = 2 THEN 'keep' ELSE 'rewrite' END AS op, CASE k WHEN 0 THEN '..' WHEN 1 THEN 'RetryCount max_size' ELSE 'a // b' END AS text FROM c),
i AS (SELECT scope, item, item % 3 = 0 AS fixed, length(role) AS longest FROM c),
m AS (SELECT a.*, fixed, longest, i.item IS NOT NULL AS known FROM a LEFT JOIN i USING (scope, item)),
n AS (SELECT DISTINCT scope FROM c WHERE item = 1)
SELECT scope, item, 'invalid_anchor' AS "check", count(*) AS n FROM m WHERE NOT known GROUP BY ALL
UNION ALL SELECT scope, item, 'directive_changed', count(*) FROM m WHERE fixed AND op <> 'keep' GROUP BY ALL
UNION ALL SELECT scope, item, 'style', count(*) FROM m WHERE op = 'rewrite' AND (text = '..' OR text LIKE '%//%' OR (longest > 0 AND length(text) > 5 * longest)) GROUP BY ALL
UNION ALL SELECT scope, item, 'duplicate', count(*) FROM a GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT scope, item, 'unaccounted', 0 FROM i WHERE (scope, item) NOT IN (SELECT scope, item FROM a)
UNION ALL SELECT DISTINCT scope, item, 'stale_identifier', 1 FROM m WHERE op = 'rewrite' AND text LIKE 'Retry%' AND scope IN (SELECT scope FROM n)""")
def plan_failures(t):
    """Plans for the turns of conversations: some for the next turn, with names that the conversation lacks, with signs and dots for text."""
    k = F.col("turn") % 4
    c = t("conversations").select(F.col("conv_id").alias("scope"), "turn", F.coalesce("role", F.lit("")).alias("role"))
    op = F.when((k == 2) & (F.col("scope") % 2 == 0), "delete").when(k == 2, "keep").otherwise("rewrite")
    actions = c.select("scope", (F.col("turn") + (k == 3).cast("int")).alias("item"), op.alias("operation"), F.when(k == 0, "..").when(k == 1, "RetryCount max_size").otherwise("a // b").alias("text"))
    items = c.select("scope", F.col("turn").alias("item"), F.when(F.col("turn") % 3 == 0, "legal").otherwise("prose").alias("class"), F.col("role").alias("text"))
    names = c.filter("turn = 1").select("scope", F.lit("max_size").alias("name"))
    return C.plan_failures(actions, items, names, ("legal",))


@query("""WITH e AS (SELECT l_orderkey AS scope, l_suppkey % 2 AS lineage, (['base', 'current', 'replayed', 'resolved'])[1 + l_linenumber % 4] AS version, CASE WHEN l_partkey % 5 = 0 THEN ' Tax ' WHEN l_partkey % 37 = 0 THEN 'duty' ELSE 'tax' END AS text, CASE WHEN l_partkey % 3 = 0 THEN 'a' || (l_partkey % 2) ELSE '' END AS anchor, l_partkey % 90 AS lo FROM lineitem),
s AS (SELECT o_orderkey AS scope, o_custkey % 90 AS lo FROM orders WHERE o_orderkey % 2 = 0),
l AS (SELECT scope, anchor FROM e WHERE anchor <> '' GROUP BY ALL HAVING NOT bool_or(version = 'resolved')),
g AS (SELECT e.scope, lineage, bool_or(l.anchor IS NOT NULL) AS lost, bool_or(version = 'resolved') AS res, min(trim(text)) = max(trim(text)) AS same, min(lower(trim(text))) = max(lower(trim(text))) AS alike, bool_or(s.lo IS NOT NULL AND e.lo < s.lo + 6 AND s.lo < e.lo + 4) AS disputed,
 bool_or(version = 'base') AND bool_or(version = 'current') AND bool_or(version = 'replayed') OR bool_and(version = 'resolved') AS whole
 FROM e LEFT JOIN s ON s.scope = e.scope LEFT JOIN l ON l.scope = e.scope AND l.anchor = e.anchor GROUP BY ALL)
SELECT scope, lineage, CASE WHEN lost AND NOT res THEN 'delete' WHEN whole AND NOT disputed AND same THEN 'unchanged' WHEN whole AND NOT disputed AND alike THEN 'cosmetic' ELSE 'frontier' END AS disposition FROM g""")
def item_dispositions(t):
    """Lines of orders as items over versions: which need a decision, and which are settled by a plain rule."""
    part = F.col("l_partkey")
    version = F.get(F.array(*map(F.lit, ("base", "current", "replayed", "resolved"))), F.col("l_linenumber") % 4)
    e = t("lineitem").select(F.col("l_orderkey").alias("scope"), (F.col("l_suppkey") % 2).alias("lineage"), version.alias("version"), F.when(part % 5 == 0, " Tax ").when(part % 37 == 0, "duty").otherwise("tax").alias("text"), F.when(part % 3 == 0, F.concat(F.lit("a"), part % 2)).otherwise("").alias("anchor"), (part % 90).alias("start"), (part % 90 + 4).alias("stop"))
    s = t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("scope"), (F.col("o_custkey") % 90).alias("start"), (F.col("o_custkey") % 90 + 6).alias("stop"))
    return C.dispositions(e, s)
