"""Queries on three snapshots of the parts: a base, and two sides with edits that depend on the key."""

from pyspark.sql import functions as F

from siltstone.operators import merge as M
from siltstone.plans.registry import query

COLS = ["p_name", "p_size", "p_retailprice"]
SIDES = """
base AS (SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey % 11 <> 0),
cur AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS p_name, p_size, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 13 <> 0),
rep AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_name || '!' WHEN p_partkey % 15 = 0 THEN p_name || '?' ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM part WHERE p_partkey % 17 <> 0),
al AS (SELECT p_partkey, CASE WHEN b.p_partkey IS NOT NULL THEN {'n': b.p_name, 's': b.p_size, 'r': b.p_retailprice} END AS b,
  CASE WHEN c.p_partkey IS NOT NULL THEN {'n': c.p_name, 's': c.p_size, 'r': c.p_retailprice} END AS c, CASE WHEN r.p_partkey IS NOT NULL THEN {'n': r.p_name, 's': r.p_size, 'r': r.p_retailprice} END AS r
  FROM base b FULL JOIN cur c USING (p_partkey) FULL JOIN rep r USING (p_partkey))"""
LABEL = """CASE WHEN b IS NULL AND c IS NOT NULL AND r IS NOT NULL THEN CASE WHEN c = r THEN 'added_both' ELSE 'conflict_added' END
 WHEN b IS NULL THEN CASE WHEN c IS NOT NULL THEN 'added_current' ELSE 'added_replayed' END
 WHEN c IS NOT DISTINCT FROM r THEN CASE WHEN c IS NOT DISTINCT FROM b THEN 'unchanged' WHEN c IS NULL THEN 'deleted_both' ELSE 'changed_both' END
 WHEN c IS NOT DISTINCT FROM b THEN CASE WHEN r IS NULL THEN 'deleted_replayed' ELSE 'changed_replayed' END
 WHEN r IS NOT DISTINCT FROM b THEN CASE WHEN c IS NULL THEN 'deleted_current' ELSE 'changed_current' END
 WHEN c IS NULL OR r IS NULL THEN 'conflict_deleted' ELSE 'conflict_changed' END"""


def _sides(t):
    p, k = t("part"), F.col("p_partkey")
    base = p.filter(k % 11 != 0)
    cur = p.filter(k % 13 != 0).withColumns({"p_name": F.when(k % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), "p_retailprice": F.when(k % 7 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))})
    name = F.when(k % 10 == 0, F.concat("p_name", F.lit("!"))).when(k % 15 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name"))
    rep = p.filter(k % 17 != 0).withColumns({"p_name": name, "p_size": F.when(k % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    return base, cur, rep


def _aligned(t):
    return M.aligned(*_sides(t), "p_partkey", COLS)


@query(f"WITH {SIDES} SELECT p_partkey, {LABEL} AS label FROM al")
def alignment_labels(t):
    return _aligned(t).select("p_partkey", M.label().alias("label"))


@query(f"""WITH {SIDES}, m AS (SELECT p_partkey, {LABEL} AS label, CASE WHEN c IS NOT DISTINCT FROM r THEN c WHEN c IS NOT DISTINCT FROM b THEN r WHEN r IS NOT DISTINCT FROM b THEN c END AS v,
 NOT (c IS NOT DISTINCT FROM r OR c IS NOT DISTINCT FROM b OR r IS NOT DISTINCT FROM b) AS conflict FROM al)
SELECT p_partkey, label, v.n AS p_name, coalesce(v.s, -1) AS p_size, round(v.r, 2) AS p_retailprice, conflict FROM m WHERE v IS NOT NULL OR conflict""")
def row_merge(t):
    return M.rows(_aligned(t), "p_partkey").select("p_partkey", "label", F.col("merged.p_name").alias("p_name"), F.coalesce("merged.p_size", F.lit(-1)).alias("p_size"), F.round("merged.p_retailprice", 2).alias("p_retailprice"), "conflict")


def _field(f: str) -> str:
    return f"CASE WHEN c.{f} IS NOT DISTINCT FROM r.{f} OR r.{f} IS NOT DISTINCT FROM b.{f} THEN c.{f} WHEN c.{f} IS NOT DISTINCT FROM b.{f} THEN r.{f} END"


def _bad(f: str, name: str) -> str:
    return f"CASE WHEN NOT (c.{f} IS NOT DISTINCT FROM r.{f} OR c.{f} IS NOT DISTINCT FROM b.{f} OR r.{f} IS NOT DISTINCT FROM b.{f}) THEN '{name},' ELSE '' END"


@query(f"""WITH {SIDES} SELECT p_partkey, {_field("n")} AS p_name, {_field("s")} AS p_size, round({_field("r")}, 2) AS p_retailprice, rtrim({_bad("n", "p_name")} || {_bad("s", "p_size")} || {_bad("r", "p_retailprice")}, ',') AS conflicts
FROM al WHERE b IS NOT NULL AND c IS NOT NULL AND r IS NOT NULL""")
def field_merge(t):
    return M.fields(_aligned(t), "p_partkey", COLS).withColumns({"conflicts": F.array_join("conflicts", ","), "p_retailprice": F.round("p_retailprice", 2)})


@query(f"WITH {SIDES}, l AS (SELECT {LABEL} AS label FROM al) SELECT label, count(*) AS n FROM l GROUP BY label")
def merge_summary(t):
    return _aligned(t).groupBy(M.label().alias("label")).agg(F.count(F.lit(1)).alias("n"))


LISTS = """
x AS (SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <= 2) AS b0, list('c' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber = 3) AS ct, list(CASE WHEN l_suppkey % 4 = 0 THEN 'c' ELSE 'r' END || l_partkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_suppkey % 4 = 0 THEN 'c' ELSE 'r' END) FILTER (l_linenumber IN (3, 4)) AS rt FROM lineitem GROUP BY 1),
y AS (SELECT l_orderkey, coalesce(b0, []) AS b, coalesce(ct, []) AS ct, coalesce(rt, []) AS rt FROM x)"""


@query(f"""WITH {LISTS} SELECT l_orderkey, CASE WHEN l_orderkey % 9 > 0 AND NOT list_has_any(ct, rt) AND len(ct) + len(rt) > 0 THEN array_to_string(b || ct || rt, ',') END AS merged FROM y WHERE len(b) > 0""")
def list_union(t):
    item = lambda c, *on: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber").isin(*on), F.struct("l_linenumber", "l_partkey", c.alias("v"))))), lambda s: s["v"])
    part = F.col("l_partkey").cast("string")
    x = t("lineitem").groupBy("l_orderkey").agg(item(part, 1, 2).alias("b"), item(F.concat(F.lit("c"), part), 3).alias("ct"), item(F.concat(F.when(F.col("l_suppkey") % 4 == 0, "c").otherwise("r"), part), 3, 4).alias("rt"))
    edited = F.when(F.col("l_orderkey") % 9 == 0, F.transform("b", lambda v: F.concat(v, F.lit("*")))).otherwise(F.col("b"))
    merged = M.list_union(F.col("b"), F.concat("b", "ct"), F.concat(edited, F.col("rt")))
    return x.filter(F.size("b") > 0).select("l_orderkey", F.array_join(merged, ",").alias("merged"))


@query("""WITH s AS (SELECT p_partkey, p_size, (p_partkey % 4 = 0) AS cd, (p_partkey % 6 = 0) AS rd, p_brand FROM part),
m AS (SELECT p_partkey, {'size': p_size} AS b, p_size, cd, rd, p_brand FROM s)
SELECT p_partkey, CASE WHEN cd AND rd THEN NULL ELSE 'size=' || (p_size) || CASE WHEN cd THEN ';note=c' ELSE '' END || CASE WHEN rd THEN ';note=r' ELSE '' END END AS merged FROM m""")
def map_union(t):
    k = F.col("p_partkey")
    base = F.create_map(F.lit("size"), F.col("p_size").cast("string"))
    none = F.create_map().cast("map<string,string>")
    cur = F.map_concat(base, F.when(k % 4 == 0, F.create_map(F.lit("note"), F.lit("c"))).otherwise(none))
    rep = F.map_concat(base, F.when(k % 6 == 0, F.create_map(F.lit("note"), F.lit("r"))).otherwise(none))
    merged = M.map_union(base, cur, rep)
    return t("part").select("p_partkey", F.array_join(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'deletion' WHEN p_size % 5 = 0 THEN 'identical' WHEN p_size % 2 = 0 THEN 'one_sided' END AS rule, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 2 = 0 THEN p_brand END AS value FROM part""")
def rule_cascade(t):
    s = F.col("p_size")
    got = M.first_rule(deletion=F.when(s % 3 == 0, ""), identical=F.when(s % 5 == 0, F.col("p_name")), one_sided=F.when(s % 2 == 0, F.col("p_brand")))
    return t("part").select("p_partkey", got["rule"].alias("rule"), got["value"].alias("value"))


@query(f"""WITH {SIDES} SELECT count(*) AS total, count(*) FILTER (p_partkey IN (SELECT p_partkey FROM rep)) AS preserved, round(count(*) FILTER (p_partkey IN (SELECT p_partkey FROM rep)) / count(*), 6) AS coverage
FROM cur WHERE p_partkey NOT IN (SELECT p_partkey FROM base)""")
def preservation_coverage(t):
    base, cur, rep = _sides(t)
    added = cur.join(base, "p_partkey", "left_anti").join(rep.select("p_partkey", F.lit(True).alias("kept")), "p_partkey", "left")
    return added.agg(F.count(F.lit(1)).alias("total"), F.count("kept").alias("preserved")).withColumn("coverage", F.round(F.try_divide("preserved", "total"), 6))


@query(f"WITH {SIDES} SELECT p_partkey FROM rep WHERE p_partkey NOT IN (SELECT p_partkey FROM base) AND p_partkey NOT IN (SELECT p_partkey FROM cur)")
def unattributed_rows(t):
    base, cur, rep = _sides(t)
    known = base.select("p_partkey").unionByName(cur.select("p_partkey"))
    return rep.join(known, "p_partkey", "left_anti").select("p_partkey")


@query("""WITH o AS (SELECT p_partkey, md5(p_name || p_type || p_size::VARCHAR) AS body, p_brand AS path, p_size FROM part),
n AS (SELECT CASE WHEN p_size % 2 = 1 THEN -1 - p_partkey ELSE p_partkey END AS p_partkey, body, CASE WHEN p_size % 3 = 0 THEN 'moved' ELSE path END AS path FROM o),
m AS (SELECT body, path, min(p_partkey) AS new_key FROM n GROUP BY ALL)
SELECT o.p_partkey AS old_key, min(m.new_key) AS new_key FROM o JOIN m USING (body) WHERE o.path <> m.path AND o.p_partkey NOT IN (SELECT p_partkey FROM n) GROUP BY 1""")
def moved_rows(t):
    """Rows whose key is gone from the new snapshot but whose body appears under another path; the new rows are one per body and path before the join."""
    k, size = F.col("p_partkey"), F.col("p_size")
    body = F.md5(F.concat("p_name", "p_type", size.cast("string")))
    old = t("part").select(k.alias("old_key"), body.alias("body"), F.col("p_brand").alias("path"))
    new = t("part").select(F.when(size % 2 == 1, -1 - k).otherwise(k).alias("new_key"), body.alias("body"), F.when(size % 3 == 0, "moved").otherwise(F.col("p_brand")).alias("new_path"))
    gone = old.join(new.select(F.col("new_key").alias("old_key")), "old_key", "left_anti")
    one = new.groupBy("body", "new_path").agg(F.min("new_key").alias("new_key"))
    return gone.join(one, "body").filter("path != new_path").groupBy("old_key").agg(F.min("new_key").alias("new_key"))
