"""Queries on unions of what sides add, on reuse with its reasons, and on what a history holds around a change."""

from pyspark.sql import functions as F

from siltstone.operators import decisions as D
from siltstone.operators import lineage as G
from siltstone.operators import reuse as R
from siltstone.operators import unions as U
from siltstone.plans.registry import query


@query(r"""WITH x AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, string_split(coalesce(text, ''), chr(10)) AS b FROM conversations),
y AS (SELECT *, len(b) // 2 AS h FROM x)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'inserted' WHEN 1 THEN 'shared' WHEN 2 THEN 'edited' WHEN 3 THEN 'directives' ELSE 'inserted' END AS reason,
md5(array_to_string(CASE k WHEN 0 THEN ['#c'] || b[:h] || ['#x', '', '#r'] || b[h + 1:] || ['#z'] WHEN 3 THEN ['#c', '#x', '#r'] || b WHEN 4 THEN b[:h] || ['', '#x', ''] || b[h + 1:] || ['#z'] END, chr(10))) AS merged FROM y""")
def insertion_unions(t):
    """A turn's lines with lines put between them by two sides: apart, with one in common, with a line gone, with only directives, and with blanks in common."""
    b, k = F.col("base"), F.col("k")
    rows = t("conversations").select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 5).alias("k"), F.split(F.coalesce("text", F.lit("")), "\n").alias("base"))
    h = F.floor(F.size(b) / 2).cast("int")
    new = lambda *x: F.array(*[F.lit(v) for v in x])
    front, back = F.slice(b, F.lit(1), h), F.slice(b, h + 1, F.size(b))
    current = F.when(k == 0, F.concat(new("#c"), front, new("#x", ""), back)).when(k == 3, F.concat(new("#c", "#x"), b)).when(k == 4, F.concat(front, new("", "#x"), back)).otherwise(F.concat(new("#c", "plain"), b))
    replayed = F.when(k == 0, F.concat(front, new("#r"), back, new("#z"))).when(k == 1, F.concat(front, new("#c"), back)).when(k == 2, F.slice(b, F.lit(2), F.size(b)))
    replayed = replayed.when(k == 3, F.concat(front, new("#c"), back, new("#r"))).otherwise(F.concat(front, new(""), back, new("#z")))
    out = U.insertion_union(rows.select("conv_id", "turn", "base", current.alias("current"), replayed.alias("replayed")), directive="^#[a-z]")
    return out.select("conv_id", "turn", "reason", F.md5(F.array_join("merged", "\n")).alias("merged"))


@query(r"""WITH x AS (SELECT p_partkey, p_partkey % 4 AS k, lower(p_type) AS a, replace(p_brand, '#', '') AS b, p_name FROM part)
SELECT p_partkey, array_to_string(CASE k WHEN 0 THEN ['#[derive(' || a || ', both, ' || b || ')]', p_name] WHEN 1 THEN ['#[derive(' || a || ', both)]', p_name] WHEN 2 THEN ['#[derive(' || a || ')]', '#[derive(both)]', p_name] ELSE [p_name] END, chr(10)) AS united,
CASE k WHEN 0 THEN 1 ELSE 0 END AS n_closed, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS n_left FROM x""")
def attribute_lists_united(t):
    """Parts with an attribute that lists, and what another side lists: one list, a name that isn't to be united, two lists of the name, none."""
    k, a, b = F.col("p_partkey") % 4, F.lower("p_type"), F.replace("p_brand", F.lit("#"), F.lit(""))
    line = lambda name, *x: F.concat(F.lit(f"#[{name}("), F.concat_ws(", ", *x), F.lit(")]"))
    both = F.lit("both")
    lines = F.when(k < 2, F.array(line("derive", a, both), F.col("p_name"))).when(k == 2, F.array(line("derive", a), line("derive", both), F.col("p_name"))).otherwise(F.array("p_name"))
    missing = F.when(k == 1, F.array(line("cfg", b))).otherwise(F.array(line("derive", both, b), F.col("p_name")))
    done = t("part").select("p_partkey", U.list_line_union(lines, missing, names=("derive", "allow", "warn")).alias("u"))
    return done.select("p_partkey", F.array_join("u.lines", "\n").alias("united"), F.size("u.closed").alias("n_closed"), F.size("u.left").alias("n_left"))


@query(r"""SELECT c_custkey, 'members = ["m' || (c_custkey % 10) || '", "x"' || CASE WHEN c_custkey % 10 <> 3 THEN ', "m3"' ELSE '' END || ', "n' || c_nationkey || '"]' AS line FROM customer""")
def setting_lists_united(t):
    """A setting that lists, with the entries that another side has and it lacks, once each."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = lambda *x: F.concat(F.lit("members = ["), F.concat_ws(", ", *x), F.lit("]"))
    own, n = q(F.concat(F.lit("m"), F.col("c_custkey") % 10)), q(F.concat(F.lit("n"), F.col("c_nationkey")))
    done = U.list_line_union(F.array(line(own, q(F.lit("x")))), F.array(line(q(F.lit("m3")), own, n), line(n)), U.SETTING)
    return t("customer").select("c_custkey", F.get(done["lines"], 0).alias("line"))


ITEMS = """i AS (SELECT l_orderkey AS scope, l_returnflag AS container, l_partkey % 50 AS name, l_linestatus AS kind, l_suppkey AS body, l_linenumber AS n FROM lineitem),
b AS (FROM i WHERE n <= 1), r AS (FROM i WHERE n <= 3), o AS (SELECT DISTINCT scope, container, name, kind, body FROM i WHERE n <> 2)"""


@query(f"""WITH {ITEMS}, w AS (SELECT o.* FROM o WHERE NOT EXISTS (FROM b WHERE b.scope = o.scope AND b.container = o.container AND b.name = o.name)),
c AS (SELECT scope, container, name FROM w WHERE kind <> 'F' GROUP BY ALL HAVING count(*) > 1)
SELECT scope, container, name, kind, body, CASE WHEN kind = 'F' THEN 'excluded' WHEN EXISTS (FROM r WHERE r.scope = w.scope AND r.name = w.name) THEN 'present' WHEN NOT EXISTS (FROM r WHERE r.scope = w.scope AND r.container = w.container) THEN 'no_container'
WHEN EXISTS (FROM c WHERE c.scope = w.scope AND c.container = w.container AND c.name = w.name) THEN 'collision' ELSE 'added' END AS outcome FROM w""")
def keyed_items_united(t):
    """Lines of orders as named items of containers: what the later lines add to the first one, against a result that has the first three."""
    i = t("lineitem").select(F.col("l_orderkey").alias("scope"), F.col("l_returnflag").alias("container"), (F.col("l_partkey") % 50).alias("name"), F.col("l_linestatus").alias("kind"), F.col("l_suppkey").alias("body"), "l_linenumber")
    return U.keyed_union(i.filter("l_linenumber <= 3"), i.filter("l_linenumber <= 1"), i.filter("l_linenumber <> 2"), ["scope"], ("F",))


@query("""WITH s AS (SELECT o_orderkey AS pos, o_custkey % 200 AS shape, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderstatus END AS language, left(o_orderpriority, 1) AS kind, o_custkey % 3 AS path, o_totalprice > 100000 AS evidence, o_orderkey % 5 > 0 AS resolved FROM orders),
a AS (SELECT c_custkey AS id, c_custkey % 200 AS shape, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'F' ELSE 'O' END AS language, (1 + c_nationkey % 5)::VARCHAR AS kind, c_custkey % 3 AS path FROM customer),
m AS (SELECT id, pos, CASE WHEN a.language <> '' AND s.language <> '' AND a.language <> s.language THEN 'language' WHEN a.kind <> s.kind THEN 'kind' WHEN a.path <> s.path THEN 'path' WHEN NOT evidence THEN 'evidence' WHEN NOT resolved THEN 'resolved' END AS why FROM a JOIN s USING (shape)),
f AS (SELECT id, min(pos) FILTER (why IS NULL) AS first FROM m GROUP BY 1),
w AS (SELECT m.id, why, min(pos) AS p FROM m JOIN f USING (id) WHERE why IS NOT NULL AND (first IS NULL OR pos < first) GROUP BY ALL)
SELECT f.id, coalesce(first, -1) AS pos, coalesce((SELECT string_agg(why, ',' ORDER BY p) FROM w WHERE w.id = f.id), '') AS near_misses FROM f""")
def reuse_with_reasons(t):
    """The first order that a customer's request can reuse, and why earlier ones of its shape can't be."""
    key = F.col("o_custkey")
    text = lambda c: c.cast("string")
    store = t("orders").select(F.col("o_orderkey").alias("pos"), text(key % 200).alias("shape"), F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.col("o_orderstatus")).alias("language"), F.left("o_orderpriority", F.lit(1)).alias("kind"), text(key % 3).alias("path"), (F.col("o_totalprice") > 100000).alias("evidence"), F.when(F.col("o_orderkey") % 5 > 0, "x").otherwise("").alias("resolved"))
    c = F.col("c_custkey")
    asked = t("customer").select(c.alias("id"), text(c % 200).alias("shape"), F.when(c % 3 == 0, "").when(c % 3 == 1, "F").otherwise("O").alias("language"), text(1 + F.col("c_nationkey") % 5).alias("kind"), text(c % 3).alias("path"))
    return R.first_reuse(asked, store).select("id", F.coalesce("pos", F.lit(-1)).alias("pos"), F.array_join("near_misses", ",").alias("near_misses"))


@query("""WITH x AS (SELECT DISTINCT o_custkey AS history, o_orderkey AS place, l_returnflag AS path, l_linenumber AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT history, place, row_number() OVER (PARTITION BY history ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY history) AS n FROM (SELECT DISTINCT history, place FROM x)),
f AS (SELECT history, path, place, row_number() OVER (PARTITION BY history, path ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY history, path) AS n FROM (SELECT DISTINCT history, path, place FROM x))
SELECT x.*, c.i AS commit_index, c.n AS commit_count, f.n - 1 - f.i AS future_file_touches, count(*) OVER (PARTITION BY x.history, x.path, region) - row_number() OVER (PARTITION BY x.history, x.path, region ORDER BY x.place) AS future_region_touches, f.i AS recent_file_touches
FROM x JOIN c USING (history, place) JOIN f USING (history, path, place)""")
def history_features(t):
    """A customer's orders as a history: where each touch stands in it, and what later orders touch again."""
    orders = t("orders").select(F.col("o_custkey").alias("history"), F.col("o_orderkey").alias("place"))
    rows = t("lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("region")).join(orders, "place")
    return G.history_features(rows)


@query("SELECT p_partkey, greatest(1, least(floor(3 * (p_size % 9) / 4.0)::INT, 6)) AS budget FROM part")
def role_budgets(t):
    return t("part").select("p_partkey", D.role_budget(3, (F.col("p_size") % 9) / 4).alias("budget"))
