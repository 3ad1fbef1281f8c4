"""Queries on line edits, pairings and budgets: conversations as versions of a text, parts as named bodies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.stats import running
from siltstone.functions.text import words
from siltstone.operators import budget as B
from siltstone.operators import lines as L
from siltstone.operators import pairing as P
from siltstone.plans.registry import query
from siltstone.sources import readers as R
from siltstone.sources.scratch import written

LINES = r"list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'))), lambda x: x <> '')"
THREE = f"""v AS (SELECT doc_id, source, text AS base, lead(text) OVER w AS cur, lead(text, 2) OVER w AS rep FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
l AS (SELECT doc_id, {LINES.format("base")} AS b, {LINES.format("cur")} AS c, {LINES.format("rep")} AS r FROM v WHERE rep IS NOT NULL),
d AS (SELECT *, list_distinct(list_filter(c, lambda x: NOT list_contains(b, x))) AS ca, list_distinct(list_filter(b, lambda x: NOT list_contains(c, x))) AS cd,
 list_distinct(list_filter(r, lambda x: NOT list_contains(b, x))) AS ra, list_distinct(list_filter(b, lambda x: NOT list_contains(r, x))) AS rd FROM l)"""


PATCH = "sha1(array_to_string(list_concat(list_transform(list_sort(cd), lambda x: '-' || x), list_transform(list_sort(ca), lambda x: '+' || x)), chr(10)))"


def _three(t):
    """Each document with the next two of its source. Ids are numbered by ranges of source and id and texts then meet by number, so no source is one task's."""
    docs = t("documents").select("doc_id", F.struct("source").alias("g"), "text")
    places = written(running(docs.select("g", "doc_id"), ["g"], ["doc_id"], {"i": F.lit(1)}).select("g", "doc_id", "i"), "places")
    at = lambda k, name: docs.join(places, ["g", "doc_id"]).select("g", (F.col("i") - k).alias("i"), *["doc_id"][k:], F.col("text").alias(name))
    rows = at(0, "base").join(at(2, "rep").filter("rep IS NOT NULL"), ["g", "i"]).join(at(1, "cur"), ["g", "i"])
    return rows.select("doc_id", F.col("g.source").alias("source"), "base", "cur", "rep")


@query(f"""WITH {THREE}, k AS (SELECT *, CASE WHEN len(ca) > 0 AND len(cd) > 0 THEN 'modified' WHEN len(ca) > 0 THEN 'added' WHEN len(cd) > 0 THEN 'deleted' ELSE 'unchanged' END AS x,
 CASE WHEN len(ra) > 0 AND len(rd) > 0 THEN 'modified' WHEN len(ra) > 0 THEN 'added' WHEN len(rd) > 0 THEN 'deleted' ELSE 'unchanged' END AS y FROM d)
SELECT doc_id, len(ca) AS n_added, len(cd) AS n_removed, list_has_any(cd, rd) AS overlap, CASE WHEN x = 'unchanged' AND y = 'unchanged' THEN 'none' WHEN y = 'unchanged' THEN 'current_only' WHEN x = 'unchanged' THEN 'replayed_only' WHEN x = 'added' AND y = 'added' THEN 'both_added'
 WHEN x = 'deleted' AND y = 'deleted' THEN 'both_deleted' WHEN x = 'deleted' OR y = 'deleted' THEN 'delete_against_change' ELSE 'both_modified' END AS direction FROM k""")
def change_directions(t):
    b, c, r = F.col("base"), F.col("cur"), F.col("rep")
    got = L.changes(b, c)
    return _three(t).select("doc_id", F.size(got["added"]).alias("n_added"), F.size(got["removed"]).alias("n_removed"), L.same_lines(b, c, r).alias("overlap"), L.direction(b, c, r).alias("direction"))


@query(rf"""WITH {THREE} SELECT doc_id, len(list_filter(ca, lambda x: NOT list_contains(r, x) AND NOT regexp_matches(x, '^[\s{{}}()\[\];,]*$'))) AS n_missing, len(list_filter(cd, lambda x: list_contains(r, x))) AS n_undone FROM d""")
def obligations(t):
    """What the later version owes the middle one."""
    b, c, r = F.col("base"), F.col("cur"), F.col("rep")
    return _three(t).select("doc_id", F.size(L.missing(b, c, r)).alias("n_missing"), F.size(L.undone(b, c, r)).alias("n_undone"))


@query(rf"""WITH {THREE} SELECT doc_id, len(list_filter(ca, lambda x: NOT list_contains(r, x) AND NOT regexp_matches(x, '^(#!?\[|@[A-Za-z])') AND regexp_matches(x, '^(//|#|/\*|\*/|\*)'))) AS n_comments, {PATCH} AS patch,
round(CASE WHEN len(c) = 0 AND len(r) = 0 THEN 1 ELSE least(len(c), len(r)) / greatest(len(c), len(r)) END, 6) AS balance FROM d""")
def side_measures(t):
    """Comments owed, a change's hash wherever it is, and how even two sides are."""
    b, c, r = F.col("base"), F.col("cur"), F.col("rep")
    return _three(t).select("doc_id", F.size(L.owed_comments(b, c, r)).alias("n_comments"), L.patch_key(b, c).alias("patch"), F.round(L.balance(c, r), 6).alias("balance"))


@query(f"""WITH {THREE}, k AS (SELECT *, CASE WHEN len(ca) > 0 AND len(cd) > 0 THEN 'modified' WHEN len(ca) > 0 THEN 'added' WHEN len(cd) > 0 THEN 'deleted' ELSE 'unchanged' END AS x,
 CASE WHEN len(ra) > 0 AND len(rd) > 0 THEN 'modified' WHEN len(ra) > 0 THEN 'added' WHEN len(rd) > 0 THEN 'deleted' ELSE 'unchanged' END AS y FROM d),
m AS (SELECT *, CASE WHEN x = 'unchanged' AND y = 'unchanged' THEN 'none' WHEN y = 'unchanged' THEN 'current_only' WHEN x = 'unchanged' THEN 'replayed_only' WHEN x = 'added' AND y = 'added' THEN 'both_added'
 WHEN x = 'deleted' AND y = 'deleted' THEN 'both_deleted' WHEN x = 'deleted' OR y = 'deleted' THEN 'delete_against_change' ELSE 'both_modified' END AS kind FROM k)
SELECT doc_id, len(b) + len(c) + len(r) AS hunk_size, len(c) AS current_side_lines, len(r) AS replayed_side_lines, round(CASE WHEN len(c) = 0 AND len(r) = 0 THEN 1 ELSE least(len(c), len(r)) / greatest(len(c), len(r)) END, 6) AS balance,
 round(CASE WHEN least(len(c), len(r)) = 0 THEN 'Infinity'::DOUBLE ELSE greatest(len(c), len(r)) / least(len(c), len(r)) END, 6) AS imbalance_ratio, list_has_any(cd, rd) AS same_line_overlap, kind AS merge_kind, kind = 'delete_against_change' AS modify_delete,
 regexp_matches(rep, '(?m)^(<<<<<<<|=======|>>>>>>>)') AS markers_remaining, c <> b AND r <> b AND c <> r AS copied_one_side, false AS copied_current_side, c <> b AND r <> b AND c <> r AS copied_replayed_side,
 len(list_filter(ca, lambda x: NOT list_contains(r, x))) AS dropped_current_additions, 0 AS dropped_replayed_additions, len(list_filter(ca, lambda x: NOT list_contains(r, x))) > 0 AS dropped_a_side FROM m JOIN v USING (doc_id)""")
def conflict_features(t):
    """Conflicts as feature rows, and what is told of the later side taken as their result."""
    b, c, r = F.col("base"), F.col("cur"), F.col("rep")
    rows = _three(t).select("doc_id", L.conflict_features(b, c, r).alias("x"), L.result_features(b, c, r, r).alias("y")).select("doc_id", "x.*", "y.*")
    return rows.withColumns({k: F.round(k, 6) for k in ("balance", "imbalance_ratio")})


@query(f"""WITH {THREE}, s AS (SELECT doc_id, string_split(base, chr(10)) AS a, doc_id % 2 AS lo, doc_id % 2 + doc_id % 3 AS hi FROM v WHERE rep IS NOT NULL), k AS (SELECT doc_id, array_to_string(list_concat(list_concat(a[:lo], ['new', 'lines']), a[hi + 2:]), chr(10)) AS out FROM s)
SELECT doc_id, md5(out) AS spliced, true AS outside FROM k""")
def line_splices(t):
    """A span of lines replaced, and the check that nothing else was."""
    first, last = (F.col("doc_id") % 2).cast("int"), (F.col("doc_id") % 2 + F.col("doc_id") % 3).cast("int")
    rows = _three(t).withColumns({"first": first, "last": last})
    out = L.spliced_all(F.col("base"), F.array(F.struct("first", "last", F.lit("new\nlines").alias("new"))))
    rows = rows.withColumn("out", out)
    return rows.select("doc_id", F.md5("out").alias("spliced"), L.outside_unchanged(F.col("base"), F.col("first"), F.least(F.col("last"), F.size(F.split("base", "\n")) - 1), F.col("out")).alias("outside"))


@query(f"""WITH {THREE}, x AS (SELECT doc_id, array_to_string(list_filter(string_split(cur, chr(10)), lambda x: NOT list_contains(rd, trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g')))), chr(10)) AS out, cur, c, r, b FROM d JOIN v USING (doc_id)),
n AS (SELECT *, {" AND ".join(f"length(replace(out, '{z}', '')) - length(replace(out, '{a}', '')) = length(replace(cur, '{z}', '')) - length(replace(cur, '{a}', ''))" for a, z in ("()", "[]", "{}"))} AS ok FROM x)
SELECT doc_id, CASE WHEN ok THEN md5(out) END AS applied, CASE WHEN c <> b AND r <> b AND c <> r THEN 'current' END AS copied FROM n""")
def applied_deletions(t):
    """The middle version without the lines that the last one dropped, and whose verbatim copy the middle version is."""
    b, c, r = F.col("base"), F.col("cur"), F.col("rep")
    return _three(t).select("doc_id", F.md5(L.without_lines(c, L.changes(b, r)["removed"])).alias("applied"), L.verbatim_copy(b, c, r, c).alias("copied"))


@query("""SELECT l_orderkey, round(-avg(ln(l_tax + 0.01)), 6) AS surprise, round(list_product(list_transform(range(1, count_star + 1), lambda i: 1 + count_star / i)), 6) AS ways FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS count_star FROM lineitem) GROUP BY l_orderkey, count_star""")
def surprise_and_interleavings(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.log(F.col("l_tax") + 0.01)).alias("p"))  # an order's few lines
    n = F.size("p")
    return rows.select("l_orderkey", F.round(L.mean_surprise(F.col("p")), 6).alias("surprise"), F.round(L.interleavings(n, n), 6).alias("ways"))


@query(f"""WITH {THREE}, k AS (SELECT doc_id, len(cd) AS n_removed, len(list_filter(cd, lambda x: list_contains(r, x))) AS n_back FROM d)
SELECT doc_id, n_removed, n_back, round(n_back / n_removed, 6) AS coverage FROM k WHERE n_removed >= 1 AND n_back / n_removed >= 0.01""")
def resurrected_lines(t):
    v = _three(t)
    old, now, res = (v.select("doc_id", F.col(c).alias("text")) for c in ("base", "cur", "rep"))
    return L.resurrected(old, now, res, "doc_id", "text", 1, 0.01).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH l AS (SELECT lang, doc_id, unnest({LINES.format('text')}) AS line FROM documents) SELECT lang, md5(line) AS leaf, min(doc_id) AS doc_id FROM l GROUP BY ALL")
def first_lines(t):
    rows = t("documents").select("lang", "doc_id", F.explode(L.lines(F.col("text"))).alias("line"))
    return L.first_occurrences(rows.groupBy("lang", F.md5("line").alias("leaf")).agg(F.min("doc_id").alias("doc_id")), ["lang"], F.col("leaf"), "doc_id")


@query()
def renamed_parts(t):
    """Parts whose key moves, paired with where they went; tested against brute force."""
    body = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    rows = t("part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("name"), body.alias("text"))
    new = rows.withColumn("name", F.when(F.col("name") % 3 == 0, F.col("name") + 10_000_000).otherwise(F.col("name"))).withColumn("text", F.when(F.col("name") % 2 == 0, F.concat("text", F.lit(" extra"))).otherwise(F.col("text")))
    shape = lambda df: df.select("kind", "name", F.md5("text").alias("body"), words(F.col("text")).alias("words"))
    return P.renames(shape(rows), shape(new))


@query("""WITH s AS (SELECT conv_id, turn, role AS kind, length(text) AS size FROM conversations), r AS (SELECT *, greatest(0, 900 - coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM s)
SELECT conv_id, turn, CASE WHEN size <= room THEN size ELSE room END::BIGINT AS used FROM r WHERE size <= room OR (kind = 'user' AND room > 0)""")
def turns_in_budget(t):
    rows = t("conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.length("text").cast("long").alias("size"))
    return B.fitted(rows, ["conv_id"], "turn", "size", 900, cut="user").select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice::BIGINT AS w, sum(o_totalprice::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS u, sum(o_totalprice::BIGINT) OVER (PARTITION BY o_custkey) AS s FROM orders)
SELECT o_custkey, o_orderkey, (100 + round(1000 * (u - w) / s))::BIGINT AS lo, (100 + round(1000 * u / s))::BIGINT AS hi FROM k""".replace("o_totalprice::BIGINT", "floor(o_totalprice)::BIGINT"))
def proportional_spans(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("w"))
    return B.shares(rows, ["o_custkey"], "o_orderkey", "w", F.lit(100), F.lit(1000)).drop("w")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN 'E' || floor(value / 25)::INT END AS code FROM events WHERE event_type = 'error'),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, coalesce(code, event_id::VARCHAR) ORDER BY event_id) AS i FROM e)
SELECT user_id, event_id, coalesce(code, '') AS code, row_number() OVER (PARTITION BY user_id ORDER BY code IS NULL, event_id) AS place FROM f WHERE i = 1 QUALIFY place <= 3""")
def root_errors(t):
    code = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("E"), F.floor(F.col("value") / 25).cast("string")))
    e = t("events").filter("event_type = 'error'").select("user_id", "event_id", code.alias("code"))
    return B.first_per_code(e, ["user_id"], "code", "event_id", 3).withColumn("code", F.coalesce("code", F.lit("")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN row_number() OVER w <= ceil(count(*) OVER (PARTITION BY l_orderkey) / 2) THEN 0.9 ELSE 0.2 END AS temperature FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def sample_temperatures(t):
    w = Window.partitionBy("l_orderkey")
    place = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", B.temperature(place, F.count(F.lit(1)).over(w), 0.9, 0.2).alias("temperature"))


@query("""SELECT o_orderkey, round(greatest(0, least(1, 0.5 * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0 END + 0.6 * CASE WHEN o_totalprice > 200000 THEN 1.0 WHEN o_totalprice > 50000 THEN 0.5 ELSE 0 END)), 6) AS confidence FROM orders""")
def history_confidence(t):
    price = F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_totalprice") > 50000, "O").otherwise("none")
    return t("orders").select("o_orderkey", F.round(B.quality({"status": (F.col("o_orderstatus"), 0.5), "price": (price, 0.6)}, {"F": 1.0, "O": 0.5}), 6).alias("confidence"))


@query("""WITH b AS (SELECT p_brand AS kind, p_partkey AS name, md5(p_type || p_size % 5) AS body FROM part),
l AS (SELECT kind, CASE WHEN name % 3 = 0 THEN name + 10000000 ELSE name END AS name, body FROM b), r AS (SELECT kind, CASE WHEN name % 5 = 0 THEN name + 20000000 ELSE name END AS name, CASE WHEN name % 7 = 0 THEN 'x' || body ELSE body END AS body FROM b WHERE name % 11 <> 0),
s AS (SELECT b.*, l.name IS NOT NULL AS in_left, r.name IS NOT NULL AS in_right, coalesce(l.body = b.body, false) AS kept_left, coalesce(r.body = b.body, false) AS kept_right FROM b LEFT JOIN l USING (kind, name) LEFT JOIN r USING (kind, name)),
gl AS (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY name) AS i FROM s WHERE NOT in_left AND NOT kept_right), gr AS (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY name) AS i FROM s WHERE NOT in_right AND NOT kept_left),
cl AS (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY name) AS i FROM l ANTI JOIN b USING (kind, name)), cr AS (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY name) AS i FROM r ANTI JOIN b USING (kind, name)),
ml AS (SELECT gl.kind, gl.name, cl.name AS ln FROM gl JOIN cl USING (kind, body, i)), mr AS (SELECT gr.kind, gr.name, cr.name AS rn FROM gr JOIN cr USING (kind, body, i))
SELECT kind, name AS base_name, coalesce(ln, CASE WHEN in_left THEN name END)::VARCHAR AS left_name, coalesce(rn, CASE WHEN in_right THEN name END)::VARCHAR AS right_name FROM s LEFT JOIN ml USING (kind, name) LEFT JOIN mr USING (kind, name) WHERE ln IS NOT NULL OR rn IS NOT NULL""")
def three_way_renames(t):
    """Parts whose key moves on one side or both, followed by their bodies."""
    base = t("part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("name"), F.md5(F.concat("p_type", (F.col("p_size") % 5).cast("string"))).alias("body"))
    moved = lambda n, by: F.when(F.col("name") % n == 0, F.col("name") + by).otherwise(F.col("name")).alias("name")
    right = base.filter("name % 11 <> 0").select("kind", moved(5, 20_000_000), F.when(F.col("name") % 7 == 0, F.concat(F.lit("x"), "body")).otherwise(F.col("body")).alias("body"))
    return P.repaired(base, base.select("kind", moved(3, 10_000_000), "body"), right).withColumns({c: F.col(c).cast("string") for c in ("left_name", "right_name")})


PROMPT = {"current": "== current side ==", "replayed": "== replayed side ==", "base": "== base ==", "context": "== context =="}


@query(rf"""WITH {THREE} SELECT doc_id, {", ".join(rf"md5(regexp_replace({c}, '(^|\n)\s*$', '')) AS {n}" for n, c in (("base", "base"), ("current", "coalesce(cur, '')"), ("replayed", "rep")))}, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || ' here' END AS context FROM v WHERE rep IS NOT NULL AND base IS NOT NULL AND doc_id % 5 <> 0""")
def stored_prompts(t):
    """Versions laid out as the sections of a prompt, and read from it again; a prompt without a section gives none."""
    v = _three(t).filter("base IS NOT NULL")
    head = {n: F.lit(h + "\n") for n, h in PROMPT.items()}
    context = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(head["context"], "source", F.lit(" here\n\nOutput: JSON\n")))
    base = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(head["base"], "base", F.lit("\n\n")))
    text = F.concat(F.lit("Task\n"), head["current"], F.coalesce("cur", F.lit("")), F.lit("\n\n"), head["replayed"], "rep", F.lit("\n\n"), base, context)
    got = v.select("doc_id", text.alias("text")).select("doc_id", R.sections(F.col("text"), PROMPT, ("context",), "^Output").alias("s")).filter("s IS NOT NULL")
    return got.select("doc_id", *[F.md5(f"s.{n}").alias(n) for n in ("base", "current", "replayed")], "s.context")
