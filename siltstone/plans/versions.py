"""Queries on versions: alignments, lineages of items, unions of paths."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import alignment as A
from siltstone.operators import ledger as G
from siltstone.operators import matching as M
from siltstone.operators import paths as P
from siltstone.operators import tokens as T
from siltstone.plans.registry import query


@query()
def turn_alignment(t):
    """How each turn's words become the next turn's: runs, matches and likeness."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").select("conv_id", "turn", F.split("text", r"\s+").alias("a")).withColumn("b", F.lead("a").over(w)).filter("b IS NOT NULL")
    n, m = F.size("a"), F.size("b")
    rows = A.aligned(c, "a", "b")
    ops = F.transform(A.opcodes(F.col("blocks"), n, m), lambda x: F.concat_ws(" ", x["tag"], x["i1"], x["i2"], x["j1"], x["j2"]))
    return rows.select("conv_id", "turn", A.shared(F.col("blocks")).alias("n_shared"), F.round(A.likeness(F.col("blocks"), n, m), 6).alias("likeness"), F.array_join(ops, ";").alias("runs"))


@query(r"""WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, '') AS anchor, string_split_regex(lower(text), '[.!?\n]+') AS parts FROM conversations WHERE text IS NOT NULL),
i AS (SELECT conv_id, turn, anchor, unnest(range(len(parts))) AS place, list_distinct(list_filter(string_split_regex(unnest(parts), '\s+'), lambda x: x <> '')) AS words FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS pos FROM i WHERE len(words) > 0),
p AS (SELECT x.conv_id, x.pos, y.pos AS old, len(list_intersect(x.words, y.words)) / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) AS score FROM k x JOIN k y ON x.conv_id = y.conv_id AND x.anchor = y.anchor AND y.pos < x.pos),
f AS (SELECT conv_id, pos, arg_max(old, score - old / 1e9) AS old FROM p WHERE score >= 0.3 GROUP BY ALL),
c AS (SELECT k.conv_id, k.pos, k.pos AS root FROM k LEFT JOIN f USING (conv_id, pos) WHERE old IS NULL UNION ALL SELECT f.conv_id, f.pos, c.root FROM f JOIN c ON f.conv_id = c.conv_id AND f.old = c.pos)
SELECT conv_id, turn, place, dense_rank() OVER (PARTITION BY conv_id ORDER BY root) AS lineage FROM c JOIN k USING (conv_id, pos)""")
def sentence_lineages(t):
    """Sentences of a conversation that live on in later turns of the same role."""
    c = t("conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("ledger"), F.col("turn").alias("version"), F.coalesce("role", F.lit("")).alias("anchor"), F.posexplode(F.split(F.lower("text"), r"[.!?\n]+")).alias("place", "part"))
    items = c.withColumn("words", F.array_distinct(F.filter(F.split("part", r"\s+"), lambda x: x != ""))).filter(F.size("words") > 0).drop("part")
    return G.lineages(items).select(F.col("ledger").alias("conv_id"), F.col("version").alias("turn"), "place", "lineage")


URLS = r"""u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS scope, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path, contains(url, '?') AS q FROM pages WHERE url IS NOT NULL),
x AS (SELECT page_id, scope, path, right(path[len(path)], 2) AS name, CASE WHEN path[len(path)] LIKE '%0' THEN 'glob' ELSE 'name' END AS kind, q FROM u WHERE len(path) > 0)"""


@query(rf"""WITH {URLS}, h AS (SELECT DISTINCT scope, path, name, kind, q, page_id // 8 AS line FROM x WHERE page_id % 4 <> 3),
m AS (SELECT DISTINCT scope, path, name, kind, q FROM x w WHERE page_id % 4 = 3 AND NOT EXISTS (FROM h WHERE h.scope = w.scope AND h.path = w.path)),
f AS (SELECT scope, path[:n] AS prefix, min(line) AS dest FROM h, range(1, 100) r(n) WHERE n <= len(path) GROUP BY ALL),
p AS (SELECT m.*, CASE WHEN kind <> 'glob' AND len(m.path) > 1 THEN dest END AS dest FROM m LEFT JOIN f ON f.scope = m.scope AND f.prefix = m.path[:len(m.path) - 1]),
g AS (SELECT p.*, EXISTS (FROM h WHERE h.scope = p.scope AND h.line = p.dest AND h.q = p.q) AS fits FROM p),
b AS (SELECT scope, dest, name FROM (SELECT scope, line AS dest, name, path FROM h UNION SELECT scope, dest, name, path FROM g WHERE fits) GROUP BY ALL HAVING count(*) > 1)
SELECT g.scope AS host, array_to_string(g.path, '/') AS path, coalesce(g.dest, -1) AS dest, CASE WHEN kind = 'glob' THEN 'glob' WHEN len(g.path) <= 1 THEN 'no_prefix' WHEN g.dest IS NULL THEN 'no_destination' WHEN NOT fits THEN 'other_domain' WHEN b.name IS NOT NULL THEN 'collision' ELSE 'added' END AS outcome
FROM g LEFT JOIN b ON g.fits AND b.scope = g.scope AND b.dest = g.dest AND b.name = g.name""")
def url_path_union(t):
    """Paths of a quarter of the pages, united with those that the others' sites have: each behind the first group of pages that has its folder, unless its name is taken there."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    parts = F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    u = t("pages").filter("url IS NOT NULL").select("page_id", host.alias("scope"), parts.alias("path"), F.contains("url", F.lit("?")).alias("q")).filter(F.size("path") > 0)
    last = F.element_at("path", -1)
    x = u.withColumns({"name": F.right(last, F.lit(2)), "kind": F.when(last.like("%0"), "glob").otherwise("name"), "line": F.floor(F.col("page_id") / 8)})
    have = x.filter("page_id % 4 <> 3").drop("page_id")
    want = x.filter("page_id % 4 = 3").select("scope", "path", "name", "kind", "q")
    out = P.path_union(have, want, ["q"])
    return out.select(F.col("scope").alias("host"), F.array_join("path", "/").alias("path"), F.coalesce("dest", F.lit(-1)).alias("dest"), "outcome")


@query()
def vector_matches(t):
    """Vectors of even id and those of odd id that they became: near enough, or nearer than most and on the same side of zero; each is used once."""
    e = t("embeddings").select(F.col("label").alias("kind"), F.floor(F.col("vec_id") / 2).alias("name"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("embedding")[0] > 0).alias("up"))
    return M.matched_by_vector(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), F.expr("a.up = b.up"), sure=0.4, maybe=0.25)


@query(r"""WITH x AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS k, regexp_replace(coalesce(text, ''), '["{}\\`]', '', 'g') AS said, '{"conv": ' || conv_id || ', "in": {"role": "' || role || '", "sign": "}\""}, "n": [' || turn || '' AS head FROM conversations WHERE role IS NOT NULL)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'balanced' ELSE 'none' END AS tier, CASE WHEN k < 3 THEN md5(head || ']}') END AS object FROM x""")
def objects_in_turns(t):
    """JSON objects found again in turns: bare, fenced, between what was said, and broken."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r'["{}\\`]', "")
    head = F.concat(F.lit('{"conv": '), "conv_id", F.lit(', "in": {"role": "'), "role", F.lit('", "sign": "}\\""}, "n": ['), "turn")
    k = (F.col("conv_id") + F.col("turn")) % 4
    text = F.when(k == 0, F.concat(head, F.lit(",]}"))).when(k == 1, F.concat(said, F.lit("\n```json\n"), head, F.lit("]}\n```\n"), said)).when(k == 2, F.concat(said, F.lit(' {"no": } '), head, F.lit("]} "), said)).otherwise(F.concat(said, head, F.lit("}"), said))
    found = t("conversations").filter("role IS NOT NULL").select("conv_id", "turn", T.extracted_object(text).alias("x"))
    return found.select("conv_id", "turn", "x.tier", F.md5("x.object").alias("object"))


@query(r"""WITH x AS (SELECT conv_id, turn, (conv_id + turn) % 3 AS k, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '')[:6] AS w FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'merged' WHEN 1 THEN 'overlap' ELSE 'unchanged' END AS reason, CASE WHEN k = 0 THEN array_to_string(list_concat(list_concat(['0', '=', w[2]], w[3:5]), ['9']), ' ') END AS merged FROM x WHERE len(w) = 6 AND len(list_distinct(w)) = 6""")
def turns_merged_by_token(t):
    """A turn's first words with one edit at each end, at one place, and with one edit only."""
    w = F.slice(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != ""), 1, 6)
    rows = t("conversations").filter("text IS NOT NULL").select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 3).alias("k"), w.alias("w")).filter("size(w) = 6 AND size(array_distinct(w)) = 6")
    line = lambda *parts: F.array_join(F.flatten(F.array(*parts)), " ")
    one, rest, last = F.slice("w", 1, 1), F.slice("w", 2, 4), F.slice("w", 6, 1)
    new = lambda *x: F.array(*[F.lit(v) for v in x])
    current = F.when(F.col("k") < 2, line(new("0", "="), rest, last)).otherwise(line(one, rest, last))
    replayed = F.when(F.col("k") == 1, line(new("7"), rest, last)).otherwise(line(one, rest, new("9")))
    rows = rows.select("conv_id", "turn", line(one, rest, last).alias("base"), current.alias("current"), replayed.alias("replayed"))
    return T.token_merge(rows).select("conv_id", "turn", "reason", "merged")


@query(r"""WITH x AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '')[:8] AS w FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, array_to_string(list_concat(list_concat(list_concat(['X'], w[3:4]), ['Y']), w[6:8]), ' ') AS text, '1 empty;2 missing;4 same' AS failed FROM x WHERE len(w) = 8 AND len(list_distinct(w)) = 8""")
def edits_in_order(t):
    """A turn's first words under five edits: one that stands there but for white space, one exact, three that fail."""
    w = F.slice(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != ""), 1, 8)
    rows = t("conversations").filter("text IS NOT NULL").select("conv_id", "turn", w.alias("w")).filter("size(w) = 8 AND size(array_distinct(w)) = 8")
    at = lambda i: F.col("w")[i - 1]
    # a sign behind the fifth word, so that the exact edit changes it whatever it is, "Y" too
    base = F.concat(at(1), F.lit("\n"), F.array_join(F.slice("w", 2, 4), " "), F.lit("! "), F.array_join(F.slice("w", 6, 3), " "))
    edit = lambda search, new: F.struct(search.alias("search"), new.alias("replace"))
    edits = F.array(edit(F.concat(at(1), F.lit("  "), at(2)), F.lit("X")), edit(F.lit(""), F.lit("a")), edit(F.lit("qq!!zz"), F.lit("b")), edit(F.concat(F.lit(" "), at(5), F.lit("! ")), F.lit(" Y ")), edit(at(3), F.concat(at(3), F.lit(" "))))
    done = rows.select("conv_id", "turn", T.applied_edits(base, edits).alias("x"))
    return done.select("conv_id", "turn", "x.text", F.array_join(F.transform("x.failed", lambda f: F.concat_ws(" ", f["edit"], f["why"])), ";").alias("failed"))
