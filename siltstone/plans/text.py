"""Queries on text functions, over whole documents and conversations."""

from pyspark.sql import functions as F

from siltstone.functions import sequences as Q
from siltstone.functions import text as X
from siltstone.plans.registry import query
from siltstone.plans.retrieval import terms_sql


@query(f"SELECT doc_id, len({terms_sql('text')}) AS n_terms, len(list_distinct({terms_sql('text')})) AS n_distinct FROM documents")
def identifier_terms(t):
    terms = X.ident_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(terms).alias("n_terms"), F.size(F.array_distinct(terms)).alias("n_distinct"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS squeezed, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END::BIGINT AS estimate,
 md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS lines FROM documents""")
def normal_forms(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.md5(X.squeezed(c)).alias("squeezed"), X.token_estimate(c).alias("estimate"), F.md5(X.squeezed_lines(c)).alias("lines"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS similarity FROM p""")
def turn_similarity(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").select("conv_id", "turn", X.words(F.col("text")).alias("x"))
    rows = c.withColumns({"y": F.lead("x").over(w), "next": F.lead("turn").over(w)}).filter(F.col("next") == F.col("turn") + 1)
    return rows.select("conv_id", "turn", F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '"[^"\n]*"|' || chr(39) || '[^' || chr(39) || '\n]*' || chr(39), '<STR>', 'g'), '(?m)(#|//).*$', '', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS masked FROM conversations""")
def masked_bodies(t):
    return t("conversations").select("conv_id", "turn", F.md5(X.masked(F.col("text"))).alias("masked"))


@query()
def name_similarity(t):
    """Character similarity of each part's name to its type; no SQL function has this metric."""
    return t("part").select("p_partkey", F.round(Q.char_ratio("p_name", F.lower("p_type")), 6).alias("similarity"))


@query()
def line_edits(t):
    """Edit runs between each turn's words and the next turn's."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").select("conv_id", "turn", F.split("text", r"\s+").alias("a")).withColumn("b", F.lead("a").over(w)).filter("b IS NOT NULL")
    runs = c.withColumn("runs", Q.opcodes("a", "b"))
    n = lambda tag: F.size(F.filter("runs", lambda r: r["tag"] == tag))
    return runs.select("conv_id", "turn", n("equal").alias("n_equal"), n("replace").alias("n_replace"), n("delete").alias("n_delete"), n("insert").alias("n_insert"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, l_partkey AS k FROM lineitem),
c AS (SELECT l_orderkey, i, k, 1 AS n FROM l UNION SELECT l.l_orderkey, l.i, l.k, c.n + 1 FROM c JOIN l ON l.l_orderkey = c.l_orderkey AND l.i > c.i AND l.k > c.k)
SELECT l_orderkey, max(n) AS n FROM c GROUP BY 1""")
def longest_rise(t):
    """Length of a longest rising run of part keys in each order, in line order."""
    xs = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("int")).alias("xs"))
    return xs.select("l_orderkey", F.size(Q.increasing("xs")).alias("n"))


KINDS = " ".join(f"WHEN regexp_matches(t, '{p}', 's') THEN '{k}'" for k, p in X.CLAIM_KINDS)
MODES = " ".join(f"WHEN regexp_matches(t, '{p}', 's') THEN '{k}'" for k, p in X.MODALITIES)
REASONS = " ".join(f"WHEN regexp_matches(t, '{p}', 's') THEN '{k}'" for k, p in X.TERMINAL_REASONS)


@query(f"WITH x AS (SELECT conv_id, turn, lower(text) AS t FROM conversations) SELECT conv_id, turn, CASE {KINDS} ELSE 'implementation_description' END AS kind, CASE {MODES} ELSE 'universal' END AS modality, CASE {REASONS} ELSE 'OTHER' END AS reason FROM x")
def claim_labels(t):
    c = F.col("text")
    return t("conversations").select("conv_id", "turn", X.claim_kind(c).alias("kind"), X.claim_modality(c).alias("modality"), X.terminal_reason(c).alias("reason"))


CHANNEL = r"""CASE WHEN trim(line) = '' THEN 'formatting' WHEN regexp_matches(line, '^\s*(#!?\[|@[A-Za-z])') THEN 'directive' WHEN regexp_matches(line, '^\s*(//|#|/\*|\*/|\*)') THEN 'comment' WHEN regexp_matches(line, '^[\s{}()\[\];,]*$') THEN 'formatting' ELSE 'executable' END"""


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, {CHANNEL} AS channel, count(*) AS n FROM l GROUP BY ALL")
def line_channels(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", X.channel(F.col("line")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT regexp_extract(line, '^\s*(?:fn\s+|def\s+|class\s+|struct\s+|enum\s+|impl\s+)?([A-Za-z_]\w*)', 1) AS anchor, count(*) AS n FROM l WHERE NOT regexp_matches(line, '^\s*(pub|async|unsafe|extern|use|import|from|#include)\s') GROUP BY ALL")
def line_anchors(t):
    lines = t("documents").select(F.explode(F.split("text", "\n")).alias("line")).filter(~F.col("line").rlike(r"^\s*(pub|async|unsafe|extern|use|import|from|#include)\s"))
    return lines.groupBy(X.anchor(F.col("line")).alias("anchor")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT p_partkey, p_brand AS grp, (p_size // 10) || '.' || (p_size % 10) || '.' || (p_partkey % 12) AS v FROM part)
SELECT grp, v AS newest FROM v QUALIFY row_number() OVER (PARTITION BY grp ORDER BY list_transform(string_split(v, '.'), lambda x: x::INT) DESC, v DESC) = 1""")
def newest_versions(t):
    v = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10, F.col("p_partkey") % 12)
    rows = t("part").select(F.col("p_brand").alias("grp"), v.alias("v"))
    return rows.groupBy("grp").agg(F.max_by("v", X.version_key(F.col("v"))).alias("newest"))


@query("""SELECT page_id, CASE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'py' THEN 'python' END AS language FROM pages""".replace("\\\\", "\\"))
def language_by_ending(t):
    return t("pages").select("page_id", X.language_of(F.regexp_replace("url", "[?#].*$", "")).alias("language"))


@query("SELECT p_partkey, sha256('a=' || p_name || chr(1) || 'b=' || coalesce(p_size::VARCHAR, '')) AS hash FROM part")
def record_hashes(t):
    return t("part").select("p_partkey", X.record_hash(b=F.col("p_size"), a=F.col("p_name")).alias("hash"))


@query(r"""WITH r AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s*([^\w\s])\s*', '\1', 'g'), '[ \t\r\n]+', ' ', 'g')) AS v FROM documents)
SELECT doc_id, md5(v) AS resolved, contains(v, 'the') AS correct FROM r""")
def resolved_texts(t):
    return t("documents").select("doc_id", F.md5(X.resolved(F.col("text"))).alias("resolved"), X.is_correct(F.col("text"), F.lit(" the ")).alias("correct"))


@query("SELECT source, key, count(*) AS n FROM (SELECT source, substr(sha256(to_json([coalesce(text, ''), lang])::VARCHAR), 1, 16) AS key FROM documents) GROUP BY ALL")
def content_keys(t):
    return t("documents").groupBy("source", X.content_key(F.col("text"), F.col("lang")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
