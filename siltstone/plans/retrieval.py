"""Queries on ranked retrieval: benchmark items against documents, vectors against vectors."""

from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS
from siltstone.functions.vectors import cosine, nearest, unit
from siltstone.operators import retrieval as R
from siltstone.plans.registry import query

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def terms_sql(col: str) -> str:
    """SQL for the terms of identifiers; RE2 has no lookahead, so letters that start no term are cut off first."""
    split = rf"regexp_replace(regexp_replace(coalesce({col}, ''), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]([0-9_])', ' \1', 'g')"
    return f"list_filter(list_transform(regexp_extract_all({split}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({STOP}))"


BM25 = f"""
dt AS (SELECT doc_id AS id, {terms_sql("text")} AS w FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM dt) GROUP BY ALL),
dl AS (SELECT id, len(w) AS dl FROM dt),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({terms_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
bm AS (
  SELECT query_id, id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 9) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (id), tot GROUP BY ALL)"""


def _bm25(t, k):
    return R.bm25(t("documents"), t("benchmark"), k)


@query(f"WITH {BM25} SELECT query_id, id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 5")
def bm25_top5(t):
    return _bm25(t, 5).withColumn("score", F.round("score", 5))


@query(f"""WITH {BM25},
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm WHERE score > 0 QUALIFY r <= 6),
boost AS (SELECT query_id, id, CASE WHEN source = 'src0' THEN score * 1.1 ELSE score END AS score FROM pool JOIN documents ON doc_id = id)
SELECT query_id, id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM boost QUALIFY rank <= 3""")
def bm25_boosted_pool(t):
    scores = _bm25(t, 6).drop("rank").join(t("documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return R.boosted(scores, 3, F.col("source") == "src0").select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {BM25},
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 10),
f AS (SELECT doc_id AS id, n_chars % 5 AS retries FROM documents WHERE lang = 'en'),
k AS (SELECT query_id, id, score FROM a LEFT JOIN f USING (id) WHERE score >= 5 AND coalesce(retries, 1073741824) <= 2)
SELECT query_id, id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 3""")
def quality_filtered(t):
    facts = t("documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 5).alias("retries"))
    return R.filtered(_bm25(t, 10), facts, 5.0, 2, 3).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


COS = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 9) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


def _asked(t):
    return t("embeddings").filter("vec_id % 20 = 0")


@query(f"WITH {COS} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 5")
def cosine_top5(t):
    return nearest(_asked(t), t("embeddings"), 5).withColumn("score", F.round("score", 6))


@query(f"WITH {COS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 10) SELECT query_id, id, round(score, 6) AS score, rank FROM k WHERE score >= 0.3")
def cosine_floor_after_limit(t):
    return nearest(_asked(t), t("embeddings"), 10, floor=0.3).withColumn("score", F.round("score", 6))


LEX = f"""WITH {BM25}, {COS},
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 10),
sem AS (SELECT query_id // 20 AS query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 10))"""


def _both(t):
    sem = nearest(_asked(t), t("embeddings"), 10).withColumn("query_id", F.expr("query_id div 20"))
    return _bm25(t, 10), sem


@query(f"""{LEX}, u AS (SELECT query_id, id, round(coalesce(1.0 / (59 + lex.rank), 0) + coalesce(1.0 / (59 + sem.rank), 0), 9) AS score FROM lex FULL JOIN sem USING (query_id, id))
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u QUALIFY rank <= 5""")
def fusion_reciprocal_rank(t):
    lex, sem = _both(t)
    return R.fused(lex, sem, 5).withColumn("score", F.round("score", 6))


def _robust(name: str) -> str:
    return f"""(SELECT query_id, id, CASE WHEN mad <= 0 THEN 1.0 ELSE (greatest(-3.0, least(3.0, (score - mid) / mad)) + 3) / 6 END AS part
  FROM (SELECT *, median(abs(score - mid)) OVER (PARTITION BY query_id) AS mad FROM (SELECT *, median(score) OVER (PARTITION BY query_id) AS mid FROM {name})))"""


@query(f"""{LEX}, u AS (SELECT query_id, id, round(round(0.5 * coalesce(x.part, 0) + 0.5 * coalesce(y.part, 0), 9), 6) AS score FROM {_robust("lex")} x FULL JOIN {_robust("sem")} y USING (query_id, id))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u QUALIFY rank <= 5""")
def fusion_robust_scores(t):
    lex, sem = _both(t)
    out = R.fused(lex, sem, 1 << 30, "robust").withColumn("score", F.round("score", 6))
    return R.top(out.drop("rank"), 5)


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM n)
SELECT vec_id, round(norm, 6) AS norm, round(list_sum(list_transform(v, lambda x: x / norm)), 5) AS unit_sum FROM u""")
def unit_vectors(t):
    v = unit(F.col("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return t("embeddings").select("vec_id", F.round(length, 6).alias("norm"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("unit_sum"))


@query("""WITH c AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
k AS (SELECT label, list(m ORDER BY pos) AS m FROM c GROUP BY label)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], m) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS similarity FROM embeddings JOIN k USING (label)""")
def centroid_similarity(t):
    e = t("embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 5).alias("similarity"))
