"""URL filtering by rules and, where none fits, by the likelihood ratio of two character language models.

The models are learned from the URLs on which the rules decide: one from those allowed, one from those blocked. Both are
variable-order Markov models over characters, smoothed by backing off to shorter contexts. A URL's score is the
difference of its log-likelihoods per character; the threshold is calibrated on decided URLs kept out of the counts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, UPPER, lean, table, written

#: Rules of the registered query: host and path, and whether they allow.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
ORDER = 5
BINS = 400
SCALE = 1e10


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty for null or a URL without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a host and path, or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    found: Column | None = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found.otherwise(F.lit(None).cast("string"))


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``label, gram, n``: how often each run of up to ``order + 1`` characters occurs in the URLs of each label, over all rows. A URL starts with ``order`` starts of text and ends with one end."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], ["label", "gram", "n"])

        for batch in batches:
            for url, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = padded(url, order)
                held.update((label, text[i - k : i + 1]) for i in range(order, len(text)) for k in range(order + 1))
                if len(held) > 200_000:
                    yield out()
                    held.clear()
        yield out()

    return urls.select("url", "label").mapInArrow(run, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def padded(url: str, order: int) -> str:
    return "\x02" * order + url.translate(str.maketrans(UPPER, LOWER)) + "\x03"


class Ratio:
    """Log-likelihood difference per character of the allowing and the blocking model, for counts that fit in memory; ``scores`` gives the same of all counts."""

    def __init__(self, rows: list[tuple[str, str, int]], order: int, weight: float = 4.0):
        self.order, self.weight = order, weight
        self.n: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
        self.total: dict[str, dict[str, int]] = {"allow": defaultdict(int), "block": defaultdict(int)}
        for label, gram, n in rows:
            self.n[label][gram] = n
            self.total[label][gram[:-1]] += n
        self.memo: dict[str, float] = {}

    def _p(self, label: str, gram: str) -> float:
        p = 1 / 256
        for k in range(len(gram)):
            part = gram[len(gram) - 1 - k :]
            seen = self.total[label].get(part[:-1], 0)
            if not seen:
                break
            p = (self.n[label].get(part, 0) + self.weight * p) / (seen + self.weight)
        return p

    def score(self, url: str) -> float:
        text = padded(url, self.order)
        total = 0.0
        for i in range(self.order, len(text)):
            gram = text[i - self.order : i + 1]
            got = self.memo.get(gram)
            if got is None:
                if len(self.memo) > 300_000:
                    self.memo.clear()
                got = self.memo[gram] = math.log(self._p("allow", gram) / self._p("block", gram))
            total += got
        return total / (len(text) - self.order)


def asked_runs(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``row, gram, n``: the runs of ``order + 1`` characters of each URL, which has one for each of its characters and its end; ``urls`` has ``row`` and a non-null ``url``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        found: list[str] = []
        times: list[int] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string()), pa.array(times, pa.int64())], ["row", "gram", "n"])

        for batch in batches:
            for row, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = padded(url, order)
                held = Counter(text[i - order : i + 1] for i in range(order, len(text)))
                rows += [row] * len(held)
                found += held
                times += held.values()
                if len(rows) > 100_000:
                    yield out()
                    rows.clear(), found.clear(), times.clear()
        yield out()

    return urls.select("row", "url").mapInArrow(run, "row long, gram string, n long")


def ratios(asked: DataFrame, counts: DataFrame, order: int = ORDER, weight: float = 4.0) -> DataFrame:
    """``gram, ratio``: ``Ratio``'s log-likelihood difference of each distinct run of ``asked``, from all counts, by joins; no count is left out or sent anywhere whole."""
    labels = ("allow", "block")
    known = written(counts.groupBy("gram").agg(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(x) for x in labels]), "counts")
    totals = written(known.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(*[F.sum(x).alias(f"{x}_of") for x in labels]), "totals")
    parts = written(asked.select("gram").distinct(), "asked").select("gram", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"))
    parts = parts.withColumn("part", F.expr("right(gram, k + 1)")).withColumn("context", F.expr("left(part, k)"))
    parts = parts.join(known.withColumnRenamed("gram", "part"), "part", "left").join(totals, "context", "left")
    steps = parts.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", *labels, *[f"{x}_of" for x in labels]))).alias("steps"))  # order + 1 of each run

    def p(label: str) -> Column:
        return F.aggregate("steps", F.lit(1 / 256), lambda p, s: F.when(s[f"{label}_of"] > 0, (F.coalesce(s[label], F.lit(0)) + weight * p) / (s[f"{label}_of"] + weight)).otherwise(p))

    return steps.select("gram", F.log(p("allow") / p("block")).alias("ratio"))


def scores(urls: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``row, score`` of each URL. The runs' ratios are summed as whole numbers of ``1 / SCALE``, so no order of rows changes a score."""
    asked = written(asked_runs(urls, order), "runs")
    ratio = written(ratios(asked, counts, order), "ratios")
    total = F.sum(F.col("n") * F.round(F.col("ratio") * SCALE).cast("long"))
    return asked.join(ratio, "gram").groupBy("row").agg((total / F.sum("n") / SCALE).alias("score"))


def judge(pages: DataFrame, rules: dict[str, str], order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row.

    A rule's verdict holds where one fits; elsewhere the models' does. Null urls and such without ``://`` have an empty
    host and path and are judged by the models as they are (null: empty). ``score`` is null where a rule fits. If the
    rules allow nothing or block nothing, the models have nothing to tell apart, and the rest is allowed. Repeated rows
    are each returned; other columns are not read.

    Counts cover all decided URLs except a fifth (by CRC-32) kept for calibration; if a label has URLs in that fifth
    only, all are counted and none calibrate. Every count takes part in the scores: URLs are cut into runs, whose ratios
    come from joins with the counts. The threshold is the one that errs least on average over both labels, from a
    histogram.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.create_map(*[F.lit(x) for item in rules.items() for x in item])[F.col("rule")] if rules else F.lit(None).cast("string")
    rows = rows.withColumn("label", verdict)
    decided = rows.filter("rule IS NOT NULL").select("url", "label")
    kept = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    tally = decided.groupBy("label").agg(F.sum(F.when(kept, 0).otherwise(1)).alias("counted")).collect()
    if len(tally) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("label", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    if not all(r["counted"] for r in tally):
        kept = F.lit(False)
    counts = written(grams(decided.filter(~kept), order), "grams")
    # the number of a row is fixed by writing it
    asked = written(rows.filter(F.col("rule").isNull() | kept).withColumn("row", F.monotonically_increasing_id()), "urls")
    scored = written(scores(asked, counts, order), "scores")
    bins = asked.filter("rule IS NOT NULL").join(scored, "row").select("label", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") * 100))).alias("bin"))
    cut = threshold([(r["label"], r["bin"], r["n"]) for r in bins.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")).collect()])
    named = rows.filter("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("label").alias("verdict"), F.lit(None).cast("double").alias("score"))
    rest = asked.filter("rule IS NULL").join(scored, "row")
    rest = rest.select("page_id", "host", "path", "rule", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict"), "score")
    return named.unionByName(rest)


def threshold(bins: list[tuple[str, int, int]]) -> float:
    """The cut between score bins (hundredths) with the least mean error of both labels; of equal ones that nearest to 0."""
    total = Counter()
    for label, _, n in bins:
        total[label] += n
    if len(total) < 2:
        return 0.0

    def errors(cut: int) -> float:
        wrong = Counter()
        for label, b, n in bins:
            if (b >= cut) != (label == "allow"):
                wrong[label] += n
        return sum(wrong[k] / total[k] for k in total)

    return min(range(-BINS, BINS + 1), key=lambda c: (round(errors(c), 9), abs(c), c)) / 100


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every page's URL, judged."""
    return judge(table(spark, sf_dir, "pages"), RULES)
