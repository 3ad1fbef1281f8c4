"""One-to-one pairing of rows that changed their name, and thinning of near-equal rows."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stats import running
from siltstone.functions.text import jaccard
from siltstone.functions.vectors import cosine
from siltstone.sources.scratch import written

#: Words of a row up to which several of them make a key, and such keys for each size of the other row at most.
SHORT, CHOICES = 10, 32
#: Pairs of members that a pair of classes stands for on average, up to which members are paired one by one.
SPREAD = 4


def greedy(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs taken by falling score (ties: smaller ids), each side used once. Pairs with a null side or score are left out, a pair that repeats counts once with its best score.

    A pair is taken if no better pair of its sides is. In each round those that are best for both sides are taken, and with
    them what follows along chains: a pair with one better neighbour is taken just if that isn't, so where each pair of a
    chain has one, every second is, which doubling finds in the logarithm of its length. Each round writes what is left.
    """
    left, taken = written(pairs.groupBy(a, b).agg(F.max(score).alias(score)).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(score).isNotNull()), "pairs"), None
    best_a, best_b = Window.partitionBy(a).orderBy(F.desc(score), b), Window.partitionBy(b).orderBy(F.desc(score), a)
    pair = F.struct(a, b)
    while left.limit(1).count():
        # _x, _y: places among the pairs of either side; of second places only the pair before matters
        ranked = left.withColumns({"_x": F.row_number().over(best_a), "_y": F.row_number().over(best_b), "_over_a": F.lag(pair).over(best_a), "_over_b": F.lag(pair).over(best_b)})
        up = F.when((F.col("_x") == 2) & (F.col("_y") == 1), F.col("_over_a")).when((F.col("_x") == 1) & (F.col("_y") == 2), F.col("_over_b"))
        chains = ranked.filter("_x + _y <= 3").select(pair.alias("pair"), score, up.alias("up"), up.isNotNull().alias("odd"))
        chains = written(chains, "chains")
        while True:
            above = chains.select(F.col("pair").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
            new = chains.join(above, "up", "left").select("pair", score, F.coalesce("_up", "up").alias("up"), F.when(F.col("_up").isNotNull(), F.col("odd") != F.col("_odd")).otherwise(F.col("odd")).alias("odd"), F.col("_up").isNotNull().alias("moved"))
            new = written(new, "chains")
            chains = new.drop("moved")
            if not new.filter("moved").limit(1).count():
                break
        # a chain that hangs on a pair with more than one better neighbour waits
        tops = chains.filter("up IS NULL").select(F.col("pair").alias("up"))
        won = chains.filter("up IS NULL").unionByName(chains.filter("NOT odd").join(tops, "up", "left_semi").select(*chains.columns))
        won = written(won.select(F.col(f"pair.{a}").alias(a), F.col(f"pair.{b}").alias(b), score), "won")
        taken = won if taken is None else taken.unionByName(won)
        left = written(left.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti"), "pairs")
    return pairs.select(a, b, score).limit(0) if taken is None else taken.select(a, b, score)


def repaired(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Renames on both sides of a three-way merge: ``kind, base_name, left_name, right_name``, from parts ``kind, name, body``.

    A part is gone from a side if the side has no part of its kind and name; it may be renamed there unless the other side
    kept it with the same body. It is renamed to a part that is new on that side, of the same kind and body; parts with
    equal bodies pair in order of their names, each once. A side that didn't rename the part has its name if it has the
    part, else null. Null or empty bodies never pair; names are taken as unique in a kind, repeated rows count once.
    """
    base, left, right = (x.filter(F.col("kind").isNotNull() & F.col("name").isNotNull()).groupBy("kind", "name").agg(F.min("body").alias("body")) for x in (base, left, right))
    sides = base.withColumnRenamed("body", "own")
    for side, rows in (("left", left), ("right", right)):
        sides = sides.join(rows.select("kind", "name", F.lit(True).alias(f"in_{side}"), F.col("body").alias(f"{side}_body")), ["kind", "name"], "left")
    sides = written(sides.withColumns({f"in_{s}": F.col(f"in_{s}").isNotNull() for s in ("left", "right")}), "sides")
    out = sides
    for side, other, rows in (("left", "right", left), ("right", "left", right)):
        gone = sides.filter(~F.col(f"in_{side}") & ~(F.col(f"in_{other}") & F.col(f"{other}_body").eqNullSafe(F.col("own")))).select("kind", "name", F.col("own").alias("body")).filter("body <> ''")
        come = rows.join(base.select("kind", "name"), ["kind", "name"], "left_anti").filter("body <> ''")
        places = [running(x, ["kind", "body"], ["name"], {"_i": F.lit(1).cast("long")}) for x in (gone, come)]
        met = places[0].select("kind", "body", "_i", "name").join(places[1].select("kind", "body", "_i", F.col("name").alias(f"{side}_new")), ["kind", "body", "_i"])
        out = out.join(met.select("kind", "name", f"{side}_new"), ["kind", "name"], "left")
    name = lambda s: F.coalesce(f"{s}_new", F.when(F.col(f"in_{s}"), F.col("name"))).alias(f"{s}_name")
    return out.filter("left_new IS NOT NULL OR right_new IS NOT NULL").select("kind", F.col("name").alias("base_name"), name("left"), name("right"))


def renames(old: DataFrame, new: DataFrame, least: float = 0.6, min_words: int = 2) -> DataFrame:
    """``kind, old_name, new_name, how`` for names (``kind, name, body, words``) that are gone from ``new`` and names that ``old`` lacks.

    Equal bodies pair first, in order of names; what is left pairs by the likeness of its words, if at least ``least``,
    best first, each name once. Bodies under ``min_words`` never pair. Rows with the same words are compared as one and
    taken in runs (``_runs``), so copies aren't paired with each other; see ``_alike`` for what is compared.
    """
    gone = old.join(new.select("kind", "name"), ["kind", "name"], "left_anti").filter(F.size("words") >= min_words)
    come = new.join(old.select("kind", "name"), ["kind", "name"], "left_anti").filter(F.size("words") >= min_words)
    rank = lambda df: df.withColumn("_i", F.row_number().over(Window.partitionBy("kind", "body").orderBy("name")))
    x = rank(gone).select("kind", "body", "_i", F.col("name").alias("old_name"))
    y = rank(come).select("kind", "body", "_i", F.col("name").alias("new_name"))
    equal = written(x.join(y, ["kind", "body", "_i"]).select("kind", "old_name", "new_name", F.lit("equal_body").alias("how")), "equal")
    rest_old = gone.join(equal.select("kind", F.col("old_name").alias("name")), ["kind", "name"], "left_anti")
    rest_new = come.join(equal.select("kind", F.col("new_name").alias("name")), ["kind", "name"], "left_anti")
    rest = [written(rows.select("kind", "name", F.sort_array("words").alias("words")), "rest") for rows in (rest_old, rest_new)]
    pair = lambda df: df.select(F.struct("kind", F.col("o").alias("name")).alias("o"), F.struct("kind", F.col("n").alias("name")).alias("n"), "score")
    fuzzy = None
    if any(rows.groupBy("kind", "name").count().filter("count > 1 OR name IS NULL").limit(1).count() for rows in rest):  # a name isn't one class's
        pairs = _alike(*(rows.withColumnRenamed("name", "id") for rows in rest), least)
    else:
        classes = [written(rows.groupBy("kind", "words").agg(F.min("name").alias("id"), F.count(F.lit(1)).alias("size")), "classes") for rows in rest]
        pairs = written(_alike(*(c.drop("size") for c in classes), least), "edges")
        ids = [c.filter("size > 1").select("kind", "words", "id") for c in classes]
        ranked = Window.partitionBy("kind", "id").orderBy("name")
        members = [written(rows.join(c, ["kind", "words"], "left").select("kind", F.coalesce("id", "name").alias("id"), "name").withColumn("i", F.row_number().over(ranked)), "members") for rows, c in zip(rest, ids, strict=True)]
        fuzzy, pairs = _runs(pairs, [c.select("kind", "id", "size") for c in classes], members)
    left = greedy(pair(pairs), "o", "n", "score").select(F.col("o.kind").alias("kind"), F.col("o.name").alias("old_name"), F.col("n.name").alias("new_name"))
    fuzzy = left if fuzzy is None else fuzzy.unionByName(left)
    return equal.unionByName(fuzzy.withColumn("how", F.lit("like_body")))


def _alike(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """``kind, o, n, score``: ids of rows (``kind, id, words``) of the same kind whose words are at least ``least`` alike.

    Words are ordered by how rare they are in their kind. Two rows of some sizes that are like enough share so many words;
    so they share several among the first few, and any choice of these is a key: of rows of up to ``SHORT`` words as many
    as give ``CHOICES`` keys at most, often all that they must share. Longer ones share one of their rarest. None is lost.
    """
    spark = old.sparkSession
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    said = both.select("kind", "side", "id", "words", F.explode("words").alias("w")).withColumn("w", F.coalesce("w", F.lit("\0")))
    df = said.groupBy("kind", "w").agg(F.count(F.lit(1)).alias("df"))
    rows = said.join(df, ["kind", "w"]).groupBy("kind", "side", "id", "words").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("rare"))
    rows = written(rows.withColumns({"rare": F.col("rare")["w"], "size": F.size("rare")}), "rare")
    table = []
    for n, m in itertools.product(range(1, SHORT + 1), repeat=2):
        share = math.ceil(least * (n + m) / (1 + least) - 1e-6)
        if share <= min(n, m):
            share = max(1, share)
            most = max(k for k in range(1, share + 1) if k == 1 or math.comb(max(n, m) - share + k, k) <= CHOICES)
            table += [(n, m, list(c)) for c in itertools.combinations(range(n - share + most), most)]
    table = spark.createDataFrame(table, "size int, other int, at array<int>")
    short = rows.join(F.broadcast(table), "size").withColumn("key", F.xxhash64(F.transform("at", lambda i: F.col("rare")[i]))).drop("at")
    first = F.slice("rare", 1, (F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1).cast("int"))
    long = rows.filter(F.col("size") > least * SHORT).withColumns({"other": F.lit(0), "key": F.explode(first)}).withColumn("key", F.xxhash64("key"))
    keys = short.unionByName(long).select("kind", "side", "id", "words", "size", "other", "key")
    x = keys.filter("side = 0").select("kind", F.col("id").alias("o"), F.col("words").alias("_o"), F.col("size").alias("_no"), "other", "key")
    y = keys.filter("side = 1").select(F.col("kind").alias("_kind"), F.col("id").alias("n"), F.col("words").alias("_n"), F.col("size").alias("_nn"), F.col("other").alias("_other"), F.col("key").alias("_key"))
    sizes = ((F.col("other") > 0) & (F.col("other") == F.col("_nn")) & (F.col("_other") == F.col("_no"))) | ((F.col("other") == 0) & (F.col("_other") == 0) & (F.greatest("_no", "_nn") > SHORT))
    met = x.join(y, (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")) & sizes)
    return met.withColumn("score", F.round(jaccard(F.col("_o"), F.col("_n")), 9)).filter(F.col("score") >= least).select("kind", "o", "n", "score").distinct()


def _runs(pairs: DataFrame, classes: list[DataFrame], members: list[DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """Of ``pairs`` of classes (``kind, o, n, score``): ``kind, old_name, new_name`` that ``greedy`` takes among their members, until what is left is hardly more as pairs of members; and these ``kind, o, n, score``.

    ``classes`` are ``kind, id, size`` of either side, ``members`` their names by rank ``i``. Members of a class are used in
    order. Where a pair of classes is the best of both (ties: the one with the smaller first name left), their next members
    pair in order until one class ends or the next name isn't smaller than the first one left of a class that ties.
    """
    left = [c.withColumn("used", F.lit(0).cast("long")) for c in classes]
    taken = None
    while True:
        heads = [c.filter("used < size").join(m.select("kind", "id", F.col("i").alias("_at"), F.col("name").alias("head")), ["kind", "id"]).filter("_at = used + 1").drop("_at") for c, m in zip(left, members, strict=True)]
        x, y = (h.select("kind", F.col("id").alias(s), F.col("head").alias(f"head_{s}"), F.col("used").alias(f"used_{s}"), (F.col("size") - F.col("used")).alias(f"rest_{s}")) for h, s in zip(heads, "on", strict=True))
        open_ = written(pairs.join(x, ["kind", "o"]).join(y, ["kind", "n"]), "open")
        pairs = open_.select("kind", "o", "n", "score")
        n, expanded = open_.agg(F.count(F.lit(1)), F.sum(F.col("rest_o").cast("double") * F.col("rest_n"))).first()
        if (expanded or 0) <= n * SPREAD:
            break
        over_o, over_n = Window.partitionBy("kind", "o").orderBy(F.desc("score"), "head_n"), Window.partitionBy("kind", "n").orderBy(F.desc("score"), "head_o")
        tie = lambda other, w: F.when(F.lead("score").over(w) == F.col("score"), F.lead(other).over(w))
        best = open_.withColumns({"_x": F.row_number().over(over_o), "_y": F.row_number().over(over_n), "tie_n": tie("head_n", over_o), "tie_o": tie("head_o", over_n)}).filter("_x = 1 AND _y = 1").drop("_x", "_y")
        best = written(best, "best")
        for s, m in zip("on", members, strict=True):  # members before the first one left of a class that ties
            upto = best.filter(F.col(f"tie_{s}").isNotNull()).select("kind", "o", "n", f"tie_{s}", f"used_{s}", F.col(s).alias("id")).join(m, ["kind", "id"])
            upto = upto.filter((F.col("i") > F.col(f"used_{s}")) & (F.col("name") < F.col(f"tie_{s}"))).groupBy("kind", "o", "n").agg(F.count(F.lit(1)).alias(f"upto_{s}"))
            best = best.join(upto, ["kind", "o", "n"], "left")
        best = written(best.withColumn("t", F.least("rest_o", "rest_n", "upto_o", "upto_n")).select("kind", "o", "n", "used_o", "used_n", "t"), "best")
        taken = best if taken is None else taken.unionByName(best)
        left = [written(c.join(best.select("kind", F.col(s).alias("id"), "t"), ["kind", "id"], "left").withColumn("used", F.col("used") + F.coalesce("t", F.lit(0))).drop("t"), "left") for c, s in zip(left, "on", strict=True)]
    a, b = (m.select("kind", F.col("id").alias(s), F.col("i").alias(f"i_{s}"), F.col("name").alias(f"name_{s}")) for m, s in zip(members, "on", strict=True))
    rows = open_.select("kind", "o", "n", "score", "used_o", "used_n").join(a, ["kind", "o"]).join(b, ["kind", "n"]).filter("i_o > used_o AND i_n > used_n")
    rows = rows.select("kind", F.col("name_o").alias("o"), F.col("name_n").alias("n"), "score")
    if taken is None:
        return None, rows
    some = taken.join(a, ["kind", "o"]).filter("i_o > used_o AND i_o <= used_o + t").withColumn("i_n", F.col("used_n") + F.col("i_o") - F.col("used_o"))
    return some.join(b.withColumn("i_n", F.col("i_n").cast("long")), ["kind", "n", "i_n"]).select("kind", F.col("name_o").alias("old_name"), F.col("name_n").alias("new_name")), rows


def thinned(rows: DataFrame, group: str, id_col: str, vec_col: str, weight: str, least: float = 0.9) -> DataFrame:
    """Rows of each group left after dropping those that a heavier row (ties: smaller id) of the group is at least ``least`` like, the heavier itself not having been dropped by that row.

    For groups of bounded size, such as the warnings of one check: a group's pairs are compared in the join.
    """
    a = rows.select(group, F.col(id_col).alias("a"), F.col(vec_col).alias("va"), F.col(weight).alias("wa"))
    b = rows.select(group, F.col(id_col).alias("b"), F.col(vec_col).alias("vb"), F.col(weight).alias("wb"))
    heavier = (F.col("wa") > F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b")))
    beaten = a.join(b, group).filter(heavier & (cosine(F.col("va"), F.col("vb")) >= least)).select(group, F.col("b").alias(id_col)).distinct()
    return rows.join(beaten, [group, id_col], "left_anti")
