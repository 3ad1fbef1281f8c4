"""Robust statistics as aggregations and joins: median, spread, trimming, distances between samples, monotone fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import written


def sigmoid(z: Column) -> Column:
    """Logistic function that never overflows."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def huber(r: Column, cutoff: float) -> Column:
    """Quadratic up to the cutoff, linear beyond it."""
    a = F.abs(r)
    return F.when(a <= cutoff, 0.5 * r * r).otherwise(cutoff * (a - 0.5 * cutoff))


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def dealt(rows: DataFrame, keys: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """``rows`` dealt by ``n`` ranges (as many as a shuffle has) of keys and order, with the number of their range, and written. Rows that are equal in both share a range; a large group has many."""
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = a["_range"] == b["_range"]
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def running(rows: DataFrame, keys: list[str], order: list[str], amounts: dict[str, Column], largest: bool = False) -> DataFrame:
    """``rows`` with each amount summed over the rows of the group up to and with those of equal ``order`` (under its name), and over the whole group (``_all`` behind its name); with ``largest``, the largest amount in place of the sum. Null keys are a group, null orders come first.

    No group is one task's: rows are dealt by ranges, each range is summed, and counts on from the sums of the ranges
    before it, of which there is one row for each range and group.
    """
    both, fold = (F.greatest, F.max) if largest else (lambda x, y: x + F.coalesce(y, F.lit(0)), F.sum)
    parts = dealt(rows.withColumns(amounts), keys, order)
    sums = parts.groupBy(*keys, "_range").agg(*[fold(a).alias(a) for a in amounts])
    before, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    base = sums.select(*keys, "_range", *[fold(a).over(before).alias(f"_{a}_before") for a in amounts], *[fold(a).over(whole).alias(f"{a}_all") for a in amounts])
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    parts = parts.withColumns({a: fold(a).over(within) for a in amounts})
    out = parts.join(base, _same(parts, base, keys))
    return out.select(*[parts[c] for c in rows.columns if c not in amounts], *[both(F.col(a), F.col(f"_{a}_before")).alias(a) for a in amounts], *[f"{a}_all" for a in amounts])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the exact quantiles of a column, interpolated between neighbouring values, from counts of its distinct values. Null values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    rows = running(counts, keys, ["_v"], {"_upto": F.col("_m")})
    at = lambda i: F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_m") <= i), F.col("_v")))
    place = {name: F.lit(float(q)) * (F.col("_upto_all") - 1) for name, q in shares.items()}
    found = rows.groupBy(*keys).agg(*[x for name, p in place.items() for x in (at(F.floor(p)).alias(f"_lo_{name}"), at(F.ceil(p)).alias(f"_hi_{name}"), F.max(p - F.floor(p)).alias(f"_t_{name}"))])
    return found.select(*keys, *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_t_{name}")).alias(name) for name in shares])


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: ``n, low, high, mean, mid`` (median) ``, mad`` (median absolute deviation) ``, mad_scaled``. Null values are left out. Medians are exact."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    base = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean")).join(quantiles(rows, keys, "v", {"mid": 0.5}), keys)
    off = quantiles(rows.join(base.select(*keys, "mid"), keys).withColumn("off", F.abs(F.col("v") - F.col("mid"))), keys, "off", {"mad": 0.5})
    return base.join(off, keys).withColumn("mad_scaled", F.col("mad") * 1.4826)


def trimmed(df: DataFrame, keys: list[str], value: str, share: float, tie: str) -> DataFrame:
    """The rows left after dropping floor(n * share) of the smallest and of the largest values of each group; ``tie`` orders equal values and is unique among them."""
    cut = F.floor(F.col("_i_all") * share)
    return running(df, keys, [value, tie], {"_i": F.lit(1)}).filter((F.col("_i") > cut) & (F.col("_i") <= F.col("_i_all") - cut)).drop("_i", "_i_all")


def ks(df: DataFrame, keys: list[str], value: str, in_first: Column) -> DataFrame:
    """Per group: the largest distance between the distributions of the values of two samples, ``in_first`` telling which; 0 if one is empty. Equal values advance together."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(in_first).alias("n1"), F.count_if(~in_first).alias("n2"))
    rows = running(counts, keys, [value], {"_a": F.col("n1"), "_b": F.col("n2")})
    gap = F.abs(F.try_divide(F.col("_a"), F.col("_a_all")) - F.try_divide(F.col("_b"), F.col("_b_all")))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


PIVOTS = 4


def shift(df: DataFrame, keys: list[str], value: str, in_first: Column, each: int = 64) -> DataFrame:
    """Per group: the median of all differences between a value of the first sample and one of the second (Hodges-Lehmann); no row where one is empty. Nulls and values that aren't finite are left out; a null key is a group.

    The differences aren't formed. Each value of the first sample has a window of ranks of the second sample's distinct
    values, at first all of them. A round draws a few differences from a group's windows, counts by one ordered pass how
    many differences lie below each, and narrows the windows to those between the two that enclose the middle. Once a
    group's windows hold at most ``each`` differences for each of its values, these are formed and ranked. The draws follow
    from hashes, so a round that is repeated gives the same. Differences that are equal but for rounding count as one place.
    """
    counts = df.filter(F.col(value).isNotNull() & in_first.isNotNull()).select(*keys, in_first.alias("_first"), F.col(value).cast("double").alias("_v"))
    counts = counts.filter(~F.isnan("_v") & (F.abs("_v") < float("inf"))).groupBy(*keys, "_first", "_v").agg(F.count(F.lit(1)).alias("_n"))
    names = [f"_k{i}" for i in range(len(keys))]
    counts = written(counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_first", "_v", "_n"), "samples")
    g = F.struct(F.lit(0).alias("_"), *names)  # nulls inside a struct are equal in joins
    second = written(running(counts.filter("NOT _first").select(g.alias("g"), "_v", "_n"), ["g"], ["_v"], {"_upto": F.col("_n"), "_rank": F.lit(1).cast("long")}), "second")
    size = second.groupBy("g").agg(F.max("_rank_all").alias("ranks"), F.max("_upto_all").alias("weight"))
    first = counts.filter("_first").select(g.alias("g"), F.col("_v").alias("x"), F.col("_n").alias("nx"))
    totals = first.groupBy("g").agg(F.count(F.lit(1)).alias("values"), F.sum("nx").alias("wx")).join(size, "g")
    totals = totals.select("g", (F.col("values") + F.col("ranks")).alias("values"), (F.col("wx") * F.col("weight")).alias("all"), "ranks")
    no = float("inf")
    windows = written(first.join(totals, "g").select("g", "x", "nx", F.lit(0).cast("long").alias("low"), F.col("ranks").alias("high"), F.lit(-no).alias("lo"), F.lit(no).alias("hi"), F.lit(0).cast("long").alias("below"), "values", "all"), "windows")
    done, rounds = [], 0
    while True:
        held = written(windows.groupBy("g").agg(F.sum(F.col("high") - F.col("low")).alias("pairs"), F.max("values").alias("values")).select("g", (F.col("pairs") <= each * F.col("values")).alias("small")), "held")
        done.append(windows.join(held.filter("small"), "g", "left_semi"))
        if not held.filter("NOT small").limit(1).count():
            break
        wide = windows.join(held.filter("NOT small"), "g", "left_semi")
        windows, rounds = written(_narrowed(wide, second, rounds), "windows"), rounds + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    step = 4096
    rows = rows.filter("high > low").select("*", F.explode(F.sequence(F.col("low") + 1, F.col("high"), F.lit(step).cast("long"))).alias("start"))
    rows = rows.select("g", "x", "nx", "below", "all", F.explode(F.sequence("start", F.least(F.col("start") + step - 1, F.col("high")))).alias("_rank"))
    diffs = rows.join(second.select("g", "_rank", "_v", "_n"), ["g", "_rank"]).groupBy("g", (F.col("x") - F.col("_v")).alias("_d")).agg(F.sum(F.col("nx") * F.col("_n")).alias("_w"), F.max("below").alias("below"), F.max("all").alias("all"))
    ranked = running(diffs, ["g"], ["_d"], {"_upto": F.col("_w")}).withColumn("_upto", F.col("_upto") + F.col("below"))
    at = lambda i: F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_w") <= i), F.col("_d")))
    last = F.col("all") - 1
    out = ranked.groupBy("g").agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("shift"))
    return out.select(*[F.col(f"g.{n}").alias(k) for k, n in zip(keys, names, strict=True)], "shift")


def _narrowed(windows: DataFrame, second: DataFrame, seed: int) -> DataFrame:
    """Windows with closer bounds. Differences are drawn evenly from all windows of a group: the least of -ln(u) / size is a window drawn by its size, a hash then is a rank in it."""
    size = F.col("high") - F.col("low")
    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "x"), F.lit(1 << 40)) + 1) / float(1 << 40)
    drawn = windows.filter("high > low").groupBy("g").agg(F.array(*[F.min_by(F.struct("x", (F.col("low") + 1 + F.pmod(F.xxhash64(F.lit(-1 - i), F.lit(seed), "x"), size)).alias("_rank")), -F.log(u(i)) / size) for i in range(PIVOTS)]).alias("drawn"))
    pivots = drawn.select("g", F.explode(F.array_distinct("drawn")).alias("d")).select("g", "d.*").join(second.select("g", "_rank", "_v"), ["g", "_rank"]).select("g", (F.col("x") - F.col("_v")).alias("t"))
    ends = windows.groupBy("g").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    bounds = pivots.groupBy("g").agg(F.collect_set("t").alias("ts")).join(ends, "g").select("g", F.array_distinct(F.concat("ts", F.array("lo", "hi"))).alias("ts"))
    # a probe before the values equal to it counts the smaller ones, a probe behind them those and the equal ones
    asked = windows.select("g", "x", "nx", "values", "all").join(bounds, "g").select("*", F.explode("ts").alias("t")).select("*", F.explode(F.array(F.lit(0), F.lit(2))).alias("side"))
    probes = asked.select("g", (F.col("x") - F.col("t")).alias("_v"), "side", F.struct("x", "nx", "values", "all", "t").alias("q"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("n"))
    known = second.select("g", "_v", F.lit(1).alias("side"), F.lit(None).cast(probes.schema["q"].dataType).alias("q"), F.col("_n").alias("w"), F.lit(1).cast("long").alias("n"))
    met = running(probes.unionByName(known), ["g"], ["_v", "side"], {"_upto": F.col("w"), "_rank": F.col("n")}).filter("side <> 1")
    met = written(met.select("g", "q.*", "side", "_upto", "_rank", (F.col("_upto_all") - F.col("_upto")).alias("above")), "probes")
    # of the second sample, larger values make smaller differences
    sums = met.groupBy("g", "t", "side").agg(F.sum(F.col("nx") * F.col("above")).alias("n"), F.max("all").alias("all"))
    first, last = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    lower, upper = (F.col("side") == 2) & (F.col("n") <= first), (F.col("side") == 0) & (F.col("n") > last)
    new = sums.groupBy("g").agg(F.max(F.when(lower, F.col("t"))).alias("lo"), F.min(F.when(upper, F.col("t"))).alias("hi"), F.max(F.when(lower, F.struct("t", "n")))["n"].alias("below"))
    rows = met.join(new, "g").filter("(side = 2 AND t = lo) OR (side = 0 AND t = hi)")
    return rows.groupBy("g", "x").agg(F.max("nx").alias("nx"), F.max(F.when(F.col("side") == 0, F.col("_rank"))).alias("low"), F.max(F.when(F.col("side") == 2, F.col("_rank"))).alias("high"), *[F.max(c).alias(c) for c in ("lo", "hi", "below", "values", "all")])


def gap_threshold(df: DataFrame, keys: list[str], score: str, related: Column, tie: str) -> DataFrame:
    """Per group: the middle of the widest gap between neighbouring scores of different class; the middle of the two medians if no such gap is wider than 0, or the one median if there is one class. ``tie`` orders equal scores."""
    rows = df.filter(F.col(score).isNotNull()).select(*keys, F.col(score).alias("s"), related.alias("r"), F.col(tie).alias("_t"))
    # of equal scores the first has the score before as its neighbour, the last the score after
    ends = dealt(rows.groupBy(*keys, "s").agg(F.min_by("r", "_t").alias("first"), F.max_by("r", "_t").alias("last")), keys, ["s"])
    heads = ends.groupBy(*keys, "_range").agg(F.min(F.struct("s", "first")).alias("head"))
    after = heads.select(*keys, "_range", F.lead("head").over(Window.partitionBy(*keys).orderBy("_range")).alias("after"))
    within = Window.partitionBy(*keys, "_range").orderBy("s")
    near = ends.withColumn("next", F.lead(F.struct("s", "first")).over(within))
    near = near.join(after, _same(near, after, keys)).select(*[near[k] for k in keys], "s", "last", F.coalesce("next", "after").alias("next"))
    gaps = near.filter((F.col("next.first") != F.col("last")) & (F.col("next.s") > F.col("s")))
    gaps = gaps.groupBy(*keys).agg(F.max(F.struct((F.col("next.s") - F.col("s")).alias("gap"), (-F.col("s")).alias("least"), ((F.col("next.s") + F.col("s")) / 2).alias("mid"))).alias("best"))
    mids = rows.select(*keys).distinct().join(quantiles(rows.filter("r"), keys, "s", {"a": 0.5}), keys, "left").join(quantiles(rows.filter("NOT r"), keys, "s", {"b": 0.5}), keys, "left")
    both = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a"))
    return mids.join(gaps, keys, "left").select(*keys, both.otherwise(F.coalesce("best.mid", (F.col("a") + F.col("b")) / 2)).alias("threshold"))


def _pool(sums: list[float], weights: list[float]) -> list[int]:
    """How many points each block has after pooling adjacent violators."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, weights, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-1][0] / blocks[-1][1] < blocks[-2][0] / blocks[-2][1] - 1e-12:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return [int(b[2]) for b in blocks]


PIECE = 65_536


def pooled(df: DataFrame, x: str, y: str, weight: str | None = None, keys: list[str] | None = None, each: int = 250_000) -> DataFrame:
    """Monotone fit by pooling adjacent violators: ``x, fitted`` per distinct x of each group. Rows with a null or without a positive weight are left out; a null key is a group.

    Equal x are pooled first, by a grouping with map-side combination. Then the points are dealt by ranges of x, of about
    ``each`` points but no more than a shuffle has, and each range is pooled by itself. The fit of the whole group is that
    of the ranges, held between the slopes with which the lower hull of the running sums crosses into a range and out of it.
    """
    keys = keys or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.sum(w * F.col(y)).alias("s"), F.sum(w).alias("w")).filter("w > 0")
    names = [f"_k{i}" for i in range(len(keys))]
    points = written(points.select(F.struct(F.lit(0).alias("_"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).alias("g"), "x", "s", "w"), "points")
    kind = points.schema["g"].dataType.simpleString()
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = dealt(points, ["g"], ["x"], max(1, min(most, -(-points.count() // each))))
    whole = parts.groupBy("g").agg((F.sum("s") / F.sum("w")).alias("mean"))
    parts = parts.join(whole, "g").withColumn("s", F.col("s") - F.col("mean") * F.col("w"))  # small running sums lose no digits

    def in_range(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x").reset_index(drop=True)
        size = _pool(part["s"].tolist(), part["w"].tolist())
        number = np.repeat(np.arange(len(size)), size)
        total = np.bincount(number, part["s"]) / np.bincount(number, part["w"])
        return part.assign(own=total[number], block=number)

    first = parts.select("g", "_range", F.to_json("g", {"ignoreNullFields": "false"}).alias("_name"), "x", "s", "w", "mean")
    first = first.groupBy("_name", "_range").applyInPandas(lambda p: in_range(p)[["g", "_range", "x", "s", "w", "mean", "own", "block"]], f"g {kind}, _range int, x double, s double, w double, mean double, own double, block long")
    first = written(first, "pooled")
    slopes = _crossings(first)
    held = F.col("own")
    if slopes is not None:
        first = first.join(slopes, ["g", "_range"], "left")
        held = F.greatest(F.least("own", "outward"), "inward")  # a null is no bound
    return first.select(*[F.col(f"g.{n}").alias(k) for k, n in zip(keys, names, strict=True)], "x", (held + F.col("mean")).alias("fitted"))


def _crossings(first: DataFrame, rounds: int = 200) -> DataFrame | None:
    """``g, _range, inward, outward``: the slopes with which the lower hull of a group's running sums crosses the borders of its ranges; None if every group is one range.

    The slope at a border is that of the one line that touches the sums on both sides. At a slope t the least of C - t W
    (running sum and weight) over the sums of a side is where a line of that slope touches it, and the difference of the
    two sides' least values rises with t: so each round tries, at all borders at once, the lines through the touching
    points of both bounds and the middle of the bounds. A range answers for its own sums from its blocks. Only borders,
    fewer than the ranges of a shuffle, pass through the driver.
    """
    spark = first.sparkSession
    sums = first.groupBy("g", "_range").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    before = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "_range", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("c0"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("ranges"))
    sums = written(sums.filter("ranges > 1"), "range-sums")
    ranges: dict[str, list[int]] = {}
    for r in sums.select(F.to_json("g", {"ignoreNullFields": "false"}).alias("name"), "_range").orderBy("_range").collect():
        ranges.setdefault(r["name"], []).append(r["_range"])
    if not ranges:
        return None
    blocks = first.join(sums, ["g", "_range"]).groupBy("g", "_range", "block").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.max("own").alias("own"), F.max("c0").alias("c0"), F.max("w0").alias("w0"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        c, w = part["c0"].iloc[0] + np.cumsum(part["s"].to_numpy()), part["w0"].iloc[0] + np.cumsum(part["w"].to_numpy())
        own, at = part["own"].to_numpy(), range(0, len(part), PIECE)
        return pd.DataFrame({"name": part["_name"].iloc[0], "range": int(part["_range"].iloc[0]), "own": [own[i : i + PIECE] for i in at], "c": [c[i : i + PIECE] for i in at], "w": [w[i : i + PIECE] for i in at]})

    pieces = blocks.select(F.to_json("g", {"ignoreNullFields": "false"}).alias("_name"), "_range", "block", "s", "w", "own", "c0", "w0")
    pieces = written(pieces.groupBy("_name", "_range").applyInPandas(pack, "name string, range int, own array<double>, c array<double>, w array<double>"), "hulls")

    def touched(asked: dict[tuple[str, int], list[float]]):
        by_name: dict[str, list[tuple[int, float]]] = {}
        for (name, border), ts in asked.items():
            by_name.setdefault(name, []).extend((border, t) for t in ts)
        sent = spark.sparkContext.broadcast(by_name)

        def answer(frames):
            for frame in frames:
                for name, number, own, c, w in zip(frame["name"], frame["range"], frame["own"], frame["c"], frame["w"], strict=True):
                    if name not in sent.value:
                        continue
                    border, t = (np.array(v) for v in zip(*sent.value[name], strict=True))
                    at = np.maximum(np.searchsorted(own, t), 1) - 1  # blocks under the slope lead down, the first one's end is the least there is
                    left = number <= border
                    yield pd.DataFrame({"name": name, "border": border, "t": t, "left": left, "f": c[at] - t * w[at], "c": c[at], "w": w[at]})

        got = pieces.mapInPandas(answer, "name string, border int, t double, left boolean, f double, c double, w double")
        out = got.groupBy("name", "border", "t", "left").agg(F.min(F.struct("f", "w", "c")).alias("p")).collect()
        sent.unpersist()
        return out

    bounds = {(name, i): [None, None] for name, numbers in ranges.items() for i in numbers[:-1]}
    found: dict[tuple[str, int], float] = {}
    asked = {b: [0.0] for b in bounds}
    for _ in range(rounds):
        sides: dict[tuple[str, int, float], dict[bool, tuple[float, float, float]]] = {}
        for r in touched(asked):
            sides.setdefault((r["name"], r["border"], r["t"]), {})[r["left"]] = (r["p"]["f"], r["p"]["c"], r["p"]["w"])
        for (name, border, t), side in sides.items():
            if (name, border) in found:
                continue
            f, c, w = min(side[True], (0.0, 0.0, 0.0))  # the sums begin at 0
            h, d, v = side[False]
            line = (d - c) / (v - w)
            if abs(f - h) <= 1e-13 * max(1.0, abs(f), abs(t * v)):
                found[name, border] = line
                continue
            ends, above = bounds[name, border], int(f > h)
            if ends[above] is None or (t < ends[above][0]) == bool(above):
                ends[above] = (t, line)
        asked = {}
        for b, (lo, hi) in bounds.items():
            if b in found:
                continue
            least, most = lo[0] if lo else -np.inf, hi[0] if hi else np.inf
            tries = {line for end in (lo, hi) if end for line in end[1:] if least < line < most}
            if lo and hi and least < (least + most) / 2 < most:
                tries.add((least + most) / 2)
            if tries:
                asked[b] = sorted(tries)
            else:
                found[b] = lo[1] if lo else hi[1]
        if not asked:
            break
    else:
        raise ArithmeticError("slopes at borders of ranges weren't found")
    rows = [(name, r, found.get((name, numbers[i - 1])) if i else None, found.get((name, r))) for name, numbers in ranges.items() for i, r in enumerate(numbers)]
    made = spark.createDataFrame(rows, "name string, _range int, inward double, outward double")
    return made.join(sums.select("g", "_range", F.to_json("g", {"ignoreNullFields": "false"}).alias("name")), ["name", "_range"]).drop("name")


def evaluated(rows: DataFrame, x: str, fit: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with ``fitted``, the value of a monotone fit (``keys, x, fitted``) at their ``x``: constant inside a block, linear between blocks, the nearest end's beyond them; 0 without points, null for a null ``x``.

    Rows and points are dealt by ranges together; a range takes the nearest points that it lacks from the ranges around it.
    """
    keys = keys or []
    point = F.struct("x", "fitted")
    own = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(x).cast("double").alias("_x"), F.struct(*rows.columns).alias("row"), F.lit(None).cast(fit.select(point.alias("p")).schema["p"].dataType).alias("p"))
    seen = fit.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("x").alias("_x"), F.lit(None).cast(own.schema["row"].dataType).alias("row"), point.alias("p"))
    groups = [f"_k{i}" for i in range(len(keys))]
    parts = dealt(own.unionByName(seen), groups, ["_x"])
    ends = parts.groupBy(*groups, "_range").agg(F.min("p").alias("least"), F.max("p").alias("most"))
    back, ahead = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*groups, "_range", F.max("most").over(back).alias("before"), F.min("least").over(ahead).alias("after"))
    upto, onward = Window.partitionBy(*groups, "_range").orderBy("_x"), Window.partitionBy(*groups, "_range").orderBy(F.desc("_x"))
    near = parts.withColumns({"lo": F.max("p").over(upto), "hi": F.min("p").over(onward)})
    near = near.join(ends, _same(near, ends, groups)).filter("row IS NOT NULL").select("row", "_x", F.coalesce("lo", "before").alias("lo"), F.coalesce("hi", "after").alias("hi"))
    slope = (F.col("hi.fitted") - F.col("lo.fitted")) / (F.col("hi.x") - F.col("lo.x"))
    value = F.when(F.col("lo").isNull() & F.col("hi").isNull(), 0.0).when(F.col("lo").isNull(), F.col("hi.fitted")).when(F.col("hi").isNull() | (F.col("hi.x") <= F.col("lo.x")), F.col("lo.fitted")).otherwise(F.col("lo.fitted") + slope * (F.col("_x") - F.col("lo.x")))
    return near.select("row.*", F.when(F.col("_x").isNotNull(), value).alias("fitted"))


def pooled_robust(df: DataFrame, x: str, y: str, cutoff: float | None = None, rounds: int = 10, close: float = 1e-4) -> DataFrame:
    """Monotone fit under Huber loss: ``x, fitted``.

    Fits and weights by turns: points whose residual is over the cutoff weigh in proportion less. The cutoff is 1.345 times
    the scaled median absolute deviation of the first fit's residuals (1.345 where that is 0), unless given. It ends when
    no weight moves by ``close``, or after ``rounds``.
    """
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w"))
    for _ in range(rounds):
        fit = pooled(points, "x", "y", "w")
        rows = written(points.join(fit, "x").withColumn("r", F.col("y") - F.col("fitted")), "weighted")
        if cutoff is None:
            mad = spread(rows.withColumn("all", F.lit(1)), ["all"], "r").first()
            cutoff = 1.345 * mad["mad_scaled"] if mad and mad["mad_scaled"] else 1.345
        new = F.least(F.lit(1.0), F.lit(cutoff) / (F.abs("r") + 1e-12))
        moved = rows.agg(F.max(F.abs(new - F.col("w"))).alias("m")).first()["m"]
        points = rows.select("x", "y", new.alias("w"))
        if moved is None or moved < close:
            break
    return pooled(points, "x", "y", "w")
