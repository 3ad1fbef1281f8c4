"""Union of paths: what one side has and the other lacks is added behind what it belongs to, unless that isn't safe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import written


def path_union(have: DataFrame, want: DataFrame, domain: list[str]) -> DataFrame:
    """``scope, path, dest, outcome`` for each distinct wanted path that its scope lacks.

    Both have ``scope, path`` (an array) ``, name`` (what it binds, null for nothing) ``, kind`` and the columns of
    ``domain``; ``have`` has the number ``line`` of the line that holds it, too. A path belongs to the first line that
    has a path starting with all of the wanted one but its last part. Outcomes: ``glob`` (of that kind: never added),
    ``no_prefix`` (a single part), ``no_destination``, ``other_domain`` (the line has no path of the same domain),
    ``collision`` (the line, or another path that is added to it, binds the same name to another path; none of those that
    collide is added), ``added``. Wanted paths that agree in path but differ in name, kind or domain are rows of their own; null
    paths are left out.

    Prefixes are exploded on the side that has them, once for each line, and met by an equi-join, so a scope with most of
    the paths is dealt by prefix.
    """
    own = have.select("scope", F.col("path").alias("_path")).distinct()
    on = want["scope"].eqNullSafe(own["scope"]) & (want["path"] == own["_path"])
    missing = want.filter("path IS NOT NULL").distinct().join(own, on, "left_anti").withColumn("prefix", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    missing = written(missing, "missing")
    heads = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    firsts = have.filter(F.size("path") > 0).select("scope", F.explode(heads).alias("prefix"), "line").groupBy("scope", "prefix").agg(F.min("line").alias("dest"))
    asked = missing.filter("NOT kind <=> 'glob' AND size(path) > 1")
    left, right = asked.alias("a"), firsts.alias("f")
    placed = left.join(right, F.col("a.scope").eqNullSafe(F.col("f.scope")) & (F.col("a.prefix") == F.col("f.prefix")), "left").select("a.*", "dest")
    placed = written(placed, "placed")
    lines = have.groupBy("scope", F.col("line").alias("dest")).agg(F.collect_set(F.struct(*domain)).alias("domains"))  # of a line's paths
    a, b = placed.filter("dest IS NOT NULL").alias("a"), lines.alias("b")
    gated = a.join(b, F.col("a.scope").eqNullSafe(F.col("b.scope")) & (F.col("a.dest") == F.col("b.dest"))).select("a.*", F.array_contains("domains", F.struct(*domain)).alias("fits"))
    fits = written(gated.filter("fits").drop("fits"), "fits")
    bound = have.filter("name IS NOT NULL").select("scope", F.col("line").alias("dest"), "name", "path").unionByName(fits.filter("name IS NOT NULL").select("scope", "dest", "name", "path")).distinct()
    taken = bound.groupBy("scope", "dest", "name").agg(F.count(F.lit(1)).alias("paths")).filter("paths > 1").drop("paths").alias("t")
    f = fits.alias("f")
    clash = F.col("f.scope").eqNullSafe(F.col("t.scope")) & (F.col("f.dest") == F.col("t.dest")) & (F.col("f.name") == F.col("t.name"))
    done = f.join(taken, clash, "left").select("f.scope", "f.path", "f.dest", F.when(F.col("t.name").isNotNull(), "collision").otherwise("added").alias("outcome"))
    say = lambda rows, what: rows.select("scope", "path", F.col("dest") if "dest" in rows.columns else F.lit(None).cast(have.schema["line"].dataType).alias("dest"), F.lit(what).alias("outcome"))
    rest = say(missing.filter("kind = 'glob'"), "glob").unionByName(say(missing.filter("NOT kind <=> 'glob' AND size(path) <= 1"), "no_prefix"))
    return done.unionByName(rest).unionByName(say(placed.filter("dest IS NULL"), "no_destination")).unionByName(say(gated.filter("NOT fits"), "other_domain"))
