"""Unions of what two sides add: lines inserted between those of a base, entries of lists that a line holds, named items of containers; each says why where it does nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.alignment import aligned, opcodes, shared

# Lines that hold a list: what is before it (with the list's name inside), its entries, what is behind it.
ATTRIBUTE = r"^(\s*#!?\[\s*([\w:]+)\()([^()]*)(\)\]\s*)$"
SETTING = r"^(\s*([\w.-]+)\s*=\s*\[)([^\[\]]*)(\]\s*)$"


def inserted(blocks: Column, base: Column, side: Column, number: int) -> Column:
    """The runs that a side puts between the base's elements: ``at`` (the base's element behind the run), ``side``, ``lines``; null if an element of the base is gone or changed."""
    runs = F.filter(opcodes(blocks, F.size(base), F.size(side)), lambda x: x["tag"] == "insert")
    cut = F.transform(runs, lambda x: F.struct(x["i1"].alias("at"), F.lit(number).alias("side"), F.slice(side, x["j1"] + 1, x["j2"] - x["j1"]).alias("lines")))
    return F.when(shared(blocks) == F.size(base), cut)


def insertion_union(rows: DataFrame, base: str = "base", current: str = "current", replayed: str = "replayed", directive: str | None = None) -> DataFrame:
    """``rows`` with ``merged`` (lines, or null) and ``reason``, from three arrays of lines.

    ``inserted``: both sides only insert, and share no inserted line that isn't blank; each run stands before the base's line
    that it was put before, the current side's first. ``directives``: they share some, both insert, and all that is
    inserted matches ``directive``: each line once, at the first place of all. Else ``shared``, or ``edited`` where a line
    of the base is gone. Null arrays count as empty. Names that start with ``_`` and ``blocks`` are taken.
    """
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in (base, current, replayed)})
    both = aligned(aligned(rows, base, current).withColumnRenamed("blocks", "_cur"), base, replayed).withColumnRenamed("blocks", "_rep")
    b = F.col(base)
    both = both.withColumns({"_x": inserted(F.col("_cur"), b, F.col(current), 0), "_y": inserted(F.col("_rep"), b, F.col(replayed), 1)})
    flat = lambda c: F.flatten(F.transform(c, lambda r: r["lines"]))
    both = both.withColumns({"_p": flat("_x"), "_q": flat("_y")})
    said = lambda c: F.filter(c, lambda x: x.rlike(r"\S"))
    clash = F.arrays_overlap(said("_p"), said("_q"))
    places = F.transform(b, lambda x, i: F.struct(i.alias("at"), F.lit(2).alias("side"), F.array(x).alias("lines")))
    woven = F.flatten(F.transform(F.array_sort(F.concat("_x", "_y", places)), lambda r: r["lines"]))
    only = F.lit(False) if directive is None else F.forall(F.concat("_p", "_q"), lambda x: x.rlike(directive)) & (F.size("_p") > 0) & (F.size("_q") > 0)
    reason = F.when(F.col("_x").isNull() | F.col("_y").isNull(), "edited").when(~clash, "inserted").when(only, "directives").otherwise("shared")
    both = both.withColumn("reason", reason)
    at = F.array_min(F.transform(F.concat("_x", "_y"), lambda r: r["at"]))
    once = F.concat(F.slice(b, F.lit(1), at), F.array_union("_p", "_q"), F.slice(b, at + 1, F.size(b)))
    merged = F.when(F.col("reason") == "inserted", woven).when(F.col("reason") == "directives", once)
    return both.withColumn("merged", merged).drop("_cur", "_rep", "_x", "_y", "_p", "_q")


def listed(line: Column, pattern: str = ATTRIBUTE) -> Column:
    """The list that a line holds: its ``name`` (empty if it holds none) and ``entries``, each once and trimmed."""
    parts = F.transform(F.split(F.regexp_extract(line, pattern, 3), ","), lambda x: F.trim(x))
    return F.struct(F.regexp_extract(line, pattern, 2).alias("name"), F.array_distinct(F.filter(parts, lambda x: x != "")).alias("entries"))


def list_line_union(lines: Column, missing: Column, pattern: str = ATTRIBUTE, names: tuple[str, ...] | None = None) -> Column:
    """``lines, closed, left``: lists of ``lines`` with the entries that lists of the same name in ``missing`` have and they lack, in that order; which missing lines are done, and which are left.

    A missing line is left if it holds no list, its name isn't in ``names`` (where given), or ``lines`` has no list of its
    name or several. Lists over more than one line aren't seen. Nulls count as empty.
    """
    empty = F.array().cast("array<string>")
    have, want = F.coalesce(lines, empty), F.coalesce(missing, empty)
    name = lambda x: F.regexp_extract(x, pattern, 2)
    held = F.transform(have, name)
    fits = lambda x: (name(x) != "") & (F.size(F.filter(held, lambda h: h == name(x))) == 1) & (name(x).isin(*names) if names is not None else F.lit(True))
    closed, left = F.filter(want, lambda x: F.coalesce(fits(x), F.lit(False))), F.filter(want, lambda x: ~F.coalesce(fits(x), F.lit(False)))

    def wider(line: Column) -> Column:
        more = F.flatten(F.transform(F.filter(closed, lambda x: name(x) == name(line)), lambda x: listed(x, pattern)["entries"]))
        own = listed(line, pattern)["entries"]
        new = F.array_except(more, own)
        whole = F.concat(F.regexp_extract(line, pattern, 1), F.array_join(F.concat(own, new), ", "), F.regexp_extract(line, pattern, 4))
        return F.when((name(line) != "") & (F.size(new) > 0), whole).otherwise(line)

    return F.struct(F.transform(have, wider).alias("lines"), closed.alias("closed"), left.alias("left"))


def keyed_union(result: DataFrame, base: DataFrame, other: DataFrame, scope: list[str], excluded: tuple[str, ...] = ()) -> DataFrame:
    """What ``other`` adds to ``base`` and ``result`` lacks: ``scope``'s columns, ``container, name, kind, body, outcome``.

    All have these columns but the outcome. An item is added if base has none of its name in its container. Outcomes, the
    first that holds: ``excluded`` (its kind is), ``present`` (the result has the name anywhere in the scope),
    ``no_container`` (the result has no such container there), ``collision`` (two items of that name for that container),
    ``added``. Repeated rows count once; nulls equal each other in keys, items without a name are left out.
    """
    cols = [*scope, "container", "name", "kind", "body"]

    def meet(left: DataFrame, right: DataFrame, on: list[str], how: str, flag: str | None = None) -> DataFrame:
        keys = right.select(*[F.col(c).alias(f"_{c}") for c in on], *([F.lit(True).alias(flag)] if flag else [])).distinct()
        cond = F.lit(True)
        for c in on:
            cond = cond & left[c].eqNullSafe(keys[f"_{c}"])
        return left.join(keys, cond, how).drop(*[f"_{c}" for c in on])

    new = meet(other.select(*cols).filter("name IS NOT NULL").distinct(), base, [*scope, "container", "name"], "left_anti")
    new = meet(new, result, [*scope, "name"], "left", "_present")
    new = meet(new, result, [*scope, "container"], "left", "_held")
    twice = new.groupBy(*scope, "container", "name").agg(F.count_if(~F.coalesce(F.col("kind").isin(*excluded) if excluded else F.lit(False), F.lit(False))).alias("_n")).filter("_n > 1")
    new = meet(new, twice, [*scope, "container", "name"], "left", "_twice")
    bad = F.coalesce(F.col("kind").isin(*excluded), F.lit(False)) if excluded else F.lit(False)
    outcome = F.when(bad, "excluded").when(F.col("_present"), "present").when(F.col("_held").isNull(), "no_container").when(F.col("_twice"), "collision").otherwise("added")
    return new.select(*cols, outcome.alias("outcome"))
