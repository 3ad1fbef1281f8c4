"""Row-level rules: each gives a struct, hard failures quarantine a row, warnings tag it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import has_markers, words


def rule(name: str, passed: Column, severity: str = "hard", message: str = "") -> Column:
    """A rule's verdict on a row; an unknown result counts as passed."""
    return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(True)).alias("passed"), F.lit(severity).alias("severity"), F.lit(message or name).alias("message"))


def text_rules(text: Column, needs_human: Column | None = None, forbidden: list[str] | None = None) -> list[Column]:
    """Rules that any text can be held against."""
    out = [rule("non_empty", F.length(F.trim(F.coalesce(text, F.lit("")))) > 0), rule("no_markers", ~has_markers(text)), rule("no_nul", ~text.contains("\u0000"))]
    if needs_human is not None:
        out.append(rule("needs_human", ~needs_human))
    out += [rule(f"forbidden:{p}", ~text.rlike(p)) for p in forbidden or []]
    out.append(rule("no_repeated_lines", F.size(F.array_distinct(F.split(text, "\n"))) * 2 >= F.size(F.split(text, "\n")), "warning"))
    return out


def side_kept(name: str, side: Column, base: Column, result: Column, floor: float = 0.8) -> Column:
    """Of the words that a side adds to the base, enough are in the result; nothing added is enough."""
    added = F.array_except(words(side), words(base))
    kept = F.size(F.array_intersect(added, words(result)))
    return rule(name, (F.size(added) == 0) | (kept >= floor * F.size(added)), "warning")


def checked(df: DataFrame, rules: list[Column], name: str = "verdicts") -> DataFrame:
    """The rows with all verdicts, ``n_hard``, ``n_warning`` (failures) and ``accepted``."""
    failed = lambda s: F.size(F.filter(F.col(name), lambda v: ~v["passed"] & (v["severity"] == s)))
    out = df.withColumn(name, F.array(*rules))
    return out.withColumns({"n_hard": failed("hard"), "n_warning": failed("warning")}).withColumn("accepted", F.col("n_hard") == 0)


def duplicates(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Keys that occur more than once: ``n`` and first and last position."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"), F.max(pos).alias("last")).filter("n > 1")


def new_errors(baseline: DataFrame, after: DataFrame, keys: list[str], key: Column, pos: str) -> DataFrame:
    """Errors whose key isn't among those of the baseline, the first of each key, in order."""
    known = baseline.select(*keys, key.alias("key")).distinct()
    fresh = after.select(*keys, key.alias("key"), F.col(pos)).join(known, [*keys, "key"], "left_anti")
    return fresh.groupBy(*keys, "key").agg(F.min(pos).alias(pos))
