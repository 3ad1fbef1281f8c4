"""What a side of a change adds, drops and owes, as sets of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import anchor, channel, has_markers, squeezed


def lines(text: Column) -> Column:
    """Squeezed lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeezed), lambda x: x != "")


def changes(base: Column, side: Column) -> Column:
    """Lines that a side added and removed, each once: struct of ``added`` and ``removed``."""
    b, s = lines(base), lines(side)
    return F.struct(F.array_except(s, b).alias("added"), F.array_except(b, s).alias("removed"))


def missing(base: Column, side: Column, result: Column) -> Column:
    """Lines that the side added and the result lacks: what the result still owes it. Formatting owes nothing."""
    owed = F.array_except(changes(base, side)["added"], lines(result))
    return F.filter(owed, lambda x: channel(x) != "formatting")


def owed_comments(base: Column, side: Column, result: Column) -> Column:
    """Of what the result owes the side the comments alone, which may be settled later."""
    return F.filter(missing(base, side, result), lambda x: channel(x) == "comment")


def _surplus(text: Column) -> Column:
    """Opening less closing brackets of each kind."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.array(*[count(a) - count(b) for a, b in ("()", "[]", "{}")])


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without every line whose squeezed form is among ``dropped``; null where that would unbalance its brackets."""
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(dropped, squeezed(x))), "\n")
    return F.when(_surplus(left) == _surplus(text), left)


def spliced(text: Column, first: Column, last: Column, new: Column) -> Column:
    """The text with its lines ``first`` to ``last`` (from 0, both included) replaced by ``new``."""
    all_lines = F.split(text, "\n")
    return F.array_join(F.concat(F.slice(all_lines, F.lit(1), first), F.split(new, "\n"), F.slice(all_lines, last + 2, F.greatest(F.size(all_lines) - last - 1, F.lit(0)))), "\n")


def spliced_all(text: Column, spans: Column) -> Column:
    """The text with several spans (structs ``first, last, new``, which don't overlap) replaced at once: from the last to the first, so that none moves another."""
    ordered = F.reverse(F.array_sort(spans))
    return F.aggregate(ordered, text, lambda t, s: spliced(t, s["first"], s["last"], s["new"]))


def outside_unchanged(original: Column, first: Column, last: Column, result: Column) -> Column:
    """Whether all lines outside ``first`` to ``last`` of the original are in the result as they were."""
    a, b = F.split(original, "\n"), F.split(result, "\n")
    behind = F.size(a) - last - 1
    tail = lambda x: F.slice(x, F.greatest(F.size(x) - behind, F.lit(0)) + 1, F.greatest(behind, F.lit(0)))
    return (F.size(b) >= first + behind) & (F.slice(a, F.lit(1), first) == F.slice(b, F.lit(1), first)) & (tail(a) == tail(b))


def verbatim_copy(base: Column, current: Column, replayed: Column, result: Column) -> Column:
    """``current`` or ``replayed`` where the result is that side as it is though both changed the base, else null."""
    changed = (lines(current) != lines(base)) & (lines(replayed) != lines(base)) & (lines(current) != lines(replayed))
    return F.when(changed & (lines(result) == lines(current)), "current").when(changed & (lines(result) == lines(replayed)), "replayed")


def conflict_features(base: Column, current: Column, replayed: Column) -> Column:
    """A conflict as a row of numbers and labels for the models: sizes in lines that aren't blank, how even the sides are, whether both changed a line, and the kind of conflict."""
    c, r = F.size(lines(current)), F.size(lines(replayed))
    kind = direction(base, current, replayed)
    return F.struct(
        (F.size(lines(base)) + c + r).alias("hunk_size"),
        c.alias("current_side_lines"),
        r.alias("replayed_side_lines"),
        balance(current, replayed).alias("balance"),
        F.when(F.least(c, r) == 0, F.lit(float("inf"))).otherwise(F.greatest(c, r) / F.least(c, r)).alias("imbalance_ratio"),
        same_lines(base, current, replayed).alias("same_line_overlap"),
        kind.alias("merge_kind"),
        (kind == "delete_against_change").alias("modify_delete"),
    )


def result_features(base: Column, current: Column, replayed: Column, result: Column) -> Column:
    """A result as a row of features for the models: markers left, a side copied, and what each side added that is gone."""
    copied = F.coalesce(verbatim_copy(base, current, replayed, result), F.lit(""))
    lost = lambda side: F.size(F.array_except(changes(base, side)["added"], lines(result)))
    return F.struct(
        has_markers(result).alias("markers_remaining"),
        (copied != "").alias("copied_one_side"),
        (copied == "current").alias("copied_current_side"),
        (copied == "replayed").alias("copied_replayed_side"),
        lost(current).alias("dropped_current_additions"),
        lost(replayed).alias("dropped_replayed_additions"),
        ((lost(current) > 0) | (lost(replayed) > 0)).alias("dropped_a_side"),
    )


def patch_key(base: Column, side: Column) -> Column:
    """A hash of what a change adds and removes that doesn't depend on where, nor on white space."""
    c = changes(base, side)
    return F.sha1(F.concat_ws("\n", F.transform(F.array_sort(c["removed"]), lambda x: F.concat(F.lit("-"), x)), F.transform(F.array_sort(c["added"]), lambda x: F.concat(F.lit("+"), x))))


def balance(current: Column, replayed: Column) -> Column:
    """The smaller by the larger number of lines that aren't blank; 1 for two empty sides."""
    x, y = F.size(lines(current)), F.size(lines(replayed))
    return F.when((x == 0) & (y == 0), 1.0).otherwise(F.least(x, y) / F.greatest(x, y))


def interleavings(m: Column, n: Column) -> Column:
    """In how many ways two lists can be merged that keep their order, as a double."""
    k = F.least(m, n)
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda p, i: p * (F.greatest(m, n) + i) / i)


def mean_surprise(logprobs: Column) -> Column:
    """Mean negative log probability of an array's values that aren't null; null if there is none."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, -F.aggregate(known, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(known))


def undone(base: Column, side: Column, result: Column) -> Column:
    """Lines that the side removed and the result has again."""
    return F.array_intersect(changes(base, side)["removed"], lines(result))


def satisfied(base: Column, side: Column, result: Column) -> Column:
    return (F.size(missing(base, side, result)) == 0) & (F.size(undone(base, side, result)) == 0)


def exclusive(owed: Column, result: Column) -> Column:
    """Of the owed lines those whose anchor the result has with another value: they exclude what is there."""
    present = F.transform(lines(result), anchor)
    return F.filter(owed, lambda x: (anchor(x) != "") & F.array_contains(present, anchor(x)))


def same_lines(base: Column, current: Column, replayed: Column) -> Column:
    """Both sides dropped or changed a common line of the base."""
    return F.arrays_overlap(changes(base, current)["removed"], changes(base, replayed)["removed"])


def side_kind(base: Column, side: Column) -> Column:
    """unchanged, added, deleted or modified."""
    c = changes(base, side)
    more, less = F.size(c["added"]) > 0, F.size(c["removed"]) > 0
    return F.when(more & less, "modified").when(more, "added").when(less, "deleted").otherwise("unchanged")


def direction(base: Column, current: Column, replayed: Column) -> Column:
    """What kind of conflict two changed sides make."""
    x, y = side_kind(base, current), side_kind(base, replayed)
    return (
        F.when((x == "unchanged") & (y == "unchanged"), "none")
        .when(y == "unchanged", "current_only")
        .when(x == "unchanged", "replayed_only")
        .when((x == "added") & (y == "added"), "both_added")
        .when((x == "deleted") & (y == "deleted"), "both_deleted")
        .when((x == "deleted") | (y == "deleted"), "delete_against_change")
        .otherwise("both_modified")
    )


def first_occurrences(rows: DataFrame, keys: list[str], leaf: Column, pos: str) -> DataFrame:
    """Of rows with an equal leaf the first by position."""
    w = Window.partitionBy(*keys, "_leaf").orderBy(pos)
    return rows.withColumn("_leaf", leaf).withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_leaf", "_i")


def resurrected(old: DataFrame, now: DataFrame, result: DataFrame, key: str, text: str, least: int = 3, share: float = 0.8) -> DataFrame:
    """Per key: lines that ``now`` had dropped from ``old`` and ``result`` has again, where they are many: ``n_removed, n_back, coverage``."""
    j = old.select(key, F.col(text).alias("o")).join(result.select(key, F.col(text).alias("r")), key).join(now.select(key, F.col(text).alias("n")), key, "left")
    gone = changes(F.col("o"), F.col("n"))["removed"]
    rows = j.select(key, F.size(gone).alias("n_removed"), F.size(F.array_intersect(gone, lines(F.col("r")))).alias("n_back"))
    rows = rows.withColumn("coverage", F.try_divide("n_back", "n_removed"))
    return rows.filter((F.col("n_removed") >= least) & (F.col("coverage") >= share))
