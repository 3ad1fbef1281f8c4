"""What became of named bodies between two snapshots, plans held against what they are for, and which items need a decision at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.matching import matched_by_vector
from siltstone.operators.pairing import renames
from siltstone.operators.sessions import frontier
from siltstone.sources.scratch import written

# Operations of a plan that bring new text.
WRITES = ("rewrite", "move", "merge")
# Words of a text that name something: with an underscore, of mixed case, or all capitals; of at least four characters.
SYMBOL = r"^(?=.{4,}$)(?:(?=.*_)(?=.*[A-Za-z]).*|(?!.*_)(?=.*[a-z])(?=(?:.*[A-Z]){2}).*|[A-Z]{4,})$"


def _met(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """A join on ``on`` (left name to right name), nulls being equal; of the right the other columns are kept."""
    other = right.select(*[F.col(r).alias(f"_on_{r}") for r in on.values()], *[c for c in right.columns if c not in on.values()])
    cond = F.lit(True)
    for a, b in on.items():
        cond = cond & left[a].eqNullSafe(other[f"_on_{b}"])
    return left.join(other, cond, how).drop(*[f"_on_{b}" for b in on.values()])


def change_classes(old: DataFrame, new: DataFrame, renamed: DataFrame) -> DataFrame:
    """``kind, name, old_name, change`` for each ``kind, name`` (with ``signature, body``) that isn't as it was.

    ``signature_changed`` before ``body_changed`` for names that both have; a new name is ``renamed`` (``renamed`` has
    ``kind, old_name, new_name``) or ``added``; an old one that is gone and wasn't renamed is ``removed``. A name is
    expected once a snapshot; null signatures and bodies equal each other.
    """
    side = lambda df, s: df.select("kind", "name", F.struct("signature", "body").alias(s))
    both = side(new, "n").join(_met(side(old, "o"), side(new, "n").select("kind", "name"), {"kind": "kind", "name": "name"}, "left_semi"), ["kind", "name"])
    o, n = F.col("o"), F.col("n")
    how = F.when(~n["signature"].eqNullSafe(o["signature"]), "signature_changed").when(~n["body"].eqNullSafe(o["body"]), "body_changed")
    none = F.lit(None).cast(old.schema["name"].dataType).alias("old_name")
    kept = both.select("kind", "name", none, how.alias("change")).filter("change IS NOT NULL")
    come = _met(new.select("kind", "name"), old.select("kind", "name"), {"kind": "kind", "name": "name"}, "left_anti")
    come = _met(come, renamed.select("kind", "new_name", "old_name"), {"kind": "kind", "name": "new_name"})
    come = come.select("kind", "name", "old_name", F.when(F.col("old_name").isNotNull(), "renamed").otherwise("added").alias("change"))
    gone = _met(old.select("kind", "name"), new.select("kind", "name"), {"kind": "kind", "name": "name"}, "left_anti")
    gone = _met(gone, renamed.select("kind", "old_name"), {"kind": "kind", "name": "old_name"}, "left_anti")
    return kept.unionByName(come).unionByName(gone.select("kind", "name", none, F.lit("removed").alias("change")))


def matched_in_turn(sources: DataFrame, targets: DataFrame, sign: Column | None = None, **vector: object) -> DataFrame:
    """``kind, name, target, how`` for each source: the target it lives on in, by the first way that finds one.

    Both have ``kind, name, id, body, words, vec`` and what ``sign`` asks for. ``same_name``; ``renamed`` (by body or
    words, as ``pairing.renames`` has it); then, of what is left on both sides, ``renamed`` or ``possibly_renamed`` by
    vector (``matching.matched_by_vector``, which takes ``vector``'s options), each target once; else ``unmatched`` without
    a target. Names that several rows of a kind share are matched as one; ids are expected once a side.
    """
    key = {"kind": "kind", "name": "name"}
    names = sources.select("kind", "name").distinct()
    same = _met(names, targets.select("kind", "name").distinct(), key, "left_semi").select("kind", "name", F.col("name").alias("target"), F.lit("same_name").alias("how"))
    shape = lambda df: df.select("kind", "name", "body", "words")
    moved = written(renames(shape(targets), shape(sources)).select("kind", F.col("new_name").alias("name"), F.col("old_name").alias("target"), F.lit("renamed").alias("how")), "moved")
    rest = _met(_met(sources, same.select("kind", "name"), key, "left_anti"), moved.select("kind", "name"), key, "left_anti")
    free = _met(_met(targets, names, key, "left_anti"), moved.select("kind", F.col("target").alias("name")), key, "left_anti")
    if sign is None:  # nothing unsure counts
        vector |= {"maybe": max(vector.get("maybe", 0.70), vector.get("sure", 0.85))}
    near = matched_by_vector(written(rest, "rest"), written(free, "free"), F.lit(False) if sign is None else sign, **vector)
    near = _met(_met(near.select("a", "b", "how"), rest.select("id", "kind", "name"), {"a": "id"}), free.select("id", F.col("name").alias("target")), {"b": "id"}).select("kind", "name", "target", "how")
    found = written(same.unionByName(moved).unionByName(near), "found")
    left = _met(names, found.select("kind", "name"), key, "left_anti")
    return found.unionByName(left.select("kind", "name", F.lit(None).cast(targets.schema["name"].dataType).alias("target"), F.lit("unmatched").alias("how")))


def plan_failures(actions: DataFrame, items: DataFrame, names: DataFrame, fixed: tuple[str, ...] = (), widest: int = 120, times: int = 5) -> DataFrame:
    """``scope, item, check, n``: what is wrong with a plan's ``actions`` (``scope, item, operation, text``) for ``items`` (``scope, item, class, text``, a row for each version of an item).

    ``invalid_anchor``: an action for no item (empty and null ones aside). ``unaccounted``: an item without an action.
    ``duplicate``: several actions. ``directive_changed``: an item with a version whose class is ``fixed`` is written anew
    or deleted. ``stale_identifier``: new text names something that isn't among the scope's ``names`` (``scope, name``;
    scopes without any aren't held to it); ``n`` counts such names. ``style``: new text is over ``times`` as long as the
    longest version, has a comment sign inside a line, fewer than three letters or digits, or a line of over ``widest``
    characters where no version has one. Else ``n`` counts actions. Nulls in scopes and items equal each other.
    """
    text = F.coalesce("text", F.lit(""))
    width = lambda c: F.array_max(F.transform(F.split(c, "\n"), lambda x: F.length(x)))
    solid = F.regexp_replace(text, r"^\s+|\s+$", "")
    bad = F.coalesce(F.col("class").isin(*fixed), F.lit(False)) if fixed else F.lit(False)
    known = items.groupBy("scope", "item").agg(F.max(bad).alias("_fixed"), F.max(F.length(solid)).alias("_longest"), F.max(width(text)).alias("_widest"), F.lit(True).alias("_known"))
    known = written(known, "items")
    acts = written(_met(actions.select("scope", "item", "operation", "text"), known, {"scope": "scope", "item": "item"}), "acts")
    writes = F.col("operation").isin(*WRITES)
    nested = F.exists(F.split(solid, "\n"), lambda x: F.regexp_replace(x, r"^\s+", "").rlike(r"^.[^\n]*(?://|#)"))
    style = (F.coalesce((F.col("_longest") > 0) & (F.length(solid) > times * F.col("_longest")), F.lit(False))) | nested | (F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", "")) < 3) | ((width(solid) > widest) & (F.coalesce("_widest", F.lit(0)) <= widest))
    checks = {
        "invalid_anchor": F.col("_known").isNull() & (F.coalesce(F.col("item").cast("string"), F.lit("")) != ""),
        "directive_changed": F.coalesce("_fixed", F.lit(False)) & (writes | (F.col("operation") == "delete")),
        "style": writes & (solid != "") & style,
    }
    failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    rows = acts.select("scope", "item", F.explode(failed).alias("check")).groupBy("scope", "item", "check").agg(F.count(F.lit(1)).alias("n"))
    twice = acts.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("scope", "item", F.lit("duplicate").alias("check"), "n")
    open_ = _met(known.select("scope", "item"), actions.select("scope", "item").distinct(), {"scope": "scope", "item": "item"}, "left_anti").select("scope", "item", F.lit("unaccounted").alias("check"), F.lit(0).cast("long").alias("n"))
    named = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]+)"))), lambda x: x.rlike(SYMBOL))
    said = acts.filter(writes).select("scope", "item", F.explode(named).alias("name")).distinct()
    said = _met(said, names.select("scope").distinct(), {"scope": "scope"}, "left_semi")
    stale = _met(said, names.select("scope", "name").distinct(), {"scope": "scope", "name": "name"}, "left_anti").groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n")).select("scope", "item", F.lit("stale_identifier").alias("check"), "n")
    return rows.unionByName(twice).unionByName(open_).unionByName(stale)


def dispositions(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """``scope, lineage, disposition`` of items over versions: ``entries`` has ``scope, lineage, version, text, anchor, start, stop``, ``spans`` the places in dispute, ``scope, start, stop`` (stops aren't part of them).

    The first that holds: ``delete`` (no resolved version, and something it was anchored to is in a source version of the
    scope, but in no resolved one), ``unchanged`` (the same text in all three source versions, or resolved only, and not
    in dispute), ``cosmetic`` (the same but for case and white space, in all of them, not in dispute), ``frontier``. An
    empty or null anchor is none; a null text is empty; entries without a place aren't in dispute.

    Disputes are met by one ordered pass dealt by ranges, anchors by groupings; no lineage or scope is gathered.
    """
    entries = entries.select("scope", "lineage", F.coalesce("version", F.lit("")).alias("version"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("anchor", F.lit("")).alias("anchor"), F.col("start").cast("long").alias("lo"), (F.col("stop").cast("long") - 1).alias("hi"))
    disputes = spans.select("scope", F.col("start").cast("long").alias("lo"), (F.col("stop").cast("long") - 1).alias("hi")).filter("lo <= hi")
    rows = frontier(entries, disputes, "scope", "lo", "hi", F.lit(None).cast("string"))
    here = F.col("version") == "resolved"
    lost = entries.filter("anchor != ''").groupBy("scope", "anchor").agg(F.max(here).alias("_in")).filter("NOT _in").select("scope", "anchor", F.lit(True).alias("_lost"))
    rows = _met(rows, lost, {"scope": "scope", "anchor": "anchor"})
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    plain = F.regexp_replace(F.lower(text), r"\s+", " ")
    same = lambda c: F.min(c) == F.max(c)
    by = rows.groupBy("scope", "lineage").agg(
        F.max(F.coalesce("_lost", F.lit(False))).alias("lost"), F.max(here).alias("resolved"), same(text).alias("same"), same(plain).alias("alike"), F.max((F.col("disposition") == "frontier") & (F.col("lo") <= F.col("hi"))).alias("disputed"),
        F.max(~here).alias("source"), *[F.max(F.col("version") == v).alias(v) for v in ("base", "current", "replayed")],
    )
    whole, calm = F.expr("base AND current AND replayed OR NOT source"), ~F.coalesce("disputed", F.lit(False))
    how = F.when(F.col("lost") & ~F.col("resolved"), "delete").when(whole & calm & F.col("same"), "unchanged").when(whole & calm & F.col("alike"), "cosmetic").otherwise("frontier")
    return by.select("scope", "lineage", how.alias("disposition"))
