"""Merging two edits of a text by its tokens, and finding JSON objects in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.alignment import aligned, opcodes

# The four kinds of tokens (letters and underscores, digits, white space, signs), and the lines that a merge may span.
TOKENS = r"[A-Za-z_]+|[0-9]+|\s+|[^\sA-Za-z0-9]+"
MOST_LINES = 12


def tokens(text: Column) -> Column:
    """The tokens of a text, which together are the text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), 0)


def lines_in(text: Column) -> Column:
    """How many lines of a text aren't blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x85  ]"), lambda x: F.trim(x) != ""))


def _meet(x: Column, y: Column) -> Column:
    """Changed spans that share a token, a place of insertion inside the other's span, or one place of insertion."""
    point_x, point_y = x["i1"] == x["i2"], y["i1"] == y["i2"]
    inside = lambda p, s: (s["i1"] <= p["i1"]) & (p["i1"] < s["i2"])
    return F.when(point_x & point_y, x["i1"] == y["i1"]).when(point_x, inside(x, y)).when(point_y, inside(y, x)).otherwise((x["i1"] < y["i2"]) & (y["i1"] < x["i2"]))


def token_merge(rows: DataFrame, base: str = "base", current: str = "current", replayed: str = "replayed", most: int = MOST_LINES) -> DataFrame:
    """``rows`` with ``merged`` and ``reason``: both sides' edits applied to the base where they touch different tokens.

    Each side is aligned with the base token by token. ``merged`` is null, and ``reason`` says why, if the three texts
    have more than ``most`` lines that aren't blank (``large``), if a side changes nothing (``unchanged``) or if changed
    spans or places of insertion meet (``overlap``); else ``reason`` is ``merged``. A null text counts as empty.
    """
    cut = rows.withColumns({"_b": tokens(F.col(base)), "_c": tokens(F.col(current)), "_r": tokens(F.col(replayed))})
    large = lines_in(F.col(base)) + lines_in(F.col(current)) + lines_in(F.col(replayed)) > most
    few = lambda c: F.when(F.col("_large"), F.array().cast("array<string>")).otherwise(F.col(c))  # noqa: E731 - large texts aren't aligned
    cut = cut.withColumn("_large", large).withColumns({c: few(c) for c in ("_b", "_c", "_r")})

    def edits(side: str) -> Column:
        ops = F.filter(opcodes(F.col("blocks"), F.size("_b"), F.size(side)), lambda o: o["tag"] != "equal")
        return F.transform(ops, lambda o: F.struct(o["i1"].alias("i1"), o["i2"].alias("i2"), F.array_join(F.slice(side, o["j1"] + 1, o["j2"] - o["j1"]), "").alias("new")))

    one = aligned(cut, "_b", "_c").withColumn("_x", edits("_c")).drop("blocks")
    both = aligned(one, "_b", "_r").withColumn("_y", edits("_r")).drop("blocks")
    reason = F.when(F.col("_large"), "large").when((F.size("_x") == 0) | (F.size("_y") == 0), "unchanged").when(F.exists("_x", lambda x: F.exists("_y", lambda y: _meet(x, y))), "overlap").otherwise("merged")
    piece = lambda lo, hi: F.array_join(F.slice("_b", lo + 1, hi - lo), "")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda s, o: F.struct(o["i2"].alias("at"), F.concat(s["text"], piece(s["at"], o["i1"]), o["new"]).alias("text"))
    spliced = F.aggregate(F.array_sort(F.concat("_x", "_y")), start, step, lambda s: F.concat(s["text"], piece(s["at"], F.size("_b"))))
    return both.withColumn("reason", reason).withColumn("merged", F.when(F.col("reason") == "merged", spliced)).drop("_b", "_c", "_r", "_x", "_y", "_large")


def balanced_objects(text: Column) -> Column:
    """Every outermost ``{...}`` of a text whose braces balance, in order; braces in double-quoted strings don't count, and a closing brace that nothing opened is passed over. None for null.

    A fold over runs of other characters, quotes, braces and escaped pairs, on the JVM: depth, whether in a string, and where
    the object began. Behind a quote that is never closed nothing is found, as in any reader of strings.
    """
    text = F.coalesce(text, F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(r'\\(?s:.)?|["{}]|[^\\"{}]+'), 0)
    found = F.array().cast("array<string>")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("first"), found.alias("found"))

    def step(s: Column, part: Column) -> Column:
        sign = F.right(part, F.lit(1))  # outside strings an escape is two signs
        here = s["at"] + F.length(part)
        real = ~s["quoted"]
        opens, closes = real & (sign == "{"), real & (sign == "}") & (s["depth"] > 0)
        depth = F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        quoted = F.when(s["quoted"], part != '"').otherwise(sign == '"')
        first = F.when(opens & (s["depth"] == 0), here - 1).otherwise(s["first"])
        whole = F.when(closes & (s["depth"] == 1), F.array_append(s["found"], F.substring(text, s["first"], here - s["first"]))).otherwise(s["found"])
        return F.struct(here.alias("at"), depth.alias("depth"), quoted.alias("quoted"), first.alias("first"), whole.alias("found"))

    return F.aggregate(parts, start, step, lambda s: s["found"])


def _object(text: Column) -> Column:
    """The text if it is a JSON object, or is one without its trailing commas; else null."""
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    mended = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    return F.when(is_object(text), text).when(is_object(mended), mended)


def extracted_object(text: Column) -> Column:
    """``tier, object`` of the JSON object in a text: the whole text (``direct``), else the last fenced block that is one (``fenced``), else the last balanced one (``balanced``); ``none`` and null without any. Trailing commas are forgiven."""
    text = F.coalesce(text, F.lit(""))
    last = lambda xs: F.try_element_at(F.filter(F.transform(xs, _object), lambda x: x.isNotNull()), F.lit(-1))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    direct = _object(bare(text))
    fenced = last(F.transform(F.regexp_extract_all(text, F.lit(r"```(?:json)?[ \t]*\n((?s:.*?))```"), 1), bare))
    balanced = last(balanced_objects(text))
    tier = F.when(direct.isNotNull(), "direct").when(fenced.isNotNull(), "fenced").when(balanced.isNotNull(), "balanced").otherwise("none")
    return F.struct(tier.alias("tier"), F.coalesce(direct, fenced, balanced).alias("object"))


def applied_edits(text: Column, edits: Column) -> Column:
    """``text, failed`` after edits ``search, replace``, each applied to what the one before has left.

    An edit replaces the first place where its search text (less line ends behind it) stands; where it stands nowhere, the
    first place where it does with any white space for white space. ``failed`` lists the number, from 0, and why: ``empty``
    (nothing to search), ``same`` (the replacement is the same but for white space) or ``missing``. A null edit or search
    is empty, a null replacement removes, a null text is empty. No edits leave the text as it is.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    start = F.struct(F.lit(0).alias("n"), F.coalesce(text, F.lit("")).alias("text"), F.array().cast("array<struct<edit:int,why:string>>").alias("failed"))

    def step(s: Column, e: Column) -> Column:
        search, new, old = F.regexp_replace(F.coalesce(e["search"], F.lit("")), r"\n+$", ""), F.coalesce(e["replace"], F.lit("")), s["text"]
        quoted = F.transform(F.split(flat(search), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        exact = F.instr(old, search) > 0
        loose = F.regexp_substr(old, F.array_join(quoted, "\\s+"))  # null: nowhere
        what = F.when(exact, search).otherwise(loose)
        at = F.instr(old, what)
        why = F.when(search == "", "empty").when(flat(search) == flat(new), "same").when(~exact & (loose.isNull() | (flat(search) == "")), "missing")
        done = F.concat(F.substring(old, F.lit(1), at - 1), new, F.substring(old, at + F.length(what), F.length(old)))
        failed = F.when(why.isNotNull(), F.array_append(s["failed"], F.struct(s["n"].alias("edit"), why.alias("why")))).otherwise(s["failed"])
        return F.struct((s["n"] + 1).alias("n"), F.when(why.isNull(), done).otherwise(old).alias("text"), failed.alias("failed"))

    return F.aggregate(F.coalesce(edits, F.array().cast("array<struct<search:string,replace:string>>")), start, step, lambda s: F.struct(s["text"].alias("text"), s["failed"].alias("failed")))
