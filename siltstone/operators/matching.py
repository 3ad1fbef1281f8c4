"""Pairs of vectors that are near each other, and one-to-one matching by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: Rows of the asking side that meet in one task's group at most, and how many times as many of the other side may.
BLOCK, WIDE = 4096, 16
#: Partners that a row is first given when it takes one in turn; those that lose all of them ask for more.
TOP = 32
#: Cells that a row may meet on average, and numbers that a group compares at once or returns.
HITS, ONCE = 32, 2**22


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = m.reshape(len(column), len(m) // max(1, len(column)))
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Directions of ``n`` cells of unit vectors, by spherical k-means from evenly spaced rows."""
    c = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(length > 0, total / np.maximum(length, 1e-300), c)
    return c


def _directions(drawn: np.ndarray, asked: np.ndarray, reach: float, most: int) -> np.ndarray:
    """Directions of as many cells as pay: each row is copied to those it may meet, so these are few and at most half of all; else there is one cell."""
    while most > 1:
        c = centroids(drawn, most)
        score = drawn @ c.T
        near = score.argmax(axis=1)
        radius = np.full(len(c), -np.inf)
        np.maximum.at(radius, near, np.arccos(np.clip(score[np.arange(len(near)), near], -1, 1)))
        hits = (np.arccos(np.clip(asked @ c.T, -1, 1)) <= radius + reach).sum(axis=1).mean()
        if hits <= min(HITS, most / 2):
            return c
        most //= 4
    return centroids(drawn, 1)


def near_pairs(a: DataFrame, b: DataFrame, least: float, probes: int | None = None, cells: int | None = None, sample: int = 8192, top: int | None = None) -> DataFrame:
    """``a, b, score``: rows of the same kind whose cosine, rounded to 9 digits, is at least ``least``.

    Both sides have ``kind, id, vec``; ids are unique on a side. Null and zero vectors, and those holding null or
    non-finite numbers, are in no pair. All vectors of both sides have one length. Null kinds are one kind.

    ``b`` is dealt to cells, by the nearest of some directions that a bounded ``sample`` of it gives (about the root of its
    number, 1,024 at most; fewer where rows would meet many of them, and one where they would meet most). A row of ``a``
    meets the cells that can hold a partner: by the triangle inequality of angles, those no further from it than the cell's
    radius and the angle that ``least`` allows; so no pair is lost. With ``probes`` it meets so many of the nearest of them
    only. A cell's rows meet in blocks, so no cell is one task's.

    With ``top`` each row of ``a`` gets its best so many only (ties: the smaller ids) and ``more``, whether it has others;
    rows of ``b`` may then have ``held``, an id of ``a``: greater ones don't meet them.
    """
    ddl = lambda df, *more: ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.schema], *more])
    sound = lambda df: df.select("kind", "id", "vec", *[c for c in df.columns if c == "held" and top]).filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    a, b = sound(a), sound(b)
    n, size = b.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        none = a.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score")).limit(0)
        return none.withColumn("more", F.lit(False)) if top else none
    reach = np.arccos(max(-1.0, least - 1e-9)) + 1e-6
    directions = None
    if cells != 1:
        draw = lambda df, rows: _units(df.orderBy(F.xxhash64("id"), "id").limit(rows).select("vec").toArrow().column("vec"))
        drawn, most = draw(b, sample), cells or int(min(1024, max(1, n**0.5)))
        asked = None if cells or probes else draw(a, max(1, sample // 8))
        if asked is not None and not len(asked):
            return near_pairs(a, b.limit(0), least, top=top)
        directions = centroids(drawn, min(most, len(drawn))) if asked is None else _directions(drawn, asked, reach, min(most, len(drawn)))
    if directions is None or len(directions) == 1:
        placed, asks = b.withColumn("cell", F.lit(0)), a.withColumn("cell", F.lit(0))
    else:
        placed, asks = _celled(a, b, directions, reach, probes, ddl)
    rows_a = BLOCK if top else max(1, BLOCK // 4)  # all pairs of a group may be near
    rows_a, rows_b = (min(rows_a, max(1, ONCE // top)), max(BLOCK, min(WIDE * BLOCK, ONCE // max(1, size)))) if top else (rows_a, rows_a)
    count = lambda df, name, rows: df.groupBy("kind", "cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    left, right = count(asks, "ka", rows_a).alias("l"), count(placed, "kb", rows_b).alias("r")
    sizes = left.join(right, F.col("l.kind").eqNullSafe(F.col("r.kind")) & (F.col("l.cell") == F.col("r.cell"))).select(F.col("l.kind").alias("_kind"), F.col("l.cell").alias("_cell"), "ka", "kb")
    sizes = written(sizes, "blocks")
    on = F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("cell") == F.col("_cell"))
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    asks = asks.join(sizes, on).select("kind", "cell", own("ka").alias("i"), every("kb").alias("j"), "id", "vec")
    placed = placed.join(sizes, on).select("kind", "cell", every("ka").alias("i"), own("kb").alias("j"), *[c for c in b.columns if c != "kind"])
    id_a, id_b = (df.select("id").toArrow().schema.field("id").type for df in (asks.limit(0), placed.limit(0)))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        found = []
        if x.num_rows and y.num_rows:
            y = y.take(pc.sort_indices(y.column("id")))  # among equals smaller ids come first
            u, v = _units(x.column("vec")), _units(y.column("vec"))
            if "held" in y.column_names:
                ids, free = x.column("id").to_numpy(), y.column("held").is_null().to_numpy()
                held = y.column("held").fill_null(x.column("id")[0]).to_numpy()
            step = max(1, ONCE // len(v))
            for at in range(0, len(u), step):
                score = np.round(u[at : at + step] @ v.T, 9)
                ok = score >= least
                if "held" in y.column_names:
                    ok &= free | (held[None] >= ids[at : at + step, None]).astype(bool)
                full = ok.sum(axis=1) > (top or len(v))
                if full.any():
                    last = np.partition(np.where(ok[full], score[full], -np.inf), len(v) - top, axis=1)[:, len(v) - top]
                    ok[full] &= score[full] >= last[:, None]
                i, j = np.nonzero(ok)
                got = score[i, j]
                if full.any():  # more may tie with the last
                    order = np.lexsort((j, -got, i))
                    i, j, got = i[order], j[order], got[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < top
                    i, j, got = i[keep], j[keep], got[keep]
                found.append((i + at, j, got, full[i]))
        i, j, score, more = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        out = [x.column("id").take(pa.array(i, pa.int64())).cast(id_a), y.column("id").take(pa.array(j, pa.int64())).cast(id_b), pa.array(score, pa.float64())]
        return pa.table([*out, pa.array(more)], ["a", "b", "score", "more"]) if top else pa.table(out, ["a", "b", "score"])

    block = ["kind", "cell", "i", "j"]
    kind = lambda df: df.schema["id"].dataType.simpleString()
    out = asks.groupBy(*block).cogroup(placed.groupBy(*block)).applyInArrow(meet, f"a {kind(asks)}, b {kind(placed)}, score double" + ", more boolean" * bool(top))
    if not top or (directions is None or len(directions) == 1) and (sizes.agg(F.max("kb")).first()[0] or 1) == 1:
        return out
    best, all_ = Window.partitionBy("a").orderBy(F.desc("score"), "b"), Window.partitionBy("a")
    out = out.withColumns({"_i": F.row_number().over(best), "more": F.max("more").over(all_) | (F.count(F.lit(1)).over(all_) > top)})
    return out.filter(F.col("_i") <= top).drop("_i")


def _celled(a: DataFrame, b: DataFrame, directions: np.ndarray, reach: float, probes: int | None, ddl: Callable) -> tuple[DataFrame, DataFrame]:
    """``b`` with its ``cell``, and ``a`` with each cell that can hold a partner."""
    spark = a.sparkSession
    shared = spark.sparkContext.broadcast(directions)

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = _units(batch.column("vec")) @ shared.value.T
                cell = score.argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.arccos(np.clip(score[np.arange(len(cell)), cell], -1, 1)))], [*batch.schema.names, "cell", "angle"])

    placed = written(b.mapInArrow(cell_of, ddl(b, "cell int", "angle double")), "cells")
    radius = np.full(len(directions), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("r")).collect():  # one row a cell
        radius[r["cell"]] = r["r"]
    wide = spark.sparkContext.broadcast(radius)

    def cells_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):  # each row is copied to its cells
                angle = np.arccos(np.clip(_units(some.column("vec")) @ shared.value.T, -1, 1))
                may = angle <= wide.value + reach
                if probes is not None and probes < angle.shape[1]:
                    order = np.argsort(np.where(may, angle, np.inf), axis=1, kind="stable")[:, :probes]
                    first = np.zeros_like(may)
                    np.put_along_axis(first, order, True, axis=1)
                    may &= first
                row, cell = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(cell.astype(np.int32))], [*some.schema.names, "cell"])

    return placed, written(a.mapInArrow(cells_for, ddl(a, "cell int")), "asks")


def _settled(pairs: DataFrame, won: DataFrame | None = None, asking: DataFrame | None = None) -> DataFrame:
    """``a, b, score`` that are left when the rows of ``a`` take theirs in turn: ``pairs`` lists what each may take, ``won`` what is taken so far, ``asking`` who has yet to ask (else all).

    All that have nothing ask at once for the best that no smaller one holds; each ``b`` is kept for the smallest that asks.
    A ``b`` once held stays held, by ever smaller ones, so who gives it up asks on among the others. When nobody gives up
    any more, all have what they would have got in turn. A round writes what is held, not the pairs.
    """

    def first(some: DataFrame, held: DataFrame | None) -> DataFrame:
        if held is not None:
            some = some.join(held.select(F.col("b").alias("_b"), F.col("a").alias("_a")), F.col("b") == F.col("_b"), "left").filter(F.col("_a").isNull() | (F.col("a") < F.col("_a")))
        return some.groupBy("a").agg(F.min_by(F.struct("b", "score"), F.struct((-F.col("score")).alias("s"), F.col("b").alias("b"))).alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.score").alias("score"))

    of = lambda who: pairs.join(who.select(F.col("a").alias("_who")), F.col("a") == F.col("_who"), "left_semi")
    claims = first(pairs if asking is None else of(asking), won)
    claims = claims if won is None else won.unionByName(claims)
    while True:
        claims = written(claims, "asked")
        holders = claims.groupBy("b").agg(F.min_by(F.struct("a", "score"), "a").alias("x"), F.count(F.lit(1)).alias("n"))
        won = holders.select(F.col("x.a").alias("a"), "b", F.col("x.score").alias("score"))
        if not holders.filter("n > 1").limit(1).count():
            return claims
        claims = won.unionByName(first(of(claims.join(won.select(F.col("a").alias("_won")), F.col("a") == F.col("_won"), "left_anti")), won))


def taken_in_turn(pairs: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """``pairs`` that are left when the rows of ``a``, by rising id, each take the best ``b`` (ties: the smaller id) that none before has taken. There are as many rounds of asking as the longest row of changes of mind."""
    named = written(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("score")).distinct(), "pairs")
    return _settled(named).select(F.col("a").alias(a), F.col("b").alias(b), F.col("score").alias(score))


def matched_by_vector(old: DataFrame, new: DataFrame, sign: Column, sure: float = 0.85, maybe: float = 0.70, probes: int | None = None) -> DataFrame:
    """``a, b, score, how`` (``renamed`` or ``possibly_renamed``) for rows of ``old`` whose ``kind, name`` are gone from ``new``.

    Both have ``kind, name, id, vec`` and what ``sign``, a condition over their columns ``a.*`` and ``b.*``, asks for. In
    order of id each takes the nearest row of its kind that is left (ties: the smaller id), if its cosine is at least
    ``sure``, or ``maybe`` where ``sign`` holds too. Rows without a usable vector are in no pair; a null sign doesn't hold.

    Pairs near enough may be a share of all, so they are never listed: each row gets its best few; those that lose all of
    these ask again for eight times as many, or for as many as make up the first list, what smaller ones hold left out, until all have one or have seen all.
    """
    gone = old.join(new.select(F.col("kind").alias("_k"), F.col("name").alias("_n")).distinct(), F.col("kind").eqNullSafe(F.col("_k")) & F.col("name").eqNullSafe(F.col("_n")), "left_anti")
    gone = written(gone, "gone")
    more = lambda df, side: df.drop("vec").withColumn("_id", F.col("id")).alias(side)

    def fitting(near: DataFrame) -> DataFrame:
        unsure = near.filter(F.col("score") < sure).alias("p")
        signed = unsure.join(more(gone, "a"), F.col("p.a") == F.col("a._id")).join(more(new, "b"), F.col("p.b") == F.col("b._id")).filter(sign).select("p.a", "p.b", "p.score")
        return written(near.filter(F.col("score") >= sure).select("a", "b", "score").unionByName(signed), "pairs")

    top = TOP
    near = written(near_pairs(gone, new, maybe, probes, top=top), "near")
    pairs, cut, listed = fitting(near), near.filter("more").select("a").distinct(), near.count()
    won = _settled(pairs)
    while True:
        again = written(cut.join(won.select("a"), "a", "left_anti"), "again")
        n = again.count()
        if not n:
            return won.withColumn("how", F.when(F.col("score") >= sure, "renamed").otherwise("possibly_renamed"))
        top = max(8 * top, listed // n)
        asking = gone.join(again.select(F.col("a").alias("id")), "id", "left_semi")
        held = new.join(won.select(F.col("b").alias("id"), F.col("a").alias("held")), "id", "left")
        near = written(near_pairs(asking, held, maybe, probes, None if probes else 1, top=top), "near")
        pairs = pairs.unionByName(fitting(near))
        cut = written(cut.join(again, "a", "left_anti").unionByName(near.filter("more").select("a").distinct()), "cut")
        won = _settled(pairs, won, again)
