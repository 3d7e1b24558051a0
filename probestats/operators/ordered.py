"""Ordered work over groups of any size: running totals, ranks and exact quantiles.

A plain ``Window.partitionBy(key).orderBy(value)`` puts a whole key into one task. Most keys are small enough for that; which
are not is looked up first (a job). Such a key is cut along the value axis into *cells*, at quantiles that a mergeable
sketch of its values gives; what a window inside a cell gives is added to the totals of earlier cells. Sketches draw at
random, so borders are written before they are used: every evaluation of a plan, also after a lost executor, cuts alike.

Totals of cells are summed up in two levels: over the ranges of the first cut (at most ``RANGES`` for a key), and inside
each. So no window, with a key or without, ever runs over all rows or over all cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from probestats.operators.stage import stage

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
CELL = "_cell"
#: Most parts into which one cut divides a key or a cell.
RANGES = 1_024
#: Most cuts one after the other, for keys whose sketch is too coarse for their size.
MAX_CUTS = 3
#: Size of the sketches: for groups (error of a rank about 0.1 %), and for cuts and all rows together (0.007 %).
GROUP_SKETCH, CUT_SKETCH = 4_096, 65_535
#: Error of a rank that a sketch exceeds in one of 100 cases is 2.446 / k ** 0.9433; five times that is beyond 12 deviations.
_ERROR, _POWER, _SAFE = 2.446, 0.9433, 5.0
#: Rows of a looked-up table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which NULL equals NULL, with the columns of ``left`` and the others of ``right``."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row on the right
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    if how in ("left_semi", "left_anti"):
        return left.join(renamed, condition, how)
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _hot_limit(sizes: DataFrame, size: str, hot_rows: int | None) -> Column:
    total = sizes.agg(F.sum(size)).scalar()
    return F.greatest(F.lit(float(HOT_ROWS if hot_rows is None else hot_rows)), total / MAX_HOT_KEYS)


def hot_keys(rows: DataFrame, keys: Sequence[str], *, hot_rows: int | None = None) -> DataFrame | None:
    """Keys with more rows than one task should hold, with ``_n`` and the limit; None if there are none. Runs a job.

    The limit is at least total / MAX_HOT_KEYS rows, so there are fewer than MAX_HOT_KEYS such keys whatever the data: the
    result may be broadcast.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = _hot_limit(sizes, "_n", hot_rows)
    hot = stage(sizes.select(*keys, "_n", limit.alias("_limit")).where(F.col("_n") > F.col("_limit")), "hot")
    return None if hot.isEmpty() else hot


def _quantile_grid(sketch: Column, parts: int) -> Column:
    ranks = ",".join(repr((i + 1) / parts) for i in range(parts - 1))
    return F.kll_sketch_get_quantile_double(sketch, F.split(F.lit(ranks), ",").cast("array<double>"))  # one constant


def _borders(rows: DataFrame, keys: Sequence[str], value: Column, sizes: DataFrame) -> DataFrame:
    """Per key in ``sizes`` (keys, _n, _limit): borders that leave about half of ``_limit`` rows in a part. Runs a job.

    Borders lie in chunks of about the root of their number, so that finding a value's part takes two short searches.
    """
    some = null_safe_join(rows, F.broadcast(sizes), keys)
    wanted = F.least(F.ceil(F.lit(2.0) * F.first("_n") / F.greatest(F.first("_limit"), F.lit(1.0))), F.first("_n"), F.lit(RANGES))
    found = some.groupBy(*keys).agg(
        F.kll_sketch_agg_double(value.cast("double"), CUT_SKETCH).alias("_sketch"), F.greatest(wanted, F.lit(2)).cast("int").alias("_parts")
    )
    # ranks must be constants: the finest grid, of which each key takes every so many
    grid = F.when(F.kll_sketch_get_n_double("_sketch") > 0, _quantile_grid(F.col("_sketch"), RANGES))
    step = F.greatest(F.floor(F.lit(RANGES) / F.col("_parts")), F.lit(1)).cast("int")
    borders = F.array_distinct(F.filter(grid, lambda b, i: (i + 1) % step == 0))
    width = F.ceil(F.sqrt(F.greatest(F.size("_b"), F.lit(1)))).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_b"), F.lit(1)), F.col("_width")), lambda i: F.slice("_b", i, F.col("_width")))
    cut = found.select(*keys, borders.alias("_b")).where(F.size("_b") > 0).select("*", width.alias("_width")).select(*keys, "_width", chunks.alias("_chunks"))
    tops = F.transform("_chunks", lambda c: F.element_at(c, 1))
    return stage(cut.select(*keys, "_width", "_chunks", tops.alias("_tops")), "borders")


def _part(value: Column) -> Column:
    """How many borders are not greater than the value; 0 for NULL and where there are no borders."""
    value = value.cast("double")
    chunk = F.size(F.filter("_tops", lambda b: b <= value))
    inside = F.size(F.filter(F.get("_chunks", chunk - 1), lambda b: b <= value))
    return F.when(F.col("_tops").isNull() | (chunk <= 0), F.lit(0)).otherwise((chunk - 1) * F.col("_width") + inside).cast("bigint")


@dataclass
class Cells:
    """Borders of the cells of keys that are too large for one task: of the keys, then of cells that were too large again."""

    keys: list[str]
    cuts: list[DataFrame]

    def add(self, rows: DataFrame, value: str) -> DataFrame:
        """``rows`` with their cell: a number that never falls as the value grows. Keys that need no cells have one, 0."""
        out = rows.withColumn(CELL, F.lit(0).cast("bigint"))
        for depth, borders in enumerate(self.cuts):
            on = [*self.keys, CELL] if depth else self.keys
            # fewer than MAX_HOT_KEYS keys, and as many cells beyond the limit
            found = null_safe_join(out, F.broadcast(borders), on, "left" if on else "inner")
            out = found.withColumn(CELL, F.col(CELL) * RANGES + _part(F.col(value))).drop("_width", "_chunks", "_tops")
        return out

    def top(self) -> Column:
        """The part of the first cut that holds a cell."""
        return F.floor(F.col(CELL) / F.lit(RANGES ** (len(self.cuts) - 1))).cast("bigint")


def find_cells(rows: DataFrame, keys: Sequence[str], value: str, *, hot_rows: int | None = None) -> Cells | None:
    """Cells for the keys (or, without keys, for all rows) that one task should not hold; None if there are none. Runs jobs.

    A cell holds at most about half of the limit, unless its values are equal. Cells that turn out to hold more than the
    limit are cut again.
    """
    keys = list(keys)
    hot = hot_keys(rows, keys, hot_rows=hot_rows)
    if hot is None:
        return None
    among = null_safe_join(rows, F.broadcast(hot.select(*keys)), keys, "left_semi") if keys else rows
    cells = Cells(keys, [_borders(among, keys, F.col(value), hot)])
    while len(cells.cuts) < MAX_CUTS:
        celled = cells.add(among, value)
        sizes = celled.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("_n"), (F.min(value) < F.max(value)).alias("_differ"))
        limits = null_safe_join(sizes, F.broadcast(hot.select(*keys, "_limit")), keys)
        full = stage(limits.where((F.col("_n") > F.col("_limit")) & (F.col("_n") > 1) & F.col("_differ")).drop("_differ"), "full_cells")
        if full.isEmpty():
            break
        cells.cuts.append(_borders(celled, [*keys, CELL], F.col(value), full))
    return cells


def _cell_offsets(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], top: Column | None = None) -> DataFrame:
    """Per cell: the sums of earlier cells (``_off_*``) and of the key (``_tot_*``).

    With ``top`` (a coarser cell) in two levels: over the coarse cells of a key, then over the cells inside each.
    """
    per_cell = rows.groupBy(*keys, CELL).agg(*[c.alias(n) for n, c in sums.items()]).withColumn("_top", F.lit(0) if top is None else top)
    inside = W.partitionBy(*keys, "_top").orderBy(CELL).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = per_cell.select(*keys, CELL, "_top", *[(F.sum(n).over(inside) - F.col(n)).alias(f"_off_{n}") for n in sums], *[F.col(n).alias(f"_in_{n}") for n in sums])
    if top is None:
        whole = W.partitionBy(*keys)
        return own.select(*keys, CELL, *[f"_off_{n}" for n in sums], *[F.sum(f"_in_{n}").over(whole).alias(f"_tot_{n}") for n in sums])
    coarse = own.groupBy(*keys, "_top").agg(*[F.sum(f"_in_{n}").alias(n) for n in sums])
    before = W.partitionBy(*keys).orderBy("_top").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    coarse = coarse.select(
        *keys, "_top", *[(F.sum(n).over(before) - F.col(n)).alias(f"_before_{n}") for n in sums], *[F.sum(n).over(whole).alias(f"_tot_{n}") for n in sums]
    )
    both = null_safe_join(own, coarse, [*keys, "_top"])
    return both.select(*keys, CELL, *[(F.col(f"_off_{n}") + F.col(f"_before_{n}")).alias(f"_off_{n}") for n in sums], *[f"_tot_{n}" for n in sums])


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Mapping[str, Column],
    *,
    hot_rows: int | None = None,
) -> tuple[DataFrame, Cells | None]:
    """One row per distinct (keys, value): each weight summed there, up to there and over the key; and the cells in use.

    Equal values are summed before anything is shuffled. Output: keys, value, cell, and for each weight
    ``w``, ``w_cum`` (this value included) and ``w_total``. Weights are whole numbers; NULL keys are one key; a
    NULL value comes first. Runs a job that counts the rows of each key.
    """
    keys, names = list(keys), list(weights)
    levels = rows.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    cells = find_cells(rows.select(*keys, value), keys, value, hot_rows=hot_rows)
    if cells is None:
        upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
        whole = W.partitionBy(*keys)
        plain = levels.select(
            *keys,
            F.lit(0).cast("bigint").alias(CELL),
            value,
            *names,
            *[F.sum(n).over(upto).alias(f"{n}_cum") for n in names],
            *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
        )
        return plain, None
    celled = stage(cells.add(levels, value), "levels")  # read by the offsets and by the windows
    offsets = _cell_offsets(celled, keys, {n: F.sum(n) for n in names}, cells.top())
    inside = W.partitionBy(*keys, CELL).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = null_safe_join(celled, offsets, [*keys, CELL]).select(
        *keys,
        CELL,
        value,
        *names,
        *[(F.col(f"_off_{n}") + F.sum(n).over(inside)).alias(f"{n}_cum") for n in names],
        *[F.col(f"_tot_{n}").alias(f"{n}_total") for n in names],
    )
    return joined, cells


def row_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    *,
    name: str = "row_rank",
    limit: int | None = None,
    cells: Sequence[Column] | None = None,
    few_cells: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Number the rows of each key 1, 2, ... by ``order`` then ``ties``, keeping every column.

    ``cells`` gives other borders than the value's own, as columns that sort the same way. ``few_cells``
    promises that their number, over all keys, is bounded by construction: their offsets are broadcast.
    With ``limit`` only the first rows come back; rows of cells behind the limit are never shuffled then.
    Without ``cells`` it runs a job that counts the rows of each key.
    """
    keys, top = list(keys), None
    if cells is None:
        found = find_cells(rows.select(*keys, order), keys, order, hot_rows=hot_rows)
        if found is None:
            ranked = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order, *ties)).cast("bigint"))
            return ranked if limit is None else ranked.where(F.col(name) <= limit)
        celled, top = found.add(rows, order), found.top()
    else:
        celled = rows.withColumn(CELL, F.struct(*cells) if len(cells) > 1 else cells[0])
    offsets = _cell_offsets(celled, keys, {"n": F.count(F.lit(1))}, top).drop("_tot_n")
    if limit is not None:
        offsets = offsets.where(F.col("_off_n") < limit)
    if few_cells:
        offsets = F.broadcast(offsets)
    inside = W.partitionBy(*keys, CELL).orderBy(order, *ties)
    ranked = (
        null_safe_join(celled, offsets, [*keys, CELL])
        .withColumn(name, F.row_number().over(inside) + F.col("_off_n"))
        .drop(CELL, "_off_n")
    )
    return ranked if limit is None else ranked.where(F.col(name) <= limit)


def _between_ranks(probs: Mapping[str, float], n: Column) -> dict[str, tuple[Column, Column, Column]]:
    spots = {name: F.lit(float(p)) * (n - 1) for name, p in probs.items()}
    return {name: (F.floor(at), F.ceil(at), at - F.floor(at)) for name, at in spots.items()}


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    small_groups: bool = False,
    sketch: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, exact, plus ``n`` (values that are not NULL or NaN). Runs a job.

    Two reads of ``rows``. The first sketches each key's values. A sketch of ``sketch`` values brackets every wanted rank
    between two values, a few thousandths of the key apart. The second read counts what lies below each bracket and
    shuffles only values inside. Keys with fewer values than the sketch holds are sorted as they are. A rank that lay
    outside its bracket, which happens less than once in 10^30 sketches, would raise.

    ``small_groups`` says that keys are many and mostly small: they are counted instead of sketched, and sketched only if
    one has over ``hot_rows`` rows.
    """
    keys = list(keys)
    k = (CUT_SKETCH if not keys else GROUP_SKETCH) if sketch is None else sketch
    v = F.col(value).cast("double")
    data = rows.select(*keys, F.when(~F.isnan(v), v).alias("_v")).where(F.col("_v").isNotNull())
    if small_groups and hot_keys(data, keys, hot_rows=hot_rows) is None:
        return _pick(_sorted_groups(data, keys), keys, probs)

    error = _SAFE * _ERROR / k**_POWER + 1 / k
    found = data.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", k).alias("_s")).withColumn("_n", F.kll_sketch_get_n_double("_s"))
    ends = [(max(p - error, 0.0), min(p + error, 1.0)) for p in probs.values()]
    at = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(x) for pair in ends for x in pair]))
    brackets = F.array(*[F.struct(F.get("_at", F.lit(2 * j)).alias("lo"), F.get("_at", F.lit(2 * j + 1)).alias("hi")) for j in range(len(ends))])
    large = found.withColumn("_at", F.when(F.col("_n") > k, at)).where("_n > 0").select(*keys, "_n", F.when(F.col("_at").isNotNull(), brackets).alias("_b"))
    known = stage(large, "brackets")
    if known.where(F.col("_b").isNotNull()).isEmpty():
        return _pick(_sorted_groups(data, keys), keys, probs)

    if not keys or known.count() <= BROADCAST_ROWS:
        tagged = null_safe_join(data, F.broadcast(known), keys)
    else:
        tagged = join_lookup(data, known.withColumn("_size", F.col("_n")), keys, size="_size")
    # (which bracket, the value inside it or NULL below it); -1 for keys without brackets
    whole = F.array(F.struct(F.lit(-1).alias("j"), F.col("_v").alias("at")))
    placed = F.transform("_b", lambda b, j: F.struct(j.alias("j"), F.when(F.col("_v") >= b["lo"], F.col("_v")).alias("at"), (F.col("_v") > b["hi"]).alias("over")))
    inside = F.transform(F.filter(placed, lambda x: ~x["over"]), lambda x: F.struct(x["j"].alias("j"), x["at"].alias("at")))
    parts = tagged.select(*keys, "_n", F.explode(F.when(F.col("_b").isNull(), whole).otherwise(inside)).alias("_p")).select(*keys, "_n", "_p.j", F.col("_p.at").alias("_v"))
    counted = parts.groupBy(*keys, "_n", "j", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*keys, "j").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    return _pick(counted.withColumn("_upto", F.sum("_c").over(upto)), keys, probs)


def _sorted_groups(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every value with its place among those of its key; groups that a task can hold."""
    return data.select(
        *keys,
        "_v",
        F.lit(-1).alias("j"),
        F.lit(1).cast("bigint").alias("_c"),
        F.row_number().over(W.partitionBy(*keys).orderBy("_v")).cast("bigint").alias("_upto"),
        F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("_n"),
    )


def _pick(ranked: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from values (``_v``, ``_c`` times) that end at rank ``_upto`` of ``_n``, for bracket ``j`` or for all."""
    aggregates = [F.max("_n").alias("_n")]
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto")
    for j, (name, (lo, hi, frac)) in enumerate(_between_ranks(probs, F.col("_n")).items()):
        own = F.col("j").isin(-1, j)
        aggregates += [F.max(F.when(own & (first <= rank) & (rank < last), F.col("_v"))).alias(f"_{end}_{name}") for end, rank in (("lo", lo), ("hi", hi))]
        aggregates.append(F.max(frac).alias(f"_frac_{name}"))
    found = ranked.groupBy(*keys).agg(*aggregates).where(F.col("_n").isNotNull())
    outside = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")

    def between(name: str) -> Column:
        low, high = (F.coalesce(F.col(f"_{end}_{name}"), outside) for end in ("lo", "hi"))
        return (low + (high - low) * F.col(f"_frac_{name}")).alias(name)

    return found.select(*keys, F.col("_n").alias("n"), *[between(name) for name in probs])


def join_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], *, size: str | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Inner join to a table with one row per key, when one key may hold a large share of ``rows``. Runs a job.

    ``size`` names the lookup's column that tells how many rows each key has (dropped from the result), if it has every
    key of ``rows``; without it they are counted in ``rows``, so that hot keys that the lookup lacks are known, too. Rows
    of hot keys only meet a broadcast of their few lookup rows and stay where they are; all others go through a join.
    """
    keys = list(keys)
    carried = [c for c in lookup.columns if c not in (*keys, size)]
    if size is None:
        hot = hot_keys(rows, keys, hot_rows=hot_rows)
    else:
        lookup = stage(lookup, "lookup")  # read again by the join
        large = lookup.where(F.col(size) > _hot_limit(lookup, size, hot_rows)).select(*keys)
        hot = None if large.isEmpty() else large
        lookup = lookup.drop(size)
    if hot is None:
        return null_safe_join(rows, lookup, keys).select(*rows.columns, *carried)
    hot = F.broadcast(hot.select(*keys))
    spread = null_safe_join(rows, F.broadcast(null_safe_join(lookup, hot, keys, "left_semi")), keys)
    joined = null_safe_join(null_safe_join(rows, hot, keys, "left_anti"), lookup, keys)
    return joined.unionByName(spread).select(*rows.columns, *carried)
