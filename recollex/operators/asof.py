"""What holds at each of many times: as-of joins of intervals, and counts of them, without comparing all pairs.

Intervals are half-open; an unknown start is valid at every time, an unknown end never comes. Intervals that end at or
before their start hold at no time; null times meet nothing but intervals of unknown start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.operators.kg import valid_at

#: The times' range is cut into 2 ** DEPTH cells.
DEPTH = 16
CELLS = 1 << DEPTH


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _range(times: DataFrame, at: str) -> tuple[int, int]:
    """The least time and the width of a cell, in microseconds."""
    r = times.agg(F.min(_micros(F.col(at))).alias("lo"), F.max(_micros(F.col(at))).alias("hi")).head()
    lo, hi = (r.lo, r.hi) if r.lo is not None else (0, 0)
    return lo, (hi - lo) // CELLS + 1


def _cover(a: Column, b: Column) -> Column:
    """The ranges of cells, each 2 ** level long and at a multiple of its length, that make up [a, b): at most two a level,
    however long the interval is, and disjoint, so a cell is in one of them at most."""
    nodes = []
    for level in range(DEPTH + 1):
        step = 1 << level
        left, right = F.floor((a + (step - 1)) / step), F.floor(b / step)
        open_ = left < right
        for taken, node in ((open_ & (left % 2 == 1), left), (open_ & (right % 2 == 1), right - 1)):
            nodes.append(F.when(taken, F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"))))
    return F.filter(F.array(*nodes), lambda x: x.isNotNull())


def join(times: DataFrame, intervals: DataFrame, keys: list[str] | None = None, at: str = "at", start: str = "valid_from", stop: str = "valid_until") -> DataFrame:
    """Each row of times with every row of intervals that is valid at it, and has the same keys if there are any. Columns:
    those of times, then the other ones of intervals.

    An interval is cut into at most two ranges a level and a time looks up the one range of each level that it is in, so
    the join is on equal ranges, of (keys, level, range): rows that meet are results, but for those in the cells of an
    interval's ends, which are tested. Long intervals make no more rows than a few dozen, and a hot key is spread over its
    ranges. One pass before the join finds the range of the times. The join is a merge of two shuffled sides."""
    keys = list(keys or [])
    lo, width = _range(times, at)
    cell = lambda micros: F.floor((micros - lo) / width)
    always = F.col(start).isNull()
    first = F.when(always, F.lit(0)).otherwise(F.greatest(cell(_micros(F.col(start))), F.lit(0)))
    last = F.when(always | F.col(stop).isNull(), F.lit(CELLS - 1)).otherwise(F.least(cell(_micros(F.col(stop)) - 1), F.lit(CELLS - 1)))
    cut = intervals.withColumn("__node", F.explode(_cover(first.cast("long"), last.cast("long") + 1)))
    own = [F.struct(F.lit(level).alias("level"), F.shiftright(F.col("__cell"), level).alias("node")) for level in range(DEPTH + 1)]
    probes = times.withColumn("__cell", F.coalesce(cell(_micros(F.col(at))).cast("long"), F.lit(0))).withColumn("__node", F.explode(F.array(*own))).drop("__cell")
    # neither side is broadcast: Spark takes the ranges for as few rows as the intervals that they are cut from
    met = probes.join(cut.hint("merge"), [*keys, "__node"]).where(F.coalesce(valid_at(F.col(at), start, stop), F.lit(False)))
    return met.select(*times.columns, *[c for c in intervals.columns if c not in keys])


def counts(times: DataFrame, intervals: DataFrame, keys: list[str] | None = None, at: str = "at", start: str = "valid_from", stop: str = "valid_until") -> DataFrame:
    """Each row of times with `valid`, the number of intervals (of the same keys, if any) that are valid at it.

    No pairs are made: an interval adds one where it starts and takes one away where it ends; these changes are summed by
    time, by cell and over the cells before. A task has the cells of a key, whose number is fixed, or the different times
    of one cell. Null times get the number of intervals of unknown start."""
    keys = list(keys or [])
    lo, width = _range(times, at)
    floor = F.timestamp_micros(F.lit(lo)).cast(times.schema[at].dataType)
    some = intervals.where(F.col(start).isNotNull() & (F.col(stop).isNull() | (F.col(stop) > F.col(start))))
    always = intervals.where(F.col(start).isNull()).groupBy(*keys).agg(F.count("*").alias("__always"))
    up = some.select(*keys, F.greatest(F.col(start), floor).alias(at), F.lit(1).alias("__d"))
    down = some.where(F.col(stop).isNotNull()).select(*keys, F.greatest(F.col(stop), floor).alias(at), F.lit(-1).alias("__d"))
    asked = times.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("__d"))
    steps = up.unionByName(down).unionByName(asked).groupBy(*keys, at).agg(F.sum("__d").alias("__d"))
    steps = steps.withColumn("__cell", F.least(F.floor((_micros(F.col(at)) - lo) / width), F.lit(CELLS)).cast("long"))
    cells = steps.groupBy(*keys, "__cell").agg(F.sum("__d").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*keys, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    same = lambda a, b, names: [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]  # noqa: E731, ARG005
    inside = F.sum("__d").over(Window.partitionBy(*keys, "__cell").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    run = steps.where(F.col("__cell") < CELLS).withColumn("__in", inside).alias("a").join(cells.alias("b"), same("a", "b", [*keys, "__cell"]))
    found = run.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{at}"), (F.col("__in") + F.col("__before")).alias("__n"))
    out = times.alias("a").join(found.alias("b"), same("a", "b", [*keys, at]), "left").select("a.*", "b.__n")
    out = out.alias("a").join(always.alias("b"), same("a", "b", keys), "left") if keys else out.alias("a").crossJoin(F.broadcast(always.alias("b")))  # without keys one row
    return out.select(*[F.col(f"a.{c}") for c in times.columns], (F.coalesce("__n", F.lit(0)) + F.coalesce("__always", F.lit(0))).alias("valid"))
