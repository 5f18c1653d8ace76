"""Ordered work on series of any length: rows are cut into ranges of their order, and what a range needs from others is carried.

A range is a key's rows between two bounds of the order column. Bounds are approximate quantiles over all rows, fixed as
literals, so a key that holds most rows is in many ranges and every recomputation cuts alike. ``edged`` sums each
range up in one row (last or first value, or a sum), scans these few rows along each key, and adds the result as an edge row before
or after the range's own rows: a window of the range then sees all that came before. No window spans a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that ranges bring: role of a row, its range, its place in it, rows of the key before the range, and position.
ROLE, RANGE, PLACE, OFFSET, POSITION = "__role", "__b", "__j", "__off", "__i"


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def ranged(df: DataFrame, order: str, name: str = RANGE, parts: int | None = None) -> DataFrame:
    """``df`` with the number of a range of ``order`` (a number or a stamp), about equally filled; nulls are range -1.

    The bounds are approximate quantiles, fixed as literals, so a range is a plain function of the row
    and the same in every recomputation.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[order]
    x = micros(q(order)).cast("double") if kind.startswith(("timestamp", "date")) else q(order).cast("double")
    bounds = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: x > b)) if bounds else F.lit(0)
    return df.withColumn(name, F.when(x.isNull(), -1).otherwise(above))


def sums_before(counts: DataFrame, cols: list[str]) -> DataFrame:
    """For each range the sums of all lower ones; one row a range."""
    w = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(RANGE).alias("__q"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__before_{c}") for c in cols])


class Edged:
    """Rows in ranges with edge rows, and the windows over a range."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str]):
        self.rows = rows
        by = [*[q(k) for k in keys], F.col(RANGE)]
        up = Window.partitionBy(*by).orderBy(F.col(ROLE), *[q(c) for c in order])
        # backwards instead of a frame that ends at the last row: that one is evaluated anew for each row
        down = Window.partitionBy(*by).orderBy(F.col(ROLE).desc(), *[q(c).desc() for c in order])
        self.rowwise = up
        self.up = up.rowsBetween(Window.unboundedPreceding, 0)
        self.down = down.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, name: str) -> Column:
        """The last non-null value of ``name`` at or before the row, in its range or earlier ones."""
        return F.last(q(name), ignorenulls=True).over(self.up)

    def first(self, name: str) -> Column:
        """The first non-null value of ``name`` at or after the row."""
        return F.last(q(name), ignorenulls=True).over(self.down)

    def total(self, name: str) -> Column:
        """The sum of ``name`` up to the row."""
        return F.sum(q(name)).over(self.up)

    def done(self, rows: DataFrame) -> DataFrame:
        """``rows`` without edges, and without the columns that they brought."""
        return rows.filter(F.col(ROLE) == 0).drop(ROLE, RANGE, PLACE, OFFSET, POSITION)


def edged(df: DataFrame, keys: list[str], order: list[str], carry: dict[str, tuple[str, Column]], parts: int | None = None, numbered: bool = False) -> Edged:
    """``df`` in ranges with a new column for each of ``carry``: name -> (how, its value at a row).

    Edge rows hold null in all of the table's other columns; in theirs of ``carry`` they hold the ``last`` value or ``sum`` of all
    earlier ranges of the key, or the ``first`` value of all later ones. ``last_at`` and ``first_at`` give (i, v), the value with
    its row's position in the key; they need ``numbered``, which adds the position as ``__i``. Keys may be null.
    """
    keys, order = list(keys), list(order)
    by = [*[q(k) for k in keys], F.col(RANGE)]
    rows = ranged(df, order[0], parts=parts).withColumn(ROLE, F.lit(0))
    if numbered:
        rows = rows.withColumn(PLACE, F.row_number().over(Window.partitionBy(*by).orderBy(*[q(c) for c in order])).cast("long"))
        order = [PLACE]
    at = [n for n, (how, _) in carry.items() if how.endswith("_at")]
    pair = lambda i, v: F.when(v.isNotNull(), F.struct(i.alias("i"), v.alias("v")))
    rows = rows.withColumns({n: pair(F.col(PLACE), v) if n in at else v for n, (_, v) in carry.items()})
    place = F.struct(*[q(c) for c in order])

    def summed(name: str, how: str) -> Column:
        if how == "sum":
            return F.sum(q(name))
        pick = F.max_by if how.startswith("last") else F.min_by
        return pick(q(name), F.when(q(name).isNotNull(), place))

    along = Window.partitionBy(*by[:-1]).orderBy(RANGE)
    # ranges of a key are as many as partitions at most, so windows over their summaries are small
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[summed(n, how).alias(n) for n, (how, _) in carry.items()])
    found = found.withColumn(OFFSET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    found = found.withColumns({n: F.when(q(n).isNotNull(), F.struct((q(n)["i"] + F.col(OFFSET)).alias("i"), q(n)["v"].alias("v"))) for n in at})
    scan = {"last": lambda n: F.last(q(n), ignorenulls=True).over(earlier), "first": lambda n: F.last(q(n), ignorenulls=True).over(later), "sum": lambda n: F.sum(q(n)).over(earlier)}
    scan |= {"last_at": scan["last"], "first_at": scan["first"]}
    after = [n for n, (how, _) in carry.items() if how.startswith("first")]
    before = [n for n in carry if n not in after]
    edges = []
    if before or numbered:
        edges.append(found.select(*by, F.lit(-1).alias(ROLE), *([OFFSET] if numbered else []), *[scan[carry[n][0]](n).alias(n) for n in before]))
    if after:
        edges.append(found.select(*by, F.lit(1).alias(ROLE), *[scan["first"](n).alias(n) for n in after]))
    for e in edges:
        rows = rows.unionByName(e, allowMissingColumns=True)
    out = Edged(rows, keys, order)
    if numbered:
        out.rows = rows.withColumn(POSITION, F.col(PLACE) + out.last(OFFSET))
        out.rows = out.rows.withColumns({n: F.when(F.col(ROLE) == 0, pair(F.col(POSITION), q(n)["v"])).otherwise(q(n)) for n in at})
    return out


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with each row's position in its key's ``order``, from 1; ties in ``order`` come in any order, each once."""
    e = edged(df, keys, order, {}, parts, numbered=True)
    return e.done(e.rows.withColumn(name, F.col(POSITION)))
