"""Windows over keys of any size.

A window function needs the rows of its key in one task. Here a key of more rows than that may
hold is cut into ranges of its order columns: rolling frames get the last rows of the range before,
running values get what the ranges before add up to, and the window itself is partitioned by key
and range. Keys of fewer rows keep their plain window, so small tables pay a count and no more.

Ranges come from histograms over the order columns, so that all uses of a table agree on them
without a sample or a sorted copy. A cell of too many rows gets a histogram of its own, over the
next order column if all its rows have one value. The driver sees a few counts for each range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key that one task takes; ranges have this many at least, and twice as many at most
#: unless more rows are equal in all order columns.
ROWS = 1_000_000
#: Tables of at most this many rows (one for each range) are broadcast; larger ones are shuffled.
SMALL = 250_000
#: Cells of a histogram for each range expected, and at most.
FINE, CELLS = 4, 4096
RANGE = "_range"


def _number(df: DataFrame, name: str) -> Column:
    """The column as a long or double that orders alike."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return F.col(name).cast("long")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.col(name).cast("double")
    raise ValueError(f"{name}: ranges need order columns of numbers, dates or timestamps")


@dataclass
class _Leaf:
    """Rows that get a histogram: those of a key, or of a cell. Cells -1 and ``cells`` hold nulls
    and infinities."""

    key: int
    path: tuple[int, ...]
    column: int
    low: float
    width: float
    cells: int
    targets: dict[int, int] = field(default_factory=dict)


class Cut:
    """A table with the number of each row's range: -1 for keys that are whole."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS):
        self.source, self.keys, self.order, self.rows = df, list(keys), list(order), rows
        self._numbers = [_number(df, c) for c in order]
        self._whole = [isinstance(df.select(x).schema[0].dataType, T.LongType) for x in self._numbers]
        self._levels: list[list[_Leaf]] = []
        self._hot = df.groupBy(*keys).agg(*self._stats()).filter(F.col("_n") > rows).collect()
        self.ranges = self._number_ranges() if self._hot else 0
        self.df = self._routed()

    def _finite(self, i: int) -> Column:
        x = self._numbers[i]
        return x if self._whole[i] else F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    def _stats(self) -> list[Column]:
        out = [F.count("*").alias("_n")]
        for i, x in enumerate(self._numbers):
            high = F.lit(False) if self._whole[i] else F.isnan(x) | (x == float("inf"))
            out += [F.min(self._finite(i)).alias(f"_low{i}"), F.max(self._finite(i)).alias(f"_high{i}"), F.count_if(x.isNull() | (x == float("-inf"))).alias(f"_first{i}"), F.count_if(high).alias(f"_last{i}")]
        return out

    def _leaf(self, row, key: int, path: tuple[int, ...], column: int) -> _Leaf | None:
        """A histogram over the first order column of more than one value, from the given one on."""
        for i in range(column, len(self.order)):
            low, high = row[f"_low{i}"], row[f"_high{i}"]
            if (low is not None) + (row[f"_first{i}"] > 0) + (row[f"_last{i}"] > 0) > 1 or (low is not None and low < high):
                cells = min(CELLS, FINE * -(-row["_n"] // self.rows))
                low, high = (0, 0) if low is None else (low, high)
                width = (high - low) // cells + 1 if self._whole[i] else ((high - low) / cells or 1.0)
                return _Leaf(key, path, i, low, width, cells)
        return None

    def _number_ranges(self) -> int:
        """Follows the heavy cells down, then numbers the pieces of each key in their order."""
        level = [leaf for i, row in enumerate(self._hot) if (leaf := self._leaf(row, i, (), 0))]
        pieces: list[tuple[int, tuple[int, ...], int, _Leaf | None, int]] = []
        while level:
            self._levels.append(level)
            counted = self._routed().filter("_leaf is not null").groupBy("_leaf", "_cell").agg(*self._stats()).collect()
            below: list[_Leaf] = []
            for row in sorted(counted, key=lambda r: (r["_leaf"], r["_cell"])):
                leaf, cell = level[row["_leaf"]], row["_cell"]
                deeper = self._leaf(row, leaf.key, (*leaf.path, cell), leaf.column) if row["_n"] > 2 * self.rows else None
                if deeper:
                    leaf.targets[cell] = -len(below) - 1
                    below.append(deeper)
                else:
                    pieces.append((leaf.key, (*leaf.path, cell), row["_n"], leaf, cell))
            level = below
        number, held, last = -1, self.rows, None
        for key, _, n, leaf, cell in sorted(pieces, key=lambda p: p[:2]):
            if key != last or held >= self.rows:
                number, held, last = number + 1, 0, key
            held += n
            leaf.targets[cell] = number
        return number + 1

    def _routed(self) -> DataFrame:
        """The table with _range, and (while ranges are made) the histogram and cell of each row."""
        spark, at = self.source.sparkSession, self.source.columns
        if not self._levels:
            return self.source.withColumn(RANGE, F.lit(-1))
        kept, df = F.lit(-1), self.source
        for depth, level in enumerate(self._levels):
            rows = [(i, x.column, *((int(x.low), int(x.width), 0.0, 1.0) if self._whole[x.column] else (0, 1, float(x.low), float(x.width))), x.cells, [x.targets.get(c) for c in range(-1, x.cells + 1)]) for i, x in enumerate(level)]
            schema = "_id int, _column int, _low long, _width long, _lowd double, _widthd double, _cells int, _targets array<int>"
            if depth == 0:
                named = [T.StructField(f"_key{i}", self.source.schema[k].dataType) for i, k in enumerate(self.keys)]
                rows = [tuple(self._hot[x.key][k] for k in self.keys) + r for x, r in zip(level, rows, strict=True)]
                leaves = spark.createDataFrame(rows, T.StructType(named + T.StructType.fromDDL(schema).fields))
                on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(self.keys)] or [F.lit(True)]
            else:
                leaves, on = spark.createDataFrame(rows, schema), [F.col("_next") == F.col("_id")]
            small = len(level) <= SMALL
            df = df.join(F.broadcast(leaves) if small else leaves, on, "left")
            cell = F.lit(None).cast("int")
            for i, x in enumerate(self._numbers):
                if self._whole[i]:
                    off = x - F.col("_low")
                    inner = (off - F.pmod(off, F.col("_width"))) / F.col("_width")  # exact: multiples of the width
                    own = F.when(x.isNull(), -1).otherwise(inner.cast("int"))
                else:
                    inner = F.least(F.floor((x - F.col("_lowd")) / F.col("_widthd")), F.col("_cells") - 1)
                    own = F.when(x.isNull() | (x == float("-inf")), -1).when(F.isnan(x) | (x == float("inf")), F.col("_cells")).otherwise(inner.cast("int"))
                cell = F.when(F.col("_column") == i, own).otherwise(cell)
            target = F.get("_targets", F.col("_cell") + 1)
            df = df.withColumn("_cell", cell).withColumn("_target", target)
            last = depth == len(self._levels) - 1
            kept = F.when(F.col("_target") >= 0, F.col("_target")).otherwise(F.col("_kept") if depth else F.lit(-1))
            more = [F.col("_id").alias("_leaf"), F.col("_cell")] if last else []
            df = df.select(*at, kept.alias("_kept"), F.when(F.col("_target") < 0, -F.col("_target") - 1).alias("_next"), *more)
        return df.withColumn(RANGE, F.col("_kept")).drop("_kept", "_next")

    @property
    def by(self) -> list[str]:
        return [*self.keys, RANGE]

    @property
    def window(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def rows_of(self, df: DataFrame | None = None) -> DataFrame:
        return self.df.drop("_leaf", "_cell") if df is None else df

    def with_carried(self, df: DataFrame, totals: DataFrame, carried: dict[str, Column]) -> DataFrame:
        """``df`` beside values made from the totals of all earlier ranges of its key, null on the
        first. ``carried`` are columns over a window of the totals."""
        before = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.by)], *[x.alias(name) for name, x in carried.items()])
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.by)]
        joined = df.join(F.broadcast(before) if self.ranges <= SMALL else before, on, "left")
        return joined.drop(*[f"_k{i}" for i in range(len(self.by))])

    @property
    def earlier(self):
        return Window.partitionBy(*self.keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _last_of(x: Column, order: Sequence[str]) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))


#: How a running value is made of a frame, of all rows of a range, and of two parts.
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, lambda x, _: F.sum(x), lambda a, b: a + b),
    "product": (F.product, lambda x, _: F.product(x), lambda a, b: a * b),
    "max": (F.max, lambda x, _: F.max(x), F.greatest),
    "last": (lambda x: F.last(x, ignorenulls=True), _last_of, lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame | Cut, keys: Sequence[str] = (), order: Sequence[str] = (), values: dict[str, tuple[str, Column]] | None = None, rows: int = ROWS) -> DataFrame:
    """Running values of each key: name -> (kind, of what), over all rows up to and with each.

    Kinds are sum, product, max and last (the last that isn't null). Nulls are passed over; a
    value is null until there is one that isn't.
    """
    cut = df if isinstance(df, Cut) else Cut(df, keys, order, rows)
    frame = cut.window.rowsBetween(Window.unboundedPreceding, 0)
    base = cut.rows_of()
    out = base.withColumns({name: KINDS[kind][0](x).over(frame) for name, (kind, x) in values.items()})
    if not cut.ranges:
        return out.drop(RANGE)
    totals = base.filter(F.col(RANGE) >= 0).groupBy(*cut.by).agg(*[KINDS[kind][1](x, cut.order).alias(name) for name, (kind, x) in values.items()])
    carried = {f"_before_{name}": KINDS[kind][0](F.col(name)).over(cut.earlier) for name, (kind, _) in values.items()}
    out = cut.with_carried(out, totals, carried)
    joined = {name: F.coalesce(KINDS[kind][2](F.col(f"_before_{name}"), F.col(name)), F.col(name), F.col(f"_before_{name}")) for name, (kind, _) in values.items()}
    return out.withColumns(joined).drop(RANGE, *carried)


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, values: Callable[[object], dict[str, Column]], rows: int = ROWS) -> DataFrame:
    """Values over each row and the n - 1 before it in its key.

    ``values`` makes columns of a window that is ordered and partitioned but has no frame. Each range
    gets the last n - 1 rows of the range before, found with a limit that tasks apply before they
    shuffle.
    """
    cut = Cut(df, keys, order, max(rows, n))
    base = cut.rows_of()
    if not cut.ranges or n < 2:
        return base.withColumns(values(cut.window)).drop(RANGE)
    backwards = Window.partitionBy(*cut.by).orderBy(*[F.col(c).desc() for c in order])
    tail = base.filter(F.col(RANGE) >= 0).withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") < n).drop("_back")
    both = base.withColumn("_own", F.lit(True)).unionByName(tail.withColumn(RANGE, F.col(RANGE) + 1).withColumn("_own", F.lit(False)))
    return both.withColumns(values(cut.window)).filter("_own").drop("_own", RANGE)


def compound(df: DataFrame, keys: Sequence[str], order: Sequence[str], factor: Column, start: float, name: str = "bankroll", peak: str = "peak", rows: int = ROWS) -> DataFrame:
    """``start`` times the product of the factors so far, and the greatest value so far (the start too).

    A range's part in a path is its product and the greatest product within it. Both together say
    where the next range starts and what peak it starts under.
    """
    cut = Cut(df, keys, order, rows)
    frame = cut.window.rowsBetween(Window.unboundedPreceding, 0)
    own = cut.rows_of().withColumn(name, F.product(factor).over(frame))
    own = own.withColumn(peak, F.max(name).over(frame))
    at, top = F.lit(start), F.lit(start)
    if cut.ranges:
        totals = own.filter(F.col(RANGE) >= 0).groupBy(*cut.by).agg(F.product(factor).alias("_product"), F.max(name).alias("_greatest"))
        totals = totals.withColumn("_at", F.lit(start) * F.coalesce(F.product("_product").over(cut.earlier), F.lit(1.0)))
        own = cut.with_carried(own, totals, {"_at": F.col("_at"), "_top": F.max(F.col("_at") * F.col("_greatest")).over(cut.earlier)})
        at, top = F.coalesce("_at", at), F.greatest("_top", top)
    out = own.withColumn(peak, F.greatest(at * F.col(peak), top)).withColumn(name, at * F.col(name))
    return out.drop(RANGE, "_at", "_top")


#: Products of many factors are kept as sums of log10 in whole units of this many to one.
LOG_UNITS = 10**14
#: What a factor of 0 or less counts as; sums below half of it are products of 0.
RUIN = Decimal(-(10**26))


def log_units(factor: Column) -> Column:
    """log10 of a factor in whole units, so that sums are exact in any order and never run out of range."""
    units = F.round(F.log10(factor) * F.lit(float(LOG_UNITS))).cast("decimal(18,0)").cast("decimal(28,0)")
    return F.when(factor <= 0, F.lit(RUIN).cast("decimal(28,0)")).otherwise(units)


def from_log_units(units: Column) -> Column:
    return F.pow(F.lit(10.0), units.cast("double") / F.lit(float(LOG_UNITS)))


def log_compound(df: DataFrame, keys: Sequence[str], order: Sequence[str], factor: Column, name: str = "log_units", peak: str = "peak_units", rows: int = ROWS) -> DataFrame:
    """The product of the factors so far, and the greatest so far (that of none, 1, too), in log units.

    As ``compound``, but exact in any order and for products beyond what doubles hold.
    """
    cut = Cut(df, keys, order, rows)
    frame, zero = cut.window.rowsBetween(Window.unboundedPreceding, 0), F.lit(0).cast("decimal(38,0)")
    own = cut.rows_of().withColumn("_units", log_units(factor))
    own = own.withColumn(name, F.coalesce(F.sum("_units").over(frame), zero))
    own = own.withColumn(peak, F.max(name).over(frame))
    at, top = zero, zero
    if cut.ranges:
        totals = own.filter(F.col(RANGE) >= 0).groupBy(*cut.by).agg(F.sum("_units").alias("_sum"), F.max(name).alias("_greatest"))
        totals = totals.withColumn("_at", F.coalesce(F.sum("_sum").over(cut.earlier), zero).cast("decimal(38,0)"))
        own = cut.with_carried(own, totals, {"_at": F.col("_at"), "_top": F.max(F.col("_at") + F.col("_greatest")).over(cut.earlier)})
        at, top = F.coalesce("_at", at), F.greatest("_top", top)
    out = own.withColumn(peak, F.greatest(at + F.col(peak), top).cast("decimal(38,0)")).withColumn(name, (at + F.col(name)).cast("decimal(38,0)"))
    return out.drop(RANGE, "_at", "_top", "_units")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], ties: Sequence[str] = (), before: bool = False, rows: int = ROWS) -> DataFrame:
    """Each row of ``left`` with the values of the last row of ``right`` of its keys that isn't later.

    With ``before`` the row must be earlier. Rows of ``right`` at one time follow ``ties``. Where
    there is none the values are null. Both sides are put together and the last values carried on
    along the time, over the edges of ranges too; no pairs are made. A null key meets a null key; a null time
    meets nothing, on either side.
    """
    mine = [F.col(c) for c in left.columns]
    nothing = F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema[0].dataType)
    own = left.select(*mine, nothing.alias("_value"), F.lit(0 if before else 1).alias("_side"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(ties)])
    other = right.filter(F.col(time).isNotNull()).select(*keys, time, F.struct(*values).alias("_value"), F.lit(1 if before else 0).alias("_side"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)])
    both = own.withColumn("_left", F.lit(True)).unionByName(other.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    order = [time, "_side", *[f"_tie{i}" for i in range(len(ties))]]
    found = running(both, keys, order, {"_found": ("last", F.col("_value"))}, rows).filter("_left")
    return found.select(*mine, *[F.col("_found")[v].alias(v) for v in values])
