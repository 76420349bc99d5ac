"""As-of join: each left row gets, of each right side, the newest row of its key that is not later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Side = tuple[DataFrame, dict[str, object]]


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: dict[str, object], slice_width: int | None = None) -> DataFrame:
    """Adds right's `values` columns (name -> default where there is no such row) to left. See asof_join_all."""
    return asof_join_all(left, [(right, values)], key, time, slice_width)


def asof_join_all(left: DataFrame, sides: list[Side], key: str, time: str, slice_width: int | None = None) -> DataFrame:
    """Adds the `values` columns of several right sides (name -> default where there is no such row) to left.

    All sides are put into one table that is sorted once for each key; equal times match. No range join: the work grows
    with the rows of all sides. With slice_width, a key's rows are sorted slice by slice of time, so that a hot key is
    as many tasks as it has slices; a slice begins with the last row of each side in the slices before, found from one
    row for each key and slice. A row with a null key matches only inside its slice.
    """
    names = [f"_side{k}" for k in range(len(sides))]
    held = [F.struct(*(F.col(v) for v in values)) for _, values in sides]
    kinds = [right.select(h.alias("h")).schema["h"].dataType for (right, _), h in zip(sides, held, strict=True)]
    whole = F.struct(*left.columns)
    left_kind = left.select(whole.alias("h")).schema["h"].dataType

    def rows(df: DataFrame, name: str, value: Column) -> DataFrame:
        every = zip(["_left", *names], [left_kind, *kinds], strict=True)
        return df.select(key, time, *((value if n == name else F.lit(None).cast(kind)).alias(n) for n, kind in every))

    both = rows(left, "_left", whole)
    for (right, _), name, h in zip(sides, names, held, strict=True):
        both = both.unionAll(rows(right, name, h))
    by = [key]
    if slice_width is not None:
        both, by = both.withColumn("_slice", F.floor(F.col(time) / slice_width)), [key, "_slice"]
    w = Window.partitionBy(*by).orderBy(F.col(time), F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(*by, "_left", *(F.last(n, ignorenulls=True).over(w).alias(n) for n in names)).filter(F.col("_left").isNotNull())
    if slice_width is not None:
        ends = both.groupBy(*by).agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col(time))).alias(n) for n in names))
        earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, *(F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_before") for n in names))
        found = found.join(carried, by, "left").select("_left", *(F.coalesce(n, f"{n}_before").alias(n) for n in names))
    out = []
    for (_, values), n in zip(sides, names, strict=True):
        out += [(F.col(f"{n}.{v}") if d is None else F.coalesce(F.col(f"{n}.{v}"), F.lit(d))).alias(v) for v, d in values.items()]
    return found.select("_left.*", *out)
