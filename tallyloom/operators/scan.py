"""Running values in the order of a key's rows, without bringing a key's rows to one task.

The order is cut into segments of a fixed width. Each segment is scanned by itself; what
it adds is a row of a summary, the summary is scanned in its turn, and what came before
a segment is joined to its rows. So a key with a third of all rows is spread over its
segments, and a task holds one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a segment in units of the order (lines, turns).
SEGMENT = 1 << 16


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, null meeting null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def scan(rows: DataFrame, by: tuple[str, ...], order: str, counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with, for each of ``counts``, how many rows up to this one (itself included) fulfil it, and for each of ``lasts``, its last value that is not null before this row.

    ``order`` is a whole number that orders the rows of a key; rows without one come first.
    """
    counts, lasts = counts or {}, lasts or {}
    keys = [*by, "_segment"]
    cut = rows.withColumn("_segment", F.floor(F.col(order) / segment)).withColumns({**{f"_c_{n}": c.cast("int") for n, c in counts.items()}, **{f"_l_{n}": c for n, c in lasts.items()}})
    own = Window.partitionBy(*keys).orderBy(order)
    until, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({**{n: F.coalesce(F.sum(f"_c_{n}").over(until), F.lit(0)) for n in counts}, **{n: F.last(f"_l_{n}", ignorenulls=True).over(before) for n in lasts}})
    place = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 62)))
    sums = cut.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_c_{n}").alias(f"_p_{n}") for n in counts],
        *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), place)).alias(f"_p_{n}") for n in lasts])
    earlier = Window.partitionBy(*by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, *[F.sum(f"_p_{n}").over(earlier).alias(f"_p_{n}") for n in counts], *[F.last(f"_p_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}") for n in lasts])
    joined = null_safe(local, carried, keys)
    out = joined.withColumns({**{n: F.col(n) + F.coalesce(f"_p_{n}", F.lit(0)) for n in counts}, **{n: F.coalesce(n, f"_p_{n}") for n in lasts}})
    return out.select(*rows.columns, *counts, *lasts)


def stamps(rows: DataFrame, by: tuple[str, ...], nth: str, here: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """Per key and stretch ``nth`` (a running count of turns): ``here``, what any row of the stretch says, and ``after``, what any row of the stretch before says.

    Aggregated in part before the shuffle: a stretch may be as long as its key.
    """
    own = rows.groupBy(*by, nth).agg(*[F.max(c).alias(n) for n, c in {**here, **after}.items()])
    both = own.select(*by, F.explode(F.array(
        F.struct(F.col(nth).alias(nth), *[F.col(n).alias(n) for n in here], *[F.lit(None).cast(own.schema[n].dataType).alias(n) for n in after]),
        F.struct((F.col(nth) + 1).alias(nth), *[F.lit(None).cast(own.schema[n].dataType).alias(n) for n in here], *[F.col(n).alias(n) for n in after]))).alias("s")).select(*by, "s.*")
    return both.groupBy(*by, nth).agg(*[F.max(n).alias(n) for n in (*here, *after)])
