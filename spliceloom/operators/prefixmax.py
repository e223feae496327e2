"""Running totals over positions: the largest value, or the number of rows, at or before a point, without pairs.

"Some interval with left <= p and right >= q" holds where the largest right end of all intervals
that start at or before p reaches q. Catalog and points are summed up to one row a position, so a
bin of positions holds at most its own width in rows, however many intervals or points share a
place, and a wide interval is one row. The maximum runs inside each bin; what earlier bins carry
over comes from a table of one row a bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 16


def running(catalog: DataFrame, points: DataFrame, keys: list[str], at: str, value: Column, total: Callable[[str], Column], two: Callable[[Column, Column], Column], *, bin_size: int = BIN) -> DataFrame:
    """(keys, at, best): for each place of ``points`` the ``total`` of ``value`` over the catalog's rows at or before it, null if none.

    ``catalog`` has keys and ``at`` and what ``value`` reads, ``points`` keys and ``at``; ``total``
    is a sum or a maximum, ``two`` the same of two columns. Rows with a null key or place are nowhere.
    """
    known = catalog.select(*keys, at, value.alias("_v"), F.lit(False).alias("_asked"))
    both = known.unionByName(points.select(*keys, at, F.lit(True).alias("_asked")), allowMissingColumns=True)
    places = both.dropna(subset=[*keys, at]).groupBy(*keys, at).agg(total("_v").alias("_v"), F.bool_or("_asked").alias("_asked"))
    places = places.withColumn("_b", F.floor(F.col(at) / bin_size))
    inside = Window.partitionBy(*keys, "_b").orderBy(at)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.groupBy(*keys, "_b").agg(total("_v").alias("_m")).select(*keys, "_b", total("_m").over(earlier).alias("_in"))
    own = places.withColumn("_own", total("_v").over(inside)).filter("_asked")
    return own.join(carried, [*keys, "_b"]).select(*keys, at, two(F.col("_own"), F.col("_in")).alias("best"))


def prefix_max(catalog: DataFrame, points: DataFrame, keys: list[str], at: str, value: str, *, bin_size: int = BIN) -> DataFrame:
    """(keys, at, best): the largest ``value`` of the catalog's rows at or before each place of ``points``."""
    return running(catalog, points, keys, at, F.col(value), F.max, F.greatest, bin_size=bin_size)


def prefix_count(catalog: DataFrame, points: DataFrame, keys: list[str], at: str, *, bin_size: int = BIN) -> DataFrame:
    """(keys, at, best): how many rows of the catalog lie at or before each place of ``points``; 0 for none."""
    return running(catalog, points, keys, at, F.lit(1).cast("long"), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), bin_size=bin_size)


def covered(rows: DataFrame, catalog: DataFrame, keys: list[str], span: tuple[Column, Column], interval: tuple[Column, Column]) -> DataFrame:
    """``rows`` that lie in some interval of the catalog with equal keys: interval left <= span left, span right <= interval right."""
    asked = rows.withColumn("_at", span[0].cast("long"))
    known = catalog.select(*keys, interval[0].cast("long").alias("_at"), interval[1].cast("long").alias("_right"))
    best = prefix_max(known, asked, keys, "_at", "_right")
    return asked.join(best, [*keys, "_at"]).filter(F.col("best") >= span[1]).drop("_at", "best")


def covering(rows: DataFrame, catalog: DataFrame, keys: list[str], span: tuple[Column, Column], interval: tuple[Column, Column]) -> DataFrame:
    """``rows`` that hold some interval of the catalog: span left <= interval left, interval right < span right.

    The mirror image: the smallest right end of the intervals at or after a place.
    """
    asked = rows.withColumn("_at", -span[0].cast("long"))
    known = catalog.select(*keys, (-interval[0].cast("long")).alias("_at"), (-interval[1].cast("long")).alias("_right"))
    best = prefix_max(known, asked, keys, "_at", "_right")
    return asked.join(best, [*keys, "_at"]).filter(-F.col("best") < span[1]).drop("_at", "best")
