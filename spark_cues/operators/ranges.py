"""Work along one long group, spread over tasks: the group is cut into ranges of its order, and what crosses an edge is carried."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, ship_package

#: Values of the order column that one range spans: so many rows at most where it numbers them.
WIDTH = 65_536


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``df`` joined to ``other`` by keys, nulls equal; the keys of ``other`` go."""
    named = {k: f"__key_{i}" for i, k in enumerate(keys)}
    return df.join(other.withColumnsRenamed(named), [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()], how).drop(*named.values())


def range_of(order: str, width: float = WIDTH) -> Column:
    return F.floor(F.col(order) / width).cast("bigint")


# --- windows with carried edges ----------------------------------------------------------------------------------------


def _placed(df: DataFrame, keys: list[str], order: str, width: float) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """``df`` with ``__k``, the range of a row, and the windows over a range's rows and over a group's ranges.

    The range is one struct of keys and number, equal where its nulls are, so that rows lie after the window where a join by it wants them.
    """
    ranged = df.withColumn("__k", F.struct(*keys, range_of(order, width).alias("__b")))
    return ranged, Window.partitionBy("__k").orderBy(order), Window.partitionBy(*[F.col("__k")[k] for k in keys]).orderBy(F.col("__k")["__b"])


def with_neighbours(df: DataFrame, keys: list[str], order: str, lag: list[str] = (), lead: list[str] = (), width: float = WIDTH) -> DataFrame:
    """``df`` with structs ``before`` and ``after``: the columns ``lag`` of the row before and ``lead`` of the row after, null where there is none.

    A window holds a range of a group at most; rows at its edges meet the last and first rows of the ranges beside it, of which
    there is one each.
    """
    ranged, w, by_group = _placed(df, keys, order, width)
    ahead, behind = F.struct(*(lead or [order])), F.struct(*(lag or [order]))
    rows = ranged.withColumns({"__before": F.lag(behind).over(w), "__after": F.lead(ahead).over(w)})
    edges = ranged.groupBy("__k").agg(F.min_by(ahead, order).alias("__first"), F.max_by(behind, order).alias("__last"))
    beside = edges.select("__k", F.lag("__last").over(by_group).alias("__left"), F.lead("__first").over(by_group).alias("__right"))
    both = rows.join(beside, "__k", "left")
    return both.select(*df.columns, F.col("__k")["__b"].alias("__b"), F.coalesce("__before", "__left").alias("before"), F.coalesce("__after", "__right").alias("after"))


def numbered_groups(df: DataFrame, keys: list[str], order: str, own: list[str], before: list[str], begins: Callable[[Column, Column], Column], name: str, width: float = WIDTH) -> DataFrame:
    """``df`` with ``name``: how many groups have begun up to each row, where ``begins(row, last)`` says whether a row begins one after the last row.

    ``row`` is a struct of the columns ``own``, ``last`` one of ``before``, null for a group's very first row.  Rows are counted within their range;
    whether a range's first row begins a group, and how many begin in the ranges before it, comes from a row a range.
    """
    ranged, w, by_group = _placed(df, keys, order, width)
    row, last = F.struct(*own), F.struct(*before)
    inner = ranged.withColumn("__l", F.lag(last).over(w)).withColumn("__v", F.when(F.col("__l").isNotNull() & begins(row, F.col("__l")), 1).otherwise(0))
    edges = inner.groupBy("__k").agg(F.min_by(row, order).alias("__first"), F.max_by(last, order).alias("__last"), F.sum("__v").alias("__s"))
    opened = edges.withColumn("__open", F.when(begins(F.col("__first"), F.lag("__last").over(by_group)), 1).otherwise(0))
    before_it = F.sum(F.col("__s") + F.col("__open")).over(by_group.rowsBetween(Window.unboundedPreceding, -1))
    base = opened.select("__k", (F.coalesce(before_it, F.lit(0)) + F.col("__open")).alias("__base"))
    counted = inner.withColumn("__n", F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.join(base, "__k", "left").select(*df.columns, (F.col("__n") + F.col("__base")).alias(name))


# --- folds by next-begin pointers --------------------------------------------------------------------------------------

#: Where the item that began with a value ends: the row at which the next one begins, the number of rows if it ends with the last, None if it stays
#: open.  Called with columns as lists, the value, the first row to look at, and whether that row is the item's own first.
NextBegin = Callable[[dict[str, list], float, int, bool], int | None]


def _summed_up(cols: dict[str, list], begins: list[float], follow: NextBegin, head: int) -> tuple[list[float], list[int]]:
    """For an item that begins at each of the first ``head`` rows, or after them: the open item's value that leaves the range (NaN: none), and the items begun."""
    n = len(begins)
    leaves, counts = [float("nan")] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        at = follow(cols, begins[i], i, True)
        leaves[i], counts[i] = (begins[i], 1) if at is None else (leaves[at], counts[at] + 1)
    return leaves[: head + 1], counts[: head + 1]


def entries(rows: DataFrame, keys: list[str], order: list[str], begin: str, columns: list[str], follow: NextBegin, reach: Callable[[dict[str, list], list[float]], int]) -> DataFrame:
    """``(*keys, __b, __begun, __items, __lost)``: the open item's value and the number of items begun when each range of a long group is entered.

    Every range ``__b`` is summed up in a task of its own: for its first rows, what state leaves it if an item begins there.  These
    summaries, a row a range, are composed in order.  ``reach`` says how many first rows decide where an open item of an earlier
    range ends; where they don't (times that go back), the group is ``__lost`` and has to be folded in one piece.
    """
    ship_package(rows.sparkSession)
    named = [f for f in rows.schema.fields if f.name in keys]
    real, whole = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
    summary = T.StructType([*named, T.StructField("b", T.LongType()), T.StructField("first", T.ArrayType(real)), T.StructField("all", T.BooleanType()), T.StructField("leaves", real), T.StructField("counts", whole)])
    out = T.StructType([*named, T.StructField("__b", T.LongType()), T.StructField("__begun", T.DoubleType()), T.StructField("__items", T.LongType()), T.StructField("__lost", T.BooleanType())])

    def sum_up(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(order, kind="stable", ignore_index=True)
        cols, begins = {c: block[c].astype(float).tolist() for c in columns}, block[begin].astype(float).tolist()
        head = reach(cols, begins)
        leaves, counts = _summed_up(cols, begins, follow, head)
        first = [[cols[c][i] for c in columns] for i in range(head)]
        return pd.DataFrame([[*(block[k].iloc[0] for k in [*keys, "__b"]), first, head == len(begins), leaves, counts]], columns=summary.names)

    def compose(ranges: pd.DataFrame) -> pd.DataFrame:
        found, begun, items = [], float("nan"), 0
        for r in ranges.sort_values("b").to_dict("records"):
            key = [r[k] for k in keys]
            found.append([*key, r["b"], begun, items, False])
            cols = {c: [row[i] for row in r["first"]] for i, c in enumerate(columns)}
            at = 0 if begun != begun else follow(cols, begun, 0, False)
            if at is not None and at < len(r["leaves"]):
                begun, items = r["leaves"][at], items + int(r["counts"][at])
            elif at is not None or not r["all"]:
                return pd.DataFrame([[*key, r["b"], float("nan"), 0, True]], columns=out.names)
        return pd.DataFrame(found, columns=out.names)

    long = rows.groupBy(*keys).agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi")).where("__hi > __lo").select(*keys)
    parts = _beside(rows, long, keys, "left_semi").select(*dict.fromkeys([*keys, "__b", *order, begin, *columns])).groupBy(*keys, "__b").applyInPandas(sum_up, summary)
    entered = parts.groupBy(*keys).applyInPandas(compose, out)
    return entered.withColumn("__begun", F.when(~F.isnan("__begun"), F.col("__begun")))


def with_entries(rows: DataFrame, keys: list[str], entered: DataFrame) -> DataFrame:
    """``rows`` with ``__begun`` and ``__items`` of their range; ranges of lost groups become one."""
    known = cut(entered)  # a row a range of the long groups, read twice
    at = known.where("not __lost").drop("__lost")
    lost = known.where("__lost").select(*keys, F.lit(True).alias("__lost"))
    both = _beside(_beside(rows, at, [*keys, "__b"]), lost, keys)
    return both.select(*[c for c in rows.columns if c != "__b"], F.when(F.col("__lost"), 0).otherwise(F.col("__b")).alias("__b"), "__begun", F.coalesce("__items", F.lit(0)).cast("bigint").alias("__items"))
