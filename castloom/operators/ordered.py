"""Order-dependent columns (running sums, positions, neighbours) without hot tasks.

A plain window sends every row of one key to one task. Keys with few rows get just that: one
shuffle. A key with more than HOT_ROWS rows is cut along its order at borders that are taken
once, from a bounded sample, and then stand in the plan as literals: every evaluation, also
after an executor is lost, sees the same parts, so nothing has to be written down in between.
Each part computes its own rows, and what crosses a border is carried by one summary row per
hot key and part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from castloom.operators.rows import hash_sample

#: Rows of a key from which on it is cut, and into how many parts.
HOT_ROWS, PARTS = 200_000, 64
#: Hot keys that are cut: any other key then has less than a thousandth of the rows.
MOST_HOT = 1000
#: Rows that the borders are taken from.
SAMPLE_ROWS = 4096

_PART = "_part"


def _literal(value) -> Column:
    if isinstance(value, Row):
        return F.struct(*(_literal(v).alias(n) for n, v in zip(value.__fields__, value, strict=True)))
    return F.lit(value)


def _same(keys: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return same


def _hot_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, int]:
    """The hot keys, at most MOST_HOT rows, or None, and how many rows they have."""
    count = F.count(F.lit(1)).alias("_n")
    rows = (
        df.groupBy(*keys).agg(count).where(F.col("_n") > HOT_ROWS)
        .orderBy(F.col("_n").desc()).limit(MOST_HOT).collect()
    )
    if not rows:
        return None, 0
    fields = [f for f in df.select(*keys).schema.fields] if keys else []
    schema = df.select(*keys).schema if fields else "_all int"
    data = [tuple(r[k] for k in keys) if keys else (1,) for r in rows]
    hot = df.sparkSession.createDataFrame(data, schema)
    named = hot.select(*(F.col(k).alias(f"_h{k}") for k in keys), F.lit(True).alias("_hot"))
    return named, sum(r["_n"] for r in rows)


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, bool]:
    """Rows with the part of their key they belong to, and whether any key is cut.

    ``order`` must identify a row within its key; only then can a hot key be cut.
    """
    hot, count = _hot_keys(df, keys)
    if hot is None:
        return df.withColumn(_PART, F.lit(0)), False
    marked = df.join(F.broadcast(hot), _same(keys, "_h"), "left") if keys else df.withColumn("_hot", F.lit(True))
    sample = hash_sample(marked.where("_hot").select(*order), order, count, SAMPLE_ROWS)
    sample = sample.orderBy(*order).collect()
    picked = [sample[len(sample) * i // PARTS] for i in range(1, PARTS)]
    at = F.struct(*order)
    part = F.lit(0)
    for row in sorted(set(picked), key=picked.index):
        border = F.struct(*(_literal(row[o]).cast(df.schema[o].dataType).alias(o) for o in order))
        part += F.when(border <= at, 1).otherwise(0)
    part = F.when(F.col("_hot"), part).otherwise(0)
    return marked.withColumn(_PART, part).drop("_hot", *(f"_h{k}" for k in keys)), True


def _carried(df: DataFrame, keys: Sequence[str], summary: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys, _PART).agg(*[c.alias(n) for n, c in summary.items()])


def _attach(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the border rows: at most PARTS per hot key, hence the broadcast."""
    renamed = carried.withColumnsRenamed({c: f"_c{c}" for c in (*keys, _PART)})
    condition = (F.col(_PART) == F.col(f"_c{_PART}")) & _same(keys, "_c")
    joined = df.join(F.broadcast(renamed), condition, "left")
    return joined.drop(*[f"_c{c}" for c in (*keys, _PART)])


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Add one inclusive running sum per entry of ``sums``."""
    parts, cut = spread(df, keys, order)
    names = list(sums)
    rows = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({f"_l_{n}": F.sum(sums[n]).over(rows) for n in names})
    if not cut:
        return local.drop(_PART).withColumnsRenamed({f"_l_{n}": n for n in names})
    across = Window.partitionBy(*keys).orderBy(_PART)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = _carried(parts, keys, {f"_t_{n}": F.sum(sums[n]) for n in names})
    # Only keys with several parts have rows behind a border.
    offsets = totals.select(
        *keys, _PART, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in names],
        F.lag(F.lit(True)).over(across).alias("_spans"),
    ).where("_spans").drop("_spans")
    joined = _attach(local, offsets, keys)
    return joined.withColumns(
        {
            n: F.when(F.col(f"_o_{n}").isNull(), F.col(f"_l_{n}"))
            .when(F.col(f"_l_{n}").isNull(), F.col(f"_o_{n}"))
            .otherwise(F.col(f"_l_{n}") + F.col(f"_o_{n}"))
            for n in names
        }
    ).drop(_PART, *[f"_l_{n}" for n in names], *[f"_o_{n}" for n in names])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    *,
    following: bool = True,
) -> DataFrame:
    """Add the ``value`` of the next (or previous) row of the same key, null at the end."""
    parts, cut = spread(df, keys, order)
    wrapped = F.struct(F.col(value).alias("v"))
    step = F.lead if following else F.lag
    local = parts.withColumn(
        "_near", step(wrapped).over(Window.partitionBy(*keys, _PART).orderBy(*order))
    )
    if not cut:
        return local.withColumn(name, F.col("_near")["v"]).drop(_PART, "_near")
    rank = F.struct(*order)
    edge = F.min_by(wrapped, rank) if following else F.max_by(wrapped, rank)
    edges = _carried(parts, keys, {"_edge": edge})
    across = Window.partitionBy(*keys).orderBy(_PART)
    borders = edges.select(*keys, _PART, step("_edge").over(across).alias("_border")).where(
        F.col("_border").isNotNull()
    )
    joined = _attach(local, borders, keys)
    return joined.withColumn(name, F.coalesce("_near", "_border")["v"]).drop(
        _PART, "_near", "_border"
    )
