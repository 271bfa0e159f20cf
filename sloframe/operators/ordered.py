"""Order-dependent work on groups that may be far larger than one task.

A plain ``Window.partitionBy(group).orderBy(...)`` sorts a whole group in one
task, which breaks when one group holds a large share of all rows. Everything
here splits a group into *blocks* that follow the order, works inside blocks,
and carries small per-block summaries across block borders.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def attach(df: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add one row of group facts to every row of ``df``.

    ``facts`` has one row per group. Without keys it is a single row and is read
    as a scalar subquery, so no join on a constant key can pile rows up.
    """
    new = [c for c in facts.columns if c not in by]
    if not by:
        one = facts.select(F.struct(*new).alias("__one")).scalar()
        out = df.withColumn("__one", one)
        return out.select(*df.columns, *[F.col("__one")[c].alias(c) for c in new])
    # NULL keys are equal inside a struct, so such groups find their facts as well.
    right = facts.select(F.struct(*by).alias("__key"), *new)
    return df.withColumn("__key", F.struct(*by)).join(right, "__key", "left").drop("__key")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums per group in ``order``.

    ``blocks`` are coarse keys, widest first, that never decrease along
    ``order``. Rows are sorted only inside one (group, block...) cell; earlier
    cells enter as sums, added level by level, so each level's window sees only
    the cells of one parent.
    """
    by = list(by)
    names = [f"__b{i}" for i in range(len(blocks))]
    keyed = df
    for name, block in zip(names, blocks):
        keyed = keyed.withColumn(name, block)
    cells = keyed.groupBy(*by, *names).agg(*[F.sum(c).alias(f"__s_{t}") for t, c in totals.items()])
    carried, parts = cells, {t: [] for t in totals}
    for depth in range(len(names)):
        parent, level = [*by, *names[:depth]], names[depth]
        w = Window.partitionBy(*parent).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        offsets = [F.coalesce(F.sum(f"__s_{t}").over(w), F.lit(0)).alias(f"__o{depth}_{t}") for t in totals]
        for t in totals:
            parts[t].append(F.col(f"__o{depth}_{t}"))
        if depth == len(names) - 1:
            carried = carried.select("*", *offsets)
        else:
            wider = cells.groupBy(*parent, level).agg(*[F.sum(f"__s_{t}").alias(f"__s_{t}") for t in totals])
            carried = attach(carried, wider.select(*parent, level, *offsets), [*parent, level])
    summed = carried.select(*by, *names, *[sum(parts[t], F.lit(0)).alias(f"__off_{t}") for t in totals])
    # One struct key serves the join and the window: the rows are shuffled once.
    offsets_by_cell = summed.select(F.struct(*by, *names).alias("__cell"), *[f"__off_{t}" for t in totals])
    inside = keyed.withColumn("__cell", F.struct(*by, *names)).join(offsets_by_cell, "__cell", "left")
    local = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return inside.select(
        *df.columns,
        *[(F.sum(c).over(local) + F.col(f"__off_{t}")).alias(t) for t, c in totals.items()],
    )


def add_positions(
    df: DataFrame,
    by: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[Column],
    name: str = "pos",
) -> DataFrame:
    """0-based position of each row in its group."""
    out = running_totals(df, by, blocks, order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group. Spark limits each map task to ``n`` rows per
    group before the shuffle, so a hot group moves at most n rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)


def rolling_mean(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    value: Column,
    width: int,
    name: str = "rolling",
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean of the last ``width`` rows (fewer at the start) along dense positions.

    Each chunk of positions also receives the ``width - 1`` rows before it, so
    chunks of one group run in different tasks and the result is exact.
    """
    if width > chunk:
        chunk = width
    home = F.floor(F.col(pos) / chunk)
    spill = F.col(pos) % chunk >= chunk - (width - 1)
    spread = df.withColumn(
        "__cell",
        F.explode(
            F.when(spill, F.array(F.struct(home.alias("c"), F.lit(True).alias("own")),
                                  F.struct((home + 1).alias("c"), F.lit(False).alias("own"))))
            .otherwise(F.array(F.struct(home.alias("c"), F.lit(True).alias("own"))))
        ),
    ).select("*", F.col("__cell.c").alias("__c"), F.col("__cell.own").alias("__own"))
    w = Window.partitionBy(*by, "__c").orderBy(pos).rowsBetween(-(width - 1), 0)
    return spread.withColumn(name, F.avg(value).over(w)).where("__own").select(*df.columns, name)


def decayed_baseline(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    value: Column,
    keep: float,
    name: str = "baseline",
) -> DataFrame:
    """Value of b <- keep*b + (1-keep)*x from 0, as it stood *before* each row; ``keep``
    is between 0 and 1.

    Inside a chunk the recurrence is a weighted running sum. The chunk is as long
    as the weights stay inside double range (keep**chunk ~ 1e-40). Of earlier chunks,
    all enter whose weight is not zero as a double.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    chunk = max(1, math.floor(92.0 / -math.log(keep)))
    cell = F.floor(F.col(pos) / chunk)
    local = F.col(pos) % chunk
    # One struct key serves the window and the join: the rows are shuffled once.
    base = df.withColumn("__c", cell).withColumn("__i", local).withColumn("__cell", F.struct(*by, "__c"))
    gain = F.lit(1.0 - keep)
    w = Window.partitionBy("__cell").orderBy(pos)
    before = F.sum(value * F.pow(F.lit(1.0 / keep), F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inner = base.withColumn("__in", F.coalesce(gain * before * F.pow(F.lit(keep), F.col("__i") - 1), F.lit(0.0)))
    ends = base.groupBy(*by, "__c").agg(
        F.sum(value * F.pow(F.lit(1.0 / keep), F.col("__i"))).alias("__w"),
        F.max("__i").alias("__last"),
    )
    end = gain * F.col("__w") * F.pow(F.lit(keep), F.col("__last"))
    chunks = Window.partitionBy(*by).orderBy("__c")
    weights = [keep ** (chunk * i) for i in range(64)]
    carried = sum((F.coalesce(F.lag(end, i).over(chunks), F.lit(0.0)) * w for i, w in enumerate(weights) if w > 0 and i), end)
    ends = ends.select(F.struct(*by, (F.col("__c") + 1).alias("__c")).alias("__cell"), carried.alias("__end"))
    joined = inner.join(ends, "__cell", "left")
    carried = F.coalesce(F.col("__end"), F.lit(0.0)) * F.pow(F.lit(keep), F.col("__i"))
    return joined.withColumn(name, F.col("__in") + carried).select(*df.columns, name)


# Index rules for percentiles; each gives the 0-based rank(s) to read.
RULES = ("linear", "index_n", "index_n_minus_1", "index_n_or_max_below_20", "index_n_clamped", "discrete")


def _ranks(rule: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """(low rank, high rank, weight of the high rank), ranks 0-based."""
    prob = F.lit(float(p))
    zero = F.lit(0.0)
    if rule == "linear":
        h = prob * (n - 1)
        return F.floor(h), F.ceil(h), h - F.floor(h)
    if rule == "index_n":
        r = F.floor(prob * n)
    elif rule == "index_n_minus_1":
        r = F.floor(prob * (n - 1))
    elif rule == "index_n_or_max_below_20":
        r = F.when(n >= 20, F.floor(prob * n)).otherwise(n - 1)
    elif rule == "index_n_clamped":
        r = F.least(F.floor(prob * n), n - 1)
    elif rule == "discrete":
        r = F.greatest(F.ceil(prob * n) - 1, F.lit(0))
    else:
        raise ValueError(f"unknown percentile rule {rule!r}")
    return r, r, zero


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column,
    quantiles: dict[str, float],
    rule: str = "linear",
    margin: float = 0.002,
    grid: int = 512,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact order statistics per group, the same way for groups of any size.

    1. One mergeable sketch per group gives its size and ``grid + 1`` edges at about
       even ranks, the outer ones being the minimum and the maximum.
    2. A quantile's bracket runs between the edges around its rank, widened by ``margin``
       of the group and 20 rows, which is more than the sketch's error and what the
       index rules differ by. One pass counts rows under each bracket and keeps rows
       inside it, merged by value before the shuffle.
    3. The bracket is cut at its own edges; running counts per bin find the wanted ranks,
       so no task sorts more than one bin, whatever the outliers.

    The sketch's error is at most 1 / ``accuracy`` of a group, so a rank cannot leave its
    bracket; if it ever did, the query would fail rather than give a wrong value.
    """
    by = list(by)
    base = df.select(*by, value.cast("double").alias("__v")).where("__v is not null")
    probs = list(quantiles.values())
    sketch = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", [i / grid for i in range(1, grid)], accuracy).alias("__g"),
    )
    edges = sketch.select(*by, "__n", F.concat(F.array("__min"), "__g", F.array("__max")).alias("__e"))

    def bracket(i: int, p: float) -> Column:
        """Quantile number and the sketch's edges from below to above its rank."""
        slack = F.lit(margin) + F.try_divide(F.lit(20.0), F.col("__n"))
        low = F.greatest(F.floor((F.lit(p) - slack) * grid), F.lit(0)).cast("int")
        high = F.least(F.ceil((F.lit(p) + slack) * grid), F.lit(grid)).cast("int")
        return F.struct(F.lit(i).alias("i"), F.slice("__e", low + 1, high - low + 1).alias("cuts"))

    brackets = edges.select(*by, "__n", F.array(*[bracket(i, p) for i, p in enumerate(probs)]).alias("__br"))
    # Rows under the bracket form bin -1, so they enter the running count first.
    wanted = F.explode(
        F.expr(
            "transform(filter(__br, b -> __v <= element_at(b.cuts, -1)), b -> named_struct('i', b.i,"
            " 'bin', if(__v < b.cuts[0], -1, size(filter(b.cuts, c -> c <= __v))), 'v', if(__v < b.cuts[0], cast(null as double), __v)))"
        )
    )
    cells = (
        attach(base, brackets, by)
        .select(*by, "__n", wanted.alias("__w"))
        .select(*by, "__n", F.col("__w.i").alias("__i"), F.col("__w.bin").alias("__bin"), F.col("__w.v").alias("__v"))
        .groupBy(*by, "__n", "__i", "__bin", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    located = running_totals(cells, [*by, "__i"], [F.col("__bin")], [F.col("__v")], {"__cum": F.col("__c")})
    aggs, outs = [], []
    for i, (name, p) in enumerate(quantiles.items()):
        lo, hi, frac = _ranks(rule, p, F.col("__n"))

        def pick(rank: Column, i: int = i) -> Column:
            here = (F.col("__i") == i) & (F.col("__cum") - F.col("__c") <= rank) & (rank < F.col("__cum"))
            return F.max(F.when(here & F.col("__v").isNotNull(), F.col("__v")))

        aggs += [pick(lo).alias(f"__l{i}"), pick(hi).alias(f"__h{i}"), F.max(frac).alias(f"__f{i}")]
        value_at = F.when(
            F.col(f"__l{i}").isNull() | F.col(f"__h{i}").isNull(),
            F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double"),
        ).when(
            F.col(f"__l{i}") == F.col(f"__h{i}"), F.col(f"__l{i}")  # also if both are infinite
        ).otherwise(F.col(f"__l{i}") + F.col(f"__f{i}") * (F.col(f"__h{i}") - F.col(f"__l{i}")))
        outs.append(value_at.alias(name))
    if by:
        return located.groupBy(*by).agg(*aggs).select(*by, *outs)
    # No rows at all gives one NULL row, as a global aggregate does.
    guarded = located.agg(F.count(F.lit(1)).alias("__any"), *aggs)
    return guarded.select(*[F.when(F.col("__any") > 0, o).alias(n) for n, o in zip(quantiles, outs)])


def spread_counts(df: DataFrame, count: Column, name: str = "draw", block: int = CHUNK) -> DataFrame:
    """One row per number 0..count-1 for each input row, made in two steps so that
    no row builds an array longer than ``count / block`` or ``block``."""
    blocks = df.withColumn("__count", count.cast("bigint")).where("__count > 0").withColumn(
        "__block", F.explode(F.expr(f"sequence(0L, (__count - 1) div {block})"))
    )
    shared = blocks.repartition(*[F.col(c) for c in df.columns], F.col("__block"))
    stop = F.least(F.col("__count"), (F.col("__block") + 1) * block) - 1
    return shared.withColumn(name, F.explode(F.sequence(F.col("__block") * block, stop))).drop("__count", "__block")
