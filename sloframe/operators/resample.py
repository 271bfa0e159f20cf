"""Ranks and bootstrap intervals at row grain, for groups of any size.

Nothing here numbers or sorts a whole group in one task: values are counted first, cut into
bins by a sketch of the group, and running counts are carried from bin to bin. The exception
are resamples of groups that a task can hold (``WHOLE``), which ``draws`` counts as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from sloframe.functions.stats import hash32, pearson, spearman_p
from sloframe.operators import draws
from sloframe.operators.ordered import CHUNK, add_positions, attach, running_totals
from sloframe.operators.ranking import POISSON_CUTS, _rank_sums

BINS = 128
SIDE = 8  # resamples that one row counts side by side
WHOLE = 1 << 22  # rows of a group that one task draws from; larger groups are drawn from by shuffles
SLICES, DRAWS = 48, 2_000_000_000  # least number of tasks for the resamples of some groups, and draws of a task beyond it
_NO_VALUE = 1 << 30  # bin of a missing value: ranked last


def _bins(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``cells`` with ``__bin``, a number that never falls along the value."""
    cuts = cells.groupBy(*by).agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 10_000).alias("__cuts"))
    below = F.size(F.filter("__cuts", lambda c: c <= F.col(value)))
    return attach(cells, cuts, by).withColumn("__bin", F.when(F.col(value).isNull(), F.lit(_NO_VALUE)).otherwise(below)).drop("__cuts")


def _tied_ranks(counts: DataFrame, by: Sequence[str], value: str, ranks: dict[str, str], descending: bool, binned_by: Sequence[str]) -> DataFrame:
    """Average rank of each value of a group, from how often it occurs there: ``ranks`` names a
    rank and the column that counts the value for it. ``counts`` has one row per group and
    value; ``binned_by`` are the keys of a group's value bins."""
    binned = _bins(counts, binned_by, value)
    known = F.col("__bin") < _NO_VALUE
    block = F.when(known, -F.col("__bin")).otherwise(F.lit(_NO_VALUE)) if descending else F.col("__bin")
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    run = running_totals(binned, by, [block], [order], {f"__upto_{name}": F.col(count) for name, count in ranks.items()})
    return run.select(*by, value, *[(F.col(f"__upto_{name}") - (F.col(count) - 1) / 2.0).alias(name) for name, count in ranks.items()])


def add_average_ranks(df: DataFrame, by: Sequence[str], ranks: dict[str, str], descending: bool = True) -> DataFrame:
    """Average-tie rank (1 = largest, or smallest) of the column ``ranks[name]`` as column
    ``name``, per group. Missing values share the last places. Ranks come from one row per
    distinct value; each row then gets its value's rank."""
    by = list(by)
    for name, column in ranks.items():
        value = F.col(column).cast("double")
        counts = df.groupBy(*by, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        ranked = _tied_ranks(counts, by, "__v", {name: "__n"}, descending, by)
        df = attach(df.withColumn("__v", value), ranked, [*by, "__v"]).drop("__v")
    return df


def spearman_rows(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation with p-value over the rows of each group that have both values."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    s = _rank_sums(by, add_average_ranks(both, by, {"__ra": a, "__rb": b}))
    return _correlated(s, by)


def _correlated(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n").cast("double")
    rho = pearson(n, F.col("sa"), F.col("sb"), F.col("saa"), F.col("sbb"), F.col("sab"))
    return sums.select(*by, "n", rho.alias("rho")).withColumn("p_value", spearman_p(F.col("rho"), F.col("n")))


def bootstrap_spearman_rows(
    df: DataFrame, by: Sequence[str], key: str, a: str, b: str, resamples: int = 100, seed: int = 42, blocks: Sequence[Column] | None = None, whole: int = WHOLE
) -> DataFrame:
    """Percentile interval of the rank correlation over resamples with replacement, drawn as
    ``ranking.bootstrap_spearman`` draws them: draw j of resample r takes the row whose place
    by ``key`` is md5(seed|r|j) mod n.

    Places are dealt out block by block (``blocks``: coarse keys that never decrease along the
    key; by default ``CHUNK`` keys of an integer each). Groups of up to ``whole`` rows are drawn
    from in tasks that hold all values of some groups and take a share of the resamples;
    larger ones, of any size, by shuffles of their draws.
    """
    by = list(by)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, key, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    if blocks is None:
        blocks = [F.floor(F.col(key) / CHUNK)]
    placed = add_positions(rows, by, blocks, [F.col(key)], "__j")
    placed = attach(placed, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
    total = rows.agg(F.count(F.lit(1)).alias("__n")).scalar()
    per = _drawn_in_tasks(placed.where(F.col("__n") <= whole), by, total, resamples, seed, whole).unionByName(
        _drawn_by_shuffles(placed.where(F.col("__n") > whole), by, resamples, seed)
    )
    rhos = _correlated(per, [*by, "__r"]).groupBy(*by).agg(F.array_sort(F.collect_list("rho")).alias("__s"))  # one value per resample
    lo, hi = int(0.025 * resamples), min(int(0.975 * resamples), resamples - 1)
    ci = rhos.select(*by, F.col("__s")[lo].alias("ci_lower"), F.col("__s")[hi].alias("ci_upper"))
    return attach(spearman_rows(df, by, a, b), ci, by).select(*by, "n", "rho", "ci_lower", "ci_upper", "p_value")


def _drawn_in_tasks(placed: DataFrame, by: list[str], total: Column, resamples: int, seed: int, whole: int) -> DataFrame:
    """Sums of the ranks of each resample of groups that fit in a task. Rows are packed by
    place; bundles of groups go to one task per slice of the resamples."""
    block = F.floor(F.col("__j") / CHUNK).alias("__block")
    packed = placed.groupBy(*by, block).agg(F.sort_array(F.collect_list(F.struct("__j", "__a", "__b"))).alias("__rows"))  # at most CHUNK rows
    bundles = F.ceil(total / F.lit(whole))
    slices = F.ceil(F.least(total, F.lit(whole)) * F.lit(resamples / DRAWS))
    slices = F.least(F.greatest(slices, F.lit(SLICES)), F.lit(resamples)).cast("int")
    dealt = packed.select(
        *by, "__block", F.col("__rows.__a").alias("__a"), F.col("__rows.__b").alias("__b"),
        (F.pmod(F.hash(*by), bundles) if by else F.lit(0)).cast("int").alias("__bundle"), slices.alias("__slices"),
    )
    dealt = dealt.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)))
    kinds = StructType(placed.select(*by).schema.fields).add("__r", LongType())
    for name in draws.SUMS:
        kinds = kinds.add(name, LongType() if name == "n" else DoubleType())
    # Few bytes and much work: a number of partitions that stays as it is.
    spread = dealt.repartition(4 * SLICES, "__bundle", "__slice")
    return spread.groupBy("__bundle", "__slice").applyInArrow(lambda table: draws.resample_table(table, by, seed, resamples), kinds)


def _drawn_by_shuffles(placed: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """The same sums for groups of any size. Draws are counted per row, ``SIDE`` resamples side
    by side, before they meet the values, counts per value give the tied ranks, and ranks are
    carried over the group's value bins."""
    # One row per place and SIDE resamples, whose draws it counts side by side.
    side = range(min(SIDE, resamples))
    counted = (
        placed.select(*by, "__j", "__n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("__r"))
        .withColumn("__pick", F.pmod(hash32(F.concat_ws("|", F.lit(seed), F.col("__r"), F.col("__j"))), F.col("__n")))
        .select(F.struct(*by, F.col("__pick").alias("__j")).alias("__key"), "__r")
        .repartition("__key")  # a place is hardly drawn twice in a task: nothing to add up before
        .groupBy("__key", F.floor(F.col("__r") / SIDE).alias("__s"))
        .agg(*[F.count_if(F.col("__r") % SIDE == i).alias(f"__c{i}") for i in side])
    )
    drawn = counted.join(placed.select(F.struct(*by, "__j").alias("__key"), *by, "__a", "__b"), "__key")
    group = [*by, "__s"]
    # Equal pairs of values are one cell.
    drawn = drawn.groupBy(*group, "__a", "__b").agg(*[F.sum(f"__c{i}").alias(f"__c{i}") for i in side])
    for value, rank in (("__a", "__ra"), ("__b", "__rb")):
        counts = drawn.groupBy(*group, value).agg(*[F.sum(f"__c{i}").alias(f"__n{i}") for i in side])
        drawn = attach(drawn, _tied_ranks(counts, group, value, {f"{rank}{i}": f"__n{i}" for i in side}, True, by), [*group, value])
    sums = []
    for i in side:
        c, ra, rb = F.col(f"__c{i}"), F.col(f"__ra{i}"), F.col(f"__rb{i}")
        parts = {"n": c, "sa": c * ra, "sb": c * rb, "saa": c * ra * ra, "sbb": c * rb * rb, "sab": c * ra * rb}
        sums.append({name: F.sum(x).alias(f"__{name}{i}") for name, x in parts.items()})
    summed = drawn.groupBy(*group).agg(*[x for each in sums for x in each.values()])
    each = F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"__{name}{i}").alias(name) for name in sums[i]]) for i in side])
    per = summed.select(*group, F.explode(each).alias("__x")).select(*by, (F.col("__s") * SIDE + F.col("__x.i")).alias("__r"), "__x.*")
    return per.where(F.col("__r") < resamples).select(*by, "__r", *draws.SUMS)


def _poisson(digest: Column, i: int) -> Column:
    """Poisson(1) weight from 16 bits of a digest."""
    bits = F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("int")
    return sum((bits >= cut).cast("int") for cut in POISSON_CUTS)


def bootstrap_quantiles(
    df: DataFrame, by: Sequence[str], key: Column, value: Column, quantiles: dict[str, float], resamples: int = 200, alpha: float = 0.05,
    seed: int = 17, margin: float = 0.002, grid: int = 512, accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles with percentile intervals over Poisson resamples, for groups of any size.

    Every row has a Poisson(1) weight per resample (md5 of seed, key and block of eight). A
    resample's quantile is the least value whose running weight reaches ceil(p W), W being
    all of its weight. A sketch gives each quantile a bracket: the ranks that resamples reach
    are within some sqrt(p (1 - p) n) of the rank itself, so the bracket narrows as a group
    grows. In one pass weights are summed, for all resamples at once, per value inside a
    bracket and in one sum each below and above it; running sums then go bin by bin. A
    resample that left its bracket (six deviations and more) would fail the query.
    """
    by, groups = list(by), (resamples + 7) // 8
    base = df.select(*by, key.cast("string").alias("__k"), value.cast("double").alias("__v")).where("__v is not null")
    sketch = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", [i / grid for i in range(1, grid)], accuracy).alias("__g"),
    )
    edges = sketch.select(*by, "__n", F.concat(F.array("__min"), "__g", F.array("__max")).alias("__e"))

    def bracket(i: int, p: float) -> Column:
        slack = F.lit(margin) + F.lit(20.0) / F.col("__n") + F.lit(8 * math.sqrt(p * (1 - p))) / F.sqrt("__n")
        low = F.greatest(F.floor((F.lit(p) - slack) * grid), F.lit(0)).cast("int")
        high = F.least(F.ceil((F.lit(p) + slack) * grid), F.lit(grid)).cast("int")
        return F.struct(F.lit(i).alias("i"), F.slice("__e", low + 1, high - low + 1).alias("cuts"))

    brackets = edges.select(*by, "__n", F.array(*[bracket(i, p) for i, p in enumerate(quantiles.values())]).alias("__br"))
    places = F.expr(
        "transform(__br, b -> named_struct('i', b.i, 'bin', case when __v < b.cuts[0] then -1 when __v > element_at(b.cuts, -1) then 1 << 30"
        " else size(filter(b.cuts, c -> c <= __v)) end, 'v', if(__v between b.cuts[0] and element_at(b.cuts, -1), __v, cast(null as double))))"
    )
    digests = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.md5(F.concat_ws("|", F.lit(seed), F.col("__k"), g.cast("string"))))
    rows = attach(base, brackets, by).select(*by, "__n", "__k", places.alias("__p"), F.posexplode(digests).alias("__b", "__h"))
    weights = [_poisson(F.col("__h"), i).alias(f"__w{i}") for i in range(8)]
    rows = rows.select(*by, "__n", "__p", "__b", *weights).select(*by, "__n", "__b", F.explode("__p").alias("__p"), *[f"__w{i}" for i in range(8)])
    cell = [*by, F.col("__p.i").alias("__i"), "__b"]
    cells = rows.groupBy(*cell, "__n", F.col("__p.bin").alias("__bin"), F.col("__p.v").alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"), *[F.sum(f"__w{i}").alias(f"__w{i}") for i in range(8)]
    )
    group = [*by, "__i", "__b"]
    totals = cells.groupBy(*group).agg(*[F.sum(f"__w{i}").alias(f"__t{i}") for i in range(8)])
    run = running_totals(cells, group, [F.col("__bin")], [F.col("__v")], {"__cc": F.col("__c"), **{f"__s{i}": F.col(f"__w{i}") for i in range(8)}})
    run = attach(run, totals, group)
    p = F.element_at(F.array(*[F.lit(float(q)) for q in quantiles.values()]), F.col("__i") + 1)

    def reached(upto: str, here: str, all_: Column) -> Column:
        need = F.ceil(p * all_)
        need = F.greatest(need, F.lit(1))
        hit = (F.col(upto) - F.col(here) < need) & (need <= F.col(upto))
        return F.max(F.when(hit & F.col("__v").isNotNull(), F.col("__v")))

    found = run.groupBy(*group).agg(
        F.max("__n").alias("__n"), reached("__cc", "__c", F.col("__n")).alias("__q"),
        *[reached(f"__s{i}", f"__w{i}", F.col(f"__t{i}")).alias(f"__q{i}") for i in range(8)], *[F.max(f"__t{i}").alias(f"__t{i}") for i in range(8)],
    )
    lost = F.raise_error(F.lit("a resample's quantile fell outside its bracket")).cast("double")
    each = F.array(*[F.when(F.col(f"__t{i}") > 0, F.coalesce(F.col(f"__q{i}"), lost)) for i in range(8)])
    per = found.select(*by, "__i", "__b", "__n", F.coalesce("__q", lost).alias("__q"), F.posexplode(each).alias("__j", "__x"))
    per = per.where((F.col("__b") * 8 + F.col("__j") < resamples) & F.col("__x").isNotNull())
    out = per.groupBy(*by, "__i").agg(F.max("__n").alias("n"), F.max("__q").alias("value"), F.array_sort(F.collect_list("__x")).alias("__s"))  # one value per resample
    at = lambda q: F.element_at("__s", (F.floor(F.lit(q) * (F.size("__s") - 1)) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(q) for q in quantiles]), F.col("__i") + 1)
    return out.select(*by, name.alias("quantile"), "n", "value", at(alpha / 2).alias("ci_lower"), at(1 - alpha / 2).alias("ci_upper"))
