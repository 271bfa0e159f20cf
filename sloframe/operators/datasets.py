"""Task sets: sampling, balancing, variants, splits, checks, conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.functions.jsonops import field, parse_strict, text_of
from sloframe.functions.stats import hash32, hash60
from sloframe.operators.ordered import add_positions, attach, first_rows, spread_counts


def draw_key(seed: int, key: Column) -> Column:
    """Text whose order is a repeatable shuffle."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows of the shuffle, overall or per group.

    Overall, rows are first counted by the first digits of their hash (65,536 counts), which
    says up to where the n-th row lies; only rows up to there are ordered, block by block, so
    ``n`` may be any share of a table of any size.
    """
    order = [draw_key(seed, F.col(key)), F.col(key)]
    if by:
        return first_rows(df, by, order, n).drop("__rn")
    tagged = df.withColumn("__h", order[0])
    counts = tagged.groupBy(F.substring("__h", 1, 4).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("").alias("p"))
    reach = lambda acc, x: F.when(acc["n"] >= n, acc).otherwise(F.struct((acc["n"] + x["c"]).alias("n"), x["p"].alias("p")))
    cut = counts.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("p", "c"))), start, reach)["p"].alias("p"))
    near = tagged.where(F.substring("__h", 1, 4) <= cut.scalar())
    return _placed(near, [], key, "__pos").where(F.col("__pos") < n).select(*df.columns)


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """A repeatable shuffle of the whole table: every row's 0-based place. Write the rows by
    ranges of the place to have files in shuffled order."""
    placed = _placed(df.withColumn("__h", draw_key(seed, F.col(key))), [], key, name)
    return placed.select(*df.columns, name)


def _placed(tagged: DataFrame, by: Sequence[str], key: str, name: str) -> DataFrame:
    """Places by ``__h``. The first hash digits cut every group into even blocks, so a hot
    group, or a whole table, is ordered by many tasks."""
    return add_positions(tagged, by, [F.substring("__h", 1, 4)], [F.col("__h"), F.col(key)], name)


def first_n_per_file(df: DataFrame, file: str, line: str, n: int) -> DataFrame:
    return first_rows(df, [file], [F.col(line)], n).drop("__rn")


def _shuffled(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Position of each row in its group's shuffle."""
    return _placed(df.withColumn("__h", draw_key(seed, F.col(key))), [group], key, "__pos")


def largest_group(df: DataFrame, group: str) -> int:
    """Rows of the largest group: the target that leaves no group out of an oversampled mix."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def balanced_mix(df: DataFrame, group: str, key: str, target: int, strategy: str, seed: int) -> DataFrame:
    """Every group at ``target`` rows (``oversample``), at most ``target``
    (``undersample``), or unchanged (``natural``).

    Oversampling keeps all originals and draws the rest with replacement; a drawn
    row's id gets ``_dup{n}`` with n counting on from the group size.
    """
    ids = F.col(key).cast("string")
    if strategy == "natural":
        return df.withColumn(key, ids)
    placed = _shuffled(df, group, key, seed)
    kept = placed.where(F.col("__pos") < target).select(*[c for c in df.columns if c != key], ids.alias(key))
    if strategy == "undersample":
        return kept.select(*df.columns)
    if strategy != "oversample":
        raise ValueError(f"unknown strategy {strategy!r}")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    draws = spread_counts(sizes, F.lit(target) - F.col("__n"), "__j")
    pick = F.pmod(hash60(F.concat_ws("|", F.lit(seed), F.col(group), F.col("__j"))), F.col("__n"))
    picks = draws.select(group, pick.alias("__pos"), (F.col("__n") + F.col("__j")).alias("__at"))
    extra = picks.join(placed, [group, "__pos"]).select(
        *[F.col(c) for c in df.columns if c != key], F.concat(ids, F.lit("_dup"), F.col("__at")).alias(key)
    )
    return kept.select(*df.columns).unionByName(extra.select(*df.columns))


def mix_statistics(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    a = before.groupBy(group).agg(F.count(F.lit(1)).alias("original"))
    b = after.groupBy(group).agg(F.count(F.lit(1)).alias("balanced"))
    return a.join(b, group, "left").na.fill(0, ["balanced"])


def expand_variants(df: DataFrame, key: str, prompt: str, templates: Sequence[str], marker: str = "Context:") -> DataFrame:
    """One row per template; the prompt keeps its tail from the marker on. Rows
    without the marker are an error."""
    at = F.instr(prompt, marker)
    tail = F.when(at > 0, F.substring(F.col(prompt), at, F.length(prompt))).otherwise(
        F.raise_error(F.lit(f"prompt without {marker} marker")).cast("string")
    )
    made = df.withColumn("__tail", tail).select("*", F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("__i", "__t"))
    return made.select(
        *[c for c in df.columns if c not in (key, prompt)],
        F.concat(F.col(key).cast("string"), F.lit("_v"), "__i").alias(key),
        F.concat("__t", F.lit("\n\n"), "__tail").alias(prompt),
    ).select(*df.columns)


def cyclic_fill(df: DataFrame, key: str, blocks: Sequence[Column], order: Sequence[Column], target: int) -> DataFrame:
    """Exactly ``target`` rows: the first rows in order, repeated from the start
    while too few; a repeat's id gets ``_x{place}``."""
    placed = add_positions(df, [], blocks, order, "__p")
    sized = attach(placed, df.agg(F.count(F.lit(1)).alias("__n")), [])
    copies = F.ceil((F.lit(target) - F.col("__p")) / F.col("__n"))
    spread = spread_counts(sized, F.greatest(copies, F.lit(0)), "__k")
    place = F.col("__p") + F.col("__k") * F.col("__n")
    ids = F.col(key).cast("string")
    named = F.when(F.col("__k") == 0, ids).otherwise(F.concat(ids, F.lit("_x"), place))
    return spread.select(*[named.alias(c) if c == key else F.col(c) for c in df.columns])


def hash_split(df: DataFrame, key: str, valid_share: float, seed: int) -> DataFrame:
    """``split`` column from the id alone, so repeats of an id stay together."""
    limit = int(valid_share * 2**32)
    draw = hash32(F.concat_ws("|", F.lit(seed), F.col(key)))
    return df.withColumn("split", F.when(draw < limit, "valid").otherwise("train"))


def quality_report(lines: DataFrame, text: str, line_no: str, schema_path: str) -> DataFrame:
    """One row per problem of a task file: line number and message."""
    rec = lines.where(F.trim(text) != "").select(line_no, text).withColumn("__v", parse_strict(F.col(text)))
    ok = F.col("__v").isNotNull()
    wrong = ok & ~text_of(field(F.col("__v"), "schema_path")).eqNullSafe(F.lit(schema_path))
    problems = F.array_compact(
        F.array(
            F.when(~ok, F.lit("invalid JSON")),
            F.when(wrong, F.lit("wrong schema_path")),
            F.when(ok & field(F.col("__v"), "gold").isNull(), F.lit("missing gold")),
            F.when(ok & field(F.col("__v"), "prompt").isNull(), F.lit("missing prompt")),
        )
    )
    return rec.select(line_no, F.explode(problems).alias("problem"))


def backfill(df: DataFrame, task_type: str, schema_path: str, question: str) -> DataFrame:
    """Fill missing task type and schema path, rebuild a missing prompt."""
    return df.withColumns(
        {
            "task_type": F.coalesce("task_type", F.lit(task_type)),
            "schema_path": F.coalesce("schema_path", F.lit(schema_path)),
            "prompt": F.coalesce("prompt", F.concat(F.lit("Request: "), F.col(question))),
        }
    )


def task_record(df: DataFrame, key: Column, task_type: str, prompt: Column, schema_path: str, gold: Column) -> DataFrame:
    """The common task record; ``gold`` is a struct and becomes JSON."""
    return df.select(
        key.cast("string").alias("id"), F.lit(task_type).alias("task_type"), prompt.alias("prompt"), F.lit(schema_path).alias("schema_path"), F.to_json(gold).alias("gold")
    )


def patch_prompt(problem: Column, hints: Column, tests_json: Column, shown: int = 5) -> Column:
    """Prompt with the problem, hints if any, and the first listed tests; NULL
    without a problem."""
    tests = F.from_json(tests_json, "array<string>")
    listed = F.array_join(F.transform(F.slice(tests, 1, shown), lambda t: F.concat(F.lit("- "), t)), "\n")
    has_hints = F.coalesce(F.trim(hints) != "", F.lit(False))
    return F.when(
        F.coalesce(F.trim(problem) != "", F.lit(False)),
        F.concat(
            F.lit("## Problem\n\n"), problem,
            F.when(has_hints, F.concat(F.lit("\n\n## Hints\n\n"), hints)).otherwise(F.lit("")),
            F.when(F.size(tests) > 0, F.concat(F.lit("\n\n## Target Tests\n\n"), listed)).otherwise(F.lit("")),
        ),
    )
