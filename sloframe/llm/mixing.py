"""Mixing sources to target weights by iterative proportional fitting (raking).

A stated share of all tokens is the budget. Token weights of the cells source x language x
topic are scaled to one margin after the other until all three margins have their target
shares of it, no cell giving more than it has; documents are then drawn with the
probabilities that the scaled cells call for.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.llm.store import stored

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
_words = regex.compile(rb"[^\x20\x09-\x0D]+").findall


def topic_of(words: list[bytes]) -> int:
    """Topic of a text: of its most frequent word of five characters or more (lower case;
    the least in byte order if tied), the first hex digit of the MD5, modulo 8. A text
    without such a word has topic 0."""
    counts = Counter(w for w in words if len(w) >= 5)
    best, most = None, 0
    for word, n in counts.items():
        if (n > most or n == most and word < best) and len(word.decode()) >= 5:
            best, most = word, n
    return int(hashlib.md5(best, usedforsecurity=False).hexdigest()[0], 16) % TOPICS if best is not None else 0


def described(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Per row: id, source, lang, topic (``t0`` to ``t7``) and tokens (words). A null
    source or language is the empty string."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), name(source).alias("source"), name(lang).alias("lang"), name(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, tokens = [], []
            for t in batch.column(3).cast(pa.binary()).to_pylist():
                words = _words(t.lower())
                topics.append(f"t{topic_of(words)}")
                tokens.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(topics, pa.string()), pa.array(tokens, pa.int64())], ["id", "source", "lang", "topic", "tokens"])

    return rows.mapInArrow(describe, f"id {rows.schema['id'].dataType.simpleString()}, source string, lang string, topic string, tokens long")


def cells_of(rows: DataFrame) -> DataFrame:
    """Tokens per source, language and topic; cells without tokens are left out."""
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Targets ``value``, ``target``: each value's share of tokens to a power, made to sum
    to 1. An exponent of 1 leaves the corpus as it is, 0 makes all values equal."""
    margin = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("target"))
    total = margin.agg(F.sum("target").alias("t")).first()["t"] or 1.0
    return margin.withColumn("target", F.col("target") / F.lit(total))


def goals(cells: DataFrame, dimension: str, target: DataFrame, budget: float, rounds: int = 6) -> DataFrame:
    """``value`` and ``goal``, the tokens that each value is to give to the budget.

    That is its target times one scale, but never more than it has: values that run out give
    all they have, and the scale grows for the others, ``rounds`` times at most. A value
    without target gives nothing. The driver sees two sums a round.
    """
    margin = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    margin = stored(margin.join(target.select("value", "target"), "value"), "margin")
    total = margin.agg(F.sum("target").alias("t")).first()["t"]
    scale = budget / total if total else 0.0
    for _ in range(rounds):
        short = F.col("tokens") <= F.col("target") * F.lit(scale)
        sums = margin.agg(F.sum(F.when(short, F.col("tokens"))).alias("given"), F.sum(F.when(~short, F.col("target"))).alias("left")).first()
        if not sums["left"]:
            break
        scale = (budget - (sums["given"] or 0.0)) / sums["left"]
    return margin.select("value", F.least("tokens", F.col("target") * F.lit(scale)).alias("goal"))


def rake(cells: DataFrame, wanted: dict[str, DataFrame], budget: float, cycles: int = 8) -> DataFrame:
    """``cells`` with their ``weight`` after ``cycles`` rounds: the tokens that each is to give.

    All weights start as the same share of the cells' tokens. A step scales the weights of each
    value of one dimension to its goal and cuts them at the cell's tokens, so a cell of which
    more is wanted than there is is taken whole, and the next steps raise the others. Each
    step is written to the shared folder, so plans stay small.
    """
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    rows = cells.withColumn("weight", F.col("tokens") * F.lit(budget / total))
    for _ in range(cycles):
        for d in DIMENSIONS:
            margin = rows.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("margin"))
            step = wanted[d].join(margin, "value").select(F.col("value").alias(d), F.when(F.col("margin") > 0, F.col("goal") / F.col("margin")).otherwise(0.0).alias("factor"))
            scaled = F.least(F.col("tokens").cast("double"), F.col("weight") * F.coalesce("factor", F.lit(0.0)))
            rows = stored(rows.join(step, d, "left").select(*DIMENSIONS, "tokens", scaled.alias("weight")), "raked")
    return rows


def draw(id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the id; a null id draws
    as an empty one."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrated(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, exponent: float = 0.7, keep: float = 0.9, cycles: int = 8, seed: str = "mix",
    id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
) -> DataFrame:
    """Per row: id, source, lang, topic, tokens, ``probability`` and ``kept``.

    The budget is the share ``keep`` of all tokens. It is raked over the cells source x
    language x topic so that the margins meet their targets as far as the corpus has the
    tokens; a cell is taken whole before any document would be taken twice, and what it lacks
    the others give, see ``goals`` and ``rake``. The probability of a document is its cell's
    weight over the cell's tokens, so the expected tokens are the budget, or less where cells
    that are taken whole leave no others to raise. A rare cell changes its own probability
    only. A row is kept if the draw of its id is below its probability; rows that repeat an id
    are kept or left together. Rows without tokens, or in cells without target, have
    probability 0. Targets default to the corpus' own shares to the power ``exponent``. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = stored(described(docs, id, text, source, lang), "described")
    cells = stored(cells_of(rows), "cells")
    if targets is None:
        targets = {d: stored(tempered(cells, d, exponent), "targets") for d in DIMENSIONS}
    budget = keep * float(cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0)
    raked = rake(cells, {d: stored(goals(cells, d, targets[d], budget), "goals") for d in DIMENSIONS}, budget, cycles)
    ratios = raked.select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("ratio"))
    out = rows.join(ratios, list(DIMENSIONS), "left")
    probability = F.when(F.col("tokens") > 0, F.coalesce("ratio", F.lit(0.0))).otherwise(0.0)
    out = out.select("id", *DIMENSIONS, "tokens", probability.alias("probability"))
    return out.withColumn("kept", draw(F.col("id"), seed) < F.col("probability")).withColumnRenamed("id", id)


def keep_mixed(docs: DataFrame, id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that ``calibrated`` keeps, with all their columns."""
    kept = calibrated(docs, id=id, **settings).filter("kept").select(F.col(id).alias("_kept_id")).distinct()
    return docs.join(kept, docs[f"`{id}`"].eqNullSafe(kept["_kept_id"]), "left_semi")
