"""Mixing sources by temperature, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import WORD
from hostlens.session import cut

SECTIONS = 32  # one pass over the sources takes five bisection steps at once
PASSES = 8
GRID = 1_000_000  # the exponent is rounded to six decimals, to the safe side


def token_count(text: Column) -> Column:
    """Words plus one for the end of the document, so that no document is free."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint") + 1


def _bisect(shares: DataFrame, holds) -> tuple[float, float]:
    """The bracket around the last exponent in [0, 1] for which `holds(exponent, row)` is true.

    `holds` must turn from true to false once, or be true throughout. Its sums over the
    sources are taken in Spark; the driver sees one row per pass.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        width = (high - low) / SECTIONS
        points = [low + width * k for k in range(1, SECTIONS + 1)]
        row = shares.agg(F.count(F.lit(1)).alias("n"), *[
            column for k, t in enumerate(points) for column in (
                F.sum(F.pow("share", F.lit(t))).alias(f"z{k}"),
                F.sum(F.pow("share", F.lit(t)) * F.ln("share")).alias(f"l{k}"))
        ]).first()
        good = 0
        while good < SECTIONS and holds(points[good], row, good):
            good += 1
        if good == SECTIONS:
            return points[-1], points[-1]
        low, high = low + width * good, points[good]
    return low, high


def plan_weights(
    sizes: DataFrame, budget: int | None, target_entropy: float | None,
    repetition_limit: float | None,
) -> DataFrame:
    """(source, rows, tokens, exponent, budget_tokens, epochs, blocks) from (source, rows, tokens).

    Weights are token shares to the power of an exponent in [0, 1], normalised. The
    exponent is the largest with an entropy of at least `target_entropy` times the
    logarithm of the number of sources; 1 if the shares are that even already. Where
    a source would then repeat more than `repetition_limit` times as often as the least
    repeated one (with a budget: more than that many passes), it is the smallest exponent
    within the limit. Without a budget, the budget is the smallest with which every
    source gets at least one whole pass, so no document is lost.
    """
    bounds = sizes.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    whole, least, most = bounds if bounds[0] else (1, 1, 1)
    shares = sizes.withColumn("share", F.col("tokens") / F.lit(float(whole)))
    exponent = 1.0
    if target_entropy is not None:
        def even(t, row, k):
            entropy = math.log(row[f"z{k}"]) - t * row[f"l{k}"] / row[f"z{k}"]
            return entropy >= target_entropy * math.log(row["n"])

        low, high = _bisect(shares, even) if bounds[0] else (1.0, 1.0)
        exponent = 1.0 if low == high else int(low * GRID) / GRID
    if repetition_limit is not None and bounds[0]:
        def too_often(t, row, k):
            if budget is None:
                times = (most / least) ** (1 - t)
            else:
                times = budget * (least / whole) ** t / row[f"z{k}"] / least
            return times > repetition_limit

        if target_entropy is None:
            exponent = 0.0
        _, high = _bisect(shares, too_often)
        exponent = max(exponent, min(1.0, -int(-high * GRID) / GRID))
    power = F.pow(F.col("tokens") / F.lit(float(whole)), F.lit(exponent))
    if budget is None:
        tokens = F.greatest(F.col("tokens"), F.round(
            F.col("tokens") * F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - exponent)))
            .cast("bigint"))
    else:
        z = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
        tokens = F.round(F.lit(float(budget)) * power / F.lit(z)).cast("bigint")
    return sizes.select(
        "source", "rows", "tokens", F.lit(exponent).alias("exponent"),
        tokens.alias("budget_tokens"),
        F.ceil(tokens / F.col("tokens")).cast("int").alias("epochs"),
        F.ceil(F.sqrt("rows")).alias("blocks"),
    )


def _text_key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(
        (p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("null")) for p in parts]))


def _digest(text: Column) -> Column:
    """Tells rows of one id, or of none, apart."""
    return F.md5(F.coalesce(text, F.lit("")))


def _slots(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Each row once for every epoch its source reaches, with its place in the permutation."""
    joined = rows.join(plan, rows["_source"].eqNullSafe(plan["source"])).drop(plan["source"])
    block = F.pmod(
        F.conv(F.substring(_text_key(seed, "block", F.col("_id"), F.col("_text")), 1, 8), 16, 10).cast("bigint"),
        F.col("blocks"))
    last = F.greatest(F.col("epochs"), F.lit(1)) - 1
    return (
        joined.withColumn("_block", block)
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("_block_key", _text_key(seed, F.col("_epoch"), F.col("_source"),
                                            F.col("_block")))
        .withColumn("_row_key", _text_key(
            seed, F.col("_epoch"), F.col("_id"), F.col("_text")))
    )


def mix_plan(
    docs: DataFrame, budget: int | None = None, target_entropy: float | None = None,
    repetition_limit: float | None = None, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(plan, placements): the weights, and one row for each time a document is used.

    A source is permuted in every epoch: its blocks (about the square root of its rows,
    dealt by a hash of id and text) come in a new random order, and so do the rows of each
    block. `token_offset` counts the tokens of the source placed before; rows are placed
    while it is below the budget. No window holds more than about the square root of
    the rows of a source.

    A null source is a source of its own. Rows without an id, and rows of equal id, are
    dealt by their texts; rows equal in both share a place in the order and stay together. Null and empty texts count one token. An empty table
    gives empty results.
    """
    rows = cut(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        _digest(F.col(text_col)).alias("_text"), token_count(F.col(text_col)).alias("_tokens")), "mix-sizes")
    sizes = cut(rows.groupBy(F.col("_source").alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_tokens").alias("tokens")), "mix-sources")
    plan = cut(plan_weights(sizes, budget, target_entropy, repetition_limit), "mix-plan")
    slots = _slots(rows, plan, seed)
    blocks = slots.groupBy("_source", "_epoch", "_block", "_block_key").agg(
        F.sum("_tokens").alias("_sum"))
    in_epoch = Window.partitionBy("_source", "_epoch").orderBy("_block_key", "_block")
    before = in_epoch.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_source").alias("b_source"), F.col("_epoch").alias("b_epoch"),
        F.col("_block").alias("b_block"), F.row_number().over(in_epoch).alias("block_rank"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    in_block = (
        Window.partitionBy("_source", "_epoch", "_block").orderBy("_row_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        slots.withColumn("_inside", F.coalesce(F.sum("_tokens").over(in_block), F.lit(0)))
        .join(blocks, F.col("_source").eqNullSafe(F.col("b_source"))
              & (F.col("_epoch") == F.col("b_epoch")) & (F.col("_block") == F.col("b_block")))
        .withColumn("token_offset",
                    F.col("_epoch") * F.col("tokens") + F.col("_start") + F.col("_inside"))
        .filter(F.col("token_offset") < F.col("budget_tokens"))
        .select(
            F.col("_id").alias("doc_id"), F.col("_source").alias("source"),
            F.col("_epoch").alias("epoch"), "block_rank", "token_offset",
            F.col("_tokens").alias("n_tokens"), "exponent", "budget_tokens",
            "_block", "_block_key", "_row_key")
    )
    return plan, placed


def mix_documents(docs: DataFrame, seed: int = 0, id_col: str = "doc_id",
                  source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents of a mix: each row as often as it is placed, with its own columns.

    Texts are not shuffled: the last place that the budget reaches in each source and
    epoch is worked out on ids, and each row then tells from its own place whether it
    is before that.
    """
    plan, placed = mix_plan(docs, seed=seed, id_col=id_col, source_col=source_col,
                            text_col=text_col, **options)
    last = placed.groupBy("source", "epoch").agg(
        F.max(F.struct("_block_key", "_block", "_row_key")).alias("cut"))
    # of each source its epochs, at most ceil(budget / tokens)
    cuts = cut(last.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("epoch", "cut"))).alias("_cuts")), "mix-cuts")
    plan = plan.join(cuts, plan["source"].eqNullSafe(cuts["source"])).drop(cuts["source"])
    names = docs.columns
    rows = docs.select(
        F.struct(*[docs[name] for name in names]).alias("_doc"),
        docs[id_col].alias("_id"), docs[source_col].alias("_source"),
        _digest(docs[text_col]).alias("_text"))
    slots = _slots(rows, plan, seed)
    here = F.struct("_block_key", "_block", "_row_key")
    return slots.filter(here <= F.col("_cuts")[F.col("_epoch")]).select(
        *[F.col("_doc")[name].alias(name) for name in names])
