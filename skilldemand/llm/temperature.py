"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets the weight p ** a / sum(p ** a). The exponent a is the
smallest step of 1/4096 from 0 to 1 at which the weights' entropy is at most a target and
no source repeats more often than a limit; both fall as a grows, so it is found by sections.
The target lies between the entropy of the natural shares (a is 1) and that of even ones (a
is 0), by default in the middle, so sources that differ are always evened out: rows of large
sources are left out and those of small ones repeat. A target can also be a share of
the even entropy; sources that are more even than that keep their natural shares.

A source's budget is its weight times the budget of all. It is spent on whole passes over
the source and then on the beginning of one more pass. A pass visits the source's blocks
of rows in a seeded order, and in a block its rows in a seeded order. Where the last pass
ends is found from running sums over blocks, then over the rows of a block.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilldemand.llm.common import stage
from skilldemand.llm.ranking import digest_fraction, group_name, range_count, seeded_digest

STEPS = 4096  # steps of the exponent from 0 to 1
SECTIONS = 32
PER_BLOCK = 2_000  # rows of all sources that fall into one range of digests, a source's block
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def smallest_exponent(
    sources: DataFrame, total: int, budget: int, target: float | None, max_repeats: float | None
) -> float:
    """The smallest exponent from 0 to 1 that keeps both limits, or 1 if none does.

    ``sources`` has one row per source with its ``tokens`` (more than 0). Tempering only
    evens out, so at 1 the natural shares stay as they are, however even. There every
    source repeats ``budget / total`` times; a limit below that can't be kept by any
    mixture of the budget, and a warning says so.
    """
    if max_repeats is not None and budget / total > max_repeats + 1e-9:
        warnings.warn(
            f"{budget} of {total} words repeat every source {budget / total:.6g} times at the least, "
            f"over the limit of {max_repeats}: natural shares are taken",
            stacklevel=2,
        )
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    low, high = 0, STEPS  # the answer is in (low - 1, high]
    while low < high:
        width = max(1, -(-(high - low) // SECTIONS))
        tried = list(range(low, high, width))
        tries = F.explode(F.array(*[F.lit(t) for t in tried])).alias("t")
        powers = sources.select(tries, share.alias("p"))
        powers = powers.withColumn("w", F.pow("p", F.col("t") / F.lit(float(STEPS))))
        facts = powers.groupBy("t").agg(
            F.sum("w").alias("z"),
            F.sum(F.col("w") * F.log("w")).alias("wlogw"),
            F.max(F.col("w") / F.col("p")).alias("ratio"),
        )
        good = F.lit(True)
        if target is not None:
            entropy = F.log("z") - F.col("wlogw") / F.col("z")
            good &= entropy <= F.lit(target + 1e-12)
        if max_repeats is not None:
            repeats = F.col("ratio") / F.col("z") * F.lit(budget / total)
            good &= repeats <= F.lit(max_repeats + 1e-9)
        met = {r.t for r in facts.where(good).select("t").collect()}
        first = next((t for t in tried if t in met), None)
        if first is None:
            low = tried[-1] + 1
        else:
            low, high = max(low, first - width + 1), first
    return high / STEPS


def target_entropy(sources: DataFrame, total: int, evenness: float | None, entropy_ratio: float | None) -> float | None:
    """The entropy to meet: a share of the even one, or a step from the natural one towards it."""
    share = F.col("tokens") / F.lit(float(total))
    facts = sources.agg(F.sum(-share * F.log(share)).alias("natural"), F.log(F.count("*")).alias("even")).first()
    if entropy_ratio is not None:
        return entropy_ratio * facts.even
    return None if evenness is None else facts.natural + evenness * max(facts.even - facts.natural, 0.0)


def temperature_mixture(
    df: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    budget: int | None = None,
    evenness: float | None = 0.5,
    entropy_ratio: float | None = None,
    max_repeats: float | None = 4.0,
    seed: int = 0,
    per_block: int = PER_BLOCK,
) -> DataFrame:
    """Rows of ``df`` as often as the mixture takes them, with ``n_tokens``, ``epoch``, ``block``.

    ``budget`` is the number of words in all, by default that of ``df``. ``epoch`` counts a
    source's passes from 0; a pass's order is by ``visit`` of its blocks (see
    ``block_visit``). The row on which the last pass reaches its budget is its last.
    ``evenness``, from 0 to 1, is how far the target lies from the entropy of the natural
    shares to that of even ones; ``entropy_ratio``, if given, is the target as a share of the
    latter. Where the target is above the natural entropy, the sources with the largest
    shares lose rows and others repeat. ``max_repeats`` goes before the target. A budget that
    breaks it at every exponent is spent by natural shares, with a warning. Null sources are a
    source of their own; a source without words has no weight and is left out; rows without
    words cost nothing and go with their block. Rows equal in key, source
    and text may change places. Columns named like the added ones are refused. An empty
    table, or one without words, gives no rows.
    """
    added = ["n_tokens", "epoch", "block", "_group", "_digest", "_spent", "_before", "_full", "_rest", "_copies"]
    clash = {c.lower() for c in df.columns} & set(added)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    digest = seeded_digest(seed, F.col(key), F.crc32(F.col(text).cast("binary")))
    rows = df.withColumns({"n_tokens": word_count(F.col(text)), "_group": group_name(F.col(source)), "_digest": digest})
    counts = df.select(F.count("*").alias("n")).first().n
    blocks = range_count(counts, per_block)
    rows = rows.withColumn("block", F.floor(digest_fraction(F.col("_digest")) * blocks))

    sums = stage(rows.groupBy("_group", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    sources = sums.groupBy("_group").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if total == 0:
        budget, exponent = 0, 1.0
    else:
        budget = total if budget is None else budget
        target = target_entropy(sources, total, evenness, entropy_ratio)
        exponent = smallest_exponent(sources, total, budget, target, max_repeats)
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent))
    scale = sources.agg(F.sum(power)).first()[0] or 1.0
    due = F.round(power / F.lit(scale) * F.lit(float(budget))).cast("long")
    plan = sources.withColumn("_due", due).select(
        "_group",
        F.expr("_due div tokens").alias("_full"),
        (F.col("_due") % F.col("tokens")).alias("_rest"),
    )

    # the last pass: blocks in its order, and what was spent before each
    blocks_ = sums.join(plan, "_group")
    in_order = Window.partitionBy("_group").orderBy(
        block_visit(seed, F.col("_group"), F.col("_full"), F.col("block")), "block"
    )
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    blocks_ = blocks_.select(
        "_group", "block", "_full", "_rest", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_group", "block").orderBy("_digest", F.col(key).asc_nulls_first())
    spent = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_spent", spent).join(blocks_, ["_group", "block"])
    more = F.when(F.col("_before") + F.col("_spent") < F.col("_rest"), 1).otherwise(0)
    rows = rows.withColumn("_copies", (F.col("_full") + more).cast("int")).where("_copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], "n_tokens", "epoch", "block")


def block_visit(seed: int, group: Column, epoch: Column, block: Column) -> Column:
    """Sort key of a source's blocks in a pass."""
    return seeded_digest(seed, group, epoch, block)
