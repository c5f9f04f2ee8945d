"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source shares of the tokens are raised to an exponent in [0, 1] and normalised. The exponent is found by bisection: the
largest one whose weights reach the target entropy, raised as far as the repetition limit asks. A weight and the budget
give each source so many whole passes and a rest; the rest is a budgeted block permutation: documents fall into about
sqrt(n) blocks by hash, blocks are taken whole in the order of their own hash while the rest lasts, and the block in
which it ends is cut after the last document, in hash order, that still fits.

What each document needs to know is its source's row of a small plan: passes, number of blocks, last block key, last
document key. No document is ranked against others, so a source with a third of all rows costs nothing extra; the
largest windows hold the blocks of a source or the documents of one block, about sqrt(n) rows either.

Defined results: a null source is the source ''; a null text has no tokens; sources without tokens stay as they are
(one copy); a very long text only weighs more; a null doc_id is ordered as the id ''; rows of one doc_id are taken or left together; an empty table gives
an empty result; other columns are ignored by the plan and kept by `mix`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, discard, store, unboxed

#: The exponent is a multiple of 2 ** -STEPS, and a job tries LEVEL levels of the bisection at once.
STEPS, LEVEL = 20, 4


@dataclass(frozen=True)
class Target:
    """entropy: least entropy of the weights, as a share of its maximum. repetitions: most passes over a source.
    budget: tokens to realise, as a multiple of all tokens; None: the least budget that takes every source once."""

    entropy: float = 0.97
    repetitions: float = 4.0
    budget: float | None = 1.0
    seed: int = 7


def token_count(text: str = "text") -> Column:
    """Number of words: runs of anything but space and 0x09 to 0x0D."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _key(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def _block(blocks: Column) -> Column:
    return F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % blocks


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, n_tokens and the hash that orders the document."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count().alias("n_tokens"))
    return rows.withColumn("key", _key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _smallest(holds, n: int = 1 << STEPS) -> int:
    """The smallest k in 0..n for which it holds, n if for none below: bisection, several levels a job. holds: list of k to list of bool."""
    low, high = 0, n  # the answer is in low..high
    while low < high:
        tried = sorted({low + (high - low) * i // (1 << LEVEL) for i in range(1 << LEVEL)})
        answers = holds(tried)
        first = next((i for i, yes in enumerate(answers) if yes), None)
        if first is None:
            low = tried[-1] + 1
        else:
            high = tried[first]
            low = tried[first - 1] + 1 if first else low
    return low


def _exponent(shares: DataFrame, target: Target) -> float:
    """shares: source, p > 0. The sums that entropy and repetition need are aggregates over the sources."""
    n, least, most = shares.agg(F.count(F.lit(1)), F.min("p"), F.max("p")).first()
    if not n:
        return 1.0
    top = shares.select(F.log(F.lit(float(n)))).first()[0]

    def sums(ks: list[int]) -> list[tuple[float, float]]:
        points = [k / (1 << STEPS) for k in ks]
        row = shares.agg(*(x for a in points for x in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p"))))).first()
        return list(zip(row[0::2], row[1::2], strict=True))

    def too_even(ks: list[int]) -> list[bool]:  # entropy under the target, from some exponent on
        import math

        return [math.log(z) - k / (1 << STEPS) * s / z < target.entropy * top - 1e-9 for k, (z, s) in zip(ks, sums(ks), strict=True)]

    def few_passes(ks: list[int]) -> list[bool]:  # from some exponent on
        out = []
        for k, (z, _) in zip(ks, sums(ks), strict=True):
            a = k / (1 << STEPS)
            passes = target.budget * least ** (a - 1) / z if target.budget is not None else (least / most) ** (a - 1)
            out.append(passes <= target.repetitions + 1e-9)
        return out

    under = _smallest(too_even)
    natural = (1 << STEPS) if under == 1 << STEPS and not too_even([under])[0] else max(0, under - 1)
    return max(natural, _smallest(few_passes)) / (1 << STEPS)


def plan(documents: DataFrame, target: Target) -> DataFrame:
    """One row a source: weight, budget_tokens, passes, blocks, last_block and last_key. `documents`: a stored `sized`."""
    totals = documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    totals = store(totals, "source-totals")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(1, everything))))
    a = _exponent(shares, target)
    z, most = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.pow("p", F.lit(1 - a)))).first()
    budget = target.budget if target.budget is not None else (z or 0) * (most or 0)
    weight = F.pow("p", F.lit(a)) / F.lit(z)
    rows = shares.withColumn("weight", weight).withColumn("budget_tokens", F.floor(F.col("weight") * F.lit(float(everything) * budget) + F.lit(1e-6)))
    if target.budget is None:  # rounding must not cost the largest source a document
        rows = rows.withColumn("budget_tokens", F.greatest("budget_tokens", "tokens"))
    rows = rows.withColumn("passes", F.floor(F.col("budget_tokens") / F.col("tokens"))).withColumn("rest", F.col("budget_tokens") - F.col("passes") * F.col("tokens"))
    rows = rows.withColumn("blocks", F.ceil(F.sqrt("docs"))).select("source", "weight", "budget_tokens", "passes", "rest", "blocks")
    block = documents.join(rows.select("source", "blocks", "rest"), "source").withColumn("block", _block(F.col("blocks")))
    tokens = block.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("n"))
    tokens = tokens.withColumn("block_key", _key(target.seed, F.col("source"), F.col("block")))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("block_key", "block"))
    cut = tokens.withColumn("run", run).filter("run > rest")
    ends = cut.groupBy("source").agg(F.min_by(F.struct("block", "block_key", (F.col("run") - F.col("n")).alias("before"), "rest"), F.struct("block_key", "block")).alias("e"))
    ends = ends.select("source", "e.*")
    inside = block.join(ends.select("source", "block", "before"), ["source", "block"])
    inside = inside.withColumn("run", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key")) + F.col("before"))
    last = inside.filter("run <= rest").groupBy("source").agg(F.max("key").alias("last_key"))
    ends = ends.select("source", F.col("block_key").alias("last_block")).join(last, "source", "left")
    made = store(rows.join(ends, "source", "left").drop("rest"), "mixing-plan")
    discard(totals)
    return made


def _copies(key: Column, source: Column, seed: int) -> Column:
    """How often a document is taken, from its hash and its source's row of the plan."""
    block = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("blocks")
    block_key = _key(seed, source, block)
    inside = (block_key < F.col("last_block")) | ((block_key == F.col("last_block")) & (key <= F.col("last_key")))
    return F.when(F.col("passes").isNull(), F.lit(1)).otherwise(F.col("passes") + F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)).cast("int")


def mixed_counts(docs: DataFrame, target: Target) -> DataFrame:
    """doc_id, source, n_tokens, budget_tokens (of the source; null without tokens) and copies of every document."""
    documents = store(sized(docs, target.seed), "sized")
    rows = documents.join(plan(documents, target), "source", "left")
    return rows.select("doc_id", "source", "n_tokens", "budget_tokens", _copies(F.col("key"), F.col("source"), target.seed).alias("copies"))


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """The mixture itself: every document as often as its copies say; columns as they came."""
    marked = boxed(docs, source=F.coalesce(F.col("source").cast("string"), F.lit("")), key=_key(target.seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = marked.join(plan(store(sized(docs, target.seed), "sized"), target), "source", "left")
    return unboxed(rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), _copies(F.col("key"), F.col("source"), target.seed)))), docs)
