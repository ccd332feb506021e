"""Mixing sources to target weights by temperature (operator 5).

Source shares p (by tokens) are raised to an exponent and normalised to weights
w.  The exponent is the largest in [0, 1] whose entropy reaches the target
``entropy`` (in nats; by default ``LEVEL`` of the way from the entropy of the
shares to that of equal weights), but none that reads a source more than
``max_repeat`` times: then the smallest that keeps this limit.  It is found by repeated division
of the interval into 64 parts: one aggregate over the table of sources each, so
no list of sources reaches the driver.

A budget of B tokens gives each source a quota of w * B.  Documents sit in 65 536
blocks by a hash of their id; each pass over a source reads its blocks in a new
permutation (coarse blocks, then fine ones).  Full passes take every document;
the last pass takes whole blocks while they fit the quota's rest, and in the
block where it ends documents in hash order while they fit.  Block totals are
small partial aggregates; only documents of that one block are ranked, so a
source that holds a third of all rows is never one task.

Cases: a null source is a source of its own; documents without words have 0
tokens and come along with every full pass; repeated rows count each; without
tokens at all, nothing is read; other columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

COARSE = FINE = 256
MAX_REPEAT = 4.0
LEVEL = 0.5
PARTS = 64
ROUNDS = 6
#: Sources that one broadcast may hold; beyond, the plan joins by shuffle.
BROADCAST_SOURCES = 50_000


def token_table(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``(doc_id, source, n_tokens, coarse, fine)`` of every document, written once."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    place = F.xxhash64("doc_id", F.lit(seed))
    return written(docs.select("doc_id", "source", words.alias("n_tokens"), F.pmod(place, F.lit(COARSE)).cast("int").alias("coarse"),
                               F.pmod(F.shiftright(place, 16), F.lit(FINE)).cast("int").alias("fine")), "mix-tokens")


def solve_exponent(sources: DataFrame, total: int, budget: float, entropy: float, max_repeat: float | None) -> float:
    """The exponent for ``sources(tokens)``; see the module's text."""
    def divide(goal) -> float:
        """Largest exponent found with ``goal`` true, which holds below some point."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / PARTS for i in range(PARTS + 1)]
            p = F.col("tokens") / F.lit(float(total))
            rows = (sources.where("tokens > 0").select(p.alias("p"), F.explode(F.lit(grid)).alias("a"))
                    .groupBy("a").agg(F.sum(F.pow("p", F.col("a"))).alias("z"),
                                      F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("s"),
                                      F.max(F.pow("p", F.col("a") - 1)).alias("m")).collect())  # one row per grid point
            ok = [r["a"] for r in rows if goal(r["a"], r["z"], r["s"], r["m"])]
            lo = max(ok, default=lo)
            hi = min([r["a"] for r in rows if r["a"] > lo], default=lo)
            if hi <= lo:
                break
        return lo

    exponent = divide(lambda a, z, s, m: math.log(z) - a * s / z >= entropy)
    if max_repeat is not None:
        # the largest exponent that still breaks the limit; just above it the limit holds
        over = lambda a, z, s, m: budget / total * m / z > max_repeat * (1 + 1e-12)
        least = divide(over)
        if least > 0 or _breaks_at_zero(sources, total, budget, max_repeat):
            least = min(1.0, least + 2.0 / PARTS ** ROUNDS)
        exponent = max(exponent, least)
    return exponent


def target_entropy(sources: DataFrame, total: int, level: float = LEVEL) -> float:
    """``level`` of the way from the entropy of the sources' shares to the entropy of equal weights."""
    p = F.col("tokens") / F.lit(float(total))
    r = sources.where("tokens > 0").agg(F.sum(-p * F.log(p)).alias("h"), F.count("*").alias("n")).first()
    return r["h"] + level * (math.log(r["n"]) - r["h"])


def _breaks_at_zero(sources: DataFrame, total: int, budget: float, max_repeat: float) -> bool:
    r = sources.where("tokens > 0").agg(F.count("*").alias("n"), F.min("tokens").alias("low")).first()
    return bool(r["n"]) and budget / r["n"] / r["low"] > max_repeat


def mix(docs: DataFrame, budget: float | None = None, entropy: float | None = None, max_repeat: float | None = MAX_REPEAT,
        seed: int = 7) -> DataFrame:
    """One row per document and pass: ``doc_id, source, n_tokens, copy, block, position, weight, exponent``.

    Sorted by ``position`` within a pass the rows are the block permutation.
    The budget defaults to all tokens.
    """
    rows = token_table(docs, seed)
    sources = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    total, n_sources = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    budget = float(total if budget is None else budget)
    if total and entropy is None:
        entropy = target_entropy(sources, total)
    exponent = solve_exponent(sources, total, budget, entropy, max_repeat) if total else 1.0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(exponent))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(float(z))
    quota = weight * F.lit(budget)
    plan = sources.select("source", "tokens", weight.alias("weight"),
                          F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens") + 1e-12)).otherwise(0).cast("int").alias("passes"),
                          quota.alias("quota"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens"))).drop("quota", "tokens")
    plan = written(plan, "mix-plan")
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)

    def cut(blocks: DataFrame, left: DataFrame, column: str) -> DataFrame:
        """The block of each source where its last pass ends, and what is left there; ``before``: its place in the permutation."""
        turn = F.xxhash64(F.lit(seed), F.col("passes"), *([F.col("coarse")] if column == "fine" else []), F.col(column))
        left = left.withColumnRenamed("source", "s0").withColumnRenamed("coarse", "c0")
        on = F.col("source").eqNullSafe(F.col("s0"))
        j = blocks.join(small(left), on & (F.col("coarse") == F.col("c0")) if column == "fine" else on).drop("s0", "c0")
        j = j.withColumn("turn", turn)
        w = Window.partitionBy("source").orderBy("turn", column)
        j = j.withColumn("upto", F.sum("n_tokens").over(w))
        j = j.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n_tokens") <= F.col("rest")))
        first = F.row_number().over(Window.partitionBy("source").orderBy("upto", "turn"))
        j = j.withColumn("k", first).where("k = 1")
        return j.withColumn("rest", F.col("rest") - F.col("upto") + F.col("n_tokens"))

    by_coarse = rows.groupBy("source", "coarse").agg(F.sum("n_tokens").alias("n_tokens"))
    c = written(cut(by_coarse, plan.select("source", "passes", "rest"), "coarse")
                .select("source", "passes", "rest", "coarse", F.col("turn").alias("coarse_turn")), "mix-coarse")
    here = c.select(F.col("source").alias("s0"), F.col("coarse").alias("c0"))
    inside = rows.join(small(here), F.col("source").eqNullSafe(F.col("s0")) & (F.col("coarse") == F.col("c0")), "left_semi")
    by_fine = inside.groupBy("source", "coarse", "fine").agg(F.sum("n_tokens").alias("n_tokens"))
    f = written(cut(by_fine, c.select("source", "passes", "rest", "coarse"), "fine")
                .select("source", "coarse", "fine", "rest", F.col("turn").alias("fine_turn")), "mix-fine")
    ends = plan.join(small(c.select(F.col("source").alias("s1"), F.col("coarse").alias("end_coarse"), "coarse_turn")),
                     F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1")
    ends = ends.join(small(f.select(F.col("source").alias("s2"), F.col("fine").alias("end_fine"), "fine_turn", F.col("rest").alias("end_rest"))),
                     F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    ends = ends.withColumnRenamed("source", "s0")
    j = rows.join(small(ends), F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    turn = F.xxhash64(F.lit(seed), F.col("passes"), F.col("coarse"))
    fine = F.xxhash64(F.lit(seed), F.col("passes"), F.col("coarse"), F.col("fine"))
    # before the end block of the last pass, in it, or after it
    where = (F.when(F.col("rest") <= 0, "after").when(F.col("coarse_turn").isNull(), "before")
             .when(turn != F.col("coarse_turn"), F.when(turn < F.col("coarse_turn"), "before").otherwise("after"))
             .when(F.col("fine_turn").isNull(), "before")
             .when(fine != F.col("fine_turn"), F.when(fine < F.col("fine_turn"), "before").otherwise("after")).otherwise("in"))
    j = j.withColumn("where", where)
    edge = j.where("where = 'in'")
    w = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("n_tokens").over(w)).withColumn("last", F.col("upto") <= F.col("end_rest")).drop("upto")
    j = j.where("where <> 'in'").withColumn("last", F.col("where") == "before").unionByName(edge)
    copies = F.when(F.col("last"), F.col("passes") + 1).otherwise(F.col("passes"))
    out = j.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.select("doc_id", "source", "n_tokens", "copy", (F.col("coarse") * FINE + F.col("fine")).alias("block"),
                      F.struct(F.xxhash64(F.lit(seed), "copy", "coarse").alias("coarse_turn"),
                               F.xxhash64(F.lit(seed), "copy", "coarse", "fine").alias("fine_turn")).alias("position"),
                      "weight", F.lit(exponent).alias("exponent"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_mixing``: all documents mixed to a budget of all tokens, half-way to equal weights, no source read more than ``MAX_REPEAT`` times."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_tokens", "copy", "block", F.col("position.coarse_turn").alias("turn"),
                      F.col("position.fine_turn").alias("fine_turn"), "weight", "exponent")
