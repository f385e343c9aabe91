"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import split_join, table

#: Exponents are multiples of 1 / GRID ** ROUNDS, found in ROUNDS jobs that try GRID at a time.
GRID, ROUNDS = 32, 4
#: Leading hex digits of a block's place in the permutation, by which its prefix sum is worked out in two steps.
DIGITS = 3


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null or blank. Each word becomes one character, so no list of words is held."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \\t\\n\\x0B\\f\\r]+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("long")


def _hash(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def exponent(totals: DataFrame, target_entropy: float | None, max_repeat: float | None, cover: bool) -> float:
    """Bisect the temperature exponent in [0, 1] over the table of source totals.

    With ``target_entropy`` (a fraction of the logarithm of the number of sources) it is the
    largest exponent whose weights reach that entropy; with ``max_repeat`` the smallest at which
    no source is repeated more often. Both tests are monotone in the exponent, so each round
    tries GRID points inside the bracket in one aggregation; GRID rows come back to the driver.
    """
    steps = GRID**ROUNDS
    lo, hi = (0, steps) if target_entropy is not None else (-1, steps)
    logs = totals.select(F.log(F.col("share")).alias("l"))
    while hi - lo > 1:
        step = max(1, (hi - lo) // GRID)
        tries = [k for k in range(lo + step, hi, step)]
        grid = F.explode(F.array(*[F.lit(k) for k in tries]))
        a = F.col("k") / F.lit(float(steps))
        got = (
            logs.select("l", grid.alias("k"))
            .groupBy("k")
            .agg(F.sum(F.exp(a * F.col("l"))).alias("s"), F.sum(F.exp(a * F.col("l")) * F.col("l")).alias("t"), F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("l").alias("n"))
            .collect()
        )
        for r in sorted(got, key=lambda r: r["k"]):
            at = r["k"] / steps
            if target_entropy is not None:
                holds = math.log(r["s"]) - at * r["t"] / r["s"] >= target_entropy * math.log(r["n"]) - 1e-12
                lo, hi = (max(lo, r["k"]), hi) if holds else (lo, min(hi, r["k"]))
            else:
                top = (at - 1) * (r["lo"] - r["hi"]) if cover else (at - 1) * r["lo"] - math.log(r["s"])
                holds = top <= math.log(max_repeat) + 1e-12
                lo, hi = (lo, min(hi, r["k"])) if holds else (max(lo, r["k"]), hi)
    return (lo if target_entropy is not None else hi) / steps


def mix_sources(
    docs: DataFrame,
    tokens: Column | None = None,
    source: str = "source",
    key: str = "doc_id",
    target_entropy: float | None = None,
    max_repeat: float | None = None,
    cover: bool = False,
    budget: int | None = None,
    block_tokens: int = 1 << 18,
    block_rows: int = 1 << 16,
    seed: int = 7,
    prefix: str = "mix",
) -> DataFrame:
    """Draw documents so that the sources' token shares become their tempered weights.

    Shares are raised to an exponent (see :func:`exponent`) and normalised. A source's quota is
    its weight times the budget: the given one, or the corpus total, or with ``cover`` as much
    as makes the least repeated source go in exactly once, so that no document is lost. A quota
    is filled epoch by epoch; in each epoch the source's blocks, to which documents belong by
    hash, come in a permuted order of that epoch, the last one only as far as the quota reaches.
    A block holds about ``block_tokens`` tokens and ``block_rows`` documents; if rows that share
    a key make one twice as large, its rows are dealt to as many parts of it as it takes.

    Returns the columns of ``docs`` and ``mix_tokens``, ``mix_weight``, ``mix_epoch`` (int, from
    0), ``mix_at`` (double in [0, 1): place in the mixed stream; sorting by it interleaves the
    sources evenly); ``prefix`` stands for ``mix``, and columns of ``docs`` of these names give
    way. A null source is a source of its own. A document without tokens takes part
    with its source's first epoch (without ``cover`` only if it comes before the quota's end) or,
    if the source has none at all, is drawn once with weight 0. Null and empty texts have no
    tokens, very long ones count whole.
    Rows repeated in ``docs`` are drawn as rows of their own. An empty table gives an empty one.
    """
    if (target_entropy is None) == (max_repeat is None):
        raise ValueError("give either target_entropy or max_repeat")
    if max_repeat is not None and max_repeat < 1:
        raise ValueError("max_repeat is at least 1")
    made = [f"{prefix}_{x}" for x in ("tokens", "weight", "epoch", "at")]
    own = [c for c in docs.columns if c not in made]
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    count = F.greatest(F.coalesce(word_count(F.col("text")) if tokens is None else tokens, F.lit(0)), F.lit(0)).cast("long")
    # the documents' own columns are one struct, so no name of theirs meets one of these
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"),
        F.coalesce(F.concat(F.lit("s:"), F.col(source)), F.lit("n")).alias("src"),
        count.alias("tokens"),
        F.conv(F.substring(_hash(seed, name), 1, 8), 16, 10).cast("long").alias("pick"),
        _hash(seed, "d", name).alias("turn"),
        F.col(key).alias("key"),
    )
    totals = table(sized.groupBy("src").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("rows")), "totals")
    some = totals.filter("total > 0")
    n, corpus, top, low = some.agg(F.count(F.lit(1)), F.sum("total"), F.max("total"), F.min("total")).first()
    share = F.col("total") / F.lit(corpus or 1)
    alpha = exponent(some.select(share.alias("share")), target_entropy, max_repeat, cover) if n > 1 else 1.0
    power = F.pow(share, F.lit(alpha))
    norm = some.agg(F.sum(power)).first()[0] or 1.0
    if cover:
        budget = math.ceil(corpus * (top / corpus) / ((top / corpus) ** alpha / norm)) if n else 0
    elif budget is None:
        budget = corpus or 0
    quota = F.round(power / F.lit(norm) * F.lit(float(budget))).cast("long")
    if cover:
        quota = F.greatest(quota, F.col("total"))
    has = F.col("total") > 0
    sources = totals.select(
        "src",
        "total",
        F.when(has, quota).otherwise(0).alias("quota"),
        F.when(has, power / F.lit(norm)).otherwise(0.0).alias("weight"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens), F.ceil(F.col("rows") / block_rows)).alias("blocks"),
    )
    sources = table(sources, "sources")
    dealt = split_join(sized, sources.select("src", "blocks"), ["src"]).withColumn("block", F.col("pick") % F.col("blocks")).drop("blocks", "pick")
    loads = table(dealt.groupBy("src", "block").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("rows")), "loads")
    dealt, loads = _parted(dealt, loads, block_rows)

    epochs = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest(F.col("total"), F.lit(1)))).cast("int")
    plan = split_join(loads, sources.drop("blocks"), ["src"]).withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    plan = plan.withColumn("turn", _hash(seed, F.col("epoch"), F.col("src"), F.col("block"))).withColumn("lead", F.substring("turn", 1, DIGITS))
    plan = table(plan, "turns")
    # blocks of a source that begin alike are summed first, so that no window holds all of them
    leads = plan.groupBy("src", "epoch", "lead").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("src", "epoch").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    leads = leads.select("src", "epoch", "lead", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("led"))
    inside = Window.partitionBy("src", "epoch", "lead").orderBy("turn", "block", "part").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    plan = split_join(plan, leads, ["src", "epoch", "lead"]).withColumn("start", F.col("led") + F.col("ahead") + F.col("epoch") * F.col("total"))
    whole = F.col("total") == 0
    if cover:  # the first epoch is within the quota, and what has no tokens may lie right at its end
        whole = whole | (F.col("epoch") == 0)
    plan = plan.filter((F.col("start") < F.col("quota")) | whole)
    plan = table(plan.select("src", "block", "part", "epoch", "weight", "start", "quota", "total"), "plan")

    inner = Window.partitionBy("src", "block", "part").orderBy("turn", "key").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    drawn = split_join(dealt, plan, ["src", "block", "part"]).withColumn("at", F.col("start") + F.col("before"))
    place = F.try_divide(F.least(F.col("at"), F.col("quota") - 1) + 0.5, F.col("quota"))
    return drawn.filter((F.col("at") < F.col("quota")) | whole).select(
        "doc.*", F.col("tokens").alias(made[0]), F.col("weight").alias(made[1]), F.col("epoch").alias(made[2]), F.coalesce(place, F.lit(0.0)).alias(made[3])
    )


def _parted(dealt: DataFrame, loads: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: 0, but in blocks of more than twice ``block_rows``, whose rows share keys.

    Such rows are told apart by where they lie, so they are written down first.
    """
    over = loads.filter(F.col("rows") > 2 * block_rows).select("src", "block", F.ceil(F.col("rows") / block_rows).alias("parts"))
    none = F.lit(0).cast("long")
    if over.isEmpty():
        return dealt.withColumn("part", none), loads.select("src", "block", none.alias("part"), "size")
    numbered = split_join(dealt.withColumn("n", F.monotonically_increasing_id()), over, ["src", "block"], "left")
    numbered = table(numbered.withColumn("part", F.coalesce(F.pmod(F.xxhash64("n"), F.col("parts")), none)).drop("n", "parts"), "parted")
    return numbered, numbered.groupBy("src", "block", "part").agg(F.sum("tokens").alias("size"))
