"""Mix sources to target weights by entropy balancing.

Each source has a target number of words.  Among all document rates that meet it, the one
closest to "every document once" in relative entropy, with no rate above the cap, is
``min(cap, exp(lambda * size))`` with one multiplier per source.  Newton steps on the
convex dual find the multipliers: every step is one aggregation over the counts of
(source, size), each source moves by itself, and a bracket catches steps that overshoot.

Rates are then rounded into copies.  A document gets the whole part of its rate, and the
documents whose hash is smallest against the rest get one more, up to a cut that makes the
source's words meet the target.  The cut is found digit by digit from histograms; the
few documents that fit best close the last gap.  No step sorts or gathers a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabmend.llm.common import Workspace, named, ordered, words

SHARE = 1.5
WEIGHTS = (5, 2, 1)
CAP = 2
STEPS = 80
DIGIT, DIGITS = 16, 3  # bits of a digit, digits of the rounding order
#: Rounds that close the last gap, documents tried in each, and hash buckets that propose one each.
CLOSERS, POOL, DEALT = 3, 8, 256


def targets(sizes: DataFrame, share: float, weights: tuple, cap: int) -> DataFrame:
    """Target words of each source, from (source, source_size): one row per source.

    Weights repeat over the sources in code point order, null last.  A source's target
    stops at ``cap`` times its size; what it can't take is shared out again by weight."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(place) - 1) % len(weights) + 1
    )
    df = sizes.withColumn("w", w).withColumn("most", cap * F.col("source_size").cast("double"))
    df = df.withColumns({"all_": share * F.sum("source_size").over(every), "w_": F.sum("w").over(every)})
    before = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    df = df.withColumns({
        "left": F.col("all_") - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "shares": F.col("w_") - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    df = df.withColumn("full", F.col("most") * F.col("shares") <= F.col("left") * F.col("w"))
    rest = F.col("all_") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.try_divide(rest * F.col("w"), open_))
    return df.select("source", "source_size", target.alias("target"), "full")


def _rate(cap: int) -> Column:
    x = F.col("lam") * F.col("size") / F.col("top")
    return F.when(F.col("full") | (x >= math.log(cap)), F.lit(float(cap))).otherwise(F.exp(x))


def solve(hist: DataFrame, goals: DataFrame, cap: int, space: Workspace, steps: int = STEPS) -> DataFrame:
    """The goals with the multiplier ``lam`` of each source; sizes are measured by ``top``.

    Sums are decimals, so that they don't depend on the order of addition."""
    some = hist.filter("size > 0").groupBy(F.col("source").alias("s_")).agg(
        F.max("size").cast("double").alias("top"),
        F.min("size").cast("double").alias("least"),
        (F.sum(F.col("n") * F.col("size") * F.col("size")).cast("double")).alias("square"),
    )
    state = goals.join(some, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    reach = F.log(F.try_divide("target", "source_size"))
    ends = F.when(reach < 0, reach).otherwise(F.lit(math.log(cap))) * F.try_divide("top", "least")
    state = state.withColumns({
        "lo": F.when(reach < 0, ends).otherwise(F.lit(0.0)),
        "hi": F.when(reach < 0, F.lit(0.0)).otherwise(ends),
        "lam": F.try_divide(reach * F.col("source_size") * F.col("top"), F.col("square")),
        "off": F.lit(1.0),
    })
    state = space.stored(state, "dual")
    rows = hist.withColumnRenamed("source", "s_")
    for _ in range(steps):
        both = rows.join(state, F.col("s_").eqNullSafe(F.col("source")))
        rate = _rate(cap)
        part = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, part * F.col("size") / F.col("top")).otherwise(F.lit(0.0))
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        sums = both.groupBy("s_").agg(exact(part).alias("g"), exact(slope).alias("d"))
        g, goal = F.col("g"), F.col("target")
        lo = F.when(g < goal, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(g < goal, F.col("hi")).otherwise(F.col("lam"))
        step = F.col("lam") - F.try_divide(F.log(F.try_divide(g, goal)) * g, F.col("d"))
        off = F.abs(g - goal) / F.greatest(goal, F.lit(1.0))
        ended = F.col("full") | F.col("lam").isNull() | (off < 1e-9)
        state = state.join(sums, F.col("source").eqNullSafe(F.col("s_")), "left").withColumns(
            {"lo": lo, "hi": hi, "step": step, "off": F.when(ended, F.lit(0.0)).otherwise(off)}
        )
        inside = (F.col("d") > 0) & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        moved = F.when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = state.withColumn("lam", F.when(F.col("off") == 0, F.col("lam")).otherwise(moved))
        state = space.stored(state.drop("s_", "g", "d", "step"), "dual")
        if not state.agg(F.max("off")).first()[0]:
            break
    return state


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    weights: tuple = WEIGHTS,
    cap: int = CAP,
    seed: int = 0,
) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, rate, copies, taken.

    ``share`` times all words are wanted.  Null texts have size 0 and get no copies; a null
    source is a source.  Rows of one id in a source are decided alike when their sizes are
    equal.  An empty table gives an empty result.  Draws are hashes of (id, size), so
    reruns agree."""
    space = Workspace(docs.sparkSession)
    rows = docs.select(
        named(id_col).alias("id"),
        named(source_col).alias("source"),
        F.size(words(named(text_col))).cast("long").alias("size"),
    )
    rows = space.stored(rows, "sizes")
    hist = space.stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sizes, share, weights, cap)
    state = solve(hist, goals, cap, space).select("source", "source_size", "target", "full", "top", "lam")
    rated = rows.withColumnRenamed("source", "of_").join(state, F.col("of_").eqNullSafe(F.col("source")))
    rate = F.when(F.col("size") > 0, _rate(cap)).otherwise(F.lit(0.0))
    rated = rated.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    # the 48 bits say how early a document gets one more copy
    draw = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), "id", "size"), F.lit(16)) / F.lit(float(2**48))
    early = (draw - (F.col("rate") - F.col("whole")) + 1) / 2
    bits = DIGIT * DIGITS
    order = F.least(F.greatest(F.floor(early * float(2**bits)), F.lit(0)), F.lit(2**bits - 1))
    can = (F.col("size") > 0) & (F.col("whole") < cap)
    rated = rated.select(
        "id", "source", "size", "source_size", "target", "rate", "whole", F.when(can, order).alias("order")
    )
    rated = space.stored(rated, "rates")
    ends = _closed(rated, _cuts(rated, space), cap, space)
    ends = ends.select(F.col("source").alias("s_"), "cut", "changes")
    done = rated.join(ends, F.col("source").eqNullSafe(F.col("s_")), "left")
    mine = F.filter("changes", lambda x: x["one"] == F.struct("size", ordered(F.col("id")).alias("key")))
    copies = F.coalesce(_base() + F.coalesce(F.get(mine, F.lit(0))["more"], F.lit(0)), F.lit(0)).cast("long")
    return done.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def _base() -> Column:
    """Copies by the rounding order alone."""
    return F.col("whole") + F.coalesce(F.col("order") < F.col("cut"), F.lit(False)).cast("long")


def _closed(rated: DataFrame, cut: DataFrame, cap: int, space: Workspace) -> DataFrame:
    """(source, cut, gap, changes): a few documents near the cut get a copy more or less, so that the words taken
    come close to the target.

    Of the documents nearest to the cut, one for each of ``DEALT`` hash buckets, ``POOL`` are tried in all
    combinations of one copy less, as many, one more; the best one is kept if it is better than
    none.  Rounds take other documents.  A source of few documents is tried as a whole."""
    one = F.struct("size", ordered(F.col("id")).alias("key"))
    kind = rated.select(one.alias("one")).schema["one"].dataType.simpleString()
    ends = cut.withColumn("changes", F.array().cast(f"array<struct<one: {kind}, more: bigint>>"))
    rows = rated.filter("size > 0").withColumnRenamed("source", "s_")
    for _ in range(CLOSERS):
        open_ = ends.filter(F.abs("gap") >= 1)
        if open_.isEmpty():
            break
        near = rows.join(open_, F.col("s_").eqNullSafe(F.col("source")))
        near = near.filter(~F.exists("changes", lambda x: x["one"] == one))
        far = F.abs(F.coalesce("order", F.lit(2 ** (DIGIT * DIGITS))) - F.col("cut"))
        best = near.groupBy("s_", F.pmod(F.xxhash64("id", "size"), F.lit(DEALT)).alias("bucket")).agg(
            F.min(F.struct(far.alias("far"), one.alias("one"))).alias("near")
        )
        pool = best.groupBy(F.col("s_").alias("p_")).agg(  # at most DEALT rows
            F.transform(F.slice(F.array_sort(F.collect_list("near")), 1, POOL), lambda x: x["one"]).alias("pool")
        )
        # rows that repeat an id and a size change together
        tried = near.join(pool, F.col("s_").eqNullSafe(F.col("p_"))).filter(F.array_contains("pool", one))
        tried = tried.groupBy("s_", one.alias("one"), _base().alias("base")).agg(F.sum("size").alias("words"))
        tried = tried.groupBy("s_").agg(F.array_sort(F.collect_list(F.struct("one", "base", "words"))).alias("tried"))
        ends = ends.join(tried, F.col("source").eqNullSafe(F.col("s_")), "left")
        found = F.array_min(F.transform(_sums(F.col("tried"), cap), lambda x: F.struct(F.abs(F.col("gap") - x["words"]).alias("off"), x["code"].alias("code"), x["words"].alias("words"))))
        ends = space.stored(ends.withColumn("found", found), "tried")
        better = F.coalesce(F.col("found.off") < F.abs("gap"), F.lit(False))
        digit = lambda i: F.floor(F.col("found.code") / F.pow(F.lit(3.0), i.cast("double"))) % 3 - 1
        told = F.transform("tried", lambda x, i: F.struct(x["one"].alias("one"), digit(i).cast("long").alias("more")))
        ends = ends.select(
            "source", "cut",
            F.when(better, F.col("gap") - F.col("found.words")).otherwise(F.col("gap")).alias("gap"),
            F.when(better, F.concat("changes", told)).otherwise(F.col("changes")).alias("changes"),
        )
        ends = space.stored(ends, "cut")
    return ends


def _sums(tried: Column, cap: int) -> Column:
    """(words, code) of all combinations: digit i of the code, to base 3, is what document i gets, plus 1."""
    least = F.array(F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("code"), F.lit(1).cast("long").alias("unit")))

    def add(sums: Column, x: Column) -> Column:
        ways = F.filter(F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)]), lambda d: (x["base"] + d >= 0) & (x["base"] + d <= cap))
        each = lambda s: F.transform(ways, lambda d: F.struct(
            (s["words"] + d * x["words"]).alias("words"), (s["code"] + (d + 1) * s["unit"]).alias("code"), (s["unit"] * 3).alias("unit")
        ))
        return F.flatten(F.transform(sums, each))

    return F.aggregate(tried, least, add)


def _cuts(rated: DataFrame, space: Workspace) -> DataFrame:
    """(source, cut, gap): documents before the cut fit into the target, ``gap`` words are left (below 0: too many whole copies)."""
    have = rated.groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("had")
    )
    cut = have.select(
        "source",
        F.lit(0).cast("long").alias("cut"),
        F.greatest(F.floor("target") - F.col("had"), F.lit(0)).cast("long").alias("gap"),
        (F.col("target") - F.floor("target") + F.least(F.floor("target") - F.col("had"), F.lit(0))).alias("rest"),
        F.lit(False).alias("all_in"),
    )
    cut = space.stored(cut, "cut")
    for k in range(DIGITS):
        low = DIGIT * (DIGITS - 1 - k)
        here = rated.filter(F.col("order").isNotNull()).select(F.col("source").alias("s_"), "order", "size")
        here = here.join(cut, F.col("s_").eqNullSafe(F.col("source")))
        high = low + DIGIT
        same = F.shiftright("order", high) == F.shiftright("cut", high)
        here = here.filter(same & ~F.col("all_in"))
        digit = F.shiftright("order", low).bitwiseAND(2**DIGIT - 1)
        sums = here.groupBy("s_", digit.alias("digit")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("s_").orderBy("digit")  # at most 2**DIGIT rows
        sums = sums.withColumn("upto", F.sum("size").over(upto)).join(
            cut.select("source", "gap"), F.col("s_").eqNullSafe(F.col("source"))
        )
        over = F.col("upto") > F.col("gap")
        found = sums.groupBy("s_").agg(
            F.min(F.when(over, F.struct("digit", (F.col("upto") - F.col("size")).alias("before")))).alias("at"),
            F.max("upto").alias("every"),
        )
        cut = cut.join(found, F.col("source").eqNullSafe(F.col("s_")), "left")
        more = F.shiftleft(F.coalesce(F.col("at.digit"), F.lit(0)).cast("long"), low)
        none = F.col("all_in") | F.col("at").isNull()
        # where all fit, the cut lies beyond the last
        cut = cut.select(
            "source",
            F.when(none, F.lit(2 ** (DIGIT * DIGITS)).cast("long")).otherwise(F.col("cut") + more).alias("cut"),
            F.when(none, F.col("gap")).otherwise(F.col("gap") - F.col("at.before")).alias("gap"),
            "rest",
            none.alias("all_in"),
        )
        cut = space.stored(cut, "cut")
    return cut.select("source", "cut", (F.col("gap") + F.col("rest")).alias("gap"))
