"""Exact percentiles (linear interpolation) with bounded state.

Spark's ``percentile`` keeps every distinct value of a column in one reducer.
That is the fastest way for small tables: one fused aggregate.  Beyond that the
order statistics are distributed:

1. distinct values are counted in one grouped aggregate, a value that fills a third
   of the table being one row;
2. the counted values are dealt by value into ranges whose cut points Spark samples, and
   stored with the number of their range;
3. the totals of the ranges, a row for each, give by prefix sums the one range that
   holds a rank, and how many cells come before it;
4. only that range is read again, and the rank is found by a running sum inside it.

No task ever sees more than a range, whatever the size of the column.  Where a column
is long, a KLL sketch first proposes the values around the wanted ranks, and an exact count
confirms them, so that little is stored; a sketch that is wrong costs space, never
the answer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tabmend.functions.kinds import number
from tabmend.session import Scratch

# Cells one fused ``percentile`` job may keep, over all its columns.
DIRECT_CELLS = 200_000
# Cells that a range of values holds at most, about; longer columns are narrowed first.
RANGE_VALUES = 100_000
# Columns searched together in the same scans.
COLUMNS_PER_SEARCH = 32
SKETCH_K = 1000
SKETCH_PAD = 0.01
SKETCH_GROUPS = 256


@dataclass
class _Search:
    """Where the order statistics ``first`` and ``first + 1`` of a column are."""

    name: str
    prob: float
    cells: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def first(self) -> int:
        return int(self.prob * (self.cells - 1))

    @property
    def second(self) -> int:
        return min(self.first + 1, self.cells - 1)

    @property
    def weight(self) -> float:
        return self.prob * (self.cells - 1) - self.first

    def within(self, value: str) -> str:
        return f"({value} BETWEEN {number(self.low)} AND {number(self.high)})"

    def kept(self, value: str) -> str:
        return f"CASE WHEN {self.within(value)} THEN {value} END"

    def holds(self, below: int, inside: int) -> bool:
        return below <= self.first and self.second < below + inside


def exact_quantiles(
    df: DataFrame,
    values: dict[str, str],
    probs: tuple[float, ...],
    cells: dict[str, int],
    direct_cells: int | None = None,
    range_values: int | None = None,
) -> dict[str, dict[float, float]]:
    """Percentiles of each SQL expression in ``values``; ``cells`` gives its non-null
    count.  A column without cells is left out."""
    limit = DIRECT_CELLS if direct_cells is None else direct_cells
    result: dict[str, dict[float, float]] = {}
    batch: list[str] = []
    held = 0
    wide: list[str] = []
    for name in (n for n in values if cells[n] > 0):
        if cells[name] > limit:
            wide.append(name)
            continue
        if held + cells[name] > limit:
            result |= _direct(df, values, probs, batch)
            batch, held = [], 0
        batch.append(name)
        held += cells[name]
    if batch:
        result |= _direct(df, values, probs, batch)
    if wide:
        keep = RANGE_VALUES if range_values is None else range_values
        for i in range(0, len(wide), COLUMNS_PER_SEARCH):
            group = {n: values[n] for n in wide[i : i + COLUMNS_PER_SEARCH]}
            result |= _narrowed(df, group, probs, cells, keep)
    return result


def _direct(df, values, probs, names) -> dict[str, dict[float, float]]:
    wanted = ", ".join(number(p) for p in probs)
    row = df.selectExpr(
        *[f"percentile({values[n]}, array({wanted})) AS q{i}" for i, n in enumerate(names)]
    ).first()
    return {n: dict(zip(probs, row[i])) for i, n in enumerate(names)}


def _narrowed(df, values, probs, cells, keep) -> dict[str, dict[float, float]]:
    x = {n: f"CAST({v} AS DOUBLE)" for n, v in values.items()}
    everything = (-math.inf, math.inf)
    searches = [_Search(n, p, cells[n], *everything, 0, cells[n]) for n in x for p in probs]
    long = [s for s in searches if s.inside > keep]
    if long:
        _tighten(df, x, long)
    return _order_statistics(df, x, searches, keep)


def _tighten(df, x, searches: list[_Search]) -> None:
    """Two scans: sketch the range of every search (searches
    with one range share a sketch), then count the proposed ranges."""
    ranges = list(dict.fromkeys((s.name, s.low, s.high) for s in searches))
    slot = {r: i for i, r in enumerate(ranges)}
    kept = {(s.name, s.low, s.high): s.kept(x[s.name]) for s in searches}
    grouped = (
        df.selectExpr(
            f"spark_partition_id() % {SKETCH_GROUPS} AS part",
            *[f"{kept[r]} AS s{i}" for r, i in slot.items()],
        )
        .groupBy("part")
        .agg(*[F.expr(f"kll_sketch_agg_double(s{i}, {SKETCH_K}) AS k{i}") for i in slot.values()])
    )
    wanted: dict[int, list[float]] = {i: [] for i in slot.values()}
    for s in searches:
        wanted[slot[s.name, s.low, s.high]] += [
            max((s.first - s.below) / s.inside - SKETCH_PAD, 0.0),
            min((s.second - s.below) / s.inside + SKETCH_PAD, 1.0),
        ]
    found = grouped.selectExpr(
        *[
            f"kll_sketch_get_quantile_double(kll_merge_agg_double(k{i}, {SKETCH_K}), "
            f"array({', '.join(map(number, ps))})) AS r{i}"
            for i, ps in wanted.items()
        ]
    ).first()
    answers = {i: iter(found[i]) for i in wanted}
    proposed = []
    for s in searches:
        answer = answers[slot[s.name, s.low, s.high]]
        low, high = next(answer), next(answer)
        at_start = (s.first - s.below) / s.inside <= SKETCH_PAD
        at_end = (s.second - s.below) / s.inside >= 1.0 - SKETCH_PAD
        proposed.append((s.low if at_start else low, s.high if at_end else high))
    counts = []
    for i, (s, (low, high)) in enumerate(zip(searches, proposed)):
        v = x[s.name]
        inside = f"{v} BETWEEN {number(low)} AND {number(high)}"
        counts += [
            f"count_if({v} < {number(low)}) AS b{i}",
            f"count_if({inside}) AS i{i}",
        ]
    got = df.selectExpr(*counts).first()
    for i, (s, (low, high)) in enumerate(zip(searches, proposed)):
        below, inside = got[2 * i : 2 * i + 2]
        if s.holds(below, inside):
            s.low, s.high, s.below, s.inside = low, high, below, inside


def _order_statistics(df, x, searches: list[_Search], keep: int) -> dict[str, dict[float, float]]:
    """Count the distinct values of each search, deal them into ranges, and read off
    two ranks.  Searches over the same values share the counts."""
    spans = list(dict.fromkeys((s.name, s.low, s.high) for s in searches))
    slot = {r: i for i, r in enumerate(spans)}
    kept = {(s.name, s.low, s.high): s.kept(x[s.name]) for s in searches}
    cells = ", ".join(f"named_struct('slot', {i}, 'value', {kept[r]})" for r, i in slot.items())
    counted = (
        df.selectExpr(f"inline(array({cells}))")
        .where("value IS NOT NULL")
        .groupBy("slot", "value")
        .agg(F.expr("count(1) AS n"))
    )
    most = sum({(s.name, s.low, s.high): s.inside for s in searches}.values())
    scratch = Scratch(df.sparkSession)
    # the number of a range holds for the written table alone: another run may draw other cut points
    dealt = counted.repartitionByRange(max(1, math.ceil(most / keep)), "slot", "value")
    dealt = scratch.stored(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    totals = sorted(tuple(r) for r in dealt.groupBy("slot", "part").agg(F.sum("n")).collect())
    spots = {}
    for s in searches:
        for rank in {s.first, s.second}:
            spots[s.name, s.prob, rank] = _spot(totals, slot[s.name, s.low, s.high], rank - s.below)
    found = _look_up(dealt, sorted(set(spots.values())))
    scratch.discard()
    result: dict[str, dict[float, float]] = {}
    for s in searches:
        a, b = (found[spots[s.name, s.prob, rank]] for rank in (s.first, s.second))
        exact = a if s.weight == 0.0 else (1.0 - s.weight) * a + s.weight * b
        result.setdefault(s.name, {})[s.prob] = float(exact)
    return result


def _spot(totals: list[tuple[int, int, int]], slot: int, rank: int) -> tuple[int, int, int]:
    """(slot, part, rank inside the part) of a rank among the values of a slot."""
    for own, part, n in totals:
        if own == slot:
            if rank < n:
                return slot, part, rank
            rank -= n
    raise ValueError("there are fewer cells than were counted before; has the input changed?")


def _look_up(dealt: DataFrame, spots: list[tuple[int, int, int]]) -> dict[tuple, float]:
    """The values at some ranks: a running sum over the ranges that hold them."""
    places = sorted({spot[:2] for spot in spots})
    here = " OR ".join(f"slot = {s} AND part = {p}" for s, p in places)
    upto = "sum(n) OVER (PARTITION BY slot, part ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wanted = [
        f"min(value) FILTER (WHERE slot = {s} AND part = {p} AND upto > {rank}L) AS v{i}"
        for i, (s, p, rank) in enumerate(spots)
    ]
    row = dealt.where(here).selectExpr("*", f"{upto} AS upto").selectExpr(*wanted).first()
    return dict(zip(spots, row, strict=True))
