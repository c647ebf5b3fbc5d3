"""MinHash near-dedup with DartMinHash signatures.

A set's elements (five-word shingles, weighted) own regions of a plane of weight and rank on
which darts fall: a fixed random process, told by hashes of the element and the cell, thrown only
as far in rank as the set needs for about ``k ln k + 2k`` darts.  Each dart belongs to one of
``k`` coordinates; the earliest dart of a coordinate is its minimum.  The cost depends on the
darts, not on elements times coordinates.  Equal minima are as likely as the sets are similar.

Copies with equal shingles become one representative.  Coordinates are joined in bands, and members of a
band's bucket are compared with its most central member.  Where a bucket still holds several classes,
its members are dealt anew into finer buckets, each of three bands that must all agree, and compared with
a member picked by hash; this merges most of what belongs together.  Texts whose buckets are mixed even
then are joined exactly: two sets at the wanted similarity share one of their rarest shingles at
positions that leave room for the overlap needed, so texts that have only boilerplate in common don't meet.
Comparisons are made on all shingles.  Classes are the connected components of the links found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmend.llm.blocked_filter import among, not_among
from tabmend.llm.common import Workspace, full, named, shipped, words

shipped(__name__)

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no bucket in 1 of 300,000 cases
LOW_CELL = -6  # ranks below 2**LOW_CELL are one cell
ROUNDS = 100
#: Finer buckets of a text: each of three bands, spread evenly by a fixed rule.
TRIPLES = 300
#: Cells in which shingles are counted to order them by rarity; two that share a cell cost time only.
CELLS = 1 << 18

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Chances of at most 0, 1, 2 ... darts."""
    n = np.arange(int(mean + 12 * mean**0.5 + 24))
    logs = n * np.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(n[1:]))))
    return np.cumsum(np.exp(logs))


def shingles(codes: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(set, element, times), sorted, of texts whose word codes lie one after another.

    A text of fewer words is one shingle; a text without words has none."""
    starts = np.concatenate(([0], ends[:-1]))
    length = ends - starts
    many = np.maximum(length - size + 1, np.minimum(length, 1))
    owner = np.repeat(np.arange(len(ends)), many)
    first = np.arange(many.sum()) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many) + starts[owner]
    code = _mix(np.minimum(length, size)[owner].astype(np.uint64))
    for j in range(size):
        there = first + j < ends[owner]
        word = codes[np.minimum(first + j, max(len(codes) - 1, 0))] if len(codes) else np.zeros(len(first), np.uint64)
        code = np.where(there, _mix(code * U(0x9E3779B97F4A7C15) + word), code)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """The earliest rank of each coordinate (a row for each set, infinite for empty sets)."""
    sums = np.bincount(owner, weight, sets)
    least = np.full(sets * k, np.inf)
    chances: dict[float, np.ndarray] = {}
    reach = np.where(sums > 0, (k * np.log(k) + 2 * k) / np.maximum(sums, 1e-300), 0.0)
    todo = sums > 0
    while todo.any():
        mine = todo[owner]
        o, e, w = owner[mine], element[mine], weight[mine]
        limit = reach[o]
        high_w = int(np.ceil(np.log2(max(w.max(), 1.0))))
        high_r = int(np.ceil(np.log2(max(limit.max(), 2.0**LOW_CELL))))
        for nu in range(high_w + 1):
            w_low, w_wide = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0 ** (nu - 1))
            for rho in range(LOW_CELL, high_r + 1):
                r_low, r_wide = (0.0, 2.0**rho) if rho == LOW_CELL else (2.0 ** (rho - 1), 2.0 ** (rho - 1))
                here = np.flatnonzero((w > w_low) & (limit > r_low))
                if not len(here):
                    continue
                cell = _mix(e[here] + U(((nu * 4096 + rho + 2048) * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
                area = w_wide * r_wide
                if area not in chances:
                    chances[area] = _poisson(area)
                count = np.searchsorted(chances[area], _unit(_mix(cell)), side="right")
                hit = np.flatnonzero(count)
                times = count[hit]
                src = np.repeat(hit, times)
                number = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
                dart = _mix(cell[src] + (number.astype(np.uint64) + U(1)) * U(0xD1B54A32D192ED03))
                at = here[src]
                rank = r_low + r_wide * _unit(dart)
                keep = rank <= limit[at]
                if w_low + w_wide > 1.0:
                    keep &= w_low + w_wide * _unit(_mix(dart ^ U(0xA5A5A5A5A5A5A5A5))) <= w[at]
                at, rank, dart = at[keep], rank[keep], dart[keep]
                coordinate = (_mix(dart ^ U(0x5851F42D4C957F2D)) % U(k)).astype(np.int64)
                np.minimum.at(least, o[at] * k + coordinate, rank)
        todo = todo & np.isinf(least.reshape(sets, k)).any(axis=1)
        reach = np.where(todo, reach * 2, reach)
    return least.reshape(sets, k)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = least.view(np.uint64).reshape(len(least), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2])
    for r in range(rows):
        key = _mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch one after another, and where each text ends."""
    ends = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values, dtype=np.int64)[ends[0] : ends[-1]].astype(np.int64).view(np.uint64)
    return values, ends[1:] - ends[0]


def _word_codes(text):
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def sketched(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, weights: str) -> DataFrame:
    """(id, same1, same2, n, keys): equal (same1, same2) mean equal shingles; keys are the buckets."""
    df = docs.select(named(id_col).alias("id"), _word_codes(full(named(text_col))).alias("codes"))
    kind = df.schema["id"].dataType

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes, ends = _codes(part.column(1))
                owner, element, times = shingles(codes, ends)
                weight = times.astype(np.float64) if weights == "count" else np.ones(len(times))
                keys = band_keys(signatures(owner, element, weight, len(ends), bands * rows), bands, rows)
                told = [_mix(element + U(s)) * (times.astype(np.uint64) if weights == "count" else U(1)) for s in (1, 2)]
                size = np.bincount(owner, weight, len(ends))
                sums = [np.zeros(len(ends), np.uint64) for _ in told]
                for total, each in zip(sums, told, strict=True):
                    np.add.at(total, owner, each)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(_mix(s).view(np.int64)) for s in sums], pa.array(size.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))],
                    names=["id", "same1", "same2", "n", "keys"],
                )

    return df.mapInArrow(sketch, f"id {kind.simpleString()}, same1 long, same2 long, n long, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float, weights: str) -> DataFrame:
    """The pairs (a, b) of ids whose shingles are similar enough, compared in full over ``texts`` (id, t)."""
    left = texts.select(F.col("id").alias("a_id"), F.col("t").alias("t_a"))
    right = texts.select(F.col("id").alias("b_id"), F.col("t").alias("t_b"))
    # a has few pairs, b may have many: its partition is split where it is large
    both = pairs.join(left, F.col("a") == F.col("a_id")).drop("a_id")
    both = both.join(right, F.col("b") == F.col("b_id")).drop("b_id")
    both = both.select("a", "b", _word_codes(F.col("t_a")).alias("x"), _word_codes(F.col("t_b")).alias("y"))
    kind = both.schema["a"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = [shingles(*_codes(part.column(c))) for c in (2, 3)]
                owner = np.concatenate([s[0] for s in sides])
                element = np.concatenate([s[1] for s in sides])
                weight = np.concatenate([s[2] if weights == "count" else np.ones(len(s[2]), np.int64) for s in sides])
                order = np.lexsort((element, owner))
                owner, element, weight = owner[order], element[order], weight[order]
                twice = np.flatnonzero((owner[1:] == owner[:-1]) & (element[1:] == element[:-1]))
                common = np.bincount(owner[twice], np.minimum(weight[twice], weight[twice + 1]), part.num_rows)
                every = np.bincount(owner, weight, part.num_rows) - common
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(common >= similarity * every - 1e-9)], names=["a", "b", "ok"]
                )

    return both.mapInArrow(compare, f"a {kind}, b {kind}, ok boolean").filter("ok").select("a", "b")


def components(nodes: DataFrame, edges: DataFrame, space: Workspace) -> DataFrame:
    """(id, comp): each node and the smallest id that it is linked with, over any number of links."""
    edges = space.stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    comp = space.stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "classes")
    last = comp
    for _ in range(ROUNDS):
        # the smallest class among neighbours, hung under the class it had, then one jump
        c = comp.select(F.col("id").alias("n_"), F.col("comp").alias("c_"))
        near = edges.join(c, F.col("b") == F.col("n_")).groupBy(F.col("a").alias("id")).agg(F.min("c_").alias("low"))
        now = comp.join(near, "id").select("id", "comp", F.least("comp", "low").alias("low"))
        hang = now.groupBy(F.col("comp").alias("r_")).agg(F.min("low").alias("up"))
        now = now.join(hang, F.col("comp") == F.col("r_")).select("id", F.col("comp").alias("was"), F.least("low", "up").alias("comp"))
        jump = now.select(F.col("id").alias("j_"), F.col("comp").alias("to"))
        now = now.join(jump, F.col("comp") == F.col("j_"), "left").select("id", "was", F.least("comp", F.coalesce("to", "comp")).alias("comp"))
        now = space.stored(now, "classes")
        space.discard(last)
        comp, last = now.drop("was"), now
        if now.filter("comp <> was").isEmpty():
            break
    else:
        raise RuntimeError("the classes did not settle")
    space.discard(edges)
    full_ = nodes.join(comp.withColumnRenamed("id", "n_"), F.col("id") == F.col("n_"), "left")
    return full_.select("id", F.coalesce("comp", "id").alias("comp"))


def _mixed(spots: DataFrame, comp: DataFrame, space: Workspace) -> DataFrame:
    """(m_, comp): the members of buckets that hold several classes."""
    placed = space.stored(spots.select("key", "rep").join(comp, F.col("rep") == F.col("id")).drop("id"), "placed")
    mixed = placed.groupBy(F.col("key").alias("k_")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return placed.join(mixed.select("k_"), F.col("key") == F.col("k_")).select(F.col("rep").alias("m_"), "comp").distinct()


def triples(bands: int, count: int) -> list[tuple[int, int, int]]:
    """``count`` different threes of bands (fewer if there are no more), by steps of a fixed generator."""
    found: dict[tuple[int, ...], None] = {}
    most = bands * (bands - 1) * (bands - 2) // 6
    x = 1
    while len(found) < min(count, most):
        picked = set()
        while len(picked) < 3:
            x = x * 48271 % (2**31 - 1)
            picked.add(x % bands)
        found[tuple(sorted(picked))] = None
    return list(found)


def _tokens(column: pa.Array, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element) of a batch, each copy by itself where copies count, and the size of each text."""
    owner, element, times = shingles(*_codes(column))
    if weights == "count":
        number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner, element = np.repeat(owner, times), np.repeat(element, times) + number.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    return owner, _mix(element), np.bincount(owner, minlength=len(column))


def prefixes(texts: DataFrame, similarity: float, weights: str) -> DataFrame:
    """(id, comp, n, token, pos): the rarest elements of each text (id, comp, codes), counted from 0.

    Any total order of elements makes the join whole; counts of all texts in cells make it short."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                token = _tokens(batch.slice(at, 256).column(2), weights)[1]
                cells += np.bincount((token % U(CELLS)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "n"])

    counted = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)
    often[np.asarray(counted["cell"])] = np.asarray(counted["n"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, token, size = _tokens(part.column(2), weights)
                order = np.lexsort((token, often[(token % U(CELLS)).astype(np.int64)], owner))
                owner, token = owner[order], token[order]
                pos = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
                here = np.flatnonzero(pos <= size[owner] * (1 - similarity) + 1e-9)
                which = pa.array(owner[here])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(which), part.column(1).take(which), pa.array(size[owner[here]]),
                     pa.array(token[here].view(np.int64)), pa.array(pos[here])],
                    names=["id", "comp", "n", "token", "pos"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(rarest, f"id {kind}, comp {kind}, n long, token long, pos long")


def possible(texts: DataFrame, similarity: float, weights: str, space: Workspace) -> DataFrame:
    """The pairs (a, b) of texts (id, comp, codes) of different classes that can be similar enough.

    No such pair is missed.  The first element that two sets have in common, x and y places from their
    ends, leaves an overlap of at most the smaller of x and y."""
    all_ = space.stored(prefixes(texts, similarity, weights), "prefixes")
    share = similarity / (1 + similarity)
    short = all_.filter(F.col("pos") <= F.col("n") * (1 - 2 * share) + 1e-9)
    short = short.select(*[F.col(c).alias(f"{c}_") for c in short.columns])
    met = short.join(
        all_,
        (F.col("token_") == F.col("token")) & (F.col("comp_") != F.col("comp"))
        & ((F.col("n_") < F.col("n")) | (F.col("n_") == F.col("n")) & (F.col("id_") < F.col("id")))
        & (F.col("n_") >= similarity * F.col("n") - 1e-9)
        & (F.least(F.col("n_") - F.col("pos_"), F.col("n") - F.col("pos")) >= share * (F.col("n_") + F.col("n")) - 1e-9),
    )
    return met.select(F.greatest("id_", "id").alias("a"), F.least("id_", "id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    weights: str = "set",
) -> DataFrame:
    """Per row of ``docs``: id and class_id, the smallest id of its class.

    Words are lower-cased.  Similarity is that of sets (``weights="set"``) or of counts
    (``"count"``).  Texts of fewer than five words are one shingle; null and empty texts have
    equal (empty) sets and are one class.  A null id can't name a class: such a row is a class
    of its own, null.  Rows that repeat an id should have one text; else pairs of any of them count.  An
    empty table gives no rows."""
    space = Workspace(docs.sparkSession)
    known = docs.filter(named(id_col).isNotNull())
    rows_ = space.stored(sketched(known, id_col, text_col, bands, rows, weights), "sketches")
    # one representative for texts of equal shingles, before anything is compared
    reps = rows_.groupBy("same1", "same2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = space.stored(reps, "representatives")
    spots = reps.filter("n > 0").select("rep", "n", F.explode("keys").alias("key"))
    shared = spots.groupBy(F.col("key").alias("k_")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = space.stored(spots.join(shared, F.col("key") == F.col("k_")).drop("k_"), "buckets")
    central = met.groupBy(F.col("rep").alias("c_")).agg(F.sum("size").alias("central"))
    spots = space.stored(met.join(central, F.col("rep") == F.col("c_")).drop("c_"), "buckets")
    space.discard(met)
    sharing = space.stored(spots.select(F.col("rep").alias("id")).distinct(), "sharing")
    # only these texts are ever compared: they move once, and later joins read no others
    texts = among(known.select(named(id_col).alias("id"), full(named(text_col)).alias("t")), "id", sharing, "id")
    texts = space.stored(texts, "texts")
    # the most central member leads, the smaller id of equals
    lead = spots.groupBy(F.col("key").alias("k_")).agg(F.min(F.struct(-F.col("central"), "rep", "n")).alias("l"))
    close = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b)
    pairs = spots.join(lead, F.col("key") == F.col("k_")).select("rep", "n", F.col("l.rep").alias("b"), F.col("l.n").alias("m"))
    pairs = pairs.filter((F.col("rep") != F.col("b")) & close(F.col("n"), F.col("m")))
    pairs = space.stored(pairs.select(F.col("rep").alias("a"), "b").distinct(), "pairs")
    links = space.stored(similar(pairs, texts, similarity, weights).distinct(), "links")
    nodes = reps.select(F.col("rep").alias("id"))
    comp = space.stored(components(sharing, links, space), "classes")
    # buckets that still hold several classes: members meet one of each finer bucket
    mixed = _mixed(spots, comp, space)
    fine = F.array(*[
        F.struct(*[F.lit(i).alias(c) for c, i in zip("abc", three, strict=True)]) for three in triples(bands, TRIPLES)
    ])
    again = reps.join(mixed, F.col("rep") == F.col("m_")).select("rep", "n", "comp", "keys", F.explode(fine).alias("f"))
    at = lambda c: F.get(F.col("keys"), F.col(f"f.{c}"))
    again = again.select("rep", "n", "comp", F.xxhash64("f", at("a"), at("b"), at("c")).alias("key"))
    lead = again.groupBy(F.col("key").alias("k_")).agg(
        F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep", "n", "comp")).alias("l"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
    ).filter("lo <> hi")
    more = again.join(
        lead, (F.col("key") == F.col("k_")) & (F.col("comp") != F.col("l.comp")) & close(F.col("n"), F.col("l.n"))
    )
    one, two = F.least(F.col("rep"), F.col("l.rep")), F.greatest(F.col("rep"), F.col("l.rep"))
    more = more.select(two.alias("a"), one.alias("b")).distinct()
    done = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = space.stored(more.join(done, ["a", "b"], "left_anti"), "pairs")
    new = similar(more, texts, similarity, weights)
    links = space.stored(links.unionByName(new).distinct(), "links")
    comp = space.stored(components(nodes, links, space), "classes")
    # texts of buckets that are mixed even then: all pairs that can be similar enough
    mixed = space.stored(_mixed(spots, comp, space), "mixed")
    if not mixed.isEmpty():
        codes = texts.join(mixed, F.col("id") == F.col("m_")).select("id", "comp", _word_codes(F.col("t")).alias("codes"))
        last = possible(codes, similarity, weights, space)
        last = last.join(done, ["a", "b"], "left_anti").join(more, ["a", "b"], "left_anti")
        last = space.stored(last, "pairs")
        new = similar(last, texts, similarity, weights)
        links = space.stored(links.unionByName(new).distinct(), "links")
        comp = space.stored(components(nodes, links, space), "classes")
    space.discard(spots, texts, sharing, pairs, more)
    comp = comp.withColumnRenamed("id", "r_")
    told = reps.select("same1", "same2", "rep").join(comp, F.col("rep") == F.col("r_")).select(
        F.col("same1").alias("s1"), F.col("same2").alias("s2"), "comp"
    )
    members = rows_.select("id", "same1", "same2").join(told, (F.col("same1") == F.col("s1")) & (F.col("same2") == F.col("s2")))
    result = members.select(F.col("id").alias(id_col), F.col("comp").alias("class_id"))
    alone = docs.filter(named(id_col).isNull()).select(
        named(id_col).alias(id_col), named(id_col).alias("class_id")
    )
    return result.unionByName(alone)


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row of the smallest id stays.

    Texts that share an id are told apart by a hash of the text: each is judged by itself, the smaller hash
    leads, and of rows with one id and one text the smallest stays.  A row without an id is a class of
    its own and stays.  Only rows that may go are moved."""
    space = Workspace(docs.sparkSession)
    ids = docs.filter(named(id_col).isNotNull()).groupBy(named(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    repeated = not ids.filter("n > 1").isEmpty()
    key = named(id_col)
    if repeated:
        key = F.when(named(id_col).isNotNull(), F.struct(named(id_col).alias("id"), F.xxhash64(full(named(text_col))).alias("h")))
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row_"), key.alias("key_"), full(named(text_col)).alias("text_"))
    told = near_duplicates(rows.select("key_", "text_").filter("key_ IS NOT NULL"), "key_", "text_", **kwargs)
    gone = space.stored(told.filter("key_ <> class_id").select("key_").distinct(), "gone")
    kept = not_among(rows.drop("text_"), "key_", gone, "key_")
    if repeated:
        once = kept.filter("key_ IS NOT NULL").groupBy("key_").agg(F.min("row_").alias("row_"))
        kept = kept.filter("key_ IS NULL").select("row_").unionByName(once.select("row_"))
    return kept.select("row_.*")
