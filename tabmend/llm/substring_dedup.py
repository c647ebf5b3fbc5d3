"""Exact substring dedup: remove every byte of a string of ``length`` bytes that occurred before.

Strings that are equal must meet without sending every string anywhere.  Each string has a
lead: the smallest hash of the 24-byte pieces in it.  Neighbouring strings share their lead, so a
text falls into runs (about one to 40 strings), and equal strings lie in runs of equal leads.

1. A run that is equal to an earlier run holds only repeats.  Tasks find such runs among their own
   texts first, so that a run of any number of copies leaves a task once.
2. Runs of equal leads that differ, and runs that may repeat themselves, are compared: block by block, their suffixes are sorted, and the
   Burrows-Wheeler transform of the block is searched breadth first.  All strings of one
   letter are its first intervals; extending every interval backwards by a letter gives those of the
   next length, and what falls apart at that step has just this length as common prefix.  The
   search stops at ``length``: suffixes not yet apart share a whole string.  Runs none of whose strings
   has a hash that occurs again in the block are left out before: they lose nothing and take nothing.
3. Leads that a sample of the texts shows to be very frequent would fill a block; their
   strings are compared by a hash of each whole string instead, of which one per task is sent.  So are those of
   any lead whose runs, once counted over all texts, exceed a block, wherever the sample missed it: no block
   grows with a lead, though one run may be as long as its text.  Which leads these are changes the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import Workspace, full, named, ordered, shipped

shipped(__name__)

LENGTH = 100
PIECE = 24
#: Bytes of text that a task looks at together, and of runs in a block.
TEXT_CHUNK, BLOCK = 4 << 20, 1 << 20
#: Of one text in so many, leads found HOT_TIMES or more, HOT_MOST leads at most.
SAMPLE, HOT_TIMES, HOT_MOST = 64, 48, 100_000

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)
#: Up to so many leads (8 bytes each) that exceed a block are broadcast; beyond, they are joined by a shuffle.
WIDE_SENT = 1_000_000
RUN, LOOP, KNOWN, STRING = 0, 1, 2, 3  # kinds of rows; a loop has its lead at several places


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


LETTER = _mix(np.arange(1, 257, dtype=np.uint64))


class Hashes:
    """Hashes of any piece of some bytes, from sums of letters times powers."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, U(BASE))
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTER[data] * powers[:n], out=self.sums[1:])
        powers[1:] = U(BACK)
        self.back = np.cumprod(powers)

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    have = 1
    while have * 2 <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == span else np.minimum(x[: len(x) - (span - have)], x[span - have :])


def leads(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    """(text, first string, last string, lead, loop) of each run, and the hashes."""
    n, piece = len(data), min(PIECE, length)
    if n < length:
        return None
    h = Hashes(data)
    pieces = h(slice(0, n - piece + 1), slice(piece, n + 1))
    lead = _least(pieces, length - piece + 1)
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts >= length
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    inside = np.cumsum(edge)[: len(lead)] > 0
    new = np.ones(len(lead), bool)
    new[1:] = lead[1:] != lead[:-1]
    new[starts[long]] = True
    new &= inside
    stop = np.ones(len(lead), bool)
    stop[:-1] = ~inside[1:] | new[1:]
    stop &= inside
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    # the lead falls out of the front, and the next string has the same one from elsewhere
    moves = np.concatenate(([0], np.cumsum((pieces[: len(lead)] == lead) & inside & ~stop)))
    return np.searchsorted(ends, first, side="right"), first, last, lead[first], moves[last + 1] > moves[first], h


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at[1:] - at[0]


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about ``most`` bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = _bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _joined(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping spans of a text as one."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    if not len(text):
        return text, start, end
    far = end + text * (1 << 44)  # keeps texts apart, rising over all
    reach = np.maximum.accumulate(far)
    new = np.ones(len(text), bool)
    new[1:] = start[1:] + text[1:] * (1 << 44) > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    return text[at], start[at], reach[last] - text[at] * (1 << 44)


def find_runs(length: int, hot: np.ndarray):
    """For mapInArrow: (none, id, part, text) to rows that meet by ``key``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, 3, TEXT_CHUNK):
            data, ends = _bytes_of(batch.column(3))
            got = leads(data, ends, length)
            if got is None:
                continue
            text, first, last, lead, loop, h = got
            rank = np.empty(batch.num_rows, np.int64)
            keys = pa.Table.from_batches([batch.select([0, 1, 2])])
            rank[pc.sort_indices(keys, [(c, "ascending") for c in keys.column_names]).to_numpy()] = np.arange(batch.num_rows)
            size = last - first + length
            code = h(first, last + length)
            # `first` breaks ties only within a text
            order = np.lexsort((first, rank[text], size, code, lead))
            text, first, last, lead, loop, size, code = (x[order] for x in (text, first, last, lead, loop, size, code))
            again = np.zeros(len(lead), bool)
            again[1:] = (lead[1:] == lead[:-1]) & (code[1:] == code[:-1]) & (size[1:] == size[:-1])
            gone = [(text[again], first[again], last[again] + length)]
            text, first, last, lead, loop, size, code = (x[~again] for x in (text, first, last, lead, loop, size, code))
            many = np.isin(lead, hot)
            rows = [(np.where(loop[~many], LOOP, RUN), lead[~many], code[~many], text[~many], first[~many], size[~many])]
            if many.any():
                count = (last - first + 1)[many]
                t = np.repeat(text[many], count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[many], count)
                whole, led = h(at, at + length), np.repeat(lead[many], count)
                order = np.lexsort((at, rank[t], led, whole))
                t, at, whole, led = t[order], at[order], whole[order], led[order]
                same = np.zeros(len(at), bool)
                same[1:] = (whole[1:] == whole[:-1]) & (led[1:] == led[:-1])
                gone.append((t[same], at[same], at[same] + length))
                t, at, whole, led = t[~same], at[~same], whole[~same], led[~same]
                rows.append((np.full(len(at), STRING), whole, led, t, at, np.full(len(at), length)))
            t, start, end = _joined(*(np.concatenate(x) for x in zip(*gone, strict=True)))
            rows.append((np.full(len(t), KNOWN), _mix(rank[t].astype(np.uint64) * U(BASE) + start.astype(np.uint64)),
                         np.zeros(len(t), np.uint64), t, start, end - start))
            kind, key, code, text, start, size = (np.concatenate(x) for x in zip(*rows, strict=True))
            begin = np.concatenate(([0], ends[:-1]))[text]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(code.view(np.int64)),
                 *[batch.column(c).take(take) for c in range(3)],
                 pa.array((start - begin).astype(np.int64)), pa.array(size.astype(np.int64))],
                names=["key", "kind", "code", "none", "id", "part", "start", "size"],
            )

    return work


def _whole_keys(batches: Iterator[pa.RecordBatch], enough) -> Iterator[pa.Table]:
    """Pieces of sorted rows that end where the key changes, once ``enough`` says so."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if not enough(held):
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1])
        if len(cut):
            yield rows.slice(0, int(cut[-1]) + 1)
            held = rows.slice(int(cut[-1]) + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to spans that are gone, and runs that have to be compared (``ask``).

    A key may have any number of rows: of those before a batch only the last one is known, how many
    different runs its key has had, and the one run that a second would make ask."""
    columns = ["key", "none", "id", "part", "start", "size"]
    last, times, waiting = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, kind, code, size = (batch.column(c).to_numpy() for c in ("key", "kind", "code", "size"))
        sort = np.maximum(kind, LOOP)
        new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = (key[1:] != key[:-1]) | (sort[1:] != sort[:-1])
        new[1:] = new_key[1:] | (code[1:] != code[:-1]) | (size[1:] != size[:-1])
        new_key[0] = last is None or last[:2] != (key[0], sort[0])
        new[0] = new_key[0] or last[2:] != (code[0], size[0])
        group = np.cumsum(new_key) - int(new_key[0])
        different = np.bincount(group, new)
        if not new_key[0]:
            different[0] += times
            if waiting is not None and different[0] > 1:
                yield waiting
        if different[0] > 1 or group[-1] or new_key[0]:
            waiting = None
        ask = new & ((kind == LOOP) | (kind == RUN) & (different[group] > 1))
        out = np.flatnonzero(ask | (~new & (kind != KNOWN)) | (kind == KNOWN))
        told = batch.select(columns).take(pa.array(out))
        yield told.append_column("ask", pa.array(ask[out]))
        last, times = (key[-1], sort[-1], code[-1], size[-1]), different[-1]
        one = np.flatnonzero(new & (group == group[-1]))
        if times == 1 and len(one) and kind[one[0]] == RUN:
            waiting = batch.select(columns).take(pa.array(one)).append_column("ask", pa.array([True]))


def suffix_order(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The rank of each suffix: sorted by 7 symbols, then by twice as many each time.

    With ``depth`` suffixes that agree in so many symbols stay in the order of their places."""
    n = len(symbols)
    code = np.zeros(n, np.int64)
    padded = np.concatenate((symbols, np.zeros(7, np.int64)))
    for j in range(7):
        code = (code << 9) | np.minimum(padded[j : j + n], 511)
    order = np.argsort(code, kind="stable")
    new = np.ones(n, bool)
    new[1:] = code[order][1:] != code[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # ranks leave room for ties
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = first
    left = order[(~new) | np.append(~new[1:], False)]
    step = 7
    while len(left) and (depth is None or step < depth):
        ahead = rank[np.minimum(left + step, n)]
        by = np.lexsort((ahead, rank[left]))
        left, ahead = left[by], ahead[by]
        mine = rank[left]
        start = np.ones(len(left), bool)
        start[1:] = mine[1:] != mine[:-1]
        new = start.copy()
        new[1:] |= ahead[1:] != ahead[:-1]
        at = np.arange(len(left))
        rank[left] = mine + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
        alone = new & np.append(new[1:], True)
        left = left[~alone]
        step *= 2
    if len(left):
        left = left[np.lexsort((left, rank[left]))]
        at = np.arange(len(left))
        start = np.diff(rank[left], prepend=-1) != 0
        rank[left] += at - np.maximum.accumulate(np.where(start, at, 0))
    return rank[:n]


def strings_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(run, place in the bytes, hash) of every string in some runs."""
    size = np.diff(ends, prepend=0)
    strings = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(ends)), strings)
    first = np.arange(len(owner)) + (ends - size - np.cumsum(strings) + strings)[owner]
    return owner, first, Hashes(data)(first, first + length)


def repeated_runs(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Whether a run holds a string that occurs again in the block, by hashes: equal strings have equal ones."""
    owner, _, code = strings_of(data, ends, length)
    order = np.argsort(code)
    twin = code[order][1:] == code[order][:-1]
    again = np.zeros(len(ends), bool)
    again[owner[order[1:][twin]]] = True
    again[owner[order[:-1][twin]]] = True
    return again


def spell_out(length: int):
    """For mapInArrow: (none, id, part, start, key, run) to one row for each different string of some runs,
    its earliest one, and the spans of the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, 5, BLOCK):
            data, ends = _bytes_of(batch.column(5))
            run, at, whole = strings_of(data, ends, length)
            rank = np.empty(batch.num_rows, np.int64)
            places = pa.Table.from_batches([batch.select([0, 1, 2, 3])])
            rank[pc.sort_indices(places, [(c, "ascending") for c in places.column_names]).to_numpy()] = np.arange(batch.num_rows)
            lead = batch.column(4).to_numpy()[run]
            order = np.lexsort((at, rank[run], lead, whole))
            run, at, whole, lead = (x[order] for x in (run, at, whole, lead))
            same = np.zeros(len(run), bool)
            same[1:] = (whole[1:] == whole[:-1]) & (lead[1:] == lead[:-1])
            t, start, end = _joined(run[same], at[same], at[same] + length)
            first = ~same
            run = np.concatenate((run[first], t))
            kind = np.repeat([STRING, KNOWN], [first.sum(), len(t)])
            key = np.concatenate((whole[first], _mix(rank[t].astype(np.uint64) * U(BASE) + start.astype(np.uint64))))
            code = np.concatenate((lead[first], np.zeros(len(t), np.int64)))
            begin = np.diff(ends, prepend=0)
            inside = np.concatenate((at[first], start)) - (ends - begin)[run]
            size = np.concatenate((np.full(first.sum(), length), end - start))
            take = pa.array(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(code.astype(np.int64)),
                 *[batch.column(c).take(take) for c in range(3)],
                 pa.array(batch.column(3).to_numpy()[run] + inside), pa.array(size.astype(np.int64))],
                names=["key", "kind", "code", "none", "id", "part", "start", "size"],
            )

    return work


def prefix_classes(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each place, a number that equal strings of ``length`` symbols from there share.

    Row j of the sorted suffixes begins with a letter c, followed by the suffix in row
    ``after[j]`` (the inverse of the step from a row to the row of its extension by the letter
    before it).  Two neighbours of one letter fall apart at length l + 1 if the suffixes after
    the letter fall apart at length l, that is, lie in different intervals of length l."""
    n = len(symbols)
    row = suffix_order(symbols, length)  # what agrees in so many symbols is never told apart
    place = np.empty(n, np.int64)
    place[row] = np.arange(n)
    after = row[np.minimum(place + 1, n - 1)]
    letter = symbols[place]
    apart = np.ones(n, bool)
    apart[1:] = (letter[1:] != letter[:-1]) | (letter[1:] == 0)
    open_ = np.flatnonzero(~apart)
    for _ in range(1, length):
        if not len(open_):
            break
        interval = np.cumsum(apart, dtype=np.int32)
        split = interval[after[open_]] != interval[after[open_ - 1]]
        apart[open_[split]] = True
        open_ = open_[~split]
    same = np.empty(n, np.int64)
    same[place] = np.cumsum(apart)
    return same


def compare_runs(length: int):
    """For mapInArrow: sorted runs of bytes to spans of strings that an earlier run holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(i, 2_000) for b in batches for i in range(0, b.num_rows, 2_000))
        for rows in _whole_keys(small, lambda held: sum(b.column("run").nbytes for b in held) >= BLOCK):
            runs = rows.column("run").combine_chunks()
            runs = runs.chunk(0) if isinstance(runs, pa.ChunkedArray) else runs
            again = repeated_runs(*_bytes_of(runs), length)
            if not again.any():
                continue
            # the search gets the runs that can lose something
            rows, runs = rows.filter(pa.array(again)), runs.filter(pa.array(again))
            data, ends = _bytes_of(runs)
            size = np.diff(ends, prepend=0)
            owner = np.repeat(np.arange(len(ends)), size)
            symbols = np.zeros(len(data) + len(ends), np.int64)  # a separator after each run
            at = np.arange(len(data)) + owner
            symbols[at] = data.astype(np.int64) + 1
            same = prefix_classes(symbols, length)
            inside = np.arange(len(data)) - (ends - size)[owner]
            whole = inside <= size[owner] - length
            place, run, offset = at[whole], owner[whole], inside[whole]
            # rows come in the order of documents, so the first place of a class is the earliest
            group = same[place]
            order = np.argsort(group, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = group[order][1:] != group[order][:-1]
            late = np.zeros(len(order), bool)
            late[order] = ~new
            run, start, end = _joined(run[late], offset[late], offset[late] + length)
            told = rows.select(["none", "id", "part"]).take(pa.array(run))
            begin = rows.column("start").to_numpy()[run]
            told = told.append_column("start", pa.array(begin + start)).append_column("size", pa.array(end - start))
            yield from told.combine_chunks().to_batches()

    return work


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, sample: int = SAMPLE,
    hot_times: int = HOT_TIMES, block: int = BLOCK, wide_sent: int = WIDE_SENT,
) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, spans (start, end) and kept (binary).

    A string counts as earlier in a smaller id, null ids last, or earlier in the same text.  Rows
    that repeat an id are ordered by a hash of their text, and rows equal in both are one
    document.  Null and empty texts, and texts below ``length`` bytes, lose nothing.  An empty table gives
    an empty result.  Columns of ``docs`` named like new ones are replaced."""
    space = Workspace(docs.sparkSession)
    ids = docs.groupBy(named(id_col)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    text = full(named(text_col))
    repeated = not ids.isEmpty()
    part = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    texts = docs.select(ordered(named(id_col)).alias("doc"), part.alias("part"), text.alias("text"))
    if repeated:
        texts = texts.dropDuplicates(["doc", "part"])
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    doc = f"none boolean, id {kind}, part long"
    flat = texts.select("doc.none", "doc.id", "part", "text")

    def count_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, 0, TEXT_CHUNK):
            got = leads(*_bytes_of(batch.column(0)), length)
            if got is not None:
                lead, times = np.unique(got[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(times)], names=["lead", "n"])

    some = flat.filter(F.pmod(F.xxhash64("id", "part"), F.lit(sample)) == 0).select("text")
    found = some.mapInArrow(count_leads, "lead long, n long").groupBy("lead").agg(F.sum("n").alias("n"))
    found = found.filter(F.col("n") >= hot_times).orderBy(F.desc("n"), "lead").limit(HOT_MOST)
    hot = np.array([r["lead"] for r in found.collect()], dtype=np.int64).view(np.uint64)
    met = f"key long, kind int, code long, {doc}, start long, size long"

    def decided(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("key").sortWithinPartitions("key", "kind", "code", "size", "none", "id", "part", "start")
        return rows.mapInArrow(decide, f"key long, {doc}, start long, size long, ask boolean")

    told = space.stored(decided(flat.mapInArrow(find_runs(length, hot), met)), "runs")
    asks = told.filter("ask")
    wide = asks.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > block)
    wide = space.stored(wide.select(F.col("key").alias("wide")), "wide")
    n_wide = wide.count()
    if n_wide:
        asks = asks.join(F.broadcast(wide) if n_wide <= wide_sent else wide, F.col("key") == F.col("wide"), "left")
    else:
        asks = asks.withColumn("wide", F.lit(None).cast("long"))
    asked = asks.groupBy(F.struct("none", "id").alias("of_"), F.col("part").alias("its_")).agg(
        F.collect_list(F.struct("key", "wide", "start", "size")).alias("asks")
    )
    here = (F.col("doc") == F.col("of_")) & (F.col("part") == F.col("its_"))
    runs = texts.join(asked, here).select(
        "doc.none", "doc.id", "part", F.col("text").cast("binary").alias("text"), F.explode("asks").alias("a")
    )
    cut = F.substring(F.col("text"), (F.col("a.start") + 1).cast("int"), F.col("a.size").cast("int"))
    runs = runs.select("none", "id", "part", "a.start", "a.key", cut.alias("run"), "a.wide")
    spelled = None
    if n_wide:
        runs = space.stored(runs, "asked")
        spelled = decided(runs.filter("wide IS NOT NULL").drop("wide").mapInArrow(spell_out(length), met))
    runs = runs.filter("wide IS NULL").drop("wide").repartition("key").sortWithinPartitions("key", "none", "id", "part", "start")
    late = runs.mapInArrow(compare_runs(length), f"{doc}, start long, size long")
    gone = told.filter("NOT ask").select("none", "id", "part", "start", "size").unionByName(late)
    if spelled is not None:
        gone = gone.unionByName(spelled.select("none", "id", "part", "start", "size"))
    gone = gone.groupBy(F.struct("none", "id").alias("of_"), F.col("part").alias("its_")).agg(
        F.collect_list(F.struct("start", "size")).alias("gone_")
    )

    @F.pandas_udf("struct<n_removed: long, spans: array<struct<start: long, end: long>>, kept: binary>")
    def kept(texts, spans):
        import pandas as pd

        out = []
        for data, places in zip(texts, spans, strict=True):
            if places is None or not len(places):
                out.append((0, [], data))
                continue
            start = np.array([p["start"] for p in places])
            end = start + np.array([p["size"] for p in places])
            _, start, end = _joined(np.zeros(len(start), np.int64), start, end)
            edges = [0, *np.column_stack((start, end)).ravel().tolist(), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((int((end - start).sum()), [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())], left))
        return pd.DataFrame(out, columns=["n_removed", "spans", "kept"])

    whole = docs.withColumns({"doc_": ordered(named(id_col)), "part_": part, "bytes_": text.cast("binary")})
    whole = whole.join(gone, (F.col("doc_") == F.col("of_")) & (F.col("part_") == F.col("its_")), "left")
    whole = whole.withColumn("r_", kept("bytes_", "gone_")).withColumns({
        "n_bytes": F.octet_length("bytes_").cast("long"), "n_removed": F.col("r_.n_removed"),
        "spans": F.col("r_.spans"), "kept": F.col("r_.kept"),
    })
    return whole.drop("doc_", "part_", "bytes_", "of_", "its_", "gone_", "r_")
