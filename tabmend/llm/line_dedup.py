"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of rising ids, cut at quantiles of numbers and at splitters of a sample of other ids.  A run is a table of (line hash, first document),
partitioned and sorted by hash, and no hash is in two runs.  A batch reduces its lines to
one row per hash, anti-joins them with the runs by merging, and adds the rest as a new run of
level 0.  Where a level holds ``fanout`` runs, they are compacted into one run of the next
level, so a batch meets few runs.  Once all batches are in, a line goes if its hash has
another first document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tabmend.llm.common import SPACE, UPPER, Workspace, full, named, ordered

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
SPLITTERS = 250


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, part, pos, h): a 128-bit hash for each line whose key is long enough.

    ``part`` tells apart texts that share an id."""
    text = full(named(text_col))
    lines = docs.select(
        ordered(named(id_col)).alias("doc"),
        F.xxhash64(text).alias("part"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    lines = lines.select("doc", "part", "pos", line_key(F.col("line")).alias("key"))
    return lines.filter(F.char_length("key") >= min_chars).select(
        "doc", "part", "pos", F.unhex(F.md5("key")).alias("h")
    )


class LineRuns:
    """The runs, by level."""

    def __init__(self, spark: SparkSession, space: Workspace, fanout: int = FANOUT):
        self.spark, self.space, self.fanout, self.levels = spark, space, fanout, [[]]

    def runs(self) -> DataFrame | None:
        every = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, every) if every else None

    def add(self, lines: DataFrame) -> None:
        """Takes the lines of one batch; ids must not be smaller than those before."""
        fresh = lines.groupBy("h").agg(F.min("doc").alias("first"))  # summed up before the shuffle
        seen = self.runs()
        if seen is not None:
            fresh = fresh.hint("merge").join(seen.select("h"), "h", "left_anti")
        self._write(0, fresh)

    def _write(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        run = run.select("h", "first").repartition("h").sortWithinPartitions("h")
        self.levels[level].append(self.space.stored(run, f"run-{level}"))
        if len(self.levels[level]) == self.fanout:
            together = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._write(level + 1, together)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and ``n_lines`` and ``n_dropped``.

    A null or empty text is one empty line and stays as it is.  Null ids come after all others and are one
    document, as are rows that repeat an id: lines shared only by them stay.  A line that a
    document repeats stays or goes with all its copies.  An empty table gives an empty
    result.  Columns of ``docs`` named like the two new ones are replaced."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    lines = space.stored(line_hashes(docs, id_col, text_col, min_chars), "lines")
    runs = LineRuns(spark, space, fanout)
    for low, high in _ranges(docs, id_col, batches):
        key = F.col("doc.id")
        part = lines
        if low is not None:
            part = part.filter((key > low) | F.col("doc.none"))
        if high is not None:
            part = part.filter(key <= high)
        runs.add(part)
    first = runs.runs()
    # one row of the runs to a hash: a hash of many lines is split over tasks
    gone = lines.hint("merge").join(first, "h").filter(F.col("doc") != F.col("first"))
    gone = gone.groupBy("doc", "part").agg(F.collect_set("pos").alias("gone_"))
    text = full(named(text_col))
    left = docs.withColumns({"doc_": ordered(named(id_col)), "part_": F.xxhash64(text)})
    both = left.join(
        gone.select(F.col("doc").alias("of_"), F.col("part").alias("its_"), "gone_"),
        (F.col("doc_") == F.col("of_")) & (F.col("part_") == F.col("its_")),
        "left",
    )
    both = both.withColumns({"lines_": F.split(text, "\n", -1), "gone_": F.coalesce("gone_", F.array().cast("array<int>"))})
    both = both.withColumns(
        {"n_lines": F.size("lines_").cast("long"), "n_dropped": F.size("gone_").cast("long"),
         "stay_": F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), F.col("gone_"))}
    )
    kept = F.array_join(F.transform("stay_", lambda i: F.get(F.col("lines_"), i)), "\n")
    both = both.withColumn(text_col, F.when(F.col("n_dropped") > 0, kept).otherwise(named(text_col)))
    return both.drop("doc_", "part_", "of_", "its_", "gone_", "lines_", "stay_")


def _ranges(docs: DataFrame, id_col: str, batches: int) -> list[tuple]:
    """(above, up to) of each batch's ids, about evenly; ids that are neither numbers nor text: one batch.

    Where the cuts lie changes the sizes of batches, never the result.  Text is cut at splitters
    among the ids with the smallest hashes, at most ``SPLITTERS`` to a batch."""
    key = named(id_col)
    kind = docs.select(key).schema[0].dataType
    if batches < 2 or not isinstance(kind, (NumericType, StringType)):
        return [(None, None)]
    shares = [k / batches for k in range(1, batches)]
    if isinstance(kind, NumericType):
        cuts = docs.select(F.percentile_approx(key, shares, 1000).alias("c")).first()["c"] or []
    else:
        ids = docs.select(key.alias("id")).filter("id IS NOT NULL").distinct()
        few = ids.orderBy(F.xxhash64("id"), "id").limit(SPLITTERS * batches).collect()
        sample = sorted(r["id"] for r in few)  # in the order of code points, as Spark compares
        cuts = [sample[int(len(sample) * share)] for share in shares] if sample else []
    cuts = sorted(set(cuts))
    return list(zip([None, *cuts], [*cuts, None], strict=True))
