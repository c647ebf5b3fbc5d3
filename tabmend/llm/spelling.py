"""Spelling variants: words one letter apart, found by PartEnum signatures of their letters.

A word's letters are a multiset, that is a binary vector with one place for each (letter, how many
before).  One inserted, deleted or replaced letter changes at most two places.  PartEnum turns that
distance into equality: the places are dealt into ``first`` groups, of which one differs in at most
``2 // first`` places, and each group into ``second`` parts; leaving out as many parts as may differ, in
every way, gives signatures of which near words share at least one.

Letters say nothing of order, so each signature is taken together with one half of the word: an edit
leaves the first or the last half alone.  A half is counted for the shorter word of a pair, so a word has the
halves for its own length and for that of a word one letter shorter.  Words that share a signature are
joined, and pairs are kept if the vectors are at distance two or less and the words one edit apart.

A word's form is its most frequent near word if that is at least twice as frequent; forms are followed to
their root by pointer jumping, so chains of any length settle in a logarithmic number of rounds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import UPPER, Workspace, full, named, shipped

shipped(__name__)

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_TIMES, RATIO = 5, 3, 2
#: One word of a document in so many loses a letter (0: none).
SLIPS = 97
#: Groups and parts of PartEnum.  On the 764,000 words of 0.5 GB of text (1, 4) leaves half the candidates of (3, 1)
#: and a quarter of those of (2, 3) or (2, 2).
FIRST, SECOND = 1, 4
DISTANCE = 2  # places that one edit changes at most

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_of(id_: Column, run: Column, slips: int) -> Column:
    """The run, or the run without one letter, as the checksum of ``<id>:<run>`` says."""
    if not slips:
        return run
    h = F.crc32(F.encode(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % slips == 0, shorter).otherwise(run)


def vocabulary(
    docs: DataFrame, id_col: str, text_col: str, slips: int = SLIPS, min_letters: int = MIN_LETTERS, min_times: int = MIN_TIMES
) -> DataFrame:
    """(word, n): words of enough letters that occur often enough, over all texts."""
    text = F.translate(full(named(text_col)), UPPER, UPPER.lower())
    runs = docs.select(
        named(id_col).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")
    )
    words = runs.select(word_of(F.col("id"), F.col("run"), slips).alias("word"))
    words = words.filter(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_times)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after another, and the length of each word."""
    texts = words.to_pylist()
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), size


def _places(code: np.ndarray, owner: np.ndarray, first: int, second: int) -> tuple[np.ndarray, ...]:
    """(hash, group, part) of each letter's place: the letter and how many equal ones come before it."""
    order = np.lexsort((np.arange(len(code)), code, owner))
    new = np.ones(len(code), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    before = np.empty(len(code), np.uint64)
    where = np.arange(len(code))
    before[order] = where - np.maximum.accumulate(np.where(new, where, 0))
    dealt = ((code * U(7) + before * U(3)) % U(first * second)).astype(np.int64)
    return _mix(code * U(65_537) + before + U(1)), dealt % first, dealt // first


def signatures(words: pa.Array, first: int = FIRST, second: int = SECOND) -> tuple[np.ndarray, ...]:
    """(word, length, key) of all signatures, and a mask for each word of which at most two bits differ for near words."""
    code, size = _letters(words)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    begin = np.cumsum(size) - size
    place, group, part = _places(code, owner, first, second)
    sums = np.zeros((n, first, second), np.uint64)
    np.add.at(sums, (owner, group, part), place)
    mask = np.zeros(n, np.uint64)
    np.bitwise_xor.at(mask, owner, U(1) << (place & U(63)))
    # hashes of halves from sums over letters times their places, counted from the end that is kept
    inside = np.arange(len(code)) - begin[owner]
    told = []
    for length in (size, size - 1):
        half = length // 2
        heads, tails = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        head = inside < half[owner]
        np.add.at(heads, owner[head], _mix(code[head] * U(256) + inside[head].astype(np.uint64)))
        back = size[owner] - 1 - inside
        tail = back < (length - half)[owner]
        np.add.at(tails, owner[tail], _mix(code[tail] * U(256) + back[tail].astype(np.uint64)))
        for side, hashed in enumerate((heads, tails)):
            told.append((length, _mix(hashed + _mix(length.astype(np.uint64) * U(2) + U(side)))))
    out: list[tuple[np.ndarray, ...]] = []
    some = second - DISTANCE // first
    for g in range(first):
        for number, parts in enumerate(itertools.combinations(range(second), max(some, 0))):
            picked = sums[:, g, list(parts)].sum(axis=1, dtype=np.uint64) + U(g * 4096 + number)
            for length, half in told:
                out.append((np.arange(n), length, _mix(_mix(picked) * U(0x9E3779B97F4A7C15) + half)))
    word, length, key = (np.concatenate(x) for x in zip(*out, strict=True))
    return word, length, key.view(np.int64), mask.view(np.int64)


def signed(words: DataFrame, first: int, second: int) -> DataFrame:
    """(key, longer, mask, word, n): the rows of words that meet by ``key``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                word, length, key, mask = signatures(part.column(0), first, second)
                size = np.array([len(t) for t in part.column(0).to_pylist()])
                take = pa.array(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(length < size[word]), pa.array(mask[word]), part.column(0).take(take), part.column(1).take(take)],
                    names=["key", "longer", "mask", "word", "n"],
                )

    return words.mapInArrow(work, "key long, longer boolean, mask long, word string, n long")


def near_words(words: DataFrame, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """(word, n, other, m): the pairs of ``words`` (word, n) one edit apart, each once.

    Of a pair ``word`` is the shorter, of equal lengths the smaller."""
    rows = signed(words, first, second)
    short = rows.filter("NOT longer").drop("longer")
    other = rows.select(*[F.col(c).alias(f"{c}_") for c in rows.columns])
    near = short.join(
        other,
        (F.col("key") == F.col("key_"))
        & (F.col("longer_") | (F.col("word") < F.col("word_")))
        & (F.bit_count(F.col("mask").bitwiseXOR(F.col("mask_"))) <= DISTANCE)
        & (F.levenshtein(F.col("word"), F.col("word_"), 1) == 1),
    )
    return near.select("word", "n", F.col("word_").alias("other"), F.col("n_").alias("m")).distinct()


def followed(forms: DataFrame, space: Workspace) -> DataFrame:
    """(word, root) of words with a form (word, form): each round doubles the way looked ahead.

    Frequencies rise along forms, so there are no cycles, and the rounds end."""
    now = space.stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("on")), "roots")
    while not now.filter("on").isEmpty():
        ahead = now.select(F.col("word").alias("at_"), F.col("root").alias("to_"))
        now = now.join(ahead, F.col("root") == F.col("at_"), "left").select(
            "word", F.coalesce("to_", "root").alias("root"), F.col("to_").isNotNull().alias("on")
        )
        now = space.stored(now, "roots")
    return now.select("word", "root")


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slips: int = SLIPS,
    min_letters: int = MIN_LETTERS,
    min_times: int = MIN_TIMES,
    ratio: int = RATIO,
    first: int = FIRST,
    second: int = SECOND,
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters with only A-Z lower-cased; one in ``slips`` of a document's words loses
    a letter by a fixed rule (a null id is empty text there).  A word needs ``min_letters`` letters and
    ``min_times`` occurrences over all texts.  Null and empty texts have no words, rows that repeat count each
    time, and an empty table gives no rows.  The form is the near word of largest n, of equals the smaller, and
    only if it is ``ratio`` times as frequent (2 at least); root is the word at the end of the forms, the word itself without
    one."""
    if ratio < 2 or min_letters < 2:
        raise ValueError("forms need a ratio of 2, words two letters")
    space = Workspace(docs.sparkSession)
    words = space.stored(vocabulary(docs, id_col, text_col, slips, min_letters, min_times), "words")
    near = space.stored(near_words(words, first, second), "near")
    both = near.unionByName(near.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    told = both.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))).alias("most")
    )
    frequent = -F.col("most.less") >= F.lit(ratio) * F.col("n")
    told = space.stored(
        told.select("word", "n_near", F.when(frequent, F.col("most.form")).alias("form"), F.when(frequent, -F.col("most.less")).alias("form_n")),
        "forms",
    )
    roots = followed(told.filter("form IS NOT NULL").select("word", "form"), space).withColumnRenamed("word", "of_")
    told = told.join(roots, F.col("word") == F.col("of_"), "left").drop("of_").withColumnRenamed("word", "w_")
    return words.join(told, F.col("word") == F.col("w_"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
