"""Same or nearly same records across splits, with their overlap in content-defined chunks.

Pairs across splits are found by the word prefixes of setjoin, which lose none,
and compared exactly. Each record of a pair is then cut by a rolling hash over
its normalised words, so that an edit changes only the chunks around it; the
digests of the chunks of the two are joined, and the lengths of the shared ones
are summed to the part of either record that the other has. Chunks can't find
the pairs themselves: near records need not share any (see the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.words import hashed, words
from ticketloom.llm.setjoin import EMITTED, candidates, compared, distinct_sets, frequency_sketch, near, record_sets, rows_in_slices, word_prefixes
from ticketloom.session import discard, written

#: Words that the rolling hash looks at, and one place in so many is a cut.
WINDOW = 2
EVERY = 3
#: Multiplier of the rolling hash.
ROLL = 6364136223846793005
OVERLAPS = "record_id_a bigint, record_id_b bigint, jaccard double, overlap_a double, overlap_b double"


def cut(flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of sequences of word hashes (start: where each begins, none empty): digest, place of the first word, words."""
    first = np.zeros(len(flat), bool)
    first[start] = True
    with np.errstate(over="ignore"):
        x = flat.view(np.uint64)
        rolled = x.copy()
        for k in range(1, WINDOW):
            rolled[k:] = rolled[k:] * np.uint64(ROLL) + x[:-k]
        rolled ^= rolled >> np.uint64(31)
        ends = (rolled * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(EVERY) == 0
        #: A place with less than a window before it in its sequence is none.
        place = np.arange(len(flat)) - np.repeat(start, np.diff(np.concatenate([start, [len(flat)]])))
        ends &= place >= WINDOW - 1
        ends[np.concatenate([start[1:], [len(flat)]]) - 1] = True
        begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
        size = np.diff(np.concatenate([begin, [len(flat)]]))
        power = np.full(int(size.max()), ROLL, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        value = np.add.reduceat(x * power[np.arange(len(flat)) - np.repeat(begin, size)], begin)
        value ^= value >> np.uint64(29)
        value = value * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
    return (value ^ (value >> np.uint64(32))).view(np.int64), begin, size


def shared_parts(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the part of a's words in chunks that b has too, and of b's in chunks of a; no sequence is empty."""
    digest, row, size, side = [], [], [], []
    whole = []
    for k, x in enumerate((a, b)):
        n = np.asarray(x.value_lengths(), np.int64)
        flat = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False))
        d, begin, s = cut(flat, np.cumsum(n) - n)
        whole.append(n)
        digest.append(d)
        size.append(s)
        row.append(np.repeat(np.arange(len(n)), n)[begin])
        side.append(np.full(len(d), k))
    d, r, s, k = (np.concatenate(x) for x in (digest, row, size, side))
    order = np.lexsort((d, r))
    d, r, s, k = d[order], r[order], s[order], k[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])
    group = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    both = (np.minimum.reduceat(k, begins) != np.maximum.reduceat(k, begins))[group]
    return tuple(np.bincount(r[both & (k == i)], s[both & (k == i)], minlength=len(whole[i])) / whole[i] for i in (0, 1))  # type: ignore[return-value]


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_in_slices(batches, 4096):
        if b.num_rows:
            parts = shared_parts(b.column("wa"), b.column("wb"))
            yield pa.RecordBatch.from_arrays([b.column("record_id_a"), b.column("record_id_b"), b.column("jaccard"), *map(pa.array, parts)], names=[c.split()[0] for c in OVERLAPS.split(", ")])


def chunk_overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (record_id_a, record_id_b, jaccard) with the part of either record in chunks of the other; texts: id, text."""
    ends = pairs.select(F.explode(F.array("record_id_a", "record_id_b")).alias("id")).distinct()
    found = texts.join(ends, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).select("id", hashed(words(F.col("text"))).alias("w"))
    side = lambda x: found.select(F.col("id").alias("record_id_" + x), F.col("w").alias("w" + x))
    return pairs.join(side("a"), "record_id_a").join(side("b"), "record_id_b").mapInArrow(_overlaps, OVERLAPS)


def cross_split_pairs(
    records: DataFrame, splits: DataFrame, id_col: str = "record_id", key_col: str = "source_row_id", text_col: str = "text_clean",
    split_col: str = "split", training: tuple[str, ...] = ("training",), evaluation: tuple[str, ...] = ("validation", "holdout"), threshold: float = 0.7,
) -> DataFrame:
    """(record_id_a, record_id_b, jaccard, overlap_a, overlap_b): near pairs with one record in training and one in evaluation, a < b, once each.

    Exact: no pair is lost. jaccard is that of the distinct words; overlap_a
    the part of a's words that stand in chunks which b has too, overlap_b the
    same the other way round (1 for equal sequences of words).
    Records without a split, with a null key or id or without words are in no
    pair; rows of splits that come twice count once; empty tables give none.
    Of an id with several texts all are compared, and the chunks are those of
    the first in order. Equal records are one record until the end, so a hot
    text costs its pairs of the result and nothing else. Other columns of
    either table are ignored.
    """
    role = F.when(F.col(split_col).isin(*training), 1).when(F.col(split_col).isin(*evaluation), 2)
    of = splits.select(F.col(key_col).alias("k"), role.alias("role")).where("k is not null and role is not null").distinct()
    of = of.groupBy("k").agg(F.bit_or("role").alias("role"))
    named = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(key_col).alias("k"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = record_sets(named.join(of, "k").select("id", "role", "text"), "id", "text", "role").where(F.size("t") > 0).persist(StorageLevel.MEMORY_AND_DISK)
    sets = distinct_sets(rows, F.bit_or("role").alias("role")).drop("rep", "cnt").persist(StorageLevel.MEMORY_AND_DISK)
    spark = records.sparkSession
    sketch = spark.sparkContext.broadcast(frequency_sketch(sets.select(F.explode("t").alias("w")), "w"))
    emitted = sets.select("h1", "h2", "t", "role").mapInArrow(word_prefixes(sketch, threshold), EMITTED)
    found = compared(candidates(emitted, threshold, apart=True), sets, "h1", "h2", "role").where(near(threshold))
    found = written(found.select("h1_a", "h2_a", "h1_b", "h2_b", "role_a", "role_b", (F.col("both") / F.col("n")).alias("jaccard")), "near")
    one = lambda t, e: found.where(F.col(f"role_{t}").bitwiseAND(1) > 0).where(F.col(f"role_{e}").bitwiseAND(2) > 0).select(*[F.col(f"h{k}_{x}").alias(f"{y}{k}") for x, y in ((t, "t"), (e, "e")) for k in (1, 2)], "jaccard")
    same = sets.where("role = 3").select(*[F.col(f"h{k}").alias(f"{y}{k}") for y in "te" for k in (1, 2)], F.lit(1.0).alias("jaccard"))
    way = one("a", "b").unionByName(one("b", "a")).unionByName(same)
    members = lambda bit, x: rows.where(F.col("role").bitwiseAND(bit) > 0).select(F.col("h1").alias(x + "1"), F.col("h2").alias(x + "2"), F.col("id").alias("id_" + x))
    pairs = way.join(members(1, "t"), ["t1", "t2"]).join(members(2, "e"), ["e1", "e2"]).where("id_t <> id_e")
    pairs = written(pairs.groupBy(F.least("id_t", "id_e").alias("record_id_a"), F.greatest("id_t", "id_e").alias("record_id_b")).agg(F.max("jaccard").alias("jaccard")), "pairs")
    sets.unpersist()
    rows.unpersist()
    out = written(chunk_overlaps(pairs, named.select("id", F.col("text").cast("string").alias("text"))), "overlaps")
    discard(found)
    discard(pairs)
    return out
