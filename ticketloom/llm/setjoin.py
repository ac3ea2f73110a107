"""Exact similarity self-join of word sets at a Jaccard threshold.

Prefixes under three orders of the words filter the candidates before any
pair is verified. Under order 1 (rare words first, by a fixed-size frequency
sketch) two sets that reach the threshold share at least one word of their
prefixes, at least two of prefixes longer by one, and so on; groups that are
large under the first shared word are therefore split by the second and third
shared word. Orders 2 and 3 are by two other hashes; the words of their
prefixes are kept as 32 bits each, and where these don't meet, no word of the
prefixes is shared. Besides, 64-bit parities of the words in either half of
the hash space bound the difference of two sets from below. A pair must pass
all three orders, this bound, the size and the position filter before its
word sets are compared. All filters are necessary conditions, so no pair is
lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.words import digest, hashed, words
from ticketloom.operators.components import connected_components
from ticketloom.session import written

#: Counters of the frequency sketch: 4 MB in every process whatever the input.
SKETCH_BITS = 22
#: A group of more than this many sets is split by its next shared word.
SMALL_GROUP = 32
#: In a group of so many sets of which most may be near one, only the links to that one are looked at first.
DENSE = 1024
#: A word in more sets than this is shuffled by word pairs, so that no task gets all its sets.
HOT_WORD = 1 << 17

#: Multipliers of the hashes by which orders 2 and 3 sort, and of the one that chooses a word's bit.
ORDERS = (-7046029254386353131, -4417276706812531889)
BIT = 1609587929392839161

#: g: the shared word; h1, h2: the set; n: its words; pos: words before g under order 1; room: words from g to the end of the prefix;
#: p2, p3: bits of the prefixes under orders 2 and 3; o1, o2: parities; sfx: 32 bits of each word after g.
EMITTED = "g bigint, h1 bigint, h2 bigint, n int, pos int, room int, p2 int, p3 int, o1 bigint, o2 bigint, role int, sfx binary"
COLUMNS = [c.split()[0] for c in EMITTED.split(", ")]
PAIRS = "a1 bigint, a2 bigint, b1 bigint, b2 bigint, star int"


def record_sets(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, h1, h2, t, keep): the distinct words of each text as hashes and 128 bits for the set. Rows with a null id are left out."""
    t = F.array_sort(F.array_distinct(hashed(words(F.col(text_col)))))
    base = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), t.alias("t"), *keep)
    h1, h2 = digest(F.col("t"))
    return base.select("id", h1.alias("h1"), h2.alias("h2"), "t", *keep)


def distinct_sets(records: DataFrame, *more) -> DataFrame:
    """One row per set that has words: (h1, h2, t, rep, cnt); rep is its smallest id. Copies are combined before the shuffle."""
    return records.where(F.size("t") > 0).groupBy("h1", "h2").agg(F.first("t").alias("t"), F.min("id").alias("rep"), F.count("*").alias("cnt"), *more)


def frequency_sketch(hashes: DataFrame, column: str) -> bytes:
    """Counts of hashes in 2**SKETCH_BITS counters, as 8 times their binary logarithm; 0: seen once at most."""
    mask = (1 << SKETCH_BITS) - 1
    counted = hashes.select(F.col(column).bitwiseAND(F.lit(mask)).cast("int").alias("k")).groupBy("k").count()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    rows = counted.where("count > 1").select("k", F.least(F.round(8 * F.log2("count")), F.lit(255)).cast("int").alias("q")).toArrow()
    out[rows["k"].to_numpy()] = rows["q"].to_numpy().astype(np.uint8)
    return out.tobytes()


def _alpha(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def _prefix(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _depth(t: float) -> int:
    """So many words are shared by any two different sets at the threshold, three at most."""
    return 3 if t >= 1 else max(1, min(3, math.ceil(t / (1 - t) - 1e-9)))


def parities(flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per list of hashes (start: where each begins, none empty), one parity word for either half of the hash space."""
    bit = np.uint64(1) << ((flat >> 40) & 63).astype(np.uint64)
    half = (flat >> 46) & 1 == 1
    return tuple(np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), start).view(np.int64) for x in (half, ~half))  # type: ignore[return-value]


def prefix_bits(flat: np.ndarray, row: np.ndarray, start: np.ndarray, prefix: np.ndarray, order: int) -> np.ndarray:
    """Per list of hashes, 32 bits of the words in its prefix under an order by hash."""
    with np.errstate(over="ignore"):
        by = np.lexsort((flat * np.int64(order), row))
        bit = np.uint32(1) << ((flat[by] * np.int64(BIT)).view(np.uint64) >> np.uint64(59)).astype(np.uint32)
    inside = np.arange(len(flat)) - start[row] < prefix[row]
    return np.bitwise_or.reduceat(np.where(inside, bit, np.uint32(0)), start).view(np.int32)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All starts[i] .. starts[i] + counts[i] - 1, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def binary_column(words32: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words32.astype(np.uint32).tobytes())])


def rows_in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _emitter(sketch, t: float):
    depth = _depth(t)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = np.frombuffer(sketch.value, np.uint8)
        mask = (1 << SKETCH_BITS) - 1
        hot = min(255, round(8 * math.log2(HOT_WORD)))
        for b in rows_in_slices(batches, 4096):
            lists = b.column("t")
            n = np.asarray(lists.value_lengths(), np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(n)), n)
            q = rarity[flat & mask]
            order = np.lexsort((flat, row * 256 + q))
            flat, q = flat[order], q[order]
            start = np.cumsum(n) - n
            pos = np.arange(len(flat)) - start[row]
            prefix = _prefix(n, t)
            bits = [prefix_bits(flat, row, start, prefix, o) for o in ORDERS] + list(parities(flat, start))
            #: In the suffix are the words that can be the second or third one shared.
            last = np.minimum(n, prefix + depth - 1)
            first = np.flatnonzero((pos < prefix[row]) & (q > 0) & ~((q > hot) & (depth > 1)))
            key, at, own = flat[first], first, pos[first]
            lots = np.flatnonzero((pos < prefix[row]) & (q > hot) & (depth > 1))
            if len(lots):
                r = row[lots]
                many = np.minimum(prefix[r] - pos[lots], n[r] - 1 - pos[lots])
                second = ragged(lots + 1, many)
                lots = np.repeat(lots, many)
                key = np.concatenate([key, flat[lots] * np.int64(-7046029254386353131) + flat[second]])
                at, own = np.concatenate([at, second]), np.concatenate([own, pos[lots]])
            r = row[at]
            left = np.maximum(0, start[r] + last[r] - at - 1)
            words32 = flat[ragged(at + 1, left)] & 0xFFFFFFFF
            role = b.column("role").to_numpy()[r] if "role" in b.schema.names else np.zeros(len(r))
            ints = [pa.array(x.astype(np.int32)) for x in (n[r], own, prefix[r] - pos[at])]
            out = [pa.array(key), b.column("h1").take(pa.array(r)), b.column("h2").take(pa.array(r)), *ints, *[pa.array(x[r]) for x in bits], pa.array(role.astype(np.int32)), binary_column(words32, left)]
            yield pa.RecordBatch.from_arrays(out, names=COLUMNS)

    return emit


def word_prefixes(sketch, t: float):
    """What candidates() reads: the prefixes of word sets, without loss; sketch: a broadcast frequency_sketch of their words."""
    return _emitter(sketch, t)


class Group:
    """Columns of the sets in one or more whole groups."""

    def __init__(self, b: pa.Table | pa.RecordBatch):
        for c in COLUMNS[:-1]:
            setattr(self, c, b.column(c).to_numpy())
        self.n = self.n.astype(np.int64)
        self.o1, self.o2 = self.o1.view(np.uint64), self.o2.view(np.uint64)
        sfx = b.column("sfx")
        sfx = sfx.combine_chunks() if isinstance(sfx, pa.ChunkedArray) else sfx
        sfx = sfx.chunk(0) if isinstance(sfx, pa.ChunkedArray) else sfx
        offsets = np.frombuffer(sfx.buffers()[1], np.int32)[sfx.offset : sfx.offset + len(sfx) + 1].astype(np.int64)
        data = sfx.buffers()[2]
        self.sfx = np.frombuffer(data, np.uint32) if data is not None and data.size else np.zeros(0, np.uint32)
        self.lo, self.hi = offsets[:-1] // 4, offsets[1:] // 4


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.concatenate([begin, [len(keys)]]))


def _pass(x: Group, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of rows pass orders 2 and 3, the parities, the size and the position filter."""
    ni, nj = x.n[i], x.n[j]
    alpha = _alpha(ni, nj, t)
    shared = ((x.p2[i] & x.p2[j]) != 0) & ((x.p3[i] & x.p3[j]) != 0)
    far = np.bitwise_count(x.o1[i] ^ x.o1[j]).astype(np.int64) + np.bitwise_count(x.o2[i] ^ x.o2[j])
    ok = shared & (far <= ni + nj - 2 * alpha) & (np.minimum(ni, nj) >= t * np.maximum(ni, nj) - 1e-9)
    return ok & (np.minimum(ni - x.pos[i], nj - x.pos[j]) >= alpha)


def _within(x: Group, rows: np.ndarray, begin: np.ndarray, size: np.ndarray, t: float, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in the runs that pass every filter."""
    end = np.repeat(begin + size, size)
    active = ragged(begin, size)
    k = 1
    while True:
        keep = active + k < end
        active, end = active[keep], end[keep]
        if not len(active):
            return
        i, j = rows[active], rows[active + k]
        if apart:
            roles = (x.role[i] | x.role[j]) == 3
            i, j = i[roles], j[roles]
        ok = _pass(x, i, j, t)
        if ok.any():
            yield i[ok], j[ok]
        k += 1


def _dense(x: Group, run: np.ndarray, t: float, only: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]] | None:
    """(links to one set, other pairs) of a large run, or None if few of its sets may be near that one.

    Pairs of two sets that both may be near the one are left out: if both are,
    they are in its group. With only, all pairs of rows whose role is 3.
    """
    if only:
        rest = run[x.role[run] == 3]
        star: list[tuple[np.ndarray, np.ndarray]] = []
    else:
        one = run[np.argmin(x.h1[run])]
        others = run[run != one]
        near = _pass(x, np.full(len(others), one), others, t)
        if near.sum() * 2 < len(others):
            return None
        star, rest = [(np.full(int(near.sum()), one), others[near])], others[~near]
    pairs = []
    for r in rest:
        i = np.full(len(run), r)
        ok = _pass(x, i, run, t) & (run != r)
        if ok.any():
            pairs.append((i[ok], run[ok]))
    return star, pairs


def group_pairs(x: Group, t: float, apart: bool = False, dense: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs among the sets of each group, by row, and which are links to one set of a dense group.

    Large groups are split by the next shared word; if partners need to share
    no more than level words, sets are compared before the split, with all
    that are not much larger.
    """
    depth = _depth(t)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stars: list[tuple[np.ndarray, np.ndarray]] = []
    rows, keys, at, level = np.arange(len(x.g)), x.g, x.lo, 1
    while len(rows):
        begin, size = _runs(keys)
        open_ = np.ones(len(begin), bool)
        if dense:
            for k in np.flatnonzero(size >= DENSE):
                got = _dense(x, rows[begin[k] : begin[k] + size[k]], t, apart)
                if got is not None:
                    open_[k] = False
                    stars += got[0]
                    found += got[1]
        small = open_ & (size > 1) & ((size <= SMALL_GROUP) | (level >= 3))
        found += _within(x, rows, begin[small], size[small], t, apart)
        if level >= 3:
            break
        large = open_ & (size > SMALL_GROUP)
        pick = ragged(begin[large], size[large])
        run = np.repeat(np.arange(large.sum()), size[large])
        r, a = rows[pick], at[pick]
        if depth <= level:
            begin, size = _runs(run)
            found += _within(x, r, begin, size, t, apart)
            break
        many = np.maximum(0, np.minimum(x.hi[r], x.lo[r] + x.room[r] + level - 1) - a)
        s = ragged(a, many)
        keys = (np.repeat(run, many).astype(np.int64) << 32) | x.sfx[s].astype(np.int64)
        order = np.argsort(keys)
        keys, rows, at = keys[order], np.repeat(r, many)[order], (s + 1)[order]
        level += 1
    none = np.zeros(0, np.int64)
    #: The links come first, since of equal pairs np.unique keeps the first: a link stays one though a smaller run has it too.
    i, j = (np.concatenate(c) for c in zip(*stars, *found)) if found or stars else (none, none)
    star = np.arange(len(i)) < sum(len(c) for c, _ in stars)
    both, first = np.unique(np.minimum(i, j) * np.int64(len(x.g)) + np.maximum(i, j), return_index=True)
    return both // len(x.g), both % len(x.g), star[first].astype(np.int32)


def _pairer(t: float, apart: bool, dense: bool):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            x = Group(table)
            i, j, star = group_pairs(x, t, apart, dense)
            first = (x.h1[i] < x.h1[j]) | ((x.h1[i] == x.h1[j]) & (x.h2[i] < x.h2[j]))
            a, b = np.where(first, i, j), np.where(first, j, i)
            other = (x.h1[a] != x.h1[b]) | (x.h2[a] != x.h2[b])
            a, b, star = a[other], b[other], star[other]
            if len(a):
                every, which = np.unique(np.stack([x.h1[a], x.h2[a], x.h1[b], x.h2[b]]), axis=1, return_inverse=True)
                stars = np.zeros(every.shape[1], np.int32)
                np.maximum.at(stars, which.ravel(), star)
                yield pa.RecordBatch.from_arrays([*map(pa.array, every), pa.array(stars)], names=["a1", "a2", "b1", "b2", "star"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 40_000:
                continue
            table = pa.Table.from_batches(held)
            g = table.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from solved(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
                rows = len(g) - cut
        if held:
            yield from solved(pa.Table.from_batches(held).combine_chunks())

    return pairs


def candidates(emitted: DataFrame, t: float, apart: bool = False, dense: bool = False) -> DataFrame:
    """(a1, a2, b1, b2, star): pairs of one group that pass all filters, once each; star: a link to one set of a dense group."""
    pairs = emitted.repartition("g").sortWithinPartitions("g").mapInArrow(_pairer(t, apart, dense), PAIRS)
    return pairs.groupBy("a1", "a2", "b1", "b2").agg(F.max("star").alias("star"))


def compared(pairs: DataFrame, sets: DataFrame, *keep: str) -> DataFrame:
    """(star, both, n, and keep of either side): words that the sets of each pair share, and words of the two together.

    The sets are partitioned by their hashes as they come, so their words aren't shuffled again.
    """
    side = lambda x: sets.select(F.col("h1").alias(x + "1"), F.col("h2").alias(x + "2"), F.col("t").alias("t" + x), *[F.col(c).alias(f"{c}_{x}") for c in keep])
    joined = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).withColumn("both", F.size(F.array_intersect("ta", "tb")))
    return joined.select("star", "both", (F.size("ta") + F.size("tb") - F.col("both")).alias("n"), *[f"{c}_{x}" for c in keep for x in "ab"])


def near(t: float):
    """Whether a pair of compared() reaches the threshold."""
    return F.col("both") >= F.lit(t) * F.col("n") - 1e-9


def near_links(sets: DataFrame, t: float) -> DataFrame:
    """(a, b): links whose components are those of all near pairs; all near pairs but some inside dense groups.

    In a dense group the sets that may be near one of them are first compared
    with that one only. Those that turn out not to be near it are compared
    with all others in a second pass, which is skipped where there are none.
    """
    sketch = sets.sparkSession.sparkContext.broadcast(frequency_sketch(sets.select(F.explode("t").alias("w")), "w"))
    emit = lambda df: df.mapInArrow(_emitter(sketch, t), EMITTED)
    first = written(compared(candidates(emit(sets.select("h1", "h2", "t")), t, dense=True), sets, "rep").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "star", near(t).alias("near")), "compared")
    links = first.where("near").select("a", "b")
    failed = first.where("star = 1 and not near").select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    if failed.isEmpty():
        return links
    marked = sets.join(failed.withColumn("role", F.lit(3)), "rep", "left").select("h1", "h2", "t", F.coalesce("role", F.lit(2)).alias("role"))
    second = compared(candidates(emit(marked), t, apart=True, dense=True), sets, "rep").where(near(t)).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    return links.unionByName(written(second, "second")).distinct()


def near_groups(df: DataFrame, id_col: str = "record_id", text_col: str = "text_clean", threshold: float = 0.7) -> DataFrame:
    """(id_col, group_id): the groups of two or more records that are near, directly or through others.

    Near: of the distinct words of the two texts together, at least threshold
    occur in both. Exact: copies of a word set are one set (so a hot text costs
    no pairs), and no pair of different sets is lost. Null, empty and wordless
    texts are near nothing; null ids are left out; a repeated id is one record;
    an empty table gives an empty one. Only the two named columns are read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    records = record_sets(df, id_col, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    sets = distinct_sets(records).persist(StorageLevel.MEMORY_AND_DISK)
    parts = connected_components(near_links(sets, threshold))
    grouped = sets.select("h1", "h2", "rep", "cnt").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    grouped = grouped.where("cnt > 1 or component is not null").select("h1", "h2", F.coalesce("component", "rep").alias("group_id"))
    found = records.select("id", "h1", "h2").join(grouped, ["h1", "h2"]).select("id", "group_id").distinct()
    kept = written(found, "groups")
    sizes = kept.groupBy("group_id").count().where("count > 1").select("group_id")
    sets.unpersist()
    records.unpersist()
    return kept.join(sizes, "group_id").select(F.col("id").alias(id_col), "group_id")
