"""Boosted trees over sparse rows: histograms of the entries that rows have, the bin of zero by subtraction.

Spark ML keeps a bin of every feature for every row. Here a block of rows has
its entries in the order of features; a pass sums them by node and bin, and
the driver, which holds bins of a bounded vocabulary, chooses the splits. Rows
have no state: each pass applies the trees so far. Thresholds are Spark ML's,
from a sample of SAMPLE rows, and the same for all trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.features import WIDEST
from ticketloom.session import written

BINS = 32
SAMPLE = 10_000
#: Rows of a block.
BLOCK = 1 << 14


def thresholds(values: np.ndarray, rows: float, bins: int = BINS) -> np.ndarray:
    """Spark ML's split candidates of a feature, from its values other than 0 in a sample of rows."""
    seen, count = np.unique(values, return_counts=True)
    if rows - len(values) > 0:
        at = np.searchsorted(seen, 0.0)
        seen, count = np.insert(seen, at, 0.0), np.insert(count.astype(float), at, rows - len(values))
    middle = (seen[1:] + seen[:-1]) / 2
    if len(middle) <= bins - 1:
        return middle
    stride, out = rows / bins, []
    current, target = count[0], rows / bins
    for i in range(1, len(seen)):
        before, current = current, current + count[i]
        if abs(before - target) < abs(current - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


class Binned:
    """Thresholds of all features, and rows as blocks of entries."""

    def __init__(self, rows: DataFrame, width: int):
        n = rows.count()
        share = min(1.0, SAMPLE / max(n, 1))
        picked = rows.where(F.pmod(F.xxhash64(F.lit("splits"), "id"), F.lit(1_000_000)) < round(share * 1_000_000)).select("c", "v").toArrow()
        c, v = (picked[x].combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in ("c", "v"))
        c, v = c[v != 0], v[v != 0]
        order = np.argsort(c, kind="stable")
        ends = np.searchsorted(c[order], np.arange(width + 1))
        splits = [thresholds(v[order[a:b]], picked.num_rows) if b > a else np.zeros(0) for a, b in zip(ends[:-1], ends[1:])]
        self.padded = np.full((width, max([1, *map(len, splits)])), np.inf)
        for i, s in enumerate(splits):
            self.padded[i, : len(s)] = s
        self.start = np.concatenate([[0], np.cumsum([len(s) + 1 for s in splits])]).astype(np.int64)
        self.zero = (0.0 > self.padded).sum(axis=1)

    def entries(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(bin, row) of all entries, in the order of bins."""
        row = np.repeat(np.arange(b.num_rows, dtype=np.int32), b.column("c").value_lengths().to_numpy(zero_copy_only=False))
        c, v = b.column("c").flatten().to_numpy(zero_copy_only=False), b.column("v").flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([np.zeros(0, np.int64), *[(v[s : s + 65536, None] > self.padded[c[s : s + 65536]]).sum(axis=1) for s in range(0, len(c), 65536)]])
        cell = self.start[c] + at
        order = np.argsort(cell, kind="stable")
        return cell[order].astype(np.int32), row[order]

    def blocks(self, rows: DataFrame, tasks: int) -> DataFrame:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(s, BLOCK)
                    cell, row = self.entries(b)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (cell, row, b.column("y").to_numpy(zero_copy_only=False).astype(np.int32))], names=["cell", "row", "y"])

        return rows.repartition(tasks).mapInArrow(packed, "cell binary, row binary, y binary")

    def leaves(self, tree: list, cell: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The node of each row: tree is a list of (feature, bin, left, right) or None for a leaf, children after their parent."""
        at = np.zeros(n, np.int32)
        for i, node in enumerate(tree):
            if node:
                f, bin_, left, right = node
                lo, hi = np.searchsorted(cell, [self.start[f], self.start[f + 1]])
                above = np.full(n, self.zero[f] > bin_)
                above[row[lo:hi]] = cell[lo:hi] - self.start[f] > bin_
                here = at == i
                at[here & above], at[here & ~above] = right, left
        return at


def _score(x: np.ndarray, gini: bool) -> np.ndarray:
    """Sum of squares of the sums over the weight: what a split should raise, for Gini impurity and for variance."""
    w = x[..., 1:].sum(axis=-1) if gini else x[..., 0]
    return np.divide((x[..., 1:] ** 2).sum(axis=-1), w, out=np.zeros(w.shape), where=w > 0)


def grown(binned: Binned, blocks: DataFrame, depth: int, count: int, stats, gini: bool) -> tuple[list[list], list[list[np.ndarray]]]:
    """count trees at once, and the sums of each of their nodes; stats(cell, row, y): for each tree (n, 1 + sums) of the rows of a block, the first being 1."""
    trees: list[list] = [[None] for _ in range(count)]
    sums: list[list] = [[None] for _ in range(count)]
    open_ = [[0] for _ in range(count)]
    size, start, last = int(binned.start[-1]), binned.start[:-1], binned.start[1:] - 1
    for _ in range(depth):
        if not any(open_):
            break

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict = {}
            for b in batches:
                for cb, rb, yb in zip(*(b.column(x).to_pylist() for x in ("cell", "row", "y"))):
                    cell, row, y = (np.frombuffer(x, np.int32) for x in (cb, rb, yb))
                    for t, of in enumerate(stats(cell, row, y)):
                        if not open_[t]:
                            continue
                        place = np.full(len(trees[t]), -1)
                        place[open_[t]] = np.arange(len(open_[t]))
                        node = place[binned.leaves(trees[t], cell, row, len(y))]
                        use = node[row] >= 0
                        key, who = node[row[use]] * size + cell[use], row[use]
                        known = node >= 0
                        h, total = got.setdefault(t, (np.zeros((of.shape[1], len(open_[t]) * size)), np.zeros((of.shape[1], len(open_[t])))))
                        for k in range(of.shape[1]):
                            h[k] += np.bincount(key, of[who, k], h.shape[1])
                            total[k] += np.bincount(node[known], of[known, k], total.shape[1])
            for t, (h, total) in got.items():
                some = np.flatnonzero(h[0])
                yield pa.RecordBatch.from_arrays([pa.array([t]), *[pa.array([x.tobytes()]) for x in (some, h[:, some], total)]], names=["t", "at", "h", "total"])

        found: dict = {}
        for r in blocks.mapInArrow(summed, "t bigint, at binary, h binary, total binary").collect():  # a row per task and tree
            n, at = len(open_[r["t"]]), np.frombuffer(r["at"], np.int64)
            total = np.frombuffer(r["total"]).reshape(-1, n)
            h, all_ = found.setdefault(r["t"], (np.zeros((n * size, len(total))), np.zeros((n, len(total)))))
            h[at] += np.frombuffer(r["h"]).reshape(len(total), -1).T
            all_ += total.T
        for t, (h, total) in found.items():
            following = []
            for j, i in enumerate(open_[t]):
                x, whole = h[j * size : (j + 1) * size], total[j]
                sums[t][i] = whole
                x[start + binned.zero] += whole - np.add.reduceat(x, start, axis=0)
                left = np.cumsum(x, axis=0)
                left -= np.repeat(np.concatenate([np.zeros((1, x.shape[1])), left[last[:-1]]]), last - start + 1, axis=0)
                right = whole - left
                gain = _score(left, gini) + _score(right, gini) - _score(whole, gini)
                gain[(left[:, 0] < 0.5) | (right[:, 0] < 0.5)] = -np.inf
                gain[last] = -np.inf
                best = int(gain.argmax())
                if gain[best] > 1e-12 * max(1.0, whole[0]):
                    f = int(np.searchsorted(binned.start, best, "right")) - 1
                    k = len(trees[t])
                    trees[t][i] = (f, best - int(binned.start[f]), k, k + 1)
                    trees[t] += [None, None]
                    sums[t] += [left[best], right[best]]
                    following += [k, k + 1]
            open_[t] = following
    return trees, sums


def _prepared(train, test, vocab, labels, id_col, label, classes, ids, asked_ids):
    names = [r["feature"] for r in vocab.select("feature").orderBy("feature").limit(WIDEST + 1).collect()]
    if len(names) > WIDEST:
        raise ValueError(f"more than {WIDEST} features")
    index = train.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, c int")

    def rows(values: DataFrame, of: DataFrame | None) -> DataFrame:
        packed = values.join(F.broadcast(index), "feature").where("value is not null").groupBy("id").agg(F.collect_list(F.struct("c", F.col("value").cast("double").alias("v"))).alias("p"))
        if of is not None:
            packed = of.where("id is not null").select("id").distinct().join(packed, "id", "left")
        p = F.coalesce("p", F.array().cast("array<struct<c:int,v:double>>"))
        return packed.select("id", p["c"].alias("c"), p["v"].alias("v"))

    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int").alias("y")
    data = written(rows(train, ids).join(labels.where(F.col(label).isin(*classes)).select(F.col(id_col).alias("id"), y), "id"), "tree-rows")
    binned = Binned(data, len(names))
    tasks = max(1, data.sparkSession.sparkContext.defaultParallelism)
    return binned, written(binned.blocks(data, tasks), "tree-blocks"), rows(test, asked_ids)


def _predicted(binned: Binned, asked: DataFrame, classes: list[str], votes) -> DataFrame:
    """(id, pred): the class of the most votes, the first on ties."""
    kind = asked.schema["id"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                b = whole.slice(s, BLOCK)
                best = votes(*binned.entries(b), b.num_rows).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([classes[k] for k in best], pa.string())], names=["id", "pred"])

    return asked.mapInArrow(named, f"id {kind}, pred string")


def boosted(train, test, vocab, labels, id_col: str, label: str, classes: list[str], ids=None, asked_ids=None, rounds: int = 20, depth: int = 4, step: float = 0.1) -> DataFrame:
    """(id, pred): for each class gradient boosting of log loss against the others, all classes in the same passes; as Spark ML's one-vs-rest of boosted trees."""
    binned, blocks, asked = _prepared(train, test, vocab, labels, id_col, label, classes, ids, asked_ids)
    made: list[tuple] = []

    def margins(cell: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(classes)))
        for r, (trees, values) in enumerate(made):
            for t, tree in enumerate(trees):
                out[:, t] += (step if r else 1.0) * values[t][binned.leaves(tree, cell, row, n)]
        return out

    def stats(cell: np.ndarray, row: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        sign = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
        target = 4 * sign / (1 + np.exp(2 * sign * margins(cell, row, len(y)))) if made else sign
        return [np.column_stack([np.ones(len(y)), target[:, t]]) for t in range(len(classes))]

    for _ in range(rounds):
        trees, sums = grown(binned, blocks, depth, len(classes), stats, False)
        if any(s[0] is None for s in sums):  # no row at all
            break
        made.append((trees, [np.array([x[1] / max(x[0], 1) for x in s]) for s in sums]))
    return _predicted(binned, asked, classes, margins)


def adaboost(train, test, vocab, labels, id_col: str, label: str, classes: list[str], ids=None, asked_ids=None, rounds: int = 5, depth: int = 2) -> DataFrame:
    """(id, pred): multi-class boosting (SAMME) of weighted trees; ends early when a tree is no better than chance."""
    binned, blocks, asked = _prepared(train, test, vocab, labels, id_col, label, classes, ids, asked_ids)
    made: list[tuple] = []

    def stats(cell: np.ndarray, row: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        weight = np.ones(len(y))
        for tree, named, say in made:
            weight *= np.where(named[binned.leaves(tree, cell, row, len(y))] != y, math.exp(say), 1.0)
        return [np.column_stack([np.ones(len(y)), (y[:, None] == np.arange(len(classes))) * weight[:, None]])]

    def votes(cell: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(classes)))
        for tree, named, say in made:
            out[np.arange(n), named[binned.leaves(tree, cell, row, n)]] += say
        return out

    for _ in range(rounds):
        (tree,), (sums,) = grown(binned, blocks, depth, 1, stats, True)
        if sums[0] is None:
            break
        ends = [i for i, node in enumerate(tree) if not node]
        named = np.array([int(x[1:].argmax()) for x in sums])
        right = sum(sums[i][1:].max() for i in ends)
        error = min(1 - 1e-9, max(1e-9, 1 - right / sums[0][1:].sum()))
        if error >= 1 - 1 / len(classes):
            break
        made.append((tree, named, math.log((1 - error) / error) + math.log(len(classes) - 1)))
    return _predicted(binned, asked, classes, votes)
