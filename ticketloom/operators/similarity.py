"""Cosine similarity over dense vectors: radius join, nearest neighbours, redundancy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.quality import latest_per_key

#: Vectors of a block: a task holds two of them.
BLOCK = 2048
#: Pivots of the radius join, at most; they are a sample by hash, so the broadcast is bounded.
PIVOTS = 512


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_norm_violations(df: DataFrame, vector: str, tolerance: float = 1e-4) -> DataFrame:
    """(violations): vectors whose length is not 1 within tolerance; null ones count."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return df.agg(F.count_if(F.coalesce(F.abs(norm - 1) > tolerance, F.lit(True))).alias("violations"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def similarity_edges(df: DataFrame, id_col: str, vector_col: str, threshold: float, seed: int = 42) -> DataFrame:
    """(a, b, similarity): all pairs a < b at a cosine of threshold or more, exactly.

    Every vector lives in the cell of its nearest pivot and visits each cell
    that could hold a partner: by the triangle inequality of angles, those
    whose pivot is within the cell's radius plus the threshold's angle. The
    higher the threshold, the fewer visits. A cell is compared in blocks. Null
    and zero vectors have no partner; all vectors have the same length.
    """
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    n = rows.count()
    wanted = max(1, min(PIVOTS, int(n**0.5)))
    picked = rows.withColumn("d", F.xxhash64(F.lit(seed), "id")).orderBy("d", "id").limit(wanted).select("v").toArrow()
    pivots = spark.sparkContext.broadcast(_matrix(picked["v"].combine_chunks()) if picked.num_rows else np.zeros((0, 1)))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = np.arccos(np.clip(_matrix(b.column("v")) @ pivots.value.T, -1, 1))
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], names=["cell", "angle"])

    if not picked.num_rows:
        return spark.createDataFrame([], "a bigint, b bigint, similarity double")
    radius = np.full(pivots.value.shape[0], -1.0)
    for r in rows.mapInArrow(homes, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r")).collect():  # a row per pivot
        radius[r["cell"]] = r["r"]
    reach = spark.sparkContext.broadcast(radius)
    theta = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            angle = np.arccos(np.clip(_matrix(b.column("v")) @ pivots.value.T, -1, 1))
            home = angle.argmin(axis=1)
            row, cell = np.nonzero((angle <= reach.value + theta) & (reach.value >= 0))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cell != home[row]), b.column("id").take(take), b.column("v").take(take)], names=["cell", "guest", "id", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray]] = []
        current = None
        for b in batches:
            cells, guests, ids, m = b.column("cell").to_numpy(), b.column("guest").to_numpy(zero_copy_only=False), b.column("id").to_numpy(), _matrix(b.column("v"))
            edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (guests[1:] != guests[:-1]), [True]])) if len(cells) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if cells[lo] != current:
                    own, current = [], cells[lo]
                for s in range(lo, hi, BLOCK):
                    block = (ids[s : min(s + BLOCK, hi)], m[s : min(s + BLOCK, hi)])
                    if not guests[lo]:
                        own.append(block)
                    for other in own:
                        sim = block[1] @ other[1].T
                        i, j = np.nonzero(sim >= threshold)
                        x, y, v = block[0][i], other[0][j], sim[i, j]
                        keep = x < y if (other is block or guests[lo]) else x != y
                        if keep.any():
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(v[keep])], names=["a", "b", "similarity"])

    spread = rows.mapInArrow(visits, "cell int, guest boolean, id bigint, v array<float>")
    found = spread.repartition("cell").sortWithinPartitions("cell", "guest", "id").mapInArrow(compared, "a bigint, b bigint, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def nearest_neighbours(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 1) -> DataFrame:
    """(query, rank, neighbour, similarity): the k most similar other rows of each query; ties go to the smaller id.

    Rows and queries are packed into blocks; each pair of blocks is one matrix
    product that leaves k rows per query. Null vectors are left out.
    """
    def packed(d: DataFrame, name: str) -> DataFrame:
        rows = d.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, BLOCK):
                    part = b.slice(s, BLOCK)
                    m = _matrix(part.column("v")).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().tobytes()]), pa.array([m.tobytes()])], names=[f"{name}_ids", f"{name}_m"])

        return rows.mapInArrow(pack, f"{name}_ids binary, {name}_m binary")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qm, ri, rm in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_m", "r_ids", "r_m"))):
                q, r = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                sim = np.frombuffer(qm).reshape(len(q), -1) @ np.frombuffer(rm).reshape(len(r), -1).T
                sim[q[:, None] == r[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(r, sim.shape), -np.round(sim, 12)), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(q)), top.shape[1])
                s = sim[rows, top.ravel()]
                keep = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(q[rows][keep]), pa.array(r[top.ravel()][keep]), pa.array(s[keep])], names=["query", "neighbour", "similarity"])

    pairs = packed(queries, "q").crossJoin(packed(df, "r"))
    best = pairs.mapInArrow(product, "query bigint, neighbour bigint, similarity double")
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "similarity")


def canonical_pairs(df: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """df with a <= b, one row per pair: the first in order; pairs with a null end or of one element are left out."""
    ends = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    return latest_per_key(ends, [a, b], order)


def redundancy(edges: DataFrame, labels: DataFrame, id_col: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, pairs, records, conflicting) of the edges at each threshold; conflicting: pairs of different labels, null safe."""
    la, lb = labels.select(F.col(id_col).alias("a"), F.col(label).alias("la")), labels.select(F.col(id_col).alias("b"), F.col(label).alias("lb"))
    levels = edges.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    e = edges.join(la, "a").join(lb, "b").join(F.broadcast(levels), F.col("similarity") >= F.col("threshold"))
    ends = e.select("threshold", F.explode(F.array("a", "b")).alias("id")).groupBy("threshold").agg(F.count_distinct("id").alias("records"))
    pairs = e.groupBy("threshold").agg(F.count("*").alias("pairs"), F.count_if(~F.col("la").eqNullSafe(F.col("lb"))).alias("conflicting"))
    return levels.join(pairs, "threshold", "left").join(ends, "threshold", "left").fillna(0)
