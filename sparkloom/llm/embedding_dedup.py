"""Embedding near-dedup by a subspace pigeonhole join.

Cosine at least c between unit vectors means a squared distance of at most 2 - 2c. Vectors are rotated by a fixed
orthogonal matrix and split into ``BLOCKS`` low-dimensional blocks; a pair within the whole budget is within the
proportional budget in one block at least. Each block is range-joined: a vector's home is its cell of a grid over the
block's first coordinates, and it probes the cells within the block's radius. Candidates of a cell are those within the
block's budget; they are verified exactly on the input vectors in double precision. A pair that several blocks find is
counted by the first of them only, which either side can tell from the two vectors, so no pair is ever written out: a
cell gives link counts of its home vectors and links of a spanning forest.

Equal vectors are one row with a multiplicity. The number of grid coordinates follows the largest label; cells with
more than ``HOME`` home vectors are split into chunks that meet all probes of the cell, which stream past in batches.

Style: cells run as Arrow batches with matrix products, everything else as DataFrames. Defined results: vectors that
are null, empty or zero, hold null or non-finite components or have a null label link with nothing (n_links 0, a
component of their own); vectors of different lengths never link; repeated rows link as equal vectors; null vec_ids
take part, but are never a component's smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, table
from sparkloom.llm.components import components

COSINE = 0.98
BLOCKS = 8
SIDE = 0.2
HOME = 2000
#: Vectors of one label to which one more grid coordinate is due, and the factor for the next.
CROWD, FINER = 20_000, 3
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def _bounds(dim: int) -> list[tuple[int, int]]:
    n = min(BLOCKS, dim)
    edges = [round(i * dim / n) for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


class _Frame:
    """Rotation and blocks of each vector length."""

    def __init__(self):
        self.by_dim: dict[int, np.ndarray] = {}

    def units(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        dim = vectors.shape[1]
        if dim not in self.by_dim:
            self.by_dim[dim] = rotation(dim)
        return self.units(vectors) @ self.by_dim[dim]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _expand(cosine: float, coordinates: int):
    budget = 2 - 2 * cosine + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = _Frame()
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                turned = frame.rotated(_matrix(part.column("vector"), int(dim)))
                bounds = _bounds(int(dim))
                radius = math.sqrt(budget / len(bounds)) + 1e-6
                take, blocks, cells, roles = [], [], [], []
                for b, (lo, hi) in enumerate(bounds):
                    grid = turned[:, lo : min(hi, lo + coordinates)]
                    low, high, home = (np.floor(x / SIDE).astype(np.int64) for x in (grid - radius, grid + radius, grid))
                    number = lambda c: ((c + 512) * 1024 ** np.arange(c.shape[1])).sum(axis=1)
                    take.append(np.arange(len(grid)))
                    cells.append(number(home))
                    roles.append(np.zeros(len(grid), np.int32))
                    reach = int((high - low).max(initial=0)) + 1
                    for step in product(range(reach), repeat=grid.shape[1]):
                        at = low + np.array(step)
                        inside = np.flatnonzero((at <= high).all(axis=1))
                        take.append(inside)
                        cells.append(number(at[inside]))
                        roles.append(np.ones(len(inside), np.int32))
                    blocks.append(np.full(sum(map(len, take)) - sum(map(len, blocks)), b, np.int32))
                rows = part.take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(blocks)), pa.array(np.concatenate(cells)), pa.array(np.concatenate(roles))],
                                                 names=["cid", "label", "dim", "n", "vector", "block", "cell", "role"])

    return run


class _Cell:
    """Home vectors of one cell (or chunk), and what the probes so far have shown."""

    def __init__(self, ids, vectors, turned, block, cosine):
        self.ids, self.vectors, self.turned, self.block, self.cosine = ids, vectors, turned, block, cosine
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.bounds = _bounds(vectors.shape[1])
        self.limit = (2 - 2 * cosine + SLACK) / len(self.bounds)
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]

    def probe(self, ids, times, vectors, turned) -> None:
        lo, hi = self.bounds[self.block]
        for at in range(0, len(ids), 1024):
            cut_ = slice(at, at + 1024)
            a, b = self.turned[:, lo:hi], turned[cut_, lo:hi]
            near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T <= self.limit + 1e-9
            i, j = np.nonzero(near)
            linked_i, linked_j = [], []
            for k in range(0, len(i), 65536):  # bounded by the chunk, however dense the cell
                x, y = i[k : k + 65536], j[k : k + 65536] + at
                difference = self.turned[x] - turned[y]
                square = np.stack([(difference[:, p:q] ** 2).sum(axis=1) for p, q in self.bounds], axis=1)
                mine = np.argmax(square <= self.limit, axis=1) == self.block
                mine &= (square[:, self.block] <= self.limit) & (self.ids[x] != ids[y])
                x, y = x[mine], y[mine]
                norm = np.sqrt(np.einsum("ij,ij->i", vectors[y], vectors[y]))
                good = np.einsum("ij,ij->i", self.vectors[x], vectors[y]) / (self.norms[x] * norm) >= self.cosine
                linked_i.append(x[good])
                linked_j.append(y[good])
            if not linked_i:
                continue
            x, y = np.concatenate(linked_i), np.concatenate(linked_j)
            if not len(x):
                continue
            np.add.at(self.links, x, times[y])
            _, first = np.unique(y, return_index=True)
            anchor = np.zeros(len(ids), np.int64)
            anchor[y[first]] = x[first]
            self.merge(x, anchor[y])
            self.edges.append((self.ids[x[first]], ids[y[first]]))

    def result(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.links)
        merged = np.flatnonzero(self.root != np.arange(len(self.ids)))
        u = np.concatenate([self.ids[some], self.ids[merged], *(a for a, _ in self.edges)])
        v = np.concatenate([self.ids[some], self.ids[self.root[merged]], *(b for _, b in self.edges)])
        links = np.concatenate([self.links[some], np.zeros(len(u) - len(some), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, links)], names=["u", "v", "links"])


def _join(cosine: float):
    """Batches sorted by label, dim, block, cell, chunk and role: homes first, then probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, cell, key = _Frame(), None, None
        homes: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dim", "block", "cell", "chunk", "role")]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, z in zip(starts, starts[1:], strict=False):
                here = tuple(c[a] for c in columns[:5])
                part = batch.slice(a, z - a)
                vectors = _matrix(part.column("vector"), int(here[1]))
                ids, times = part.column("cid").to_numpy(), part.column("n").to_numpy()
                if here != key:
                    if cell is not None:
                        yield cell.result()
                    cell, key, homes = None, here, []
                if columns[5][a] == 0:
                    homes.append((ids, vectors, frame.rotated(vectors)))
                    continue
                if cell is None:
                    if not homes:
                        continue
                    cell = _Cell(*(np.concatenate(x) for x in zip(*homes, strict=True)), int(here[2]), cosine)
                cell.probe(ids, times, vectors, frame.rotated(vectors))
        if cell is not None:
            yield cell.result()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(usable & finite, F.lit(False)).alias("usable"))
    classes = cut(rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()))
    crowd = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    coordinates = 1 + max(0, math.ceil(math.log(max(crowd, 1) / CROWD, FINER)))
    plain = classes.select("cid", F.col("label").cast("string").alias("label"), F.size("embedding").cast("long").alias("dim"), "n", F.col("embedding").cast("array<double>").alias("vector"))
    spread = plain.mapInArrow(_expand(cosine, min(coordinates, 6)), "cid long, label string, dim long, n long, vector array<double>, block int, cell long, role int")
    where = ["label", "dim", "block", "cell"]
    crowded = cut(spread.where("role = 0").groupBy(*where).agg(F.ceil(F.count("*") / HOME).cast("int").alias("chunks")).where("chunks > 1"))
    dealt = spread.join(crowded, where, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.explode(F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("cid"), "chunks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))).drop("chunks")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = dealt.repartition(n, *where, "chunk").sortWithinPartitions(*where, "chunk", "role")
    found = cut(cells.mapInArrow(_join(cosine), "u long, v long, links long"))
    counted = found.where("links > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("others"))
    joined = components(found.where("u <> v"), "u", "v")
    named = classes.join(joined, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.join(smallest, "root").join(counted, "cid", "left").select(
        F.col("label").alias("of_label"), F.col("embedding").alias("of_embedding"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.join(result, rows["usable"] & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_embedding")), "left")
    return linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
