"""A road graph: nodes and directed edges as DataFrames."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.geo import within
from spanweave.shared import shared_dir

MAX_LOCAL_EDGES = 5_000_000  # graphs up to this size are shipped to kernels whole; larger ones use the join-based operators


@dataclass(frozen=True)
class RoadGraph:
    """``nodes`` (node_id, and optionally lat, lon, ...) and ``edges`` (edge_id, src, dst, weight, and optionally label, ...)."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None) -> RoadGraph:
        """Graph of (src, dst, weight, ...) rows; edge ids follow (src, dst, weight); isolated nodes come from ``nodes``."""
        if "edge_id" not in edges.columns:
            edges = edges.select((F.row_number().over(Window.orderBy("src", "dst", "weight")) - 1).cast("long").alias("edge_id"), "*")
        if nodes is None:
            nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
        return cls(nodes, edges)

    def save(self, path: str) -> None:
        """Two Parquet tables under ``path``."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RoadGraph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def out_degree(self) -> DataFrame:
        """(node_id, degree) of every node."""
        d = self.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def outgoing(self, node: int) -> DataFrame:
        """(dst, weight) of a node's edges."""
        return self.edges.where(F.col("src") == node).select("dst", "weight")

    def undirected(self) -> DataFrame:
        """Distinct (u, v) with u < v; loops go."""
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()

    def with_elevation(self, elevation: DataFrame) -> RoadGraph:
        """Nodes with a column elevation from (node_id, elevation)."""
        return RoadGraph(self.nodes.drop("elevation").join(elevation.select("node_id", "elevation"), "node_id", "left"), self.edges)

    def with_confidence(self, confidence: DataFrame) -> RoadGraph:
        """Edges with a column confidence from (edge_id, confidence)."""
        return RoadGraph(self.nodes, self.edges.drop("confidence").join(confidence.select("edge_id", "confidence"), "edge_id", "left"))

    def restrict(self, node_ids: DataFrame) -> RoadGraph:
        """Induced subgraph on (node_id)."""
        ids = node_ids.select("node_id").distinct()
        e = self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        return RoadGraph(self.nodes.join(ids, "node_id", "left_semi"), e.select(*self.edges.columns))

    def subgraph(self, points: Sequence[tuple[float, float]]) -> RoadGraph:
        """Induced subgraph inside a polygon; the bounding box reaches the scan; nodes without coordinates stay out."""
        return self.restrict(self.nodes.where(within("lat", "lon", points)))

    def edges_in_polygon(self, points: Sequence[tuple[float, float]]) -> DataFrame:
        """(src, dst) of edges with both ends inside."""
        return self.subgraph(points).edges.select("src", "dst")

    def filter_edges(self, condition: Column) -> RoadGraph:
        """Edges for which the condition holds, and their ends."""
        e = self.edges.where(condition)
        ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
        return RoadGraph(self.nodes.join(ends, "node_id", "left_semi"), e)

    def reorder(self, mapping: DataFrame) -> RoadGraph:
        """New ids by (node_id, new_id)."""
        m = mapping.select("node_id", "new_id")
        nodes = self.nodes.join(m, "node_id").drop("node_id").withColumnRenamed("new_id", "node_id")
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(m.select(F.col("node_id").alias(end), F.col("new_id").alias(f"__{end}")), end).drop(end).withColumnRenamed(f"__{end}", end)
        return RoadGraph(nodes.select(*self.nodes.columns), e.select(*self.edges.columns))

    def local(self, *columns: str) -> LocalGraph:
        """The graph as arrays, for kernels; refused beyond ``MAX_LOCAL_EDGES``.

        One task streams sorted rows into array files in the shared folder, and every process maps these: the graph never passes
        through the driver, and pickles of it hold the folder only.  ``columns``: numeric node columns that go along.
        """
        path = f"{shared_dir(self.spark)}/spanweave/graph-{uuid.uuid4().hex}"
        extra = [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)]
        none = [F.lit(None).cast("double").alias(f"x{k}") for k in range(len(columns))]
        nodes = self.nodes.select(F.lit(0).alias("kind"), F.col("node_id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"), *extra)
        edges = self.edges.select(F.lit(1).alias("kind"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("weight").cast("double").alias("w"), *none)
        most = MAX_LOCAL_EDGES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, n, m = _write_arrays(batches, path, columns, most)
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [n], "m": [m]})

        rows = nodes.union(edges).repartition(1).sortWithinPartitions("kind", "a", "b", "w")
        name, _, m = rows.mapInArrow(run, "name string, n long, m long").first()
        if m > most:
            raise ValueError(f"{m} edges are too many to ship to every task; use the join-based operator or cut the graph by region first")
        return LocalGraph.opened(f"{path}/{name}")


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that no size estimate broadcasts: tables of nodes compress to a few MB, and their hash tables fill the driver."""
    return df.hint("merge")


def _folder(path: str) -> tuple[fs.FileSystem | None, str]:
    """File system and path of a shared folder; None: files that processes can map."""
    if path.startswith("file:") or "://" not in path:
        return None, re.sub("^file:(//)?", "", path)
    return fs.FileSystem.from_uri(path)


def _write_arrays(batches: Iterator[pa.RecordBatch], path: str, columns: Sequence[str], most: int) -> tuple[str, int, int]:
    """Sorted rows (nodes, then edges) as array files in a folder of this attempt; its name, nodes and edges.  Stops writing beyond ``most`` edges."""
    system, root = _folder(path)
    name = uuid.uuid4().hex
    if system is None:
        os.makedirs(f"{root}/{name}", exist_ok=True)
    else:
        system.create_dir(f"{root}/{name}", recursive=True)
    out = lambda part: open(f"{root}/{name}/{part}", "wb") if system is None else system.open_output_stream(f"{root}/{name}/{part}")  # noqa: E731, SIM115
    ids, extra, n, m = [], [[] for _ in columns], 0, 0
    to, weight = [], []
    degree = None

    def edges(found: list[pa.RecordBatch]) -> None:
        nonlocal degree
        a, b, w = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in found]) for c in "abw")
        if degree is None:
            degree = np.zeros(len(ids) + 1, np.int64)
        at = np.searchsorted(ids, a)
        first, last = int(at[0]), int(at[-1])
        degree[first : last + 1] += np.bincount(at - first, minlength=last - first + 1)[: last - first + 1]
        to.append(np.searchsorted(ids, b.astype(np.int64)).astype(np.int32))
        weight.append(w)

    held, rows = [], 0
    for batch in batches:
        k = batch.column("kind").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, 1))
        if cut:
            ids.append(batch.column("a").slice(0, cut).to_numpy(zero_copy_only=False))
            for c, x in enumerate(extra):
                x.append(batch.column(f"x{c}").slice(0, cut).to_numpy(zero_copy_only=False))
        if cut < len(k):
            if isinstance(ids, list):
                ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
            m += len(k) - cut
            if m <= most:
                held.append(batch.slice(cut))
                rows += len(k) - cut
                if rows > 500_000:
                    edges(held)
                    held, rows = [], 0
    if isinstance(ids, list):
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
    n = len(ids)
    if m > most:
        return name, n, m
    if held:
        edges(held)
    degree = (np.zeros(n, np.int64) if degree is None else degree)[:n]
    offset = np.concatenate([[0], np.cumsum(degree)]).astype(np.int64)
    to = np.concatenate(to) if to else np.empty(0, np.int32)
    weight = np.concatenate(weight) if weight else np.empty(0)
    arrays = {"ids": ids.astype(np.int64), "offset": offset, "dst": to, "weight": weight.astype(float), "src": np.repeat(np.arange(n, dtype=np.int32), degree)}
    arrays |= {f"at_{c}": np.concatenate(x).astype(float) if x else np.empty(0) for c, x in zip(columns, extra, strict=True)}
    for part, x in arrays.items():
        with out(part) as f:
            f.write(np.ascontiguousarray(x).data)
    del arrays
    back = np.argsort(to, kind="stable")
    for part, x in (("back_offset", np.concatenate([[0], np.cumsum(np.bincount(to, minlength=n)[:n])]).astype(np.int64)), ("back_src", np.repeat(np.arange(n, dtype=np.int32), degree)[back]), ("back_weight", weight[back])):
        with out(part) as f:
            f.write(np.ascontiguousarray(x).data)
    return name, n, m


TYPES = {"ids": np.int64, "offset": np.int64, "dst": np.int32, "src": np.int32, "weight": float, "back_offset": np.int64, "back_src": np.int32, "back_weight": float}
LISTS = 400_000  # edges up to which adjacency is kept as lists, quicker to walk than arrays


class Rows:
    """(target, weight) pairs of each node, read from arrays as they are asked for."""

    def __init__(self, offset: np.ndarray, to: np.ndarray, weight: np.ndarray):
        self.offset, self.to, self.weight = memoryview(offset), memoryview(to), memoryview(weight)

    def __len__(self) -> int:
        return len(self.offset) - 1

    def __getitem__(self, u: int):
        a, b = self.offset[u], self.offset[u + 1]
        return zip(self.to[a:b].tolist(), self.weight[a:b].tolist())

    def __iter__(self):
        return (self[u] for u in range(len(self)))


class LocalGraph:
    """Compressed rows over positions 0..n-1 of the sorted node ids; edges sorted by source, target, weight."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.lexsort((weight, dst, src))
        self.ids = ids
        self.src, self.dst, self.weight = src[order].astype(np.int64), dst[order].astype(np.int64), weight[order].astype(float)
        self.offset = np.searchsorted(self.src, np.arange(len(ids) + 1))
        self._path: str | None = None
        self._back: tuple | None = None
        self._adjacent: list | Rows | None = None
        self._reverse: list | Rows | None = None

    @classmethod
    def opened(cls, path: str) -> LocalGraph:
        """The graph of array files in a folder."""
        g = cls.__new__(cls)
        g.__setstate__(path)
        return g

    def _array(self, part: str) -> np.ndarray:
        system, root = _folder(self._path)
        kind = np.dtype(TYPES.get(part, float))
        if system is not None:
            with system.open_input_file(f"{root}/{part}") as f:
                return np.frombuffer(f.read(), kind)
        return np.memmap(f"{root}/{part}", kind, "r").view(np.ndarray) if os.path.getsize(f"{root}/{part}") else np.empty(0, kind)

    def at_nodes(self, column: str) -> np.ndarray:
        """A node column that went along, NaN where it is null."""
        return self._array(f"at_{column}")

    @property
    def n(self) -> int:
        return len(self.ids)

    def at(self, node_id: int) -> int:
        """Position of an id, -1 if the graph has none."""
        k = int(np.searchsorted(self.ids, node_id))
        return k if k < self.n and self.ids[k] == node_id else -1

    @property
    def back(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, sources and weights by target, sources ascending."""
        if self._back is None:
            if self._path:
                self._back = tuple(self._array(f"back_{x}") for x in ("offset", "src", "weight"))
            else:
                order = np.argsort(self.dst, kind="stable")
                self._back = np.searchsorted(self.dst[order], np.arange(self.n + 1)), self.src[order], self.weight[order]
        return self._back

    @property
    def adjacent(self) -> list[list[tuple[int, float]]] | Rows:
        """(target, weight) lists, made once a process."""
        if self._adjacent is None:
            self._adjacent = self._rows(self.offset, self.dst, self.weight)
        return self._adjacent

    @property
    def reverse(self) -> list[list[tuple[int, float]]] | Rows:
        if self._reverse is None:
            self._reverse = self._rows(*self.back)
        return self._reverse

    @staticmethod
    def _rows(offset: np.ndarray, to: np.ndarray, weight: np.ndarray) -> list[list[tuple[int, float]]] | Rows:
        rows = Rows(offset, to, weight)
        return [list(r) for r in rows] if len(to) <= LISTS else rows

    def __getstate__(self):
        return self._path or (self.ids, self.src, self.dst, self.weight)

    def __setstate__(self, state):
        if not isinstance(state, str):
            return self.__init__(*state)
        self._path, self._back, self._adjacent, self._reverse = state, None, None, None
        self.ids, self.src, self.dst, self.weight, self.offset = (self._array(x) for x in ("ids", "src", "dst", "weight", "offset"))
