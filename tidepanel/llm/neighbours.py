"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

Vectors of a shard get one more component that makes their norms equal; the order by distance is then the order by
inner product, so the graph serves either. A shard holds at most about ``shard_rows`` vectors, chosen by a
hash, and is one row of flat arrays. Equal vectors of a shard are one node with all their ids. Every query
searches every shard; the shards' results are merged by exact scores on the original vectors.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.storage import Scratch

SHARD_ROWS = 8192
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
SLICE_QUERIES = 4096

INDEX = ("shard int, dim int, ids array<long>, first array<int>, vectors array<double>, levels array<int>, "
         "links array<int>, link_first array<long>, entry int")


class Graph:
    """Flat arrays: node n has at level l the neighbours links[link_first[n] + ...], 2 * LINKS places at level 0 and
    LINKS at each level above, filled up with -1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: int):
        norms = (vectors * vectors).sum(axis=1)
        rest = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.points = np.concatenate([vectors, rest[:, None]], axis=1)
        self.levels, self.m = levels, links
        sizes = 2 * links + levels.astype(np.int64) * links
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.links = np.full(self.first[-1], -1, np.int32)
        self.entry = -1

    def around(self, node: int, level: int) -> np.ndarray:
        a = self.first[node] + (0 if level == 0 else 2 * self.m + (level - 1) * self.m)
        return self.links[a:a + (2 * self.m if level == 0 else self.m)]

    def search(self, point: np.ndarray, start: list[tuple[float, int]], level: int, width: int) -> list[tuple[float, int]]:
        """The best nodes found at a level as (-score, node), best first."""
        seen = {n for _, n in start}
        queue = list(start)
        heapq.heapify(queue)
        best = [(-d, n) for d, n in start]
        heapq.heapify(best)
        while queue:
            d, node = heapq.heappop(queue)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [n for n in self.around(node, level).tolist() if n >= 0 and n not in seen]
            if not new:
                continue
            seen.update(new)
            for score, n in zip((self.points[new] @ point).tolist(), new, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (score, n))
                elif score > best[0][0]:
                    heapq.heapreplace(best, (score, n))
                else:
                    continue
                heapq.heappush(queue, (-score, n))
        return sorted((-s, n) for s, n in best)

    def _pick(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes that are nearer to the centre than to those picked already, then the nearest of the rest."""
        if len(found) <= most:
            return [n for _, n in found]
        nodes = [n for _, n in found]
        near = self.points[nodes]
        between = near @ near.T
        closest = np.full(len(found), -np.inf)  # to a picked node
        picked: list[int] = []
        for k, (d, _) in enumerate(found):
            if closest[k] < -d:
                picked.append(k)
                if len(picked) == most:
                    break
                np.maximum(closest, between[k], out=closest)
        chosen = set(picked)
        picked += [k for k in range(len(found)) if k not in chosen][:most - len(picked)]
        return [nodes[k] for k in picked]

    def _link(self, node: int, level: int, chosen: list[int]) -> None:
        row = self.around(node, level)
        row[:] = -1
        row[:len(chosen)] = chosen

    def add(self, node: int, width: int) -> None:
        point, level = self.points[node], int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        top = int(self.levels[self.entry])
        start = [(-float(self.points[self.entry] @ point), self.entry)]
        for at in range(top, level, -1):
            start = self.search(point, start, at, 1)
        for at in range(min(top, level), -1, -1):
            start = self.search(point, start, at, width)
            self._link(node, at, self._pick(start, self.m))
            most = 2 * self.m if at == 0 else self.m
            for other in [n for n in self.around(node, at).tolist() if n >= 0]:
                row = self.around(other, at)
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                near = [*row.tolist(), node]
                found = sorted(zip((-(self.points[near] @ self.points[other])).tolist(), near, strict=True))
                self._link(other, at, self._pick(found, most))
        if level > top:
            self.entry = node

    def nearest(self, query: np.ndarray, width: int) -> list[int]:
        if self.entry < 0:
            return []
        point = np.append(query, 0.0)
        start = [(-float(self.points[self.entry] @ point), self.entry)]
        for at in range(int(self.levels[self.entry]), 0, -1):
            start = self.search(point, start, at, 1)
        return [n for _, n in self.search(point, start, 0, width)]


def _build(links: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        shard, dim = table.column("shard")[0].as_py(), table.column("dim")[0].as_py()
        ids = table.column("vec").to_numpy()
        flat = table.column("point").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.lexsort((ids, *flat.T[::-1]))
        ids, flat = ids[order], flat[order]
        first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]).any(axis=1)]))
        nodes = flat[first]
        chance = np.random.default_rng(20).random(len(nodes))
        levels = np.floor(-np.log(np.maximum(chance, 1e-12)) / math.log(links)).astype(np.int32)
        graph = Graph(nodes, levels, links)
        for node in np.random.default_rng(21).permutation(len(nodes)).tolist():  # not in the sorted order
            graph.add(node, width)
        row = {"shard": shard, "dim": dim, "ids": ids, "first": np.append(first, len(ids)).astype(np.int32),
               "vectors": nodes.reshape(-1), "levels": levels, "links": graph.links, "link_first": graph.first, "entry": graph.entry}
        return pa.Table.from_pylist([row], schema=_INDEX_ARROW)
    return run


_INDEX_ARROW = pa.schema([
    ("shard", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())),
    ("vectors", pa.list_(pa.float64())), ("levels", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())),
    ("link_first", pa.list_(pa.int64())), ("entry", pa.int32())])


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, point, dim) of the rows that take part, repeated rows once."""
    point = F.col(vector_col).cast("array<double>")
    fine = F.forall("point", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec"), point.alias("point"))
            .where(F.col("point").isNotNull() & fine & F.exists("point", lambda x: x != 0)).distinct()
            .withColumn("dim", F.size("point")))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
                links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """One row of flat arrays per shard. Every valid row is indexed; each length of vectors has its own shards.

    The rows are small beside the work on them, so they are dealt to twice as many tasks as there are shards:
    adaptive coalescing, which looks at bytes, would build many shards in one task.
    """
    scratch = Scratch(vectors.sparkSession, "neighbour-rows")
    rows = scratch.store(valid_vectors(vectors, id_col, vector_col), "rows")
    sizes = scratch.store(rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "sizes")
    tasks = max(64, 2 * (sizes.agg(F.sum("shards")).first()[0] or 0))
    spread = rows.join(sizes, "dim").withColumn("shard", F.expr("cast(pmod(xxhash64(vec), shards) as int)"))
    dealt = spread.select("shard", "dim", "vec", "point").repartition(tasks, "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInArrow(_build(links, width), INDEX)


class _Searcher:
    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids, self.first = np.array(row["ids"]), np.array(row["first"])
        self.vectors = np.array(row["vectors"]).reshape(-1, self.dim)
        levels, first = np.array(row["levels"], np.int32), row["link_first"]
        self.graph = Graph(self.vectors, levels, (first[1] - first[0]) // (2 + row["levels"][0]))
        self.graph.links, self.graph.entry = np.array(row["links"], np.int32), row["entry"]

    def top(self, own: int, query: np.ndarray, k: int, width: int) -> list[tuple[int, float]]:
        nodes = np.array(self.graph.nearest(query, max(width, k + 1)), np.int64)
        scores = (self.vectors[nodes] * query).sum(axis=1)
        out: list[tuple[int, float]] = []
        for at in np.lexsort((self.ids[self.first[nodes]], -scores)):
            members = self.ids[self.first[nodes[at]]:self.first[nodes[at] + 1]][:k + 1]
            out += [(int(v), float(scores[at])) for v in members if v != own]
        return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def _search(k: int, width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, at = None, None
        for batch in frames:
            out: list[tuple] = []
            for j in range(len(batch)):
                row = batch.slice(j, 1)
                if row.column("index")[0].is_valid:
                    searcher = _Searcher(row.column("index")[0].as_py())
                    at = tuple(row.column(c)[0].as_py() for c in ("dim", "shard", "slice"))
                    continue
                assert at == tuple(row.column(c)[0].as_py() for c in ("dim", "shard", "slice"))
                own, query = row.column("vec")[0].as_py(), np.array(row.column("point")[0].as_py())
                out += [(own, zlib.crc32(query.tobytes()), v, s) for v, s in searcher.top(own, query, k, width)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["query_id", "which", "vec_id", "score"]).astype(
                {"query_id": "int64", "which": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)
    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH, slice_queries: int = SLICE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec, point, dim), itself left out.

    A task gets a shard first and then a slice of the queries one after another, so it holds one shard at a time.
    """
    slices = max(1, math.ceil(queries.count() / slice_queries))
    one = F.expr(f"explode(sequence(0, {slices - 1}))")
    shards = index.select("dim", "shard", one.alias("slice"), F.struct(*index.columns).alias("index"))
    asked = (index.select("dim", "shard").join(queries, "dim")
             .select("dim", "shard", F.expr(f"cast(pmod(xxhash64(vec), {slices}) as int)").alias("slice"), "vec", "point"))
    # ``index`` is null for queries, and nulls come last.
    both = shards.unionByName(asked, allowMissingColumns=True).repartition("dim", "shard", "slice").sortWithinPartitions(
        "dim", "shard", "slice", F.col("index").isNull())
    found = both.select("dim", "shard", "slice", "vec", "point", "index").mapInArrow(
        _search(k, width), "query_id long, which long, vec_id long, score double")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20,
                       k: int = 20, **sizes) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``, by inner product in double precision.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do rows without an
    id. A vector is only compared with those of its length. Rows that repeat an id and vector count once; an id with
    several vectors is a query for each and a candidate with each, never its own. Ties go to the smaller id.
    Fewer candidates than k give them all. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    index = scratch.store(build_index(vectors, id_col, vector_col, **sizes), "index")
    queries = valid_vectors(vectors, id_col, vector_col).where(f"vec % {every} = 0")
    return search(index, queries, k)
