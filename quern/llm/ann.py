"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash. In a shard a
graph is grown in batches: a greedy search over the graph so far proposes a
new vector's neighbours, and pruning keeps of them, nearest first, those that no
kept neighbour is nearer to by the factor ``ALPHA``; edges back are pruned in
the same way. A query is answered by beam search in every shard, and the
shards' nearest are merged. All rows are indexed; the index is a table in the
shared folder, a row for each shard. Queries are a table of blocks of about
``QUERY_BLOCK``; blocks and shards meet in one job, by shard, so nothing passes
through the driver or is broadcast.

Graphs are searched in single precision, on vectors that are scaled by their
shard's largest component, so that any finite double can take part. Equal
vectors are one node, which carries the ``k + 1`` smallest of their ids: ties go
to the smaller id, so no other can be among k nearest. Scores are computed, and
the nearest chosen, on the original vectors in double precision.

Defined results: a vector that is null, zero or holds a null or non-finite
component takes no part, neither as query nor as candidate; vectors of other
dimensions aren't candidates of a query; repeated rows are one candidate; an id
with several vectors is as near as the nearest of them, as a query too; a query
is not its own candidate, by id; with fewer candidates than k all are returned;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

SHARD_ROWS, QUERY_BLOCK = 4096, 2048
DEGREE, BEAM, ALPHA, EXPAND = 32, 64, 1.2, 4


@dataclass
class Graph:
    vectors: np.ndarray  # n x d
    edges: np.ndarray  # n x DEGREE, -1 where there is none
    start: int


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, of each row of ``a`` (m x d) to its own rows of ``b`` (m x c x d)."""
    diff = b - a[:, None, :]
    return np.einsum("mcd,mcd->mc", diff, diff)


def search(graph: Graph, queries: np.ndarray, beam: int = BEAM, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes that greedy beam search finds for each query (-1 where none), and their squared distances."""
    m, n = len(queries), len(graph.vectors)
    node = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    node[:, 0], done[:, 0] = graph.start, False
    dist[:, 0] = distances(queries, graph.vectors[np.full((m, 1), graph.start)])[:, 0]
    seen[:, graph.start] = True
    rows = np.arange(m)
    while len(rows):
        open_ = np.where(done[rows], np.inf, dist[rows])
        pick = np.argpartition(open_, min(expand, beam - 1), axis=1)[:, :expand]
        live = np.isfinite(np.take_along_axis(open_, pick, 1))
        keep = live.any(1)
        rows, pick, live = rows[keep], pick[keep], live[keep]
        if not len(rows):
            break
        done[rows[:, None], pick] |= live
        near = np.where(live[:, :, None], graph.edges[node[rows[:, None], pick]], -1).reshape(len(rows), -1)
        fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        order = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        target = near[r, c]
        seen[rows[r], target] = True
        diff = graph.vectors[target] - queries[rows[r]]
        far = np.full(near.shape, np.inf, np.float32)
        far[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_node = np.concatenate([node[rows], np.where(fresh, near, -1)], 1)
        all_dist = np.concatenate([dist[rows], far], 1)
        all_done = np.concatenate([done[rows], ~fresh], 1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        node[rows], dist[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_node, all_dist, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(dist, order, 1)


def prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Edges of each point among its candidates (-1 for none; one node may stand twice)."""
    own = vectors[points]
    ok = (candidates >= 0) & (candidates != points[:, None])
    there = vectors[np.maximum(candidates, 0)]
    far = np.where(ok, distances(own, there), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    there = np.take_along_axis(there, order[:, :, None], 1)
    alive = np.isfinite(far)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        some = alive[rows].any(1)
        rows = rows[some]
        if not len(rows):
            break
        first = alive[rows].argmax(1)
        out[rows, k] = candidates[rows, first]
        apart = distances(there[rows, first], there[rows])
        alive[rows] &= (alpha * alpha) * apart > far[rows]
        alive[rows, first] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512) -> Graph:
    n = len(vectors)
    middle = vectors.mean(0, dtype=np.float64)
    start = int(((vectors - middle) ** 2).sum(1).argmin())
    graph = Graph(vectors, np.full((n, degree), -1, np.int64), start)
    order = np.random.default_rng(n).permutation(n)
    order = order[order != start]
    at, size = 0, 8
    while at < len(order):
        points = order[at : at + size]
        found, _ = search(graph, vectors[points], beam)
        graph.edges[points] = prune(vectors, points, np.concatenate([found, np.broadcast_to(start, (len(points), 1))], 1), degree, alpha)
        source = np.repeat(points, degree)
        target = graph.edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, begin, counts = np.unique(target, return_index=True, return_counts=True)
        width = min(int(counts.max(initial=0)), 2 * degree)
        back = np.full((len(heads), width), -1, np.int64)
        place = np.arange(len(target)) - np.repeat(begin, counts)
        fits = place < width
        back[np.repeat(np.arange(len(heads)), counts)[fits], place[fits]] = source[fits]
        together = np.concatenate([graph.edges[heads], back], 1)
        full = (together >= 0).sum(1) > degree
        for i in range(0, int(full.sum()), batch):
            some = np.flatnonzero(full)[i : i + batch]
            graph.edges[heads[some]] = prune(vectors, heads[some], together[some], degree, alpha)
        loose = np.flatnonzero(~full)
        packed = np.take_along_axis(together[loose], np.argsort(together[loose] < 0, axis=1, kind="stable"), 1)[:, :degree]
        graph.edges[heads[loose]] = packed
        at, size = at + size, min(2 * size, batch)
    return graph


def reachable(graph: Graph) -> np.ndarray:
    seen = np.zeros(len(graph.vectors), bool)
    seen[graph.start] = True
    edge = np.array([graph.start])
    while len(edge):
        edge = np.unique(graph.edges[edge])
        edge = edge[edge >= 0]
        edge = edge[~seen[edge]]
        seen[edge] = True
    return seen


def unscaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """In single precision, for a search; beyond its range a query is only far away."""
    return np.clip(vectors / scale, -1e15, 1e15).astype(np.float32)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision; where squares overflow or vanish, by the largest difference."""
    with np.errstate(over="ignore", under="ignore"):
        diff = a - b
        out = np.sqrt((diff * diff).sum(1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-150))
        if len(odd):
            most = np.abs(diff[odd]).max(1)
            part = diff[odd] / np.where(most > 0, most, 1)[:, None]
            out[odd] = most * np.sqrt((part * part).sum(1))
    return out


INDEX = "dim int, shard long, n int, start int, scale double, vectors binary, edges binary, unreached binary, ids array<array<long>>"
_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("scale", pa.float64()), ("vectors", pa.binary()), ("edges", pa.binary()), ("unreached", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
BLOCKS = "dim int, block long, asked binary, asked_ids array<long>"
_BLOCKS = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("asked", pa.binary()), ("asked_ids", pa.list_(pa.int64()))])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    # 0.0 and -0.0 are one component, of one vector.
    same = F.transform("vector", lambda x: x + F.lit(0.0))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False))).select("id", same.alias("vector"))


def index(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard: its distinct vectors, their graph, and for each the ``k + 1`` smallest ids."""
    rows = usable(vectors, id_col, vector_col)
    few = Window.partitionBy("vector").orderBy("id")
    nodes = rows.distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = store.saved(nodes, "ann-nodes")
    shards = -(-nodes.count() // shard_rows) or 1
    dealt = nodes.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        dim = table.column("dim")[0].as_py()
        points = flat.reshape(-1, dim)
        scale = float(np.abs(points).max())
        graph = build(unscaled(points, scale))
        lost = np.flatnonzero(~reachable(graph)).astype("<i4")  # looked at one by one
        row = [[dim], [table.column("shard")[0].as_py()], [len(points)], [graph.start], [scale], [points.astype("<f8").tobytes()], [graph.edges.astype("<i4").tobytes()], [lost.tobytes()], [table.column("ids").to_pylist()]]
        return pa.table([pa.array(v, f.type) for v, f in zip(row, _INDEX, strict=True)], schema=_INDEX)

    return store.saved(dealt.groupBy("dim", "shard").applyInArrow(run, INDEX), "ann-index")


def blocks(queries: DataFrame, id_col: str, vector_col: str, query_block: int) -> DataFrame:
    """A row for each block of queries."""
    rows = store.saved(usable(queries, id_col, vector_col).distinct(), "ann-queries")
    count = -(-rows.count() // query_block) or 1
    dealt = rows.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(count)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = [[table.column(c)[0].as_py()] for c in ("dim", "block")] + [[flat.astype("<f8").tobytes()], [table.column("id").to_pylist()]]
        return pa.table([pa.array(v, f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    return store.saved(dealt.groupBy("dim", "block").applyInArrow(run, BLOCKS), "ann-blocks")


def answers(dim: int, start: int, scale: float, points: np.ndarray, edges: np.ndarray, lost: np.ndarray, owned: pa.ListScalar, ids: np.ndarray, asked: np.ndarray, k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """The k nearest that one shard has for each query of one block."""
    graph = Graph(unscaled(points, scale), edges, start)
    begin, owned = owned.values.offsets.to_numpy().astype(np.int64), owned.values.values.to_numpy()
    for i in range(0, len(ids), 256):
        found, _ = search(graph, unscaled(asked[i : i + 256], scale), max(beam, k + 1))
        found = np.concatenate([found, np.broadcast_to(lost, (len(found), len(lost)))], 1)
        q, c = np.nonzero(found >= 0)
        node = found[q, c]
        score = euclidean(asked[i + q], points[node])
        counts = begin[node + 1] - begin[node]
        who = np.repeat(np.arange(len(node)), counts)
        vec = owned[np.repeat(begin[node] - (np.cumsum(counts) - counts), counts) + np.arange(len(who))]
        q, score = q[who], score[who]
        other = vec != ids[i + q]
        q, score, vec = q[other], score[other], vec[other]
        order = np.lexsort((vec, score, q))
        q, score, vec = q[order], score[order], vec[order]
        # An id that stands in several places of a query counts at its nearest.
        again = np.lexsort((np.arange(len(q)), vec, q))
        first = np.ones(len(q), bool)
        first[again[1:]] = (q[again[1:]] != q[again[:-1]]) | (vec[again[1:]] != vec[again[:-1]])
        q, score, vec = q[first], score[first], vec[first]
        top = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        yield pa.record_batch([pa.array(ids[i + q[top]]), pa.array(vec[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, ties to the smaller id."""
    shards = index(vectors, k, id_col, vector_col, shard_rows)
    asked = blocks(queries, id_col, vector_col, query_block)
    # Each block goes to each shard of its dimension: an equal join on the shard, spread by shard and block.
    met = asked.join(shards.select("dim", "shard"), "dim").repartition(store.shuffle_partitions(vectors.sparkSession), "dim", "shard", "block").join(shards, ["dim", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for row in range(len(batch)):
                dim, start, scale = (get[c][row].as_py() for c in ("dim", "start", "scale"))
                points, own = (np.frombuffer(get[c][row].as_buffer(), "<f8").reshape(-1, dim) for c in ("vectors", "asked"))
                edges = np.frombuffer(get["edges"][row].as_buffer(), "<i4").reshape(len(points), -1).astype(np.int64)
                lost = np.frombuffer(get["unreached"][row].as_buffer(), "<i4").astype(np.int64)
                yield from answers(dim, start, scale, points, edges, lost, get["ids"][row], get["asked_ids"][row].values.to_numpy(), own, k, beam)

    found = store.saved(met.select("dim", "start", "scale", "vectors", "edges", "unreached", "ids", "asked", "asked_ids").mapInArrow(run, "query_id long, vec_id long, score double"), "ann-found")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
