"""Exact top-k by inner product with dual-tree cover-tree search.

Vectors are dealt to cells around pivots, and large cells to shards of a bounded size; the cells,
with their covering radii, are the upper level of the tree. Each query first searches the shard
that it lies in, which gives it a kth score, and then goes only to the cells whose pivot and
radius allow a product of at least that. The queries of a shard are cut into blocks; each
block with the shard is one group: a cover tree is built over each side, and pairs of nodes are
pruned when the largest inner product that their centres and covering radii allow is below the
worst kth score of the query group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.storage import shared_folder

#: Vectors of a shard, queries of a block, the least and the largest number of pivots (between, one for
#: each shard), vectors of a leaf, how much smaller the radius of a node's children is meant to be, and how
#: many children it has at most; vectors of a leaf that are multiplied at a time.
SHARD_ROWS, BLOCK_ROWS, PIVOTS, LEAF, SHRINK, FAN_OUT, BLOCK = 8192, 1024, (32, 1024), 64, 1.3, 24, 256


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children", "worst")

    def __init__(self, centre: np.ndarray, radius: float, rows: np.ndarray) -> None:
        self.centre, self.radius, self.rows = centre, radius, rows
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []
        self.worst = -math.inf


def cover_tree(points: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK, fan_out: int = FAN_OUT) -> Node:
    """A node covers its rows with its radius. Its children's centres are further apart than the
    child radius, and cover the rows with it. Where that would take more than `fan_out` children, as in
    many dimensions, where distances hardly differ, nothing would be gained by them: the node is a
    leaf. Equal points end in one leaf."""

    def node(rows: np.ndarray, centre: int) -> Node:
        gap = points[rows] - points[centre]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        out = Node(points[centre], float(far.max()), rows)
        stack.append((out, far))
        return out

    stack: list[tuple[Node, np.ndarray]] = []
    root = node(np.arange(len(points)), 0)
    while stack:
        top, far = stack.pop()
        if len(top.rows) <= leaf or top.radius == 0:
            continue
        rows, least, of = top.rows, far.copy(), np.zeros(len(top.rows), np.int64)
        centres = [int(rows[int(np.argmin(far))])]
        while len(centres) < fan_out and least.max() > top.radius / shrink:
            centres.append(int(rows[int(np.argmax(least))]))
            gap = points[rows] - points[centres[-1]]
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            closer = d < least
            least[closer], of[closer] = d[closer], len(centres) - 1
        if least.max() > top.radius / shrink:
            continue
        top.children = [node(rows[of == n], c) for n, c in enumerate(centres) if (of == n).any()]
    return root


class Best:
    """The k best of each query so far: scores descending, ties by ascending id."""

    def __init__(self, n: int, k: int, exact: type, least: np.ndarray | None = None) -> None:
        #: what doesn't reach this needn't be looked at
        self.floor = np.full(n, np.iinfo(np.int64).min)
        if least is not None:
            known = np.isfinite(least)
            self.floor[known] = least[known].astype(np.int64)
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.k, self.exact = k, exact

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores: a row for each query. A vector with the query's own id is left out. Only queries
        and vectors that reach a kth score so far are sorted."""
        near = scores >= np.maximum(self.scores[queries, -1], self.floor[queries])[:, None]
        rows = near.any(1)
        if not rows.any():
            return
        columns = near[rows].any(0)
        queries, scores, ids = queries[rows], scores[np.ix_(rows, columns)], ids[columns]
        known = np.where(ids[None, :] == own[queries][:, None], np.iinfo(np.int64).min, scores)
        shown = np.where(known == np.iinfo(np.int64).min, np.iinfo(np.int64).max, ids[None, :])
        scores = np.concatenate([self.scores[queries], known], axis=1)
        ids = np.concatenate([self.ids[queries], shown], axis=1)
        order = np.lexsort((ids, -scores.astype(np.float64) if self.exact is float else ~scores), axis=1)[:, : self.k]
        self.scores[queries] = np.take_along_axis(scores, order, 1)
        self.ids[queries] = np.take_along_axis(ids, order, 1)


def dual_search(queries: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (k columns; unused places have the largest id) for each query, exactly.

    queries, points: integer vectors as int64. least: scores below which nothing of a query counts, as
    it has k others of at least that. Products are summed as doubles where those are exact (below
    2**53), else as 64-bit integers."""
    best = Best(len(queries), k, int, least)
    if not len(queries) or not len(points):
        return best.ids, best.scores
    q, p = queries.astype(np.float64), points.astype(np.float64)
    small = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1]) < 2**52
    tree, other = cover_tree(q, 32), cover_tree(p)

    def most(a: Node, b: Node) -> float:
        bound = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return bound + 1e-9 * (abs(bound) + a.norm * b.norm) + 1e-6

    if least is not None:
        nodes = [tree]
        while nodes:
            top = nodes.pop()
            top.worst = float(least[top.rows].min())
            nodes += top.children
    stack = [(most(tree, other), tree, other)]
    while stack:
        bound, a, b = stack.pop()
        if bound < a.worst:
            continue
        if not a.children and not b.children:
            for at in range(0, len(b.rows), BLOCK):
                rows = b.rows[at : at + BLOCK]
                scores = np.rint(q[a.rows] @ p[rows].T).astype(np.int64) if small else queries[a.rows] @ points[rows].T
                best.offer(a.rows, scores, ids[rows], own)
            worst = int(best.scores[a.rows, -1].min())
            a.worst = max(a.worst, worst if worst > np.iinfo(np.int64).min else -math.inf)
            continue
        split_a = a.children and (not b.children or a.radius >= b.radius)
        pairs = [(c, b) for c in a.children] if split_a else [(a, c) for c in b.children]
        if split_a:
            for c in a.children:
                c.worst = max(c.worst, a.worst)
        kept = [(m, x, y) for x, y in pairs if (m := most(x, y)) >= x.worst]
        stack += sorted(kept, key=lambda t: t[0])
        if a.children:
            a.worst = max(a.worst, min(c.worst for c in a.children))
    return best.ids, best.scores


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return np.asarray(flat).reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, points = _matrix(left["query"]), _matrix(right["v"])
        own, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        found, scores = dual_search(queries, own, points, ids, k, left["least"].to_numpy()) if len(own) and len(ids) else (np.zeros((0, k), np.int64),) * 2
        row = np.repeat(np.arange(len(found)), k)
        used = found.ravel() != np.iinfo(np.int64).max
        return pa.table({"query_id": pa.array(own[row[used]] if len(row) else [], pa.int64()), "row": left["query_row"].take(pa.array(row[used])) if len(row) else pa.array([], pa.int64()), "vec_id": pa.array(found.ravel()[used], pa.int64()), "score": pa.array(scores.ravel()[used], pa.int64())})

    return run


def _far(pivots: np.ndarray, radii: np.ndarray):
    """For queries with their kth scores the cells (of the pivots' width) that may hold more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column("least").to_numpy()
            q = _matrix(batch.column("query")).astype(np.float64)
            if not len(q):
                continue
            most = q @ pivots.T + np.sqrt((q * q).sum(1))[:, None] * radii[None, :]
            #: the bound is rounded up; cells without vectors have no radius
            near = most + 1e-9 * np.abs(most) + 1.0 >= least[:, None]
            row, cell = np.nonzero(near & np.isfinite(radii)[None, :])
            rows = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32))], names=[*rows.schema.names, "cell"])

    return run


def _cells(pivots: np.ndarray):
    """The nearest pivot of each vector, and the distance; vectors of another width are of cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots * pivots).sum(1) / 2
        for batch in batches:
            near, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            sizes = np.diff(np.asarray(batch.column("v").offsets))
            same = np.flatnonzero(sizes == pivots.shape[1])
            if len(same):
                v = _matrix(batch.column("v").take(pa.array(same))).astype(np.float64)
                near[same] = np.argmin(half - v @ pivots.T, axis=1)
                far[same] = np.sqrt(((v - pivots[near[same]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, copies): floor(256 * x) of each component. Vectors that are null, empty, or hold null
    or non-finite components take no part, nor do rows without an id; rows alike in both are
    counted."""
    x = F.col(f"`{embedding}`")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(fine, x).alias("e")).where("vec_id is not null and size(e) > 0")
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` the k vectors
    with the largest inner product of quantised components, ties to the smaller id.

    All rows but those with the query's own id are searched, exactly, and a repeated row counts as often
    as it is there (more than k of one can't be shown). A repeated query is asked once. Only vectors
    of as many components are compared. An empty table gives an empty one."""
    session = vectors.sparkSession
    shared_folder(session)
    #: Quantised once, written to the shared folder: all that follows reads it.
    rows = quantised(vectors, vec_id, embedding).withColumn("row", F.xxhash64("vec_id", "v")).checkpoint()
    #: Pivots are a bounded number of rows by a hash order; they decide placement and bounds.
    wanted = min(PIVOTS[1], max(PIVOTS[0], -(-rows.count() // shard_rows)))
    some = rows.orderBy("row", "vec_id").limit(wanted).select("v").collect()
    width = max((len(r["v"]) for r in some), default=1)
    pivots = np.unique(np.array([r["v"] for r in some if len(r["v"]) == width], np.float64).reshape(-1, width), axis=0)
    if not len(pivots):
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = rows.mapInArrow(_cells(pivots), "vec_id long, v array<long>, copies long, row long, cell int, far double").withColumn("width", F.size("v"))
    sizes = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    #: a row for each width and pivot
    merged = _merged_cells({(r["width"], r["cell"]): r["n"] for r in sizes}, shard_rows)
    parts = {(r["width"], r["cell"]): max(1, -(-r["n"] // shard_rows)) for r in sizes}
    table = session.createDataFrame([(w, c, merged[(w, c)], n) for (w, c), n in parts.items()], "width int, cell int, base int, parts int")
    part = F.col("base").cast("long") * (1 << 32) + F.pmod(F.col("row"), F.col("parts"))
    data = placed.join(F.broadcast(table), ["width", "cell"]).select("vec_id", "v", "row", "width", "cell", "copies", part.alias("shard"))
    asked = data.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("query"), F.col("width").alias("query_width"), F.col("shard").alias("home"))
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    #: first every query in its own shard, then in those that its kth score there doesn't rule out
    first = ranked(_grouped(asked.withColumn("least", F.lit(-math.inf)).withColumn("query_shard", F.col("home")), data, k, block_rows)).checkpoint()
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("row").alias("r"), F.col("score").cast("double").alias("kth"))
    known = asked.join(kth, (F.col("query_id") == F.col("q")) & (F.col("query_row") == F.col("r")), "left").select("query_id", "query_row", "query", "query_width", "home", F.coalesce("kth", F.lit(-math.inf)).alias("least"))
    radii = np.full(len(pivots), np.nan)
    for r in sizes:
        if r["width"] == width:
            radii[r["cell"]] = r["far"]
    schema = "query_id long, query_row long, query array<long>, query_width int, home long, least double, cell int"
    near = known.where(F.col("query_width") == width).mapInArrow(_far(pivots, radii), schema).unionByName(known.where(F.col("query_width") != width).withColumn("cell", F.lit(0)))
    shards = table.select(F.col("width").alias("w"), F.col("cell").alias("c"), "base", "parts").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("w", "c", (F.col("base").cast("long") * (1 << 32) + F.col("n")).alias("query_shard"))
    there = near.join(F.broadcast(shards), (F.col("query_width") == F.col("w")) & (F.col("cell") == F.col("c"))).where("query_shard <> home").drop("w", "c", "cell").distinct()
    return ranked(first.drop("rank").unionByName(_grouped(there, data, k, block_rows))).select("query_id", "rank", "vec_id", "score")


def _grouped(queries: DataFrame, data: DataFrame, k: int, block_rows: int) -> DataFrame:
    """What queries (query_shard, least, ...) find in the shards that they are sent to. The queries of a
    shard are cut into blocks, and only as many copies of it are made."""
    queries = queries.checkpoint()
    counts = queries.groupBy("query_width", "query_shard").agg(F.count("*").alias("m")).select(F.col("query_width").alias("w"), F.col("query_shard").alias("s"), F.ceil(F.col("m") / block_rows).cast("int").alias("blocks"))
    sent = queries.join(F.broadcast(counts), (F.col("query_width") == F.col("w")) & (F.col("query_shard") == F.col("s"))).withColumn("query_block", F.pmod(F.shiftright("query_row", 8), F.col("blocks")).cast("int")).drop("w", "s", "blocks", "home")
    copies = F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int")))
    points = data.join(F.broadcast(counts), (F.col("width") == F.col("w")) & (F.col("shard") == F.col("s"))).select("vec_id", "v", "width", "shard", "copies", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("copy", copies).drop("copy", "copies")
    return sent.groupBy("query_width", "query_shard", "query_block").cogroup(points.groupBy("width", "shard", "block")).applyInArrow(_search(k), "query_id long, row long, vec_id long, score long")


def _merged_cells(sizes: dict[tuple[int, int], int], shard_rows: int) -> dict[tuple[int, int], int]:
    """Small neighbouring cells of one width share a shard number; a large cell has its own."""
    out: dict[tuple[int, int], int] = {}
    number, held, width = -1, 0, None
    for key in sorted(sizes):
        n = sizes[key]
        if key[0] != width or n > shard_rows or held + n > shard_rows:
            number, held, width = number + 1, 0, key[0]
        out[key] = number
        held += n
    return out
