"""Exact top-k inner-product search by a Voronoi kNN join.

A vector x with |x|^2 <= M becomes (x, sqrt(M - |x|^2)) and a query q becomes (q, 0): the squared
distance is then |q|^2 + M - 2 q.x, so the nearest vectors are those with the highest product, and
the triangle inequality bounds what a cell of data can hold for a group of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from joinloom.llm.common import pick, written

TOP = 5
SCALE = 256
#: Pivots: the root of the number of vectors, within these limits; and vectors drawn to choose them
#: and to bound the queries' distances with.
LEAST_PIVOTS, MOST_PIVOTS = 8, 256
DRAWN = 2048
#: Data rows and query rows of one local solve, about.
DATA_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Distances are floats: bounds are widened by this share of the greatest length.
SLOP = 1e-6


@dataclass
class Pivots:
    points: np.ndarray  # with the extra coordinate
    drawn: np.ndarray  # vectors of the sample, as integers
    ids: np.ndarray  # and their ids
    most: float  # M
    dim: int
    k: int

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        norms = np.einsum("ij,ij->i", x, x)
        return np.column_stack([x, np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.most - norms))])

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Of each vector to each pivot."""
        y = self.lift(x, query)
        square = np.einsum("ij,ij->i", y, y)[:, None] + np.einsum("ij,ij->i", self.points, self.points) - 2 * y @ self.points.T
        return np.sqrt(np.maximum(0.0, square))

    def reach(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A bound on each query's distance to its k-th nearest, from the drawn vectors but its own."""
        if not len(x):
            return np.zeros(0)
        scores = x @ self.drawn.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        if scores.shape[1] < self.k:
            return np.full(len(x), np.inf)
        kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
        return np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", x, x) + self.most - 2 * kth))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as floats; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _unpack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _pack(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())


def _gatherer(model: Pivots):
    """Placed query rows (id, v, q_cell) to (cell, pivot, near, far): the least and the greatest distance to
    each pivot at which a vector can be among the k nearest of one of the cell's queries."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.points)
        near, far = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        count = np.zeros(n, np.int64)
        for batch in batches:
            x, cell = _unpack(batch.column(1), model.dim).astype(np.float64), batch.column(2).to_numpy()
            d = model.distances(x, True)
            reach = model.reach(x, batch.column(0).to_numpy())[:, None]
            np.minimum.at(near, cell, d - reach)
            np.maximum.at(far, cell, d + reach)
            count += np.bincount(cell, minlength=n)
        cells = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(cells, n).astype(np.int32)), pa.array(np.tile(np.arange(n), len(cells)).astype(np.int32)), pa.array(near[cells].ravel()), pa.array(far[cells].ravel()), pa.array(np.repeat(count[cells], n))],
            names=["cell", "pivot", "near", "far", "n"],
        )

    return gather


def _placer(model: Pivots):
    """Rows (id, v, asks) to (id, asks, cell, distance to its pivot, v packed, q_cell): a vector's cell as
    data, and as a query where it is one."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, asks = _vectors(batch.column(1), model.dim), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            d = model.distances(x, False)
            cell = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            q_cell = np.full(len(x), -1, np.int32)
            if asks.any():
                q_cell[asks] = model.distances(x[asks], True).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), _pack(x), pa.array(q_cell)], names=["id", "asks", "cell", "d", "v", "q_cell"])

    return place


def _solver(model: Pivots):
    """The k best of one block of data for each query of one block: products by blocks, exact in
    whole numbers."""
    # No partial sum of a product exceeds M, by Cauchy and Schwarz, so these floats are exact.
    dtype = np.float32 if model.most < 2**24 else np.float64 if model.most < 2**53 else object
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solve(key: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
        qid, did = queries.column("id").to_numpy(), data.column("id").to_numpy()
        order = np.argsort(did, kind="stable")  # so that of equal scores the smaller id comes first
        did = did[order]
        q = _unpack(queries.column("v"), model.dim).astype(dtype)
        x = _unpack(data.column("v"), model.dim)[order].astype(dtype)
        k, out = min(model.k, len(did)), [schema.empty_table()]
        for at in range(0, len(q) if k else 0, 256):
            own = qid[at : at + 256]
            score = q[at : at + 256] @ x.T
            score[own[:, None] == did[None, :]] = -np.inf
            if model.most * (len(did) + 1) < 2**52:  # score and place as one exact number
                best = np.argpartition(np.arange(len(did)) - score.astype(np.float64) * len(did), k - 1, axis=1)[:, :k]
            else:
                best = np.array([sorted(range(len(did)), key=lambda c: (-r[c], c))[:k] for r in score])
            row, col = np.repeat(np.arange(len(own)), k), best.ravel()
            other = did[col] != own[row]
            row, col = row[other], col[other]
            out.append(pa.table({"query_id": own[row], "vec_id": did[col], "score": score[row, col].astype(np.int64)}, schema=schema))
        return pa.concat_tables(out)

    return solve


def groups_of(counts: dict[int, int], points: np.ndarray, block: int) -> dict[int, list[int]]:
    """Query cells in groups of about `block` queries: each group grows from the largest cell left by
    the cells whose pivots are nearest."""
    left, out = dict(counts), {}
    while left:
        first = max(left, key=lambda c: (left[c], -c))
        near = sorted(left, key=lambda c: (float(np.sum((points[c] - points[first]) ** 2)), c))
        own, size = [], 0
        for c in near:
            if own and size + left[c] > block:
                break
            own.append(c)
            size += left[c]
        out[len(out)] = own
        for c in own:
            del left[c]
    return out


def top_products(spark: SparkSession, vectors: DataFrame, is_query, k: int = TOP, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors(id, v array of long), queries those rows for which is_query(id column) holds, to
    (query_id, rank int, vec_id, score long): the k rows with the highest inner products, of other ids
    than the query's, ties to the smaller id; all if there are fewer. Scores are to fit a long.

    The driver holds up to DRAWN sampled vectors, of which up to MOST_PIVOTS are pivots, and matrices
    of pivots by pivots: for each cell of queries and each pivot the distances at which data can
    matter, for each cell of data its size and extent. Cells of queries are joined into groups; a data
    row goes to those groups alone for which its distance to its pivot lies within the bounds. Data
    cells and query groups are cut into blocks by hashes of ids, so that a cell that holds most rows
    is many tasks, and each pair of a query block and a data block is solved on its own. The blocks'
    best, k a query, are merged at last.

    Vectors of unequal lengths score as if zeros followed the shorter. Rows of one id are
    one query, which a candidate meets once with each different vector, but separate candidates. No vectors or no queries: no rows."""
    seen = Observation()
    longest = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    vectors, _ = written(spark, vectors.select("id", "v").observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), longest.alias("most")), "vectors")
    shape = seen.get
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, most = shape["dim"], float(shape["most"] or 0)
    drawn = vectors.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(DRAWN).collect()
    sample = np.zeros((len(drawn), dim))
    for row, x in zip(drawn, sample, strict=True):
        x[: len(row["v"])] = row["v"]
    want = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(shape["n"] ** 0.5)))
    model = Pivots(np.zeros((0, dim + 1)), sample, np.array([r["id"] for r in drawn], np.int64), most, dim, k)
    model.points = np.unique(model.lift(sample, False), axis=0)
    model.points = model.points[np.random.default_rng(0).permutation(len(model.points))[:want]]

    # Each row is placed once, as data and as the query that it may be, and written with its vector packed,
    # queries apart.
    asks = F.coalesce(is_query(F.col("id")), F.lit(False)).alias("asks")
    data, _ = written(spark, vectors.select("id", "v", asks).mapInArrow(_placer(model), "id long, asks boolean, cell int, d double, v binary, q_cell int"), "placed", by="asks")
    queries, _ = written(spark, data.where("asks").select("id", "v", "q_cell").dropDuplicates(["id", "v"]), "queries")
    bounds = queries.mapInArrow(_gatherer(model), "cell int, pivot int, near double, far double, n long").groupBy("cell", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n")).collect()
    if not bounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = {r["cell"]: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}

    counts = {r["cell"]: r["n"] for r in bounds}
    slop = SLOP * (1 + most**0.5)
    groups = groups_of(counts, model.points, query_block)
    of = {c: g for g, own in groups.items() for c in own}
    span: dict[tuple[int, int], tuple[float, float]] = {}
    for r in bounds:
        key = (of[r["cell"]], r["pivot"])
        low, high = span.get(key, (np.inf, -np.inf))
        span[key] = min(low, r["near"] - slop), max(high, r["far"] + slop)
    met = [(g, c, low, high) for (g, c), (low, high) in sorted(span.items()) if c in cells and low <= cells[c]["high"] and high >= cells[c]["low"]]
    pieces = [(g, c, low, high, -(-cells[c]["n"] // data_block), -(-sum(counts[x] for x in groups[g]) // query_block)) for g, c, low, high in met]
    routes = spark.createDataFrame(pieces, "g int, cell int, low double, high double, d_parts int, q_parts int")
    routes = F.broadcast(routes)  # at most MOST_PIVOTS squared rows

    # A query block and a data block meet under (g, q_part, cell, d_part).
    sent = data.join(routes, "cell").where("d >= low and d <= high").withColumn("d_part", F.pmod(F.xxhash64("id", "v"), F.col("d_parts")).cast("int"))
    sent = sent.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("g", "q_part", "cell", "d_part", "id", "v")
    member = F.broadcast(spark.createDataFrame(sorted(of.items()), "q_cell int, g int"))  # at most MOST_PIVOTS rows
    asked = queries.join(member, "q_cell").join(routes, "g").withColumn("q_part", F.pmod(F.xxhash64("id", "v"), F.col("q_parts")).cast("int"))
    asked = asked.withColumn("d_part", F.explode(F.sequence(F.lit(0), F.col("d_parts") - 1))).select("g", "q_part", "cell", "d_part", "id", "v")
    key = ["g", "q_part", "cell", "d_part"]
    best = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_solver(model), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """embeddings(vec_id, embedding) to (id, v): floor(scale * x) of every component x as a double. Rows
    without an id, and vectors that are null or hold null or non-finite components, are left out."""
    rows = pick(embeddings, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    whole = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.transform(whole, lambda x: F.floor(x * scale).cast("long")).alias("v"))
