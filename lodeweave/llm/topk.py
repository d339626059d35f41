"""Exact top-k search by inner product, with pivot-table elimination.

Every vector's distances to a fixed set of pivots are computed once and kept in a table.
For a query and a candidate the largest difference of their pivot distances is a lower
bound d of their own distance, so (|q|^2 + |c|^2 - d^2) / 2 is an upper bound of the inner
product.

Candidates are dealt by their nearest pivot into cells, of which the table gives the range
of every pivot distance; so a whole cell has a bound as well. A query first meets one block
of its own cell, and then, with the k-th score found there, only the cells whose bound
reaches it. In a block, pivots are used in rounds as long as they eliminate candidates;
what is left is evaluated in order of its bound until that falls below the k-th score.

Defined results: vectors that are null or hold nulls or non-finite values take no part,
nor do rows with a null vec_id; every other row is a candidate for every row but itself,
and rows with equal ids are rows of their own; ties go to the smaller vec_id; vectors of
different lengths meet as if the shorter ended in zeros; scores beyond a long are ranked
exactly and given as the nearest long; an empty table gives an empty result; other
columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.shared import tidy, written

PIVOTS = 64
#: Vectors from which the pivots are chosen; the result doesn't depend on them.
PIVOT_SAMPLE = 4000
#: Rows of a block. A cell has about CELL_ROWS of them or more, and there are as many cells as pivots at most.
CANDIDATES, QUERIES, CELL_ROWS = 16_384, 4_096, 4_096
#: Inner products below this are whole numbers that doubles hold exactly, sums on the way included.
EXACT = 1 << 52
#: Queries that are bounded together, pivots of a round, and candidates that are evaluated at a time.
TOGETHER, ROUND, STEP = 32, 4, 512
#: A round of pivots that eliminates less than this share of what is left is the last one.
WORTH = 1 / 16


def whole_numbers(embedding: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of every component."""
    return F.transform(embedding, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as int64, with zeros behind those that are shorter."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    out = np.zeros((n, dim), np.int64)
    if n:
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far from one another: each next pivot is the vector farthest from those chosen."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    x = sample.astype(np.float64)
    chosen = [0]
    gap = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(v - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(v), 0))


def upper(q2: np.ndarray, c2: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest inner product at squared lengths q2, c2 and a distance of at least low; rounding moves distances by less than what is added."""
    return (q2 + c2 - low * low) / 2 + 1e-9 * (q2 + c2) + 1.0


def _plain(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """Each query's k best in Python's integers, for components that doubles can't hold."""
    out: tuple[list, list, list] = ([], [], [])
    for v, row in zip(q.astype(object), q_rows.tolist(), strict=True):
        scored = sorted((-int(v @ w), i) for w, i, r in zip(c.astype(object), c_ids.tolist(), c_rows.tolist(), strict=True) if r != row)
        for score, i in scored[:k]:
            for column, x in zip(out, (row, i, max(-(1 << 63), min((1 << 63) - 1, -score))), strict=True):
                column.append(x)
    return *out, len(q) * len(c)


def block_best(q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, pivots: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """Each query's k best candidates of one block, as (query rows, vec_ids, scores), and how many pairs were evaluated.

    floor: scores that a query has k times already; smaller ones needn't be found.
    """
    if not len(q) or not len(c):
        return [], [], [], 0
    largest = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (q, c)]  # Python's integers: the least long has no positive twin
    most = max(1, q.shape[1]) * max(largest[0] * largest[1], largest[0] ** 2, largest[1] ** 2)
    if most >= EXACT:
        return _plain(q, q_rows, c, c_rows, c_ids, k)
    if most.bit_length() + len(c).bit_length() > 62:  # a score and a place don't fit into one number: fewer candidates at a time
        half = len(c) // 2
        parts = [block_best(q, q_rows, floor, c[s], c_rows[s], c_ids[s], pivots, k) for s in (slice(0, half), slice(half, None))]
        return tuple(a + b for a, b in zip(*parts, strict=True))
    order = np.argsort(c_ids, kind="stable")
    c, c_rows, c_ids = c[order].astype(np.float64), c_rows[order], c_ids[order]
    c2, q2 = np.einsum("ij,ij->i", c, c), np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))
    c_far, q_far = np.ascontiguousarray(distances(c, pivots).T), distances(q.astype(np.float64), pivots)
    if len(pivots):  # queries that are near the same pivot ask for much the same candidates
        alike = np.argsort(q_far.argmin(axis=1), kind="stable")
        q, q_rows, floor, q2, q_far = q[alike], q_rows[alike], floor[alike], q2[alike], q_far[alike]
    shift = int(len(c)).bit_length()
    nothing = np.iinfo(np.int64).min
    rows, ids, scores, seen = [], [], [], 0
    for lo in range(0, len(q), TOGETHER):
        part = q[lo : lo + TOGETHER].astype(np.float64)
        n, far, least = len(part), q_far[lo : lo + TOGETHER], np.maximum(floor[lo : lo + TOGETHER], -1e300)
        low = np.zeros((n, len(c)))
        bound = upper(q2[lo : lo + n, None], c2[None], low)
        alive = np.count_nonzero(bound >= least[:, None])
        for p in range(0, len(pivots), ROUND):
            for j in range(p, min(p + ROUND, len(pivots))):
                np.maximum(low, np.abs(c_far[j][None] - far[:, j : j + 1]), out=low)
            bound = upper(q2[lo : lo + n, None], c2[None], low)
            left = np.count_nonzero(bound >= least[:, None])
            if alive - left < WORTH * alive:
                break
            alive = left
        bound[q_rows[lo : lo + n, None] == c_rows[None]] = -np.inf
        # Scores and places in one number, so that of equal scores the smaller vec_id is larger.
        best = np.full((n, k), nothing)
        by_bound = np.argsort(-bound.max(axis=0), kind="stable")
        for at in range(0, len(c), STEP):
            some = by_bound[at : at + STEP]
            asked = np.flatnonzero((bound[:, some] >= least[:, None]).any(axis=1))
            some = some[(bound[asked][:, some] >= least[asked, None]).any(axis=0)] if len(asked) else some[:0]
            if not len(some):
                continue
            key = (np.rint(part[asked] @ c[some].T).astype(np.int64) << shift) + (len(c) - 1 - some)
            key[bound[asked][:, some] < least[asked, None]] = nothing  # also what is no candidate at all
            seen += key.size
            best[asked] = np.partition(np.concatenate([best[asked], key], axis=1), -k, axis=1)[:, -k:]
            least = np.maximum(least, np.where(best.min(axis=1) > nothing, best.min(axis=1) >> shift, -1e300))
        which, where = np.nonzero(best > nothing)
        key = best[which, where]
        rows += q_rows[lo + which].tolist()
        ids += c_ids[len(c) - 1 - (key & ((1 << shift) - 1))].tolist()
        scores += (key >> shift).tolist()
    return rows, ids, scores, seen


def search(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, n_candidates: int = CANDIDATES, n_queries: int = QUERIES, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, vec_id, score) over whole-number vectors in column v, and one row with the share of all pairs that were evaluated.

    is_query is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows, "vectors")  # with its row numbers
    total, asked, dim = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    dim = max(int(dim or 0), 1)
    sample = [r.v for r in rows.orderBy(F.xxhash64("row"), "row").limit(PIVOT_SAMPLE).select("v").collect()]
    chosen = choose_pivots(matrix(pa.array(sample, pa.list_(pa.int64())), dim), pivots)
    cells = max(1, min(len(chosen), -(-total // cell_rows)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dim).astype(np.float64)
            far = distances(v, chosen)
            cell = far[:, :cells].argmin(axis=1) if far.shape[1] else np.zeros(len(v), np.int64)
            far = np.concatenate([far, np.einsum("ij,ij->i", v, v)[:, None]], axis=1)  # the squared length goes last
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), lists], [*batch.schema.names, "cell", "far"])

    table = written(rows.mapInArrow(tidy(measured), "row long, vec_id long, v array<long>, asks boolean, cell long, far array<double>"), "pivots")
    ends = [f(F.col("far")[j]).alias(f"{name}{j}") for j in range(len(chosen) + 1) for name, f in (("min", F.min), ("max", F.max))]
    # A row for each cell, of which there are as many as pivots at most.
    known = table.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("n_asks"), *ends).collect()
    count, asks = {r.cell: r.n for r in known}, {r.cell: r.n_asks for r in known}
    ids = np.array(sorted(count), np.int64)
    by_cell = {r.cell: r for r in known}
    nearest, farthest = (np.array([[by_cell[c][f"{name}{j}"] for j in range(len(chosen))] for c in ids.tolist()]).reshape(len(ids), len(chosen)) for name in ("min", "max"))
    longest = np.array([by_cell[c][f"max{len(chosen)}"] for c in ids.tolist()])
    blocks = [-(-count.get(c, 0) // n_candidates) or 1 for c in range(cells)]
    per_cell = lambda values: F.array(*[F.lit(int(x)).cast("long") for x in values])[F.col("cell").cast("int")]
    block_of = F.pmod(F.xxhash64("row", F.lit(2)), F.col("blocks"))
    candidates = table.select("row", "vec_id", "v", "cell", per_cell(blocks).alias("blocks")).withColumn("block", block_of)
    kind = "row long, vec_id long, score long"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = matrix(left.column("v"), dim), matrix(right.column("v"), dim)
        floor = left.column("floor").to_numpy().astype(np.float64)
        found = block_best(q, left.column("row").to_numpy(), floor, c, right.column("row").to_numpy(), right.column("vec_id").to_numpy(), chosen, k)
        # A row without a query tells how many pairs were evaluated.
        return pa.table({name: pa.array([*values, more], pa.int64()) for name, values, more in zip(("row", "vec_id", "score"), found, (-1, -1, found[3]), strict=False)})

    # First every query meets one block of its own cell.
    groups = [max(1, -(-asks.get(c, 0) // (blocks[c] * n_queries))) for c in range(cells)]
    spread = F.explode(F.sequence(F.lit(0).cast("long"), per_cell(groups) - 1))
    queries = table.where("asks").withColumns({"floor": F.lit(-float("inf")), "blocks": per_cell(blocks)}).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")))
    near = queries.select("row", "v", "floor", "cell", "block", F.pmod(F.xxhash64("row", F.lit(3)), per_cell(groups)).alias("group"))
    keys = ["cell", "block", "group"]
    first = near.groupBy(*keys).cogroup(candidates.withColumn("group", spread).groupBy(*keys)).applyInArrow(best, kind)
    first = written(first, "near")
    reached = first.where("row >= 0").groupBy(F.col("row").alias("_row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("score"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every cell that may hold something better."""
        for batch in batches:
            far = np.array(batch.column("far").to_pylist(), np.float64).reshape(batch.num_rows, len(chosen) + 1)
            floor = batch.column("floor").to_numpy()
            low = np.zeros((batch.num_rows, len(ids)))
            for j in range(len(chosen)):
                own = far[:, j : j + 1]
                np.maximum(low, np.maximum(own - farthest[None, :, j], nearest[None, :, j] - own), out=low)
            which, to = np.nonzero(upper(far[:, -1:], longest[None], low) >= floor[:, None])
            rest = pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "v", "floor", "cell", "block")], ["row", "v", "floor", "from", "seen"]).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ids[to])], [*rest.schema.names, "cell"])

    floors = queries.join(reached, F.col("row") == F.col("_row"), "left").withColumn("floor", F.coalesce(F.col("score").cast("double"), F.lit(-float("inf"))))
    to = floors.select("row", "v", "floor", "cell", "block", "far").mapInArrow(tidy(routed), "row long, v array<long>, floor double, from long, seen long, cell long")
    to = written(to, "routed")
    # At most as many rows as there are pairs of cells.
    ways = [(r["from"], r.cell, r.n) for r in to.groupBy("from", "cell").agg(F.count("*").alias("n")).collect()]
    ways = spark.createDataFrame([(a, b, -(-n // n_queries)) for a, b, n in ways], "from long, _cell long, groups long")
    to = to.join(F.broadcast(ways.withColumnRenamed("from", "_from")), (F.col("from") == F.col("_from")) & (F.col("cell") == F.col("_cell")))
    to = to.withColumns({"group": F.pmod(F.xxhash64("row", F.lit(5)), F.col("groups")), "block": F.explode(F.sequence(F.lit(0).cast("long"), per_cell(blocks) - 1))})
    to = to.where((F.col("cell") != F.col("from")) | (F.col("block") != F.col("seen"))).select("row", "v", "floor", "from", "cell", "block", "group")
    others = candidates.join(F.broadcast(ways), F.col("cell") == F.col("_cell"))
    others = others.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("row", "vec_id", "v", "from", "cell", "block", "group")
    keys = ["from", *keys]
    second = to.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(best, kind)
    found = first.unionByName(written(second, "far"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id")))
    ranked = found.where("row >= 0").withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("row", "_row")
    names = table.where("asks").select("row", F.col("vec_id").alias("query_id"))
    result = ranked.join(names, F.col("_row") == F.col("row")).select("query_id", "rank", "vec_id", "score")
    pairs = max(1, asked * (total - 1))
    return result, found.where("row < 0").agg((F.coalesce(F.sum("score"), F.lit(0)) / pairs).alias("evaluated"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score): `search` without its measure."""
    return search(vectors, is_query, k, **sizes)[0]
