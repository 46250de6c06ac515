"""Operator 8: exact top-k inner products by ball trees, one for each shard.

Components become whole numbers, so scores are exact (up to 2^53). Rows are dealt to shards by a hash, as many to one as
``SHARD_BYTES`` of memory hold; the task of a shard builds a ball tree and blocks of queries pass it. They
walk the tree best node first: a node's upper bound for a query is its centre's inner product plus its
radius times the query's length, and nodes that cannot reach the query's k-th score any more are left
out. Every query first searches one shard; the k-th score found there is shared with its searches
of all the other shards, which start from it.

All queries meet all rows, by nature; a shard's rows are sent once for each ``BLOCK_QUERIES`` queries and a query once
for each shard, so what moves is some N/3,000,000 times the N rows.

Scores descend; ties go to the smaller vec_id. Rows with a null id, a null or empty vector, or a vector
with a null or non-finite component take no part. Rows with equal ids are rows of their own: each is a candidate for all
others, and if their id is a query's, each asks and gets its own ranks. Queries only meet vectors of their own length. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a shard: at most so many bytes; rows that are worth a shard of their own where cores would be idle.
SHARD_BYTES, LEAST_ROWS = 1 << 25, 4_096
#: Queries that meet a shard in one task, and those that walk its tree together.
BLOCK_QUERIES, WALK_QUERIES = 65_536, 1_024
LEAF = 192
NOTHING = -(1 << 62)


def quantized(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


class BallTree:
    """Rows sorted into a binary tree; node i covers rows [start, end) and has the children left, right (0: a leaf)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.centre, self.radius, self.span, self.children, self.least_id = [], [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = vectors[order[a:b]]
            centre = own.mean(axis=0)
            node = len(self.span)
            if parent >= 0:
                self.children[parent][side] = node
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            self.span.append((a, b))
            self.children.append([0, 0])
            self.least_id.append(int(ids[order[a:b]].min()))
            if b - a > LEAF and self.radius[-1] > 0:
                far = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
                farther = own[((own - far) ** 2).sum(axis=1).argmax()]
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (farther - far), middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.centre, self.radius, self.least_id = np.array(self.centre), np.array(self.radius), np.array(self.least_id)

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each a row of k for each query, of the best other rows with a score of at least ``kth``; NOTHING fills up."""
        n = len(query_rows)
        scores, found = np.full((n, k), NOTHING), np.full((n, k), np.iinfo(np.int64).max)
        kth = kth.copy()
        length = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centre.T + length[:, None] * self.radius
        bounds += 1e-9 * np.abs(bounds) + 1e-6
        heap = [(-float(bounds[:, 0].max()), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            reach = bounds[:, node] >= kth
            # Equal scores only help with a smaller id.
            reach &= ~((bounds[:, node] < kth + 1) & (scores[:, -1] == kth) & (self.least_id[node] > found[:, -1]))
            active = np.flatnonzero(reach)
            if not len(active):
                continue
            if self.children[node][0]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-float(bounds[active, child].max()), child))
                continue
            a, b = self.span[node]
            new = np.rint(queries[active] @ self.vectors[a:b].T).astype(np.int64)
            ids = self.ids[a:b]
            new[query_rows[active][:, None] == self.rows[a:b]] = NOTHING
            better = new.max(axis=1) >= kth[active]
            active, new = active[better], new[better]
            if not len(active):
                continue
            all_scores = np.concatenate([scores[active], new], axis=1)
            all_ids = np.concatenate([found[active], np.broadcast_to(ids, new.shape)], axis=1)
            best = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
            scores[active] = np.take_along_axis(all_scores, best, axis=1)
            found[active] = np.take_along_axis(all_ids, best, axis=1)
            kth[active] = np.maximum(kth[active], scores[active, -1])
        return scores, found


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def search_shards(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Searches each (width, shard, block) that occurs in both. rows: these, row, vec_id, q; queries: these, row, vec_id, q, kth."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            tree = BallTree(left.column("row").to_numpy(), left.column("vec_id").to_numpy(), matrix(left.column("q"), width))
            for at in range(0, right.num_rows, WALK_QUERIES):
                asked = right.slice(at, WALK_QUERIES)
                own = asked.column("row").to_numpy()
                scores, found = tree.search(own, matrix(asked.column("q"), width), k, asked.column("kth").to_numpy())
                some = scores > NOTHING
                for name, values in (("query_row", np.repeat(own, k)), ("query_id", np.repeat(asked.column("vec_id").to_numpy(), k)), ("vec_id", found.ravel()), ("score", scores.ravel())):
                    out[name].append(values[some.ravel()])
        return pa.table({name: pa.array(np.concatenate(x) if x else [], pa.int64()) for name, x in out.items()})

    keys = ["width", "shard", "block"]
    queries = queries.select([F.col(c).alias(f"asked_{c}") for c in queries.columns]).toDF(*queries.columns)
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of each row for which ``is_query`` holds (a condition on vec_id)."""
    own = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        .select("vec_id", quantized(F.col("v"), factor).alias("q"), F.size("v").alias("width"), F.monotonically_increasing_id().alias("row"))
    )
    own = stored(own)  # which also keeps the numbers of the rows
    cores = own.sparkSession.sparkContext.defaultParallelism
    held = F.greatest(F.lit(1), F.lit(SHARD_BYTES) / (8 * F.col("width")))
    shards = F.greatest(F.ceil(F.col("n") / held), F.least(F.lit(cores), F.floor(F.col("n") / LEAST_ROWS)), F.lit(1)).cast("int")
    blocks = F.greatest(F.ceil(F.col("asked") / BLOCK_QUERIES), F.lit(1)).cast("int")
    sizes = own.groupBy("width").agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).where("asked > 0")
    sizes = stored(sizes.select("width", shards.alias("shards"), blocks.alias("blocks")))
    spread = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = own.join(sizes, "width").withColumn("shard", spread("shards", 1))
    asked = own.where(is_query).join(sizes, "width").withColumn("block", spread("blocks", 2)).withColumn("home", F.pmod(F.col("block") + spread("shards", 3), F.col("shards")).cast("int"))
    none = F.lit(int(NOTHING)).cast("long")
    names = ["width", "shard", "block", "row", "vec_id", "q"]
    rows = dealt.withColumn("block", up_to("blocks")).select(*names)
    # First each query in one shard.
    first = stored(search_shards(rows, asked.withColumn("shard", F.col("home")).withColumn("kth", none).select(*names, "kth"), k))
    kth = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query_row", F.when(F.col("n") >= k, F.col("least")).alias("kth"))
    shared = asked.join(kth, asked["row"] == F.col("query_row"), "left").withColumn("kth", F.coalesce("kth", none))
    others = shared.withColumn("shard", up_to("shards")).where("shard <> home").select(*names, "kth")
    found = first.unionByName(search_shards(rows, others, k))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
