"""Approximate nearest neighbours by inner product: balanced posting lists behind a graph of their centroids.

Method: centroids are fitted on a bounded sample, with a penalty on crowded
ones so that lists come out balanced.  Every vector goes to the list of its
nearest centroid, and a vector near a border also to further lists, where no
list chosen before is nearer to that centroid than the vector is.  Centroids
are found by best-first search over an in-memory graph (each one's nearest
others, a ring and random links).  A query opens the lists whose centroids are
at most ``ratio`` times as far as the nearest one; the ratio is calibrated on
the sample, so that ``TARGET`` of the sample's true neighbours are within.

Inner products become distances by one more coordinate: a vector gets
sqrt(M² - |x|²), where M is the greatest norm of all, and a query is scaled to
norm M and gets 0.  The nearest by that distance has the largest inner product.

Equal vectors are one entry of a list, with their smallest ids: of a group of
copies no others can be among k nearest, since ties go to smaller ids.  Rows of
a list and its queries are dealt into tiles of about ``PAGE`` rows and
``QBLOCK`` queries, so that no task holds a whole list, whatever its size; the
copies are those of a block join within the opened lists.  Scores are products
and sums in double precision on the original vectors.

Bounds: the sample has ``SAMPLE`` vectors, by a hash of the vector; the square
root of the number of distinct vectors gives the number of lists, ``MOST_LISTS``
at most, and so bounds what is broadcast (centroids, graph and list sizes).
All rows are in lists, and all that lie in opened lists are compared.

Defined results: vectors that are null, zero, of another length than the most
frequent one (the longer, if tied), or that hold nulls or non-finite components
take no part, nor do rows without an id.  Rows that repeat an id and vector
count once; an id with two vectors is a query with each.  Fewer candidates than
k are all returned.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SAMPLE = 16_384
MOST_LISTS = 2_048
PAGE, QBLOCK = 4_096, 512
TARGET = 0.965               # share of the sample's true neighbours that the calibrated ratio reaches
CALIBRATE = 512              # queries of the sample that the ratio is calibrated on
NEIGHBOURS = 20              # of each of these
REPLICAS, BORDER = 3, 1.1    # lists of a vector at most, and how much farther than the nearest one they may be
DEGREE, RANDOM_LINKS, ENTRIES = 16, 4, 8
WIDTH = 4                    # nodes that a search opens at a time
ASSIGN_BEAM = 32


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _balanced_centroids(x: np.ndarray, n: int, greatest: float, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k-means on the sphere of the lifted vectors; distances grow with a centroid's crowd in the rounds before."""
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    penalty = np.zeros(n)
    for _ in range(rounds):
        d = _squared(x, centres)
        near = np.argmin(d + penalty, axis=1)
        count = np.bincount(near, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        length = np.sqrt((total * total).sum(1))
        full &= length > 0
        centres[full] = total[full] * (greatest / length[full])[:, None]
        typical = float(np.median(d[np.arange(len(x)), near]))
        penalty = 0.5 * penalty + 0.25 * typical * (count * n / len(x) - 1)
    return centres


class Lists:
    """Centroids, their graph, and the calibrated search; small enough for every task."""

    def __init__(self, sample: np.ndarray, n_lists: int, greatest: float, n_rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.greatest, n = greatest, min(n_lists, len(sample))
        x = self.lifted(sample)
        self.centres = _balanced_centroids(x, n, greatest, rng).astype(np.float32)
        self.norms = (self.centres.astype(np.float64) ** 2).sum(1).astype(np.float32)
        self._link(rng)
        # the sample's nearest few stand where NEIGHBOURS of all rows do
        self._calibrate(sample, x, max(2, min(NEIGHBOURS, -(-NEIGHBOURS * len(sample) // n_rows))))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(self.greatest ** 2 - (v * v).sum(1), 0))
        return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)

    def lifted_queries(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        v = v * (self.greatest / np.sqrt((v * v).sum(1)))[:, None]
        return np.concatenate([v, np.zeros((len(v), 1))], axis=1).astype(np.float32)

    def _link(self, rng: np.random.Generator) -> None:
        n = len(self.centres)
        d = _squared(self.centres.astype(np.float64), self.centres.astype(np.float64))
        self.between = np.sqrt(d).astype(np.float32)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, :min(n - 1, DEGREE - RANDOM_LINKS - 1)]
        ring = np.empty(n, np.int64)
        order = rng.permutation(n)
        ring[order] = np.roll(order, -1)                                 # every centroid can be reached
        links = rng.integers(0, n, (n, RANDOM_LINKS))
        self.graph = np.concatenate([near, ring[:, None], links], axis=1).astype(np.int32)
        entries = [int(order[0])]
        while len(entries) < min(n, ENTRIES):                            # far from one another
            entries.append(int(np.argmax(self.between[:, entries].min(axis=1))))
        self.entries = np.array(entries, np.int32)

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) by best-first search of the graph, nearest first; the searches go in step.

        Unused places hold centroid 0 at an infinite distance.
        """
        n, b = len(self.centres), len(x)
        beam = min(beam, n)
        row = np.arange(b)[:, None]
        own = (x.astype(np.float64) ** 2).sum(1).astype(np.float32)[:, None]
        seen = np.zeros((b, n), bool)

        def distances(nodes):
            return np.maximum(own + self.norms[nodes] - 2 * np.einsum("bd,bkd->bk", x, self.centres[nodes]), 0)

        nodes = np.broadcast_to(self.entries, (b, len(self.entries)))
        seen[row, nodes] = True
        ids = np.zeros((b, beam), np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        far = distances(nodes)
        while True:
            ids = np.concatenate([ids, nodes], axis=1)
            dist = np.concatenate([dist, far], axis=1)
            done = np.concatenate([done, np.isinf(far)], axis=1)
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = ids[row, best], dist[row, best], done[row, best]
            pick = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]    # the nearest that are not open yet
            fresh = ~done[row, pick]
            if not fresh.any():
                return ids, dist
            done[row, pick] = True
            nodes = self.graph[ids[row, pick]].reshape(b, -1)
            nodes = np.where(np.repeat(fresh, self.graph.shape[1], axis=1), nodes, self.entries[0])
            nodes = np.sort(nodes, axis=1)
            old = seen[row, nodes]
            old[:, 1:] |= nodes[:, 1:] == nodes[:, :-1]
            seen[row, nodes] = True
            far = np.where(old, np.inf, distances(nodes)).astype(np.float32)

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, which of them hold the vector): the nearest one, and border lists."""
        ids, d2 = self.nearest(x, ASSIGN_BEAM)
        ids, dist = ids[:, :2 * REPLICAS], np.sqrt(d2[:, :2 * REPLICAS])
        keep = np.isfinite(dist) & (dist <= BORDER * dist[:, :1])
        for j in range(1, ids.shape[1]):
            for i in range(j):
                keep[:, j] &= ~(keep[:, i] & (self.between[ids[:, i], ids[:, j]] < dist[:, j]))
        return ids, keep & (np.cumsum(keep, axis=1) <= REPLICAS)

    def _calibrate(self, sample: np.ndarray, x: np.ndarray, neighbours: int) -> None:
        """The ratio and the beam, from true neighbours within the sample."""
        q = np.arange(min(CALIBRATE, len(sample)))
        scores = sample[q].astype(np.float64) @ sample.astype(np.float64).T
        scores[q, q] = -np.inf
        true = np.argsort(-scores, axis=1)[:, :max(1, min(neighbours, len(sample) - 1))]
        d = np.sqrt(_squared(self.lifted_queries(sample[q]).astype(np.float64), self.centres.astype(np.float64)))
        nearest = np.maximum(d.min(axis=1), 1e-12)
        ids, keep = self.assigned(x[true.ravel()])
        of = np.repeat(q, true.shape[1])
        need = np.where(keep, d[of[:, None], ids], np.inf).min(axis=1) / nearest[of]
        self.ratio = float(np.quantile(need, TARGET)) if len(need) else 1.0
        opened = (d <= self.ratio * nearest[:, None]).sum(axis=1)
        self.beam = min(len(self.centres), int(1.25 * opened.max()) + 2 * ENTRIES)

    def opened(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of each list to open: those within the ratio, and more while they hold fewer than ``least`` rows."""
        ids, d2 = self.nearest(self.lifted_queries(vectors), self.beam)
        held = np.cumsum(np.where(np.isfinite(d2), sizes[ids], 0), axis=1)
        keep = np.isfinite(d2) & ((d2 <= self.ratio ** 2 * d2[:, :1]) | (held - sizes[ids] < least))
        short = held[:, -1] < least
        keep[short] = False
        query, place = np.nonzero(keep)
        every = np.repeat(np.flatnonzero(short), len(self.centres))
        return (np.concatenate([query, every]),
                np.concatenate([ids[query, place], np.tile(np.arange(len(self.centres)), int(short.sum()))]))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part, without repeated rows."""
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    src = src.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
                     & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
                     & F.exists("vec", lambda x: x != 0))
    most = src.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return src.filter(F.size("vec") == (most.n if most else 0)).distinct()


class Index:
    """Posting lists of all vectors, written to the shared scratch folder; serves searches for up to ``k`` neighbours."""

    def __init__(self, rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding",
                 n_lists: int | None = None):
        self.spark, self.k = rows.sparkSession, k
        self.path = scratch_path(self.spark, "posting-lists")
        self.rows = usable(rows, vec_id, vector)
        # of equal vectors the k + 1 smallest ids: cut within the tasks first, so a group of copies never meets whole
        place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
        kept = self.rows.withColumn("place", place).filter(F.col("place") <= k + 1)
        (kept.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
         .select(F.monotonically_increasing_id().alias("entry"), "vec", "ids").write.parquet(f"{self.path}/entries"))
        self.entries = self.spark.read.parquet(f"{self.path}/entries")
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        self.n, greatest = self.entries.agg(F.count(F.lit(1)), F.max(norm)).first()
        if self.n:
            self.model = self._fit(n_lists or max(1, min(MOST_LISTS, round(self.n ** 0.5))), greatest)
            self._write_lists()

    def _fit(self, n_lists: int, greatest: float) -> bytes:
        """The pickled ``Lists`` of a bounded sample, fitted in one task."""
        n_rows = self.n

        def fit(batches):
            x = np.concatenate([_matrix(b.column(0)) for b in batches])
            yield pa.record_batch([pa.array([pickle.dumps(Lists(x, n_lists, greatest, n_rows))], pa.binary())], names=["model"])

        sample = self.entries.orderBy(F.xxhash64("vec"), "entry").limit(SAMPLE).select("vec")
        return sample.coalesce(1).mapInArrow(fit, "model binary").first().model

    def _write_lists(self) -> None:
        shared = self.spark.sparkContext.broadcast(self.model)

        def assign(batches):
            lists = pickle.loads(shared.value)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    b = batch.slice(lo, 1024)
                    ids, keep = lists.assigned(lists.lifted(_matrix(b.column(1))))
                    at, j = np.nonzero(keep)
                    rows = b.take(pa.array(at))
                    yield pa.record_batch([pa.array(ids[at, j], pa.int32()), *rows.columns], names=["list", "entry", "vec", "ids"])

        (self.entries.mapInArrow(assign, "list int, entry long, vec array<double>, ids array<long>")
         .write.parquet(f"{self.path}/lists"))
        self.lists = self.spark.read.parquet(f"{self.path}/lists")
        sizes = self.lists.groupBy("list").count().collect()               # MOST_LISTS rows at most
        self.sizes = np.zeros(MOST_LISTS, np.int64)
        self.sizes[[r["list"] for r in sizes]] = [r["count"] for r in sizes]

    def _tiles(self, opened: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows and queries of each list with the tiles (list, page, qblock) they belong to."""
        rows = self.spark.createDataFrame([(i, max(1, -(-int(n) // PAGE))) for i, n in enumerate(self.sizes) if n],
                                          "list int, pages int")
        blocks = opened.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QBLOCK).cast("int").alias("qblocks"))
        shape = F.broadcast(rows.join(blocks, "list"))                     # MOST_LISTS rows at most
        left = (self.lists.join(shape, "list").withColumn("page", F.pmod(F.xxhash64("entry"), "pages").cast("int"))
                .select("list", "page", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"), "vec", "ids"))
        right = (opened.join(shape, "list").withColumn("qblock", F.pmod(F.xxhash64("entry"), "qblocks").cast("int"))
                 .select("list", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), "qblock", "entry", "vec"))
        return left, right

    def search(self, queries: Column) -> DataFrame:
        """(query_id, rank, vec_id, score): the nearest found of each row that ``queries`` (a condition on vec_id) holds for."""
        k = self.k
        if not self.n:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = self.rows.filter(queries).select("vec_id", "vec").join(self.entries.select("vec", "entry"), "vec")
        path = scratch_path(self.spark, "neighbours")
        asked.select(F.col("vec_id").alias("query_id"), "entry").write.parquet(f"{path}/asked")
        asked = self.spark.read.parquet(f"{path}/asked")
        shared = self.spark.sparkContext.broadcast((self.model, self.sizes))

        def route(batches):
            model, sizes = shared.value
            lists = pickle.loads(model)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    b = batch.slice(lo, 256)
                    at, which = lists.opened(_matrix(b.column(1)), sizes, REPLICAS * (k + 1))
                    yield pa.record_batch([pa.array(which, pa.int32()), *b.take(pa.array(at)).columns], names=["list", "entry", "vec"])

        def compare(key, left, right):
            x, q = _matrix(left.column("vec").combine_chunks()), _matrix(right.column("vec").combine_chunks())
            held = left.column("ids").combine_chunks()
            ids, at = held.flatten().to_numpy(), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
            out_n, out_id = [], []
            if len(x) and len(q):
                rough = q @ x.T
                most = min(k + 1, len(x))
                floor = np.partition(rough, len(x) - most, axis=1)[:, len(x) - most]
                slack = 1e-9 * (1 + np.abs(rough).max(axis=1))
                for i in range(len(q)):
                    near = np.flatnonzero(rough[i] >= floor[i] - slack[i])
                    score = (x[near] * q[i]).sum(axis=1)        # in the same order of summation wherever the row lies
                    n = at[near + 1] - at[near]
                    of = np.repeat(-score, n)
                    who = ids[np.arange(int(n.sum())) + np.repeat(at[near] - np.cumsum(n) + n, n)]
                    first = np.lexsort((who, of))[:k + 1]
                    out_n.append(of[first])
                    out_id.append(who[first])
            ends = pa.array(np.concatenate([[0], np.cumsum(list(map(len, out_n)))]).astype(np.int32), pa.int32())
            names = right.column("entry").combine_chunks() if len(out_n) else pa.array([], pa.int64())
            return pa.table({"entry": names,
                             "far": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *out_n]))),
                             "who": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *out_id])))})

        vectors = self.entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "vec")
        vectors.mapInArrow(route, "list int, entry long, vec array<double>").write.parquet(f"{path}/opened")
        left, right = self._tiles(self.spark.read.parquet(f"{path}/opened"))
        tile = ["list", "page", "qblock"]
        found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
            compare, "entry long, far array<double>, who array<long>")
        # a query's k + 1 best of each tile; replicas have equal entries, so the first REPLICAS * (k + 1) hold k + 1 others
        hits = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("far", "who"))))
        hits = F.slice(F.array_distinct(F.slice(hits, 1, REPLICAS * (k + 1))), 1, k + 1)
        best = found.groupBy("entry").agg(hits.alias("hits"))
        out = asked.join(best, "entry").select("query_id", F.posexplode(F.slice(
            F.filter("hits", lambda h: h["who"] != F.col("query_id")), 1, k)).alias("place", "hit"))
        return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.who").alias("vec_id"),
                          (F.lit(0.0) - F.col("hit.far")).alias("score"))


def nearest(spark: SparkSession, rows: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id",
            vector: str = "embedding", n_lists: int | None = None) -> DataFrame:
    """Index all rows and search for those that ``queries`` (a condition on vec_id) holds for."""
    return Index(rows, k, vec_id, vector, n_lists).search(queries)
