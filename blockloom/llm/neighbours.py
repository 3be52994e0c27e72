"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, leaves visited best bin first, in the order
of a priority queue, as many of them as calibrated recall needs."""

from __future__ import annotations

import contextlib
import hashlib
import pickle
import uuid
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialise, shared_dir, writing

K, EVERY = 20, 20
#: The tree on the driver is fitted on rows chosen by a hash: SAMPLE, or a part in ROWS_EACH of a larger table, up to MOST_SAMPLE
#: rows and SAMPLE_BYTES. A node is split into BRANCH until it stands for LEAF_ROWS rows of the table or fewer, or has LEAF rows of
#: the sample. A leaf that still gets over REFIT rows has a tree of its own, fitted in a task on about SAMPLE of them.
SAMPLE, ROWS_EACH, MOST_SAMPLE, SAMPLE_BYTES = 16_384, 32, 65_536, 64 << 20
BRANCH, LEAF, LEAF_ROWS, REFIT, ROUNDS = 8, 16, 1024, 16_384, 8
#: Recall wanted, and on how many queries (chosen by a hash, compared with all rows) it is calibrated.
RECALL, PROBES = 0.95, 256
#: Vectors of neighbouring leaves that are read together, and queries that one task holds; rows that pass one copy of a leaf's tree.
BLOCK, PASS = 4096, 65_536
#: Queries that are compared with a block at once; numbers that a step may hold besides (a matrix of so many doubles).
STRIP, NUMBERS = 128, 2 << 20
#: A table with a row for each leaf of a leaf's tree is broadcast up to this many rows, joined otherwise.
SMALL = 65_536
#: The id of a place in a list that is still free.
FREE = np.iinfo(np.int64).max


class Tree:
    """centers[i] and children[i] of each node; leaf[i] is its leaf number or -1."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, least: int = LEAF, seed: int = 7) -> None:
        self.centers, self.children, self.leaf, self.leaves = [sample.mean(axis=0)], [[]], [-1], 0
        rng, todo = np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, x = todo.pop()
            groups = self._split(x, branch, rng) if len(x) > least else []
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for part in groups:
                self.children[node].append(len(self.centers))
                self.centers.append(part.mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
                todo.append((len(self.centers) - 1, part))
        self.centers = np.array(self.centers)
        self.at = np.argsort([leaf if leaf >= 0 else len(self.leaf) for leaf in self.leaf], kind="stable")[: self.leaves]  # the node of each leaf
        self.levels, now = [], [0]  # (nodes, parents) of each level under the root
        while now := [(child, node) for node in now for child in self.children[node]]:
            self.levels.append(np.array(now).T)
            now = [child for child, _ in now]

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng) -> list[np.ndarray]:
        c = x[rng.choice(len(x), branch, replace=False)] if len(x) > branch else x
        for _ in range(ROUNDS):
            to = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
            c = np.array([x[to == k].mean(axis=0) if (to == k).any() else c[k] for k in range(len(c))])
        return [x[to == k] for k in range(len(c)) if (to == k).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest center at each level."""
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centers[self.children[node]]
            to = ((c * c).sum(axis=1) - 2 * (x[rows] @ c.T)).argmin(axis=1)
            todo += [(child, rows[to == k]) for k, child in enumerate(self.children[node])]
        return out

    def _promise(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both (queries, leaves): a priority queue that holds nodes by the product of the query with their center gives a leaf
        when the least product on its path comes (the first); leaves of one such node come by their own (the second)."""
        own = q @ self.centers.T
        least = np.full(own.shape, np.inf)
        for nodes, parents in self.levels:
            least[:, nodes] = np.minimum(own[:, nodes], least[:, parents])
        return least[:, self.at], own[:, self.at]

    def places(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves): the place of each leaf in the order of a query's visits, the most promising first."""
        out = np.empty((len(q), self.leaves), np.int64)
        for i in range(len(q)):
            least, own = self._promise(q[i : i + 1])
            out[i, np.lexsort((-own[0], -least[0]))] = np.arange(self.leaves)
        return out

    def visited(self, q: np.ndarray, width: int, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first query, (queries, leaves): whether it visits the leaf) for a few queries at a time: the `width` first
        leaves, and beyond them until over k rows are seen (k beside the query itself). rows: of each leaf."""
        step = max(1, NUMBERS // len(self.leaf))
        for at in range(0, len(q), step):
            least, own = self._promise(q[at : at + step])
            if width >= self.leaves:
                yield at, np.ones(least.shape, bool)
                continue
            edge = -np.partition(-least, width - 1, axis=1)[:, width - 1 : width]
            out, tied = least > edge, least == edge
            more = width - out.sum(axis=1)
            for i in range(len(out)):
                j = np.flatnonzero(tied[i])
                out[i, j if len(j) == more[i] else j[np.argsort(-own[i, j], kind="stable")[: more[i]]]] = True
            for i in np.flatnonzero(out @ rows <= k):  # small leaves
                order = np.lexsort((-own[i], -least[i]))
                out[i, order[: int(np.searchsorted(np.cumsum(rows[order]), k, side="right")) + 1]] = True
            yield at, out


def _array(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Vectors in double precision; kind: how they are stored."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _vectors(table: DataFrame, vec_id: str, embedding: str, kind: str) -> DataFrame:
    """(vec_id, d, v, dim): usable rows; v: little-endian numbers, d: a 128-bit digest of them. It is computed anew by all that
    read it: reading the table again costs less than to keep a copy of all vectors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ds, vs, dims = [], [], [], []
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("v")):
                x = x.values
                if i is None or x is None or not len(x) or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(kind, copy=False)
                if np.isfinite(x).all() and x.any():
                    data = x.tobytes()
                    ids.append(i), vs.append(data), dims.append(len(x)), ds.append(hashlib.blake2b(data, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ds, pa.binary()), pa.array(vs, pa.binary()), pa.array(dims, pa.int64())], ["vec_id", "d", "v", "dim"])

    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v"))
    return rows.mapInArrow(read, "vec_id long, d binary, v binary, dim long")


@contextlib.contextmanager
def _tidy(spark):
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _truth(cells: DataFrame, probes: np.ndarray, dim: int, kind: str, k: int) -> DataFrame:
    """(q, leaf, leaf2): where the k nearest of each probe lie, by one pass over all rows. A task keeps k for each probe, and
    the lists of the tasks are merged in two steps."""
    q = probes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(q), k), -np.inf)
        at = np.zeros((len(q), k, 3), np.int64)  # leaf, leaf2, rows that share the vector
        for b in batches:
            if not b.num_rows:
                continue
            here = np.array([b.column("leaf").to_pylist(), b.column("leaf2").to_pylist(), b.column("n").to_pylist()], np.int64).T
            s = q @ _array(b.column("v"), dim, kind).T
            some = np.flatnonzero((s > best[:, -1:]).any(axis=0))
            s, here = np.concatenate([best, s[:, some]], axis=1), here[some]
            if not len(some):
                continue
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row = np.arange(len(q))[:, None]
            at = np.where((top < k)[:, :, None], at[row, np.minimum(top, k - 1)], here[np.maximum(top - k, 0)])
            best = s[row, top]
        for i in range(len(q)):
            keep = np.isfinite(best[i])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([best[i][keep].tolist()], pa.list_(pa.float64())), *[pa.array([at[i][keep][:, j].tolist()], pa.list_(pa.int64())) for j in range(3)]], ["q", "s", "leaf", "leaf2", "n"])

    schema = "q long, s array<double>, leaf array<long>, leaf2 array<long>, n array<long>"

    def merge(key, t):
        rows = sorted((-s, *x) for c in zip(*(t.column(x).to_pylist() for x in ("s", "leaf", "leaf2", "n"))) for s, *x in zip(*c))[:k]
        return pa.table({"q": pa.array([key[0].as_py()], pa.int64()), "s": pa.array([[-r[0] for r in rows]], pa.list_(pa.float64())), **{x: pa.array([[r[j] for r in rows]], pa.list_(pa.int64())) for j, x in ((1, "leaf"), (2, "leaf2"), (3, "n"))}})

    lists = cells.select("v", "leaf", "leaf2", F.size("ids").alias("n")).mapInArrow(scan, schema)
    lists = lists.withColumn("part", F.spark_partition_id() % 64).groupBy("q", "part").applyInArrow(lambda key, t: merge(key, t), schema)
    lists = lists.groupBy("q").applyInArrow(lambda key, t: merge(key, t), schema)
    return lists.select("q", F.posexplode(F.slice(F.flatten(F.transform(F.arrays_zip("leaf", "leaf2", "n"), lambda x: F.array_repeat(F.struct(x["leaf"].alias("leaf"), x["leaf2"].alias("leaf2")), x["n"].cast("int")))), 1, k)).alias("i", "x")).select("q", "x.leaf", "x.leaf2")


def _widths(places: list[tuple[int, int]], recall: float, second: bool) -> tuple[int, int]:
    """How many leaves, and leaves of a leaf's own tree, to visit so that `recall` of the probes' true neighbours lie in them: the
    pair with the least product. places: (place of the leaf in the probe's order, place within the leaf) of each neighbour."""
    first, inner = np.array([p for p, _ in places]), np.array([p for _, p in places])
    need, found = int(np.ceil(recall * len(places))), []
    for depth in sorted({int(x) + 1 for x in np.quantile(inner, np.linspace(0.5, 1, 26), method="higher")}) if second else [1]:
        ok = np.sort(first[inner < depth])
        if len(ok) >= need:
            width = int(ok[need - 1]) + 1
            found.append((width * depth, width, depth))
    return min(found)[1:]


def _fit(cells: DataFrame, big: dict[int, int], dim: int, kind: str) -> DataFrame:
    """(leaf, tree, leaves): trees of the leaves in big ({leaf: rows}), each fitted in a task on about SAMPLE rows of its leaf."""
    spark = cells.sparkSession
    every = spark.createDataFrame([(leaf, -(-w // SAMPLE), w) for leaf, w in big.items()], "leaf long, every long, w long")  # as many rows as the tree on the driver has leaves at most
    picked = cells.join(F.broadcast(every), "leaf").filter(F.pmod(F.xxhash64("d", F.lit(3)), F.col("every")) == 0).select("leaf", "w", "d", "v")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("leaf", "w", "v"))))
        for (leaf, w), group in groupby(rows, key=lambda r: r[:2]):
            x = np.frombuffer(b"".join(r[2] for r in group), kind).reshape(-1, dim).astype(np.float64)
            tree = Tree(x, least=max(LEAF, LEAF_ROWS * len(x) // w))
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], ["leaf", "tree"])

    return materialise(picked.repartition("leaf").sortWithinPartitions("leaf", "d").mapInArrow(fit, "leaf long, tree binary"), "leaf-trees")


def _past(rows: DataFrame, trees: DataFrame, f, schema: str, dim: int, kind: str) -> DataFrame:
    """f(tree, leaf, part of rows, vectors) for all rows (leaf, d, v, ids): rows of a leaf pass its tree, at most about PASS rows
    each copy of it. trees: leaf, tree."""
    n = rows.groupBy("leaf").agg(F.ceil(F.count("*") / PASS).alias("salts"))
    deal = materialise(trees.join(n, "leaf"), "leaf-deal")
    left = rows.join(F.broadcast(deal.select("leaf", "salts")), "leaf").withColumn("salt", F.pmod(F.xxhash64("d"), F.col("salts")))
    left = left.select("leaf", "salt", F.lit(1).alias("kind"), "d", "v", "ids")
    right = deal.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(b"").alias("d"), F.col("tree").alias("v"), F.lit(None).cast("array<long>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            at, leaves, kinds = 0, b.column("leaf").to_pylist(), b.column("kind").to_pylist()
            while at < b.num_rows:
                if kinds[at] == 0:
                    tree = pickle.loads(b.column("v")[at].as_py())
                    at += 1
                    continue
                end = at
                while end < b.num_rows and kinds[end] == 1:
                    end += 1
                part = b.slice(at, end - at)
                yield from f(tree, leaves[at], part, _array(part.column("v"), dim, kind))
                at = end

    return right.unionByName(left).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind", "d").mapInArrow(run, schema)


def _shelve(cells: DataFrame, dim: int, kind: str) -> DataFrame:
    """(shard, file, at, n, m, top): cells (shard, d, v, ids) as blocks of at most BLOCK in files of the shared folder, those of a shard one
    after the other. A block is at `at`: m ids, how many of them each of the n vectors has, the vectors; top: their greatest length."""
    root = f"{shared_dir(cells.sparkSession)}/blockloom-{cells.sparkSession.sparkContext.applicationId}/blocks-{uuid.uuid4().hex}"

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("shard", "v", "ids"))))
        one = next(rows, None)
        if one is None:
            return
        uri, at, index = f"{root}/{TaskContext.get().partitionId()}", 0, []
        with writing(uri) as out:
            for shard, group in groupby(chain([one], rows), key=lambda r: r[0]):
                while part := list(islice(group, BLOCK)):
                    ids = [sorted(set(r[2])) for r in part]
                    x = np.frombuffer(b"".join(r[1] for r in part), kind).reshape(-1, dim)
                    flat = np.array([i for some in ids for i in some], "<i8")
                    data = flat.tobytes() + np.array([len(some) for some in ids], "<i4").tobytes() + x.tobytes()
                    index.append((shard, uri, at, len(part), len(flat), float(np.linalg.norm(x.astype(np.float64), axis=1).max())))
                    out.write(data)
                    at += len(data)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index)], ["shard", "file", "at", "n", "m", "top"])

    sorted_ = cells.select("shard", "d", "v", "ids").repartition("shard").sortWithinPartitions("shard", "d")
    return materialise(sorted_.mapInArrow(shelve, "shard long, file string, at long, n long, m long, top double"), "index")


class _Lists:
    """The k best (score, id) of each query of a task: greatest score, then least id."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.s, self.i = np.full((len(q), k), -np.inf), np.full((len(q), k), FREE)

    def add(self, asks: np.ndarray, x: np.ndarray, ids: np.ndarray, n: np.ndarray, top: float) -> None:
        """Compare the queries numbered `asks` with the rows of x, of which each has n of the ids. Products of vectors of floats are
        told apart in that precision first; all that may be among the best for the bound of its error are computed in doubles."""
        dim, start = x.shape[1], np.cumsum(n) - n
        for lo in range(0, len(asks), STRIP):
            rows = asks[lo : lo + STRIP]
            q = self.q[rows]
            length = np.linalg.norm(q, axis=1)
            single = x.dtype == np.float32 and length.max() * top < 1e37
            error = 4 * dim * np.finfo(x.dtype if single else np.float64).eps * length * top + 1e-35
            s = q.astype(np.float32) @ x.T if single else q @ x.T
            edge = self.s[rows, -1]
            if not np.isfinite(edge).all() and s.shape[1] > self.k:
                edge = np.maximum(edge, np.partition(s, -self.k, axis=1)[:, -self.k] - error)
            some = np.flatnonzero(~(s.max(axis=1) < edge - error))  # what is not a number goes to the exact step, too
            if len(some):
                r, j = np.nonzero(~(s[some] < (edge - error)[some, None]))
                step = max(1, NUMBERS // dim)
                for at in range(0, len(r), step):
                    self._merge(rows[some[r[at : at + step]]], j[at : at + step], x, ids, n, start)

    def _merge(self, r: np.ndarray, j: np.ndarray, x: np.ndarray, ids: np.ndarray, n: np.ndarray, start: np.ndarray) -> None:
        s, more, hit = np.einsum("ij,ij->i", self.q[r], x[j].astype(np.float64)), n[j], np.unique(r)
        i = ids[np.arange(more.sum()) + np.repeat(start[j] - (np.cumsum(more) - more), more)]
        r = np.concatenate([np.repeat(hit, self.k), np.repeat(r, more)])
        s, i = np.concatenate([self.s[hit].ravel(), np.repeat(s, more)]), np.concatenate([self.i[hit].ravel(), i])
        for _ in range(2):
            order = np.lexsort((i, -s, r))
            r, s, i = r[order], s[order], i[order]
            again = np.append(False, (r[1:] == r[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1]) & (i[1:] != FREE))
            if not again.any():
                break
            s[again], i[again] = -np.inf, FREE
        first = np.searchsorted(r, hit)
        keep = first[:, None] + np.arange(self.k)
        self.s[hit], self.i[hit] = s[keep], i[keep]


def nearest(table: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding", sample: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every` their k nearest other rows found.

    Rows without an id, and vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, nor do
    those of another length than most, whose product with the others is not defined. Equal vectors are one entry of the index with its k + 1 least ids, which is all
    that a list of k can show of them, and equal queries are searched once, so a vector that a third of all rows have
    costs no more than another. Neighbouring leaves lie together in shards of about BLOCK entries, and a visit to a leaf
    searches its shard. Shards lie in files; a task holds at most BLOCK queries, each with a bit for every shard, and reads one block
    of a shard at a time, so visits are never rows and no task holds more when the table grows. The table is read four times."""
    spark = table.sparkSession
    kind = "<f4" if table.select(embedding).schema[0].dataType.simpleString() == "array<float>" else "<f8"
    rows = _vectors(table, vec_id, embedding, kind)
    schema = "query_id long, rank int, vec_id long, score double"
    size = rows.groupBy("dim").agg(F.count("*").alias("count"), F.approx_count_distinct("d", 0.02).alias("total")).orderBy(F.desc("count"), F.desc("dim")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim, total = size.dim, size.total
    rows = rows.filter(F.col("dim") == dim)
    order = F.xxhash64("d", F.lit(1))
    sample = sample or min(max(SAMPLE, min(total // ROWS_EACH, MOST_SAMPLE)), SAMPLE_BYTES // (8 * dim))
    part = 1.2 * (sample + 8 * sample**0.5) / total  # so many pass the hash that `sample` are left; `total` is within a few hundredths
    some = rows if part >= 1 else rows.filter(order < int(-(2**63) + part * 2**64))
    picked = _array(pa.array([bytes(r.v) for r in some.groupBy("d").agg(F.first("v").alias("v")).orderBy(order).select("v").limit(sample).collect()]), dim, kind)
    tree = Tree(picked, least=max(LEAF, LEAF_ROWS * len(picked) // total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaf, at = tree.assign(np.concatenate([_array(b.column("v"), dim, kind) for b in some])), 0
            for b in some:
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("v"), b.column("ids"), pa.array(leaf[at : at + b.num_rows], pa.int64())], ["d", "v", "ids", "leaf"])
                at += b.num_rows

        some, n = [], 0
        for b in batches:  # many rows go down the tree together: a step costs as much for one
            some.append(b)
            n += b.num_rows
            if n * dim >= NUMBERS:
                yield from placed(some)
                some, n = [], 0
        if n:
            yield from placed(some)

    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("d").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    cells = first.groupBy("d").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    with _tidy(spark):
        cells = materialise(cells.mapInArrow(place, "d binary, v binary, ids array<long>, leaf long"), "leaves")
        asked = materialise(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "d", "v"), "asked")
        queries = materialise(asked.groupBy("d").agg(F.first("v").alias("v"), F.count("*").alias("w")), "queries")
    held = {r.leaf: (r.w, r.ids) for r in cells.groupBy("leaf").agg(F.count("*").alias("w"), F.sum(F.size("ids")).alias("ids")).collect()}  # a row for each leaf of the tree on the driver
    big = {leaf: w for leaf, (w, _) in held.items() if w > REFIT}
    in_big = F.col("leaf").isin(list(big))
    trees = None
    if big:

        def inner(tree, leaf, part, x):
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("leaf", "d", "v", "ids")] + [pa.array(tree.assign(x), pa.int64())], ["leaf", "d", "v", "ids", "leaf2"])

        trees = _fit(cells, big, dim, kind)
        deep = _past(cells.filter(in_big).select("leaf", "d", "v", "ids"), trees, inner, "leaf long, d binary, v binary, ids array<long>, leaf2 long", dim, kind)
        with _tidy(spark):
            cells = materialise(deep.unionByName(cells.filter(~in_big).withColumn("leaf2", F.lit(0).cast("long")).select("leaf", "d", "v", "ids", "leaf2")), "deep-leaves")
    else:
        cells = cells.withColumn("leaf2", F.lit(0).cast("long"))

    probes = _array(pa.array([bytes(r.v) for r in queries.orderBy(F.xxhash64("d", F.lit(2))).select("v").limit(PROBES).collect()], pa.binary()), dim, kind)
    if not len(probes):
        return spark.createDataFrame([], schema)
    near = [tuple(r) for r in _truth(cells, probes, dim, kind, k).collect()]  # at most PROBES * k rows
    orders = tree.places(probes)
    inside = {(q, leaf, 0): 0 for q, leaf, _ in near if leaf not in big}
    if big:
        wanted: dict[tuple[int, int], set] = {}
        for q, leaf, leaf2 in near:
            if leaf in big:
                wanted.setdefault((q, leaf), set()).add(leaf2)

        def told(tree, leaf, part, x):
            for d, order, want in zip(part.column("d").to_pylist(), tree.places(x), part.column("ids").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([int(d)] * len(want), pa.int64()), pa.array([leaf] * len(want), pa.int64()), pa.array(want, pa.int64()), pa.array([int(order[y]) for y in want], pa.int64())], ["q", "leaf", "leaf2", "place"])

        ask = spark.createDataFrame([(leaf, bytearray(str(q).encode()), bytearray(probes[q].astype(kind).tobytes()), sorted(want)) for (q, leaf), want in wanted.items()], "leaf long, d binary, v binary, ids array<long>")
        inside |= {(r.q, r.leaf, r.leaf2): r.place for r in _past(ask, trees, told, "q long, leaf long, leaf2 long, place long", dim, kind).collect()}
    width, depth = _widths([(int(orders[q][leaf]), inside[q, leaf, leaf2]) for q, leaf, leaf2 in near], recall, bool(big)) if near else (1, 1)

    # shards: neighbouring leaves, numbered through; those of a leaf with a tree of its own follow the others
    shard_of, before = np.zeros(tree.leaves, np.int64), 0
    for leaf in (x for x in range(tree.leaves) if x not in big):
        shard_of[leaf] = before // BLOCK
        before += held.get(leaf, (0, 0))[0]
    n_shards = int(shard_of.max()) + 1
    dealt, tree_files = spark.createDataFrame([(leaf, 0, int(shard_of[leaf])) for leaf in held if leaf not in big], "leaf long, leaf2 long, shard long"), {}
    if big:
        here = cells.filter(in_big).groupBy("leaf", "leaf2").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows"))
        past = F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("leaf2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = materialise(here.withColumn("shard", F.floor(past / BLOCK).cast("long")), "shards")
        base = []
        for r in here.groupBy("leaf").agg(F.max("shard").alias("most")).orderBy("leaf").collect():
            base.append((r.leaf, n_shards))
            n_shards += r.most + 1
        here = materialise(here.join(F.broadcast(spark.createDataFrame(base, "leaf long, base long")), "leaf").select("leaf", "leaf2", "rows", (F.col("shard") + F.col("base")).alias("shard")), "shards")
        dealt = dealt.unionByName(here.select("leaf", "leaf2", "shard"))
        leaves = here.groupBy("leaf").agg(F.collect_list(F.struct("leaf2", "rows", "shard")).alias("x"))
        root = f"{shared_dir(spark)}/blockloom-{spark.sparkContext.applicationId}/trees-{uuid.uuid4().hex}"

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for leaf, data, x in zip(*(b.column(c).to_pylist() for c in ("leaf", "tree", "x"))):
                    inner_tree = pickle.loads(data)
                    seen, to = np.zeros(inner_tree.leaves, np.int64), np.full(inner_tree.leaves, -1)
                    for r in x:
                        seen[r["leaf2"]], to[r["leaf2"]] = r["rows"], r["shard"]
                    with writing(f"{root}/{leaf}") as out:
                        out.write(pickle.dumps((inner_tree, seen, to)))
                    yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([f"{root}/{leaf}"])], ["leaf", "file"])

        tree_files = {r.leaf: r.file for r in materialise(trees.join(leaves, "leaf").mapInArrow(keep, "leaf long, file string"), "tree-files").collect()}
    few = dealt if big and here.count() > SMALL else F.broadcast(dealt)
    with _tidy(spark):
        index = _shelve(cells.join(few, ["leaf", "leaf2"]), dim, kind)
    blocks = sorted(tuple(r) for r in index.collect())  # a row for each block of about BLOCK vectors
    seen_in = np.array([held.get(leaf, (0, 0))[1] for leaf in range(tree.leaves)])
    flat = np.array([leaf not in big for leaf in range(tree.leaves)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _array(b.column("v"), dim, kind)
            bits, home = np.zeros((len(q), n_shards), bool), tree.assign(q)
            first, deeper = np.where(flat[home], shard_of[home], 0), {leaf: [] for leaf in tree_files}
            for at, out in tree.visited(q, width, seen_in, k):
                r, leaf = np.nonzero(out & flat)
                bits[at + r, shard_of[leaf]] = True
                for leaf, asks in deeper.items():
                    asks += (at + np.flatnonzero(out[:, leaf])).tolist()
            for leaf, asks in deeper.items():
                if not asks:
                    continue
                system, path = fs.FileSystem.from_uri(tree_files[leaf])
                with system.open_input_stream(path, compression=None) as f:
                    inner_tree, rows_in, to = pickle.loads(f.read())
                asks = np.array(asks)
                for at, out in inner_tree.visited(q[asks], depth, rows_in, k):
                    r, leaf2 = np.nonzero(out & (to >= 0))
                    bits[asks[at + r], to[leaf2]] = True
                mine = np.flatnonzero(home == leaf)
                first[mine] = to[inner_tree.assign(q[mine])]
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("v"), b.column("w"), pa.array(first, pa.int64()), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["d", "v", "w", "first", "bits"])

    def found(part: list[tuple]) -> pa.RecordBatch:
        q = np.frombuffer(b"".join(r[1] for r in part), kind).reshape(-1, dim).astype(np.float64)
        bits = np.frombuffer(b"".join(r[3] for r in part), np.uint8).reshape(len(part), -1)
        lists, name, f = _Lists(q, k + 1), None, None
        for shard, file, at, n, m, top in blocks:
            asks = np.flatnonzero(bits[:, shard >> 3] & (128 >> (shard & 7)))
            if not len(asks):
                continue
            if file != name:
                f = f and f.close()
                system, path = fs.FileSystem.from_uri(file)
                name, f = file, system.open_input_file(path)
            data = f.read_at(8 * m + 4 * n + n * dim * int(kind[2:]), at)
            lists.add(asks, np.frombuffer(data, kind, n * dim, 8 * m + 4 * n).reshape(n, dim), np.frombuffer(data, "<i8", m), np.frombuffer(data, "<i4", n, 8 * m).astype(np.int64), top)
        f = f and f.close()
        full = lists.i != FREE
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.int64()), pa.array([x[y].tolist() for x, y in zip(lists.s, full)], pa.list_(pa.float64())), pa.array([x[y].tolist() for x, y in zip(lists.i, full)], pa.list_(pa.int64()))], ["d", "w", "s", "ids"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("d", "v", "w", "bits"))))
        while part := list(islice(rows, BLOCK)):
            yield found(part)

    n = queries.count()
    tasks = max(-(-n // BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-n // STRIP)))
    with _tidy(spark):
        visits = materialise(queries.repartition(tasks, "d").mapInArrow(walk, "d binary, v binary, w long, first long, bits binary"), "visits")
        lists = materialise(visits.repartitionByRange(tasks, "first", "d").mapInArrow(search, "d binary, w long, s array<double>, ids array<long>"), "lists")
    out = lookup(asked.select("vec_id", "d"), lists, ["d"], "inner", "w", asked.count())
    own = F.filter(F.arrays_zip("s", "ids"), lambda x: x["ids"] != F.col("vec_id"))
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.s").alias("score"))


def op2(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest found of every row whose vec_id is divisible by 20, nearest first, ties to the smaller vec_id; all candidates
    where there are fewer. Edge cases as in nearest(): unusable vectors are neither queries nor candidates, a query that has
    no candidate gives no row, repeated rows are one candidate, an empty table gives no row."""
    return nearest(embeddings)
