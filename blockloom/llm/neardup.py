"""MinHash near-dedup: one-permutation signatures with optimal densification, banded buckets, star-shaped candidate
edges, links confirmed on the full shingle sets, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_PARTS, boxed, doc_key, lookup, materialise, unboxed
from .components import components, joined
from .shingles import Signer, shingle_sets
from .tokens import slices

#: 32 bands of 4 bins: a pair at similarity 0.8 shares a bucket but for 5 in 100 million.
BINS, BANDS, MIN_PCT = 128, 32, 80
#: The contract of op4: 25 bands of 5 bins; a pair at 0.85 shares a bucket but for 4 in 10 million.
OP4_BANDS, OP4_PCT = 25, 85
#: Rounds of stars; members of a block of a star.
ROUNDS, SPOKES = 1, 64
#: Members and shingles of a block of a group that stars leave; hashes that are compared at once.
BLOCK, SHINGLES, COLUMNS = 512, 1_000_000, 2048
_SIGNED = "doc_id long, dk long, th long, n long, node binary, bands array<long>"


def signatures(docs: DataFrame, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """A row for each document: number of shingles, a 128-bit digest of the set (the node it belongs to: documents with
    equal sets are one node), and its bucket in each band. Written once to the shared folder."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bins, bands)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(len(texts), [len(t) for t in texts], 4_000_000):
                n, node, keys = [], [], []
                for s in shingle_sets(texts[i:j]):
                    n.append(len(s))
                    if len(s):
                        node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        keys.append(signer.band_keys(signer.sign(s)).view(np.int64))
                    else:
                        node.append(None), keys.append(None)
                cols = [b.column(c).slice(i, j - i) for c in ("doc_id", "dk", "th")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], [x.split()[0] for x in _SIGNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(sign, _SIGNED), "signatures")


def _members(nodes: DataFrame) -> DataFrame:
    """(cell, node, far): the buckets with two members or more; far orders the members of a bucket, the most central first
    (the one with most company in all its buckets), so the stars of a group mostly share their center.

    Buckets with over 1/HOT_PARTS of all (node, bucket) rows, fewer than HOT_PARTS by that very bound, are known by name, so a
    node's array of buckets is parted before it is exploded: their rows meet them by broadcast, all others by a shuffle."""
    sizes = materialise(nodes.select(F.explode("bands").alias("cell")).groupBy("cell").agg(F.count("*").alias("w")).filter("w > 1"), "buckets")
    total = nodes.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    hot = F.col("w") * HOT_PARTS > total

    def rows(bands, cells: DataFrame) -> DataFrame:
        return nodes.select("node", F.explode(bands).alias("cell")).join(cells, "cell").withColumnRenamed("w", "company")

    m, names = rows(F.col("bands"), sizes), [r.cell for r in sizes.filter(hot).select("cell").collect()]
    if names:
        known = F.lit(names).cast("array<long>")
        m = rows(F.array_except("bands", known), sizes.filter(~hot)).unionByName(rows(F.array_intersect("bands", known), F.broadcast(sizes.filter(hot))))
    m = materialise(m, "members")
    far = m.groupBy("node").agg((-F.sum("company")).alias("far"))
    return m.select("cell", "node").join(far, "node")


def _open_cells(members: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The members of cells that hold nodes of more than one component (labels: node, label; a node without one is alone),
    with `c`, the cell's center. What one component holds needs no further comparison."""
    members, label = members.select("cell", "node", "far"), F.col("node")
    if labels is not None:
        of = labels.withColumnsRenamed({"node": "_n", "label": "_l"})
        members, label = materialise(members.join(of, F.col("node") == F.col("_n"), "left").drop("_n"), "labelled"), F.coalesce("_l", "node")
    cells = members.groupBy("cell").agg(F.min(label).alias("_a"), F.max(label).alias("_z"), F.min(F.struct("far", "node")).alias("_c"), F.count("*").alias("w"))
    cells = materialise(cells.filter("_a != _z").select("cell", F.col("_c.node").alias("c"), "w"), "open-cells")
    total = cells.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return materialise(lookup(members.select("cell", "node", "far"), cells, ["cell"], "inner", "w", total), "open-members")


def _sets(nodes: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """(node, n, shingles): the full sets of nodes (node, dk, th, copies), each made again from the text of one row. A row that
    is there many times (over 1/HOT_PARTS of all, so fewer than HOT_PARTS such keys) is made once a task, not once a copy."""
    texts = docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            names, hot = b.column("node").to_pylist(), b.column("hot").to_pylist()
            at = [i for i, (n, h) in enumerate(zip(names, hot)) if not (h and n in seen) and not (h and seen.add(n))]
            b = b.take(pa.array(at, pa.int64()))
            text, names = b.column("text").to_pylist(), b.column("node").to_pylist()
            for x, y in slices(len(text), [len(t) for t in text], 2_000_000):
                sets = shingle_sets(text[x:y])
                yield pa.RecordBatch.from_arrays([pa.array(names[x:y], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "shingles"])

    wanted = nodes.select("dk", "th", "node", F.col("copies"), (F.col("copies") * HOT_PARTS > rows).alias("hot"))
    found = lookup(texts, wanted, ["dk", "th"], "inner", "copies", rows)
    return materialise(found.mapInArrow(make, "node binary, n long, shingles binary").dropDuplicates(["node"]), "sets")


def _star_sizes(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, node, both, nc, n): exact sizes for each edge. A star is dealt into blocks of SPOKES members, a center's set goes to
    each of its blocks; a task holds one center's set and one member's at a time."""
    spokes = edges.groupBy("c").agg(F.ceil(F.count("*") / SPOKES).alias("blocks"), F.count("*").alias("w"))
    spokes = materialise(spokes, "spokes")
    total = spokes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    members = lookup(edges, spokes, ["c"], "inner", "w", total).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("c", "block", "node")
    members = members.join(sets, "node").select("c", "block", F.lit(True).alias("spoke"), "node", "shingles")
    centers = spokes.join(sets.withColumnRenamed("node", "c"), "c").select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("spoke"), F.col("c").alias("node"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names, center = (pa.binary(), pa.binary(), *[pa.int64()] * 3), ["c", "node", "both", "nc", "n"], None
        for b in batches:
            out = []
            for c, spoke, node, data in zip(*(b.column(x).to_pylist() for x in ("c", "spoke", "node", "shingles"))):
                s = np.frombuffer(data, np.uint64)
                if not spoke:
                    center = s
                    continue
                at = np.searchsorted(center, s)
                at[at == len(center)] = 0
                out.append((c, node, int(np.count_nonzero(center[at] == s)), len(center), len(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    both = centers.unionByName(members).repartition("c", "block").sortWithinPartitions("c", "block", "spoke")
    return materialise(both.mapInArrow(compare, "c binary, node binary, both long, nc long, n long"), "stars")


def _finer(members: DataFrame, stars: DataFrame, min_pct: int) -> DataFrame:
    """Cells by distance to the center. The Jaccard distance is a metric, so nodes that are linked, at most 1 - min_pct / 100
    apart, are that near in their distances to any center as well: rings of that width, each node in the two cells that its
    ring shares with the next ones, keep all pairs that may be linked together, and part those that may not. The center
    has been compared with all others of its cell and leaves."""
    width = (100 - min_pct) / 100 + 1e-9
    d = 1 - F.col("both") / (F.col("nc") + F.col("n") - F.col("both"))
    rings = stars.select("c", "node", F.floor(d / width).alias("ring"))
    m = members.filter("node != c").join(rings, ["c", "node"]).withColumn("ring", F.explode(F.array(F.col("ring"), F.col("ring") + 1)))
    return m.select(F.xxhash64("cell", "c", "ring").alias("cell"), "node", "far")


def _alone(members: DataFrame, sets: DataFrame, min_pct: int) -> DataFrame:
    """Members without those that can have no link: of a set's shingles only those that some other open set has can be in an
    intersection, so fewer than min_pct of them are too few. One shuffle of hashes, counted map-side."""
    nodes = members.select("node").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, data in zip(b.column("node").to_pylist(), b.column("shingles").to_pylist()):
                s = np.frombuffer(data, np.int64)
                for i in range(0, len(s), 100_000):
                    part = s[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(node, pa.binary()), len(part)), pa.array(part)], ["node", "h"])

    open_ = sets.join(nodes, "node", "left_semi")
    once = open_.select("node", "shingles").mapInArrow(spread, "node binary, h long").groupBy("h").agg(F.count("*").alias("w"), F.min("node").alias("node")).filter("w = 1")
    own = once.groupBy("node").agg(F.count("*").alias("own"))
    stay = open_.select("node", "n").join(own, "node", "left").filter(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= min_pct * F.col("n"))
    return members.join(stay.select("node"), "node", "left_semi")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections: 0/1 matrices over the hashes that several sets have, COLUMNS at a time."""
    sets = left if left is right else left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    owner, column = owner[keep], shared[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        out += m @ m.T if left is right else m[: len(left)] @ m[len(left) :].T
    return out


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what `link`, a symmetric matrix, connects: one less than the members of each component."""
    out, todo = [], np.ones(len(link), bool)
    for root in range(len(link)):
        if todo[root]:
            todo[root], stack = False, [root]
            while stack:
                x = stack.pop()
                found = np.flatnonzero(link[x] & todo)
                todo[found] = False
                stack += found.tolist()
                out += [(x, y) for y in found.tolist()]
    return out


def _block_links(members: DataFrame, sets: DataFrame, min_pct: int) -> DataFrame:
    """(a, b): links among the nodes of cells that stars could not settle, enough of them to connect what is linked.

    Cells with the same center are one group. A group of over BLOCK members or SHINGLES shingles is dealt into blocks by a hash,
    and a task gets two of them, so no task holds more, and every pair of the group still meets in one."""
    groups = materialise(members.select(F.col("c").alias("grp"), "node").distinct().join(sets.select("node", "n"), "node"), "groups")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("w"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("g"))
    wanted = lookup(groups, materialise(sizes, "group-sizes"), ["grp"], "inner", "w", groups.count())
    wanted = wanted.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("g"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    sent = wanted.join(sets.select("node", "shingles"), "node").select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "mine", "shingles")

    def compare(members: list[tuple]) -> list[tuple[bytes, bytes]]:
        """members: (i, j, node, mine, set) of one task; a row that came twice counts once."""
        members = list({m[2]: m for m in members}.values())
        i, j = members[0][:2]
        left, right = ([m for m in members if m[3] == k] for k in (i, j))
        a = [np.frombuffer(m[4], np.uint64) for m in left]
        b = a if i == j else [np.frombuffer(m[4], np.uint64) for m in right]
        if len(a) * len(b) == 0:
            return []
        both, na, nb = _intersections(a, b).astype(np.float64), np.array([len(s) for s in a]), np.array([len(s) for s in b])
        link = 100 * both >= min_pct * (na[:, None] + nb[None, :] - both)
        if i != j:
            square = np.zeros((len(a) + len(b),) * 2, bool)
            square[: len(a), len(a) :], square[len(a) :, : len(a)] = link, link.T
            left, link = left + right, square
        return [(left[x][2], left[y][2]) for x, y in _forest(link)]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("grp", "i", "j", "node", "mine", "shingles"))))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            found = compare([r[1:] for r in group])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ("a", "b"))

    return sent.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(check, "a binary, b binary")


def classes(nodes: DataFrame, docs: DataFrame, min_pct: int, rows: int) -> DataFrame:
    """(node, label): the components of links with 100 * intersection >= min_pct * union of the full sets; nodes that have none
    may be left out.

    ROUNDS times, every bucket that still holds several components gives a star from its most central node to all its other
    members, and the stars are confirmed exactly. A center costs one comparison for each member, so a group of near copies
    is settled in work that grows with its size, whatever its size. What is left after that, without the sets that have too few
    shingles in common with any, is compared pair by pair in blocks (_block_links)."""
    members = materialise(_members(nodes), "central-members")
    sets = _sets(nodes.join(members.select("node").distinct(), "node", "left_semi"), docs, rows)
    labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    for k in range(ROUNDS):
        members = _open_cells(members, labels if k else None)
        if not members.head(1):
            return labels
        stars = _star_sizes(members.filter("node != c").select("c", "node").distinct(), sets)
        new = stars.filter(100 * F.col("both") >= min_pct * (F.col("nc") + F.col("n") - F.col("both"))).select(F.col("c").alias("a"), F.col("node").alias("b"))
        labels = joined(labels, new) if k else components(new)
        members = _finer(members, stars, min_pct)
    members = _open_cells(members, labels)
    if members.head(1):
        members = _open_cells(_alone(members, sets, min_pct), labels)
    return joined(labels, materialise(_block_links(members, sets, min_pct), "block-links")) if members.head(1) else labels


def near_duplicates(docs: DataFrame, min_pct: int = MIN_PCT, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """(doc_id, dk, th, n_shingles, component_id) for each row of docs.

    A null text, or one without words, has no shingle and is linked with nothing. Equal sets are linked as such, before
    any bucket, so a huge group of copies is one node. A row without an id takes part, but a component's id is the least
    id that is there; a component of such rows alone has none. Repeated rows get the same answer."""
    docs = docs.select("doc_id", "text")
    t = signatures(docs, bins, bands)
    rows = t.count()
    nodes = t.filter(F.col("node").isNotNull()).groupBy("node", "dk", "th").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = nodes.groupBy("node").agg(F.min("least").alias("least"), F.min(F.struct("dk", "th", "copies")).alias("of"), F.sum("copies").alias("w"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.select("node", "least", "of.dk", "of.th", "of.copies", "w", "bands"), "nodes")
    labels = classes(nodes, docs, min_pct, rows)
    labels = nodes.select("node", "least", "w").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = materialise(labels, "labels")
    heads = labels.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    of = lookup(labels, heads, ["label"], "inner", "m", nodes.count()).select("node", "component_id", "w")
    each = t.select("doc_id", "dk", "th", "n", "node")
    found = lookup(each.filter(F.col("node").isNotNull()), of, ["node"], "inner", "w", rows)
    alone = each.filter(F.col("node").isNull()).withColumn("component_id", F.col("doc_id"))
    return found.unionByName(alone).select("doc_id", "dk", "th", F.col("n").alias("n_shingles"), "component_id")


def op4(docs: DataFrame) -> DataFrame:
    """The digest of near_duplicates() at 0.85, a row for each document. Null, empty and wordless texts have n_shingles 0 and are
    alone; repeated rows and equal texts fall into one component; a row without an id is kept only where none of its
    component has one; an empty table gives no row; other columns don't matter."""
    d = near_duplicates(docs, OP4_PCT, bands=OP4_BANDS)
    return d.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group linked at 0.8 or more, the one with the least id; rows without an id stay where no row of their
    group has one. Texts without words have no group and stay; repeated rows become one."""
    keep = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("dk", "th").distinct()
    keyed = boxed(docs).withColumn("doc_id", F.col("_row.doc_id")).select("_row", *doc_key(text="_t")).join(keep, ["dk", "th"], "left_semi")
    return unboxed(keyed.dropDuplicates(["dk", "th"]), docs)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON a = doc_id
"""
