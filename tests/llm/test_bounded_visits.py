"""Visits of queries to shards are bits of a query's row: no table has a row, with a vector, for each of them."""

import heapq
import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from blockloom.llm import common, neighbours


@pytest.mark.parametrize("kind", ["float", "double"])
def test_no_table_of_visits(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 32)
    x = np.random.default_rng(3).normal(size=(2000, 24)).astype("f4")
    root = f"{common.shared_dir(spark).removeprefix('file://')}/blockloom-{spark.sparkContext.applicationId}"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"vec_id long, embedding array<{kind}>")
    got: dict[int, list] = {}
    for r in neighbours.nearest(df, every=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    tables = [f"{root}/{t}" for t in set(os.listdir(root)) - before if os.path.exists(f"{root}/{t}/_SUCCESS")]
    assert max(pq.read_table(t).num_rows for t in tables) == 2000  # not one for each query and shard, which were 48,636
    s, hit = x.astype(float) @ x.astype(float).T, 0
    for q in range(2000):
        assert len(got[q]) == 20 and all(abs(s[q, i] - y) < 1e-12 for i, y in got[q])
        hit += len({i for i, _ in got[q]} & set([int(i) for i in np.argsort(-s[q])[:21] if i != q][:20]))
    assert hit >= 0.95 * 20 * 2000


def test_order_is_that_of_a_priority_queue():
    r = np.random.default_rng(8)
    tree, q = neighbours.Tree(r.normal(size=(3000, 16)), least=20), r.normal(size=(40, 16))
    rows = r.integers(1, 30, tree.leaves)
    least, _ = tree._promise(q)
    for width in (1, 7, tree.leaves // 2, tree.leaves):
        for at, out in tree.visited(q, width, rows, 60):
            for i, mine in enumerate(out, at):
                queue, want, seen = [(0.0, 0)], [], 0
                while queue and (len(want) < width or seen <= 60):
                    node = heapq.heappop(queue)[1]
                    if tree.leaf[node] >= 0:
                        want.append(tree.leaf[node])
                        seen += rows[want[-1]]
                    for child in tree.children[node]:
                        heapq.heappush(queue, (-float(tree.centers[child] @ q[i]), child))
                # where one node holds several leaves back, either order may take another of them last
                assert np.allclose(np.sort(least[i, want])[-width:], np.sort(least[i, mine])[-width:]) and rows[mine].sum() > min(60, rows.sum() - 1)
                assert mine.sum() >= width


def test_lists_are_exact():
    """Equal scores, vectors of very different lengths, single precision told apart in doubles."""
    r = np.random.default_rng(9)
    x = (r.normal(size=(900, 12)) * 10.0 ** r.integers(-6, 6, (900, 1))).astype("f4")
    x[300:400] = x[0]
    x[500] = x[501] * np.float32(1 + 2**-20)
    n = r.integers(1, 4, 900)
    ids = r.permutation(int(n.sum()))
    owner, exact = np.repeat(np.arange(900), n), x.astype(float)
    lists = neighbours._Lists(exact[:200], 21)
    start = np.cumsum(n) - n
    for lo in range(0, 900, 150):
        part = slice(lo, lo + 150)
        lists.add(np.arange(200), x[part], ids[start[lo] : start[lo] + n[part].sum()], n[part], float(np.linalg.norm(exact[part], axis=1).max()))
    s = np.einsum("qd,xd->qx", exact[:200], exact)[:, owner]
    for q in range(200):
        want = np.lexsort((ids, -np.array([float(np.einsum("ij,ij->i", exact[q : q + 1], exact[o : o + 1])[0]) for o in owner])))[:21]
        assert lists.i[q].tolist() == ids[want].tolist() and np.allclose(lists.s[q], s[q, want], rtol=1e-12)
