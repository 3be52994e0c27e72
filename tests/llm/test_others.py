import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import neighbours, warc

_V = "vec_id long, embedding array<float>, label int, d string, leaf string, ids string"


def vectors():
    r = np.random.default_rng(4)
    centers = r.normal(size=(12, 16))
    x = centers[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16))
    rows = [(i, [float(np.float32(v)) for v in row], 0, "c", "c", "c") for i, row in enumerate(x)]
    hot = rows[3][1]
    rows += [(2000 + i, hot, 0, "c", "c", "c") for i in range(300)]  # one vector many times
    rows += [(5000, None, 0, "c", "c", "c"), (5020, [0.0] * 16, 0, "c", "c", "c"), (5040, [float("nan")] * 16, 0, "c", "c", "c"), (5060, [None] * 16, 0, "c", "c", "c"), (5080, [1.0], 0, "c", "c", "c"), (5100, [], 0, "c", "c", "c"), (None, hot, 0, "c", "c", "c"), (5120, [float("inf")] + [0.0] * 15, 0, "c", "c", "c")]
    return rows


def brute(rows, k):
    good = [(i, np.array(v)) for i, v, *_ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    return {i: [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != i][:k] for i, v in good if i % 20 == 0 for s in [x @ v]}


def test_neighbours(spark):
    rows = vectors()
    want, got = brute(rows, 20), {}
    for r in neighbours.op2(spark.createDataFrame(rows, _V)).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    score = {(q, i): s for q, w in want.items() for i, s in w}
    hit = 0
    for q, w in want.items():
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in [r.vec_id for r in mine]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(score.get((q, r.vec_id), r.score) - r.score) < 1e-12 for r in mine)
        hit += len({i for i, _ in w} & {r.vec_id for r in mine})
    assert hit >= 0.9 * 20 * len(want)


def test_neighbours_through_trees_of_leaves(spark, monkeypatch):
    """A sample so small that leaves hold many rows: each gets a tree of its own."""
    monkeypatch.setattr(neighbours, "REFIT", 100)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 30)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "PASS", 50)
    rows = vectors()
    want, got = brute(rows, 20), {}
    for r in neighbours.nearest(spark.createDataFrame(rows, _V), sample=64).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in w} & {i for i, _ in got[q]}) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_neighbours_of_few_and_none(spark):
    rows = [(20 * i, [float(i), 1.0], 0, "", "", "") for i in range(5)]
    got = neighbours.op2(spark.createDataFrame(rows, _V)).collect()
    assert len(got) == 20 and [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r.rank))][:4] == [20, 40, 60, 80]
    assert neighbours.op2(spark.createDataFrame([], _V)).collect() == []
    assert neighbours.op2(spark.createDataFrame([(1, [1.0, 2.0], 0, "", "", "")], _V)).collect() == []
    one = neighbours.op2(spark.createDataFrame([(20, [1.0, 2.0], 0, "", "", "")], _V))
    assert one.collect() == []


def test_sf_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hit = n = 0
    got = {}
    for r in neighbours.op2(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, mine in got.items():
        s = x @ x[list(ids).index(q)]
        want = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        hit += len(set(want) & mine)
        n += 20
    assert hit >= 0.9 * n


@pytest.mark.parametrize("top", [4096, 2])
def test_audit_locates_all_damage(spark, monkeypatch, top):
    monkeypatch.setattr(warc, "TOP", top)
    r = random.Random(1)
    good = {i: f"record {i} {r.random()}" for i in list(range(700)) + [10_000, 10_001, 5_000_000]}
    bad = dict(good)
    bad[3] += "!"
    del bad[300], bad[10_000]
    bad[9_999_999] = "stray"
    schema = "number long, record string, leaf string, level string"

    def df(d, more=()):
        return spark.createDataFrame([(k, v, "x", "x") for k, v in d.items()] + list(more), schema).repartition(3)

    got = {x.number: x for x in warc.fixity_audit(df(good), df(bad)).collect()}
    assert {k: v.status for k, v in got.items()} == {3: "changed", 300: "missing", 10_000: "missing", 9_999_999: "extra"}
    assert got[300].offset == sum(len(good[i]) for i in range(300)) and got[10_000].offset == sum(len(good[i]) for i in range(700)) and got[3].length == len(good[3])
    assert warc.fixity_audit(df(good), df(good)).collect() == []
    twice = [(5, good[5], "x", "x")] * 3
    assert [x.number for x in warc.fixity_audit(df(good, twice), df(good)).collect()] == [5]
    assert warc.fixity_audit(df(good, twice), df(good, twice)).collect() == []
    nulls = [(None, "a", "x", "x"), (600, None, "x", "x")]
    assert {x.number for x in warc.fixity_audit(df(good, nulls), df(good)).collect()} == {-1, 600}
    none = spark.createDataFrame([], schema)
    assert warc.fixity_audit(none, none).collect() == []
    assert {x.status for x in warc.fixity_audit(none, df(bad)).collect()} == {"extra"} and warc.fixity_audit(df(good), none).count() == len(good)


def test_pages_query(spark):
    rows = [(i, None if i % 50 == 1 else f"http://x/{i}", None if i % 40 == 2 else "<p>" * (i % 30)) for i in range(800)]
    got = {r.number: r.status for r in warc.op1(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "changed" for i in range(800) if i % 97 == 13} | {i: "missing" for i in range(800) if i % 193 == 7} | {i + (1 << 40): "extra" for i in range(800) if i % 389 == 11}
    assert got == want
    assert warc.op1(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc_files(spark):
    records = [r.record.encode() for r in spark.createDataFrame([(1, "u", "body"), (2, None, None)], "i long, u string, b string").select(warc.warc_record(F.col("i"), F.col("u"), F.col("b")).alias("record")).collect()]
    plain, packed = b"".join(records), warc.pack_warc(records)
    assert [r for _, r in warc.parse_warc(plain)] == records == [r for _, r in warc.parse_warc(packed)]
    assert [r for _, r in warc.parse_warc(plain[:-5])][0] == records[0]
    files = spark.createDataFrame([("p", bytearray(plain)), ("z", bytearray(packed)), ("e", bytearray(b""))], "path string, content binary")
    got = warc.read_warc(files).orderBy("path", "number").collect()
    assert [(r.path, bytes(r.record)) for r in got] == [("p", records[0]), ("p", records[1]), ("z", records[0]), ("z", records[1])]


def test_parsing_is_linear_and_by_steps():
    import io

    r = random.Random(4)
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + r.randbytes(n) + b"\r\n\r\n" for n in [0, 5, 70_000, 65_536 - 40, 300_000, 1] * 20]

    class Steps(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            assert 0 < n <= warc.STEP
            data = super().read(n)
            self.taken += len(data)
            return data

    for data in (b"".join(records), warc.pack_warc(records)):
        f, at = Steps(data), 0
        for offset, record in warc.parse_stream(f):
            assert record == records[at] and offset < len(data)
            at += 1
        assert at == len(records) and f.taken == len(data)


def test_written_archive_is_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(i, f"u{i}", "b" * (i % 300)) for i in range(200)] + [(None, "none", "x"), (7, "again", "y")]
    df = spark.createDataFrame(rows, "i long, u string, b string").select(F.col("i").alias("number"), warc.warc_record(F.col("i"), F.col("u"), F.col("b")).alias("record"))
    files = warc.write_warc(df, "test")
    assert files.count() > 10 and files.agg(F.sum(F.size("numbers"))).first()[0] == len(rows)
    want = sorted((str(r.number), r.record.encode()) for r in df.collect())
    assert sorted((str(r.number), bytes(r.record)) for r in warc.archive(files).collect()) == want
