"""Mixing a table in which one id, or one row, is a great part of all."""

from collections import Counter

from pyspark.sql import functions as F

from blockloom.llm import mixing


def test_hot_ids_are_dealt_into_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_PARTS", 5)
    rows = [(i, f"text {i} of some words", "ab"[i % 2]) for i in range(60)] + [(None, f"other text {i} " * (1 + i % 9), "a") for i in range(60)] + [(7, "the same row", "b")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    seen = []
    cut = mixing._cut_at_hot_ids
    monkeypatch.setattr(mixing, "_cut_at_hot_ids", lambda r: seen.append(cut(r)) or seen[-1])
    got = mixing.op3(docs).collect()
    assert seen[0].filter("_z != ''").count() > 0 and seen[0].groupBy("_x", "_z", "_s", "_t").count().agg(F.max("count")).first()[0] < 20
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    for r in got:
        e = r.target / r.source_size
        assert int(e) <= r.copies <= int(e) + 1
    for size in sizes.values():
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.copies for r in mine) - len(mine) * mine[0].target / size) < 2
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert sorted(map(str, mixing.op3(docs.repartition(3)).collect())) == sorted(map(str, got))
