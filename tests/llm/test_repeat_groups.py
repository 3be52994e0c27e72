"""Maximal repeat groups with all occurrences, and borders of the chunks in which long texts are worked on."""

import random
from collections import defaultdict

import numpy as np
import pytest

from blockloom.llm import repeats, shingles


def corpus():
    r = random.Random(8)

    def text(n):
        return "".join(r.choice("abcdefgh ") for _ in range(n))

    core, long = text(260), text(900)
    rows = [text(100) + core + text(80), text(300) + core[:230] + text(50), text(20) + core[20:] + text(90), text(500), long, "x" + long + "y", long, text(60) + core, "zz" * 250]
    return list(enumerate(rows))


@pytest.mark.parametrize("most", [4096, 2])
def test_groups_are_repeats_with_all_occurrences(spark, most):
    rows, length = corpus(), 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    data = {i: t.encode() for i, t in rows}
    groups = defaultdict(set)
    for g in repeats.repeat_groups(docs, length, 40, most).collect():
        groups[bytes(g.gid)].add((g.dk, g.start, g.size))
    covered = defaultdict(set)
    for members in groups.values():
        texts = {data[d][a : a + n] for d, a, n in members}
        assert len(texts) == 1 and len(members) > 1
        (x,) = texts
        assert len(x) >= length
        everywhere = {(d, k, len(x)) for d, t in data.items() for k in range(len(t) - len(x) + 1) if t.startswith(x, k)}
        assert members <= everywhere
        if most > 2 and len(set(x)) > 2:  # a text of one repeated pair has an anchor in one place only
            assert members == everywhere
        for d, a, n in members:
            covered[d] |= set(range(a, a + n))
    want = defaultdict(set)
    places = defaultdict(list)
    for d, t in data.items():
        for k in range(len(t) - length + 1):
            places[t[k : k + length]].append((d, k))
    for where in places.values():
        if len(where) > 1:
            for d, k in where:
                want[d] |= set(range(k, k + length))
    assert covered == want


def test_anchors_across_chunks(monkeypatch):
    r = random.Random(2)
    data = bytes(r.choices(b"abc", k=6000))
    whole = repeats.anchors(data)
    of = {s: (h, a) for h, a, lo, hi in zip(*(x.tolist() for x in whole)) for s in range(lo, hi + 1)}
    assert sorted(of) == list(range(len(data) - 199))
    monkeypatch.setattr(repeats, "_CHUNK", 700)
    cut = repeats.anchors(data)
    assert {s: (h, a) for h, a, lo, hi in zip(*(x.tolist() for x in cut)) for s in range(lo, hi + 1)} == of


def test_shingles_across_steps(monkeypatch):
    text = " ".join(f"w{random.Random(5).randint(0, 9)}{i % 97}" for i in range(5000))
    want = shingles.shingle_sets([text, "a b c", ""])
    monkeypatch.setattr(shingles, "_STEP", 1000)
    for x, y in zip(want, shingles.shingle_sets([text, "a b c", ""]), strict=True):
        assert np.array_equal(x, y)
