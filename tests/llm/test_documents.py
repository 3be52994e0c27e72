"""Every operator on documents against brute force, on a small table with all that is awkward in it."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blockloom.llm import bitplane, lines, mixing, neardup, packing, quality, repeats
from blockloom.llm.licenses import op5
from blockloom.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dk string, h string, n string, _t string, node string"
_R = random.Random(5)
_WORDS = ["".join(_R.choice("abcdefgh") for _ in range(_R.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) for _ in range(n))


def edit(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else "zz" + str(r.random()) for w in text.split(" "))


PASSAGE = prose(60, 99)


def table():
    base, texts = prose(300, 1), []
    texts += [None, "", " \t\n", "one", "a b c d", "A B c D", "a b c d e", "\n\n\n", "Ünïcödé wörds ß é 你好 😀 " * 30, "x" * 5000, "ab" * 700, "\n".join(["common line"] * 3)]
    texts += [base] * 4 + [edit(base, s, i) for i, s in enumerate([0.01, 0.02, 0.03, 0.05, 0.1, 0.3] * 3)]
    texts += [prose(80, 50 + i) + "\n  COMMON Line \n" + PASSAGE + "\n" + prose(30, 500 + i) for i in range(12)]
    texts += ["home | about | contact | login\n" + prose(40, 7), "### $$$ %%% &&& ***", "BUY NOW!! " * 20, "we use cookies\n" + prose(30, 8), prose(5, 3) + " " + "again and again " * 30]
    texts += ["Licensed under the Apache License, Version 2.0", "CC-BY cc by CC BY", "GNU General Public License. All rights reserved", "released under the MIT license", "all rights\nreserved", prose(20_000, 12)]
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4] if i % 3 else "a", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[14], (None, base, "en", "z", 3), (None, None, None, None, None)]
    return [(*r, "clash", "clash", "clash", "clash", "clash") for r in rows]


ROWS = table()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def key(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_quality(docs, empty):
    want = Counter()
    for doc, text, *_ in ROWS:
        w, t = ws(text), text or ""
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                hit |= set(range(i, i + 5))
        full = [x for x in t.split("\n") if ws(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(hit), failed] += 1
    got = quality.op10(docs).collect()
    assert key(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    by = {ROWS[r.doc_id][1]: r for r in got if r.doc_id is not None}
    assert not any(r.kept and r.base_failed for r in got) and not by["BUY NOW!! " * 20].kept
    assert by[prose(300, 1)].kept and by["home | about | contact | login\n" + prose(40, 7)].n_bad_lines == 1
    assert quality.op10(empty).collect() == []
    kept = quality.stage(docs)
    assert kept.columns == docs.columns and not any("cookies" in r.text for r in kept.collect()) and quality.stage(empty).collect() == []


def test_lines(docs, empty):
    def k(line):
        return lower_az(line.strip(" \t\n\x0b\x0c\r"))

    found = defaultdict(set)
    for doc, text, *_ in ROWS:
        for line in (text or "").split("\n"):
            found[k(line)].add(doc)
    common = {x for x, d in found.items() if len(d) >= 10 and x}
    assert "common line" in common
    want = Counter()
    for doc, text, *_ in ROWS:
        all_ = (text or "").split("\n")
        stay = [x for x in all_ if k(x) not in common]
        want[doc, len(all_), len(all_) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    assert key(lines.op7(docs).collect(), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert lines.op7(empty).collect() == [] and lines.stage(docs).columns == docs.columns


def shingles(text):
    w = ws(lower_az(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize(("block", "rounds"), [(512, 1), (3, 0), (3, 2)])
def test_near_duplicates(docs, empty, block, rounds, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "SPOKES", 4)
    sets = [(r[0], shingles(r[1])) for r in ROWS]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[root(i)].append(d)
    want = Counter()
    for i, (d, s) in enumerate(sets):
        ids = [x for x in least[root(i)] if x is not None]
        c = min(ids) if ids else None
        want[d, len(s), c, d == c] += 1
    got = neardup.op4(docs).collect()
    assert key(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert neardup.op4(empty).collect() == []
    if rounds == 1:
        kept = neardup.stage(docs)
        assert kept.columns == docs.columns and kept.filter("text IS NOT NULL").groupBy("text").count().filter("count > 1 AND length(text) > 20").count() == 0


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats(docs, empty, most):
    data = [(d, (t or "").encode()) for d, t, *_ in ROWS]
    n = Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    want = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                a = max(i, end)
                gone[a : i + 200] = b"\1" * (i + 200 - a)
                end = i + 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d, len(b), len(b) - len(kept), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    repeats_default = repeats.repeated_spans.__defaults__
    repeats.repeated_spans.__defaults__ = (200, 40, most)
    try:
        got = repeats.op6(docs).collect()
    finally:
        repeats.repeated_spans.__defaults__ = repeats_default
    assert key(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert repeats.op6(empty).collect() == []


def test_interval_scan_gives_maximal_repeats():
    r = random.Random(3)
    core = bytes(r.choices(b"ab", k=40))
    entries = list({bytes(r.choices(b"ab", k=r.randint(0, 6))) + core[: r.randint(20, 40)] + bytes(r.choices(b"ab", k=r.randint(0, 9))) for _ in range(60)})
    entries = [(e, e.find(core[:20])) for e in entries if core[:20] in e]
    for length in (22, 30):
        found: list = []
        spans = repeats.interval_scan(entries, length, found)
        for (e, at), x in zip(entries, spans):
            hit = set()
            for f, p in entries:
                left = next((k for k in range(min(at, p)) if e[at - 1 - k] != f[p - 1 - k]), min(at, p))
                right = next((k for k in range(min(len(e) - at, len(f) - p)) if e[at + k] != f[p + k]), min(len(e) - at, len(f) - p))
                if f != e and left + right >= length:
                    hit |= set(range(at - left, at + right))
            assert (set(range(at - x[0], at + x[1])) if x else set()) == hit
        for left, depth, members in found:
            texts = {entries[m][0][entries[m][1] - left : entries[m][1] + depth] for m in members}
            assert len(texts) == 1 and len(members) > 1 and left + depth >= length
            same = [k for k, (f, p) in enumerate(entries) if p >= left and f[p - left : p + depth] == next(iter(texts))]
            assert sorted(members) == same
            assert len({entries[m][0][entries[m][1] - left - 1 : entries[m][1] - left] if entries[m][1] > left else m for m in members}) > 1


def ids_of(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [(d, x.ids) for (d, *_), x in zip(ROWS, t.encode_batch([r[1] or "" for r in ROWS], add_special_tokens=False))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, empty):
    want = Counter((d, len(x) + 1, crc([*x, 2])) for d, x in ids_of(bitplane.VOCABULARY))
    got = bitplane.op8(docs).collect()
    assert key(got, "doc_id", "n_tokens", "ids_crc32") == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0)) and bitplane.op8(empty).collect() == []


@pytest.mark.parametrize("kind", [8, 1])
def test_bit_planes_round_trip(kind, tmp_path):
    import pyarrow as pa

    r = np.random.default_rng(1)
    docs = [(None, b""), (5, r.integers(0, 2**32, 1000, np.uint64).astype("<u4").tobytes()), (-7, b""), (9, r.integers(0, 300, 777).astype("<u4").tobytes()), (2**40, b"\1\0\0\0")]
    with pa.OSFile(str(tmp_path / "x"), "wb") as out:
        w = bitplane.Writer(out, kind, block=256)
        for d, ids in docs:
            w.add(d, ids)
        w.close()
    with pa.OSFile(str(tmp_path / "x"), "rb") as f:
        assert list(bitplane.Reader(f)) == docs
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-1])
    with pytest.raises(ValueError), pa.OSFile(str(tmp_path / "y"), "rb") as f:
        bitplane.Reader(f)


def test_packing(docs, empty):
    got, want = packing.op9(docs).collect(), ids_of(packing.VOCABULARY)
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
    for d, x in want:
        x = [*x, 0]
        if sum(e == d for e, _ in want) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), crc(x[at : at + r.length]))
                at += r.length
            assert at == len(x)
    total = sum(len(x) + 1 for _, x in want)
    assert sum(r.length for r in got) == total and len(windows) * 1024 < total * 1.1 + 1024
    assert packing.op9(empty).collect() == []


def test_packer_fills_windows():
    r = random.Random(2)
    for most in (1, 4, 32):
        p, done = packing.Packer(100, most, 0), []
        sizes = [r.randint(1, 250) for _ in range(500)]
        for i, n in enumerate(sizes):
            done += p.add((i, 0, bytes(4 * n), n))
            assert len(p.open) <= most
        done += p.close()
        assert sum(len(x[2]) // 4 for _, w in done for x in w) == sum(sizes) and all(sum(len(x[2]) // 4 for x in w) <= 100 for _, w in done)
        assert len(done) <= -(-sum(sizes) // 100) * 1.05 + 1 and len({k for k, _ in done}) == len(done)


def test_mixing(docs, empty):
    sizes, total = Counter(), 0
    for _, text, _, source, *_ in ROWS:
        sizes[source] += len(ws(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and weights[s] * left / free > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    got = mixing.op3(docs).collect()
    assert len(got) == len(ROWS) and got and sorted(map(str, got)) == sorted(map(str, mixing.op3(docs).collect()))
    by = {i: r[3] for i, r in enumerate(ROWS)}
    taken, seen = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            s = by[r.doc_id]
            want = 3 * sizes[s] if s in capped else weights[s] * left / free
            assert r.source_size == sizes[s] and abs(r.target - want) < 1e-6
            taken[s] += r.copies
            seen[s] += 1
            assert int(want / sizes[s]) <= r.copies <= int(want / sizes[s]) + 1
    assert mixing.op3(empty).collect() == [] and mixing.mix(empty).collect() == []
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_licenses(docs, empty):
    want = Counter()
    for d, text, *_ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))
        at = [(i, label) for label, p in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want[d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    got = op5(docs).collect()
    assert key(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    labels = {ROWS[r.doc_id][1]: r for r in got if r.doc_id is not None}
    assert labels["Licensed under the Apache License, Version 2.0"].labels == "apache" and labels["released under the MIT license"].score == 1.0
    assert all(0 <= r.score <= 1 for r in got) and op5(empty).collect() == []
