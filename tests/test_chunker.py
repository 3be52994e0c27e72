import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions.chunker import GEAR, PushChunker, chunk, cut_points, java_random_bytes, masks
from blockloom.model import ChunkParams


def naive(data, p):
    strict, lenient = masks(p)
    out, o, n = [], 0, len(data)
    while o < n:
        avail = n - o
        if avail <= p.min:
            out.append(n)
            break
        hard = min(avail, p.max)
        normal, fp, cut = min(p.avg, hard), 0, hard
        for i in range(p.min, hard):
            fp = ((fp << 1) + int(GEAR[data[o + i]])) & (1 << 64) - 1
            if not fp & (strict if i < normal else lenient):
                cut = i
                break
        o += cut
        out.append(o)
    return out


def test_gear_and_params():
    assert [hex(int(x)) for x in GEAR[:3]] == ["0x5155661551f6c869", "0xde4200afa685aec5", "0x4668273a59895f7c"]
    assert hashlib.sha256(GEAR.astype(">u8").tobytes()).hexdigest() == "c681be3cfc481eec02f62e7bddc93fd66af1f72b069df0545d27d35e6c0bcb93"
    p = ChunkParams.of(65536, 4 << 20)
    assert (p.min, p.avg, p.max) == (16384, 65536, 262144)
    assert masks(p) == (0x7FFFE00000000000, 0x7FFE000000000000)
    with pytest.raises(ValueError):
        ChunkParams.of(4096, 1000)
    with pytest.raises(ValueError):
        ChunkParams(10, 20, 30)


@pytest.mark.parametrize(("seed", "size", "params", "count", "first", "last"), [(1, 3_000_000, (4096, 16384), 630, [7111, 4430, 4650, 7426], 228), (7, 4_000_000, (8192, 65536), 437, [5454, 9186, 4569, 11487], 7002), (3, 1_000_000, (8192, 65536), 107, [9554, 8759, 10336, 4517], 6433)])
def test_known_cuts(seed, size, params, count, first, last):
    ends = cut_points(java_random_bytes(seed, size), ChunkParams.of(*params))
    lengths = [b - a for a, b in zip([0, *ends], ends)]
    assert len(lengths) == count and lengths[:4] == first and lengths[-1] == last


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6000), st.sampled_from([(64, 128, 512), (64, 256, 1024), (64, 64, 64)]), st.sampled_from([300, 1 << 22]))
def test_same_as_naive(seed, size, params, step):
    data, p = java_random_bytes(seed, size), ChunkParams(*params)
    assert cut_points(data, p, step) == naive(data, p)


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=30_000), st.lists(st.integers(1, 4000), min_size=1, max_size=6))
def test_push_is_pull(data, slices):
    p, c, got, at, k = ChunkParams(64, 128, 512), PushChunker(ChunkParams(64, 128, 512)), [], 0, 0
    while at < len(data):
        got += c.feed(data[at : at + slices[k % len(slices)]])
        at += slices[k % len(slices)]
        k += 1
    got += c.close()
    ends = cut_points(data, p)
    assert got == [data[a:b] for a, b in zip([0, *ends], ends)]


def test_insertion_is_local():
    data, p = java_random_bytes(7, 600_000), ChunkParams.of(4096, 65536)
    other = data[:300_000] + bytes(1000) + data[300_000:]
    blocks = [{x[a:b] for a, b in zip([0, *cut_points(x, p)], cut_points(x, p))} for x in (data, other)]
    assert sum(map(len, blocks[0] & blocks[1])) > 0.9 * len(data)


def test_chunk_table(spark):
    rows = [(1, b""), (2, None), (3, java_random_bytes(5, 5000)), (3, b"x" * 70)]
    got = chunk(spark.createDataFrame(rows, "payload_id int, payload binary"), ChunkParams(64, 128, 512)).collect()
    assert {r.payload_id for r in got} == {3}
    one = sorted((r for r in got if r.payload[:1] != b"x"), key=lambda r: r.seq)
    assert b"".join(bytes(r.payload) for r in one) == rows[2][1]
    assert all(hashlib.sha256(r.payload).digest() == bytes(r.hash) and len(r.payload) == r.length for r in got)
