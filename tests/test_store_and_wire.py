import hashlib
import os

import pytest

from blockloom.model import ChunkParams
from blockloom.operators import delta, rebuild, store
from blockloom.sources import blueprint, index, wire


def h(b):
    return hashlib.sha256(b).digest()


def blocks(spark, *payloads):
    return spark.createDataFrame([(h(p), len(p), p) for p in payloads], "hash binary, length int, payload binary")


def test_store_appends_once_and_guards_its_parameters(spark, tmp_path):
    path, p = f"file://{tmp_path}/store", ChunkParams.of(4096, 65536)
    s = store.BlockStore(spark, path, p)
    assert s.append(blocks(spark, b"a", b"b", b"a")) == 2
    assert s.append(blocks(spark, b"b", b"c")) == 1
    assert store.BlockStore(spark, path, p).stats().first().asDict() == {"chunk_count": 3, "stored_bytes": 3}
    assert {bytes(r.payload) for r in s.get(blocks(spark, b"a", b"c").select("hash")).collect()} == {b"a", b"c"}
    with pytest.raises(Exception, match="not in store"):
        s.get(blocks(spark, b"zz").select("hash")).collect()
    with pytest.raises(ValueError, match="force"):
        store.BlockStore(spark, path, ChunkParams.of(8192, 65536))
    assert store.BlockStore(spark, path, ChunkParams.of(8192, 65536), force=True).count() == 0


def test_pack_replay_drops_what_is_torn(spark, tmp_path):
    store.write_pack([(h(b"one"), b"one"), (h(b"two!"), b"two!")], str(tmp_path))
    raw = (tmp_path / "index.bin").read_bytes()
    assert len(raw) == 88 and len(store.replay_index(raw + b"part", 7)) == 2
    assert len(store.replay_index(raw, 5)) == 1
    assert {bytes(r.payload) for r in store.read_pack(spark, str(tmp_path), 2).collect()} == {b"one", b"two!"}


def test_fetch_in_request_order_and_missing_fails(spark):
    ask = spark.createDataFrame([(0, h(b"b")), (1, h(b"a")), (2, h(b"b"))], "seq int, hash binary")
    got = delta.fetch(ask, blocks(spark, b"a", b"b")).orderBy("seq").collect()
    assert [bytes(r.payload) for r in got] == [b"b", b"a", b"b"]
    with pytest.raises(Exception, match="unknown block"):
        delta.fetch(ask, blocks(spark, b"a")).collect()


def test_missing_keeps_first_length_and_order(spark):
    need = spark.createDataFrame([(h(b"c"), 1, 5), (h(b"a"), 1, 1), (h(b"c"), 1, 2), (h(b"b"), 1, 3)], "hash binary, length int, pos long")
    got = delta.missing_blocks(need, blocks(spark, b"b")).orderBy("first_pos").collect()
    assert [(bytes(r.hash), r.first_pos) for r in got] == [(h(b"a"), 1), (h(b"c"), 2)]


def test_metrics_of_nothing(spark):
    need = spark.createDataFrame([], "hash binary, length int, pos long")
    m = delta.transfer_metrics(need, blocks(spark, b"x")).first()
    assert (m.blocks_needed, m.saved_fraction, m.compression_ratio, m.wire_bytes) == (0, 0.0, 1.0, 17)


def test_composite_first_source_wins(spark):
    got = {bytes(r.payload): r.source for r in store.composite(blocks(spark, b"a"), blocks(spark, b"a", b"b")).collect()}
    assert got == {b"a": 0, b"b": 1}


def test_concat_fails_on_missing_block(spark):
    refs = spark.createDataFrame([(1, 0, h(b"a")), (1, 1, h(b"zz"))], "k int, seq int, hash binary")
    with pytest.raises(Exception, match="missing"):
        rebuild.concat_blocks(refs, blocks(spark, b"a"), ["k"]).collect()


def test_frames():
    data = [(h(bytes([i]) * i * 1000), bytes([i]) * i * 1000) for i in range(5)]
    raw = b"".join(wire.write_frames(data, 4096))
    assert wire.read_frames(raw, 4096) == data and len(raw) == sum(len(p) for _, p in data) + 37 * 5 + 17
    with pytest.raises(ValueError, match="limit"):
        list(wire.write_frames([(h(b""), bytes(4097))], 4096))
    with pytest.raises(ValueError, match="limit"):
        wire.read_frames(raw, 2000)
    with pytest.raises(ValueError, match="hash"):
        wire.read_frames(raw[:200] + bytes([raw[200] ^ 1]) + raw[201:], 4096)
    for cut in (5, 17):
        with pytest.raises(ValueError, match="truncated"):
            wire.read_frames(raw[:-cut], 4096)
    assert wire.gunzip(wire.gzip(raw)) == raw and wire.gzip(raw, 0) == raw


def test_hash_list():
    hashes = [h(f"block-{i}".encode()) for i in range(1000)]
    assert wire.read_hash_list(wire.write_hash_list(hashes)) == hashes
    with pytest.raises(ValueError):
        wire.read_hash_list(b"JDTH1" + (50_000_001).to_bytes(4, "big"))


def test_blueprint_round_trip_and_version_1(spark):
    import gzip
    import struct

    from blockloom.model import DecomposeLimits

    nodes = (([0], "container", 0, b"meta", 99), ([0, 0], "blob", None, None, 3), ([0, 1], "blob", None, None, 0))
    refs = (([0, 0], 0, h(b"abc"), 3),)
    b = blueprint.Blueprint(h(b"x"), 99, ChunkParams.of(4096, 65536), DecomposeLimits(7), nodes, refs)
    raw = blueprint.to_bytes(b)
    assert blueprint.from_bytes(raw) == b
    old = gzip.compress(b"JDTBP\x01" + h(b"x") + struct.pack(">qiii", 5, 1024, 4096, 16384) + b"\0" + struct.pack(">qi", 5, 0))
    assert blueprint.from_bytes(old).limits == DecomposeLimits()
    for bad in (gzip.compress(b"NOPE!\x02"), gzip.compress(b"JDTBP\x03" + bytes(80)), gzip.compress(gzip.decompress(raw)[:-3])):
        with pytest.raises(ValueError):
            blueprint.from_bytes(bad)
    t = blueprint.parse(spark.createDataFrame([("v", raw)], "version_id string, content binary"))
    assert t.filter("kind IS NOT NULL").count() == 3 and t.filter("hash IS NOT NULL").first().length == 3


def test_index_json(spark, tmp_path):
    from blockloom import model

    rows = [("b", "b.zip", 5, "s", "t", 1, 2, 3, 4, 0, "now", None), ("a", "a.zip", 6, "s", "t", 1, 2, 3, 4, 0, "now", "2024-01-01T00:00:00.123456789Z")]
    p, path = ChunkParams.of(4096, 65536), str(tmp_path / "index.json")
    index.save(spark.createDataFrame(rows, model.VERSIONS), p, path)
    got, versions = index.load(spark, path)
    assert got == p and [tuple(r) for r in versions.orderBy("id").collect()] == sorted(rows)
    assert os.path.exists(path) and '"fileModified"' in open(path).read() and open(path).read().count("fileModified") == 1
    assert "file_modified" not in index.api_view(versions).columns
    (tmp_path / "other.json").write_text('{"formatVersion": 2, "versions": []}')
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "other.json"))
