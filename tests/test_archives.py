import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from blockloom.codecs import cab, zip as zip_codec
from blockloom.functions import scalars
from blockloom.functions.chunker import java_random_bytes
from blockloom.model import ChunkParams, RepackMode
from blockloom.operators import rebuild, repack
from blockloom.operators.decompose import Decomposed
from blockloom.sources import scan


def text(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)).encode()


def make_zip(members, level=6, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method, compresslevel=level) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


MEMBERS = [("a.txt", text(3000)), ("b.bin", java_random_bytes(1, 50_000)), ("empty", b""), ("dir/c.txt", text(50, 2))]


@pytest.mark.parametrize("level", [1, 6, 9])
def test_zip_round_trip(level):
    data = make_zip(MEMBERS, level)
    meta, parts = zip_codec.decompose(data)
    assert zip_codec.rebuild(meta, parts) == data
    assert [n for n, *_ in zip_codec.listing(meta)] == ["a.txt", "b.bin", "empty", "dir/c.txt"]
    assert {p: parts[k] for p, _, k in zip_codec.listing(meta)}["a.txt"] == MEMBERS[0][1]
    for wrong in (parts[:-1], [*parts, b"x"]):
        with pytest.raises(ValueError):
            zip_codec.rebuild(meta, wrong)


def test_zip_stored_prefixed_and_broken():
    data = b"#!stub" + bytes(5000) + make_zip(MEMBERS, method=zipfile.ZIP_STORED)
    fake = b"PK\3\4" + java_random_bytes(3, 500_000)
    assert zip_codec.decompose(fake) is None and zip_codec.decompose(data[:-30]) is None
    opened = zip_codec.decompose(data)
    assert opened is None or zip_codec.rebuild(*opened) == data


@pytest.mark.parametrize("level", [1, 6, 9])
def test_cab_round_trip(level):
    members = [(f"file{100 + i}.dat", text(30_000 + i * 7777, i) if i % 2 else java_random_bytes(i + 1, 100_000 + i * 777)) for i in range(4)]
    data = cab.write(members, level)
    meta, parts = cab.decompose(data)
    assert cab.rebuild(meta, parts) == data and parts == [b for _, b in members]
    assert [n for n, *_ in cab.listing(meta)] == [n for n, _ in members]
    assert cab.decompose(data[:-1]) is None and cab.decompose(b"MSCF" + bytes(100)) is None


def test_nested_versions_rebuild_exactly(spark, tmp_path):
    inner = make_zip([("x.txt", text(4000, 5))])
    v1 = make_zip([("nested/data.zip", inner), ("nested/libs.cab", cab.write([("l.dat", text(9000, 6))])), ("fake.zip", b"PK\3\4" + bytes(100)), ("t.txt", text(5000, 7))])
    v2 = make_zip([("nested/data.zip", inner), ("t.txt", text(5000, 7) + b" more")])
    rows = spark.createDataFrame([("v1", v1), ("v2", v2), ("raw", b"plain bytes"), ("none", b"")], "version_id string, payload binary")
    d = Decomposed(rows, str(tmp_path / "scratch"), ChunkParams(64, 256, 1024))
    counts = {r.version_id: r["count"] for r in d.nodes.filter("kind = 'container'").groupBy("version_id").count().collect()}
    assert counts == {"v1": 3, "v2": 2}
    assert [r.version_id for r in d.events.filter("event = 'opaque'").collect()] == ["v1"]
    made = {r.version_id: bytes(r.payload) for r in rebuild.rebuild_versions(d.nodes, d.refs, d.blocks).collect()}
    assert made == {"v1": v1, "v2": v2, "raw": b"plain bytes", "none": b""}
    one, two = (d.refs.filter(F.col("version_id") == v) for v in ("v1", "v2"))
    shared = two.join(one.select("hash").distinct(), "hash", "left_semi").agg(F.sum("length")).first()[0]
    assert shared > 0.5 * two.agg(F.sum("length")).first()[0]


def test_repack(tmp_path):
    members = [(n, b) for n, b in MEMBERS if b]
    assert repack.repack(members, RepackMode.ZIP, str(tmp_path / "x.zip"))["entries"] == 3
    assert repack.repack(members, RepackMode.EXTRACT, str(tmp_path / "x"))["content_bytes"] == sum(len(b) for _, b in members)
    with pytest.raises(ValueError):
        repack.write_dir([("../up", b"")], str(tmp_path / "x"))


def test_directory_scan(spark, tmp_path):
    files = {"readme.txt": b"hello", "noise.bin": b"123456789", "bundle.pak": make_zip(MEMBERS), "incoming.zip.part": make_zip(MEMBERS), "app.zip": make_zip(MEMBERS), "app.cab": cab.write([("a", b"x" * 99)]), "_under.zip": make_zip(MEMBERS), ".hid.zip": make_zip(MEMBERS)}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    found = {r.name: (r.id, r.format, r["rank"]) for r in scan.candidates(scan.list_directory(spark, str(tmp_path))).collect()}
    assert found == {"bundle.pak": ("bundle", "ZIP", 1), "app.cab": ("app", "CAB", 1), "app.zip": ("app", "ZIP", 2), "_under.zip": ("_under", "ZIP", 1)}
    got = scan.payloads(spark.createDataFrame([("app", str(tmp_path / "app.zip"))], "id string, path string")).first()
    assert bytes(got.payload) == files["app.zip"] and scan.read_slice(str(tmp_path / "readme.txt"), 1, 3) == b"ell"


def test_scalars():
    assert scalars.java_hash("f0000001.txt") == -1 * 0 + scalars.java_hash("f0000001.txt") and scalars.java_hash("hello") == 99162322 and scalars.java_hash("") == 0
    assert scalars.parse_size("1.5 KiB") == 1536 and scalars.parse_size("64") == 64
    with pytest.raises(ValueError):
        scalars.parse_size("x")
    assert scalars.cab_checksum(b"\1\0\0\0\2\0\0\0") == 3 and scalars.cab_checksum(b"\1\2\3") == 0x010203
    assert scalars.sanitise_name("a\\b") == "a/b" and scalars.sanitise_name("a/") is None and scalars.sanitise_name(None) is None
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
