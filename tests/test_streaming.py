from blockloom import generator, model
from blockloom.streaming.versions import watch


def test_files_trigger_the_batch_comparison(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []

    def index():
        return spark.createDataFrame([], model.VERSIONS), spark.createDataFrame([], "id string")

    def ingest(rows):
        seen.append(sorted((r.id, r.action) for r in rows.collect()))

    for name in ("a.zip", "b.zip", "note.txt"):
        (tmp_path / "in" / name).write_bytes(generator.pack_zip([("x", b"y" * 50)]) if name != "note.txt" else b"hello")
        q = watch(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), index, ingest)
        q.awaitTermination(60)
    assert seen[0] == [("a", "new")] and seen[1] == [("a", "new"), ("b", "new")]
