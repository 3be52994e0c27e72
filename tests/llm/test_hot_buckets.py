from blockloom.llm import neardup


def test_hot_buckets_give_the_same_groups(spark, monkeypatch):
    """Buckets that a third of all documents share are parted by name and not by the shuffle; nothing else changes."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:200] + [f"x{i}"] + base[200:])) for i in range(60)]
    rows += [(100 + i, " ".join(f"d{i // 2}q{j}" for j in range(80)) + f" end{i}") for i in range(40)] + [(900, None), (901, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def groups():
        return sorted(map(str, neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()))

    plain = groups()
    t = neardup.signatures(docs)
    nodes = t.filter("node IS NOT NULL").dropDuplicates(["node"]).select("node", "bands")
    before = sorted(map(tuple, neardup._members(nodes).collect()))
    monkeypatch.setattr(neardup, "HOT_PARTS", 100)
    assert nodes.selectExpr("explode(bands) c").groupBy("c").count().filter(f"count * 100 > {nodes.count() * neardup.BANDS}").count() > 0
    assert sorted(map(tuple, neardup._members(nodes).collect())) == before and groups() == plain
    assert sum("component_id=0" in g for g in plain) == 61
