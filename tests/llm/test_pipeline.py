import re

import corpus_pipeline
from pyspark.sql import functions as F

from blockloom.llm import neardup, quality
from blockloom.llm.common import materialise

SF = "/root/testdata/sf0.001"


def first_of_groups(rows, pct):
    """The least id of every group of texts that links of at least pct percent of their 5-word shingles connect."""
    sets = []
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    label = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= pct * len(a | b) and label[i] != label[j]:
                old, new = sorted((label[i], label[j]), reverse=True)
                label = {x: new if y == old else y for x, y in label.items()}
    return set(label.values())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, f in corpus_pipeline.STAGES:
        steps.append(materialise(f(spark, steps[-1], SF), name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_windows"]
    assert all(s.columns == docs.columns for s in steps[:-1])
    clean, lines, single, mixed, packed = steps[1:]
    good = {r.doc_id for r in quality.op10(docs).filter("kept").collect()}
    assert {r.doc_id for r in clean.collect()} == good
    assert {r.doc_id for r in lines.collect()} <= good
    assert {r.doc_id for r in single.collect()} == first_of_groups([(r.doc_id, r.text) for r in lines.collect()], 80)
    assert neardup.op4(single).filter("NOT kept").count() == 0
    copies = mixed.groupBy("doc_id").count()
    assert copies.filter("count > 3").count() == 0 and mixed.join(single, "doc_id", "left_anti").count() == 0
    per = packed.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.max("doc_tokens").alias("n"))
    wrong = per.join(copies, "doc_id", "full").filter("tokens IS NULL OR tokens != n * count")
    assert wrong.count() == 0
    windows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("a"), F.max(F.col("offset") + F.col("length")).alias("b"))
    assert windows.filter("n > 1024 OR a != 0 OR b != n").count() == 0


def test_run_ends_in_windows(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
