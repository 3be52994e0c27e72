"""Which lines fail, whatever their language."""

import pytest

from blockloom.llm import quality

GOOD = [
    "A sentence that ends as it should.", "Wirklich?", "Он сказал: «Да».", "Kurz.", "这是一个句子。", "He said \"no.\"", "- An item that is a sentence.", "a long line of words without any mark at its end", "In 1998 there were 12 of them.",
    "Éa ue de la que el os.", "", "   ",
]
BAD = [
    "Contact us", "READ THIS NOW PLEASE EVERYBODY", "- item one of the list here", "home | about | contact | login", "the story goes on in the next part...", "12 345 678 90 (11) 22 33", "Wir verwenden Cookies auf dieser Seite.",
    "buy! now! it! is! cheap!", "YWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5eg.", "a $$$ b %%% c ### d.", "• rendez-vous de la semaine en ville",
]


@pytest.mark.parametrize(("lines", "fail"), [(GOOD, 0), (BAD, len(BAD))])
def test_lines(spark, lines, fail):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = quality.op10(docs).orderBy("doc_id").collect()
    assert [lines[r.doc_id] for r in got if r.n_bad_lines != (fail > 0)] == []


def test_document_loses_lines_and_stays(spark):
    prose = "Ann sat by the river until night came.\nBo went home early, for it had rained.\nNobody else knew when June would end."
    docs = spark.createDataFrame([(1, f"Menu\n{prose}\nRead more..."), (2, "Menu\nRead more...\nHome | News | Sports\n" + "Click\n" * 9 + "Only this line is a whole sentence.")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in quality.stage(docs).collect()] == [(1, prose)]
