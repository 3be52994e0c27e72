"""Strings of added tokens in texts get the ids that the library gives them by default."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from blockloom.llm import bitplane, packing
from blockloom.llm.tokens import encoder, vocabulary

E, S = "<|endoftext|>", "<|startoftext|>"
TEXTS = [
    f"hello {E} world", E, f"{E}{E}", f" {E} ", f"a{E}b", f"{S}  Two words \n{E}\n\n x", f"{E.upper()} shouted", f"<|EndOfText|>{E}", f"<|endoftext{E}|>",
    f"é{E}\u0301 {S}你好{S}", "plain words only", "", f"{E} 's it's{E}'s", f"x \t {S}\u3000{E}\u00a0y", f"A{E}" * 50,
]


@pytest.mark.parametrize(("name", "spaces"), [(bitplane.VOCABULARY, "dropped"), (packing.VOCABULARY, "kept")])
def test_encoder_as_the_library(name, spaces):
    r = random.Random(6)
    bits = [E, S, E.upper(), "<|", "|>", " ", "  ", "\n", "word", "Word,", "'s", "é", "e\u0301", "你", "7", "\u00a0", "\x85"]
    texts = TEXTS + ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(5000)]
    library = Tokenizer.from_file(vocabulary(name))
    got = encoder(vocabulary(name), spaces).encode(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


@pytest.mark.parametrize(("module", "op", "end"), [(bitplane, "op8", 2), (packing, "op9", 0)])
def test_queries_as_the_library(spark, module, op, end):
    library = Tokenizer.from_file(vocabulary(module.VOCABULARY))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) if op == "op8" else (r.doc_id, r.doc_tokens, r.ids_crc32) for r in getattr(module, op)(docs).collect()}
    ids = [[*x.ids, end] for x in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert got == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}
