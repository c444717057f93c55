"""BPE round trip against the tokenizers library."""
import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from farelens.llm import bpe
from farelens.llm.bpe import BpeModel, bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello's the WORLD 123 a\x1cb", "<|endoftext|>foo <|startoftext|><|endoftext|", "ΑΣ ΟΔΟΣ İstanbul ñ ñ " + "x" * 3000,
         "日本語😀" * 300, "l'été d'où; can't we'LL 'Re", "  tab　wide\x85next", "ß ẞ ǅ ﬁ ㎏ ½ ² Ⅷ ١٢٣", "_-*" * 40,
         "ạ́ ẛ̣ 각", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\0nul <|startoftext|>x"]


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def test_encode_and_decode_like_the_library(theirs):
    model = BpeModel(open(PATH, "rb").read())
    for text, (ids, decoded) in zip(TEXTS, model.encode_block(TEXTS)):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == theirs.decode(want, skip_special_tokens=False)


def test_small_memory_gives_the_same(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 4)
    model = BpeModel(open(PATH, "rb").read())
    text = " ".join(f"word{i}" for i in range(50)) + " <|endoftext|>"
    (ids, _), = model.encode_block([text])
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_round_trip_rows(spark, odd_docs, odd_rows, no_docs, theirs):
    got = sorted(map(tuple, bpe_round_trip(odd_docs, PATH, rewrite=False).collect()), key=str)
    want = []
    for r in odd_rows:
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe_round_trip(odd_docs, PATH).where("doc_id = 103").first()
    assert theirs.decode(full.ids, skip_special_tokens=False) == full.decoded
    assert bpe_round_trip(no_docs, PATH).collect() == []
