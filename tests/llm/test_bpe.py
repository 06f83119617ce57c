"""The encoder against the tokenizers library."""

import random

import pytest

from tasteplane.llm import bpe
from tests.llm.fixtures import ROWS, documents, sha

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return bpe.Encoder(bpe.read_vocabulary(path)), library


def test_ids_and_decoding_equal_the_library(both):
    own, library = both
    rng = random.Random(2)
    signs = "aaabbthe'sdllreve é́ßİΣσς ½²٣\x1c\x1f\x85  　\n\t日本語😀!!..--__"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) + rng.choice(["", "", "<|endoftext|>", "<|startoftext|>x"])
        want = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == want
        assert own.encode(text)[2] == library.decode(want, skip_special_tokens=False)


def test_long_words_take_linear_work(both):
    own, library = both
    for text in ("a" * 100_000, "ab" * 50_000, "!" * 50_000):
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 10)
    text = " ".join(f"word{i}" for i in range(100))
    first = own.ids(text)
    assert own.ids(text) == first and max(len(own._chunks.new), len(own._chunks.old), len(own._words.new)) <= 10


def test_table(spark, both):
    _, library = both
    spec = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*ROWS, (20, "漢字" * 50_000 + "x" * 200_000, "en", "s", 0, None, None)]  # a null doc_id and a long text without spaces among them
    out = bpe.tokenized(documents(spark, rows), spec, with_ids=True, keep=["source"]).collect()
    assert len(out) == len(rows) and {r.doc_id: r.source for r in out} == {r[0]: r[3] for r in rows}
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for r in out:
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == sha(" ".join(map(str, r.ids))) and r.decoded_sha256 == sha(library.decode(r.ids, skip_special_tokens=False))
    assert bpe.tokenized(documents(spark, []), spec).count() == 0
