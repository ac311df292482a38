import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docdelta.llm.bpe import Encoder, model_of
from docdelta.llm.encoding import encode_documents

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = ["", "It's <|endoftext|> ok <|startoftext|>'s", "İstanbul ΑΣΑΣ ß ﬁ é é 你好 \x1c\x1d a\xa0b  \n\n x ", "🙂🙃 àb ½ ² ①", "a" * 3000, "a " * 300, "\t\t  \n", "don't I'LL we'Re", "AͅΙͅ ǅ ŉ", "1234567890 12.5 a1b2"]


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    path = public_tokenizers.path(request.param)
    return Encoder(model_of(path)), Tokenizer.from_file(path)


def test_as_the_library(both):
    ours, library = both
    for text, ids in zip(TEXTS, ours.encode_all(TEXTS)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted, text[:40]
        assert ours.decode(ids) == library.decode(wanted, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    for name in NAMES:
        path = public_tokenizers.path(name)
        assert Encoder(model_of(path)).encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_pairs_by_exact_merging():
    """A pair is compatible if and only if merging its symbols gives the pair back."""
    model = model_of(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, random = Encoder(model), np.random.default_rng(7)
    ids = [i for i in range(model.size) if model.raw[i] and i not in model.specials.values()]
    a, b = random.choice(ids, 3000), random.choice(ids, 3000)
    exact = [model.merge([*model.raw[x], *model.raw[y]]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert encoder.compatible(a.astype(np.int64), b.astype(np.int64)).tolist() == exact


def test_rows(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = encode_documents(odd, path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(empty, path).count() == 0
    assert set(encode_documents(odd, path, ids=True).columns) >= {"ids", "decoded"}
