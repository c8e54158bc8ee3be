import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.piece_bpe import encoded, model

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return model(PATH)


def agree(own, text):
    ids = LIBRARY.encode(text, add_eos=True)
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aeinorst .,!\n▁é😀日\t\xa0<>0x", max_size=120)))
def test_any_text(text):
    agree(model(PATH), text)


def test_special_texts(own):
    for t in ("", " ", "  ", "     a", "▁▁ a", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "a\r\nb", "\n\n", "é", "é", "a" * 2000, "ab" * 999, "ﬁ", "�", "!!!!????", "a.b,c", "'s don't"):
        agree(own, t)


def test_pairs_of_pieces(own):
    rnd = random.Random(3)
    for _ in range(3000):
        agree(own, "".join(own.pieces[rnd.randrange(3, 32000)] for _ in range(rnd.randrange(1, 4))).replace("▁", " "))


def test_decoding_of_any_ids(own):
    rnd = random.Random(4)
    for _ in range(2000):
        ids = [rnd.randrange(3, 260 if rnd.random() < 0.4 else 32000) for _ in range(rnd.randrange(7))]
        assert own.decode(ids) == LIBRARY.decode(ids)


def test_merging_agrees_with_the_prefix_table(own):
    rnd = random.Random(5)
    for _ in range(500):
        w = "▁" + "".join(rnd.choice(["tion", "er", "an", "th", "ou", "e", "s"]) for _ in range(rnd.randrange(1, 9)))
        assert own.word_ids(w) == own.merged(w)


def test_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in encoded(docs, PATH, ["doc_id"], ids=True).collect():
        ids = LIBRARY.encode(text[r.doc_id], add_eos=True)
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == LIBRARY.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_odd_and_empty_tables(odd, empty, odd_rows):
    rows = encoded(odd, PATH, ["doc_id"], ids=True).collect()
    want = sorted(str(LIBRARY.encode(r[1] or "", add_eos=True)) for r in odd_rows)
    assert sorted(str(r.token_ids) for r in rows) == want
    assert encoded(empty, PATH, ["doc_id"]).count() == 0
