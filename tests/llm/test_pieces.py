import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from palisade.llm import pieces, tries
from tests.llm.helpers import ODD, documents, rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(MODEL)


def strings(own, count):
    rng = random.Random(5)
    short = [p for p in own.ids if len(p) < 6]
    odd = ["\n", "\t", " ", "  ", "▁", "é", "日", "\U0001f600", "\x00", "://", "\r\n", "a" * 40, "ﬁ", " ", " " * 17]
    for _ in range(count):
        yield "".join(rng.choice(short if rng.random() < 0.6 else odd) for _ in range(rng.randint(0, 15)))


def test_same_ids_as_the_library(own, library):
    for text in strings(own, 3000):
        assert own.encode(text) == library.encode(text)


def test_long_units_take_the_same_ids(own, library):
    rng = random.Random(6)
    short = [p.strip("▁") for p in own.ids if len(p) < 5]
    for _ in range(20):
        text = "".join(rng.choice(short) for _ in range(400))
        assert own.encode(text) == library.encode(text)


def test_many_texts_and_small_tries_do_not_change_results(own, library, monkeypatch):
    texts = list(strings(own, 800))
    want = [library.encode(t) for t in texts]
    both = [(ids, ",".join(map(str, ids))) for ids in want]
    assert list(own.encode_all(texts)) == both
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 50)
    monkeypatch.setattr(tries, "CHARACTERS", 30)
    monkeypatch.setattr(tries, "KEPT", 100)
    tight = pieces.Pieces(MODEL)
    assert [x for k in range(0, 800, 16) for x in tight.encode_all(texts[k:k + 16])] == both


def test_a_million_letters_without_a_space(own, library):
    rng = random.Random(8)
    text = "".join(rng.choice("etaoinshr") for _ in range(1_000_000))
    began = time.perf_counter()
    found = own.encode(text)
    assert time.perf_counter() - began < 30  # a few seconds; a quadratic way needs minutes
    assert own.decode(found) == text and own.encode(text[:20_000]) == library.encode(text[:20_000])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))


def test_whole_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs, MODEL).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in docs.collect()}


def test_odd_rows(spark, library):
    docs = documents(spark, ODD, "ids n_tokens")
    got = rows_of(pieces.round_trip(docs, MODEL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert got == sorted(((i, *expected(library, t)) for i, t in ODD), key=key)
    assert pieces.round_trip(docs.where("false"), MODEL).count() == 0


def test_encode_then_decode(spark, library):
    docs = documents(spark, ODD).select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert all(r.decoded == (r.text or "") for r in coded.collect())
