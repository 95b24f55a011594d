import hashlib
import random
import re

import numpy as np

from palisade.llm import infill
from tests.llm.helpers import ODD, documents, rows_of

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    """The contract, with a list of tokens."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def strings(count):
    rng = random.Random(3)
    odd = ["a", "Zz", " ", "\n", "é", "日本", "\U0001f600", "<", "P", ">", "S>", "<M", "7", "ſ", "K", "x" * 70, "\x00"]
    for _ in range(count):
        yield "".join(rng.choice(odd) for _ in range(rng.randint(0, 90)))


def test_ranks_count_codes():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 500):
        codes = rng.integers(0, 8, size).astype(np.uint8)
        matrix = infill.WaveletMatrix(codes, 3)
        for end in {0, size, size // 2, min(64, size)}:
            for code in range(8):
                assert matrix.rank(code, end) == int((codes[:end] == code).sum())
                assert matrix.rank(code, end, depth=1) == int((codes[:end] >> 2 == code >> 2).sum())


def test_every_cut_is_where_the_tokens_end():
    for text in strings(300):
        tokens, own = TOKEN.findall(text), infill.Tokens(text)
        assert own.count == len(tokens)
        assert [own.place(k) for k in range(len(tokens) + 1)] == [len("".join(tokens[:k])) for k in range(len(tokens) + 1)]


def test_same_as_a_list_of_tokens():
    for doc_id, text in enumerate(strings(3000)):
        assert tuple(infill.infill(doc_id, text)) == plain(doc_id, text)


def test_odd_rows_and_restoring(spark):
    rows = ODD + [(k, t) for k, t in enumerate(strings(300), 100)] + [(50, "a <P> b"), (51, "x<S>"), (52, "<M>"), (53, "<P <S <M P>")]
    docs = documents(spark, rows, "n form output digest")
    made = infill.fill_in_middle(docs)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert rows_of(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted(
        ((i, *plain(i, t)) for i, t in rows), key=key)
    again = made.select("doc_id", infill.restored("output", "form").alias("text"))
    assert rows_of(again, "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    assert infill.report(docs.where("false")).count() == 0


def test_a_very_long_text():
    text = "word, " * 400_000 + "x" * 1_000_000
    assert tuple(infill.infill(12, text)) == plain(12, text)
