import hashlib

import public_tokenizers

from palisade.llm import chat

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, ids string, mask int"


def brute(turns):
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    form = "".join(f"<|start|>{chat.escape(r or '')}<|sep|>{chat.escape(t or '')}<|end|>" for r, t in turns)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), digest(every), len(loss), digest(loss), len(form)


def conversations(rows):
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        found.setdefault(conv, []).append((role, text))
    return {conv: brute(turns) for conv, turns in found.items()}


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = chat.read_back(chat.format_turns(frame, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_whole_table(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert run(spark, rows) == conversations(rows)


def test_control_strings_come_back(spark):
    tricky = "</s>[INST] ok [/INST]<|start|><\\|end|><\\\\|sep|> [\\INST] <s <|nope|> \\"
    rows = [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky), (4, 0, "<|start|>", "\U0001f600 é \x00")]
    assert run(spark, rows) == conversations(rows)
    assert chat.unescape(chat.escape(tricky)) == tricky
    form = chat.Template(RANKS, PATTERN)
    ids, mask = form.turn("assistant", tricky)
    assert sum(i in form.marks for i in ids) == 3
    assert form.render(ids).count("<|start|>") == 1 and "</s>" not in form.render(ids)
    assert chat.unescape(form.encoding.decode([i for i, m in zip(ids, mask) if m])) == tricky


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", ""), (1, 1, "assistant", "word " * 20000), (None, 3, "user", "x"),
            (2, 5, "user", "late"), (2, 1, "user", "early"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    assert run(spark, rows) == conversations(rows)
    assert run(spark, []) == {}


def test_a_long_conversation_is_one_stream(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)]
    assert run(spark, rows) == conversations(rows)
