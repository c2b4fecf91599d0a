import zlib

import numpy as np
import pytest

from sparkveil.llm import packing
from sparkveil.llm.tokens import WordTokenizer, public_path

TEXTS = [None, "", "  ", "Hello, world! It's a test... don't <|endoftext|> stop", "É è ß ﬁ é İstanbul ΣΑΣ, 1234 #$%", "a\x1cb c d　e", "word " * 9000, "x" * 5000, "ünï.cödé; " * 300]


@pytest.fixture(scope="module")
def tok():
    return WordTokenizer(public_path("word_bpe_49k.json"), most=50)


def plain_ids(tok, text):
    return tok.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_equal_direct_ids(tok):
    for text in TEXTS * 2:
        assert tok.encode(text).tolist() == plain_ids(tok, text)


def test_pieces_cover_each_text_once(spark, tok):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id"), (3, "again")]
    got = packing.pack(spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, bucket int")).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    want = sorted((d, tuple(plain_ids(tok, t) + [2])) for d, t in rows if d is not None and d != 3)
    for d, ids in want:
        at = 0
        for r in sorted((r for r in got if r.key == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in got)
    assert total == sum(len(plain_ids(tok, t)) + 1 for _, t in rows)
    assert 4096 * len(seqs) - total < 4096


def test_limits_hold_at_once():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 60, 400)
    loss = np.minimum(tokens, rng.integers(0, 40, 400))
    limits = packing.Limits(tokens=200, segments=9, loss=90)
    seqs = packing.place(tokens, loss, limits)
    done = np.zeros(400, int)
    for seq in seqs:
        assert sum(n for _, _, n in seq) <= 200 and len(seq) <= 9
        assert sum(max(0, s + n - max(s, tokens[k] - loss[k])) for k, s, n in seq) <= 90
        for k, s, n in seq:
            assert s == done[k] and n > 0
            done[k] += n
    assert (done == tokens).all()


def test_instruction_data_under_three_limits(spark, tok):
    """Prompts bear no loss. By turns tokens, segments and loss-bearing tokens are what fills a sequence."""
    rng = np.random.default_rng(5)
    rows, bears = [], {}
    for k in range(300):
        prompt, answer = ("ask " * int(rng.integers(1, 40))).strip(), ("tell " * int(rng.integers(1, 30))).strip()
        ids = plain_ids(tok, f"{prompt} {answer}")
        bears[k] = (len(ids) + 1, len(plain_ids(tok, answer)) + 1)
        rows.append((k, f"{prompt} {answer}", bears[k][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer long")
    for limits, binding in ((packing.Limits(300, 1000, 10_000), 0), (packing.Limits(4000, 6, 10_000), 1), (packing.Limits(4000, 1000, 90), 2)):
        got = packing.pack(docs, limits=limits, loss="answer").collect()
        use = {}
        for r in got:
            n = use.setdefault(r.sequence_id, [0, 0, 0])
            n[0], n[1], n[2] = n[0] + r.length, n[1] + 1, n[2] + r.loss_length
        most = (limits.tokens, limits.segments, limits.loss)
        assert all(a <= b for n in use.values() for a, b in zip(n, most, strict=True))
        full = sorted((n[binding] / most[binding] for n in use.values()), reverse=True)
        assert full[len(full) * 3 // 4] >= 0.95, binding
        for k, (n, loss) in bears.items():
            own = [r for r in got if r.key == k]
            assert sum(r.length for r in own) == n and sum(r.loss_length for r in own) == loss


def test_a_text_longer_than_a_sequence_keeps_the_limit_of_loss(spark, tok):
    rows = [(1, "tell " * 9000, None), (2, "ask " * 5000 + "tell " * 3000, 3001), (3, "ask " * 9000, 0), (4, "tell", 1), (5, "ask " * 300, 5)]
    docs = spark.createDataFrame([(k, t.strip(), n) for k, t, n in rows], "doc_id long, text string, answer long")
    limits = packing.Limits(4096, 1024, 1024)
    got = packing.pack(docs, limits=limits, loss="answer").collect()
    use = {}
    for r in got:
        n = use.setdefault(r.sequence_id, [0, 0, 0])
        n[0], n[1], n[2] = n[0] + r.length, n[1] + 1, n[2] + r.loss_length
    assert all(n[0] <= 4096 and n[1] <= 1024 and n[2] <= 1024 for n in use.values())
    for k, t, n in rows:
        ids = [*plain_ids(tok, t.strip()), 2]
        own = sorted((r for r in got if r.key == k), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert sum(r.loss_length for r in own) == (len(ids) if n is None else n)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
