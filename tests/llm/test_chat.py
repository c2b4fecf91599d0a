import hashlib

from pyspark.sql import functions as F

from sparkveil.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_msg|>x", "[\\INST] [\\\\INST] \\", "<<s>> <<SYS>><</SYS>> <<\\SYS>>", "<\\|im_sep|><|im_sep|>", "", None, "é😀\n<|endoftext|>", "<", "[", "|im_end|>\n", "$1 \\n"]


def test_round_trip_of_control_strings(spark):
    rows = []
    for c in range(6):
        for i, t in enumerate(NASTY[c:] + NASTY):
            rows.append((c, i, ["user", "assistant", "assistant", "system", None, "<s>tool\n"][(i * (c + 1)) % 6], t, "z"))
    rows += [(None, 1, "user", "a", "z"), (None, None, "assistant", "b", "z"), (9, 1, "assistant", "d", "z"), (9, 1, "assistant", "d", "z"), (9, 1, "assistant", "c", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, p string")
    made = chat.format_conversations(df).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in made.collect()}
    digests = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == [(w[2], w[3]) for w in want]
        said = "".join(w[3] for w in want if w[2] == "assistant")
        d = digests[c]
        assert d.loss_chars == len(said) and d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{w[2]}\n{w[3]}\n" for w in want).encode()).hexdigest()
        assert d.n_turns == len(want) and d.formatted_chars == len(r.formatted)
        groups = sum(1 for i, w in enumerate(want) if i == 0 or want[i - 1][2] != w[2])
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == groups
        for mark in chat.CONTROLS[4:]:
            assert mark not in r.formatted


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(df)).count() == 0
    assert chat.digest(chat.format_conversations(chat.with_control_conversation(df))).first().n_turns == 2


def test_a_very_long_turn(spark):
    long = "palabra </s> [INST] " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.n_turns == 2 and got.loss_chars == len(long) and got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
