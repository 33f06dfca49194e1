"""Chat formatting: exact round trip and digests against plain Python."""

import hashlib
import random

from storyspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
BITS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<", "|", "\\", "<\\|", "</s>", "[INST]", "[/INST]", "[\\INST]", "é", "😀",
        "\n", "<s>", "$1", "%0A", "user", " "]


def brute(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        joined = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        learned = "".join(x for _, _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256(joined.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_round_trip(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a\nb%", None, "<|im_sep|>"]), "".join(r.choices(BITS, k=r.randrange(9))), "x")
            for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [(100, 1, "user", None, "x"), (101, None, None, None, "x"), (102, 1, "user", "a", "x"), (102, 1, "user", "a", "x"),
             (102, 1, "assistant", "b", "x"), (None, 3, "assistant", "n", "x"), (None, None, "user", "m", "x"), (103, 0, "assistant", "<|" * 90000, "x")]
    rows += [(104, t, "user" if t % 7 else "assistant", f"t{t}", "x") for t in range(4000)]
    r.shuffle(rows)
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.chat_digest(out).collect()}
    assert got == brute(rows)
    for x in out.collect():
        assert "".join(s.text for s in x.segments) == x.formatted
        assert all("<|im" not in s.text and "</s>" not in s.text and "[INST]" not in s.text for s in x.segments if s.loss)


def test_adjacent_turns_merge(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "[INST]", "")]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\n[\\INST]<|im_end|>\n"
    assert [s.text for s in got.segments if s.loss] == ["[\\INST]"]


def test_empty_table(spark):
    assert chat.chat_digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
