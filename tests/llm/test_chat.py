import hashlib
import random

from kinsight.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv),
            key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()),
        )
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def rows_of_all_kinds():
    rng = random.Random(3)
    bits = ["</s>", "[INST]", "<|im_end|>", "\\", "<\\/s>", "<\\\\|im_sep|>", "ok", "é", "\n", "<", "[", "🎉", " word " * 30]
    rows = [(1, i, rng.choice(["user", "assistant", "system", "a<|im_sep|>b"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(300)]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (2, None, "assistant", "first"), (None, 0, "assistant", "none"), (None, None, None, None)]
    rows += [(3, 0, "system", "rules"), (3, 1, "user", "long " * 900), (3, 2, "assistant", "yes " * 700), (3, 3, "user", "b"), (3, 4, "assistant", "c")]
    rows += [(4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice")]
    return rows


def test_read_back_equals_what_was_said(spark):
    rows = rows_of_all_kinds()
    conversations = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", cell string, tokens string")
    got = chat.digests(chat.format_conversations(conversations)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "word " * 60) for i in range(1, 200)]
    windows = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), budget=512).orderBy("first_token").collect()
    assert len(windows) > 30 and all(w.tokens <= 512 for w in windows)
    assert all(w.formatted.startswith("<|im_start|>system<|im_sep|>be kind") for w in windows)
    assert all(w.repeated >= 2 for w in windows[1:])  # the system turn and some history
    assert sum(len(w.loss) for w in windows) == sum(r[2] == "assistant" for r in rows)


def test_escaping_leaves_no_control_string_and_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s>", "<<|im_start|>", "[\\INST]", "<s><s>", "\\", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", chat.escaped(frame.t).alias("e"), chat.unescaped(chat.escaped(frame.t)).alias("u")).collect()
    assert all(r.u == r.t for r in got)
    assert not any(c in r.e for r in got for c in chat.CONTROLS)


def test_no_conversations(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
