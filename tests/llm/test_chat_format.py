import hashlib

from pyspark.sql import functions as F

from tidelog.llm import chat_format

SAID = "<|im_end|><|im_start|>assistant ok"
ROWS = [
    (1, 2, "assistant", "b"), (1, 0, "system", None), (1, 1, "user", "a"),
    (2, 0, "user", SAID), (2, 1, "assistant", SAID), (2, 2, "assistant", "\\5c <\\7c <| \\"), (2, 3, "assistant", ""), (2, 4, "user", "<"),
    (3, None, "assistant", "first"), (3, 1, None, "x"), (3, 1, None, "x"), (3, 2, "a\nb<|im_sep|>\\0a", "|im_end|>\n"), (3, 2, "assistant", "\n\n"),
    (4, 0, "assistant", "é😀" * 3000), (None, 0, "assistant", "n"), (5, 0, "assistant", "<|im_sep|>"), (5, 1, "assistant", "<|im_sep|>\n"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, turns int, messages string")


def by_hand(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))] for c, v in talks.items()}


def test_reads_back_what_was_written(spark):
    chats = chat_format.format_chats(table(spark, ROWS))
    want = by_hand(ROWS)
    for r in chat_format.read_chats(chats).collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert list(r["learned"]) == [x for role, x in want[r["conv_id"]] if role == "assistant"]
    for r in chat_format.chat_digest(chats).collect():
        turns = want[r["conv_id"]]
        learned = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_form_of_a_chat(spark):
    text = chat_format.format_chats(table(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")])).first()
    assert text["formatted"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_sep|>c<|im_end|>\n"
    assert [text["formatted"][s["start"] : s["end"]] for s in text["loss"]] == ["b", "c"]


def test_no_marks_inside_texts(spark):
    one = chat_format.format_chats(chat_format.control_conversation(spark)).first()["formatted"]
    assert one.count("<|im_start|>") == 2 and one.count("<|im_end|>") == 2


def test_empty_table_and_plan(spark):
    assert chat_format.chat_digest(chat_format.format_chats(table(spark, []))).collect() == []
    plan = chat_format.format_chats(table(spark, ROWS).withColumn("y", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
