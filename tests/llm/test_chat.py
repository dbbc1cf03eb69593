import hashlib

from pyspark.sql import functions as F
from quire.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\", "<\\s>", "\\<s>", "<s", "s>", "</", "[", "[\\INST]", "[/INST]\\", "", None, "é🙂\n\r\t", "$1 \\1", "<s>[INST]user[/INST]x</s>"]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(x,) for x in NASTY if x is not None], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_examples(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "z") for i, t in enumerate(NASTY)]
    rows += [(2, 0, "user", "only", "z"), (3, 0, None, None, "z"), (3, None, "assistant", "first", "z"), (4, 0, "assistant", "r", "z"), (4, 0, "assistant", "r", "z"), (None, 1, "assistant", "n", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string").repartition(3)
    examples = chat.expand_prefix_targets(df)
    by = {}
    for r in examples.collect():
        by.setdefault(r.conv_id, []).append(r)
    assert sum(r.has_loss for r in by[1]) == len(NASTY) // 2
    for r in by[1]:
        assert r.formatted.count(chat.OPEN) == r.target
        assert r.formatted[r.loss_end :] == chat.CLOSE
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    for c, r in got.items():
        turns = sorted(((-1 if x[1] is None else x[1]), x[2] or "", x[3] or "") for x in rows if x[0] == c)
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{b}\n{t}\n" for _, b, t in turns).encode()).hexdigest()
        loss = "".join(t for _, b, t in turns if b == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(e.formatted) for e in by[c])


def test_empty_table(spark):
    assert chat.read_back(chat.expand_prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
