import hashlib

from pyspark.sql import functions as F

from pagelantern.llm import chat

NASTY = ["", "\\", "<turn", "</turn", "<\\turn", "</turn>\n", "\n</turn>\n", "<turn:user>\n", "\\\\<turn\\", chat.PROBE, "a\nb", ">", "\\g\\n>>\n"]


def test_escapes_are_reversible(frame):
    rows = frame([(a + b,) for a in NASTY for b in NASTY], "t string")
    bad = rows.where((chat.unescape(chat.escape(F.col("t"))) != F.col("t")) | (chat.unescape_role(chat.escape_role(F.col("t"))) != F.col("t")))
    assert bad.count() == 0
    assert rows.where(chat.escape(F.col("t")).contains("<turn") | chat.escape(F.col("t")).contains("</turn") | chat.escape_role(F.col("t")).rlike("[>\n]")).count() == 0


def test_examples_read_back(frame):
    rows = [(1, 0, "system", "s"), (1, 1, "user", NASTY[6]), (1, 2, "assistant", NASTY[8]), (1, 3, "assistant", None), (1, 4, "user", "tail"), (2, 0, "user", "alone"), (None, 0, None, "x"), (3, 0, "assistant", "r"), (3, 0, "assistant", "r")]
    made = chat.examples(frame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string"))
    got = made.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", F.expr("substring(formatted, loss_start + 1, loss_chars)")).withColumn("loss", chat.unescape(F.col("loss"))).collect()
    by = {(r.conv_id, r.example_no): r for r in got}
    assert {k: r.loss for k, r in by.items()} == {(1, 0): NASTY[8], (1, 1): "", (1, 2): "", (2, 0): "", (None, 0): "", (3, 0): "r", (3, 1): "r"}
    assert [(t.role, t.text) for t in by[1, 2].turns] == [("system", "s"), ("user", NASTY[6]), ("assistant", NASTY[8]), ("assistant", ""), ("user", "tail")]
    assert by[1, 0].target_turn == 2 and by[1, 2].target_turn is None and [len(by[1, k].turns) for k in range(3)] == [3, 4, 5]
    assert chat.examples(frame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_on_table(spark, sf_dir):
    convs = {-7: [("user", chat.PROBE), ("assistant", chat.PROBE)]}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.op10_chat(spark, sf_dir).collect()}
    assert got.keys() == convs.keys()
    for k, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))


def test_a_very_long_text(frame):
    long = "</turn> word \\ " * 200_000
    made = chat.examples(frame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string"))
    got = made.select(F.expr("substring(formatted, loss_start + 1, loss_chars)").alias("loss"), chat.parsed(F.col("formatted")).alias("turns")).select(chat.unescape(F.col("loss")).alias("loss"), "turns").first()
    assert got.loss == long and [t.text for t in got.turns] == [long, long]
