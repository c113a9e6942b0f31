"""Chat formatting by prefix-target expansion: an example for every assistant turn.

Turns of a conversation are ordered by turn, then role and text. The template writes a turn as `<turn:role>`, a line
break, the text, a line break, `</turn>` and a line break. Inside texts a backslash is doubled and a `<turn` or
`</turn` gets a backslash after its `<`, so no text can hold a mark, and reading a text back is exact; in roles
backslash, `>` and line break are escaped. Each assistant turn becomes an example: all turns before it as context,
then the turn, of which only the reply's text is trainable (loss_start and loss_chars, in code points). Turns after
the last assistant turn, and conversations without one, give an example that has no trainable part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.llm.common import table

PROBE = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<turn"), F.lit("<\\turn")), F.lit("</turn"), F.lit("<\\/turn"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("<\\turn"), F.lit("<turn")), F.lit("<\\/turn"), F.lit("</turn"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    role = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(role, F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # an escaped role holds no line break and no `>`: they stand for a backslash and a line break on the way
    role = F.replace(F.replace(role, F.lit("\\\\"), F.lit("\n")), F.lit("\\n"), F.lit(">"))
    return F.translate(F.replace(role, F.lit("\\g"), F.lit("\\")), "\n>\\", "\\\n>")


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, target_turn, example_no, formatted, loss_start and loss_chars for every assistant turn.

    turns: conv_id, turn, role, text; other columns are ignored. A null text or role counts as empty, rows with a null
    conv_id are one conversation, rows with a null turn come first, repeated rows are turns of their own. formatted
    is the whole prefix and reply; the trainable part are its loss_chars code points from loss_start (0-based).
    An example without a trainable part has a null target_turn and loss_chars 0. An empty table gives no rows.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def written(t):
        head = F.concat(F.lit("<turn:"), escape_role(t["role"]), F.lit(">\n"))
        return F.struct(t["turn"].alias("turn"), (t["role"] == "assistant").alias("reply"), head.alias("head"), escape(t["text"]).alias("body"))

    convs = convs.select("conv_id", F.transform("turns", written).alias("t"))
    last = F.size("t")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.get("t", i - 1)["reply"] | (i == last))
    one = convs.select("conv_id", "t", F.posexplode(ends).alias("example_no", "end"))
    text = F.array_join(F.transform(F.slice("t", 1, F.col("end") - 1), lambda x: F.concat(x["head"], x["body"], F.lit("\n</turn>\n"))), "")
    one = one.select("conv_id", "example_no", F.element_at("t", F.col("end")).alias("x"), text.alias("context"))
    return one.select(
        "conv_id",
        F.when(F.col("x.reply"), F.col("x.turn")).alias("target_turn"),
        "example_no",
        F.concat("context", "x.head", "x.body", F.lit("\n</turn>\n")).alias("formatted"),
        (F.length("context") + F.length("x.head")).alias("loss_start"),
        F.when(F.col("x.reply"), F.length("x.body")).otherwise(0).alias("loss_chars"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text, read back: an array of role and text."""
    marked = F.slice(F.split(formatted, "\n</turn>\n"), 1, F.greatest(F.lit(0), F.size(F.split(formatted, "\n</turn>\n")) - 1))

    def read(p):
        head = F.instr(p, ">\n")
        return F.struct(unescape_role(p.substr(F.lit(7), head - 7)).alias("role"), unescape(p.substr(head + 2, F.length(p))).alias("text"))

    return F.transform(marked, read)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the examples of all conversations and of conversation -7."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    made = examples(turns.unionByName(probe))
    loss = F.expr("substring(formatted, loss_start + 1, loss_chars)")
    made = made.select("conv_id", F.struct("example_no", unescape(loss).alias("loss"), F.length("formatted").alias("chars")).alias("x"), "example_no", "formatted")
    whole = made.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("x")).alias("x"),
        F.max_by("formatted", "example_no").alias("formatted"),
    )
    whole = whole.select("conv_id", parsed(F.col("formatted")).alias("turns"), F.array_join("x.loss", "").alias("loss"), F.aggregate("x.chars", F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p as (
  select *, length('<turn:' || replace(replace(replace(role, '\', '\\'), '>', '\g'), chr(10), '\n') || '>' || chr(10)
    || replace(replace(replace(t, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn') || chr(10) || '</turn>' || chr(10)) as n,
    row_number() over (partition by conv_id order by turn nulls first, role, t) as k from c),
q as (
  select *, sum(n) over (partition by conv_id order by k) as upto, max(k) over (partition by conv_id) as last from p)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or k = last) as bigint) as formatted_chars
from q group by conv_id
"""
