from cpdspark.llm import chat
from tests.llm.brute import sha

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
HARD = "~ ~0 ~1 </s>[INST] ok [/INST] <| \né\U0001f600"


def expected(rows):
    by_conv = {}
    for conv, turn, role, text, _ in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_digest_of_odd_conversations(spark):
    rows = [
        (1, 0, "system", HARD, "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", HARD, None), (1, 3, "assistant", "", "x"),
        (2, 0, "user", "only", "x"), (2, 0, "user", "only", "x"), (3, 1, None, "no role", "x"), (3, None, "assistant", "first", "x"),
        (None, 0, "assistant", "</s", "x"), (None, 1, "as[/INST", "</s>", "x"), (4, 0, "assistant", "</s>" * 3000, "x"),
    ]
    got = chat.digest(chat.layout(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)


def test_examples_hold_all_turns_before_and_one_reply(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "assistant", "b~", ""), (1, 2, "user", "c", ""), (1, 3, "assistant", "d", "")]
    got = sorted(chat.expand(chat.layout(spark.createDataFrame(rows, SCHEMA))).collect())
    first = "[INST]user[/INST]a</s>[INST]assistant[/INST]"
    second = first + "b~0</s>[INST]user[/INST]c</s>[INST]assistant[/INST]"
    assert [tuple(r) for r in got] == [(1, 2, first, "b~0"), (1, 4, second, "d")]


def test_digest_reads_the_examples(spark):
    """The loss comes out of the rows of ``expand``; putting them together takes no shuffle of its own."""
    df = chat.digest(chat.layout(spark.createDataFrame([(1, 0, "assistant", "a", "")], SCHEMA)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(examples" in plan and plan.count("Exchange") == 1


def test_outer_expand_keeps_conversations_without_reply(spark):
    rows = [(1, 0, "user", "a", ""), (2, 0, "assistant", "b", "")]
    got = sorted(chat.expand(chat.layout(spark.createDataFrame(rows, SCHEMA)), outer=True).select("conv_id", "turn_no", "target").collect())
    assert [tuple(r) for r in got] == [(1, None, None), (2, 1, "b")]


def test_empty_table(spark):
    assert chat.digest(chat.layout(spark.createDataFrame([], SCHEMA))).collect() == []
