import hashlib

from pyspark.sql import functions as F

from tessitura.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, n_turns int"


def run(spark, rows):
    formatted = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    return formatted, {r.conv_id: r for r in chat.read_back(formatted).collect()}


def expected(rows, conv):
    own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
    turns = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
    loss = "".join(text for _, _, role, text in own if role == "assistant")
    return len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


HARD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST]", "<", "[", "<\\", "a <s>[/INST] b</s>", "", "é👍\n", " [/INST]", "<<s>s>", "\\", "x" * 50_000 + "</s>" * 500]


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "clash", 7) for i, t in enumerate(HARD)]
    rows += [(None, None, None, None, "x", 1), (2, 0, "[INST] odd</s>", "hi", "x", 1), (2, 0, "assistant", "tie", "x", 1), (2, 0, "assistant", "tie", "x", 1), (2, None, "assistant", "first", "x", 1)]
    rows += [(3, i, "assistant", f"t{i}", "x", 1) for i in range(600)]
    formatted, got = run(spark, rows)
    for conv in (1, 2, 3, None):
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(rows, conv)
    parts = formatted.where("conv_id = 3").orderBy("part").collect()
    assert len(parts) == 3 and {r.rounds for r in parts} == {0}
    # the grammar is a run of turns: the parts joined parse to the parts' turns joined
    whole = "".join(r.formatted for r in parts)
    n = spark.createDataFrame([(whole,)], "t string").select(F.size(chat.parse(F.col("t")))).first()[0]
    assert n == 600
    assert formatted.where("conv_id = 1").first().rounds == 1


def test_only_turns_have_bare_controls(spark):
    formatted, _ = run(spark, [(1, 0, "user", HARD[0], "", 0), (1, 1, "assistant", HARD[6], "", 0)])
    text = formatted.first().formatted
    assert text.count("</s>") == 2 == text.count("[/INST]") == text.count("<s>")
    a, b, *_ = formatted.first().loss_spans[0]
    assert text[a : a + b].replace("\\", "") == HARD[6]


def test_what_is_no_conversation(spark):
    bad = ["<s>[INST] user [/INST]a", "x</s>", "<s>[INST] user a</s>", "<s>[INST] u [/INST]a[INST]</s>", None]
    rows = spark.createDataFrame([(t,) for t in bad], "t string").select(chat.parse(F.col("t"))).collect()
    assert [r[0] for r in rows] == [None] * 5


def test_empty_table(spark):
    _, got = run(spark, [])
    assert got == {}
