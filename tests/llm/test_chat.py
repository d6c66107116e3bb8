import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat

TEXTS = [
    "plain", "", None, "</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>", "back\\slash \\<|end|>", "a<",
    "|end|>", "<<SYS>> s <</SYS>>\n", "\\", "tail\\", "\U0001f600 ünï <s> </s>", "\n\n", "[/INST][INST]",
]
ROLES = ["user", "assistant", None, "odd\nrole", "<|end|>", "assistant"]


def rows():
    out = []
    for c in range(6):
        for t in range(40):
            role = "system" if t == 0 and c % 2 else ROLES[(t + c) % len(ROLES)]
            text = TEXTS[(t * 5 + c) % len(TEXTS)]
            if t % 7 == 3:
                text = f"word {t} " * (20 * c + t)
            out.append((c, t, role, text, "extra"))
    out += [(7, 0, "system", "only this", "e"), (8, None, "assistant", "null turn", "e")]
    out += [(None, 1, "assistant", "null conversation", "e"), (9, 1, "user", "tie", "e")]
    out += [(9, 1, "user", "tie", "e"), (9, 1, "assistant", "tie", "e")]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        rows(), "conv_id long, turn long, role string, text string, window string"
    ).repartition(4)


def ordered(conv):
    own = [r for r in rows() if r[0] == conv]
    key = [(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in own]
    return [(k[2], k[3]) for k in sorted(key)]


def test_round_trip(table):
    got = {r.conv_id: r for r in chat.read_back(chat.windows(table, budget=200, history=30)).collect()}
    assert set(got) == {r[0] for r in rows()}
    for conv, r in got.items():
        turns = ordered(conv)
        assert r.n_turns == len(turns)
        assert r.turns == "".join(f"{a}\n{b}\n" for a, b in turns)
        assert r.learned == "".join(b for a, b in turns if a == "assistant")


def test_windows_keep_their_budget(table):
    budget, history = 200, 30
    found = chat.windows(table, budget=budget, history=history)
    rows_ = found.withColumn("turns", chat.turns_of(F.col("formatted"))).collect()
    assert any(r.n_repeated > 1 for r in rows_)
    for r in rows_:
        assert len(r.turns) == r.n_turns > r.n_repeated
        system = ordered(r.conv_id)[0]
        if system[0] == "system":
            assert (r.turns[0].role, r.turns[0].text) == system
        longest = max(
            len([w for w in t.text.split()]) for t in r.turns
        )
        if longest < 20:
            assert r.n_tokens <= budget
        for a, b in r.loss:
            assert r.formatted[b:].startswith(chat.CLOSE)
    # control strings occur only where the template puts them
    for r in rows_:
        bare = r.formatted
        assert bare.count(chat.OPEN) == bare.count(chat.CLOSE) == r.n_turns
        assert not any(c in bare.replace(chat.OPEN, "").replace(chat.CLOSE, "") for c in chat.CONTROL)


def test_blocks_do_not_change_the_result(table, monkeypatch):
    want = sorted(map(tuple, chat.windows(table, 200, 30).collect()), key=repr)
    monkeypatch.setattr(chat, "BLOCK", 3)
    assert sorted(map(tuple, chat.windows(table, 200, 30).collect()), key=repr) == want


def test_escape_is_reversible(spark):
    texts = [t for t in TEXTS if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(chat.unescaped(chat.escaped(F.col("t"))), chat.escaped(F.col("t"))).collect()
    assert [r[0] for r in got] == texts
    assert not any(c in r[1] for r in got for c in chat.CONTROL)


def test_empty(table):
    assert chat.read_back(chat.windows(table.limit(0))).count() == 0
