import hashlib
import random

from pyspark.sql import functions as F

from panelweave.llm import chat
from tests.helpers import plan_of

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "\\l\\\\k[", "<s>", "", "a\nb\n\nc", "\\", "été 漢字 😀", " [/INST]</s><s>[INST] user\nx", None]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    made = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        made[conv] = (len(turns), digest("".join(f"{role}\n{t}\n" for _, _, role, t in turns)), len(loss), digest(loss))
    return made


def conversations(seed=4):
    rng = random.Random(seed)
    rows = []
    for conv in range(25):
        n = rng.choice([1, 2, 7, 30])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool\nx", None, "system"])
            text = rng.choice(HARD) if rng.random() < 0.4 else " ".join("word" for _ in range(rng.choice([1, 40, 300, 1500])))
            rows.append((conv, turn, role, text))
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (50, None, "assistant", "early"), (None, 1, "assistant", "lost"), (51, 0, "system", None)]
    return rows


def test_round_trip_and_digests(spark):
    rows = conversations()
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == expected(rows)


def test_windows_fit_and_repeat_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, n, "user" if n % 2 else "assistant", "word " * 100) for n in range(1, 30)]
    made = chat.windows(spark.createDataFrame(rows, SCHEMA)).orderBy("window").collect()
    assert len(made) > 3
    for r in made:
        turns = r["formatted"].split(chat.CLOSE)[:-1]
        assert turns[0] == chat.OPEN + "system\nbe kind"
        assert sum(len(t.split()) - 3 + chat.MARKS for t in turns) <= chat.BUDGET
        assert (r["n_repeated"] > 1) == (r["window"] > 1)
        for a, b in r["loss"]:
            assert r["formatted"][a:b] == "word " * 100
    assert sum(len(r["loss"]) for r in made) == sum(r[2] == "assistant" for r in rows)
    assert [r["n_repeated"] for r in made][1:] == [3] * (len(made) - 1)


def test_a_turn_beyond_the_budget_stands_alone(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b " * 3000), (1, 2, "user", "c")]
    made = chat.windows(spark.createDataFrame(rows, SCHEMA)).orderBy("window").collect()
    assert [len(r["formatted"].split(chat.CLOSE)) - 1 - r["n_repeated"] for r in made] == [1, 1, 1]


def test_empty_and_extra_columns(spark):
    assert chat.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = conversations(8)
    plain = spark.createDataFrame(rows, SCHEMA)
    clashing = plain.withColumns({c: F.lit("x") for c in ("conv", "place", "span", "key", "tokens", "body", "window")})
    assert sorted(chat.report(clashing).collect(), key=repr) == sorted(chat.report(plain).collect(), key=repr)


def test_no_python_in_the_plan(spark):
    plan = plan_of(chat.report(spark.createDataFrame(conversations(), SCHEMA)))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
