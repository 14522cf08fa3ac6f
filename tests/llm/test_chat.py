import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from driftflow.llm import chat

ROLES = st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]", "a\\b"])
TEXTS = st.text(alphabet=st.sampled_from(list("ab\\<>[]/INSTlb \n🙂é")), max_size=30)
SHAPE = "conv_id long, turn long, role string, text string"


@given(st.lists(st.tuples(ROLES, TEXTS), max_size=8))
def test_turns_are_read_back(turns):
    made = list(chat.examples_of(turns))
    assert [i for i, *_ in made if i is not None] == [i for i, (role, _) in enumerate(turns) if role == "assistant"]
    for i, text, low, high in made:
        assert chat.read_turns(text) == (turns if i is None else turns[:i + 1])
        assert chat.unescape(text[low:high]) == ("" if i is None else turns[i][1])
    assert not turns or chat.read_turns(made[-1][1]) == turns


@given(TEXTS)
def test_no_control_string_survives_in_a_text(text):
    assert not set("<[") & set(chat.escape(text))


def test_what_is_no_conversation_raises():
    with pytest.raises(ValueError):
        chat.read_turns("[INST]a[/INST] b")


def brute(rows):
    said = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in said.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(text) for _, text, _, _ in chat.examples_of(turns))
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out.append((conv, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=repr)


def told(out):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in out.collect()), key=repr)


def test_digests_against_brute_force(spark, rng):
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", None, "tool"]),
             rng.choice(["", None, "</s>[INST] ok [/INST]", "a\\", "x" * 3000])) for _ in range(60)]
    rows += [(9, i, "user" if i % 2 else "assistant", f"turn {i} <b>") for i in range(300)] + [(10, 0, "user", "alone"), (11, 0, "assistant", "hi")] * 2
    frame = spark.createDataFrame(rows, SHAPE)
    assert told(chat.digests(chat.examples(frame))) == brute(rows)
    clashing = frame.selectExpr("*", "1 AS turns", "'x' AS target_turn")
    assert told(chat.digests(chat.examples(clashing))) == brute(rows)
    assert chat.digests(chat.examples(frame.where("false"))).count() == 0


def test_every_assistant_turn_is_a_target_once(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "r")], SHAPE)
    made = [(r.target_turn, r.text, r.text[r.loss_from:r.loss_to]) for r in chat.examples(frame).collect()]
    assert made == [(1, "[INST]q[/INST]<s>a</s>", "a"), (2, "[INST]q[/INST]<s>a</s><s>b</s>", "b"),
                    (None, "[INST]q[/INST]<s>a</s><s>b</s>[INST]r[/INST]", "")]
