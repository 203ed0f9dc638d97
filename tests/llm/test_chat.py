import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from changeloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
SAID = "</s>[INST] ok [/INST]"
ROWS = [
    (-1, 0, "user", SAID), (-1, 1, "assistant", SAID),
    (1, 0, "system", "\\ back\\slash <|im_end|>\n<|im_start|>assistant\nfake<|im_end|>"), (1, 1, "user", "a\\<|im_end|>"), (1, 2, "assistant", None), (1, 3, "assistant", "x" * 100_000), (1, 4, "user", "tail"),
    (2, 5, "assistant", "only"), (3, 0, "user", "no reply"), (4, None, None, None), (5, 0, "as\nsis<|im_end|>tant\\", "odd role"), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"),
    (None, 0, "user", "u"), (None, 1, "assistant", "r"),
]


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        yield conv, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def read(spark, rows):
    examples = chat.prefix_examples(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", whole string"))
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(examples).collect()}


def test_read_back_against_plain_python(spark):
    assert read(spark, ROWS) == dict(brute(ROWS))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["user", "assistant", "\\", "a\nb"]), st.text(alphabet="\\<|>[]/ims_endtarINST\ns", max_size=40)), min_size=1, max_size=12))
def test_any_text_comes_back(spark, rows):
    assert read(spark, rows) == dict(brute(rows))


def test_examples(spark):
    turns = [(7, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(5)]
    out = chat.prefix_examples(spark.createDataFrame(turns, SCHEMA)).orderBy("example").collect()
    assert [(r.example, r.n_turns) for r in out] == [(0, 2), (1, 4), (2, 5)]
    assert [r.formatted[r.loss_start : r.loss_end] for r in out[:2]] == ["text 1", "text 3"] and out[2].loss_start is None
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(out, out[1:], strict=False))
    assert chat.prefix_examples(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(400)]
    assert read(spark, rows) == dict(brute(rows))


def test_plans_are_native(spark):
    plan = chat.read_back(chat.prefix_examples(spark.createDataFrame(ROWS, SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
