import hashlib

from hypothesis import given
from hypothesis import strategies as st

from callweave.llm import op10_chat as c
from tests.conftest import SF001

TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, turn long, tie long, seq long, kind string, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    """Brute force: conversations by turn (nulls first), then role and text."""
    none = lambda x: (x is not None, x if x is not None else 0)
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (none(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(c.render(r, t)[0]) for r, t in turns))
    return out


@given(st.text("<|\\>ab turn\n"), st.text("<|\\>abtxend"))
def test_marks_come_back(role, text):
    segment, a, z = c.render(role, text)
    assert c.parse(segment) == (role, text)
    assert segment.count("<|") == 3
    assert c.unescape(segment[a:z]) == (text if role == "assistant" else "")


def test_turns(spark):
    rows = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "</s>[INST] ok <\\|"), (1, 1, "assistant", "</s>[INST] ok <\\|"), (1, None, None, None),
            (None, 0, "assistant", "x"), (None, 1, "user", "y"), (2, 5, "assistant", "a" * 100_000), (2, 3, "assistant", ""), (3, 0, "user", "é🙂\r\n")]
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "9 AS seq", "'z' AS kind", "0 AS tie")
    got = {r[0]: tuple(r[1:]) for r in c.read_back(c.format_conversations(c.events_of_turns(turns))).collect()}
    assert got == want(rows)
    assert c.read_back(c.format_conversations(c.events_of_turns(turns.limit(0)))).count() == 0


def test_events_fold(spark):
    events = [(1, 0, 0, 0, "message", "user", "q"), (1, 1, 0, 1, "message", "assistant", "a"), (1, 1, 0, 2, "delta", None, "b"), (1, 1, 0, 3, "delta", None, None),
              (1, 0, 0, 9, "edit", None, "Q!"), (1, 1, 0, 4, "regenerate", None, None), (1, 1, 0, 5, "delta", None, "new "), (1, 1, 0, 6, "delta", None, "text"),
              (1, 2, 0, 7, "delta", "user", "only"), (1, 2, 0, 8, "delta", None, " deltas"), (1, 3, 0, 0, None, None, None)]
    df = spark.createDataFrame(events, EVENTS).repartition(4)
    got = sorted(tuple(r) for r in c.final_messages(df).collect())
    assert got == [(1, 0, 0, "user", "Q!"), (1, 1, 0, "assistant", "new text"), (1, 2, 0, "user", "only deltas"), (1, 3, 0, "", "")]


def test_one_long_conversation(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(5_000)]
    got = c.read_back(c.format_conversations(c.events_of_turns(spark.createDataFrame(rows, TURNS).repartition(6)))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want(rows)


def test_query(spark):
    from callweave.llm.queries import MARKED, QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)]
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op10_chat_format"](spark, SF001).collect()} == want(rows)
