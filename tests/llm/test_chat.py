import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import chat

nasty = st.text(alphabet="a<>[]/\\ns INSTYé\n", max_size=20) | st.sampled_from(["</s>[INST] ok [/INST]", "<<SYS>>", "<\\s>", "[\\INST]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | nasty, nasty), max_size=6))
def test_template_is_reversible(turns):
    made = [chat.format_turn(r, t) for r, t in turns]
    assert chat.parse_turns("".join(m[0] for m in made)) == turns
    for (s, a, b), (_, t) in zip(made, turns):
        assert chat.unescape(s[a:b]) == t
        assert not any(m in s[a:b] for m in ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1500), min_size=1, max_size=30), st.integers(0, 300))
def test_windows_cover_each_turn_once_within_budget(tokens, system):
    at = 0
    for back, first, end in chat.plan_windows(tokens, system):
        assert back <= first == at < end and first - back <= chat.HISTORY_TURNS
        assert sum(tokens[back:first]) <= chat.HISTORY_TOKENS
        assert system + sum(tokens[back:end]) <= chat.BUDGET or (end == first + 1 and back == first)
        at = end
    assert at == len(tokens)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        out[c] = (
            len(ts),
            hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in ts).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def compare(got, rows):
    got = {r.conv_id: r for r in got.collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == w
        assert r.formatted_chars > 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    compare(chat.op4_chat(spark, sf), rows + [(-7, 0, "user", probe), (-7, 1, "assistant", probe)])


def test_edge_cases(spark):
    rnd = random.Random(0)
    rows = [(1, i, ["user", "assistant"][i % 2], "word " * rnd.randint(1, 60)) for i in range(1200)]
    rows[0] = (1, 0, "system", "be kind")
    rows += [(2, 0, "system", "only"), (3, None, None, None), (3, None, "user", "x"), (3, -5, "assistant", "<s>"), (None, 1, "user", "q"), (4, 0, "assistant", "huge " * 30_000)]
    rows += [(5, 7, "user", "same"), (5, 7, "user", "same"), (6, 255, "user", "edge"), (6, 100_000, "assistant", "far")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS kind").repartition(5)
    out = chat.format_conversations(df)
    compare(chat.read_back(out), rows)
    windows = [r for r in out.where("conv_id = 1").orderBy("block", "window").collect()]
    assert len(windows) > 20 and all(r.n_tokens <= chat.BUDGET for r in windows)
    assert all(chat.parse_turns(r.text)[0] == ("system", "be kind") for r in windows)
    assert all(r.n_context >= 2 for r in windows[1:])
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
