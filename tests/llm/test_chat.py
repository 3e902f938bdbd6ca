import hashlib
import random

from attesta.llm import chat
from attesta.llm.queries import op3_chat_format


def test_escape_is_reversible():
    r = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "<SYS>>", "x", "\n", "é"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS), t
        for role in ("user", "assistant", "system", "tool", "", "a\nb\\n</s>"):
            whole = chat.instruct_template([(role, t)])
            assert chat.read_turn(whole) == (role, t)


def brute(rows):
    convs = {}
    for k, turn, role, text in rows:
        convs.setdefault(k, []).append((turn, role or "", text or ""))
    out = {}
    for k, own in convs.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        out[k] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(chat.instruct_template([(r, t) for _, r, t in own])))
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_edges_and_long_conversation(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, 1, "tool", "</s>"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (3, None, "system", chat.SENTINEL), (4, 0, "user", "y" * 50_000)]
    rows += [(9, i, ("user", "assistant")[i % 2], f"turn {i} [INST]") for i in range(500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(5)
    want = brute([(k, -1 if t is None else t, r, x) for k, t, r, x in rows])
    assert got(chat.digests(chat.format_chats(df))) == want
    turns = chat.format_chats(df).collect()
    assert not any(r.rewrites for r in turns)
    long = sorted((r for r in turns if r.conv_id == 9), key=lambda r: r.seq)
    whole = chat.instruct_template([(r, x) for k, _, r, x in rows if k == 9])
    assert "".join(r.piece for r in long) == whole
    assert all(whole[r.start + r.text_start : r.start + r.text_end] == chat.escape(f"turn {r.seq} [INST]") for r in long)
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def strips_history(messages):
    last = len(messages) - 1
    return "".join(f"({r}:{t if i == last else t[:3]})" for i, (r, t) in enumerate(messages))


def test_templates_that_rewrite_history(spark):
    rows = [(1, 0, "user", "abc"), (1, 1, "assistant", "abcdef"), (1, 2, "user", "xyz"), (2, 0, "user", "only")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), strips_history).collect()
    assert {r.rewrites for r in out if r.conv_id == 1} == {True} and {r.rewrites for r in out if r.conv_id == 2} == {False}
    assert [r.piece for r in sorted(out) if r.conv_id == 1][-1] == strips_history([(r, t) for k, _, r, t in rows if k == 1])


def test_template_that_counts_all_turns_is_seen_at_the_boundary(spark):
    def counts(messages):
        return "".join(f"{i % 10 if i > 2 else 0}:{t};" for i, (_, t) in enumerate(messages))

    rows = [(1, i, "user", f"t{i}") for i in range(200)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), counts).collect()
    assert {r.rewrites for r in out if r.seq >= chat.SEGMENT} == {True}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same = "</s>[INST] ok [/INST]"
    assert got(op3_chat_format(spark, d)) == brute([*rows, (-1, 0, "user", same), (-1, 1, "assistant", same)])


def test_text_that_contains_the_sentinel_is_located(spark):
    texts = [chat.SENTINEL, f"a{chat.SENTINEL}b", chat.SENTINEL + chat.LENGTHEN * 3, chat.LENGTHEN + chat.SENTINEL * 2, f"{chat.SENTINEL}{chat.LENGTHEN}</s>"]
    rows = [(k, turn, role, t) for k, t in enumerate(texts) for turn, role in enumerate(("user", "assistant", chat.SENTINEL, "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_chats(df).collect()
    assert all(r.loss == (r.role == "assistant") and r.piece[r.text_start : r.text_end] == chat.escape(texts[r.conv_id]) for r in turns)
    assert got(chat.digests(chat.format_chats(df))) == brute(rows)


def test_template_that_trims_beyond_the_window_is_seen(spark):
    def trims(messages):
        return "".join(f"{r}:{t};" for r, t in messages[-100:])

    def plain(messages):
        return "".join(f"{r}:{t};" for r, t in messages)

    rows = [(k, i, "user", f"t{i}") for k, n in ((1, 90), (2, 101), (3, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat.format_chats(df, trims).collect())
    assert {(r.conv_id, r.rewrites) for r in out} == {(1, False), (2, True), (3, True)}
    for k in (1, 2, 3):
        assert "".join(r.piece or "" for r in out if r.conv_id == k) == trims([(r, t) for c, _, r, t in rows if c == k])
    assert not any(r.rewrites for r in chat.format_chats(df, plain).collect())
