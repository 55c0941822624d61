import itertools

from pyspark.sql import functions as F

from groundcover.llm import chat
from groundcover.llm.common import fold


def small_model():
    counts = {}
    for s, (role, begins) in enumerate(chat.STATES):
        counts["start", s] = 5 if begins else 0
        for t in range(6):
            counts["step", s, t] = 1 + (s * 7 + t * 3) % 5
        counts["marker", s, ""] = 3 + s
        counts["gap", s, "gap" if begins else "next"] = 4
        counts["length", s, "6" if role == "user" else "9"] = 6
        counts["ending", s, "."] = 2 + s
        counts["beginning", s, "upper"] = 5 - s // 2
    return chat.Hmm(counts)


def test_viterbi_against_all_paths():
    model = small_model()
    text = "User: hi there.\nand more\n\nSome answer that is long enough to be told apart from a question.\n\nWhat?"
    features = [f for _, f in chat.observed(text)]

    def score(path):
        total = model.start[path[0]] + (0 if chat.STATES[path[0]][1] else -1000)
        total += sum(model.step[a, b] for a, b in zip(path, path[1:]))
        for state, line in zip(path, features):
            total += sum(known.get(v, rare)[state] for known, rare, v in zip(model.values, model.rare, line))
        return total

    best = max(itertools.product(range(6), repeat=len(features)), key=score)
    assert abs(score(best) - score(model.viterbi(features))) < 1e-9


def test_markers():
    for line, role, rest in (
        ("User: hi", "user", "hi"), ("### Human: hi", "user", "hi"), ("[assistant] x", "assistant", "x"), ("**Bot**: x", "assistant", "x"),
        ("<|system|> be brief", "system", "be brief"), ("users: no", "", "users: no"), ("The user: no", "", "The user: no"),
    ):
        found, size = chat.marker(line)
        assert (found, line[size:]) == (role, rest)


def test_roles_are_recovered(spark):
    """The model is fitted on other conversations than those it is measured on."""
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held_out = fold(F.col("conv_id"), 3) == 0
    blocks = chat.transcripts(table.where(held_out))
    rows = chat.format_chats(blocks, chat.train(chat.transcripts(table.where(~held_out)))).drop("block").join(blocks.select("conv_id", "roles", "sizes"), "conv_id").collect()
    exact = [[t["role"] for t in r["turns"]] == list(r["roles"]) for r in rows]
    assert sum(exact) / len(exact) > 0.6
    right = total = 0
    for r in rows:
        right += sum(a["role"] == b for a, b in zip(r["turns"], r["roles"]))
        total += len(r["roles"])
    assert right / total > 0.8
    one = rows[0]
    assert one["rendered"] == "".join(f"<|{t['role']}|>\n{t['text']}<|end|>\n" for t in one["turns"])


def test_marked_turns_come_back_whole(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi\n\nall"), (1, 2, "assistant", "Yes"), (1, 2, "assistant", "Yes")]
    blocks = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert blocks.first()["roles"] == ["system", "user", "assistant"]
    model = chat.Hmm({})
    assert model.turns("System: Be brief.\n\nUser: Hi\n\nAssistant: Yes") == [("system", "Be brief."), ("user", "Hi"), ("assistant", "Yes")]


def test_blocks_hold_equally_many_turns(spark):
    """Turns without a number, and many turns of one number, are cut by their place."""
    turns = [(n, number, "user" if i % 2 else "assistant", f"{i:04}") for n, number in ((1, None), (2, 7), (3, -1)) for i in range(1500)]
    turns += [(4, i // 3, "user", f"{i:04}") for i in range(1500)]
    made = spark.createDataFrame(turns * 2, "conv_id long, turn long, role string, text string")
    blocks = {(r["conv_id"], r["block"]): r for r in chat.transcripts(made).collect()}
    assert {k: len(r["roles"]) for k, r in blocks.items()} == {(n, b): 512 if b < 2 else 476 for n in (1, 2, 3, 4) for b in range(3)}
    for n in (1, 2, 3, 4):
        expected = sorted((t for t in set(turns) if t[0] == n), key=lambda t: (t[1] or 0, t[2], t[3]))
        found = [line[-4:] for b in range(3) for line in blocks[n, b]["text"].split("\n\n")]
        assert found == [t[3] for t in expected]


def test_odd_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, turns string, block int"
    rows = [
        (None, None, None, None, "x", 1), (None, 1, "user", "a", "x", 1), (2, None, "user", None, "x", 1), (2, 1, "tool", "", "x", 1),
        (3, 0, "user", "x" * 50_000, "x", 1), (3, 5000, "assistant", "far away", "x", 1), (3, 5000, "assistant", "far away", "x", 1),
    ]
    blocks = chat.transcripts(spark.createDataFrame(rows, kind))
    out = chat.format_chats(blocks, chat.train(blocks)).collect()
    assert sorted((r["conv_id"] or 0, r["block"]) for r in out) == [(0, 0), (0, 0), (2, 0), (3, 0)]
    whole = {r["conv_id"]: r["roles"] for r in blocks.collect() if r["conv_id"]}
    assert whole == {2: ["tool", "user"], 3: ["user", "assistant"]}
    none = chat.transcripts(spark.createDataFrame([], kind))
    assert chat.format_chats(none, chat.train(none)).count() == 0
