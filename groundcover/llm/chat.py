"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is text with turns in order; some turns begin with a speaker marker ("User:", "[assistant]",
"### Human:"), some with none. Each line is observed as its marker, whether a blank line precedes it, its length,
its ending and its beginning. The hidden state of a line is a role and whether the line begins a turn. Start,
transition and observation probabilities are counted on transcripts with known roles; Viterbi finds the likeliest states,
and the turns are rendered alike: `<|role|>`, the text without marker, `<|end|>`.

`transcripts` makes raw transcripts from (conv_id, turn, role, text) rows, in blocks of BLOCK_TURNS turns by their
place in the conversation, so a conversation of any size is never in one task, whatever its turn numbers.

Defined cases: NULL texts are empty turns; NULL roles and roles outside ROLES get no marker and don't train; turns come by
number, NULL last, ties by role and text; repeated rows are one turn; rows without a conv_id are transcripts of
their own; an empty transcript has no turns; without labelled turns all probabilities are even, apart from the markers.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from groundcover.llm.common import bounded_batches
from groundcover.plans.prefix import positions

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
BLOCK_TURNS = 512
SMOOTHING = 0.5
TRAIN_BLOCKS = 20_000

# Words that name a speaker, and the forms a marker can take.
SPEAKERS = {
    "system": "system", "instruction": "system", "instructions": "system",
    "user": "user", "human": "user", "prompter": "user", "question": "user", "customer": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant", "answer": "assistant",
}
STYLES = (("User: ", "Assistant: ", "System: "), ("### Human: ", "### Assistant: ", "### System: "), ("[user] ", "[assistant] ", "[system] "), ("<|user|> ", "<|assistant|> ", "<|system|> "))
_NAME = "|".join(sorted(SPEAKERS, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:#+\s*({_NAME})\s*:?|\[({_NAME})\]\s*:?|<\|({_NAME})\|>|\**({_NAME})\**\s*:)[ \t]*", re.IGNORECASE)

FEATURES = ("marker", "gap", "length", "ending", "beginning")


def marker(line: str) -> tuple[str, int]:
    """Role named at the start of a line ('' if none) and the length of the marker."""
    found = MARKER.match(line)
    if not found:
        return "", 0
    return SPEAKERS[next(g for g in found.groups() if g).lower()], found.end()


def observe(line: str, gap: bool) -> tuple[str, ...]:
    """The line's value of each feature."""
    role, size = marker(line)
    text = line[size:].strip()
    length = "blank" if not text else str(min(6, len(text).bit_length()) if len(text) < 64 else min(11, len(text).bit_length()))
    ending = "?" if text.endswith("?") else "." if text.endswith((".", "!")) else "other"
    beginning = "list" if re.match(r"([-*•]|\d+[.)]|```)", text) else "upper" if text[:1].isupper() else "other"
    return role, "gap" if gap else "next", length, ending, beginning


def observed(text: str) -> list[tuple[int, tuple[str, ...]]]:
    """(line number, features) of every line that isn't blank."""
    out, gap = [], True
    for number, line in enumerate(text.split("\n")):
        if line.strip():
            out.append((number, observe(line, gap)))
            gap = False
        else:
            gap = True
    return out


class Hmm:
    """Log probabilities from counts of ("start", state), ("step", state, state) and (feature, state, value)."""

    def __init__(self, counts: dict[tuple, int]):
        n = len(STATES)
        self.start = np.log([counts.get(("start", s), 0) + SMOOTHING for s in range(n)])
        self.step = np.log(np.array([[counts.get(("step", a, b), 0) + SMOOTHING for b in range(n)] for a in range(n)]))
        self.start -= np.log(np.exp(self.start).sum())
        self.step -= np.log(np.exp(self.step).sum(axis=1, keepdims=True))
        self.values: list[dict[str, np.ndarray]] = []
        self.rare: list[np.ndarray] = []
        for feature in FEATURES:
            seen = sorted({k[2] for k in counts if k[0] == feature} | ({"", *ROLES} if feature == "marker" else set()))
            table = np.array([[counts.get((feature, s, v), 0) + SMOOTHING for s in range(n)] for v in seen + [None]])
            table = np.log(table / table.sum(axis=0))
            if feature == "marker":  # a marker names the role of a turn that begins here
                for i, value in enumerate(seen):
                    if value:
                        table[i] = [0.0 if STATES[s] == (value, True) else -30.0 for s in range(n)]
            self.values.append(dict(zip(seen, table)))
            self.rare.append(table[-1])

    def viterbi(self, features: list[tuple[str, ...]]) -> list[int]:
        """Likeliest states; of equal paths the one with the first states in STATES' order."""
        if not features:
            return []
        scores, back = None, np.zeros((len(features), len(STATES)), np.int8)
        for i, line in enumerate(features):
            emitted = sum(known.get(v, rare) for known, rare, v in zip(self.values, self.rare, line))
            if scores is None:
                first = [0.0 if begins else -1000.0 for _, begins in STATES]  # a transcript begins with a turn
                scores = self.start + first + emitted
            else:
                paths = scores[:, None] + self.step
                back[i] = paths.argmax(axis=0)
                scores = paths.max(axis=0) + emitted
        state = int(scores.argmax())
        states = [state]
        for i in range(len(features) - 1, 0, -1):
            state = int(back[i, state])
            states.append(state)
        return states[::-1]

    def turns(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of the turns in order; a change of role or a line that begins a turn starts one."""
        lines = text.split("\n")
        found = observed(text)
        states = self.viterbi([f for _, f in found])
        starts = [
            i for i, s in enumerate(states) if i == 0 or STATES[s][1] or STATES[s][0] != STATES[states[i - 1]][0]
        ]
        out = []
        for i, stop in zip(starts, [*starts[1:], None]):
            first = found[i][0]
            last = found[stop][0] if stop is not None else len(lines)
            body = [lines[first][marker(lines[first])[1] :], *lines[first + 1 : last]]
            out.append((STATES[states[i]][0], "\n".join(body).strip()))
        return out


def rendered(turns: Column) -> Column:
    """Canonical text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, roles, sizes, text): raw transcripts with the truth beside them.

    A conversation keeps one style of markers; a quarter of its turns (by a hash) have none.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = rows.withColumns({"alone": alone, "last": F.col("turn").isNull()}).distinct()
    rows = positions(rows, ["last", "turn", "role", "text"], ["conv_id", "alone"], "place")
    rows = rows.withColumn("block", F.floor((F.col("place") - 1) / BLOCK_TURNS).cast("long"))
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(len(STYLES)))
    hidden = F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn", F.lit("marker"))), F.lit(4)) == 0
    name = F.lit("")
    for number, (user, assistant, system) in enumerate(STYLES):
        for role, text in (("user", user), ("assistant", assistant), ("system", system)):
            name = F.when((style == number) & (F.col("role") == role), text).otherwise(name)
    raw = F.concat(F.when(hidden, "").otherwise(name), F.col("text"))
    turn = F.struct("place", "role", raw.alias("raw"))
    grouped = rows.groupBy("conv_id", "alone", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv_id", "block",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: F.size(F.split(t["raw"], "\n"))).alias("sizes"),
        F.array_join(F.transform("turns", lambda t: t["raw"]), "\n\n").alias("text"),
    )


def _true_states(roles: list[str | None], sizes: list[int], lines: list[int]) -> list[int | None]:
    """The state of each line that isn't blank, None where the role is unknown."""
    number = {state: i for i, state in enumerate(STATES)}
    owner = []
    for turn, size in enumerate(sizes):
        owner.extend([turn] * size + [None])
    out, before = [], None
    for line in lines:
        turn = owner[line]
        out.append(number.get((roles[turn], turn != before)))
        before = turn
    return out


def train(blocks: DataFrame, n: int = TRAIN_BLOCKS) -> Hmm:
    """Counts over about `n` transcripts with known roles, picked by a hash; the counts are summed in Spark."""
    bounded_batches(blocks.sparkSession)
    share = min(1.0, n / max(1, blocks.count()))
    picked = blocks.where(F.pmod(F.xxhash64("conv_id", "block"), F.lit(1 << 20)) <= int(share * (1 << 20)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for roles, sizes, text in zip(batch["roles"], batch["sizes"], batch["text"]):
                found = observed(text)
                states = _true_states(roles, sizes, [number for number, _ in found])
                before = None
                for (_, features), state in zip(found, states):
                    if state is not None:
                        keys = [(f, state, -1, v) for f, v in zip(FEATURES, features)]
                        keys.append(("start", state, -1, "") if before is None else ("step", before, state, ""))
                        for key in keys:
                            counts[key] = counts.get(key, 0) + 1
                    before = state
            yield pd.DataFrame([(*k, c) for k, c in counts.items()], columns=["kind", "a", "b", "value", "n"])

    sums = picked.select("roles", "sizes", "text").mapInPandas(count, "kind string, a int, b int, value string, n long")
    rows = sums.groupBy("kind", "a", "b", "value").agg(F.sum("n").alias("n")).collect()  # some hundred rows
    counts = {}
    for r in rows:
        key = ("start", r["a"]) if r["kind"] == "start" else ("step", r["a"], r["b"]) if r["kind"] == "step" else (r["kind"], r["a"], r["value"])
        counts[key] = r["n"]
    return Hmm(counts)


def parse(text: Column, spark, model: Hmm) -> Column:
    """array of (role, text): the turns of a transcript column."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("array<struct<role:string,text:string>>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"role": r, "text": t} for r, t in shared.value.turns(text)] for text in texts])

    return parsed(F.coalesce(text, F.lit("")))


def format_chats(blocks: DataFrame, model: Hmm) -> DataFrame:
    """(conv_id, block, turns, rendered) of transcripts (conv_id, block, text)."""
    bounded_batches(blocks.sparkSession)
    parsed = blocks.select("conv_id", "block", parse(F.col("text"), blocks.sparkSession, model).alias("turns"))
    return parsed.withColumn("rendered", rendered(F.col("turns")))
