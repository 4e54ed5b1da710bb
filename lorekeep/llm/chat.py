"""Chat transcripts to canonical turns: roles by Viterbi over a hidden Markov model of lines.

States are the roles. A line shows a speaker marker or none, what speaker its row names, and features of
its text. A line that begins a row or has a marker may change the speaker; others rarely do.

The best path through a piece of a conversation, for each pair of states before and at its end, is a small
matrix, and matrices of consecutive pieces combine. So conversations are range-partitioned by turn and may
span partitions: each partition reports the matrices of its first and last conversation, the states on the
borders follow from these, and every partition decodes its lines by itself. No conversation, however
long, has to fit in one task.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import checkpointed, shared_dir
from lorekeep.session import workers_import

ROLES = ("system", "user", "assistant")

# fixed values: names of speakers
SPEAKERS = {
    "system": 0, "sys": 0, "developer": 0, "instructions": 0,
    "user": 1, "human": 1, "customer": 1, "client": 1, "question": 1, "q": 1, "prompter": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "chatbot": 2, "model": 2, "agent": 2, "answer": 2, "a": 2,
}

# fixed values: the model's probabilities, by role
START = np.log([0.30, 0.60, 0.10])
#: From a role (row) to a role, where a row or a marked line begins.
TURN = np.log([[0.05, 0.90, 0.05], [0.02, 0.08, 0.90], [0.02, 0.90, 0.08]])
#: From line to line within a row.
STAY = np.log([[0.97, 0.015, 0.015], [0.015, 0.97, 0.015], [0.015, 0.015, 0.97]])
#: Of a marker of the own role, of another, of none.
OWN_MARK, OTHER_MARK, NO_MARK = np.log(0.60), np.log(0.015), np.log(0.37)
#: Of a row that names the own role, another.
NAMED_OWN, NAMED_OTHER = np.log(0.97), np.log(0.015)
#: Of each line feature: a long line, a question, list or code marks, an opening such as "you are".
LONG_CHARS = 300
FEATURES = np.array([[0.25, 0.08, 0.40], [0.05, 0.40, 0.10], [0.06, 0.04, 0.25], [0.40, 0.02, 0.02]])
#: Of a row without inner markers: that it is long as a whole. Answers mostly are.
LONG_ROW_CHARS = 450
LONG_ROW = np.array([0.10, 0.05, 0.70])

#: Scores are whole numbers, so sums don't depend on how a conversation is cut; each line's are nudged by
#: a hash, less than a thousandth, so that equally good paths have one winner.
SCALE, NUDGE = 1 << 34, (1 << 24) - 1


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int64)


START, TURN, STAY = whole(START), whole(TURN), whole(STAY)

_NAME = "|".join(sorted(SPEAKERS, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:[#>]+\s*)?(?:<\|({_NAME})\|>|\[({_NAME})\]|<({_NAME})>|\*{{0,2}}({_NAME})\*{{0,2}}\s*[:>]\*{{0,2}})\s*", re.IGNORECASE)
LIST_OR_CODE = re.compile(r"\s*(?:[-*+] |\d+[.)] |```|    )")
OPENING = re.compile(r"\s*(?:you are|you must|your task|always|never|act as)\b", re.IGNORECASE)


def marker(line: str) -> tuple[int, int]:
    """(role of the speaker marker, where the line goes on after it); (-1, 0) without one."""
    m = MARKER.match(line)
    return (SPEAKERS[next(g for g in m.groups() if g).lower()], m.end()) if m else (-1, 0)


def emission(line: str, mark: int, named: int) -> np.ndarray:
    """Log probability, by role, of what a line shows."""
    on = np.array([len(line) >= LONG_CHARS, "?" in line, bool(LIST_OR_CODE.match(line)), bool(OPENING.match(line))])
    out = np.where(on[:, None], np.log(FEATURES), np.log1p(-FEATURES)).sum(0)
    out += NO_MARK if mark < 0 else np.where(np.arange(3) == mark, OWN_MARK, OTHER_MARK)
    if named >= 0:
        out += np.where(np.arange(3) == named, NAMED_OWN, NAMED_OTHER)
    return out


def observed(turn, named: str | None, text: str | None) -> list[tuple[np.ndarray, bool, int, int]]:
    """(score by role, opens a turn, marker's role, where the text begins) of each line of a row."""
    role, out = SPEAKERS.get((named or "").strip().lower(), -1), []
    lines = (text or "").split("\n")
    marks = [marker(line) for line in lines]
    for k, (line, (mark, at)) in enumerate(zip(lines, marks, strict=True)):
        score = emission(line[at:], mark, role)
        if k == 0 and all(m < 0 for m, _ in marks[1:]):
            score = score + np.log(LONG_ROW if len(text or "") >= LONG_ROW_CHARS else 1 - LONG_ROW)
        nudge = [zlib.crc32(f"{turn} {k} {r} {line[:200]}".encode()) & NUDGE for r in ROLES]
        out.append((whole(score) + np.array(nudge), k == 0 or mark >= 0, mark, at))
    return out


def step(opens: bool) -> np.ndarray:
    return TURN if opens else STAY


def transfer(lines: list) -> np.ndarray:
    """Best log probability of the lines for each state before them (row) and at the last of them."""
    m = step(lines[0][1]) + lines[0][0]
    for e, opens, *_ in lines[1:]:
        m = (m[:, :, None] + step(opens)[None]).max(1) + e
        m -= m.max()  # only differences count
    return m


def opening(lines: list) -> np.ndarray:
    """As transfer(), where the conversation begins with the lines."""
    score = START + lines[0][0]
    for e, opens, *_ in lines[1:]:
        score = (score[:, None] + step(opens)).max(0) + e
        score -= score.max()
    return score


def decode(lines: list, before: int | None, last: int | None) -> list[int]:
    """The best states, given the one before (None: the conversation starts here) and the last (None: it ends here)."""
    score = (START if before is None else step(lines[0][1])[before]) + lines[0][0]
    back = []
    for e, opens, *_ in lines[1:]:
        reach = score[:, None] + step(opens)
        back.append(reach.argmax(0))
        score = reach.max(0) + e
        score -= score.max()
    state = int(score.argmax()) if last is None else last
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    return path[::-1]


def border_states(pieces: list[tuple[int, bool, bool, np.ndarray, np.ndarray]]) -> dict[tuple[int, str], tuple[int | None, int | None]]:
    """(before, last) for each piece of a conversation that spans partitions; pieces in order.

    A piece: (partition, it goes on from the piece before, the next goes on from it, its transfer matrix,
    the start scores of its first line).
    """
    out, chain = {}, []

    def close():
        scores = []  # best score for each state at the end of each piece
        for k, (_, _, _, m, first) in enumerate(chain):
            scores.append(first if k == 0 else (scores[-1][:, None] + m).max(0))
            scores[-1] = scores[-1] - scores[-1].max()
        last = int(scores[-1].argmax())
        for k in range(len(chain) - 1, -1, -1):
            p, _, _, m, _ = chain[k]
            before = int((scores[k - 1] + m[:, last]).argmax()) if k else None
            out[p, "whole"] = (before, last)
            last = before

    for piece in pieces:
        if chain and not piece[1]:
            close()
            chain = []
        chain.append(piece)
    if chain:
        close()
    return out


def _conversations(batches):
    """(conversation, rows) in order; a row is (turn, named role, text)."""
    now, rows, started = None, [], False
    for b in batches:
        for conv, turn, named, text in zip(*[c.to_pylist() for c in b.columns[:4]], strict=True):
            if not started or conv != now:
                if rows:
                    yield now, rows
                now, rows, started = conv, [], True
            rows.append((turn, named, text))
    if rows:
        yield now, rows


def rendered(role: str, text: str) -> str:
    """A turn in canonical form."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def canonical_turns(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str | None = "role", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row a recovered turn: conv_id, turn, part, role, named_role, n_lines, n_chars, rendered.

    A conversation's rows are read by turn (nulls first; equal turns by a hash of role and text). A row is
    one turn, or more (part 0, 1, ...) where marked lines or the model change the speaker inside it.
    Markers are taken off. role_col names the speaker as far as the row knows it; unknown names and nulls
    leave it to the model; None: there is no such column. A null text is an empty turn. Rows without a
    conversation form one; rows that repeat are turns each; an empty table gives no rows; other columns
    are not read.
    """
    spark = chats.sparkSession
    workers_import(spark)
    shared_dir(spark)
    kinds = dict(chats.dtypes)
    named = F.col(f"`{role_col}`").cast("string") if role_col else F.lit(None).cast("string")
    rows = chats.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), named.alias("named"), F.col(f"`{text_col}`").alias("text"))
    order = ["conv", "turn", "tie"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # both passes read these very partitions
    rows = checkpointed(rows.withColumn("tie", F.xxhash64("named", "text")).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie"))

    def borders(batches):
        """The first and last conversation of the partition, with their matrices."""
        first = last = None
        for conv, turns in _conversations(batches):
            lines = [x for turn, name, text in turns for x in observed(turn, name, text)]
            if first is None:
                first = (conv, lines)
                last = None
            else:
                last = (conv, lines)
        for kind, part in (("first", first), ("last", last)):
            if part:
                m, begin = transfer(part[1]), opening(part[1])
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([kind]), pa.array([None if part[0] is None else str(part[0])], pa.string()), pa.array([m.ravel().tolist()], pa.list_(pa.int64())), pa.array([begin.tolist()], pa.list_(pa.int64()))], names=["partition", "kind", "conv", "matrix", "begin"])

    found = sorted(rows.mapInArrow(borders, "partition int, kind string, conv string, matrix array<long>, begin array<long>").collect(), key=lambda r: (r["partition"], r["kind"] == "last"))
    fixed: dict[tuple[int, str], tuple[int | None, int | None]] = {}
    chain: list = []

    def close():
        if len(chain) > 1:
            pieces = [(k, k > 0, k + 1 < len(chain), np.array(r["matrix"]).reshape(3, 3), np.array(r["begin"])) for k, r in enumerate(chain)]
            for (k, _), states in border_states(pieces).items():
                fixed[chain[k]["partition"], chain[k]["kind"]] = states

    for r in found:
        if chain and (r["partition"] == chain[-1]["partition"] or r["conv"] != chain[-1]["conv"]):
            close()
            chain = []
        chain.append(r)
    close()

    def decoded(batches):
        partition = TaskContext.get().partitionId()
        out: list = []
        held = None

        def emit(conv, turns, kind):
            before, last = fixed.get((partition, kind), (None, None)) if kind else (None, None)
            lines = [observed(*row) for row in turns]
            states = iter(decode([x for row in lines for x in row], before, last))
            for (turn, name, text), row in zip(turns, lines, strict=True):
                parts: list[tuple[int, list[str]]] = []
                for line, (_, _, mark, at) in zip((text or "").split("\n"), row, strict=True):
                    s = next(states)
                    if not parts or s != parts[-1][0] or mark >= 0:
                        parts.append((s, []))
                    parts[-1][1].append(line[at:])
                for k, (s, body) in enumerate(parts):
                    joined = "\n".join(body)
                    out.append((conv, turn, k, ROLES[s], name, len(body), len(joined.strip()), rendered(ROLES[s], joined)))

        def flush():
            cols = [*zip(*out, strict=True)]
            types = [schema.field(i).type for i in range(2)] + [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "turn", "part", "role", "named_role", "n_lines", "n_chars", "rendered"])
            out.clear()
            return batch

        schema = None

        def kept(batches):
            nonlocal schema
            for b in batches:
                schema = schema or b.schema
                yield b

        n = 0
        for conv, turns in _conversations(kept(batches)):
            if held:
                emit(*held, "first" if n == 1 else None)
            held = (conv, turns)
            n += 1
            if len(out) > 5000:
                yield flush()
        if held:
            emit(*held, "first" if n == 1 else "last")
        if out:
            yield flush()

    return rows.mapInArrow(decoded, f"conv_id {kinds[conv_col]}, turn {kinds[turn_col]}, part int, role string, named_role string, n_lines long, n_chars long, rendered string")
