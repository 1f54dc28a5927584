"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last of them an
assistant's. For each turn the repair keeps its role, gives it another, merges it into the turn before, or first inserts
empty turns; dynamic programming over the automaton of legal turns finds the cheapest sequence, which is then rendered.

A conversation of any length is split: rows are range-sorted by (conv_id, turn, role, hash of text) and cut into chunks of at
most 2,048 turns and at partition bounds. The repair of a chunk is a 4 x 4 table of least costs from state to state;
for conversations in several chunks the tables are combined, which fixes the states at the chunk bounds, and every
chunk is then repaired by itself. The result has a row per turn, with the piece of rendered text it adds: the pieces
of a conversation in order of ``pos`` are its rendering.

Costs: merge 1; unknown role named 1; system made user 2; other change of role 3; each empty turn 2; a merge with a
change of role costs both. Among equals: keep, merge, change, fewer insertions, roles in the order listed.

Edge cases: null, blank and unknown roles are ``other``, to be given a role; a null text is empty; null turns come
last; turns of equal number are ordered by role and the text's hash; repeated rows are turns of their own; a null conv_id is a
conversation; extra columns are ignored; an empty table gives an empty table. Role markers within texts are defused.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written

ROLES = ("system", "user", "assistant")
#: Names for the three roles.
NAMES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, NAME_OTHER, SYSTEM_TO_USER, RELABEL, INSERT = 1, 1, 2, 3, 2
FAR = 1 << 40
CHUNK = 2048
SMALL_CUTS = 50_000


def role_of(raw: str | None) -> str:
    return NAMES.get((raw or "").strip().lower(), "other")


def _relabel(role: str, to: str) -> int:
    if role == to:
        return 0
    return NAME_OTHER if role == "other" else SYSTEM_TO_USER if (role, to) == ("system", "user") else RELABEL


@lru_cache(maxsize=None)
def _reach() -> dict[tuple[int, int], list[int]]:
    """The fewest empty turns that lead from a state to another."""
    out = {}
    for a in range(4):
        todo = [(a, [])]
        while todo:
            s, path = todo.pop(0)
            if (a, s) not in out:
                out[a, s] = path
                todo += [(t, [*path, t]) for t in NEXT[s]]
    return out


@lru_cache(maxsize=None)
def step(role: str) -> list[list[tuple]]:
    """step(role)[a][b]: (cost, order, action, roles inserted) of the best way to take a turn from state a to b."""
    out = [[(FAR, 9, "", ()) for _ in range(4)] for _ in range(4)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            ways, change = [], _relabel(role, ROLES[b - 1])
            if a == b:
                ways.append((MERGE + change, 1, "merge" if not change else "relabel_merge", ()))
            for via in range(4):
                if b in NEXT[via] and (a, via) in _reach():
                    added = _reach()[a, via]
                    ways.append((INSERT * len(added) + change, 0 if not change and not added else 2 + len(added), "keep" if not change else "relabel", tuple(ROLES[s - 1] for s in added)))
            if ways:
                out[a][b] = min(ways)
    return out


def closing(state: int) -> tuple[int, tuple[str, ...]]:
    """Cost and empty turns that end a conversation in a state. One without turns stays as it is."""
    added = [] if state == START else _reach()[state, ASSISTANT]
    return INSERT * len(added), tuple(ROLES[s - 1] for s in added)


def summary(roles: list[str]) -> list[list[int]]:
    """Least cost of a chunk from each state to each."""
    best = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for role in roles:
        way = step(role)
        best = [[min(best[a][m] + way[m][b][0] for m in range(4)) for b in range(4)] for a in range(4)]
    return best


def bounds(tables: list[list[list[int]]]) -> list[int]:
    """States at the chunk bounds of a conversation, start and end included, of least total cost."""
    ahead = [[closing(s)[0] for s in range(4)]]
    for t in reversed(tables):
        ahead.append([min(t[a][b] + ahead[-1][b] for b in range(4)) for a in range(4)])
    ahead.reverse()
    states = [START]
    for i, t in enumerate(tables):
        states.append(min(range(4), key=lambda b: (t[states[-1]][b] + ahead[i + 1][b], b)))
    return states


def repair(roles: list[str], start: int = START, end: int | None = None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(new role, action, roles inserted before) of each turn; ``end`` None: the conversation closes here."""
    ahead = [[closing(s)[0] if end is None else 0 if s == end else FAR for s in range(4)]]
    for role in reversed(roles):
        way, after = step(role), ahead[-1]
        ahead.append([min(way[a][b][0] + after[b] for b in range(4)) for a in range(4)])
    ahead.reverse()
    out, at = [], start
    for i, role in enumerate(roles):
        way = step(role)[at]
        at = min(range(4), key=lambda b: (way[b][0] + ahead[i + 1][b], way[b][1], b))
        out.append((ROLES[at - 1], way[at][2], way[at][3]))
    return out


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _message(role: str, text: str = "") -> str:
    return f"{OPEN}{role}\n{text}"


def render(turns: list[tuple[str, str, tuple[str, ...]]], texts: list[str | None], start: int, final: bool) -> list[str]:
    """The piece of text each turn adds. A message is closed by what follows it."""
    out, opened, last = [], start != START, start
    for (role, action, added), text in zip(turns, texts, strict=True):
        body = (text or "").replace("<|im_", "<| im_")
        if action in ("merge", "relabel_merge"):
            out.append("\n\n" + body)
        else:
            out.append((CLOSE if opened else "") + "".join(_message(r) + CLOSE for r in added) + _message(role, body))
        opened, last = True, 1 + ROLES.index(role)
    if final and out:
        out[-1] += CLOSE + "".join(_message(r) + CLOSE for r in closing(last)[1])
    return out


LABELLED = "conv_id bigint, part int, chunk int, pos bigint, cut boolean, turn bigint, role string, known string, text string"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]
_LABELLED = ["conv_id", "part", "chunk", "pos", "cut", "turn", "role", "known", "text"]
_NONE = object()


def _label(batches):
    """Names the chunks of a sorted partition. A chunk is cut if its conversation may go on elsewhere."""
    part, held, conv, chunk, first, long = TaskContext.get().partitionId(), [], _NONE, 0, True, False

    def out(cut):
        columns = zip(*[(c, part, chunk, i, cut, t, r, role_of(r), x) for i, (c, t, r, x) in enumerate(held)], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_LABELLED)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
            if row[0] != conv or len(held) == CHUNK:
                if held:
                    long = long or row[0] == conv
                    yield out(first or long)
                    chunk += 1
                if row[0] != conv:
                    first, long = conv is _NONE, False
                conv, held = row[0], []
            held.append(row)
    if held:
        yield out(True)


def _tables(pdf):
    import pandas as pd

    pdf = pdf.sort_values("pos")
    return pd.DataFrame({"conv_id": pdf.conv_id.iloc[:1], "part": pdf.part.iloc[:1], "chunk": pdf.chunk.iloc[:1], "costs": [[c for row in summary(list(pdf.known)) for c in row]]})


def _ends(pdf):
    import pandas as pd

    pdf = pdf.sort_values(["part", "chunk"])
    states = bounds([[list(c[i : i + 4]) for i in range(0, 16, 4)] for c in pdf.costs])
    return pd.DataFrame({"_part": pdf.part, "_chunk": pdf.chunk, "start": states[:-1], "end": states[1:], "final": [False] * (len(pdf) - 1) + [True]})


REPAIRED = "conv_id bigint, part int, chunk int, pos bigint, turn bigint, role string, new_role string, action string, inserted string, rendered string"


def _repair(batches):
    kinds, names = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.string()] * 5, [x.split()[0] for x in REPAIRED.split(", ")]
    held, at = [], None

    def out():
        start, end, final = held[0][7:]
        start = START if start is None else start
        turns = repair([r[5] for r in held], start, None if final is None or final else end)
        pieces = render(turns, [r[6] for r in held], start, final is None or final)
        rows = [(*at, r[3], r[2], r[4], t[0], t[1], ",".join(t[2]), p) for r, t, p in zip(held, turns, pieces, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        columns = ("part", "chunk", "turn", "pos", "role", "known", "text", "start", "end", "final", "conv_id")
        for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            if (now := (row[10], row[0], row[1])) != at:
                if held:
                    yield out()
                at, held = now, []
            held.append(row[:10])
    if held:
        yield out()


def format_chats(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per turn, as in REPAIRED; order within a conversation: part, chunk, pos."""
    small_batches(turns.sparkSession)
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.xxhash64("text").alias("_h"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("_h")]
    labelled = written(slim.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first()).drop("_h").mapInArrow(_label, LABELLED), "chat")
    cut = labelled.filter("cut").select("conv_id", "part", "chunk", "pos", "known")
    tables = cut.groupBy("conv_id", "part", "chunk").applyInPandas(_tables, "conv_id bigint, part int, chunk int, costs array<bigint>")
    ends = written(tables.groupBy("conv_id").applyInPandas(_ends, "_part int, _chunk int, start int, end int, final boolean"), "chat-ends")
    small = ends.count() <= SMALL_CUTS
    met = labelled.join(F.broadcast(ends) if small else ends, (F.col("part") == F.col("_part")) & (F.col("chunk") == F.col("_chunk")), "left")
    ordered = met.select("part", "chunk", "turn", "pos", "role", "known", "text", "start", "end", "final", "conv_id").repartition("part", "chunk").sortWithinPartitions("part", "chunk", "pos")
    return ordered.mapInArrow(_repair, REPAIRED)


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
