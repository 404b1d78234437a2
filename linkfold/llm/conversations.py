"""Conversation structure repair by weighted CYK interval parsing.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits: Keep a turn (0), Rerole it to user or assistant (3),
Delete it (4; the only edit of a blank or repeated turn), Insert an empty user or assistant turn anywhere (3); a truncated
turn that stays adds 3. Of the cheapest repairs the one with the ASCII-least audit (the edits' initials) is taken.

The grammar is in Chomsky normal form. Its nonterminals ``N[p,q]`` stand for what leads from state p to state q of the
language: 0 nothing yet, 1 after ``s``, 2 after ``u``, 3 after ``a`` (0 and 3 are complete). Rules: ``N[p,q] -> N[p,r] N[r,q]``, and
``N[p,q] ->`` one edited turn, with the insertion closure (the cheapest inserts from state to state) on either side. The chart's
cell of a span of turns holds the least (cost, audit) of each nonterminal, and spans are combined bottom-up by length. The
nonterminals are closed under splitting: a derivation over a span can be cut at any turn, and equal cells come out of
every cut, as concatenation keeps the order of (cost, audit) (audits of equal cost over one span are never prefixes of
each other: what one has beyond the other would be inserts, which cost). So one cut for each span is enough: spans of 1, 2, 4, ...
turns, and the chart is linear in the turns.

For the same reason a long conversation need not be parsed in one task. Its turns lie in blocks of ``block`` places of the
table's order; a task parses a block's turns, and further passes combine up to ``fan`` neighbouring spans at a time. What
cannot be split is a conversation's audit, which is one value, and in ``repaired_digests`` its SHA-256, which reads
the repaired text from first to last; both are streamed, so memory stays bounded by the audit.

Turns are ordered by turn number (null first), then role and a digest of role and text, so repeats are neighbours.

Cases: a null role or text is one space; null conversation ids form one conversation; an empty role has no initial and is
never kept; a role counts by its first letter; repeated rows are repeated turns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import SPACE_WORD, stored
from linkfold.operators.ordering import ordered, running_totals

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: the states' moves by role initial
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_STATES = range(4)
#: the nonterminals, those with q reachable from p, and their binary rules
PAIRS = [(p, q) for p in _STATES for q in _STATES if p == q or q in (2, 3) or (p, q) == (0, 1)]
RULES = [(PAIRS.index((p, q)), [(PAIRS.index((p, r)), PAIRS.index((r, q))) for r in _STATES if (p, r) in PAIRS and (r, q) in PAIRS])
         for p, q in PAIRS]
_NONE = (1 << 60, "")
#: initials of neighbouring turns that need no repair
LEGAL = ("su", "ua", "au")

Cell = list[tuple[int, str]]


def combine(a: Cell, b: Cell) -> Cell:
    """The cells of two neighbouring spans as the cell of both."""
    out = []
    for _, splits in RULES:
        best = _NONE
        for i, j in splits:
            cost = a[i][0] + b[j][0]
            if cost <= best[0] and cost < _NONE[0]:
                audit = a[i][1] + b[j][1]
                if cost < best[0] or audit < best[1]:
                    best = (cost, audit)
        out.append(best)
    return out


def _cell(moves: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return [moves.get(p, _NONE) for p in PAIRS]


def _closure() -> Cell:
    """The empty span: inserts from state to state."""
    step = _cell({(p, p): (0, "") for p in _STATES} | {(p, q): (INSERT, "I") for (p, c), q in NEXT.items() if c != "s"})
    cell = step
    while (longer := combine(cell, step)) != cell:
        cell = longer
    return cell


EMPTY = _closure()
_TURNS: dict[tuple[str, int], Cell] = {}


def turn_cell(initial: str, fault: int) -> Cell:
    """The cell of one turn; ``fault`` 0 none, 1 blank, 2 duplicate, 3 truncated."""
    key = (initial if initial in ("s", "u", "a") else "", fault)
    if key not in _TURNS:
        moves, extra = {(p, p): (DELETE, "D") for p in _STATES}, TRUNCATED * (fault == 3)
        if fault in (0, 3):
            for (p, c), q in NEXT.items():
                if c != "s":
                    moves[p, q] = (REROLE + extra, "R")
            for (p, c), q in NEXT.items():
                if c == key[0]:
                    moves[p, q] = (extra, "K")
        _TURNS[key] = combine(combine(EMPTY, _cell(moves)), EMPTY)
    return _TURNS[key]


def parse(cells: list[Cell]) -> Cell:
    """The cell of a whole sequence, spans doubling in length."""
    if not cells:
        return EMPTY
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best_repair(cell: Cell) -> tuple[int, str]:
    return min(cell[PAIRS.index((0, 0))], cell[PAIRS.index((0, 3))])


# ---------------------------------------------------------------- over a table

def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def conversation_turns(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, pos, fault, initial)`` of ``rows(conv_id, turn, role, text)``, stored: ``conv`` is the id's text, ``pos``
    numbers all turns of the table so that those of a conversation follow each other, ``fault`` is the first that holds."""
    named = rows.select(F.col("conv_id").cast("string").alias("conv"), "turn", _text("role").alias("role"), _text("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # whole texts are no sort key: Spark samples the keys on the driver
    t = ordered(named.withColumns({"_d": digest, "_copy": F.monotonically_increasing_id()}), ["conv", "turn", "role", "_d", "_copy"])
    placed = stored(running_totals(t, {"pos": F.lit(1)}).select(
        "conv", "turn", "role", "text", F.col("pos").cast("long").alias("pos"), "_d"), "turns-placed")
    # the place is unique, so turns that are repeated a million times meet nothing but their own place
    first = (placed.groupBy(F.col("conv").alias("_c"), "_d").agg(F.min("pos").alias("_first")).select("_first"))
    blank = ~F.col("text").rlike(SPACE_WORD)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    joined = placed.join(first, F.col("pos") == F.col("_first"), "left")
    fault = F.when(blank, 1).when(F.col("_first").isNull(), 2).when(cut, 3).otherwise(0)
    return stored(joined.select("conv", "turn", "role", "text", "pos", fault.alias("fault"), F.substring("role", 1, 1).alias("initial")),
                  "turns")


_SPANS = "conv string, lo long, first string, last string, illegal long, costs array<long>, audits array<string>"


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list]]:
    """The rows of sorted batches in groups of equal keys, whole also where a group goes over batches."""
    held, rows = None, []
    for b in batches:
        for row in b.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            if rows and key != held:
                yield held, rows
                rows = []
            held = key
            rows.append(row)
    if rows:
        yield held, rows


def _joined(conv: str | None, rows: list, cells: list[Cell]) -> tuple:
    """One span of neighbouring ones, as a row of ``_SPANS``."""
    illegal = sum(r.illegal for r in rows) + sum(a.last + b.first not in LEGAL for a, b in zip(rows, rows[1:]))
    cell = parse(cells)
    return conv, rows[0].lo, rows[0].first, rows[-1].last, illegal, [c for c, _ in cell], [a for _, a in cell]


def _frames(rows: Iterator[tuple], schema: str, size: int = 512) -> Iterator[pd.DataFrame]:
    names, held = [c.split()[0] for c in schema.split(", ")], []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def parsed(turns: DataFrame, block: int = 1024, fan: int = 64) -> DataFrame:
    """``(conv, first_pos, illegal, cost, audit)``, one row per conversation of ``conversation_turns``."""
    def leaves(batches):
        def spans():
            for (conv, _), rows in _runs(batches, ["conv", "block"]):
                yield _joined(conv, rows, [turn_cell(r.first, r.fault) for r in rows])
        return _frames(spans(), _SPANS)

    def merged(batches):
        def spans():
            for (conv, _), rows in _runs(batches, ["conv", "block"]):
                yield _joined(conv, rows, [list(zip(r.costs.tolist(), r.audits)) for r in rows])
        return _frames(spans(), _SPANS, 64)

    by_block = F.expr(f"pos div {int(block)}").alias("block")
    src = turns.select("conv", by_block, F.col("pos").alias("lo"), "fault", F.col("initial").alias("first"),
                       F.col("initial").alias("last"), F.lit(0).cast("long").alias("illegal"))
    spans = stored(src.repartition("conv", "block").sortWithinPartitions("conv", "block", "lo").mapInPandas(leaves, _SPANS), "turn-spans")
    width = block
    while not spans.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        width *= fan
        blocks = spans.select("*", F.expr(f"lo div {width}").alias("block"))
        spans = stored(blocks.repartition("conv", "block").sortWithinPartitions("conv", "block", "lo")
                       .mapInPandas(merged, _SPANS), "turn-spans")
    nothing, complete = PAIRS.index((0, 0)), PAIRS.index((0, 3))
    best = F.least(*[F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in (nothing, complete)])
    return spans.select("conv", F.col("lo").alias("first_pos"), "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


_REPAIRED = "conv string, pos long, sub int, edit string, role string, text string"


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, pos, sub, edit, role, text)``: the turns after repair, in the order ``pos, sub`` in each conversation (deleted ones are
    left out). An inserted turn has the place of the turn after it, or follows the last one.

    A conversation's audit goes ahead of its turns in the sort, so a task streams both and holds one audit at a time.
    """
    def walk(batches):
        def rows():
            conv, state, audit, at, left = None, 0, "", 0, 0

            def inserts(pos, sub):
                nonlocal state, at
                while at < len(audit) and audit[at] == "I":
                    role = "assistant" if state == 2 else "user"
                    yield conv, pos, sub, "I", role, ""
                    state, at, sub = NEXT[state, role[0]], at + 1, sub + 1

            for b in batches:
                for r in b.itertuples(index=False):
                    if r.kind == 0:
                        conv, state, audit, at = r.conv, 0, r.text, 0
                        left = len(audit) - audit.count("I")   # turns to come
                        continue
                    before = at
                    yield from inserts(r.pos, 0)
                    sub, edit, left = at - before, audit[at], left - 1
                    at += 1
                    if edit != "D":
                        role = r.role if edit == "K" else "assistant" if state == 2 else "user"
                        yield conv, r.pos, sub, edit, role, r.text
                        state = NEXT[state, role[0]]
                    if not left:   # after the last turn
                        yield from inserts(r.pos, sub + 1)
        return _frames(rows(), _REPAIRED)

    heads = found.select("conv", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = turns.select("conv", F.lit(1).alias("kind"), "pos", "role", "text")
    return (heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "pos").mapInPandas(walk, _REPAIRED))


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of ``role:text``, newline-joined; conversations of which nothing is left are missing."""
    schema = "conv string, repaired_sha256 string"

    def run(batches):
        def rows():
            conv, h = None, None
            for b in batches:
                for r in b.itertuples(index=False):
                    if h is None or r.conv != conv:
                        if h is not None:
                            yield conv, h.hexdigest()
                        conv, h = r.conv, hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(f"{r.role}:{r.text}".encode())
            if h is not None:
                yield conv, h.hexdigest()
        return _frames(rows(), schema)

    return repaired.repartition("conv").sortWithinPartitions("conv", "pos", "sub").mapInPandas(run, schema)


@dataclass
class Repair:
    """``conversations``: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``; ``turns``: the repaired turns."""
    conversations: DataFrame
    turns: DataFrame


def repair_conversations(rows: DataFrame, block: int = 1024, fan: int = 64) -> Repair:
    """Faults and cheapest repair of every conversation of ``rows(conv_id, turn, role, text)``; see the module text."""
    turns = conversation_turns(rows)
    found = stored(parsed(turns, block, fan), "turn-repairs")
    count = lambda k: F.count(F.when(F.col("fault") == k, 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    sums = turns.groupBy(F.col("conv").alias("_c")).agg(gaps.alias("gaps"), count(1).alias("blank"), count(2).alias("duplicate"),
                                                        count(3).alias("truncated"))
    summary = found.join(sums, F.col("conv").eqNullSafe(F.col("_c"))).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(summary, repaired_turns(turns, found))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with the test damage: by crc32(``conv_id:turn``) % 20 a row is dropped (0), emptied (1), loses
    its ``[.!?]`` (2), is repeated (3) or gets the role user (4). Nulls are one space."""
    key = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    kept = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), key.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (kept.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                        F.explode(times).alias("_time")).drop("_time"))
