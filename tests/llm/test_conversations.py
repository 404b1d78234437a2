import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from linkfold.llm import queries
from linkfold.llm.conversations import best_repair, damaged, parse, repair_conversations, repaired_digests, turn_cell

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
ROLES = {"u": "user", "a": "assistant"}


def faults(turns):
    """0 none, 1 blank, 2 duplicate, 3 truncated, for ordered ``(role, text)``."""
    seen, out = set(), []
    for role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def enumerated(turns):
    """All edits of each turn with up to two inserts before it and at the end."""
    gaps = [()] + [(a,) for a in "ua"] + list(product("ua", repeat=2))
    choices = []
    for (role, _), fault in zip(turns, faults(turns)):
        extra = 3 * (fault == 3)
        edits = [(4, "D", "")]
        if fault in (0, 3):
            edits += [(extra, "K", role[:1])] * bool(role) + [(3 + extra, "R", r) for r in "ua"]
        choices.append([(3 * len(g) + c, "I" * len(g) + e, "".join(g) + r) for g in gaps for c, e, r in edits])
    choices.append([(3 * len(g), "I" * len(g), "".join(g)) for g in gaps])
    return min((sum(c for c, _, _ in way), "".join(e for _, e, _ in way)) for way in product(*choices)
               if GOOD.fullmatch("".join(r if r else "" for _, _, r in way)))


def by_rows(turns):
    """The cheapest repair turn by turn, as a path through the states; for long conversations."""
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}

    def inserted(best):
        while True:
            more = dict(best)
            for (p, c), q in step.items():
                if c != "s" and p in best:
                    way = (best[p][0] + 3, best[p][1] + "I", best[p][2] + [(ROLES[c], "")])
                    if q not in more or way[:2] < more[q][:2]:
                        more[q] = way
            if more == best:
                return best
            best = more

    best = inserted({"0": (0, "", [])})
    for (role, text), fault in zip(turns, faults(turns)):
        new = {}
        for p, (cost, audit, out) in best.items():
            ways = [(p, (cost + 4, audit + "D", out))]
            if fault in (0, 3):
                extra = 3 * (fault == 3)
                for (s, c), q in step.items():
                    if s == p and c == role[:1]:
                        ways.append((q, (cost + extra, audit + "K", out + [(role, text)])))
                    if s == p and c in "ua":
                        ways.append((q, (cost + 3 + extra, audit + "R", out + [(ROLES[c], text)])))
            for q, way in ways:
                if q not in new or way[:2] < new[q][:2]:
                    new[q] = way
        best = inserted(new)
    return min((best[p] for p in "03" if p in best), key=lambda w: w[:2])


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (2 if k == 3 else 1)
    return out


def plain_repairs(rows, order):
    """The rows of the query for ``rows`` after damage; ``order`` are the original ids."""
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in order}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns, numbers = [r[2:] for r in mine], [r[1] for r in mine if r[1] is not None]
        kinds, (cost, audit, out) = faults(turns), by_rows(turns)
        initials = [t[0][:1] for t in turns]
        want[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, kinds.count(1), kinds.count(2), kinds.count(3),
                      sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                      hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return want


def random_turns(rng, n, conv):
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?  ", "same.", "same.", "é ok.", "x."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", "User", "agent", " "]
    return [(conv, t, rng.choice(roles), rng.choice(texts) + (str(rng.randrange(99)) + "." if rng.random() < 0.5 else "")) for t in range(n)]


def test_parse_against_all_edits():
    rng = random.Random(1)
    for k in range(60):
        turns = [r[2:] for r in random_turns(rng, k % 4, 0)]
        got = best_repair(parse([turn_cell(r[:1], f) for (r, _), f in zip(turns, faults(turns))]))
        assert got == enumerated(turns) == by_rows(turns)[:2]


def test_parse_against_a_path_through_the_states():
    rng = random.Random(2)
    for n in (5, 17, 64, 201, 400):
        turns = [r[2:] for r in random_turns(rng, n, 0)]
        assert best_repair(parse([turn_cell(r[:1], f) for (r, _), f in zip(turns, faults(turns))])) == by_rows(turns)[:2]


@pytest.mark.parametrize("block,fan,parts", [(1024, 64, 2), (3, 2, 5)])
def test_repairs_against_plain_python(spark, block, fan, parts):
    rng = random.Random(3)
    rows = [r for c in range(40) for r in random_turns(rng, rng.randint(1, 12), c)] + random_turns(rng, 300, 99)
    rows += [(None, 0, "user", "A null id."), (None, 1, None, None), (7, None, "user", "No turn."), (7, None, "user", "No turn."),
             (50, None, "user", "Only."), (60, 2**40, "user", "Far."), (60, -3, "system", "Below.")]
    rows = [(c, t if c != 99 else t // 2, r, x) for c, t, r, x in rows]      # repeated turn numbers
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "'x' as pos", "'x' as conv", "'x' as audit", "'x' as fault")
    hurt = plain_damage(rows)
    assert sorted(map(str, hurt)) == sorted(str(tuple(r)) for r in damaged(docs).collect())
    repair = repair_conversations(damaged(docs), block, fan)
    digest = {r["conv"]: r["repaired_sha256"] for r in repaired_digests(repair.turns).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = {r["conv"]: (*tuple(r)[1:], digest.get(r["conv"], none)) for r in repair.conversations.collect()}
    want = plain_repairs(hurt, [])
    assert got == {None if c is None else str(c): w for c, w in want.items()}


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for c in range(60) for r in random_turns(rng, rng.randint(1, 9), c)] + [(200 + k, 0, "user", "Alone.") for k in range(40)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = plain_repairs(plain_damage(rows), {r[0] for r in rows})
    assert got == want and any(w[6] == "" and w[5] == 0 for w in want.values())     # a conversation that damage drops


def test_empty_table(spark, tmp_path):
    repair = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert repair.conversations.collect() == [] and repair.turns.collect() == []
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_conversation_repair(spark, str(tmp_path)).collect() == []
