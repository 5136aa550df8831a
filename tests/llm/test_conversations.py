"""Conversation repair against a plain version."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from quillspark.llm import conversations, queries

STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
TURN = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def best(rows, i, state, memo):
    """(cost, audit, repaired turns) of the cheapest and then ASCII-least edits from here; inserts are tried at most twice in a row."""
    key = i, state
    if key in memo:
        return memo[key]
    return memo.setdefault(key, min(options(rows, i, state, memo, 3)))


def options(rows, i, state, memo, inserts):
    if i == len(rows):
        if state in ("", "a"):
            yield 0, "", ()
    else:
        (role, text), fault = rows[i]
        more = []
        cost, audit, rest = best(rows, i + 1, state, memo)
        more.append((cost + 2, "D" + audit, rest))
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            if (to := STATES[state].get(role[:1])) is not None:
                cost, audit, rest = best(rows, i + 1, to, memo)
                more.append((cost + extra, "K" + audit, (f"{role}:{text}", *rest)))
            cost, audit, rest = best(rows, i + 1, TURN[state], memo)
            more.append((cost + 1 + extra, "R" + audit, (f"{ROLES[TURN[state]]}:{text}", *rest)))
        yield from more
    if inserts:
        for cost, audit, rest in options(rows, i, TURN[state], memo, inserts - 1):
            yield cost + 5, "I" + audit, (ROLES[TURN[state]] + ":", *rest)


def plain(rows):
    rows = list(rows)
    after = list(damaged(rows))
    out = set()
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        seen, marked = set(), []
        for _, role, text in own:
            shown = WORD.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append(((role, text), fault))
        count = lambda f: sum(x == f for _, x in marked)
        illegal = sum(a[0][0][:1] + b[0][0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, turns_left = best(marked, 0, "", {})
        sha = hashlib.sha256("\n".join(turns_left).encode()).hexdigest()
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, codes string, at long"


def found(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(parts)
    df = conversations.digest(frame)
    assert df.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def odd(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why?", "cut", "cut", "", " \t\n", None, "Fine. \n", "é", "é.", "x" * 3000 + "."]
    for _ in range(n):
        yield rng.choice([None, *range(60)]), rng.choice([None, *range(6), 40, -3]), rng.choice(roles), rng.choice(texts)


@pytest.mark.parametrize("bits", [12, 1, 0])
def test_plain_version(spark, monkeypatch, bits):
    """Odd roles, faults, ties and nulls; also with conversations cut into segments of two rows and of one."""
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    rows = list(odd(random.Random(bits), 500))
    assert found(spark, rows) == plain(rows)


def test_one_conversation_in_many_partitions(spark, monkeypatch):
    """A conversation that holds nearly all rows is cut by place, and its segments fit together again."""
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 3)
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), f"{i} said{rng.choice(['.', '.', '', '!'])}") for i in range(150)]
    rows += [(7, i, "user", "the same.") for i in range(150, 190)] + [(8, 0, "user", "hi."), (8, 0, "user", "hi."), (9, None, None, None)]
    assert found(spark, rows) == plain(rows)


def test_edges(spark):
    assert found(spark, []) == set()
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "All rows dropped.")]
    assert found(spark, rows) == plain(rows) == {(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert {r[1] for r in found(spark, far)} <= {2**63 - 1, 0}


def test_bucket_queue():
    """Costs and walks of all short rows of symbols, whole and cut in two."""
    rng = random.Random(4)
    for _ in range(300):
        codes = "".join(rng.choices("suaxSUAX15", k=rng.randint(1, 9)))
        whole = conversations.costs_to_end(codes, conversations.AT_END)
        audit, _ = conversations.walk(codes, whole, 0, True)
        k = rng.randint(0, len(codes))
        behind = conversations.costs_to_end(codes[k:], conversations.AT_END)[:4]
        crossing = conversations.crossing(codes[:k])
        assert whole[0] == min(crossing[b] + behind[b] for b in range(4))
        front, state = conversations.walk(codes[:k], conversations.costs_to_end(codes[:k], behind), 0, False)
        back, _ = conversations.walk(codes[k:], conversations.costs_to_end(codes[k:], conversations.AT_END), state, True)
        assert front + back == audit


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows.sort(key=lambda r: r[0])
    want = set()
    for _, own in groupby(rows, key=lambda r: r[0]):
        want |= plain(own)
    got = [tuple(r)[:9] for r in queries.op13_conversation_repair(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(r[6] for r in want) > 100
