"""The prefix trie against a plain one by dictionaries: shared beginnings, copies, prefixes of others, odd rows, any block size."""

import hashlib
import random
import zlib

import pytest

from planmatch.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def plain(rows):
    """By the contract, with lists and dictionaries; rows of one turn number must be equal."""
    own: dict = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (c % 20 if c >= 0 else -(-c % 20))
        path[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    members: dict = {}
    for c, turns in path.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    count = lambda t: len([w for w in t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w])
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}
    out = []
    for node, own_ in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in own_ if len(path[c]) == len(node))
        out.append((min(own_), len(node), min(members[node[:-1]]) if node else None, len(own_), len(children[node]), sum(not children[m] for m in below),
                    sum((len(members[m]) - 1) * count(m[-1][1]) for m in below if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(4)


def found(spark, rows, size=conversation_trie.BLOCK):
    return sorted((tuple(r) for r in conversation_trie.trie(table(spark, rows), size).collect()), key=str)


def conversations(seed):
    rng = random.Random(seed)
    texts = ["a b", "c", "", None, " d\te  f ", " g"]
    rows = []
    for c in rng.sample(range(-45, 90), 70):
        kind = rng.random()
        turns = [(rng.choice(["user", "bot", None]), rng.choice(texts)) for _ in range(rng.randint(1, 11))] if kind < 0.4 else [("user", "a b"), ("bot", "c")] * rng.choice([1, 2, 4, 6]) + [("user", rng.choice(texts))] * (kind < 0.7)
        # null first, gaps after
        rows += [(c, None if i == 0 and c % 3 == 0 else 3 * i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("size", [1, 3, 4])
def test_against_plain(spark, size):
    rows = conversations(size)
    assert found(spark, rows, size) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (7, 1, "user", "x y"), (7, 1, "user", "x y"), (8, None, None, None), (2**40, 0, "user", "x y")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []
    # a turnless conversation: its only turns are the ones it would take over from one that isn't there
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert found(spark, [(lone, 0, "user", "x")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_one_conversation_and_many_copies(spark):
    """A conversation of two thirds of all turns, and a group of copies with more ids than are joined at once."""
    rows = [(60, i, "user", f"t {i % 5}") for i in range(900)] + [(c, i, "bot", "same") for c in range(100, 100 + 2 * conversation_trie.CHUNK) for i in range(4)]
    got = found(spark, rows)
    deep = [r for r in got if r[1] > 4 and r[0] == 60]
    assert len(deep) == 900 - 4 and all(r[3] == 1 for r in deep)
    own = {c: zlib.crc32(str(c).encode()) % 4 for c in range(100, 100 + 2 * conversation_trie.CHUNK)}
    there = [c for c in own if c - c % 20 >= 100]
    (copies,) = [r for r in got if r[1] == 4 and r[0] != 60]
    assert copies[3] == len(there) and copies[7] == hashlib.sha256(",".join(map(str, sorted(there))).encode()).hexdigest()


def test_long_conversations_are_dealt_out(spark):
    """Blocks and places of one conversation lie in many ranges, and its digests are those of one task."""
    rows = [(40, i, "user", str(i % 7)) for i in range(200)]
    turned = conversation_trie.turns(table(spark, rows))
    a = conversation_trie.blocks(turned.withColumnRenamed("pos", "depth"), 4)
    b = conversation_trie.blocks(turned.withColumnRenamed("pos", "depth").coalesce(1), 4)
    key = lambda df: sorted((r["k"], r["before_lo"], r["after_hi"]) for r in df.collect())
    assert key(a) == key(b) and len(key(a)) == 50
