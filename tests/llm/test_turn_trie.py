"""The trie of conversations against a brute-force one."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from surfaudit.llm import turn_trie
from surfaudit.llm.common import table
from surfaudit.llm.turn_trie import conversation_trie
from tests.llm.test_operators import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    leaves, saved, children = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(held) - 1) * len(p[-1][1]) if p else 0
    first = {p: min(c for c, _ in held) for p, held in members.items()}
    return sorted(
        (first[p], len(p), first[p[:-1]] if p else None, len(held), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in held if end)).encode()).hexdigest())
        for p, held in members.items()
    )


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in conversation_trie(df).collect())


def test_supplied_conversations(spark):
    df = table(spark, SF, "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert found(df) == brute_trie(rows)


def test_shared_turns_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "LEAST_TURNS", 16)
    monkeypatch.setattr(turn_trie, "CHUNK_IDS", 3)
    draw = random.Random(4)
    rows = []
    for c in range(900):
        depth = draw.choice([1, 2, 3, 5, 9, 20])
        rows += [(c, t, draw.choice(["user", "bot", None]) if t % 3 == 0 else "bot", draw.choice(["a", "béé", "", None]) if t % 2 else "same") for t in range(depth)]
    for c in range(1000, 1300):  # one conversation many times, and its continuations
        rows += [(c, t, "user", f"hot {t}") for t in range(6 + c % 3)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert found(df) == brute_trie(rows)


def test_odd_conversations(spark):
    rows = [
        (5, None, None, None), (5, 1, "user", "x" * 50_000), (5, 1, "bot", "tie"), (5, 1, "bot", "tie"), (103, 0, "user", "hi"), (7, 3, "", ""),
        (None, 0, "user", "nobody"), (100, 0, "user", "hi"), (-4, 0, "user", "hi"), (207, 0, "a", "b"), (207, 1, "a", "b"), (9, None, "user", None),
        *[(300, t, "user", f"{t}") for t in range(400)], *[(301, t, "user", f"{t}") for t in range(390)],
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"t": F.lit("x"), "turns": F.lit(1), "key": F.lit(2), "h": F.lit(0)})
    # Python floors, SQL cuts: the family of -4 is 0 either way, and there is none here.
    assert found(df) == brute_trie(rows)
    assert conversation_trie(df.where("false")).count() == 0
