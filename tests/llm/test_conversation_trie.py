"""The conversation trie against a plain one, over any number of splitters."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fairtag.llm.conversation_trie import NODE, Skeleton, Splitters, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, shard int, low long, key string"
NAMES = [c.split()[0] for c in NODE.split(", ")]


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in (r[:4] for r in rows):
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, name), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(int(c / 100) * 100, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[x][0] for x in children[node]) or 1
        saved = sum(below[x][1] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below[node] = leaves, saved
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        above = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), above, len(members[node]), len(children[node]), leaves, saved, digest))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def conversations(seed, n=400, words=3):
    """Few different turns, so that paths are shared; one conversation that a third of the ids hold; some ids below 0."""
    rng = random.Random(seed)
    common = [("user", "a common é🙂 start"), ("assistant", "and its answer"), (None, None)]
    rows = []
    for c in rng.sample(range(-150, 3 * n), n):
        turns = common if rng.random() < 0.35 else [
            (rng.choice(["user", "assistant"]), "x" * rng.randrange(words)) for _ in range(rng.choice([1, 2, 3, 5, 8, 12]))
        ]
        rows += [(c, None if rng.random() < 0.05 else i, *t, "p", 1, 2, None) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows + rows[:5] + [(None, 0, "user", "no conversation", None, None, None, None)]


@pytest.mark.parametrize("spec", [Splitters(), Splitters(shards=1), Splitters(shards=40, sample=2, ids=7), Splitters(shards=25, turns=1, sample=3)])
def test_against_plain_trie(spark, spec):
    rows = conversations(spec.shards)
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), spec)) == sorted(plain(rows), key=str)


def test_long_and_turnless_conversations(spark):
    # 101 and 102 keep nothing of their own if they have no more turns than what is taken from 100.
    rows = [(100, i, "user", f"t{i}", *[None] * 4) for i in range(3000)]
    rows += [(c, i, "user", f"{c}-{i}", *[None] * 4) for c in range(101, 160) for i in range(2)]
    rows += [(c, 0, "user", "alone", *[None] * 4) for c in range(501, 560)]
    want = plain(rows)
    assert any(w[1] == 3000 for w in want) and next(w for w in want if w[1] == 0)[7] != hashlib.sha256(b"").hexdigest()
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA), Splitters(shards=6, sample=3))) == sorted(want, key=str)


def test_empty_table_and_nulls_only(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None, None, None, None, None), (7, None, None, None, None, None, None, None)]
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == sorted(plain(rows), key=str)


def test_skeleton_numbers_children_after_parents():
    skeleton = Skeleton([[b"b", b"c"], [b"a"], [b"b", b"a"]])
    assert skeleton.depths == [0, 1, 1, 2, 2] and skeleton.parents == [-1, 0, 0, 2, 2]
    assert skeleton.down([b"b", b"a", b"z"]) == [0, 2, 3] and skeleton.down([]) == [0]
