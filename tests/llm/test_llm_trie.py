"""The prefix trie against brute force, and the radix tree's layouts."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from feedloom.llm import prefix_trie
from feedloom.llm.queries import QUERIES
from feedloom.llm.radix_tree import DirectKeys, IndexedKeys, RadixTree, SortedKeys

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole, members = {}, defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, among in members.items():
        worth = (len(among) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += worth
            leaves[path[:d]] += path not in children
    out = []
    for path, among in members.items():
        ends = ",".join(str(c) for c in sorted(among) if len(whole[c]) == len(path))
        out.append((
            min(among), len(path), min(members[path[:-1]]) if path else None, len(among), children.get(path, 0), leaves[path],
            saved[path], sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(conversations, **options):
    return sorted(map(tuple, prefix_trie.prefix_nodes(conversations, **options).select(COLUMNS).collect()), key=str)


def test_whole_table(spark):
    given = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = QUERIES["op12_prefix_trie"](spark, FOLDER)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == brute_force(given)


def shared():
    """Conversations that share first turns, whole dialogues, and ends inside others."""
    rows = []
    for c in range(240):
        length = c * 7 % 11
        rows += [(c, t, "user" if t % 2 else "bot", f"turn {t}" if t < 4 + c % 3 else f"turn {t} of {c % 5}") for t in range(length)]
    rows += [(1000 + i, t, "user", f"long {t}") for i in range(12) for t in range(80 + i % 3)]
    return rows


@pytest.mark.parametrize("task_turns", [1, 9, 100, 10_000])
def test_any_ranges(spark, task_turns, monkeypatch):
    rows = shared()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # Paths that are told apart only beyond the turns they are dealt by.
    for range_turns in (prefix_trie.RANGE_TURNS, 2):
        monkeypatch.setattr(prefix_trie, "RANGE_TURNS", range_turns)
        assert nodes(table, task_turns=task_turns) == brute_force(rows)


def test_odd_rows(spark):
    rows = [
        (100, None, "user", "first"), (100, 1, None, None), (100, 1, "", ""), (101, 0, "user", "own"), (101, 0, "user", "own"),
        (102, None, None, "x" * 50_000), (None, 0, "user", "nobody's"), (-5, 0, "user", "below"), (7, 0, "a", "bc"), (8, 0, "ab", "c"),
        (205, 0, "user", "a"), (206, 0, "user", "\U0001f600é"),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    table = table.select("*", *[F.lit("x").alias(c) for c in ("id", "path", "chars", "base", "lead", "turns", "key", "kind", "depth")])
    given = [(c, t, r, x) for c, t, r, x in rows if c != -5]
    assert nodes(table.filter("conv_id is null or conv_id <> -5")) == brute_force(given)
    assert any(r[0] == -5 for r in nodes(table))
    assert nodes(table.limit(0)) == []
    assert nodes(table.filter("conv_id is null")) == []


def test_many_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(60) for t in range(7)]
    assert nodes(spark.createDataFrame(rows, SCHEMA), task_turns=40) == brute_force(rows)


def test_layouts_grow():
    tree, kinds = RadixTree(), []
    for byte in range(256):
        tree.insert(bytes([byte, byte, 7]), byte, byte)
        kinds.append((type(tree.root.children), getattr(tree.root.children, "room", None)))
    assert [kinds.count(k) for k in ((SortedKeys, 4), (SortedKeys, 16), (IndexedKeys, None), (DirectKeys, None))] == [4, 12, 32, 208]
    assert [node.members for node in tree.root.branches()] == [[b] for b in range(256)]
    assert all(len(node.edge) == 3 for node in tree.root.branches())


def test_edges_split_and_join():
    tree = RadixTree()
    for path in (b"abcdef", b"abcxyz", b"abc", b"", b"abcdef"):
        tree.insert(path, len(path), path)
    assert [node.edge for node in tree.walk(b"abcdef")] == [b"", b"abc", b"def"]
    assert [node.members for node in tree.walk(b"abcdef")] == [[0], [3], [6, 6]]
    assert [node.edge for node in tree.walk(b"abcxyz")] == [b"", b"abc", b"xyz"]
