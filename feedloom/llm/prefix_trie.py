"""The trie of all conversation prefixes, built by adaptive radix trees.

1. A turn's id is a fixed-width big-endian number, the first 128 bits of the SHA-256 of its
   role and text, so no dictionary of turns is needed and texts leave the first pass as ids
   and lengths. A conversation's path is the bytes of its turns' ids.
2. Paths are dealt to tasks by ranges of (first turns, conv_id), so that neither a first turn
   nor a whole conversation that many share can gather in one task. Each task puts its paths
   into a radix tree; only the depths that are whole turns are nodes.
3. Another task can only know nodes on paths that begin like the first or the last path of a
   range. These are left open: their counts are summed over the tasks by the hash of their
   prefix. All other nodes are complete where they are.
4. Sums over the subtree of an open node: every open path adds, at each of its depths, what
   lies below there on nodes that it is the first path of. This counts each node once.
5. The ids that end at an open node leave the tasks as long strings in ascending ranges, and
   are hashed as they stream by.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import staged
from feedloom.llm.radix_tree import Node, RadixTree

#: Bytes of a turn id.
TURN_BYTES = 16
#: Turns by which paths are dealt to ranges, and turns in a range.
RANGE_TURNS, TASK_TURNS = 64, 20_000
#: Ids in one string of members.
CHUNK_IDS = 4096
NO_MEMBERS = sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
#: kind 0: a complete node; with ``parent_key`` its parent is open. 1: an open node on the open
#: path ``open_path``. 2: members that end at an open node.
PIECE = (
    f"kind int, {NODE}, ends_sha256 string, key binary, parent_key binary, open_path bigint, "
    "last_chars bigint, first_id bigint, ids string"
)
FIELDS = [part.split()[0] for part in PIECE.split(", ")]
TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
ARROW = pa.schema([(name, TYPES[kind]) for name, kind in (part.split() for part in PIECE.split(", "))])
ROWS = 10_000


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one it is rebuilt on."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(6)).cast("int")


def turn_id(role: Column, text: Column) -> Column:
    """``TURN_BYTES`` bytes; the role's length keeps ("a", "bc") and ("ab", "c") apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * TURN_BYTES))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars): ids and code points of every rebuilt conversation's turns.

    One row per conversation, 20 bytes a turn; no text is gathered.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), turn_id(role, text).alias("id"), F.length(text).alias("chars")).alias("turn"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    own = ordered.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "turns")
    lead = own.filter("conv_id = base").select("base", F.slice("turns", 1, 5).alias("lead"))
    h = heads(F.col("conv_id"))
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    rebuilt = own.join(lead, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("lead", none), F.lit(1), h), rest).alias("turns")
    )
    return rebuilt.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )


class _Rows:
    """Rows of one task, handed out as record batches."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {name: [] for name in FIELDS}

    def add(self, **values: object) -> None:
        for name, column in self.columns.items():
            column.append(values.get(name))

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns["kind"]) >= least:
            yield pa.RecordBatch.from_pydict(self.columns, ARROW)
            self.columns = {name: [] for name in FIELDS}


def _depths(start: int, end: int) -> range:
    """Depths of the nodes on an edge from byte ``start`` to byte ``end``; 0 belongs to the root."""
    return range(start // TURN_BYTES + 1, end // TURN_BYTES + 1) if end else range(0, 1)


def _below(root: Node) -> list[tuple[Node, int]]:
    """(node, byte depth of its parent) in an order that has parents first."""
    out, stack = [], [(root, 0)]
    while stack:
        node, start = stack.pop()
        out.append((node, start))
        end = start + len(node.edge)
        stack += [(child, end) for child in node.branches()]
    return out


def _sum_up(order: list[tuple[Node, int]]) -> None:
    """Fill ``sums`` of every tree node from the leaves up: members below, the smallest, a note of
    one of them; nodes, leaves and saved tokens next below and below its end; the same at its top."""
    for node, start in reversed(order):
        end = start + len(node.edge)
        n, least, note, children, leaves, saved = len(node.members), min(node.members, default=None), node.note, 0, 0, 0
        for child in node.branches():
            below = child.sums
            n, children, leaves, saved = n + below["n"], children + below["tops"], leaves + below["top_leaves"], saved + below["top_saved"]
            least = below["least"] if least is None else min(least, below["least"])
            note = note if note is not None else below["note"]
        node.sums = {"n": n, "least": least, "note": note, "children": children, "leaves": leaves, "saved": saved}
        on_edge = _depths(start, end)
        top_saved = saved + (n - 1) * sum(note[d - 1] for d in on_edge if d)
        has_leaf = bool(on_edge) and children == 0
        node.sums |= {"tops": 1 if on_edge else children, "top_leaves": 1 if has_leaf else leaves, "top_saved": top_saved}


def _digest(ids: Iterable[int]) -> str:
    return sha256(",".join(map(str, ids)).encode()).hexdigest()


def _complete(rows: _Rows, top: Node, start: int, parent: int | None, parent_key: bytes | None) -> Iterator[pa.RecordBatch]:
    """All nodes at and below the edge of ``top``."""
    stack = [(top, start, parent, parent_key)]
    while stack:
        node, start, parent, parent_key = stack.pop()
        s, end = node.sums, start + len(node.edge)
        on_edge = _depths(start, end)
        saved, below, leaves = s["saved"], s["children"], s["leaves"]
        for depth in reversed(on_edge):
            ends = node.members if depth * TURN_BYTES == end else []
            saved += (s["n"] - 1) * s["note"][depth - 1]
            leaves = leaves or 1
            first = depth == on_edge[0]
            rows.add(
                kind=0, conv_id=s["least"], depth=depth, n_convs=s["n"], n_children=below, n_leaves=leaves, saved_tokens=saved,
                parent_conv_id=parent if first else s["least"], parent_key=parent_key if first else None,
                ends_sha256=_digest(sorted(ends)) if ends else NO_MEMBERS,
            )
            below = 1
            yield from rows.flush(ROWS)
        here, here_key = (s["least"], None) if on_edge else (parent, parent_key)
        stack += [(child, end, here, here_key) for child in node.branches()]


def _open_paths(rows: _Rows, tree: RadixTree, open_paths: list[bytes], number: int) -> Iterator[pa.RecordBatch]:
    """The nodes on the open paths, and all that hangs on them."""
    on_open = {id(node) for path in open_paths for node in tree.walk(path)}
    told: set[int] = set()
    for path in open_paths:
        key_hash, start, key, parent_key = sha256(), 0, sha256().digest(), None
        for node in tree.walk(path):
            s, end, new = node.sums, start + len(node.edge), id(node) not in told
            told.add(id(node))
            hanging = [child for child in node.branches() if id(child) not in on_open]
            for depth in _depths(start, end):
                if depth:
                    key_hash.update(path[(depth - 1) * TURN_BYTES:depth * TURN_BYTES])
                    parent_key, key = key, key_hash.digest()
                rows.add(
                    kind=1, key=key, parent_key=parent_key, depth=depth, open_path=number, last_chars=s["note"][depth - 1] if depth else 0,
                    conv_id=s["least"] if new else None, n_convs=s["n"] if new else 0, n_children=0, n_leaves=0, saved_tokens=0,
                )
                if new and depth * TURN_BYTES == end and node.members:
                    members = sorted(node.members)
                    for i in range(0, len(members), CHUNK_IDS):
                        ids = ",".join(map(str, members[i:i + CHUNK_IDS]))
                        rows.add(kind=2, key=key, first_id=members[i], ids=ids)
                        yield from rows.flush(ROWS)
            if new and hanging:
                # Below the deepest open node so far; an end inside a turn belongs to the node above.
                rows.add(
                    kind=1, key=key, open_path=number, depth=end // TURN_BYTES, n_convs=0, n_children=sum(c.sums["tops"] for c in hanging),
                    n_leaves=sum(c.sums["top_leaves"] for c in hanging), saved_tokens=sum(c.sums["top_saved"] for c in hanging),
                )
                for child in hanging:
                    yield from _complete(rows, child, end, None, key)
            start = end
            yield from rows.flush(ROWS)
        number += 1


def _grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One radix tree for a range of paths; see the module's text for what leaves it."""
    tree, first, last, width = RadixTree(), None, None, RANGE_TURNS * TURN_BYTES
    open_first, open_last = {}, {}
    for batch in batches:
        for conv, path, chars in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), batch.column("chars"), strict=True):
            begins = path[:width]
            if first is None:
                first = begins
            if begins == first:
                open_first[path] = None
            if begins != last:
                last, open_last = begins, {}
            open_last[path] = None
            tree.insert(path, conv, chars.values.to_pylist() if path else [])
    if first is None:
        return
    order = _below(tree.root)
    _sum_up(order)
    rows, number = _Rows(), TaskContext.get().partitionId() << 33
    yield from _open_paths(rows, tree, list(open_first | open_last), number)
    yield from rows.flush()


def _hash_members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash the strings of each key, which come in order, one after the other."""
    key, digest = None, None
    for batch in batches:
        done_keys, done = [], []
        for this, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if this == key:
                digest.update(b",")
            else:
                if key is not None:
                    done_keys.append(key)
                    done.append(digest.hexdigest())
                key, digest = this, sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"key": done_keys, "ends_sha256": done})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]})


def _open_nodes(pieces: DataFrame) -> DataFrame:
    """(key, parent_key, node columns) of the open nodes, summed over all tasks."""
    parts = pieces.filter("kind = 1")
    summed = staged(parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.max("last_chars").alias("last_chars"), F.min("open_path").alias("first_path"),
        F.sum("n_children").alias("n_closed"), F.sum("n_leaves").alias("closed_leaves"), F.sum("saved_tokens").alias("closed_saved"),
    ), "open-sums")
    open_children = summed.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_open"))
    n_children = F.col("n_closed") + F.coalesce("n_open", F.lit(0))
    own = staged(summed.join(open_children, "key", "left").withColumns({
        "n_children": n_children,
        "own_leaves": F.when(n_children == 0, 1).otherwise(F.col("closed_leaves")),
        "own_saved": (F.col("n_convs") - 1) * F.col("last_chars") + F.col("closed_saved"),
    }).drop("n_open"), "open-nodes")
    # A depth stands once on each open path that has it.
    stands = parts.filter("last_chars is not null").select("key", "open_path")
    placed = stands.join(own.select("key", "depth", "first_path", "own_leaves", "own_saved"), "key")
    below = Window.partitionBy("open_path").orderBy(F.desc("depth"))
    is_first = F.col("open_path") == F.col("first_path")
    adds = placed.select(
        "key",
        F.sum(F.when(is_first, F.col("own_leaves")).otherwise(0)).over(below).alias("leaves"),
        F.sum(F.when(is_first, F.col("own_saved")).otherwise(0)).over(below).alias("saved"),
    )
    totals = adds.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    kept = own.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children")
    ends = pieces.filter("kind = 2").select("key", "first_id", "ids").repartition("key").sortWithinPartitions("key", "first_id")
    hashed = ends.mapInArrow(_hash_members, "key binary, ends_sha256 string")
    return kept.join(totals, "key").join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))


def prefix_nodes(conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    of every distinct prefix of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns go by ``turn``, nulls first; equal ones by role's and text's hash. Repeated rows are
    turns of their own. A null role or text is empty. Rows without conv_id belong to no
    conversation. An empty table has no node, not even a root. Other columns are left out.
    """
    rebuilt = staged(paths(conversations), "conversation-paths")
    turns = rebuilt.agg(F.sum(F.size("chars"))).first()[0] or 0
    begins = F.expr(f"substring(path, 1, {RANGE_TURNS * TURN_BYTES})")
    dealt = rebuilt.withColumn("begins", begins).repartitionByRange(max(1, -(-turns // task_turns)), "begins", "conv_id")
    ordered = dealt.sortWithinPartitions("begins", "path", "conv_id").select("conv_id", "path", "chars")
    pieces = staged(ordered.mapInArrow(_grow, PIECE), "trie-pieces")
    opened = staged(_open_nodes(pieces), "open-trie")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_parent"))
    complete = pieces.filter("kind = 0")
    inside = complete.filter("parent_key is null").select(columns)
    hanging = complete.filter("parent_key is not null").drop("parent_conv_id").join(parents, "parent_key")
    on_open = opened.join(parents, "parent_key", "left")
    return inside.unionByName(hanging.withColumnRenamed("open_parent", "parent_conv_id").select(columns)).unionByName(
        on_open.withColumnRenamed("open_parent", "parent_conv_id").select(columns)
    )
