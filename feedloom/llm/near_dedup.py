"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

1. Every text becomes its set of word shingles, a signature and band hashes, in one pass.
   Equal sets are one node from here on.
2. Nodes that share a band hash share a bucket. A bucket's members are compared with the
   bucket's smallest node, then with the member that has most links so far. Buckets whose
   members are all connected by then need nothing more.
3. What is left is compared in blocks, so that no link between different texts is lost and no
   pair is emitted only for sharing a bucket. Nodes that the comparisons so far found akin
   form families: in each, the nodes outside its largest connected part are compared with all,
   first by signature, then on the full sets. Nodes of different families in one bucket are
   compared by signature. Both sides of a comparison are cut into blocks.
4. Every pair is confirmed on the full sets before it counts as a link; connected components
   of the links are the groups.

A pair with similarity s shares a bucket with probability 1 - (1 - s^r)^b, for b bands of r
slots; ``band_rows`` takes the longest bands that miss one pair in a million at most at the
least similarity that counts: 25 of 5 for 0.85, 31 of 4 for 0.80.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from feedloom.llm.common import staged
from feedloom.llm.components import components
from feedloom.llm.shingles import band_hashes, shingles, signatures

SLOTS = 125
#: Pairs at the least similarity that may share no bucket.
MISSED = 1e-6
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Members of a leader's list, or of a block of a bucket, that are compared in one piece.
LIST_ROWS, BLOCK_ROWS = 100, 256
#: Standard deviations of plain MinHash (more of SuperMinHash) under the mean of equal slots at
#: the least similarity that counts, below which a pair is not verified.
DEVIATIONS = 4.5
#: Like PERCENT, for members of one family.
KIN_PERCENT = 60
#: A set is named by its smallest doc_id, or, if it has none or another set has that too, by a
#: hash of its own with this bit.
NO_ID = 1 << 62
CHUNK = 256


def band_rows(percent: int) -> int:
    """Slots in a band."""
    s = percent / 100
    return max(r for r in range(1, SLOTS + 1) if r == 1 or (1 - s**r) ** (SLOTS // r) <= MISSED)


def least_equal_slots(percent: int) -> int:
    """Equal slots below which a pair is not verified."""
    s = percent / 100
    return math.floor(SLOTS * s - DEVIATIONS * math.sqrt(SLOTS * s * (1 - s)))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            yield batch.slice(start, CHUNK)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sign(rows: int):
    bands = SLOTS // rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            sets = [shingles(text) for text in _texts(batch.column("text"))]
            least = signatures(sets, SLOTS)
            short = (least & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                "bands": pa.array(list(band_hashes(least[:, :bands * rows], bands)), pa.list_(pa.int64())),
                "slots": pa.array([row.tobytes() for row in short], pa.binary()),
            })
    return run


SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, set_key string, bands array<bigint>, slots binary"


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _verify_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leader, part, is_member): a leader's text, then its members'."""
    held, whole = None, np.empty(0, np.uint64)
    for batch in _chunks(batches):
        found: list[tuple[int, int, int, int]] = []
        leaders, parts, nodes = (batch.column(c).to_pylist() for c in ("leader", "part", "node"))
        for leader, part, node, text in zip(leaders, parts, nodes, _texts(batch.column("text")), strict=True):
            elements = shingles(text)
            if node == leader:
                held, whole = (leader, part), elements
                continue
            both = _common(whole, elements)
            of = len(whole) + len(elements) - both
            if held == (leader, part) and 100 * both >= KIN_PERCENT * of:
                found.append((leader, node, both, of))
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "both", "of"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, both, of) of the distinct ``pairs`` (leader, node) whose sets are akin: the sizes
    of intersection and union. ``texts``: (node, text).

    A leader's list is cut into parts of about ``LIST_ROWS``, each with a copy of the leader's
    text, so a leader with very many members is spread over tasks.
    """
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    parts = F.floor(F.col("n") / LIST_ROWS) + 1
    cut = pairs.join(sizes, "leader").withColumn("part", F.pmod(F.xxhash64("node"), parts))
    heads = cut.select("leader", "part").distinct().select("leader", "part", F.col("leader").alias("node"))
    wanted = cut.select("leader", "part", "node").union(heads)
    rows = wanted.join(texts, "node").withColumn("_member", F.col("node") != F.col("leader"))
    dealt = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "_member", "node")
    held = dealt.select("leader", "part", "node", "text")
    return staged(held.mapInArrow(_verify_lists, "a bigint, b bigint, both bigint, of bigint"), "akin")


def links_of(akin: DataFrame, percent: int) -> DataFrame:
    return akin.filter(100 * F.col("both") >= percent * F.col("of")).select("a", "b")


def _near(asking: pa.Table, answering: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking row with the places of the answering ones of another label whose slots agree enough."""
    queries, against = (np.frombuffer(b"".join(t.column("slots").to_pylist()), np.uint16).reshape(t.num_rows, -1) for t in (asking, answering))
    labels, own = answering.column("label").to_numpy(), asking.column("label").to_numpy()
    for i, row in enumerate(queries):
        near = ((against == row).sum(axis=1) >= least) & (labels != own[i])
        yield i, np.flatnonzero(near)


def _compare_by_slots(percent: int):
    least = least_equal_slots(percent)

    def run(asking: pa.Table, answering: pa.Table) -> pa.Table:
        left, right = asking.column("node").to_numpy(), answering.column("node").to_numpy()
        pairs = [(int(left[i]), int(x)) for i, at in _near(asking, answering, least) for x in right[at]]
        columns = ([max(p) for p in pairs], [min(p) for p in pairs])
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["leader", "node"])
    return run


def _near_rows(percent: int):
    least = least_equal_slots(percent)

    def run(asking: pa.Table, answering: pa.Table) -> pa.Table:
        """The rows of either side that agree enough with one of the other."""
        wanted, answers = [], np.zeros(answering.num_rows, bool)
        for i, at in _near(asking, answering, least):
            if len(at):
                wanted.append(i)
                answers[at] = True
        sides = (asking.take(pa.array(wanted, pa.int64())), True), (answering.filter(pa.array(answers)), False)
        columns = ["family", "i", "j", "node", "label", "slots"]
        return pa.concat_tables([t.select(columns).append_column("asks", pa.array([x] * t.num_rows, pa.bool_())) for t, x in sides])
    return run


def _compare_by_sets(percent: int):
    least = least_equal_slots(percent)

    def run(asking: pa.Table, answering: pa.Table) -> pa.Table:
        left, right = asking.column("node").to_numpy(), answering.column("node").to_numpy()
        queries, against = ([shingles(t) for t in _texts(x.column("text").combine_chunks())] for x in (asking, answering))
        sizes = np.array([len(x) for x in against])
        links = []
        for i, at in _near(asking, answering, least):
            if len(at):
                own = queries[i]
                place = np.searchsorted(own, theirs := np.concatenate([against[k] for k in at]))
                same = own[np.minimum(place, len(own) - 1)] == theirs
                both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(sizes[at])[:-1]]), dtype=np.int64)
                alike = at[100 * both >= percent * (len(own) + sizes[at] - both)]
                links += [(int(left[i]), int(right[k])) for k in alike]
        return pa.Table.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])
    return run


def labelled(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``members`` (node, ...) with the component of each node in ``links``, or itself, as ``name``."""
    labels = components(links).withColumnRenamed("label", "_label")
    return members.join(labels, "node", "left").withColumn(name, F.coalesce("_label", "node")).drop("_label")


def cells(members: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The couples of blocks to compare: (group, i, j, node, label), rows of block i and of block j.

    In each group of more than one label, the rows outside the largest label ask: they are
    compared with each other and with the rest. Both kinds are cut into blocks of about
    ``BLOCK_ROWS`` rows, numbered along, those that ask first, and each couple of blocks is one
    cell, so a cell has two blocks at most however large its group is.
    """
    sizes = members.groupBy(group, "label").agg(F.count("*").alias("k"))
    open_groups = sizes.groupBy(group).agg(
        F.sum("k").alias("n"), F.count("*").alias("labels"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("largest")
    ).filter("labels > 1 and n > 2")
    blocks = lambda rows: (F.floor(rows / BLOCK_ROWS) + 1).cast("int")
    open_groups = open_groups.select(group, "largest", blocks(F.col("n") - F.col("most")).alias("asking"), blocks(F.col("most")).alias("rest"))
    rows = members.join(staged(open_groups, "open-groups"), group)
    asks, place = F.col("label") != F.col("largest"), F.xxhash64("node")
    block = F.when(asks, F.pmod(place, F.col("asking"))).otherwise(F.col("asking") + F.pmod(place, F.col("rest"))).cast("int")
    rows = rows.withColumn("block", block)
    out = [group, "i", "j", "node", "label"]
    left = rows.filter(asks).withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("asking") + F.col("rest") - 1)))
    right = rows.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("block"), F.col("asking") - 1))))
    return left.select(*out), right.select(*out)


def compare_cells(sides: tuple[DataFrame, DataFrame], group: str, more: DataFrame, function, schema: str) -> DataFrame:
    """``function`` on the two sides of each cell; ``more`` has what it needs by node."""
    key = [group, "i", "j"]
    left, right = (side.join(more, "node") for side in sides)
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own, for the cogroup
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(function, schema)


def compare_in_families(families: DataFrame, slots: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside families. Cells get the slots of all their rows; texts are fetched
    only for the rows that are near to another one of their cell."""
    found = compare_cells(
        cells(families, "family"), "family", slots, _near_rows(percent),
        "family bigint, i int, j int, node bigint, label bigint, slots binary, asks boolean",
    )
    found = staged(found, "near-rows")
    sides = tuple(found.filter(side).drop("asks") for side in ("asks", "not asks"))
    return compare_cells(sides, "family", texts, _compare_by_sets(percent), "a bigint, b bigint")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and link with nothing: such a row is its own
    component. Equal texts are linked. ``component_id`` is the smallest id that is not null;
    a row with a null id is linked by its text, is never kept, and has a null component if
    all of it is null. Repeated rows come back as often as given. Other columns are left
    out; an empty table gives an empty one.
    """
    return grouped(docs, percent).drop("text_hash")


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with the row of the smallest id of each group.

    Of repeated rows one stays. Rows with a null id stay if their group has no id at all.
    """
    kept = grouped(docs, percent).filter("kept or component_id is null")
    kept = kept.select(F.col("doc_id").alias("_id"), F.coalesce("text_hash", F.lit(0)).alias("_hash")).distinct()
    held = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    return held.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).select("_row.*")


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``groups`` with each row's ``text_hash``."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = staged(docs.mapInArrow(_sign(band_rows(percent)), SIGNED), "signed")
    whole = signed.filter("set_key is not null")
    fallback = F.shiftrightunsigned(F.xxhash64("set_key"), 2).bitwiseOR(F.lit(NO_ID))
    sets = whole.groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    own_id = sets.groupBy("first_id").agg(F.count("*").alias("n")).filter("first_id is not null and n = 1")
    sets = sets.join(own_id, "first_id", "left")
    sets = sets.select("set_key", "first_id", F.when(F.col("n") == 1, F.col("first_id")).otherwise(fallback).alias("node"))
    # Read from a table, it has no aggregate below its joins, and a large group of copies can be split.
    sets = staged(sets, "sets")
    rows = staged(whole.select("doc_id", "text_hash", "n_shingles", "set_key").join(sets, "set_key").drop("set_key"), "rows")

    of_set = (F.col("set_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    heads = whole.join(sets.withColumnRenamed("set_key", "_key"), of_set).dropDuplicates(["node"])
    nodes = staged(heads.select("node", "first_id", "text_hash", "bands", "slots"), "nodes")

    placed = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    placed = placed.select("node", F.xxhash64("band", "hash").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    members = staged(placed.join(shared.filter("leader <> last").drop("last"), "bucket"), "members")

    # The texts of all nodes that share a bucket; equal ids with other texts fall out.
    sharing = members.select("node").distinct().join(nodes.select("node", "first_id", "text_hash"), "node")
    of_node = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("own.text_hash") == F.col("sharing.text_hash"))
    texts = staged(docs.alias("own").join(sharing.alias("sharing"), of_node).select("node", "text"), "texts")

    first = members.filter("node <> leader").select("leader", "node").distinct()
    akin = verified(first, texts)

    # The member with most links leads next, where a bucket has members that were not compared.
    links = links_of(akin, percent)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    rank = F.struct(F.coalesce("links", F.lit(0)).alias("links"), "node")
    hubs = members.join(degree, "node", "left").groupBy("bucket").agg(F.max(rank).alias("hub"), F.count("*").alias("n"))
    hubs = hubs.filter("n > 2").select("bucket", F.col("hub.node").alias("hub"))
    second = members.join(hubs, "bucket").filter("hub not in (leader, node)").select(F.col("hub").alias("leader"), "node")
    second = second.distinct().join(first, ["leader", "node"], "left_anti")
    akin = akin.union(verified(second, texts))

    # What is left: inside families on the full sets, across families first by signature.
    links = links_of(akin, percent)
    families = labelled(labelled(nodes.select("node"), akin.select("a", "b"), "family"), links, "label")
    families = staged(families, "families")
    slots = nodes.select("node", "slots")
    inside = compare_in_families(families, slots, texts, percent)
    links = links.union(staged(inside, "links"))
    placed = members.select("bucket", "node").join(families.select("node", F.col("family").alias("label")), "node")
    across = compare_cells(cells(placed, "bucket"), "bucket", slots, _compare_by_slots(percent), "leader bigint, node bigint").distinct()
    links = links.union(links_of(verified(across, texts), percent))

    labels = components(links)
    in_sets = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = in_sets.groupBy("label").agg(F.min("first_id").alias("component_id"))
    columns = ["doc_id", "text_hash", "n_shingles"]
    alone = signed.filter("set_key is null").select(*columns, F.col("doc_id").alias("component_id"))
    out = in_sets.join(least, "label").select(*columns, "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
