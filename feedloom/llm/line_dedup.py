"""Line duplicates across documents, by pairwise patience alignment.

1. Every line gets a hash, and so do runs of lines: from each line the shortest run on, and
   back, that has enough words to be deleted. Every line of a block that two documents share
   is in such a run of the block. A run that stands in several documents proposes pairs: each
   later document with the run's first document, whatever the number of holders, and, while
   the run is rare, with every earlier holder too. A very common run so makes one pair for each
   of its documents, not one for each two of them.
2. The two documents of a pair are aligned by patience diff on their line hashes.
3. A run of aligned lines with enough words is deleted from the later document.

A line's first document never loses that line, so nothing disappears from all documents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import SPACES, staged
from feedloom.llm.shingles import mix

#: Words that a run of lines needs to propose pairs, and a run of aligned lines to be deleted.
LEAST_BLOCK_WORDS = 30
#: Holders up to which a run is rare.
RARE_HOLDERS = 6
_BASE = 0x9E3779B97F4A7C15


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hashes, sizes): line hashes and word counts of each row with an id."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    held = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    size: Column = F.transform("lines", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, SPACES))))
    return held.select("doc_id", "text_hash", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), size.alias("sizes"))


def run_hashes(hashes: list[int], sizes: list[int], least_words: int) -> np.ndarray:
    """Distinct hashes of the shortest runs of ``least_words`` or more from and up to each line."""
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    starts, stops = np.arange(n), np.searchsorted(total, total[:-1] + least_words)
    onward = np.stack([starts, stops], axis=1)[stops <= n]
    starts, stops = np.searchsorted(total, total[1:] - least_words, "right") - 1, np.arange(1, n + 1)
    first, past = np.concatenate([onward, np.stack([starts, stops], axis=1)[starts >= 0]]).T
    # The sum of hash * base^place over a run, moved to place 0; all of it modulo 2^64.
    powers, back = (np.multiply.accumulate(np.array([1, *[x] * n], np.uint64)) for x in (_BASE, pow(_BASE, -1, 2**64)))
    terms = mix(np.array(hashes, np.int64).view(np.uint64)) * powers[:n]
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(terms)])
    return np.unique(mix((sums[past] - sums[first]) * back[first] + (past - first).astype(np.uint64)).view(np.int64))


def _run_rows(least_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = zip(batch.column("hashes").to_pylist(), batch.column("sizes").to_pylist(), strict=True)
            runs = [run_hashes(hashes, sizes, least_words) for hashes, sizes in lines]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "runs": pa.array(runs, pa.list_(pa.int64())),
            })
    return run


def overlapping(seqs: DataFrame, least_words: int = LEAST_BLOCK_WORDS) -> DataFrame:
    """Distinct (earlier, doc_id, text_hash) of documents that share a run of lines, as in step 1."""
    runs = seqs.mapInArrow(_run_rows(least_words), "doc_id bigint, text_hash bigint, runs array<bigint>")
    lines = staged(runs, "runs").select("doc_id", "text_hash", F.explode("runs").alias("hash"))
    shared = lines.groupBy("hash").agg(
        F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last"), F.count("*").alias("holders")
    ).filter("earlier < last")
    # Read from a table, the join has no aggregate below it, and a very common run can be split.
    shared = staged(shared, "shared-runs")
    held = lines.join(shared.drop("last"), "hash").filter("doc_id > earlier")
    rare = held.filter(F.col("holders") <= RARE_HOLDERS)
    others = rare.select("hash", F.col("doc_id").alias("earlier")).distinct()
    between = rare.drop("earlier").join(others, "hash").filter("doc_id > earlier")
    columns = ["earlier", "doc_id", "text_hash"]
    return held.select(columns).union(between.select(columns)).distinct()


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (rising in the first place) that rises in the second too."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1], ends[at:at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _anchors(a: list[int], b: list[int], i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Lines that are unique in both parts, in the longest common order; where there is none,
    the n-th copy of a line goes with its n-th copy on the other side."""
    left, right = Counter(a[i0:i1]), Counter(b[j0:j1])
    place = {x: j for j, x in enumerate(b[j0:j1], j0) if right[x] == 1}
    unique = [(i, place[x]) for i, x in enumerate(a[i0:i1], i0) if left[x] == 1 and x in place]
    if unique:
        return _rising(unique)
    seen: Counter[int] = Counter()
    nth = {}
    for j in range(j0, j1):
        nth[b[j], seen[b[j]]] = j
        seen[b[j]] += 1
    seen.clear()
    copies = []
    for i in range(i0, i1):
        if (a[i], seen[a[i]]) in nth:
            copies.append((i, nth[a[i], seen[a[i]]]))
        seen[a[i]] += 1
    return _rising(copies)


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of positions of equal lines, rising on both sides."""
    out: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        found = _anchors(a, b, i0, i1, j0, j1)
        out += found
        for (p, q), (r, s) in zip([(i0 - 1, j0 - 1), *found], [*found, (i1, j1)], strict=True):
            if found and p + 1 < r and q + 1 < s:
                parts.append((p + 1, r, q + 1, s))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], sizes: list[int], least_words: int) -> list[tuple[int, int]]:
    """Ranges of lines of ``b``, both ends included, whose aligned run has ``least_words`` or more."""
    out = []
    run: list[tuple[int, int]] = []
    for pair in [*align(a, b), (-9, -9)]:
        if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(sizes[run[0][1]:run[-1][1] + 1]) >= least_words:
                out.append((run[0][1], run[-1][1]))
            run = []
        run.append(pair)
    return out


def _align_rows(least_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            rows = {"doc_id": [], "text_hash": [], "start": [], "stop": []}
            for doc, text_hash, before, hashes, sizes in zip(
                columns["doc_id"], columns["text_hash"], columns["before"], columns["hashes"], columns["sizes"], strict=True
            ):
                for start, stop in common_blocks(before, hashes, sizes, least_words):
                    for name, value in zip(rows, (doc, text_hash, start, stop), strict=True):
                        rows[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})
    return run


def repeated_blocks(docs: DataFrame, least_words: int = LEAST_BLOCK_WORDS) -> DataFrame:
    """(doc_id, text_hash, blocks) of documents that lose lines; blocks: array of (start, stop)."""
    seqs = staged(sequences(docs), "lines")
    pairs = overlapping(seqs, least_words)
    first = seqs.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("before"))
    aligned = pairs.join(first, "earlier").join(seqs, ["doc_id", "text_hash"])
    found = aligned.select("doc_id", "text_hash", "before", "hashes", "sizes").mapInArrow(
        _align_rows(least_words), "doc_id bigint, text_hash bigint, start int, stop int"
    )
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("blocks"))


def drop_repeated_lines(docs: DataFrame, least_words: int = LEAST_BLOCK_WORDS) -> DataFrame:
    """``docs`` without the lines that earlier documents have, and with ``n_deleted_lines``.

    Earlier is the smaller doc_id. A row with a null id or text has no place in that order and
    stays as it is. Rows with equal ids are not compared with each other; each is cleaned by
    its own text, so repeated rows stay repeated. All other columns are kept as they are; one
    named like the new column gives way. A text whose lines all go becomes empty.
    """
    kept = [c for c in docs.columns if c != "n_deleted_lines"]
    lost = repeated_blocks(docs, least_words).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), F.col("blocks").alias("_blocks")
    )
    held = docs.select(F.struct(*kept).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_own_hash"))
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.col("_own_hash") == F.col("_text_hash"))
    joined = held.join(lost, same, "left").withColumn("_lines", F.split("text", "\n"))
    stays = F.filter("_lines", lambda _, i: ~F.exists("_blocks", lambda b: i.between(b["start"], b["stop"])))
    joined = joined.withColumn("_stays", F.when(F.col("_blocks").isNotNull(), stays))
    text = F.when(F.col("_stays").isNull(), F.col("text")).otherwise(F.array_join("_stays", "\n"))
    deleted = F.coalesce(F.size("_lines") - F.size("_stays"), F.lit(0)).cast("long")
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in kept], deleted.alias("n_deleted_lines"))
