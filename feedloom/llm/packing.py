"""Training sequences in length buckets with least padding, and token-budget batches.

1. A text's words are its tokens; a text longer than the sequence length becomes several
   sequences. Spark counts the sequences of each length: the histogram has at most as many
   entries as the sequence length, however large the corpus.
2. Dynamic programming over that histogram finds the bucket boundaries with the least padding
   of all sets of as many boundaries.
3. A batch of a bucket holds as many sequences as fit the token budget at the bucket's
   length. Sequences are numbered in their bucket through counts, see ``gapless_rank``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import gapless_rank, let, staged, words

MAX_TOKENS, N_BUCKETS, BATCH_TOKENS = 2048, 16, 16384


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that pad ``counts`` sequences of ``lengths``
    (rising, distinct) least; of equal solutions one with fewer buckets."""
    n = len(lengths)
    if not n:
        return []
    ends = np.asarray(lengths, np.int64)
    total = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    tokens = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64) * ends)])
    least = ends[np.arange(n)] * total[1:] - tokens[1:]  # one bucket over the first j lengths
    cuts = [np.zeros(n, np.int64)]
    best_k, best = 1, least[-1]
    for k in range(2, min(buckets, n) + 1):
        now, cut = least.copy(), np.full(n, -1, np.int64)
        for j in range(k - 1, n):
            # The last bucket holds lengths i+1 .. j, the first i+1 are padded as before.
            costs = least[:j] + ends[j] * (total[j + 1] - total[1:j + 1]) - (tokens[j + 1] - tokens[1:j + 1])
            i = int(np.argmin(costs))
            if costs[i] < now[j]:
                now[j], cut[j] = costs[i], i
        least = now
        cuts.append(cut)
        if least[-1] < best:
            best_k, best = k, least[-1]
    out, j = [], n - 1
    for cut in reversed(cuts[:best_k]):
        out.append(int(ends[j]))
        if cut is cuts[0]:
            break
        if cut[j] >= 0:
            j = int(cut[j])
        else:
            out.pop()
    return out[::-1]


def sequences(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, text_hash, chunk, first_token, n_tokens): the sequences of each row, in order."""
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.size(words(F.col("text"))), F.lit(0)).alias("n"))
    cut = counted.filter("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / max_tokens).cast("int"))).alias("chunk"))
    first = F.col("chunk") * max_tokens
    return cut.select(
        "doc_id", "text_hash", "chunk", first.alias("first_token"), F.least(F.col("n") - first, F.lit(max_tokens)).alias("n_tokens")
    )


def with_texts(packed: DataFrame, docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``packed`` with each sequence's ``text``. A text that is cut keeps its white space: that
    after a word goes with the word, that before the first is dropped. A text is cut once into
    all of its sequences."""
    def cut(word_by_word: Column) -> Column:
        last = F.floor((F.size(word_by_word) - 1) / max_tokens).cast("int")
        several = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(word_by_word, i * max_tokens + 1, F.lit(max_tokens)), ""))
        return F.when(F.size(word_by_word) < max_tokens, F.array(F.col("_text"))).otherwise(several)

    texts = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.any_value("text").alias("_text"))
    word_by_word = F.split(F.ltrim("_text", F.lit(" \t\n\x0b\x0c\r")), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    chunks = texts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.posexplode(let(word_by_word, cut)).alias("_chunk", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("chunk") == F.col("_chunk"))
    return packed.join(chunks, same).drop("_id", "_hash", "_chunk")


def pack(
    docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS, texts: bool = False,
) -> DataFrame:
    """(doc_id, chunk, first_token, n_tokens, bucket_tokens, batch, slot) of every sequence of
    ``docs`` (doc_id, text), with ``text`` if wanted.

    ``batch`` counts from 0 in its bucket, ``slot`` from 0 in its batch; only a bucket's last
    batch may have free slots. Null and empty texts, and texts of white space, have no
    sequence. Rows with equal or null ids, and repeated rows, are packed row by row. Other
    columns are left out; an empty table gives an empty one.
    """
    if batch_tokens < max_tokens:
        raise ValueError("a batch must have room for one sequence")
    cut = staged(sequences(docs, max_tokens), "sequences")
    counts = sorted((r["n_tokens"], r["n"]) for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    ends = boundaries([x for x, _ in counts], [n for _, n in counts], buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= end, end) for end in ends], F.lit(max_tokens))
    ranked = gapless_rank(cut.withColumn("bucket_tokens", bucket), ["bucket_tokens"], "rank")
    per_batch = F.floor(F.lit(batch_tokens) / F.col("bucket_tokens"))
    placed = ranked.withColumns({
        "batch": F.floor(F.col("rank") / per_batch), "slot": F.pmod(F.col("rank"), per_batch),
    }).drop("rank")
    if texts:
        placed = with_texts(placed, docs.select("doc_id", "text"), max_tokens)
    return placed.drop("text_hash")
