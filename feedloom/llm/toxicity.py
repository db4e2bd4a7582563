"""A convolutional text classifier for toxicity, trained in numpy.

Words and their beginnings are hashed into two embedding tables; filters over one, two and
three neighbouring words, max pooling over the whole text (the three greatest responses of each
filter, so that one chance hit and several hits differ), and a logistic output. It is
trained on all labelled texts and then scores every whole text in the scan. Language, source
and ids are no inputs. For each language a threshold is calibrated on every eighth labelled
text, which the training doesn't see.

The labelled texts are dealt by the hash of their id into parts of bounded size. The first
part gives the start; then, round by round, every part goes through its texts from the model
that all share, and their changes are averaged: of a weight, over the parts that change it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from feedloom.llm.common import staged
from feedloom.operators.joins import batch_join

#: Bytes of labelled text in a part, about; passes of all parts after the start, if there are several.
PART_BYTES, ROUNDS = 8 << 20, 2
#: Weights that are averaged in one group.
BLOCK = 1 << 13
#: One labelled text in so many is for the thresholds; logits of scores are counted in steps.
CHECKED, LOGIT_STEP = 8, 0.01
#: Labelled ids (12 bytes each) that are broadcast at most.
MAX_IDS = 1_000_000
PACK = "part int, lengths binary, ids binary, marks binary, langs array<string>"
WORD_BUCKETS, STEM_BUCKETS, DIM = 1 << 15, 1 << 13, 16
STEM_BYTES = 5
WIDTHS, FILTERS = (1, 2, 3), 16
#: Greatest responses of a filter that are kept, and zero rows at each end of a text.
TOP, PAD = 3, 3
STEPS, BATCH, RATE, DECAY, DROP = 750, 32, 0.01, 1e-5, 0.2
LEAST_TEXTS = 3
THRESHOLD = 0.7
#: Characters that end a word: all of ASCII but letters and digits.
_LETTERS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
CHUNK = 512


class Model(NamedTuple):
    word_table: np.ndarray
    stem_table: np.ndarray
    kernels: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray


class _Ids(dict):
    """Buckets of words seen before: hashing each word once is enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = xxh3_64_intdigest(word, 1) % WORD_BUCKETS * STEM_BUCKETS + xxh3_64_intdigest(word[:STEM_BYTES], 2) % STEM_BUCKETS
        self[word] = value
        return value


def word_ids(text: bytes, ids: _Ids) -> np.ndarray:
    tokens = text.lower().translate(_LETTERS).split()
    return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))


def embed(model: Model, ids: np.ndarray) -> np.ndarray:
    """Embeddings with zero rows at both ends, so that every filter has TOP places in any text."""
    out = np.zeros((len(ids) + 2 * PAD, DIM), np.float32)
    out[PAD:-PAD] = model.word_table[ids // STEM_BUCKETS] + model.stem_table[ids % STEM_BUCKETS]
    return out


def _pooled(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP greatest responses of each filter, and where they are: (widths * FILTERS, TOP) each."""
    tops, places = [], []
    rows = np.arange(FILTERS)
    for kernel, offset in zip(model.kernels, model.offsets, strict=True):
        n = len(x) - len(kernel) + 1
        response = sum(kernel[k].T @ x[k:k + n].T for k in range(len(kernel)))
        for _ in range(TOP):
            at = response.argmax(axis=1)
            tops.append(response[rows, at] + offset)
            places.append(at)
            response[rows, at] = -np.inf
    shape = (len(WIDTHS), TOP, FILTERS)
    return np.reshape(tops, shape), np.reshape(places, shape)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(model: Model, ids: np.ndarray) -> float:
    top, _ = _pooled(model, embed(model, ids))
    return float(_sigmoid(np.maximum(top, 0).ravel() @ model.weights + model.bias[0]))


SHAPES = [
    (WORD_BUCKETS, DIM), (STEM_BUCKETS, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS],
    (len(WIDTHS) * TOP * FILTERS,), (1,),
]


def weights_of(model: Model) -> list[np.ndarray]:
    return [model.word_table, model.stem_table, *model.kernels, *model.offsets, model.weights, model.bias]


def model_of(flat: np.ndarray) -> Model:
    ends = np.cumsum([np.prod(shape) for shape in SHAPES])
    w = [x.astype(np.float32).reshape(shape) for x, shape in zip(np.split(flat, ends[:-1]), SHAPES, strict=True)]
    n = len(WIDTHS)
    return Model(w[0], w[1], w[2:2 + n], w[2 + n:2 + 2 * n], w[-2], w[-1])


def flat_of(model: Model) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights_of(model)])


def bucket_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each bucket of words, and of beginnings, in how many texts it is."""
    known = [np.zeros(WORD_BUCKETS, np.int64), np.zeros(STEM_BUCKETS, np.int64)]
    for ids in texts:
        known[0][np.unique(ids // STEM_BUCKETS)] += 1
        known[1][np.unique(ids % STEM_BUCKETS)] += 1
    return known


def first_model(rng: np.random.Generator, known: list[np.ndarray]) -> Model:
    start = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    model = Model(
        start(WORD_BUCKETS, DIM), start(STEM_BUCKETS, DIM), [start(w, DIM, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], start(len(WIDTHS) * TOP * FILTERS), np.zeros(1, np.float32),
    )
    for rows, n in zip(model[:2], known, strict=True):
        rows *= (n >= LEAST_TEXTS)[:, None]
    return model


def train(
    model: Model, texts: list[np.ndarray], labels: np.ndarray, known: list[np.ndarray], rng: np.random.Generator, steps: int = STEPS
) -> Model:
    """Adam on the logistic loss, with random words left out; gradients pass through the
    places of the maxima alone. Changes ``model``, in whole passes of ``steps`` steps or more."""
    # Only what several texts have can be learned; all else stays at zero, as unseen words do.
    seen = [(n >= LEAST_TEXTS).astype(np.float32)[:, None] for n in known]
    held = weights_of(model)
    first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    step = 0
    batches = max(1, len(texts) // BATCH)
    for _ in range(-(-steps // batches)):
        for batch in np.array_split(rng.permutation(len(texts)), batches):
            grads = [np.zeros_like(p) for p in held]
            for i in batch:
                ids = texts[i][rng.random(len(texts[i])) > DROP]
                x = embed(model, ids)
                top, places = _pooled(model, x)
                hidden = np.maximum(top, 0).ravel()
                error = np.float32((_sigmoid(hidden @ model.weights + model.bias[0]) - labels[i]) / len(batch))
                grads[-1] += error
                grads[-2] += error * hidden
                back = (error * model.weights).reshape(top.shape) * (top > 0)
                for w, kernel in enumerate(model.kernels):
                    grads[2 + len(WIDTHS) + w] += back[w].sum(axis=0)
                    for g, at in zip(back[w], places[w], strict=True):
                        for k in range(len(kernel)):
                            grads[2 + w][k] += x[at + k].T * g
                            inside = (at + k >= PAD) & (at + k < len(x) - PAD)
                            rows, change = ids[at[inside] + k - PAD], (kernel[k] * g).T[inside]
                            np.add.at(grads[0], rows // STEM_BUCKETS, change)
                            np.add.at(grads[1], rows % STEM_BUCKETS, change)
            grads[0] *= seen[0]
            grads[1] *= seen[1]
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(held, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8) + RATE * DECAY * p).astype(np.float32)
    return model


def calibrated(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The threshold with the best F1 measure, in the middle of its gap; THRESHOLD without both classes.

    Scores come in groups, from the highest on: least and greatest score, texts and toxic ones.
    """
    if not 0 < hits.sum() < n.sum():
        return THRESHOLD
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    k = int(np.argmax(f1))
    below = high[k + 1] if k + 1 < len(high) else 0.0
    return float((low[k] + below) / 2)


def labelled_texts(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """(doc_id, text, lang, toxic) of all allowed documents with a label and a text, the text as bytes."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("text"), "lang")
    return batch_join(texts, marked, "doc_id", "inner", MAX_IDS)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """The texts of a part as word ids, in the order of their doc_id; a repeated id counts once."""
    rows = rows.sort_values(["doc_id", "text", "lang"]).drop_duplicates("doc_id")
    cache = _Ids()
    ids = [word_ids(t, cache).astype(np.int32) for t in rows["text"]]
    return pd.DataFrame({
        "part": rows["part"].iloc[:1].to_numpy(), "lengths": [np.array([len(x) for x in ids], np.int32).tobytes()],
        "ids": [b"".join(x.tobytes() for x in ids)], "marks": [rows["toxic"].to_numpy(np.uint8).tobytes()],
        "langs": [[x if isinstance(x, str) else None for x in rows["lang"]]],
    })


class Part(NamedTuple):
    number: int
    texts: list[np.ndarray]
    labels: np.ndarray
    langs: list[str | None]
    check: np.ndarray

    def to_learn(self) -> tuple[list[np.ndarray], np.ndarray]:
        return [t for t, c in zip(self.texts, self.check, strict=True) if not c], self.labels[~self.check]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            ends = np.cumsum(np.frombuffer(row["lengths"], np.int32))
            texts = np.split(np.frombuffer(row["ids"], np.int32).astype(np.int64), ends[:-1])
            labels = np.frombuffer(row["marks"], np.uint8).astype(np.float32)
            yield Part(row["part"], texts, labels, row["langs"], np.arange(len(texts)) % CHECKED == 0)


def _blocks(part: int, values: np.ndarray) -> pa.RecordBatch:
    pieces = [values[k:k + BLOCK].astype(np.float32).tobytes() for k in range(0, len(values), BLOCK)]
    return pa.RecordBatch.from_pydict({
        "block": pa.array(range(len(pieces)), pa.int32()), "part": pa.array([part] * len(pieces), pa.int32()), "data": pa.array(pieces, pa.binary()),
    })


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of a block over the parts, in their order, and how many parts have a value other than 0."""
    rows = rows.sort_values("part")
    total = given = 0
    for data in rows["data"]:
        values = np.frombuffer(data, np.float32)
        total, given = total + values.astype(np.float64), given + (values != 0)
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "total": [total.tobytes()], "given": [given.astype(np.int64).tobytes()]})


def _summed(packs: DataFrame, each: Callable[[Part], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``each`` (vectors of one length) over all parts, and by how many parts each place is set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield _blocks(part.number, each(part))

    sums = packs.mapInArrow(run, "block int, part int, data binary").groupBy("block").applyInPandas(_add, "block int, total binary, given binary")
    rows = sorted(sums.collect(), key=lambda r: r["block"])  # as long as one model, whatever the number of texts
    return np.concatenate([np.frombuffer(r["total"]) for r in rows]), np.concatenate([np.frombuffer(r["given"], np.int64) for r in rows])


def learned(packs: DataFrame) -> Model:
    """The model of all texts of ``packs``; the same whatever tasks the parts are in."""
    context = packs.sparkSession.sparkContext
    counts, _ = _summed(packs, lambda part: np.concatenate(bucket_counts(part.to_learn()[0])))
    known = np.split(counts, [WORD_BUCKETS])
    first, last = packs.agg(F.min("part"), F.max("part")).first()

    def begin(part: Part) -> np.ndarray:
        rng = np.random.default_rng(5)
        return flat_of(train(first_model(rng, known), *part.to_learn(), known, rng))

    flat, _ = _summed(packs.filter(F.col("part") == first), begin)
    for turn in range(ROUNDS if last > first else 0):
        shared = context.broadcast(flat.astype(np.float32))

        def change(part: Part, shared=shared, turn=turn) -> np.ndarray:
            texts, labels = part.to_learn()
            model = train(model_of(shared.value), texts, labels, known, np.random.default_rng([5, turn, part.number]), steps=1)
            old = model_of(shared.value)
            for now, before, n in zip(model[:2], old[:2], bucket_counts(texts), strict=True):
                now[n == 0] = before[n == 0]
            return flat_of(model) - shared.value

        total, given = _summed(packs, change)
        flat = flat + total / np.maximum(given, 1)
        shared.unpersist()
    return model_of(flat)


def language_thresholds(packs: DataFrame, model: Model) -> dict[str, float]:
    """Of each language, by the scores of the texts that ``model`` has not seen."""
    shared = packs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for part in _parts(batches):
            at = np.flatnonzero(part.check)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([part.langs[i] for i in at], pa.string()), "toxic": pa.array([int(part.labels[i]) for i in at], pa.int32()),
                "score": pa.array([score(held, part.texts[i]) for i in at], pa.float64()),
            })

    scored = packs.mapInArrow(run, "lang string, toxic int, score double").filter("lang is not null")
    inside = F.least(F.greatest("score", F.lit(1e-13)), F.lit(1 - 1e-13))
    step = F.floor(F.log(inside / (1 - inside)) / LOGIT_STEP)
    bins = scored.groupBy("lang", step.alias("step")).agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    table = bins.toPandas().sort_values(["lang", "step"], ascending=[True, False])  # 6,001 rows of a language at most
    return {x: calibrated(*[g[c].to_numpy() for c in ("low", "high", "n", "hits")]) for x, g in table.groupby("lang")}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, flagged) of every row of ``docs``.

    ``docs``: (doc_id, text, lang); ``labels``: (doc_id, toxic). All labels are learned from
    but those of held-out ids, which are never read. A null text counts as empty; an empty
    text has a score too, that of no words. A null id is not held out. A document with several
    labels is toxic if one says so; labels other than 0 and 1 don't count. Without labels of
    both classes the score is 0 for all. Repeated rows come back as often as given. Other
    columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang")
    texts = labelled_texts(docs, labels, ~held_out(F.col("doc_id")))
    size, low, high = texts.agg(F.sum(F.octet_length("text")), F.min("toxic"), F.max("toxic")).first()
    model, thresholds = None, {}
    if low != high:
        parts = max(1, -(-size // part_bytes))
        dealt = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(parts, "part")
        packs = staged(dealt.groupBy("part").applyInPandas(_pack, PACK), "labelled-texts")
        model = learned(packs)
        thresholds = language_thresholds(packs, model)
    shared = spark.sparkContext.broadcast(model and tuple(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = _Ids(), shared.value and Model(*shared.value)
        for whole in batches:
            for batch in (whole.slice(k, CHUNK) for k in range(0, whole.num_rows, CHUNK)):
                rows = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                scores = [score(held, word_ids(t, cache)) if held else 0.0 for t in rows]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "score": pa.array(scores, pa.float64()),
                })

    scored = docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id bigint, lang string, score double")
    pairs = [F.lit(x) for item in thresholds.items() for x in item]
    of_lang = F.coalesce(F.create_map(*pairs)[F.col("lang")], F.lit(THRESHOLD)) if pairs else F.lit(THRESHOLD)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        of_lang.alias("lang_threshold"), (F.col("score") >= of_lang).alias("flagged"),
    )
