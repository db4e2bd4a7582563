"""Byte-level BPE through a table of distinct words.

1. Spark cuts every text into words at places where the tokenizer's own cutting has a border
   whatever stands around them, see ``WORD``. A word is thus encoded alone as it is inside
   its text, also in a script that the tokenizer and Java class differently.
2. Texts are gathered to batches of bounded size. A batch keeps each text as the sequence of
   its words' numbers, frequent words first. Its distinct words leave it once, however often
   they stand there, in one packed row for each part of the word table.
3. The word table is dealt to parts by the word's hash. Each distinct word of the corpus is in
   one part and is encoded there once; the ids go back to the batches in the packs' order. A
   word that all texts share adds one entry per batch.
4. Each batch joins the ids with its sequences by position. Decoding joins ids with the
   tokenizer's id-to-piece table, which is as large as the vocabulary and goes to every task.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import staged

#: Bytes of text in a batch; a longer text is a batch of its own.
BATCH_BYTES = 16 << 20
#: Bytes of the corpus for each part of the word table.
PART_BYTES = 16 << 20
#: Words that the tokenizer gets at once, and words that are put together at once.
CALL_WORDS, JOIN_WORDS = 4096, 1 << 16
ZSTD_LEVEL = 9
#: The words of a text, white space included, one after the other. Every border is one of the
#: tokenizer's own cutting whatever follows: a blank goes with what comes after it, a run of
#: white space before something else ends before its last character, and a run of letters ends
#: at ASCII punctuation. All else up to the next white space stays together, so scripts that the
#: tokenizer and Java class differently, and added tokens, are left to the tokenizer. White space
#: that may stand before an added token stays with it, since the tokenizer cuts there first.
WORD = r"\x20?\p{L}++(?=[!-/:-@\[-`{-~])|\x20?\S++|\s+(?!\S)|\s+"
#: A batch's row has part -1; its packs of words have the part of the word table.
CUT = "batch bigint, part int, doc_ids array<bigint>, n_words array<int>, numbers binary, parts binary, words binary"


def word_pattern(tokenizer_json: str) -> str:
    """``WORD`` for a tokenizer; refuse one whose added tokens it might cut, or take in neighbours."""
    tokens = json.loads(tokenizer_json)["added_tokens"]
    for token in tokens:
        content = token["content"]
        if content[0] not in string.punctuation or content.split() != [content] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"words cannot be encoded apart with the added token {content!r}")
    begins = "".join(sorted({re.escape(t["content"][0]) for t in tokens}))
    return rf"(?U)\s++(?=[{begins}])\S++|{WORD}" if begins else f"(?U){WORD}"


def text_words(text: Column, pattern: str) -> Column:
    """The words of a text: joined they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)


def _places(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def _squeeze(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), ZSTD_LEVEL)


def _spread(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def _number_bytes(numbers: np.ndarray) -> bytes:
    sizes = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        has = sizes > k
        out[starts[has] + k] = ((numbers[has] >> 7 * k) & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out.tobytes()


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^28, seven bits a byte, the lowest first; all but the last byte have bit 7."""
    pieces = [_number_bytes(numbers[i:i + JOIN_WORDS]) for i in range(0, len(numbers), JOIN_WORDS)]
    return zstandard.compress(b"".join(pieces), ZSTD_LEVEL)


def unpack_numbers(packed: bytes) -> np.ndarray:
    out = _spread(packed, np.uint8)
    ends = np.flatnonzero(out < 128)
    numbers = np.zeros(len(ends), np.int32)
    for i in range(0, len(ends), JOIN_WORDS):
        last = ends[i:i + JOIN_WORDS]
        first = np.concatenate([[ends[i - 1] + 1 if i else 0], last[:-1] + 1])
        for k in range(4):
            has = first + k <= last
            numbers[i:i + JOIN_WORDS][has] |= (out[first[has] + k] & 127).astype(np.int32) << 7 * k
    return numbers


def pack_lists(sizes: np.ndarray, body: bytes) -> bytes:
    """Several byte strings, or lists of numbers, one after the other."""
    head = np.concatenate([[len(sizes)], sizes]).astype("<u4")
    return zstandard.compress(head.tobytes() + body, ZSTD_LEVEL)


def unpack_lists(packed: bytes) -> tuple[np.ndarray, bytes]:
    whole = zstandard.decompress(packed)
    n = int(np.frombuffer(whole, "<u4", 1)[0])
    return np.frombuffer(whole, "<u4", n, 4).astype(np.int64), whole[4 * n + 4:]


def _batch_rows(batch: int, doc_ids: list[pa.Array], texts: list[pa.Array], parts: int) -> pa.RecordBatch:
    lists = pa.concat_arrays(texts)
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(numbers, minlength=len(coded.dictionary))
    # Words of one count stand in their own order: their packs are smaller so.
    by_count = np.lexsort((_places(pc.array_sort_indices(coded.dictionary).to_numpy()), -counts))
    rank = _places(by_count)
    words = [w.encode() for w in coded.dictionary.take(pa.array(by_count)).to_pylist()]
    part_of = np.array([crc32(w) % parts for w in words], np.int64)
    order = np.argsort(part_of, kind="stable")
    held, starts = np.unique(part_of[order], return_index=True)
    packs = []
    for mine in np.split(order, starts[1:]) if len(held) else []:
        pack = [words[i] for i in mine.tolist()]
        packs.append(pack_lists(np.array([len(w) for w in pack]), b"".join(pack)))
    none = [None] * len(packs)
    return pa.RecordBatch.from_pydict({
        "batch": pa.array([batch] * (1 + len(packs)), pa.int64()),
        "part": pa.array([-1, *held.tolist()], pa.int32()),
        "doc_ids": pa.array([pa.concat_arrays(doc_ids).to_pylist(), *none], pa.list_(pa.int64())),
        "n_words": pa.array([lists.value_lengths().to_pylist(), *none], pa.list_(pa.int32())),
        "numbers": pa.array([pack_numbers(rank[numbers]), *none], pa.binary()),
        "parts": pa.array([_squeeze(part_of.astype("<u4")), *none], pa.binary()),
        "words": pa.array([None, *packs], pa.binary()),
    })


def _batches(batch_bytes: int, parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the texts of a partition into batches, in order."""
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 33
        doc_ids, texts, held = [], [], 0
        for row_batch in rows:
            sizes = np.cumsum(row_batch.column("n_bytes").to_numpy(zero_copy_only=False))
            start = 0
            while start < row_batch.num_rows:
                before = sizes[start - 1] if start else 0
                stop = int(np.searchsorted(sizes, before + batch_bytes - held, side="right"))
                if stop == start and held == 0:
                    stop = start + 1
                if stop > start:
                    doc_ids.append(row_batch.column("doc_id").slice(start, stop - start))
                    texts.append(row_batch.column("words").slice(start, stop - start))
                    held += int(sizes[stop - 1] - before)
                    start = stop
                if start < row_batch.num_rows:
                    yield _batch_rows(batch, doc_ids, texts, parts)
                    batch, doc_ids, texts, held = batch + 1, [], [], 0
                    pa.default_memory_pool().release_unused()
        if texts:
            yield _batch_rows(batch, doc_ids, texts, parts)
    return run


def _encode(tokenizer_json: str, kind: str) -> Callable[[pa.Table], pa.Table]:
    """Encode each distinct word of a part of the word table once, and answer its packs."""
    def run(packs: pa.Table) -> pa.Table:
        # One thread: Spark runs the tasks side by side.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        number: dict[bytes, int] = {}
        asked = []
        for pack in packs.column("words"):
            sizes, body = unpack_lists(pack.as_py())
            ends = np.cumsum(sizes).tolist()
            words = [body[end - size:end] for end, size in zip(ends, sizes.tolist(), strict=True)]
            asked.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
        distinct = list(number)
        ids, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
        for start in range(0, len(distinct), CALL_WORDS):
            texts = [w.decode() for w in distinct[start:start + CALL_WORDS]]
            coded = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
            sizes.append(np.array([len(c) for c in coded], np.int64))
            ids.append(np.fromiter(chain.from_iterable(coded), kind))
        lists = IdLists(np.concatenate(sizes), np.concatenate(ids))
        answers = []
        for mine in asked:
            found, held = lists.take(mine)
            answers.append(pack_lists(held, found.tobytes()))
        return pa.table({"asked_by": packs.column("batch"), "part": packs.column("part"), "ids": pa.array(answers, pa.binary())})
    return run


def byte_alphabet() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary: printable Latin-1
    stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def id_pieces(tokenizer_json: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer, added tokens included; unused ids have none."""
    about, alphabet = json.loads(tokenizer_json), byte_alphabet()
    pieces = {i: bytes(alphabet[c] for c in piece) for piece, i in about["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in about["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


class IdLists:
    """The ids of numbered words, one list after the other."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.sizes, self.starts, self.ids = sizes, np.cumsum(sizes) - sizes, ids

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of words, and how many each word has."""
        sizes = self.sizes[numbers]
        shift = np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))], sizes

    @classmethod
    def of_parts(cls, part_of: np.ndarray, answers: dict[int, bytes], kind: str) -> IdLists:
        """The lists that come from the packs of several parts; a part's words rise in its pack."""
        unpacked = [unpack_lists(answers[part]) for part in np.unique(part_of).tolist()]
        lists = cls(
            np.concatenate([np.zeros(0, np.int64), *[sizes for sizes, _ in unpacked]]),
            np.frombuffer(b"".join([body for _, body in unpacked]), kind),
        )
        place = _places(np.argsort(part_of, kind="stable"))
        lists.sizes, lists.starts = lists.sizes[place], lists.starts[place]
        return lists


def _assemble(kind: str, pieces: list[bytes], as_bytes: bool) -> Callable[[tuple[pa.Scalar, ...], pa.Table, pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], batches: pa.Table, answers: pa.Table) -> pa.Table:
        of_part = dict(zip(answers.column("part").to_pylist(), answers.column("ids").to_pylist(), strict=True))
        batch = batches.to_pylist()[0]
        lists = IdLists.of_parts(_spread(batch["parts"], "<u4"), of_part, kind)
        numbers, ends = unpack_numbers(batch["numbers"]), np.cumsum([0, *batch["n_words"]])
        out, first, last = [], 0, len(batch["doc_ids"])
        while first < last:
            stop = max(first + 1, int(np.searchsorted(ends, ends[first] + JOIN_WORDS, side="right")) - 1)
            ids, sizes = lists.take(numbers[ends[first]:ends[stop]])
            cuts = np.concatenate([[0], np.cumsum(sizes)])[ends[first:stop + 1] - ends[first]]
            decoded = [
                b"".join([pieces[i] for i in ids[a:b].tolist()]).decode("utf-8", "replace")
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
            ]
            if as_bytes:
                out_ids = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            else:
                out_ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            out.append(pa.RecordBatch.from_pydict({
                "doc_id": pa.array(batch["doc_ids"][first:stop], pa.int64()),
                "ids": out_ids,
                "decoded": pa.array(decoded, pa.string()),
            }))
            first = stop
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)
    return run


def encode_decode(
    docs: DataFrame, tokenizer: str, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES, as_bytes: bool = False
) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text).

    ``ids`` is an array, or ``as_bytes`` little-endian unsigned 32-bit integers. ``tokenizer`` is the path of a byte-level tokenizer file; it is read on the driver only. A
    null or empty text, or one without a word, has no ids and decodes to an empty text. Rows
    with equal or null ids, and repeated rows, are encoded row by row. Other columns are left
    out; an empty table gives an empty one.
    """
    tokenizer_json = Path(tokenizer).read_text(encoding="utf-8")
    pattern, pieces = word_pattern(tokenizer_json), id_pieces(tokenizer_json)
    kind = "<u2" if len(pieces) <= 1 << 16 else "<u4"
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    parts = 1 + (docs.agg(F.sum(n_bytes)).first()[0] or 0) // part_bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_words(F.col("text"), pattern).alias("words"), n_bytes.alias("n_bytes"))
    cut = staged(rows.mapInArrow(_batches(batch_bytes, parts), CUT), "word-numbers")
    packs = cut.filter("part >= 0").select("batch", "part", "words")
    answers = packs.groupBy("part").applyInArrow(_encode(tokenizer_json, kind), "asked_by bigint, part int, ids binary")
    batches = cut.filter("part = -1").select("batch", "doc_ids", "n_words", "numbers", "parts")
    return batches.groupBy("batch").cogroup(answers.groupBy("asked_by")).applyInArrow(
        _assemble(kind, pieces, as_bytes), f"doc_id bigint, ids {'binary' if as_bytes else 'array<int>'}, decoded string"
    )


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of texts encoded ``as_bytes``."""
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
