"""Encoding through distinct words against the tokenizer on whole texts."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedloom.llm import bpe_words
from feedloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def wanted(tokenizer, texts):
    coded = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [(ids, tokenizer.decode(ids, skip_special_tokens=False)) for ids in coded]


def test_whole_table(spark, tokenizer):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    expected = sorted(
        (r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest())
        for r, (ids, text) in zip(given, wanted(tokenizer, [r.text for r in given]), strict=True)
    )
    assert sorted(map(tuple, QUERIES["op13_bpe_words"](spark, FOLDER).collect())) == expected


PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x85", " ", " ", "　", " ", "​", "᠎", "\x1c", "\x00", "a", "don't", "I'll",
    "'s", "'", "''", "the", " The", "é", "é", "ſ", "日本", "한국", "ไทย", "ѿ", "٣", "²", "Ⅷ", "42", "3.14", "_", "a_b", "<|endoftext|>",
    "<|endof", "endoftext|>", "<|", "|>", "<", "\U0001f600", "\U0001e900", "\U00031350", "\U0001e4d0", "\U00010d4a", "x" * 40, "!!", "...", "https://a.b/c?d=e",
]


def odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(1, 30))) for _ in range(1500)]
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(every)
    texts += ["".join(every[i:i + 64]) for i in range(0, len(every), 64)]
    texts += [" ".join(every[i:i + 64]) + " ." for i in range(0, len(every), 64)]
    return [*texts, None, "", " ", "\n ", "x" * 200_000, "ab " * 100_000, " " * 100_000 + "a", "!" * 100_000, "é" * 100_000]


@pytest.mark.parametrize("batch_bytes", [1, 5_000, 16 << 20])
def test_odd_texts(spark, tokenizer, batch_bytes):
    texts = odd_texts() if batch_bytes > 1 else odd_texts()[:200] + [None, "", " "]
    rows = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    rows = rows.select("*", *[F.lit("x").alias(c) for c in ("words", "n_bytes", "batch", "ids", "numbers", "word", "id", "piece", "place")])
    got = bpe_words.encode_decode(rows, PATH, batch_bytes).collect()
    assert len(got) == len(texts)
    want = wanted(tokenizer, texts)
    assert sum(r.doc_id is None for r in got) == sum(i % 50 == 0 for i in range(len(texts)))
    wrong = [r.doc_id for r in got if r.doc_id is not None and (list(r.ids), r.decoded) != want[r.doc_id]]
    assert wrong == []
    none = sorted((list(r.ids), r.decoded) for r in got if r.doc_id is None)
    assert none == sorted((want[i][0], want[i][1]) for i in range(0, len(texts), 50))


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id bigint, text string")
    assert sorted(r.decoded for r in bpe_words.encode_decode(rows, PATH).collect()) == ["a b", "a b", "c"]
    out = bpe_words.digests(bpe_words.encode_decode(rows.limit(0), PATH, as_bytes=True))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_batches_are_bounded_and_words_leave_once(spark):
    rows = spark.createDataFrame([(i, "the cat and the cat " * 20) for i in range(100)], "doc_id bigint, text string").coalesce(1)
    cut = rows.select("doc_id", bpe_words.text_words(F.col("text"), bpe_words.WORD).alias("words"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = cut.mapInArrow(bpe_words._batches(4000, 3), bpe_words.CUT).collect()
    batches, packs = [r for r in rows if r.part == -1], [r for r in rows if r.part >= 0]
    assert [len(b.doc_ids) for b in batches] == [10] * 10
    for batch in batches:
        sizes, bodies = zip(*[bpe_words.unpack_lists(bytes(p.words)) for p in packs if p.batch == batch.batch], strict=True)
        assert sum(map(len, sizes)) == 5 and len(b"".join(bodies)) == len(" " + " and" + " cat" + " the" + "the")
    assert len({b.batch for b in batches}) == 10 and {p.part for p in packs} <= {0, 1, 2}


def test_each_distinct_word_is_encoded_once(monkeypatch):
    words = [b"the", b" cat", b" sat"]
    pack = bpe_words.pack_lists(np.array([len(w) for w in words]), b"".join(words))
    packs = pa.table({"batch": [1, 2], "part": pa.array([0, 0], pa.int32()), "words": pa.array([pack, pack])})
    asked = []

    class Counting:
        def __init__(self, real):
            self.real = real

        def no_truncation(self):
            pass

        no_padding = no_truncation

        def encode_batch(self, texts, add_special_tokens):
            asked.extend(texts)
            return self.real.encode_batch(texts, add_special_tokens=add_special_tokens)

    class Factory:
        from_str = staticmethod(lambda text: Counting(Tokenizer.from_str(text)))

    monkeypatch.setattr("tokenizers.Tokenizer", Factory)
    out = bpe_words._encode(open(PATH, encoding="utf-8").read(), "<u2")(packs)
    assert asked == ["the", " cat", " sat"] and out.column("asked_by").to_pylist() == [1, 2]
    assert out.column("ids")[0] == out.column("ids")[1]


@pytest.mark.parametrize("numbers", [[], [0], [*range(100, 140_000, 2)], [127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 0, 5]])
def test_numbers_round_trip(numbers):
    numbers = np.array(numbers, np.int64)
    assert bpe_words.unpack_numbers(bpe_words.pack_numbers(numbers)).tolist() == numbers.tolist()


def test_added_tokens_that_words_may_cut_are_refused():
    with pytest.raises(ValueError, match="apart"):
        bpe_words.word_pattern('{"added_tokens": [{"content": "two words", "lstrip": false, "rstrip": false}]}')
