import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm.packing import pack
from tideline.llm.shared import fresh_path
from tideline.llm.token_count import token_counts
from tideline.llm.token_files import Shard, bits_for, read_token_files, token_id_files, unpack, write_token_files
from tideline.llm.token_files import pack as pack_bits

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows():
    rng = random.Random(9)
    parts = ["Hello", "world's", "naïve", "  ", "\n", "\t", "12345", "éèê", "日本語", "ΑΣ ΣΑ", "😀👍🏽", "!!??", "I'LL", "we're", "<|endoftext|>", "aaaaaa", " ", "ﬁ", "é", "x" * 40, "don't", "_a_"]
    texts = ["", None, " ", "a", *("".join(rng.choice([" ", "", " "]) + rng.choice(parts) for _ in range(rng.choice([1, 5, 40, 900]))) for _ in range(120)), "word " * 30000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, start string")


def encoded(path):
    t = Tokenizer.from_file(path)
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(docs):
    want = {i: (len((t or "").encode()), len(ids), len(ids) > 2048) for (i, t), ids in zip(rows(), encoded(WORDS).values())}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORDS).collect()} == want
    assert token_counts(docs.limit(0), WORDS).collect() == []


def test_token_files_round_trip(docs, spark):
    want, at = {}, 0
    for i, ids in encoded(BYTES).items():
        want[i] = (at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_id_files(docs, BYTES).collect()} == want
    manifest = write_token_files(docs, BYTES, fresh_path(spark, "t"), shard_ids=3000, block=64)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()} == want
    shard = Shard(manifest.filter("n_docs > 2").first().file)
    ids = shard.ids(0, shard.n_ids)
    for a, b in ((0, 1), (63, 65), (100, 200), (5, 5)):
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    assert token_id_files(docs.limit(0), BYTES).collect() == []


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    assert unpack(pack_bits(ids, bits), len(ids), bits).tolist() == ids.tolist()
    assert bits_for(50257) == 16 and bits_for(2) == 1 and bits_for(1) == 1


@pytest.mark.parametrize("shard_tokens", [4 << 20, 5000])
def test_packing(docs, shard_tokens):
    got = pack(docs, BYTES, shard_tokens=shard_tokens).toPandas()
    ids = {i: [*x, 1] for i, x in encoded(BYTES).items()}
    by = got.sort_values(["doc_id", "start"])
    for d, own in by.groupby("doc_id"):
        assert (own.length.cumsum() - own.length).tolist() == own.start.tolist() and own.length.sum() == len(ids[d]) and set(own.doc_tokens) == {len(ids[d])}
        assert own.ids_crc32.tolist() == [crc(ids[d][a : a + n]) for a, n in zip(own.start, own.length)]
    assert set(by.doc_id) == set(ids)
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        n = int(s.length.sum())
        assert (s.length.cumsum() - s.length).tolist() == s.offset.tolist() and n <= 2048 and n & (n - 1) == 0


def test_packing_keeps_neighbours_together(spark):
    topics = ["red green blue yellow", "king queen castle throne", "dough flour oven bread"]
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(topics[i % 3].split(), k=330))) for i in range(60)], "doc_id long, text string").coalesce(1)
    got = pack(docs, BYTES).toPandas()
    alike = got.groupby("sequence_id").doc_id.apply(lambda d: len({x % 3 for x in d}))
    assert (alike == 1).mean() > 0.6
