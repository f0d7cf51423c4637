import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm.bpe import Trie, Vocabulary, decode, default_tokenizer, encode, op11_bpe, round_trip

POOL = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070)]] + ["<|endoftext|>", "<|endof", "'s", "'ll", " ", "  ", "\n\n", "東", "京", "é", "😀", "͸", "the", "ing", "aaaaaaaaa", " " * 10, "　", "٣", "१"]


@pytest.fixture(scope="module")
def both():
    return Trie(Vocabulary(default_tokenizer())), Tokenizer.from_file(default_tokenizer())


def test_ids_and_texts_are_the_tokenizers(both):
    trie, plain = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randrange(60))) for _ in range(200)]
    assert [np.frombuffer(i, np.int32).tolist() for i in trie.encode_batch(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for _ in range(3000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randrange(60)))
        ids = trie.encode(text)
        assert ids == plain.encode(text, add_special_tokens=False).ids
        assert trie.decode(ids) == plain.decode(ids, skip_special_tokens=False) == text
    for _ in range(300):  # lists of ids that no text gives, and ids that are none
        ids = [rng.randrange(50_300) for _ in range(rng.randrange(30))]
        assert trie.decode(ids) == plain.decode(ids, skip_special_tokens=False)
        assert trie.decode_batch(pa.array([ids, [], None, ids[:3]], pa.list_(pa.int32()))).to_pylist() == [trie.decode(ids), "", "", trie.decode(ids[:3])]


def test_long_words_and_small_tries(both):
    trie, plain = both
    rng = random.Random(2)
    small = Trie(trie.vocabulary, most_words=50, most_pairs=10, long=40)
    for text in ("a" * 20_000, "ab" * 5_000, " " * 9_000, "é" * 5_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "some plain words and more plain words " * 20):
        wanted = plain.encode(text, add_special_tokens=False).ids
        assert trie.encode(text) == wanted and small.encode(text) == wanted


def test_pairs_stay_as_the_merges_say(both):
    vocabulary, rng = both[0].vocabulary, random.Random(3)

    def merged(text):
        tokens = [vocabulary.ids[bytes([b])] for b in text]
        while len(tokens) > 1:
            rank, at = min((vocabulary.rank.get(p, 10**9), i) for i, p in enumerate(zip(tokens, tokens[1:])))
            if rank == 10**9:
                break
            tokens[at : at + 2] = [vocabulary.merged[tokens[at], tokens[at + 1]]]
        return tokens

    short = [t for t in vocabulary.table if len(vocabulary.table[t]) <= 3 and t != 50256]
    for _ in range(6000):
        one, two = rng.choice(short), rng.choice(short)
        assert vocabulary.stay(one, two) == (merged(vocabulary.table[one] + vocabulary.table[two]) == [one, two])


def test_shared_prefixes_are_computed_once(both):
    trie, seen = Trie(both[0].vocabulary), []

    class Counted(list):
        def __getitem__(self, state):
            seen.append(state)
            return super().__getitem__(state)

    trie.tokens = Counted(trie.tokens)
    trie.learn({"inter", "internal", "international", "interest"})
    assert len(seen) == len("international") + len("l") + len("est")


def test_rows(spark):
    rows = [(1, "Hello <|endoftext|> world", "x"), (None, None, "y"), (1, "", "z"), (1, "Hello <|endoftext|> world", "x"), (2, "long " * 300_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1))
    plain = Tokenizer.from_file(default_tokenizer())
    got = decode(encode(docs)).collect()
    assert sorted(map(str, round_trip(docs).collect())) == sorted(map(str, got))
    key = lambda r: (str(r[0]), len(r[1]))
    wanted = [(i, plain.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)
    assert encode(docs.limit(0)).count() == 0


def test_query(spark):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(default_tokenizer())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in op11_bpe(spark, sf_dir).collect():
        ids = plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(plain.decode(ids, skip_special_tokens=False)))
