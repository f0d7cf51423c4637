"""BPE encoding and decoding of whole texts, with words encoded along a prefix-sharing trie.

A byte-pair encoding can be grown a byte at a time: of all tokens that end at a
place of a word exactly one can be its prefix's last token, namely the one that
stands beside the last token of what is before it, i.e. whose merges, run on the two together,
leave both as they are. So a prefix's state is its last token and the prefix before that.
The distinct new words of a batch are put into a trie in order, which walks it
depth first; a node gets its state and its ids from those above it, once, and
every word that begins like that uses them. Ids of words are kept by the worker process for its
later batches, up to ``most_words``.

Texts are parted into words in the tokenizer's way: special tokens first, then its pattern; plain
texts by the same pattern here, others by the tokenizer's own splitter. Word
boundaries are all that is taken from it; ids come from the vocabulary and the merges alone.
Decoding joins the tokens' bytes and reads them as UTF-8, ill-formed bytes as U+FFFD; ids not in the vocabulary add nothing.

Defined results: a null or empty text has no ids, and no ids give the empty
text; repeated rows are encoded each; a text that spells a special token gets
its id; null ids of documents are kept; very long texts and words are encoded
whole; an empty table gives an empty result; further columns are not looked at.
Truncation and padding of the tokenizer are not used.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .token_files import _byte_letters
from .words import pieces
from .workspace import table

#: Letters, digits, marks and white space on whose kind all versions of the character tables agree.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ƿ"
_DIGITS = "0-9²³¹¼-¾"
PLAIN = re.compile("[\t-\r -~\x85-ƿ‐-‧‰-⁞€]*")
_SPACE = "\t-\r \x85\xa0"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACE}{_LETTERS}{_DIGITS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Vocabulary:
    """Tokens as bytes, their ids, and the order of merges, from a byte-level tokenizer's file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        splitter, model = told["pre_tokenizer"] or {}, told["model"]
        plain = not told["normalizer"] and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError("not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("special tokens that take in what is beside them")
        byte = {chr(c): b for b, c in _byte_letters().items()}
        as_bytes = lambda token: bytes(byte[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.rank, self.merged, self._ends, self.gathered = {}, {}, {}, None
        for n, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.rank[self.ids[a], self.ids[b]] = n
            self.merged[self.ids[a], self.ids[b]] = self.ids[a + b]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.table = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tokenizer = Tokenizer.from_file(path)
        self._split = lambda text: [as_bytes(w).decode() for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        return WORDS.findall(text) if PLAIN.fullmatch(text) else self._split(text)

    def ends(self, token: int) -> tuple[list, list]:
        """The symbols that stand first, and last, in turn, while the merges make ``token`` of its bytes, each with the rank of the merge that takes it up.

        Empty if the merges don't come to it.
        """
        found = self._ends.get(token)
        if found is None:
            tokens, rank, top = [self.ids[bytes([b])] for b in self.table[token]], self.rank, len(self.rank)
            first, last = [], []
            while len(tokens) > 1:
                ranks = [rank.get(pair, top) for pair in zip(tokens, tokens[1:])]
                best = min(ranks)
                if best == top:
                    break
                at = ranks.index(best)  # the least rank first, leftmost
                if at == 0:
                    first.append((tokens[0], best))
                if at == len(tokens) - 2:
                    last.append((tokens[-1], best))
                tokens[at : at + 2] = [self.merged[tokens[at], tokens[at + 1]]]
            found = ([*first, (token, top)], [*last, (token, top)]) if tokens == [token] else ([], [])
            self._ends[token] = found
        return found

    def stay(self, one: int, two: int) -> bool:
        """Whether the merges, run over two tokens' bytes side by side, come to just these two; ``one`` is -1 for no token.

        Merges inside either go on as if alone until one takes up a symbol of each: that needs a rank
        before those at which the two symbols are taken up inside (of equal ranks the leftmost goes first).
        """
        first = self.ends(two)[0]
        if one < 0 or not first:
            return bool(first)
        rank = self.rank
        for x, x_goes in self.ends(one)[1]:
            for y, y_goes in first:
                r = rank.get((x, y))
                if r is not None and r < x_goes and r <= y_goes:
                    return False
        return True


class Trie:
    """Encodes batches of texts; their new words make a trie, walked depth first.

    What is kept for later batches: ids of words, whether two tokens stay side by side, and the moves of an automaton over
    the vocabulary, whose state is the longest end of a prefix that begins some token: the tokens that end there are its ends.
    """

    def __init__(self, vocabulary: Vocabulary, *, most_words: int = 400_000, most_pairs: int = 1_000_000, long: int = 4096):
        self.vocabulary, self.most_words, self.most_pairs, self.long = vocabulary, most_words, most_pairs, long
        self.stays: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.begins = {t[:k] for t in vocabulary.ids for k in range(1, len(t) + 1)} | {b""}
        self.moves: dict[int, int] = {}  # by state * 256 + byte
        self.state_of, self.texts = {b"": 0}, [b""]
        self.tokens: list[list[tuple[int, int]]] = [[]]  # of each state: (token, size) of all that end there, the longest first

    def _move(self, state: int, byte: int) -> int:
        text = self.texts[state] + bytes([byte])
        while text not in self.begins:
            text = text[1:]
        to = self.state_of.setdefault(text, len(self.texts))
        if to == len(self.texts):
            ids = self.vocabulary.ids
            self.texts.append(text)
            self.tokens.append([(ids[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in ids])
        self.moves[state << 8 | byte] = to
        return to

    def _stays(self, pair: int) -> bool:
        stay = self.stays[pair] = self.vocabulary.stay((pair >> 32) - 1, pair & 0xFFFFFFFF)
        return stay

    def learn(self, words: Iterable[str]) -> None:
        """Put words in: in order, so a word's prefixes are on the path of the word before it, or new.

        Of each node: ``last`` (its last token, plus one, as the upper half of a pair) and its ids, from those of the node before that token.
        """
        moves, stays, tokens, known = self.moves.get, self.stays.get, self.tokens, self.known
        last, encoded, path, states, before = [0], [()], [0], [0], b""
        for word in sorted(words):
            content = word.encode()
            if len(content) > self.long:
                known[word] = self._long(content).tobytes()
                continue
            at, common = 0, min(len(before), len(content))
            while at < common and before[at] == content[at]:
                at += 1
            del path[at + 1 :], states[at + 1 :]
            state = states[at]
            for depth, byte in enumerate(content[at:], at + 1):
                to = moves(state << 8 | byte)
                state = self._move(state, byte) if to is None else to
                for token, size in tokens[state]:
                    node = path[depth - size]
                    pair = last[node] | token
                    stay = stays(pair)
                    if stay or stay is None and self._stays(pair):
                        break
                else:
                    raise ValueError(f"no token ends {content[:depth]!r}")
                path.append(len(last))
                states.append(state)
                last.append(token + 1 << 32)
                encoded.append(encoded[node] + (token,))
            known[word] = array("i", encoded[path[len(content)]]).tobytes()
            before = content

    def _long(self, word: bytes) -> array:
        """Ids of one very long word, with its own places as nodes: without the ids of every prefix."""
        last, before, state, moves = array("i", [-1]), array("i", [0]), 0, self.moves.get
        for depth, byte in enumerate(word, 1):
            to = moves(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            for token, size in self.tokens[state]:
                pair = last[depth - size] + 1 << 32 | token
                stay = self.stays.get(pair)
                if stay or stay is None and self._stays(pair):
                    break
            else:
                raise ValueError(f"no token ends {word[:depth]!r}")
            last.append(token)
            before.append(depth - size)
        ids, node = array("i"), len(word)
        while node:
            ids.append(last[node])
            node = before[node]
        ids.reverse()
        return ids

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as 32-bit integers of this machine."""
        if len(self.known) > self.most_words:
            self.known.clear()
        if len(self.stays) > self.most_pairs:
            self.stays.clear()
        apart, special = self.vocabulary.apart, {t: array("i", [i]).tobytes() for t, i in self.vocabulary.special.items()}
        split = []  # of each text: lists of words, and special tokens between them
        for text in texts:
            parts = apart.split(text or "") if apart else [text or ""]
            split.append([part if part in special else self.vocabulary.words(part) for part in parts])
        known, new = self.known, set()
        for parts in split:
            for words in parts:
                if type(words) is list:
                    new.update(words)
        new = new.difference(known)
        collecting = gc.isenabled()
        gc.disable()  # a trie's many small tuples hold no cycles
        try:
            self.learn(new)
        finally:
            if collecting:
                gc.enable()
        of = known.__getitem__
        out = [b"".join([special[words] if type(words) is str else b"".join(map(of, words)) for words in parts]) for parts in split]
        for word in new:
            if len(word) > self.long:
                del known[word]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return array("i", self.encode_batch([text])[0]).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        of = self.vocabulary.table
        return b"".join([of.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: the tokens' bytes are gathered at once; where these are no UTF-8, text by text."""
        vocabulary = self.vocabulary
        if vocabulary.gathered is None:
            table = [vocabulary.table.get(i, b"") for i in range(max(vocabulary.table) + 2)]  # the last stands for ids that are none
            sizes = np.array([len(t) for t in table], np.int64)
            vocabulary.gathered = np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes
        content, starts, sizes = vocabulary.gathered
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        flat = np.where((flat < 0) | (flat >= len(sizes)), len(sizes) - 1, flat)
        size = sizes[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        whole = content[np.repeat(starts[flat] - ends[:-1], size) + np.arange(ends[-1])]
        counts = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[counts].astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.string())

    _kept: dict = {}

    @classmethod
    def of(cls, tokenizer: str) -> Trie:
        """The one of this worker process."""
        if tokenizer not in cls._kept:
            cls._kept[tokenizer] = cls(Vocabulary(tokenizer))
        return cls._kept[tokenizer]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def listed(ids: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    places = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(places, np.frombuffer(b"".join(ids), np.int32))


def encode(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``ids``, the token ids of each text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece["id"], listed(trie.encode_batch(piece["text"].to_pylist()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of each list of ids."""
    path, names = tokenizer or default_tokenizer(), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, trie.decode_batch(part[ids])], [*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ``ids`` and ``decoded`` (the text that the ids give) of each text, by one worker a task: what it keeps is there once."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids = listed(trie.encode_batch(piece["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([piece["id"], ids, trie.decode_batch(ids)], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"))
    text_of_ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text_of_ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
