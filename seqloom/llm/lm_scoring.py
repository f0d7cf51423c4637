"""LM scoring with a log-frequency Bloom filter.

Counts are gathered from all training texts: of every token, and of every pair
of neighbours. No token and no pair is left out. A pair's count is quantised
to one of the ``thresholds`` (1, 2, 3 ... exact at first, then 15 % apart); the
filter holds (pair, 1), (pair, 2) ... up to its level, so a count is read back
by probing levels until one is absent. Bits grow with the number of entries,
and bits an entry with the vocabulary, so that a context expects about one
false positive or less among all tokens.

The filter has two parts. The most frequent pairs, as many as fit into
``head_bytes``, are one filter that workers get as a broadcast. All others are
in parts, each for a range of keys, a table in the shared folder. Scoring deals
texts into pieces; a piece asks each part once for the pairs that the broadcast
doesn't hold, and gets one byte for each. So what a worker holds is bounded
whatever the corpus, and no n-gram so common that every piece asks for it
travels. Exact token counts go the same way: the ``head`` most frequent ones
by broadcast, the others from their part.

The model: P(b) = (n(b) + 1) / (N + V + 1), where all unknown tokens together
are one; P(b | a) = (q(ab) + prior * P(b)) / (n(a) + prior + e), q the pair's
quantised count and e the expected number of false positives over the whole
vocabulary. Over all b this adds up to 1, but for quantising (at most 7.5 %,
where one pair has all of a context's count) and chance in the false positives.
A text's score is the sum of log10 P over its tokens and the end, the first
after an end.

Tokens are told apart by 64-bit hashes (48 bits inside a part), pairs by 40 bits
inside a part. Defined results: a null or empty text
is the end token alone; with nothing to learn from N and V are 0; repeated
rows are scored each by itself, and each counts in training; ids may be null, and rows of one id are documents
of their own; tokens of equal count are ordered by their hash; an empty table gives no rows;
a very long text is a piece by itself; further columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import fold
from .words import mixed, pieces, word_hashes
from .workspace import Workspace, table

END = np.uint64(0x5E0FD0C5)
SEGMENT = 1 << 16
_LEVEL, _SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
TOKENS, PAIRS = 0, 1  # kinds of questions and of answers


def thresholds(step: float = 1.15, most: int = 1 << 62) -> np.ndarray:
    """The least count of each level; level 1 is the first."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * step))))
    return np.array(out, np.int64)


THRESHOLDS = thresholds()
#: What a level is read as: the middle of its counts; 0 for level 0.
VALUES = np.concatenate([[0.0], (THRESHOLDS[:-1] + (THRESHOLDS[1:] - 1)) / 2])


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right").astype(np.uint8)


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text ended by END, and where each text begins (one more at the end)."""
    words, at = word_hashes(texts)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def pair_keys(stream: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; the first of a text comes after an END."""
    before = np.concatenate([[END], stream[:-1]])
    return mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + stream)


def share(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` a key belongs to: parts are ranges of keys, so sorted keys visit them in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class LogBloom:
    """A Bloom filter over (key, level) in segments of 64 KiB.

    An entry sets ``each`` bits in each of four 64-bit words of its segment, so a probe reads four words at most.
    """

    WORDS = SEGMENT // 8

    def __init__(self, words: np.ndarray, *, each: int, segments: int):
        self.words, self.each, self.segments = words, each, segments

    @classmethod
    def masks(cls, keys: np.ndarray, level: int, each: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Four times: the word in the segment, and its bits."""
        at = mixed(keys + np.uint64(level * int(_LEVEL) % 2**64))
        h = mixed(at ^ _LEVEL)
        for j in range(4):
            mask, groups = np.zeros(len(keys), np.uint64), h * np.uint64(2 * j + 1)
            for i in range(each):
                mask |= np.uint64(1) << (groups >> np.uint64(64 - 6 * (i + 1)) & np.uint64(63))
            yield (at >> np.uint64(13 * j) & np.uint64(cls.WORDS - 1)).astype(np.int64), mask

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray, *, each: int, segments: int) -> LogBloom:
        words = np.zeros(segments * cls.WORDS, np.uint64)
        start = share(mixed(keys), segments) * cls.WORDS
        for n in range(1, int(levels.max(initial=0)) + 1):
            some = levels >= n
            for word, mask in cls.masks(keys[some], n, each):
                np.bitwise_or.at(words, start[some] + word, mask)
        return cls(words, each=each, segments=segments)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which all are there; 0 where not even the first is."""
        level = np.zeros(len(keys), np.uint8)
        if not len(self.words):
            return level
        alive, n = np.arange(len(keys)), 1
        start = share(mixed(keys), self.segments) * self.WORDS
        while len(alive):
            at = mixed(keys[alive] + np.uint64(n * int(_LEVEL) % 2**64))
            begin = start[alive]
            for j in range(4):  # most that are absent go at the first word
                mask, groups = np.zeros(len(alive), np.uint64), mixed(at ^ _LEVEL) * np.uint64(2 * j + 1)
                for i in range(self.each):
                    mask |= np.uint64(1) << (groups >> np.uint64(64 - 6 * (i + 1)) & np.uint64(63))
                held = self.words[begin + (at >> np.uint64(13 * j) & np.uint64(self.WORDS - 1)).astype(np.int64)] & mask == mask
                alive, at, begin = alive[held], at[held], begin[held]
                if not len(alive):
                    break
            level[alive] = n
            n += 1
        return level


class Frequent(LogBloom):
    """The broadcast part. All that is in it has ``least`` levels or more, so fewer are false."""

    def __init__(self, words: np.ndarray, each: int, segments: int, least: int):
        super().__init__(words, each=each, segments=segments)
        self.least = least

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found = super().levels(keys)
        return np.where(found >= self.least, found, 0).astype(np.uint8)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one occurrence of each, and for each occurrence which key it is."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def _cut(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys."""
    of, first = np.unique(share(keys, parts), return_index=True)
    yield from zip(of.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])


#: Bytes that tell the keys of one part apart: tokens for sure, pairs but for one in a million, which ``chance`` counts.
SHORT = {TOKENS: 6, PAIRS: 5}


def _shorten(keys: np.ndarray, kind: int = PAIRS) -> bytes:
    return mixed(keys ^ _SHORT).view(np.uint8).reshape(-1, 8)[:, : SHORT[kind]].tobytes()


def _short(blob: bytes, kind: int = PAIRS) -> np.ndarray:
    out = np.zeros((len(blob) // SHORT[kind], 8), np.uint8)
    out[:, : SHORT[kind]] = np.frombuffer(blob, np.uint8).reshape(-1, SHORT[kind])
    return out.view(np.uint64).ravel()


def _of_part(short: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """Short keys of several parts as keys of one filter."""
    return mixed(short ^ (np.asarray(part).astype(np.uint64) << np.uint64(40)))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with ipc.new_stream(sink, batch.schema, options=ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return ipc.open_stream(pa.py_buffer(blob)).read_next_batch()


class BloomModel:
    """A model fitted on ``train`` (all rows of it)."""

    def __init__(self, train: DataFrame, *, text: str = "text", head: int = 300_000, prior: float = 300.0, head_bytes: int = 8 << 20, part_bytes: int = 2 << 20):
        self.work, self.spark = Workspace(train.sparkSession, "lm"), train.sparkSession
        rows = train.select(F.col(text).alias("text"))
        size, n_rows = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        most = (size or 0) // 2 + 1 + 2 * n_rows  # tokens at most: words have gaps between them, and each text an end
        self.parts = max(1, -(-(size or 0) // part_bytes))
        self.each = max(3, most.bit_length() // 6 + 1)  # the more tokens there may be, the rarer a false positive has to be
        self.bits = -(-4 * self.each * 1443 // 1000)  # bits for an entry, where half of all are set
        # of n things counted at most n / t have a count of t or more: so these thresholds bound what is broadcast
        self.often = min(most // max(1, head) + 1, 1 << 32)
        steps = np.arange(1, len(THRESHOLDS) + 1)
        fits = most * steps / THRESHOLDS <= 8 * head_bytes // self.bits
        self.head_level = int(np.argmax(fits)) + 1 if fits.any() else len(THRESHOLDS)
        self._count(rows)
        self.work.release()
        totals = {r["kind"]: r for r in self.known.groupBy("kind").agg(F.sum("total").alias("n"), F.sum("entries").alias("v"), F.max("entries").alias("most"), F.avg("fill").alias("fill"), F.sum(F.length("rest")).alias("rest")).collect()}  # two rows
        self.n, self.v = (totals[TOKENS]["n"], totals[TOKENS]["v"]) if TOKENS in totals else (0, 0)
        self.has_rest = any(r["rest"] for r in totals.values())
        # of a false positive: that its bits are set, or that it is short for the same as another pair
        self.chance = _false_chance(totals[PAIRS]["fill"] or 0.0, self.each) + totals[PAIRS]["most"] / 2**40 if PAIRS in totals else 0.0
        self._broadcast(head)
        self.probability = Probability(self.n, self.v, prior, self.v * self.chance)

    def _count(self, rows: DataFrame) -> None:
        """The table ``known``, a row for each kind and part (a range of keys).

        ``head``, ``head_n``: what may be broadcast, and counts (of pairs: levels). ``rest``, ``rest_n``: of tokens all others, short
        and sorted, and their counts; of pairs the words of a filter of all others. ``fill``: how many of its bits are set.
        """
        parts, often, head_level, each, bits = self.parts, self.often, self.head_level, self.each, self.bits

        def emitted(keys: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for kind, some in keys.items():
                distinct, n = np.unique(np.concatenate(some), return_counts=True)
                cuts, n, packed = [*_cut(distinct, parts)], n.astype(np.uint32), np.ndarray.tobytes if kind == TOKENS else _shorten
                columns = [pa.array([kind] * len(cuts), pa.int32()), pa.array([k for k, _, _ in cuts], pa.int64())]
                columns += [pa.array([packed(distinct[a:b]) for _, a, b in cuts], pa.binary()), pa.array([n[a:b].tobytes() for _, a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "part", "keys", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, size = {TOKENS: [], PAIRS: []}, 0
            for batch in batches:
                for p in pieces(batch, "text"):
                    stream = token_stream(p["text"])[0]
                    kept[TOKENS].append(stream)
                    kept[PAIRS].append(pair_keys(stream))
                    size += len(stream)
                    if size > 2_000_000:
                        yield from emitted(kept)
                        kept, size = {TOKENS: [], PAIRS: []}, 0
            if size:
                yield from emitted(kept)

        def summed(some: pa.Table) -> pa.Table:
            kind, part = some["kind"][0].as_py(), some["part"][0].as_py()
            keys = np.concatenate([np.frombuffer(x, np.uint64) if kind == TOKENS else _short(x) for x in some["keys"].to_pylist()])
            n = np.concatenate([np.frombuffer(x, np.uint32) for x in some["n"].to_pylist()])
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
            total, fill = int(n.sum()), None
            if kind == TOKENS:
                rare, top = n < often, n >= often // 64
                short = _short(_shorten(keys[rare], TOKENS), TOKENS)
                by = np.argsort(short)
                head, rest, rest_n = keys[top], short[by], n[rare][by].astype(np.uint32)
            else:
                n = levels_of(n)
                top = n >= head_level
                entries = int(n[~top].sum(dtype=np.int64))
                segments = -(-entries * bits // (8 * SEGMENT))
                head, rest, rest_n = _of_part(keys[top], part), LogBloom.of(keys[~top], n[~top], each=each, segments=segments).words, n[:0]
                fill = float(np.bitwise_count(rest).mean()) / 64 if segments else None
            blobs = {"head": head, "head_n": n[top], "rest": rest, "rest_n": rest_n}
            row = {"kind": pa.array([kind], pa.int32()), "part": [part], "total": [total], "entries": [len(keys)], "fill": pa.array([fill], pa.float64())}
            return pa.table(row | {k: pa.array([x.tobytes()], pa.binary()) for k, x in blobs.items()})

        dealt = rows.mapInArrow(run, "kind int, part long, keys binary, n binary").groupBy("kind", "part")
        made = dealt.applyInArrow(summed, "kind int, part long, total long, entries long, fill double, head binary, head_n binary, rest binary, rest_n binary")
        self.known = self.work.save(made, "known")

    def _broadcast(self, head: int) -> None:
        """What workers get: frequent tokens with their counts (``head`` at most), and the frequent pairs' filter (about ``head_bytes`` at most)."""
        some = self.known.filter(F.length("head") > 0).select("kind", "head", "head_n")

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch["head_n"].to_pylist():
                    n = np.bincount(levels_of(np.frombuffer(blob, np.int64)), minlength=len(VALUES))
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["level", "n"])

        # how many tokens there are from each level on; those of ``often`` and more are few enough in any corpus
        total, least = 0, self.often
        for r in some.filter(F.col("kind") == TOKENS).mapInArrow(sizes, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
            total += r["n"]
            if total > head:
                break
            least = min(least, int(THRESHOLDS[r["level"] - 1]))
        least = max(least, self.often // 64)

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kind, keys, n in zip(*(batch[c].to_pylist() for c in ("kind", "head", "head_n"))):
                    if kind == TOKENS:
                        n = np.frombuffer(n, np.int64)
                        keys, n = np.frombuffer(keys, np.uint64)[n >= least].tobytes(), n[n >= least].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([keys], pa.binary()), pa.array([n], pa.binary())], ["kind", "head", "head_n"])

        found = {TOKENS: ([], []), PAIRS: ([], [])}
        for r in some.mapInArrow(frequent, "kind int, head binary, head_n binary").toLocalIterator():  # bounded as these are
            found[r["kind"]][0].append(np.frombuffer(r["head"], np.uint64))
            found[r["kind"]][1].append(np.frombuffer(r["head_n"], np.int64 if r["kind"] == TOKENS else np.uint8))
        (tokens, counts), (pairs, level) = ((np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *n])) for keys, n in found.values())
        order = np.argsort(tokens)
        segments = -(-int(level.sum()) * self.bits // (8 * SEGMENT))
        bloom = LogBloom.of(pairs, level, each=self.each, segments=segments)
        self.head = self.spark.sparkContext.broadcast((tokens[order], counts[order]))
        self.shared_filter = self.spark.sparkContext.broadcast((bloom.words, self.each, segments, self.head_level))
        if segments:
            self.chance += _false_chance(float(np.bitwise_count(bloom.words).mean()) / 64, self.each) ** self.head_level * VALUES[self.head_level]

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", piece_bytes: int = 2 << 20, stable: bool = False) -> DataFrame:
        """One row a document: id, n_tokens, n_known, train_tokens, base_score, score.

        Pieces are read twice, to ask and to rate. They are saved in between, unless ``docs`` is said to be ``stable``:
        a table in files, of which every reading deals the same rows. Answers that don't fit a piece raise an error.
        """
        head, shared, parts, each, least = self.head, self.shared_filter, self.parts, self.each, int(THRESHOLDS[self.head_level - 1])
        n, v, often, probability = self.n, self.v, self.often, self.probability
        rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
        schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"

        def looked_up(stream: np.ndarray, frequent: Frequent) -> tuple:
            """What the broadcast parts say of a piece: (tokens, counts, which) and (pairs, levels, which), 0 for what they don't hold."""
            tokens, _, of_token = _distinct(stream)
            count = _counts_of(tokens, *head.value)
            pairs, at, of_pair = _distinct(pair_keys(stream))
            # a pair is at most as frequent as either of its tokens; those that aren't broadcast occur less than ``often``
            enough = ((count >= least) | (count == 0) & (often > least))[of_token]
            before = np.concatenate([[True], enough[:-1]])
            level, may = np.zeros(len(pairs), np.uint8), np.flatnonzero(enough[at] & before[at])
            level[may] = frequent.levels(_of_part(_short(_shorten(pairs[may])), share(pairs[may], parts)))
            return (tokens, count, of_token), (pairs, level, of_pair, at)

        def rate(batch: pa.RecordBatch, answers: dict[int, bytes], frequent: Frequent) -> pa.RecordBatch:
            stream, start = token_stream(batch["text"])
            (tokens, count, of_token), (_, level, of_pair, at) = looked_up(stream, frequent)
            if TOKENS in answers:
                count[count == 0] = np.frombuffer(answers[TOKENS], np.uint32)
            if PAIRS in answers:
                level[level == 0] = np.frombuffer(answers[PAIRS], np.uint8)
            of = count[of_token]
            before = np.concatenate([[count[np.searchsorted(tokens, END)]], of[:-1]])
            logs = np.log10(probability(level, of[at], before[at]))[of_pair]
            base = np.log10(count + 1.0)[of_token] - np.log10(n + v + 1.0)
            columns = (np.diff(start), *(np.add.reduceat(x, start[:-1]) for x in ((of > 0).astype(np.int64), base, logs)))
            return pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, columns)], ["id", "n_tokens", "n_known", "base_score", "score"])

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent = Frequent(*shared.value)
            for batch in batches:
                for p in pieces(batch, "text", piece_bytes):
                    yield rate(p, {}, frequent)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in pieces(batch, "text", piece_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([_packed(p)], pa.binary())], ["texts"])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent = Frequent(*shared.value)
            for batch in batches:
                for piece, texts in zip(batch["piece"].to_pylist(), batch["texts"].to_pylist()):
                    for kind, (keys, known, *_) in enumerate(looked_up(token_stream(_unpacked(texts)["text"])[0], frequent)):
                        keys = keys[known == 0]
                        cuts = [*_cut(keys, parts)]
                        columns = (pa.array([k for k, _, _ in cuts], pa.int64()), pa.array([piece] * len(cuts), pa.int64()), pa.array([kind] * len(cuts), pa.int32()), pa.array([_shorten(keys[a:b], kind) for _, a, b in cuts], pa.binary()))
                        yield pa.RecordBatch.from_arrays([*columns], ["part", "piece", "kind", "keys"])

        def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
            tokens, counts, bloom = np.empty(0, np.uint64), np.empty(0, np.int64), LogBloom(np.empty(0, np.uint64), each=each, segments=1)
            for kind, rest, rest_n in zip(*(known[c].to_pylist() for c in ("kind", "rest", "rest_n"))):
                if kind == TOKENS:
                    tokens, counts = np.frombuffer(rest, np.uint64), np.frombuffer(rest_n, np.uint32)
                else:
                    bloom = LogBloom(np.frombuffer(rest, np.uint64), each=each, segments=len(rest) // SEGMENT)
            kinds, asks = np.array(asked["kind"].to_pylist()), asked["keys"].to_pylist()
            found: list[bytes] = [b""] * len(asks)
            for kind in (TOKENS, PAIRS):  # all at once, then cut by question
                mine = np.flatnonzero(kinds == kind).tolist()
                keys = _short(b"".join(asks[i] for i in mine), kind)
                each_found = _counts_of(keys, tokens, counts).astype(np.uint32) if kind == TOKENS else bloom.levels(keys)
                ends = np.cumsum([len(asks[i]) // SHORT[kind] for i in mine]).tolist()
                for i, a, b in zip(mine, [0, *ends], ends):
                    found[i] = each_found[a:b].tobytes()
            return pa.table({"piece": asked["piece"], "kind": asked["kind"], "part": asked["part"], "found": pa.array(found, pa.binary())})

        def joined(piece: pa.Table, found: pa.Table) -> pa.Table:
            by_kind: dict[int, list[bytes]] = {}
            for _, kind, blob in sorted(zip(*(found[c].to_pylist() for c in ("part", "kind", "found")))):
                by_kind.setdefault(kind, []).append(blob)
            whole = {k: b"".join(x) for k, x in by_kind.items()}
            return pa.Table.from_batches([rate(_unpacked(texts), whole, Frequent(*shared.value)) for texts in piece["texts"].to_pylist()])

        if self.has_rest:
            dealt = rows.mapInArrow(deal, "texts binary").withColumn("piece", F.monotonically_increasing_id())
            dealt = dealt if stable else self.work.save(dealt, f"pieces-{uuid.uuid4().hex[:8]}")
            asked = dealt.select("piece", "texts").mapInArrow(ask, "part long, piece long, kind int, keys binary")
            answers = asked.groupBy("part").cogroup(self.known.select("part", "kind", "rest", "rest_n").groupBy("part")).applyInArrow(answer, "piece long, kind int, part long, found binary")
            scored = dealt.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(joined, schema)
        else:  # all that is known is in the broadcast parts
            scored = rows.mapInArrow(alone, schema)
        return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _false_chance(fill: float, each: int) -> float:
    """The probability that four words hold ``each`` bits that nobody put there for this key, where entries fall on words by chance."""
    if not fill:
        return 0.0
    # entries in a word: Poisson, with a mean that gives this fill on average
    mean = -np.log1p(-fill) / -np.log1p(-((1 - (1 - 1 / 64) ** each)))
    k = np.arange(0, int(mean + 12 * np.sqrt(mean) + 20))
    weight = np.exp(k * np.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k]))
    return float((weight * (1 - (1 - 1 / 64) ** (each * k)) ** each).sum() ** 4)


class Probability:
    """P(b | a) from the pair's level and the exact counts of b and a."""

    def __init__(self, n: int, v: int, prior: float, false: float):
        self.n, self.v, self.prior, self.false = n, v, prior, false

    def __call__(self, level: np.ndarray, of_token: np.ndarray, of_context: np.ndarray) -> np.ndarray:
        single = (of_token + 1) / (self.n + self.v + 1)
        return (VALUES[level] + self.prior * single) / (of_context + self.prior + self.false)


def _counts_of(keys: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each key in a sorted table; 0 if it isn't there."""
    if not len(tokens):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(tokens, keys), len(tokens) - 1)
    return np.where(tokens[at] == keys, counts[at], 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = BloomModel(docs.filter(fold(F.col("doc_id"), 7) != 2)).score(docs, stable=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
