"""Benchmark decontamination: pigeonhole edit matching, verified by Myers' bit-parallel distance.

A test item may occur with up to ``k = length * edit_rate`` edits. It is split
into k + 1 pieces: k edits can't touch them all, so one piece occurs exactly.
Pieces of all items are found in one Aho-Corasick scan of each whole text. A
hit is verified from the piece up: halves of the item get their share of the
budget by the same argument (of two halves with m1 and m2 pieces one has at
most m - 1 edits), so most chance hits end at a pair of pieces, and nothing
that is in the budget is lost. The last check is the whole item.

Items lie in a table in the shared folder, a file for each ``block_chars`` of
them. There is one narrow pass over the texts: a task takes a batch of texts
through one file of items after another, and keeps a few files' automata for
its next batches. No item goes through the driver, nothing but items is shuffled.

Both sides are compared lower-cased, with runs of white space as one space.
Short items have a small budget: under 10 characters none, so they have to
occur exactly. With ``whole_words``, items of fewer characters than that count
only where they stand between word boundaries, within the same budget.
A match is reported by its distance, the first end that has it, and the start that makes
it most nearly as long as the item (the first of two).
Defined results: null or empty texts match nothing; an empty item matches
nothing; items shorter than ``min_chars`` are set aside (by default none is);
repeated rows are judged each by itself; equal items are all reported, one of
several equal matches is the first; null ids are kept; very long texts are
searched whole; without items nothing matches, and an empty table of texts gives no rows; further columns are kept or not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import pieces
from .workers import tidy
from .workspace import Workspace, table

MATCHES = "item_id long, distance int, match_start long, match_end long"


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """A string to search for with edits, as Myers' bit vectors."""

    def __init__(self, text: str):
        self.size, self.bits = len(text), {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i
        self.mask, self.top = (1 << self.size) - 1, 1 << (self.size - 1)

    def _scores(self, window: str, anchored: bool) -> Iterator[int]:
        """After each character of ``window``, the fewest edits between the pattern and what ends there: any of it, or all of it if ``anchored``."""
        plus, minus, score = self.mask, 0, self.size
        mask, top, bits, low = self.mask, self.top, self.bits, int(anchored)
        for c in window:
            eq = bits.get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus) & mask
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1 | low) & mask, down << 1 & mask
            plus = down | ~(vertical | up) & mask
            minus = up & vertical
            yield score

    def search(self, window: str) -> tuple[int, int]:
        """(distance, end): the fewest edits between the pattern and any substring of ``window``, and where the first such ends."""
        best = (self.size, 0)
        for at, score in enumerate(self._scores(window, False), 1):
            if score < best[0]:
                best = (score, at)
        return best

    def ends(self, window: str, budget: int) -> list[tuple[int, int]]:
        """(distance, end) of each end within the budget."""
        found = [(score, at) for at, score in enumerate(self._scores(window, False), 1) if score <= budget]
        return [(self.size, 0), *found] if self.size <= budget else found

    def lengths(self, window: str, budget: int) -> list[tuple[int, int]]:
        """(distance, length) of each beginning of ``window`` within the budget of the whole pattern."""
        found = [(score, at) for at, score in enumerate(self._scores(window, True), 1) if score <= budget]
        return [(self.size, 0), *found] if self.size <= budget else found


class Item:
    """A test item and its pieces; ``checks[p]``: for piece p, what to verify in turn: (from, to, budget)."""

    def __init__(self, item_id: int, text: str, edit_rate: float):
        self.id, self.text, self.budget = item_id, text, int(len(text) * edit_rate)
        n = self.budget + 1
        self.cuts = [len(text) * p // n for p in range(n + 1)]
        self.checks: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        todo = [(0, n)]
        while todo:
            a, b = todo.pop()
            for p in range(a, b):
                self.checks[p].insert(0, (self.cuts[a], self.cuts[b], b - a - 1))
            if b - a > 1:
                middle = (a + b + 1) // 2
                todo += [(a, middle), (middle, b)]
        self.patterns: dict[tuple[int, int], Pattern] = {}
        self.backwards: Pattern | None = None
        self.beside = [self._beside(p) for p in range(n)]

    def _beside(self, p: int) -> tuple[bool, int, list[str]] | None:
        """What stands beside piece p in the smallest part to verify: after it or not, how far, and pieces of it of which one is exact."""
        wider = [c for c in self.checks[p] if c[2]]
        if not wider:
            return None
        a, b, budget = wider[0]
        after = a == self.cuts[p]
        other = self.text[self.cuts[p + 1] : b] if after else self.text[a : self.cuts[p]]
        n = budget + 1
        return after, len(other) + budget, [other[len(other) * i // n : len(other) * (i + 1) // n] for i in range(n)]

    def starts(self, text: str, end: int, budget: int) -> list[tuple[int, int]]:
        """(distance, start) of each match within the budget that ends at ``end``."""
        if self.backwards is None:
            self.backwards = Pattern(self.text[::-1])
        return [(d, end - n) for d, n in self.backwards.lengths(text[max(0, end - len(self.text) - budget) : end][::-1], budget)]

    def near(self, text: str, piece: int, at: int) -> bool:
        """Whether the parts of the item around its ``piece``, found at ``at``, are within their budgets."""
        end = at + self.cuts[piece + 1] - self.cuts[piece]
        if self.beside[piece]:
            after, reach, parts = self.beside[piece]
            beside = text[end : end + reach] if after else text[max(0, at - reach) : at]
            if not any(part in beside for part in parts):
                return False
        for a, b, budget in self.checks[piece][:-1]:
            if budget:  # else the piece itself
                pattern = self.patterns.get((a, b)) or self.patterns.setdefault((a, b), Pattern(self.text[a:b]))
                start = max(0, at - (self.cuts[piece] - a) - budget)
                if pattern.search(text[start : at + (b - self.cuts[piece]) + budget])[0] > budget:
                    return False
        return True

    def verify(self, text: str, begin: int, whole_words: bool) -> tuple[int, int] | None:
        """(distance, end in text) of the best match around ``begin``, where it begins but for the edits before the piece that was found."""
        whole = (0, len(self.text))
        pattern = self.patterns.get(whole) or self.patterns.setdefault(whole, Pattern(self.text))
        start = max(0, begin - self.budget)
        window = text[start : max(0, begin + len(self.text) + self.budget)]
        if not whole_words:
            distance, end = pattern.search(window)
            return (distance, start + end) if distance <= self.budget else None
        ends = [start + e for _, e in pattern.ends(window, self.budget) if not inside_word(text, start + e)]
        return min(((d, e) for e in ends for d, s in self.starts(text, e, self.budget) if s < e and not inside_word(text, s)), default=None)


def inside_word(text: str, k: int) -> bool:
    """Whether place ``k`` parts a word (scripts from U+2E80 on have no gaps between words)."""
    return 0 < k < len(text) and all(c.isalnum() and c < "\u2e80" for c in text[k - 1 : k + 1])


class Matcher:
    def __init__(self, items: list[tuple[int, str]], edit_rate: float, whole_words: int = 0):
        import ahocorasick

        self.whole_words = whole_words
        self.items = [Item(i, t, edit_rate) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for p in range(item.budget + 1):
                places.setdefault(item.text[item.cuts[p] : item.cuts[p + 1]], []).append((n, p))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """The best match of each item: (item id, distance, start, end) in the normalised text."""
        text = normalised(raw)
        best: dict[int, tuple[int, int]] = {}
        if not text or not self.items:
            return []
        seen: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(text):
            for n, p in where:
                item = self.items[n]
                # the last check looks at a stretch of text that only this place decides, whatever the piece
                begin = last + 1 - size - item.cuts[p]
                if best.get(n, (1,))[0] == 0 or (n, begin) in seen or not item.near(text, p, last + 1 - size):
                    continue
                seen.add((n, begin))
                found = item.verify(text, begin, len(item.text) < self.whole_words)
                if found and (n not in best or found < best[n]):
                    best[n] = found
        out = []
        for n, (distance, end) in sorted(best.items()):
            item, size = self.items[n], len(self.items[n].text)
            starts = [s for d, s in item.starts(text, end, distance) if d == distance and not (size < self.whole_words and inside_word(text, s))]
            out.append((item.id, distance, min(starts, key=lambda s: (abs(end - s - size), s)), end))
        return out


class Items:
    """Files of test items, with the automata of the last few of them that a worker process has used."""

    _kept: dict = {}

    def __init__(self, files: list[str], edit_rate: float, whole_words: int, keep: int = 8):
        self.files, self.how, self.keep = files, (edit_rate, whole_words), keep

    def matchers(self) -> Iterator[Matcher]:
        for file in self.files:
            key = (file, *self.how)
            matcher = Items._kept.pop(key, None)
            if matcher is None:
                store, name = fs.FileSystem.from_uri(file)
                rows = pq.read_table(name, filesystem=store).to_pylist()
                matcher = Matcher([(r["item_id"], r["text"]) for r in rows], *self.how)
            Items._kept[key] = matcher  # the last used stands last
            while len(Items._kept) > self.keep:
                Items._kept.pop(next(iter(Items._kept)))
            yield matcher


def item_files(items: DataFrame, *, id_col: str = "item_id", text: str = "text", edit_rate: float = 0.1, whole_words: int = 0, min_chars: int = 1, block_chars: int = 1_000_000) -> Items:
    """Normalised items as files in the shared folder, each of about ``block_chars`` characters (or one item)."""
    work = Workspace(items.sparkSession, "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t) for t in batch["text"].to_pylist()]
            long = pa.array([len(t) >= max(1, min_chars) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(texts, pa.string())], ["item_id", "text"]).filter(long)

    rows = work.save(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, text string"), "rows")
    chars = rows.agg(F.sum(F.length("text"))).first()[0]
    if not chars:
        return Items([], edit_rate, whole_words)
    return Items(sorted(work.save(rows.repartition(-(-chars // block_chars)), "files").inputFiles()), edit_rate, whole_words)


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each document and item that it holds: id, item_id, distance, match_start, match_end (in the normalised text)."""
    rows, files = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), item_files(items, **how)
    names = ("doc_id", "item_id", "distance", "match_start", "match_end")
    schema = pa.schema([(n, pa.int32() if n == "distance" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for matcher in files.matchers():
                found = [(i, *m) for piece in pieces(batch, "text") for i, t in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist()) for m in matcher.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], schema.field(k).type) for k in range(5)], schema=schema)

    return rows.mapInArrow(tidy(run), f"doc_id long, {MATCHES}").withColumnRenamed("doc_id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, in one narrow pass."""
    files = item_files(items, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for matcher in files.matchers():
                clean = [not matcher.matches(t) for piece in pieces(batch, text) for t in piece[text].to_pylist()]
                batch = batch.filter(pa.array(clean, pa.bool_()))
            yield batch

    return docs.mapInArrow(tidy(run), docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
