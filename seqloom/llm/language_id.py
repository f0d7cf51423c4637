"""Language ID by multilingual mixture inference.

Each language is a smoothed distribution over hashed letter n-grams, counted
over all its training texts. A document is a mixture: expectation-maximisation
estimates the proportion of each language from the likelihoods of its n-grams,
and languages are given up one by one, the least present first, as long as the
likelihood penalised by ``penalty * log(n-grams)`` for each language does not
fall. The largest proportion names the document.

N-grams are counted in each batch into one fixed-size array for each language,
so what is shuffled and broadcast is bounded by languages x slots.

Defined results: a null text, or one without letters, is ``und`` with score 0
(and so is everything if nothing can be learned); ties go to the first code;
texts of a null language are not learned from; repeated rows are alike; a very
long text is read whole, in memory of a few dozen bytes a character; an empty table gives no rows; further
columns are not looked at. More than MAX_LANGUAGES languages are an error: all their counts are one array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

MAX_LANGUAGES = 1000
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point, of all planes: whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
    return _LETTERS


def slots_of(text: str | None, slots: int) -> np.ndarray:
    """Slots of the letter 1-, 2- and 3-grams of a text, with one blank for all between words; empty if it has no letter."""
    letters = _letters()
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters[codes], codes, np.uint32(32))
    if not (codes != 32).any():
        return np.empty(0, np.int64)
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint64)
    codes = codes[~((codes == 32) & np.concatenate([[False], codes[:-1] == 32]))]  # runs of blanks as one
    one, out, h = codes[1:-1], [], codes
    out.append(one[one != 32] * np.uint64(0x9E3779B97F4A7C15))
    for n in (2, 3):
        h = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[n - 1 :] + np.uint64(n)
        out.append(h * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(out) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def infer(counts: np.ndarray, likelihood: np.ndarray, *, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Proportions of the languages (rows of ``likelihood``) in a document with these n-gram counts; unchosen ones are 0."""
    total = counts.sum()

    def fit(which: list[int], start: np.ndarray) -> tuple[float, np.ndarray]:
        p, share = likelihood[which], start / start.sum()
        for _ in range(rounds if len(which) > 1 else 0):
            share = share * (p @ (counts / (share @ p))) / total
        return float(counts @ np.log(share @ p)), share

    which = list(range(len(likelihood)))
    # a head start for what explains the text best alone
    alone = np.log(likelihood) @ counts
    start = np.exp(np.maximum((alone - alone.max()) / total, -20)) + 1e-6
    ll, share = fit(which, start)
    cost = penalty * np.log(max(2.0, total))
    while len(which) > 1:
        drop = int(np.argmin(share))
        fewer = which[:drop] + which[drop + 1 :]
        ll_fewer, share_fewer = fit(fewer, np.maximum(np.delete(share, drop), 1e-9))
        if ll_fewer - cost * len(fewer) < ll - cost * len(which):
            break
        which, ll, share = fewer, ll_fewer, share_fewer
    out = np.zeros(len(likelihood))
    out[which] = share
    return out


class MixtureModel:
    def __init__(self, languages: list[str], likelihood: np.ndarray, slots: int):
        self.languages, self.likelihood, self.slots = languages, likelihood, slots

    @classmethod
    def fit(cls, labelled: DataFrame, *, text: str = "text", lang: str = "lang", slots: int = 1 << 15, smoothing: float = 0.5) -> MixtureModel:
        """Learn from all rows of ``labelled`` with a language and letters."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, np.ndarray] = {}
            for batch in batches:
                for code, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                    got = slots_of(t, slots)
                    if len(got):
                        if code not in found:
                            found[code] = np.zeros(slots, np.int64)
                        found[code] += np.bincount(got, minlength=slots)
            for code, n in found.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": [code] * len(at), "slot": at, "n": n[at]})

        rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
        counts = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        got = counts.toArrow()  # at most languages x slots rows
        languages = sorted(set(got["lang"].to_pylist()))
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} can be told apart")
        full = np.full((len(languages), slots), smoothing)
        place = {code: i for i, code in enumerate(languages)}
        np.add.at(full, ([place[c] for c in got["lang"].to_pylist()], got["slot"].to_numpy()), got["n"].to_numpy())
        return cls(languages, full / full.sum(axis=1, keepdims=True) if len(languages) else full, slots)

    def proportions(self, text: str | None) -> np.ndarray | None:
        got = slots_of(text, self.slots)
        if not len(got) or not self.languages:
            return None
        n = np.bincount(got, minlength=self.slots)
        at = np.flatnonzero(n)
        return infer(n[at].astype(float), self.likelihood[:, at])

    def predict(self, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """id, lang_pred, score (its proportion) and mixture (language -> proportion)."""
        shared = docs.sparkSession.sparkContext.broadcast((self.languages, self.likelihood, self.slots))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = MixtureModel(*shared.value)
            for batch in batches:
                names, scores, mixtures = [], [], []
                for t in batch["text"].to_pylist():
                    share = model.proportions(t)
                    if share is None:
                        names.append("und"), scores.append(0.0), mixtures.append([])
                        continue
                    best = int(np.argmax(share))
                    names.append(model.languages[best])
                    scores.append(min(1.0, float(share[best])))
                    mixtures.append([(model.languages[i], float(share[i])) for i in np.flatnonzero(share)])
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "mixture"])

        rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, mixture map<string,double>").withColumnRenamed("id", id_col)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id hashes as the empty string."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = MixtureModel.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return model.predict(docs).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "mixture")
