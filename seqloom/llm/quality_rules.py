"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Everything is a DataFrame expression. Statistics are row-local; learning is a
handful of small aggregations: each growing step counts labelled rows by
(feature, bin, label), so one job weighs every threshold of every feature.
The learned list becomes one ordered ``CASE WHEN``.

The list is learned from labelled rows that pass the base rule, as it has no
say about the others.

Defined results: a null text counts as empty (all statistics 0, rejected by
the base rule); labels that contradict each other for one id are set aside;
with no low label, with labels of one kind only, or with too few low ones to
grow and to test a rule on (``min_cover``), the list is empty and the base rule
alone decides; a value at a threshold is on the side that the threshold names, of equally good rules the first
feature and bin is taken; repeated rows are judged each by itself; an empty table gives no rows; very long texts are
read whole; further columns are kept or not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import GAP, Workspace, let, table

#: Single characters, not ranges: Java tests a class of single Latin characters by one table lookup.
SYMBOLS, MARKS, DIGITS, UPPER = "#*$%&|<>", "!?;:", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")


def _chars_in(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Sorting hashes shows which occur again;
    their positions come from a second sort, or where only a few windows repeat from looking each one up."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    window = lambda h, i: F.xxhash64(h[i], h[i + 1], h[i + 2])
    starts = lambda h: F.when(F.size(h) >= 3, F.sequence(F.lit(0), F.size(h) - 3)).otherwise(F.array().cast("array<int>"))

    def again(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False))))

    def looked_up(keys: Column, dup: Column) -> Column:
        return F.filter(F.transform(keys, lambda x, i: F.when(F.array_contains(dup, x), i)), lambda i: i.isNotNull())

    def sorted_out(keys: Column) -> Column:
        def twice(s: Column) -> Column:
            near = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["i"]))

        return let(F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)

    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct((x + 2).alias("end"), (a["n"] + F.least(F.lit(3), x + 2 - a["end"])).cast("long").alias("n")),
        lambda a: a["n"],
    )

    def counted(keys: Column) -> Column:
        def by(dup: Column) -> Column:
            places = F.when(F.size(dup) <= 24, looked_up(keys, dup)).otherwise(sorted_out(keys))
            return F.when(F.size(dup) == 0, F.lit(0).cast("long")).otherwise(let(places, covered))

        return let(let(F.sort_array(keys), again), by)

    return let(hashed, lambda h: let(F.transform(starts(h), lambda i: window(h, i)), counted))


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and the columns STATS, each named ``prefix`` + name."""
    raw, words, marks = f"{prefix}__raw", f"{prefix}__words", f"{prefix}__marks"
    lines = F.filter(F.split(F.col(raw), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, F.filter(F.split(F.col(raw), GAP), lambda w: w != ""))
    out = out.withColumn(marks, F.regexp_replace(raw, f"[^{UPPER}{DIGITS}{MARKS}{SYMBOLS}\n]+", ""))  # what is counted below, mostly a small part
    found = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _chars_in(F.col(marks), SYMBOLS),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": _repeat_words(F.col(words)),
        "n_lines": _chars_in(F.col(marks), "\n") + 1,
        "n_upper": _chars_in(F.col(marks), UPPER),
        "n_marks": _chars_in(F.col(marks), MARKS),
        "n_digits": _chars_in(F.col(marks), DIGITS),
    }
    return out.withColumns({prefix + k: v for k, v in found.items()}).drop(raw, words, marks)


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def features(prefix: str = "") -> dict[str, Column]:
    """What thresholds are put on: rates, so that long and short texts compare."""
    c = lambda k: F.col(prefix + k).cast("double")
    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    return {
        "words": c("n_words"),
        "chars_per_word": c("word_chars") / words,
        "symbols_per_word": c("n_symbols") / words,
        "dup_lines_per_line": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)),
        "repeat_share": c("n_repeat_words") / words,
        "words_per_line": c("n_words") / F.greatest(c("n_lines"), F.lit(1.0)),
        "upper_share": c("n_upper") / chars,
        "marks_per_word": c("n_marks") / words,
        "digit_share": c("n_digits") / chars,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        x = features(prefix)[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[Condition, ...], ...]

    def reason(self, prefix: str = "") -> Column:
        """The first rule that fires, as text; null if none does."""
        out = F.when(F.lit(False), F.lit(""))
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column(prefix)
            out = out.when(test, F.lit(" and ".join(map(str, rule))))
        return out


def learn(labelled: DataFrame, *, workspace: Workspace, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.8, min_cover: int = 5) -> DecisionList:
    """Learn which rows are low. ``labelled``: STATS, ``low`` (boolean), ``part`` ('grow' or 'prune').

    Rules are grown on one part by FOIL gain, cut back on the other, kept while their precision
    there is at least ``min_precision``; then the rows that they cover are set aside.
    """
    named = features()
    values = workspace.save(labelled.select("low", "part", *(v.alias(k) for k, v in named.items())), "values")
    steps = [i / bins for i in range(bins + 1)]
    # quantiles of either class, ends included: a rare class has thresholds of its own, and where one class ends and the other begins is among them
    cuts_of = [F.percentile_approx(F.when(F.col("low") == side, F.col(k)), steps, 2000).alias(f"{k}_{side}") for k in named for side in (True, False)]
    found = values.agg(*cuts_of).first()
    marks = {k: sorted({*(found[f"{k}_True"] or []), *(found[f"{k}_False"] or [])}) for k in named}
    cuts = {k: [(x + y) / 2 for x, y in zip(v, v[1:])] for k, v in marks.items()}  # half-way, so that either class keeps a margin

    def counts(rows: DataFrame) -> dict[tuple[str, int, bool], int]:
        """Labelled rows by feature, number of cuts below the value, and class: one aggregation for all thresholds."""
        below = lambda k, v: F.size(F.filter(F.lit([float(c) for c in v]), lambda c: c < F.col(k)))
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), below(k, v).alias("b")) for k, v in cuts.items() if v)))
        got = rows.select("low", each.alias("x")).groupBy("x.f", "x.b", "low").count().collect()  # at most features x cuts x 2 rows
        return {(r["f"], r["b"], r["low"]): r["count"] for r in got}

    def totals(rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.count(F.when(F.col("low"), 1)), F.count(F.when(~F.col("low"), 1))).first()
        return r[0], r[1]

    rules: list[tuple[Condition, ...]] = []
    test = lambda conds: [F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold for c in conds]
    covered = F.lit(False)
    while len(rules) < max_rules:
        left = values.filter(~covered)
        inside, conj = left.filter("part = 'grow'"), []
        p, n = totals(inside)
        while p >= min_cover and n > 0 and len(conj) < max_conditions:
            got, best = counts(inside), (0.0, None, 0, 0, [])
            for k, v in cuts.items():
                for j, cut in enumerate(v):
                    lows = sum(m for (f, b, low), m in got.items() if f == k and b <= j and low)
                    highs = sum(m for (f, b, low), m in got.items() if f == k and b <= j and not low)
                    for above, a, b in ((False, lows, highs), (True, p - lows, n - highs)):
                        if a >= min_cover:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (k, above), a, b, [cut])
                            elif best[1] == (k, above) and (a, b) == best[2:4]:
                                best[4].append(cut)
            if best[1] is None:
                break
            _, (k, above), p, n, tied = best
            conj.append(Condition(k, above, (min(tied) + max(tied)) / 2))  # the middle of the gap that no grown row lies in
            inside = inside.filter(test(conj[-1:])[0])
        if not conj:
            break
        held, tests = left.filter("part = 'prune'"), test(conj)
        sums, cond = [], F.lit(True)
        for t in tests:
            cond = cond & t
            sums += [F.count(F.when(cond & F.col("low"), 1)), F.count(F.when(cond & ~F.col("low"), 1))]
        r = held.agg(*sums).first()
        worth = [((r[2 * i] - r[2 * i + 1]) / max(1, r[2 * i] + r[2 * i + 1]), -i) for i in range(len(conj))]
        keep = -max(worth)[1] + 1
        a, b = r[2 * keep - 2], r[2 * keep - 1]
        if a + b == 0 or a / (a + b) < min_precision:
            break
        rules.append(tuple(conj[:keep]))
        cond = F.lit(True)
        for t in tests[:keep]:
            cond = cond & t
        covered = covered | cond
    workspace.drop("values")
    return DecisionList(tuple(rules))


def labelled_stats(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics of the labelled rows; ``low`` where the label is 0."""
    sure = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi")).filter("__lo = __hi")
    sure = sure.select(F.col(id_col).alias("__id"), (F.col("__lo") == 0).alias("low"))
    part = F.when(F.pmod(F.xxhash64("__id"), F.lit(3)) == 2, "prune").otherwise("grow")
    return stats.join(sure, stats[id_col] == F.col("__id")).select(*STATS, "low", part.alias("part"))


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DecisionList]:
    """One row a document: ``id_col``, STATS, base_failed, kept and reason; and the list that was learned."""
    work = Workspace(docs.sparkSession, "quality")
    stats = work.save(with_stats(docs.select(F.col(id_col), F.col(text)), text).select(id_col, *STATS), "stats")
    learned = learn(labelled_stats(stats, labels, id_col).filter(~base_failed()), workspace=work)
    return stats.withColumn("base_failed", base_failed()).withColumn("reason", learned.reason()).withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull()), learned


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", max_labelled: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Statistics to learn from are computed for labelled rows alone, found by a broadcast of their ids: of more than about
    ``max_labelled``, those whose hash is lowest. No text is shuffled or written.
    """
    work = Workspace(docs.sparkSession, "quality")
    ids = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("__id")).distinct()
    ids = work.save(ids, "labelled")
    share = min(1.0, max_labelled / max(1, ids.count()))
    some = ids if share == 1 else ids.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select(F.col(id_col), F.col(text)).join(F.broadcast(some), F.col(id_col) == F.col("__id"), "left_semi")
    stats = work.save(with_stats(found, text).select(id_col, *STATS), "stats")
    learned = learn(labelled_stats(stats, labels, id_col).filter(~base_failed()), workspace=work)
    own = docs.columns
    judged = with_stats(docs, text, prefix="__q_")
    return judged.filter(~base_failed("__q_") & learned.reason("__q_").isNull()).select(*own)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")
