"""Aligning reads to references, counting, and overlaps of reads, as Spark plans around the kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.model import NullModel, Params
from . import sequences as sq
from .kernels import OverlapSweep, PairSweep, Scores, SeedIndex, Sweep, choose_diagonals, envelope, most_of_short, quals, short_forward, straight_scores, tokens, widen

ALIGNMENT = "x_idx long, x_name string, y_idx long, y_name string, raw double, null_ll double, score double, ref_row string, read_row string, qual_row string, ref_start int, ref_end int, ref_rev boolean, read_start int, read_end int"


@dataclass(frozen=True)
class EnvelopeConfig:
    """Where the search looks. ``threshold``: k-mers a diagonal needs; ``max_bytes``: by memory instead; ``full``: everywhere."""

    k: int = 6
    threshold: int = 20
    band: int = 64
    max_bytes: int | None = None
    full: bool = False

    def diagonals(self, x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
        return None if self.full else choose_diagonals(x, y, k=self.k, threshold=self.threshold, band=self.band, max_bytes=self.max_bytes)


def null_model(reads: DataFrame) -> NullModel:
    """Fitted on all reads that have qualities: at most 4 x 94 counts reach the driver."""
    hist = np.zeros((4, 94))
    for r in sq.quality_histogram(reads.filter(dna.has_qual(F.col("seq"), F.col("qual")))).filter("q is not null").collect():
        hist["ACGT".index(r["base"].upper()), r["q"]] = r["n"]
    return NullModel.fit(hist, reads.count())


def reference_rows(refs: DataFrame) -> DataFrame:
    """idx, name of the original, seq, reversed."""
    return refs.select(F.col("idx").cast("long").alias("idx"), F.coalesce(F.col("source.name"), F.col("name")).alias("origin"), "seq", (~F.col("is_orig")).alias("rev"))


def reference_windows(refs: DataFrame, size: int, lap: int) -> DataFrame:
    """Rows of ``reference_rows`` cut into windows of ``size`` bases, each with the last ``lap`` of the one before: offset (bases before it) and full (the reference's length).

    What spans up to ``lap`` bases lies in full in one of them.
    """
    if not 0 < lap < size:
        raise ValueError("a window has to be longer than its overlap with the next")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("full") - lap - 1), F.lit(size - lap))
    cut = refs.withColumn("full", F.length("seq")).withColumn("offset", F.explode(starts))
    return cut.select("idx", "origin", F.substring("seq", F.col("offset") + 1, F.lit(size)).alias("seq"), "rev", "offset", "full")


def in_blocks(rows: DataFrame, name: str, most_bases: int) -> DataFrame:
    """``rows`` in one array column: what stands together in a partition, cut at about ``most_bases`` bases of seq."""
    columns = rows.columns
    kind = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = np.cumsum(pc.binary_length(b["seq"]).to_numpy(zero_copy_only=False)), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bases, "right")))
                part = pa.StructArray.from_arrays([b[c].slice(at, to - at) for c in columns], columns)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), part)], [name])
                at = to

    return rows.mapInArrow(run, f"{name} array<struct<{kind}>>")


def reference_parts(refs: DataFrame) -> int:
    """Partitions for work over ``refs``: two for each core, fewer where these would be small, more where they would be large."""
    bases = refs.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0
    return max(1, -(-bases // 4_000_000), min(2 * refs.sparkSession.sparkContext.defaultParallelism, bases // 250_000))


def alike_together(rows: DataFrame, most: int = 8_000_000) -> DataFrame:
    """``rows`` (seq, copies): of those with one seq in a partition one, with the copies of all; ``most`` bases and copies are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, schema = {}, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*held], schema.field("seq").type), pa.array([*held.values()], schema.field("copies").type)], ["seq", "copies"])

        for b in batches:
            schema = b.schema
            for seq, copies in zip(b["seq"].to_pylist(), b["copies"].to_pylist()):
                size += len(copies) + (0 if seq in held else len(seq))
                held.setdefault(seq, []).extend(copies)
                if size >= most:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return rows.mapInArrow(run, rows.schema)


def block_pairs(reads: DataFrame, refs: DataFrame, parts: int, *, ref_bases: int = 2_000_000, read_bases: int = 100_000) -> DataFrame:
    """(refs, reads): every block of references beside every block of reads; both stay partitioned.

    References with one seq are one (seq, copies: the other columns of each), put together before they are dealt out and
    after: so copies are searched once, and a large group of them isn't sent to one task.
    """
    one = refs.select("seq", F.array(F.struct(*(c for c in refs.columns if c != "seq"))).alias("copies"))
    alike = alike_together(alike_together(one).repartition(parts, "seq"))
    return in_blocks(alike, "refs", ref_bases).crossJoin(in_blocks(reads, "reads", read_bases))


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
    """References (seq, copies) in order of the first copy's idx, and reads, of each row of ``block_pairs``."""
    place = lambda c: (c["idx"], c.get("offset") or 0)
    for batch in batches:
        for n in range(batch.num_rows):
            refs = [{"seq": r["seq"], "copies": sorted(r.get("copies") or [r], key=place)} for r in batch["refs"][n].as_py()]
            yield sorted(refs, key=lambda r: place(r["copies"][0])), batch["reads"][n].as_py()


def lanes_of(refs: list[np.ndarray], y: np.ndarray, config: EnvelopeConfig) -> list[tuple[int, int, int]]:
    return [(n, d, w) for n, x in enumerate(refs) for d, w in envelope(config.diagonals(x, y), len(x), len(y))]


@dataclass
class Search:
    """Where one read is searched in a block of references: lanes; whole matrices of ``short`` references; diagonal 0 alone in the others."""

    lanes: list[tuple[int, int, int]]
    short: list[tuple[int, int, int]]
    most: np.ndarray  # of each of ``short``: the score of its best path (or the sum over all, if asked for) is no more
    straight: np.ndarray  # references
    score: np.ndarray  # of diagonal 0 of each of ``straight``

    def reaching(self, least: float, all_paths: Callable[[list[int]], np.ndarray]) -> list[tuple[int, int, int]]:
        """Lanes of all that can score ``least``. ``all_paths``: log sums over all paths of short references; none of their paths has more."""
        short = [self.short[k] for k in np.flatnonzero(self.most >= least - 1e-6)]
        if short and least > -np.inf:
            short = [lane for lane, f in zip(short, all_paths([n for n, _, _ in short])) if f >= least - 1e-6]
        near = self.straight[np.isfinite(self.score) & (self.score >= least - 1e-6)]
        return self.lanes + short + [(int(n), 0, 1) for n in near]


def searches(xs: list[np.ndarray], ys: list[np.ndarray], qs: list[np.ndarray | None], scores: Scores, config: EnvelopeConfig, *, local: bool = True, sums: bool = False, at_once: int = 64) -> Iterator[Search]:
    """A ``Search`` of each read: the lanes are those of ``lanes_of``, but diagonals are counted for all reads at once. ``sums``: ``most`` is of all paths."""
    nothing, least = np.empty(0), 2 * (config.k + config.threshold)
    if config.full or config.max_bytes is not None:
        yield from (Search(lanes_of(xs, y, config), [], nothing, np.empty(0, np.int64), nothing) for y in ys)
        return
    index, seeds = SeedIndex(ys, config.k), [{} for _ in ys]
    for n, x in enumerate(xs):
        if len(x) >= least:
            for r, d in zip(*(v.tolist() for v in index.seeds(x, config.threshold))):
                seeds[r].setdefault(n, []).append(d)
    x_len = np.array([len(x) for x in xs], np.int64)
    short, long = np.flatnonzero(x_len < least), np.flatnonzero(x_len >= least)
    for at in range(0, len(ys), at_once):
        some, some_q = ys[at : at + at_once], qs[at : at + at_once]
        direct = straight_scores([xs[n] for n in long], some, some_q, scores, local=local)
        most = most_of_short(some, some_q, scores, least, sums=sums) if len(short) else None
        for r, y in enumerate(some):
            if len(y) < least:
                yield Search(lanes_of(xs, y, config), [], nothing, np.empty(0, np.int64), nothing)
                continue
            own = seeds[at + r]
            lanes = [(n, d, w) for n, ds in own.items() for d, w in envelope(widen(np.array(ds), len(xs[n]), len(y), config.band), len(xs[n]), len(y))]
            alone = ~np.isin(long, list(own))
            yield Search(lanes, [(n, 1 - len(y), len(xs[n]) + len(y) - 1) for n in short.tolist()], most[r, x_len[short]] if len(short) else nothing, long[alone], direct[r, alone])


def lane_groups(lanes: list[tuple[int, int, int]], most_cells: int = 4_000_000) -> Iterator[list[int]]:
    """Places of lanes of like width, so that a sweep holds a bounded number of cells."""
    order = sorted(range(len(lanes)), key=lambda k: lanes[k][2])
    group, width = [], 0
    for k in order:
        width = max(width, lanes[k][2])
        if group and ((len(group) + 1) * width > most_cells // 64 or width > 2 * lanes[group[0]][2] + 16):
            yield group
            group, width = [], lanes[k][2]
        group.append(k)
    if group:
        yield group


def rows_of_path(path: list[tuple[int, int, str]], x: str, y: str, qual: str | None) -> tuple[str, str, str | None]:
    a = "".join("-" if s == "I" else x[i - 1] for i, _, s in path)
    b = "".join("-" if s == "D" else y[j - 1] for _, j, s in path)
    return a, b, None if qual is None else "".join("~" if s == "D" else qual[j - 1] for _, j, s in path)


def align(reads: DataFrame, refs: DataFrame, *, params: Params | None = None, null: NullModel | None = None, config: EnvelopeConfig | None = None, local: bool = True, best_only: bool = True, threshold: float | None = 0.0, use_quals: bool = True, seed: tuple[int, int] | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Every read against every reference: the best alignment of each read, or all. Columns: ALIGNMENT.

    ``refs`` is ``with_revcomps`` of the references, or just those for one strand. A task takes blocks of references and
    blocks of reads, of bounded size; of each such pair only results are shuffled. With ``seed`` (k, n) only those pairs
    are aligned, in the same way, that have n common k-mers on one diagonal; they come from a join, and a read that
    has no such pair is lost. With ``window`` (size, overlap) references are cut into overlapping windows, whose places are
    turned into the reference's again: what a task holds doesn't grow with a reference. An alignment that spans no more
    than the overlap lies in one window; a read that could span more needs a larger one.
    """
    params, config = params or Params.default(), config or EnvelopeConfig()
    null = null or null_model(reads)
    scores = Scores.of(params)
    rows = reads.select(F.col("idx").cast("long").alias("idx"), "name", "seq", (F.col("qual") if use_quals else F.lit(None).cast("string").alias("qual")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ALIGNMENT.split(", ")]
        for found, some in pairs_of(batches):
            xs = [tokens(r["seq"]) for r in found]
            ys, qs = [tokens(r["seq"]) for r in some], [quals(r["qual"], len(r["seq"])) for r in some]
            got: list[tuple] = []
            for read, y, q, search in zip(some, ys, qs, searches(xs, ys, qs, scores, config, local=local)):
                base = null.log_likelihood(y, q)
                # what can't reach the threshold, or another reference's score where only the best counts, isn't swept
                least = -np.inf if threshold is None else threshold + base
                least = max(least, search.score.max(initial=-np.inf)) if best_only else least
                lanes = search.reaching(least, lambda of: short_forward([xs[n] for n in of], y, q, scores, local=local))  # noqa: B023
                score = np.full(len(lanes), -np.inf)
                for group in lane_groups(lanes):
                    score[group] = Sweep(y, q, xs, [lanes[k] for k in group], scores, local=local).viterbi(trace=False)[0]
                best: dict[int, int] = {}
                for k, (n, _, _) in enumerate(lanes):
                    if np.isfinite(score[k]) and (n not in best or score[k] > score[best[n]]):
                        best[n] = k
                chosen = sorted(best, key=lambda n: (-score[best[n]], n))
                for n in chosen[:1] if best_only else chosen:
                    if threshold is not None and score[best[n]] - base < threshold:
                        continue
                    sweep = Sweep(y, q, xs, [lanes[best[n]]], scores, local=local)
                    raw, end, back = sweep.viterbi()
                    path = sweep.path(0, int(end[0]), back)
                    seq = found[n]["seq"]
                    a, b, quality = rows_of_path(path, seq, read["seq"], read["qual"] if q is not None else None)
                    for ref in found[n]["copies"][:1] if best_only else found[n]["copies"]:
                        before, full = ref.get("offset") or 0, ref.get("full") or len(seq)
                        start, stop = before + path[0][0], before + path[-1][0]
                        if ref["rev"]:
                            start, stop = full - stop + 1, full - start + 1
                        got.append((ref["idx"], ref["origin"], read["idx"], read["name"], float(raw[0]), base, float(raw[0]) - base, a, b, quality, start, stop, ref["rev"], 1, len(y)))
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
            types = [kinds[f.split()[1]] for f in ALIGNMENT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(types)], names)

    found, parts = reference_rows(refs), reference_parts(refs)
    found = reference_windows(found, *window) if window else found
    if seed:
        pairs = sq.seed_diagonals(sq.diagonal_counts(refs, reads, seed[0]), seed[1]).select("x_idx", "y_idx").distinct()
        both = pairs.join(found.select(F.col("idx").alias("x_idx"), F.struct(*found.columns).alias("x")), "x_idx")
        both = both.join(rows.select(F.col("idx").alias("y_idx"), F.struct("idx", "name", "seq", "qual").alias("y")), "y_idx")
        blocks = both.repartition(parts, "x_idx", "y_idx").select(F.array("x").alias("refs"), F.array("y").alias("reads"))
    else:
        blocks = block_pairs(rows, found, parts)
    out = blocks.mapInArrow(run, ALIGNMENT)
    if window:  # what lies in two windows is found twice
        pair = Window.partitionBy("y_idx", "x_idx").orderBy(F.desc("score"), "ref_start")
        out = out.withColumn("__n", F.row_number().over(pair)).filter("__n = 1").drop("__n")
    return sq.best_per_group(out, "y_idx", "score", "x_idx") if best_only else out


def pair_rows(pairs: DataFrame) -> DataFrame:
    """``pairs`` (x_idx, x_seq, y_idx, y_seq) dealt over a stated number of partitions: by bytes alone, many short pairs would share a task."""
    spark = pairs.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pairs.select(F.col("x_idx").cast("long").alias("x_idx"), "x_seq", F.col("y_idx").cast("long").alias("y_idx"), "y_seq")
    return rows.repartition(parts, "x_idx", "y_idx")


def pair_sweeps(batch: pa.RecordBatch, scores: Scores, config: EnvelopeConfig, local: bool, most_cells: int = 4_000_000) -> Iterator[tuple[np.ndarray, PairSweep]]:
    """Rows of ``batch``, and a sweep over all their lanes: reads of one length together, no more at once than about ``most_cells`` cells (or one pair)."""
    xs, ys = ([tokens(s) for s in batch[c].to_pylist()] for c in ("x_seq", "y_seq"))
    sizes = np.array([len(y) for y in ys], np.int64)
    for size in np.unique(sizes).tolist():
        rows, lanes, cells = [], [], 0
        for n in [*np.flatnonzero(sizes == size).tolist(), None]:
            own = [] if n is None else envelope(config.diagonals(xs[n], ys[n]), len(xs[n]), size)
            more = sum(w for _, w in own) * 2 * (2 * size + max((w for _, w in own), default=0))
            if rows and (n is None or cells + more > most_cells or max(w for _, w in own) > 2 * lanes[0][2] + 16):
                yield np.array(rows), PairSweep(np.stack([ys[r] for r in rows]), [xs[r] for r in rows], lanes, scores, local=local)
                rows, lanes, cells = [], [], 0
            lanes += [(len(rows), d, w) for d, w in own]
            rows, cells = [*rows, n], cells + more


def pair_scores(pairs: DataFrame, *, params: Params | None = None, config: EnvelopeConfig | None = None, local: bool = True, of: tuple[str, ...] = ("viterbi", "forward")) -> DataFrame:
    """For each row (x_idx, x_seq, y_idx, y_seq), without qualities: score of the best path and log likelihood over all paths, or the one of them in ``of``."""
    scores, config = Scores.of(params or Params.default()), config or EnvelopeConfig(full=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {name: np.full(batch.num_rows, -np.inf) for name in of}
            for rows, sweep in pair_sweeps(batch, scores, config, local):
                if "viterbi" in got:
                    np.maximum.at(got["viterbi"], rows[sweep.owner], sweep.viterbi(trace=False)[0])
                if "forward" in got:
                    np.logaddexp.at(got["forward"], rows[sweep.owner], sweep.forward()[0])
            yield pa.RecordBatch.from_arrays([batch["x_idx"], batch["y_idx"], *map(pa.array, got.values())], ["x_idx", "y_idx", *got])

    return pair_rows(pairs).mapInArrow(run, ", ".join(["x_idx long, y_idx long", *(f"{name} double" for name in of)]))


def pair_cells(pairs: DataFrame, *, params: Params | None = None, config: EnvelopeConfig | None = None, local: bool = True, bases: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """The matrix of each row (x_idx, x_seq, y_idx, y_seq), without qualities: a row a cell inside the envelope.

    x_idx, y_idx, i, j, log sums over all paths up to the cell (mat, ins, del), and the probability of each state there given
    the pair (post_match, post_insert, post_delete). Lanes of an envelope are summed apart and weighted by their share.
    With ``bases`` also ref_base and read_base, those at i and j. ``only``: the columns that leave the task, where not all are wanted.
    """
    scores, config = Scores.of(params or Params.default()), config or EnvelopeConfig(full=True)
    names = ["x_idx", "y_idx", "i", "j", "mat", "ins", "del", "post_match", "post_insert", "post_delete", *(["ref_base", "read_base"] if bases else [])]
    letters = list(dna.BASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sweep in pair_sweeps(batch, scores, config, local, 1_000_000):
                lanes, kept = sweep.forward(keep=True)
                whole = np.full(len(rows), -np.inf)
                np.logaddexp.at(whole, sweep.owner, lanes)
                cells: list = []
                sweep.backward_counts(kept, lanes, cells)
                lane, i, j, mat, ins, dele, *posts = (np.concatenate(c) for c in zip(*cells)) if cells else [np.zeros(0, np.int64)] * 9
                there = np.isfinite(whole[sweep.owner[lane]])
                of = sweep.owner[lane[there]]
                weight = np.exp(lanes[lane[there]] - whole[of])
                row = pa.array(rows[of])
                columns = (i.astype(np.int32), j.astype(np.int32), mat, ins, dele)
                codes = (sweep.x[lane, i - 1 - sweep.base[lane, 0]], sweep.reads[lane, j - 1]) if bases else ()
                whole_row = pa.RecordBatch.from_arrays([batch["x_idx"].take(row), batch["y_idx"].take(row), *(pa.array(c[there]) for c in columns), *(pa.array(np.nan_to_num(q[there]) * weight) for q in posts), *(pa.array(letters).take(pa.array(c[there].astype(np.int64))) for c in codes)], names)
                yield whole_row.select(list(only)) if only else whole_row

    kinds = dict(zip(names, ["long"] * 2 + ["int"] * 2 + ["double"] * 6 + ["string"] * 2))
    return pair_rows(pairs).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in only or names))


def cell_lines(cells: DataFrame) -> DataFrame:
    """A text line for each cell: place and the three log sums."""
    number = lambda c: F.format_string("%.6g", F.col(c))
    return cells.select("x_idx", "y_idx", "i", "j", F.concat(F.lit("i="), F.col("i"), F.lit(" j="), F.col("j"), F.lit("\tmat "), number("mat"), F.lit("\tins "), number("ins"), F.lit("\tdel "), number("del")).alias("value"))


def overlap(seqs: DataFrame, originals: int, *, params: Params | None = None, null: NullModel | None = None, config: EnvelopeConfig | None = None, threshold: float | None = 0.0, compat: bool = True, require_seed: bool = False) -> DataFrame:
    """Overlaps of reads. ``seqs``: originals, then their reverse complements (``with_revcomps``).

    All pairs are searched, unless ``require_seed``: then only those with a diagonal of ``config.threshold`` common k-mers,
    found by a join instead of from every pair, which loses overlaps without such a diagonal.
    """
    params, config = params or Params.default(), config or EnvelopeConfig(threshold=14)
    null = null or null_model(seqs)
    scores = Scores.of(params)
    if require_seed:
        seeds = sq.seed_diagonals(sq.diagonal_counts(seqs.filter(F.col("idx") <= originals - 2), seqs, config.k), config.threshold)
        pairs = seeds.filter("x_idx < y_idx").select("x_idx", "y_idx").distinct().withColumn("y_complemented", F.col("y_idx") >= originals)
    else:
        pairs = sq.triangular_pairs(seqs, originals)
    side = lambda x: seqs.select(*(F.col(c).alias(f"{x}_{c}") for c in ("idx", "name", "seq", "qual")))
    full = pairs.join(side("x"), "x_idx").join(side("y"), "y_idx").select("x_idx", "x_name", "x_seq", "x_qual", "y_idx", "y_name", "y_seq", "y_qual", "y_complemented")
    schema = "x_idx long, x_name string, y_idx long, y_name string, y_complemented boolean, raw double, null_ll double, score double, x_row string, y_row string, x_start int, x_end int, y_start int, y_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for r in batch.to_pylist():
                x, y = tokens(r["x_seq"]), tokens(r["y_seq"])
                xq, yq = quals(r["x_qual"], len(x)), quals(r["y_qual"], len(y))
                raw, path = OverlapSweep(x, xq, y, yq, params, scores, config.diagonals(x, y), complemented=r["y_complemented"], compat=compat).run()
                turned = r["y_complemented"]
                base = null.log_likelihood(x, xq) + null.log_likelihood(3 - y[::-1] if turned else y, None if yq is None else yq[::-1] if turned else yq)
                if not path or threshold is not None and raw - base < threshold:
                    continue
                a, b = squashed(path, r["x_seq"], r["y_seq"])
                got.append((r["x_idx"], r["x_name"], r["y_idx"], r["y_name"], turned, raw, base, raw - base, a, b, path[0][0], path[-1][0], path[0][1], path[-1][1]))
            names, types = zip(*(f.split() for f in schema.split(", ")))
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kinds[t]) for k, t in enumerate(types)], list(names))

    # a stated number of partitions: by bytes alone, many pairs of short reads would share a task
    spark = seqs.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return full.repartition(parts, "x_idx", "y_idx").mapInArrow(run, schema)


def squashed(path: list[tuple[int, int, str]], x: str, y: str) -> tuple[str, str]:
    """Rows of an overlap: neighbouring runs of insertions and deletions stand side by side as far as both go."""
    a, b, k = [], [], 0
    while k < len(path):
        if path[k][2] == "M":
            a.append(x[path[k][0] - 1])
            b.append(y[path[k][1] - 1])
            k += 1
            continue
        dele, ins = "", ""
        while k < len(path) and path[k][2] != "M":
            i, j, state = path[k]
            dele, ins = (dele + x[i - 1], ins) if state == "D" else (dele, ins + y[j - 1])
            k += 1
        both = min(len(dele), len(ins))
        a.append(dele + "-" * (len(ins) - both))
        b.append(ins + "-" * (len(dele) - both))
    return "".join(a), "".join(b)


# Text forms of alignments


def sam_lines(alignments: DataFrame) -> DataFrame:
    """One line each; rows of reversed references are turned, so that positions run along the forward strand."""
    ref, read = (F.when(F.col("ref_rev"), dna.revcomp(F.col(c))).otherwise(F.col(c)) for c in ("ref_row", "read_row"))
    flag = F.when(F.col("ref_rev"), 16).otherwise(0)
    fields = [F.col("y_name"), flag.cast("string"), F.col("x_name"), F.col("ref_start").cast("string"), F.lit("0"), dna.cigar(ref, read), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("AS:i:"), F.round("score").cast("long").cast("string"))]
    return alignments.select("y_idx", "x_idx", F.concat_ws("\t", *fields).alias("value"))


def sam_header(refs: DataFrame, *, by_query: bool = False) -> DataFrame:
    """Header lines with their order; references that are reverse complements have none."""
    spark = refs.sparkSession
    top = spark.createDataFrame([(-1, "@HD\tVN:1.0\t" + ("GO:query" if by_query else "SO:unknown"))], "ord long, value string")
    return top.union(refs.filter("is_orig").select(F.col("idx").cast("long"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.length("seq").cast("string")))))


def gapped_fasta(alignments: DataFrame) -> DataFrame:
    where = F.concat(F.lit("substr("), "x_name", F.lit(","), F.col("ref_start").cast("string"), F.lit(".."), F.col("ref_end").cast("string"), F.lit(")"))
    return alignments.select("y_idx", "x_idx", F.concat(F.lit(">Ref "), where, F.lit("\n"), "ref_row", F.lit("\n>Read "), "y_name", F.lit("\n"), "read_row", F.lit("\n")).alias("value"))


def refseq_fasta(alignments: DataFrame) -> DataFrame:
    """The matching part of each reference, without gaps."""
    name = F.concat(F.lit(">"), "x_name", F.lit(" matches("), "y_name", F.lit(")"))
    return alignments.select("y_idx", "x_idx", F.concat(name, F.lit("\n"), dna.ungap(F.col("ref_row"))).alias("value"))


def stockholm(alignments: DataFrame) -> DataFrame:
    """Stockholm blocks with the consensus between the rows and the read's qualities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_stockholm(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["y_idx"], batch["x_idx"], pa.array(out, pa.string())], ["y_idx", "x_idx", "value"])

    same = dna.consensus(F.col("ref_row"), F.col("read_row")).alias("same")
    return alignments.select("y_idx", "x_idx", "x_name", "y_name", "score", "ref_row", "read_row", "qual_row", "ref_start", "ref_end", same).mapInArrow(run, "y_idx long, x_idx long, value string")


def _stockholm(r: dict) -> str:
    rows = [("Ref", r["ref_row"]), ("#=GC id", r["same"]), ("Read", r["read_row"])] + ([("#=GR Read QS", r["qual_row"])] if r["qual_row"] else [])
    name = max(len(n) for n, _ in rows) + 1
    step = max(name, 79 - name)
    out = ["# STOCKHOLM 1.0", f"#=GF Score {r['score']:.6g}", f"#=GS CC Ref substr({r['x_name']},{r['ref_start']}..{r['ref_end']})", f"#=GS CC Read {r['y_name']}"]
    for at in range(0, len(r["ref_row"]), step):
        out += ["", *(f"{n:<{name}}{row[at : at + step]}" for n, row in rows)]
    return "\n".join([*out, "//"])
