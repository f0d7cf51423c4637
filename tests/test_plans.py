"""Storage rows, seeded alignment and overlaps with known places."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom import catalog
from seqloom.operators import sequences as sq
from seqloom.operators.align import align

SF = "/root/testdata/sf0.001"


def test_stored_diagonals_have_both_neighbours(spark):
    pairs = spark.createDataFrame([(1, 2, 4, 3, [0, 3])], "x_idx long, y_idx long, x_len int, y_len int, diagonals array<int>")
    got = [(r["j"], r["cells"], r["offset"], r["first"]) for r in sq.storage_layout(pairs).orderBy("j").collect()]
    stored, at, expected = [-1, 0, 1, 2, 3, 4], 0, []
    for j in range(4):
        inside = [d for d in stored if 0 <= d + j <= 4]
        expected.append((j, len(inside), at, stored.index(inside[0])))
        at += len(inside)
    assert got == expected


@pytest.mark.parametrize("name", ["posterior_cells", "expected_emissions", "memory_thresholds", "diagonal_counts", "storage_layout", "quality_histogram", "nb_moment_fit", "viterbi_scores", "forward_likelihoods", "posterior_mass"])
def test_queries_equal_their_sql(spark, name):
    got = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    wanted = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_seeded_alignment_finds_what_all_pairs_find(spark):
    refs = sq.with_revcomps(catalog.references(spark, SF).filter(F.length("seq").between(300, 1500)).orderBy("idx").limit(12), 1_000_000_000).cache()
    own = [r for r in refs.filter("is_orig").orderBy("idx").collect() if len(r["seq"]) > 200][:5]
    cut = [(i, f"r{i}", r["seq"][40:160], "I" * 120) for i, r in enumerate(own)]
    reads = spark.createDataFrame(cut, "idx long, name string, seq string, qual string")
    columns = ["y_idx", "x_idx", "score", "ref_start", "ref_end", "ref_rev", "ref_row", "read_row"]
    every, seeded = (sorted(map(tuple, align(reads, refs, seed=s, threshold=None).select(*columns).collect())) for s in (None, (12, 8)))
    assert every == seeded and len(every) == 5


def test_overlaps_have_the_places_they_were_cut_from(spark):
    some, n = catalog.overlapping_reads(spark, SF)
    size = {r["idx"]: len(r["seq"]) for r in some.collect()}
    whole = {r["idx"]: len(r["seq"]) for r in catalog.reads(spark, SF).collect()}
    got = {(r["x_idx"], r["y_idx"]): r for r in catalog.overlap_seeded(spark, SF).collect()}
    found = 0
    for i, length in whole.items():
        r = got.get((2 * i, 2 * i + 1 + (n if i % 2 else 0)))
        if r:
            found += abs(r["x_start"] - (int(length * 0.3) + 1)) <= 5 and abs(r["x_end"] - size[2 * i]) <= 5
    assert found >= 0.9 * len(whole)


def test_cells_are_those_of_plain_recursions_and_enumerated_paths(spark):
    """Posteriors against all paths through a tiny matrix, one by one."""
    import math

    import numpy as np

    from seqloom.operators.align import cell_lines, pair_cells
    from seqloom.operators.kernels import Scores, tokens
    from seqloom.plans.model import Params

    x, y, s = "ACGT", "AGT", Scores.of(Params.default())
    tx, ty = tokens(x), tokens(y)
    paths: list = []

    def walk(i, j, state, p, seen):
        if j == len(y) and state == "M":
            paths.append((p + s.m2e[0], seen))
        step = {"M": (s.m2m[0], s.m2i[0], s.m2d[0]), "I": (s.i2m, s.i2i, None), "D": (s.d2m, None, s.d2d)}[state]
        if i < len(x) and j < len(y):
            walk(i + 1, j + 1, "M", p + step[0] + s.match[tx[i], ty[j], -1], [*seen, (i + 1, j + 1, "M")])
        if j < len(y) and step[1] is not None:
            walk(i, j + 1, "I", p + step[1] + s.insert[ty[j], -1], [*seen, (i, j + 1, "I")])
        if i < len(x) and step[2] is not None:
            walk(i + 1, j, "D", p + step[2], [*seen, (i + 1, j, "D")])

    for i in range(len(x)):
        walk(i + 1, 1, "M", s.match[tx[i], ty[0], -1], [(i + 1, 1, "M")])
    total = np.logaddexp.reduce([p for p, _ in paths])
    pairs = spark.createDataFrame([(1, x, 2, y)], "x_idx long, x_seq string, y_idx long, y_seq string")
    cells = pair_cells(pairs)
    for r in cells.collect():
        for state, name in (("M", "post_match"), ("I", "post_insert"), ("D", "post_delete")):
            wanted = sum(math.exp(p - total) for p, seen in paths if (r["i"], r["j"], state) in seen)
            assert r[name] == pytest.approx(wanted, abs=1e-9)
    assert cell_lines(cells).filter("value like 'i=1 j=1%mat%ins%del%'").count() == 1
