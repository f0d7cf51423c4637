"""Named queries of the sequence engine, and the SQL that checks them.

References are the ``documents`` as DNA, reads are the ``benchmark`` items.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import sequences as sq

K = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sq.from_text(docs.select(F.col("doc_id").alias("idx"), F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("seq"), F.lit(None).cast("string").alias("qual")))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with made-up qualities: (7 * letter code + position) mod 40."""
    items = table(spark, sf_dir, "benchmark")
    seq = items.select(F.col("item_id").alias("idx"), F.concat(F.lit("b"), "item_id").alias("name"), dna.dna_of_text(F.col("text")).alias("seq"))
    qual = F.array_join(F.transform(F.split("seq", ""), lambda c, i: F.when(c == "", "").otherwise(F.char((F.ascii(c) * 7 + i + 1) % 40 + 33))), "")
    return sq.drop_empty(seq.withColumn("qual", qual))


def short_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 bases for each customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"), F.translate(F.upper(F.md5(F.col("c_custkey").cast("string"))), "0123456789ABCDEF", "ACGTACGTACGTACGT").alias("seq"))


DNA_SQL = "translate(regexp_replace(lower({0}), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
REFS_SQL = f"refs AS (SELECT doc_id AS idx, {DNA_SQL.format('text')} AS seq FROM documents WHERE length({DNA_SQL.format('text')}) > 0)"
READS_SQL = f"reads AS (SELECT item_id AS idx, {DNA_SQL.format('text')} AS seq FROM benchmark WHERE length({DNA_SQL.format('text')}) > 0)"
SHORT_SQL = "short AS (SELECT c_custkey AS idx, c_name AS name, translate(upper(md5(c_custkey::VARCHAR)), '0123456789ABCDEF', 'ACGTACGTACGTACGT') AS seq FROM customer)"
QUALITY_SQL = "(ascii(substr(seq, i::INT, 1)) * 7 + i) % 40"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


@query("SELECT doc_id AS idx, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM (SELECT doc_id, " + DNA_SQL.format("text") + " AS seq FROM documents) WHERE length(seq) > 0")
def revcomp(spark, sf_dir):
    return references(spark, sf_dir).select("idx", dna.revcomp(F.col("seq")).alias("rc"))


@query(f"""WITH {REFS_SQL} SELECT idx, 'd' || idx AS name, length(seq)::BIGINT AS len, md5(seq) AS digest, true AS is_orig, NULL::VARCHAR AS source_name, NULL::INT AS source_end FROM refs
UNION ALL SELECT idx + 1000000, 'revcomp(d' || idx || ')', length(seq)::BIGINT, md5(reverse(translate(seq, 'ACGT', 'TGCA'))), false, 'd' || idx, length(seq)::INT FROM refs""")
def both_strands(spark, sf_dir):
    both = sq.with_revcomps(references(spark, sf_dir), 1_000_000)
    return both.select("idx", "name", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"), "is_orig", F.col("source.name").alias("source_name"), F.col("source.end").alias("source_end"))


@query(f"""WITH {SHORT_SQL} SELECT idx, sum((instr('ACGT', substr(seq, i::INT, 1)) - 1) * i)::BIGINT AS weighted FROM short, range(1, 33) r(i) GROUP BY idx""")
def tokenized(spark, sf_dir):
    t = short_seqs(spark, sf_dir).select("idx", dna.tokens(F.col("seq")).alias("t"))
    return t.select("idx", F.aggregate(F.transform("t", lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"))


@query(f"""WITH {SHORT_SQL}, k AS (SELECT idx, i::INT AS pos, substr(seq, (i + 1)::INT, 12) AS kmer FROM short, range(0, 21) r(i))
SELECT idx, pos, kmer AS decoded, (SELECT sum((instr('ACGT', substr(kmer, j::INT, 1)) - 1) * pow(4, 12 - j))::BIGINT FROM range(1, 13) t(j)) AS code FROM k""")
def kmer_codes(spark, sf_dir):
    k = sq.kmer_index(short_seqs(spark, sf_dir), 12).withColumn("code", dna.kmer_encode(F.col("kmer")))
    return k.select("idx", "pos", dna.kmer_decode(F.col("code"), 12).alias("decoded"), "code")


@query(f"""WITH {SHORT_SQL}, c AS (SELECT idx, seq, base, len(string_split(seq, base)) - 1 AS n, instr('ACGT', base) AS o FROM short, (VALUES ('A'), ('C'), ('G'), ('T')) b(base)),
m AS (SELECT idx, seq, arg_max(base, n * 10 - o) AS base FROM c GROUP BY ALL)
SELECT idx, string_agg(substr(base || base || seq, i::INT, 3), ',' ORDER BY i) AS contexts FROM m, range(1, 33) r(i) GROUP BY idx""")
def context_kmers(spark, sf_dir):
    return short_seqs(spark, sf_dir).select("idx", F.array_join(dna.context_kmers(F.col("seq"), 3), ",").alias("contexts"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 1 THEN 1000 - (l_suppkey % 50 + l_linenumber) + 1 ELSE l_suppkey % 50 + 1 + 100 - 1 END::BIGINT AS c_start,
CASE WHEN l_partkey % 2 = 1 THEN 1000 - (l_suppkey % 50 + 1) + 1 ELSE l_suppkey % 50 + l_linenumber + 100 - 1 END::BIGINT AS c_end, (l_partkey % 2 = 1) != (l_linenumber % 2 = 1) AS c_rev FROM lineitem""")
def composed_intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    inner = F.struct(F.lit("sub").alias("name"), (F.col("l_suppkey") % 50 + 1).alias("start"), (F.col("l_suppkey") % 50 + F.col("l_linenumber")).alias("end"), (F.col("l_linenumber") % 2 == 1).alias("rev"))
    outer = F.struct(F.lit("root").alias("name"), F.lit(100).cast("long").alias("start"), F.lit(1000).cast("long").alias("end"), (F.col("l_partkey") % 2 == 1).alias("rev"))
    c = rows.withColumn("c", dna.compose(inner, outer))
    return c.select("l_orderkey", "l_linenumber", F.col("c.start").alias("c_start"), F.col("c.end").alias("c_end"), F.col("c.rev").alias("c_rev"))


@query(f"""WITH {REFS_SQL}, n AS (SELECT base, sum(len(string_split(seq, base)) - 1)::BIGINT AS n FROM refs, (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY base)
SELECT base, n, round(n / sum(n) OVER (), 9) AS share FROM n""")
def base_composition(spark, sf_dir):
    return sq.base_composition(references(spark, sf_dir))


@query(f"""WITH {READS_SQL}, p AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM reads)
SELECT substr(seq, i::INT, 1) AS base, ({QUALITY_SQL})::INT AS q, count(*) AS n FROM p GROUP BY ALL""")
def quality_histogram(spark, sf_dir):
    return sq.quality_histogram(reads(spark, sf_dir))


@query("""SELECT l_returnflag, count(*)::DOUBLE AS n, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 6) AS variance FROM lineitem GROUP BY l_returnflag""")
def histogram_moments(spark, sf_dir):
    hist = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("int").alias("k")).agg(F.count("*").alias("f"))
    m = sq.histogram_moments(hist, ["l_returnflag"], "k", "f")
    return m.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("""WITH m AS (SELECT l_linestatus, avg(l_quantity) AS mean, avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity) AS var FROM lineitem GROUP BY l_linestatus),
f AS (SELECT l_linestatus, mean / var AS p, mean * (mean / var) / (1 - mean / var) AS r FROM m)
SELECT l_linestatus, round(p, 6) AS p, round(r, 6) AS r, round(r * (1 - p) / p, 6) AS nb_mean, round(r * (1 - p) / (p * p), 6) AS nb_variance FROM f""")
def nb_moment_fit(spark, sf_dir):
    hist = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.col("l_quantity").cast("int").alias("k")).agg(F.count("*").alias("f"))
    from .functions.stats import moment_fit

    m = sq.histogram_moments(hist, ["l_linestatus"], "k", "f").collect()  # a row a status
    fits = [(r["l_linestatus"], *map(float, moment_fit(r["mean"], r["variance"]))) for r in m]
    f = spark.createDataFrame(fits, "l_linestatus string, p double, r double")
    return f.select("l_linestatus", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(dna.nb_mean(F.col("p"), F.col("r")), 6).alias("nb_mean"), F.round(dna.nb_variance(F.col("p"), F.col("r")), 6).alias("nb_variance"))


def kmer_sql(name: str, k: int) -> str:
    return f"SELECT idx, i::INT AS pos, substr(seq, (i + 1)::INT, {k}) AS kmer FROM (SELECT idx, seq, unnest(range(0, greatest(length(seq) - {k} + 1, 0))) AS i FROM {name})"


DIAG_K = 12
DIAGS_SQL = f"""{REFS_SQL}, {READS_SQL}, kx AS ({kmer_sql('refs', DIAG_K)}), ky AS ({kmer_sql('reads', DIAG_K)}),
diags AS (SELECT kx.idx AS x_idx, ky.idx AS y_idx, kx.pos - ky.pos AS diag, count(*) AS cnt FROM kx JOIN ky ON kx.kmer = ky.kmer GROUP BY ALL)"""


@query(f"WITH {DIAGS_SQL} SELECT * FROM diags")
def diagonal_counts(spark, sf_dir):
    return sq.diagonal_counts(references(spark, sf_dir), reads(spark, sf_dir), DIAG_K, ids=table(spark, sf_dir, "documents").select("doc_id"))


@query(f"WITH {DIAGS_SQL} SELECT x_idx, y_idx, cnt, array_to_string(list_sort(list(diag)), ',') AS diagonals FROM diags GROUP BY x_idx, y_idx, cnt")
def count_distribution(spark, sf_dir):
    d = sq.count_distribution(diagonal_counts(spark, sf_dir))
    return d.select("x_idx", "y_idx", "cnt", F.array_join(F.col("diagonals").cast("array<string>"), ",").alias("diagonals"))


@query(f"WITH {DIAGS_SQL} SELECT * FROM diags WHERE cnt >= 14")
def seed_diagonals(spark, sf_dir):
    return sq.seed_diagonals(diagonal_counts(spark, sf_dir), 14)


@query(f"""WITH {DIAGS_SQL}, p AS (SELECT d.*, length(x.seq) AS x_len, length(y.seq) AS y_len FROM diags d JOIN refs x ON x.idx = d.x_idx JOIN reads y ON y.idx = d.y_idx),
lv AS (SELECT DISTINCT x_idx, y_idx, x_len, y_len, cnt AS level FROM p),
st AS (SELECT lv.x_idx, lv.y_idx, lv.x_len, lv.y_len, level, list_distinct(list_concat([-1, 0, 1], flatten(list(range(greatest(diag - 32, 1 - p.y_len) - 1, least(diag + 32, p.x_len - 1) + 2))))) AS ds
  FROM lv JOIN p ON p.x_idx = lv.x_idx AND p.y_idx = lv.y_idx AND p.cnt >= level GROUP BY ALL)
SELECT x_idx, y_idx, min(CASE WHEN len(ds) * least(x_len, y_len) * 24 < 600000 THEN level END)::BIGINT AS threshold,
  coalesce(max(CASE WHEN len(ds) * least(x_len, y_len) * 24 < 600000 THEN len(ds) END), 3)::BIGINT AS stored FROM st GROUP BY x_idx, y_idx""")
def memory_thresholds(spark, sf_dir):
    x, y = references(spark, sf_dir), reads(spark, sf_dir)
    lx, ly = x.select(F.col("idx").alias("x_idx"), F.length("seq").alias("x_len")), y.select(F.col("idx").alias("y_idx"), F.length("seq").alias("y_len"))
    return sq.memory_thresholds(diagonal_counts(spark, sf_dir), lx, ly, band=64, max_bytes=600_000)


BANDS_SQL = f"""{DIAGS_SQL}, s AS (SELECT d.x_idx, d.y_idx, length(x.seq) AS x_len, length(y.seq) AS y_len, d.diag FROM diags d JOIN refs x ON x.idx = d.x_idx JOIN reads y ON y.idx = d.y_idx WHERE cnt >= 14),
w AS (SELECT x_idx, y_idx, x_len, y_len, unnest(range(greatest(diag - 32, 1 - y_len), least(diag + 32, x_len - 1) + 1)) AS d FROM s UNION SELECT x_idx, y_idx, x_len, y_len, 0 FROM s),
env AS (SELECT x_idx, y_idx, any_value(x_len) AS x_len, any_value(y_len) AS y_len, list_sort(list(d)) AS ds FROM w GROUP BY x_idx, y_idx)"""


def _bands(spark, sf_dir):
    x, y = references(spark, sf_dir), reads(spark, sf_dir)
    lx, ly = x.select(F.col("idx").alias("x_idx"), F.length("seq").alias("x_len")), y.select(F.col("idx").alias("y_idx"), F.length("seq").alias("y_len"))
    return sq.bands(seed_diagonals(spark, sf_dir), lx, ly, 64), lx, ly


@query(f"WITH {BANDS_SQL} SELECT x_idx, y_idx, array_to_string(ds, ',') AS diagonals FROM env")
def band_envelopes(spark, sf_dir):
    return _bands(spark, sf_dir)[0].select("x_idx", "y_idx", F.array_join(F.col("diagonals").cast("array<string>"), ",").alias("diagonals"))


@query(f"""WITH {BANDS_SQL}, p AS (SELECT x_idx, y_idx, x_len, y_len, list_sort(list_distinct(flatten(list_transform(ds, lambda d: [d - 1, d, d + 1])))) AS stored FROM env),
r AS (SELECT x_idx, y_idx, x_len, stored, unnest(range(0, y_len + 1)) AS j FROM p),
c AS (SELECT x_idx, y_idx, j, stored, list_filter(stored, lambda d: d + j >= 0 AND d + j <= x_len) AS inside FROM r)
SELECT x_idx, y_idx, j::INT AS j, len(inside)::BIGINT AS cells, coalesce(sum(len(inside)) OVER (PARTITION BY x_idx, y_idx ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
CASE WHEN len(inside) > 0 THEN list_position(stored, inside[1]) - 1 ELSE -1 END::INT AS first FROM c""")
def storage_layout(spark, sf_dir):
    env, lx, ly = _bands(spark, sf_dir)
    return sq.storage_layout(env.join(lx, "x_idx").join(ly, "y_idx"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier),
a AS (SELECT idx FROM s UNION ALL SELECT idx + n FROM s, n)
SELECT x.idx AS x_idx, y.idx AS y_idx, y.idx >= n AS y_complemented FROM a x, a y, n WHERE x.idx < y.idx AND x.idx <= n - 2""")
def overlap_pairs(spark, sf_dir):
    keys = sq.numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("idx")
    n = keys.count()
    return sq.triangular_pairs(keys.union(keys.select(F.col("idx") + n)), n)


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS idx, text AS seq, coalesce(sum(length(text)) OVER (ORDER BY conv_id * 1000 + turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT idx, length(seq)::BIGINT AS len FROM c WHERE before < 20000""")
def training_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("seq"))
    return sq.training_prefix(rows, 20_000).select("idx", F.length("seq").cast("long").alias("len"))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return sq.duplicate_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


EVIDENCE_SQL = "e AS (SELECT user_id, max(value) + ln(sum(exp(value - m))) AS log_evidence FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id)"


@query(f"WITH {EVIDENCE_SQL} SELECT user_id, round(log_evidence, 6) AS log_evidence FROM e")
def log_evidence(spark, sf_dir):
    return sq.evidence(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("log_evidence", 6).alias("log_evidence"))


@query(f"WITH {EVIDENCE_SQL} SELECT event_id, round(exp(value - log_evidence), 6) AS posterior FROM events JOIN e USING (user_id)")
def posterior_weights(spark, sf_dir):
    return sq.posteriors(table(spark, sf_dir, "events"), "user_id", "value").select("event_id", F.round("posterior", 6).alias("posterior"))


@query(f"WITH {EVIDENCE_SQL} SELECT event_id FROM events JOIN e USING (user_id) WHERE value >= log_evidence - 20")
def pruned_pairs(spark, sf_dir):
    return sq.survivors(table(spark, sf_dir, "events"), "user_id", "value").select("event_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_hit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sq.best_per_group(o, "o_custkey", "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders")
def ranked_hits(spark, sf_dir):
    return sq.ranked(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


#: Two rows of a made-up alignment of each customer's sequence: gaps where md5 digits are low.
ROWS_SQL = f"""{SHORT_SQL}, cols AS (SELECT idx, i, substr(seq, i::INT, 1) AS base, substr(md5('x' || idx), i::INT, 1) AS h FROM short, range(1, 33) r(i)),
ops AS (SELECT idx, i, CASE WHEN h IN ('0', '1') THEN '-' ELSE base END AS a, CASE WHEN h IN ('2', '3') THEN '-' WHEN h = '4' THEN translate(base, 'ACGT', 'CGTA') ELSE base END AS b FROM cols)"""


def _rows(spark, sf_dir):
    h = F.split(F.md5(F.concat(F.lit("x"), F.col("idx").cast("string"))), "")
    s = short_seqs(spark, sf_dir).select("idx", F.arrays_zip(F.split("seq", "").alias("base"), h.alias("h")).alias("c"))
    a = F.array_join(F.transform("c", lambda x: F.when(x["h"].isin("0", "1"), "-").otherwise(x["base"])), "")
    b = F.array_join(F.transform("c", lambda x: F.when(x["h"].isin("2", "3"), "-").when(x["h"] == "4", F.translate(x["base"], "ACGT", "CGTA")).otherwise(x["base"])), "")
    return s.select("idx", a.alias("ref_row"), b.alias("read_row"))


@query(f"""WITH {ROWS_SQL}, o AS (SELECT idx, i, CASE WHEN a = '-' THEN 'I' WHEN b = '-' THEN 'D' ELSE 'M' END AS op FROM ops),
g AS (SELECT idx, i, op, row_number() OVER (PARTITION BY idx ORDER BY i) - row_number() OVER (PARTITION BY idx, op ORDER BY i) AS island FROM o),
runs AS (SELECT idx, op, min(i) AS s, count(*) AS n FROM g GROUP BY idx, op, island)
SELECT idx, string_agg(n || op, '' ORDER BY s) AS cigar, string_agg(op || n, '' ORDER BY s) AS cigar_op_first FROM runs GROUP BY idx""")
def cigar_strings(spark, sf_dir):
    a, b = F.col("ref_row"), F.col("read_row")
    return _rows(spark, sf_dir).select("idx", dna.cigar(a, b).alias("cigar"), dna.cigar(a, b, op_first=True).alias("cigar_op_first"))


@query(f"""WITH {ROWS_SQL} SELECT idx, string_agg(CASE WHEN a = '-' OR b = '-' THEN '-' WHEN a = b THEN a ELSE ':' END, '' ORDER BY i) AS consensus,
replace(string_agg(a, '' ORDER BY i), '-', '') AS ungapped FROM ops GROUP BY idx""")
def alignment_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select("idx", dna.consensus(F.col("ref_row"), F.col("read_row")).alias("consensus"), dna.ungap(F.col("ref_row")).alias("ungapped"))


@query(f"""WITH {SHORT_SQL} SELECT '>' || name || chr(10) || seq AS value FROM short""")
def fasta_text(spark, sf_dir):
    from .sources.fastx import fasta_lines

    return fasta_lines(short_seqs(spark, sf_dir))


@query(f"""WITH {READS_SQL}, p AS (SELECT idx, seq, unnest(range(1, length(seq) + 1)) AS i FROM reads),
q AS (SELECT idx, seq, string_agg(chr(({QUALITY_SQL})::INT + 33), '' ORDER BY i) AS qual FROM p GROUP BY idx, seq)
SELECT '@b' || idx || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS value FROM q""")
def fastq_text(spark, sf_dir):
    from .sources.fastx import fastq_lines

    return fastq_lines(reads(spark, sf_dir))


NULL_CELLS = ((0.25, 0.6, 20.0), (0.25, 0.7, 30.0), (0.3, 0.8, 40.0), (0.2, 0.9, 50.0))
_NULL_SQL = ", ".join(f"('{b}', {p}, {q}, {r})" for b, (p, q, r) in zip("ACGT", NULL_CELLS))


@query(f"""WITH {READS_SQL}, p AS (SELECT idx, seq, unnest(range(1, length(seq) + 1)) AS i FROM reads),
c AS (SELECT idx, substr(seq, i::INT, 1) AS base, ({QUALITY_SQL})::DOUBLE AS k FROM p), n(base, p, q, r) AS (VALUES {_NULL_SQL})
SELECT idx, round(count(*) * ln(0.99::DOUBLE) + ln(1 - 0.99::DOUBLE) + sum(ln(p::DOUBLE) + lgamma(k + r::DOUBLE) - lgamma(k + 1) - lgamma(r::DOUBLE) + r::DOUBLE * ln(q::DOUBLE) + k * ln(1 - q::DOUBLE)), 5) AS null_ll FROM c JOIN n USING (base) GROUP BY idx""")
def null_log_likelihood(spark, sf_dir):
    from .functions.stats import log_nb

    table94 = F.create_map(*(x for b, (p, q, r) in zip("ACGT", NULL_CELLS) for x in (F.lit(b), F.lit([math.log(p) + float(v) for v in log_nb(q, r)]))))
    each = F.zip_with(F.filter(F.split("seq", ""), lambda c: c != ""), dna.qual_scores(F.col("qual")), lambda b, q: F.get(F.element_at(table94, b), q))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) + F.length("seq") * math.log(0.99) + math.log(1 - 0.99)
    return reads(spark, sf_dir).select("idx", F.round(total, 5).alias("null_ll"))


def _path_sql(best: bool) -> str:
    """The recursion over rows of the matrix, in probabilities: of the best path (products and maxima) or of all (sums)."""
    from .plans.model import Params

    p = Params.default()
    bi, bd, ei, ed = float(p.begin_insert[0]), float(p.begin_delete[0]), float(p.extend_insert), float(p.extend_delete)
    cells = lambda t: "[" + ", ".join(map(str, t)) + "]"
    match = "[" + ", ".join(cells(float(p.match[a, b, 0]) for b in range(4)) for a in range(4)) + "]"
    insert = cells(float(p.insert[b, 0]) for b in range(4))
    any_of = "list_max" if best else "list_sum"
    base = lambda s, k: f"instr('ACGT', substr({s}, ({k})::INT, 1))"
    return f"""r AS (
  SELECT idx, x, y, 0 AS j, list_transform(range(0, 13), lambda k: 0.0::DOUBLE) AS m, list_transform(range(0, 13), lambda k: 0.0::DOUBLE) AS i, list_transform(range(0, 13), lambda k: 0.0::DOUBLE) AS d FROM pairs
  UNION ALL
  SELECT idx, x, y, j, m, i, list_transform(range(0, 13), lambda k: CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE {any_of}(list_transform(range(1, k), lambda h: m[h + 1] * {bd} * {1 - bi} * pow({ed}::DOUBLE, k - 1 - h))) END) FROM (
    SELECT idx, x, y, j + 1 AS j,
      list_transform(range(0, 13), lambda k: CASE WHEN k < 1 THEN 0.0::DOUBLE ELSE {match}[{base('x', 'k')}][{base('y', 'j + 1')}] * {any_of}([m[k] * {(1 - bi) * (1 - bd)}, i[k] * {1 - ei}, d[k] * {1 - ed}, CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END]) END) AS m,
      list_transform(range(0, 13), lambda k: CASE WHEN k < 1 THEN 0.0::DOUBLE ELSE {insert}[{base('y', 'j + 1')}] * {any_of}([i[k + 1] * {ei}, m[k + 1] * {bi}]) END) AS i
    FROM r WHERE j < length(y))
), ends AS (SELECT idx, ln({any_of}(list_transform(m, lambda v: v * {bi}))) AS score FROM r WHERE j = length(y))"""


def _back_sql() -> str:
    """The same from the last row back, over all paths: what may follow a match or an insertion at each cell."""
    from .plans.model import Params

    p = Params.default()
    bi, bd, ei, ed = float(p.begin_insert[0]), float(p.begin_delete[0]), float(p.extend_insert), float(p.extend_delete)
    cells = lambda t: "[" + ", ".join(map(str, t)) + "]"
    match = "[" + ", ".join(cells(float(p.match[a, b, 0]) for b in range(4)) for a in range(4)) + "]"
    insert = cells(float(p.insert[b, 0]) for b in range(4))
    base = lambda s, k: f"instr('ACGT', substr({s}, ({k})::INT, 1))"
    return f"""b AS (
  SELECT idx, x, y, length(y)::BIGINT AS j, list_transform(range(0, 13), lambda k: {bi}::DOUBLE) AS after_m, list_transform(range(0, 13), lambda k: 0.0::DOUBLE) AS after_i FROM pairs
  UNION ALL
  SELECT idx, x, y, j - 1,
    list_transform(range(0, 13), lambda k: {(1 - bi) * (1 - bd)} * coalesce(to_m[k + 2], 0.0) + {bi} * to_i[k + 1]
      + {bd * (1 - bi)} * coalesce(list_sum(list_transform(range(k + 1, 12), lambda h: pow({ed}::DOUBLE, h - k - 1) * {1 - ed} * to_m[h + 2])), 0.0)),
    list_transform(range(0, 13), lambda k: {1 - ei} * coalesce(to_m[k + 2], 0.0) + {ei} * to_i[k + 1])
  FROM (SELECT idx, x, y, j,
      list_transform(range(0, 13), lambda k: CASE WHEN k < 1 THEN 0.0::DOUBLE ELSE {match}[{base('x', 'k')}][{base('y', 'j')}] * after_m[k + 1] END) AS to_m,
      list_transform(range(0, 13), lambda k: {insert}[{base('y', 'j')}] * after_i[k + 1]) AS to_i
    FROM b WHERE j > 1)
)"""


PAIRS_SQL = f"""{SHORT_SQL}, pairs AS (SELECT idx, substr(seq, 1, 12) AS x, translate(substr(upper(md5('y' || idx)), 1, 4), '0123456789ABCDEF', 'ACGTACGTACGTACGT') || substr(seq, 4, 6) AS y FROM short)"""


def _short_pairs(spark, sf_dir):
    """12 bases, and a read of 10: four made-up bases and six of the same sequence."""
    s, key = short_seqs(spark, sf_dir), F.concat(F.lit("y"), F.col("idx").cast("string"))
    made = F.translate(F.substring(F.upper(F.md5(key)), 1, 4), "0123456789ABCDEF", "ACGTACGTACGTACGT")
    return s.select(F.col("idx").alias("x_idx"), F.substring("seq", 1, 12).alias("x_seq"), F.col("idx").alias("y_idx"), F.concat(made, F.substring("seq", 4, 6)).alias("y_seq"))


@query(f"WITH RECURSIVE {PAIRS_SQL}, {_path_sql(True)} SELECT idx, round(score, 6) AS viterbi FROM ends")
def viterbi_scores(spark, sf_dir):
    from .operators.align import pair_scores

    return pair_scores(_short_pairs(spark, sf_dir), of=("viterbi",)).select(F.col("x_idx").alias("idx"), F.round("viterbi", 6).alias("viterbi"))


@query(f"WITH RECURSIVE {PAIRS_SQL}, {_path_sql(False)} SELECT idx, round(score, 6) AS forward FROM ends")
def forward_likelihoods(spark, sf_dir):
    from .operators.align import pair_scores

    return pair_scores(_short_pairs(spark, sf_dir), of=("forward",)).select(F.col("x_idx").alias("idx"), F.round("forward", 6).alias("forward"))


@query(f"WITH {SHORT_SQL} SELECT idx, j::INT AS j, 1.0::DOUBLE AS mass FROM short, range(1, 11) r(j)")
def posterior_mass(spark, sf_dir):
    """Every base of a read is matched or inserted somewhere: over the reference the probabilities add up to 1."""
    from .operators.align import pair_cells

    cells = pair_cells(_short_pairs(spark, sf_dir), only=("x_idx", "j", "post_match", "post_insert"))
    return cells.groupBy(F.col("x_idx").alias("idx"), "j").agg(F.round(F.sum(F.col("post_match") + F.col("post_insert")), 6).alias("mass"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, {_path_sql(False)}, {_back_sql()}, k AS (SELECT unnest(range(1, 13)) AS i)
SELECT r.idx, k.i::INT AS i, r.j::INT AS j, round(r.m[k.i + 1] * b.after_m[k.i + 1] / exp(score), 6) AS post_match, round(r.i[k.i + 1] * b.after_i[k.i + 1] / exp(score), 6) AS post_insert
FROM r JOIN b ON r.idx = b.idx AND r.j = b.j JOIN ends ON ends.idx = r.idx, k""")
def posterior_cells(spark, sf_dir):
    """The probability that a base of the read is matched with a base of the reference, or inserted after it."""
    from .operators.align import pair_cells

    cells = pair_cells(_short_pairs(spark, sf_dir), only=("x_idx", "i", "j", "post_match", "post_insert"))
    return cells.select(F.col("x_idx").alias("idx"), "i", "j", F.round("post_match", 6).alias("post_match"), F.round("post_insert", 6).alias("post_insert"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, {_path_sql(False)}, {_back_sql()}, k AS (SELECT unnest(range(1, 13)) AS i),
c AS (SELECT substr(r.x, k.i::INT, 1) AS ref_base, substr(r.y, r.j::INT, 1) AS read_base, r.m[k.i + 1] * b.after_m[k.i + 1] / exp(score) AS pm, r.i[k.i + 1] * b.after_i[k.i + 1] / exp(score) AS pi
  FROM r JOIN b ON r.idx = b.idx AND r.j = b.j JOIN ends ON ends.idx = r.idx, k)
SELECT 'match' AS kind, ref_base, read_base, round(sum(pm), 3) AS expected FROM c GROUP BY ALL
UNION ALL SELECT 'insert', NULL, read_base, round(sum(pi), 3) FROM c GROUP BY ALL""")
def expected_emissions(spark, sf_dir):
    """Expected numbers of matches by both bases and of insertions by base, over all paths of the short pairs."""
    from .operators.align import pair_cells

    each = pair_cells(_short_pairs(spark, sf_dir), bases=True)
    matches = each.groupBy(F.lit("match").alias("kind"), "ref_base", "read_base").agg(F.round(F.sum("post_match"), 3).alias("expected"))
    inserts = each.groupBy(F.lit("insert").alias("kind"), F.lit(None).cast("string").alias("ref_base"), "read_base").agg(F.round(F.sum("post_insert"), 3).alias("expected"))
    return matches.union(inserts)


def _both(spark, sf_dir):
    return sq.with_revcomps(references(spark, sf_dir), 1_000_000_000)


@query()
def align_best(spark, sf_dir):
    """Each benchmark item, without qualities, against both strands of every document: its best alignment, if likelier than the null model."""
    from .operators.align import align

    return align(reads(spark, sf_dir), _both(spark, sf_dir), use_quals=False).select("y_idx", "x_idx", F.round("score", 4).alias("score"), "ref_start", "ref_end", "ref_rev", dna.cigar(F.col("ref_row"), F.col("read_row")).alias("cigar"))


@query()
def align_seeded(spark, sf_dir):
    """With qualities, whatever the score, for pairs with 8 common 12-mers on one diagonal: found by a join, not in all pairs."""
    from .operators.align import align

    return align(reads(spark, sf_dir), _both(spark, sf_dir), seed=(12, 8), threshold=None).select("y_idx", "x_idx", F.round("score", 4).alias("score"), "ref_start", "ref_end", "ref_rev", dna.cigar(F.col("ref_row"), F.col("read_row")).alias("cigar"))


@query()
def align_sam(spark, sf_dir):
    from .operators.align import align, sam_lines

    return sam_lines(align(reads(spark, sf_dir), _both(spark, sf_dir), use_quals=False)).select("y_idx", "value")


def overlapping_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Two reads of each benchmark item, its first and its last seven tenths, the last one turned where the item's number is odd."""
    items = reads(spark, sf_dir)
    n = F.length("seq")
    cut = lambda c: F.array(F.substring(c, F.lit(1), F.ceil(n * 0.7).cast("int")), F.substring(c, (F.floor(n * 0.3) + 1).cast("int"), n))
    both = items.select("idx", "name", F.posexplode(F.arrays_zip(cut("seq").alias("seq"), cut("qual").alias("qual"))).alias("half", "r"))
    turned = (F.col("half") == 1) & (F.col("idx") % 2 == 1)
    rows = both.select((2 * F.col("idx") + F.col("half")).alias("idx"), F.concat("name", F.lit("/"), "half").alias("name"), F.when(turned, dna.revcomp(F.col("r.seq"))).otherwise(F.col("r.seq")).alias("seq"), F.when(turned, F.reverse("r.qual")).otherwise(F.col("r.qual")).alias("qual"))
    return sq.drop_empty(rows), 2 * (table(spark, sf_dir, "benchmark").agg(F.max("item_id") + 1).first()[0] or 0)


@query()
def overlap_reads(spark, sf_dir):
    """Overlaps of the benchmark items and their reverse complements, searched in every pair."""
    from .operators.align import overlap

    items = reads(spark, sf_dir)
    n = table(spark, sf_dir, "benchmark").agg(F.max("item_id") + 1).first()[0] or 0
    found = overlap(sq.with_revcomps(items, n), n)
    return found.select("x_idx", "y_idx", "y_complemented", F.round("score", 4).alias("score"), "x_start", "x_end", "y_start", "y_end")


@query()
def overlap_seeded(spark, sf_dir):
    """Overlaps of two reads of each benchmark item, and of their reverse complements: pairs with a seed diagonal, from a join.

    Qualities shape the null model alone: made-up ones say nothing of the bases.
    """
    from .operators.align import null_model, overlap

    some, n = overlapping_reads(spark, sf_dir)
    bare = sq.with_revcomps(some.withColumn("qual", F.lit(None).cast("string")), n)
    found = overlap(bare, n, null=null_model(some), require_seed=True)
    return found.select("x_idx", "y_idx", "y_complemented", F.round("score", 4).alias("score"), "x_start", "x_end", "y_start", "y_end")


@query()
def em_evidence(spark, sf_dir):
    """One E-step on the default model: log evidence of each read and the references that remain."""
    from .operators.align import null_model
    from .plans.model import Params
    from .plans.train import e_step

    items = reads(spark, sf_dir)
    evidence, _ = e_step(items, _both(spark, sf_dir), Params.default(), null_model(items))
    return evidence.select("idx", F.round("log_evidence", 4).alias("log_evidence"), F.size("kept").alias("kept"))


@query()
def em_counts(spark, sf_dir):
    """Expected counts of that E-step by slot."""
    from .operators.align import null_model
    from .plans.model import Params
    from .plans.train import e_step

    items = reads(spark, sf_dir)
    _, sums = e_step(items, _both(spark, sf_dir), Params.default(), null_model(items))
    return sums.select("slot", F.round("value", 4).alias("value"))


@query()
def trained_params(spark, sf_dir):
    """The model fitted to the benchmark items by expectation-maximisation, in long form."""
    from .plans.train import train

    fit = train(reads(spark, sf_dir), _both(spark, sf_dir))
    return spark.createDataFrame(fit.params.rows(), "param string, ref_base string, ctx string, p double, q double, r double")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
