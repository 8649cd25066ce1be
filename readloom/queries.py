"""The driver's queries, and the same results in DuckDB SQL by other means: closed forms over exploded places."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import scalars as fs
from readloom.functions import umi
from readloom.kernels.match import Linked, LinkedParams, MatchParams
from readloom.kernels.pair import CorrectionParams
from readloom.kernels.segment import SegmentParams
from readloom.kernels.trim import FilterParams, TrimParams
from readloom.operators import dedup, outputs, report, sample, segment, sniff, strand, workflow
from readloom.plans import projections as px
from readloom.plans.config import Adapter, AdapterStage, LinkedStage, Plan, SegmentPlan, UmiStage
from readloom.sources import catalogue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("orders", "events", "nation")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def reads(spark: SparkSession, sf_dir: str, projection: str) -> DataFrame:
    """A projection; one that comes in fewer parts than there are cores is dealt out, as a small file does."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in projection}
    df = spark.sql(projection, **used)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# SQL parts


def cte(projection: str, name: str = "r") -> str:
    return f"{name} AS ({projection.format(**{t: t for t in TABLES})})"


def phreds(q: str) -> str:
    return f"list_transform(range(1, length({q}) + 1), lambda i: ascii(substr({q}, i, 1)) - 33)"


def sql_front(qs: str, s: str, e: str, least: int, w: int = 4) -> str:
    return f"coalesce(list_min(list_filter(range({s}, {e}), lambda x: list_sum({qs}[x + 1 : least(x + {w}, {e})]) >= {least} * (least(x + {w}, {e}) - x))), {e})"


def sql_tail(qs: str, s: str, e: str, least: int, w: int = 4) -> str:
    return f"coalesce(list_max(list_filter(range({s} + 1, {e} + 1), lambda x: list_sum({qs}[greatest(x - {w}, {s}) + 1 : x]) >= {least} * (x - greatest(x - {w}, {s})))), {s})"


def sql_right(qs: str, e: str, least: int, w: int = 4) -> str:
    return f"coalesce(list_min(list_filter(range(0, {e} - least({w}, {e}) + 1), lambda x: list_sum({qs}[x + 1 : x + least({w}, {e})]) < {least} * least({w}, {e}))), {e})"


def sql_poly(s: str, e: str, base: str) -> str:
    part = f"substr({s}, {e} - i + 1, i)"
    return f"coalesce(list_max(list_filter(range(10, {e} + 1), lambda i: length(replace({part}, '{base}', '')) <= i * 0.1::DOUBLE)), 0)"


def sql_mates(extra: str = "") -> str:
    return f"m AS (SELECT record_index, 'R1' AS mate, r1_seq AS s, r1_qual AS q{extra} FROM r UNION ALL SELECT record_index, 'R2', r2_seq, r2_qual{extra} FROM r)"


def sql_hits(adapters: list[tuple[str, int, str]], source: str = "m", least: int = 8) -> str:
    """hit (record_index, mate, p, e, o, k): the first, cleanest, longest, first declared match."""
    rows = ", ".join(f"('{mate}', {k}, '{a}')" for mate, k, a in adapters)
    return f"""ad AS (SELECT * FROM (VALUES {rows}) t(mate, k, a)),
laid AS (SELECT record_index, mate, k, p, least(length(a), length(s) - p) AS o, s, a FROM (SELECT *, unnest(range(0, greatest(length(s) - {least} + 1, 0))) AS p FROM {source}) x JOIN ad USING (mate)),
hit AS (SELECT record_index, mate, key // 1000000000 AS p, key // 1000000 % 1000 AS e, 999 - key // 1000 % 1000 AS o, key % 1000 AS k FROM
  (SELECT record_index, mate, min(p * 1000000000 + e * 1000000 + (999 - o) * 1000 + k) AS key FROM (SELECT *, hamming(substr(s, p + 1, o), substr(a, 1, o)) AS e FROM laid) y WHERE o >= {least} AND e <= floor(o * 0.1::DOUBLE) GROUP BY ALL) z)"""


TRUSEQ = [("R1", 0, px.TRUSEQ_R1), ("R2", 0, px.TRUSEQ_R2)]
ADAPTERS = AdapterStage((Adapter("TruSeq R1", px.TRUSEQ_R1),), (Adapter("TruSeq R2", px.TRUSEQ_R2),))
NAMES = (("TruSeq R1",), ("TruSeq R2",))
TAIL20 = TrimParams(quality_tail=20)
PARITY = Plan(adapter=ADAPTERS, trim=(TAIL20, TAIL20), filter=FilterParams(min_length=20))
#: What the parity run gives each mate: hit, end behind the adapter (e0) and behind the quality tail (e).
PARITY_SQL = f"""{cte(px.PAIRS)}, {sql_mates()}, {sql_hits(TRUSEQ)},
f AS (SELECT record_index, mate, s, q, {phreds("q")} AS qs, coalesce(p, length(s)) AS e0, k, hit.p FROM m LEFT JOIN hit USING (record_index, mate)),
t AS (SELECT *, {sql_tail("qs", "0", "e0", 20)} AS e FROM f),
w AS (SELECT a.record_index, a.e AS e1, b.e AS e2, a.e0 AS c1, b.e0 AS c2, a.p AS p1, b.p AS p2, a.s AS s1, a.q AS q1, b.s AS s2, b.q AS q2 FROM t a JOIN t b ON a.record_index = b.record_index AND a.mate = 'R1' AND b.mate = 'R2')"""


def parity(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    return workflow.run(reads(spark, sf_dir, px.PAIRS), replace(PARITY, **changes))


@query(f"WITH {PARITY_SQL} SELECT record_index, substr(s1, 1, e1) AS r1_seq, substr(q1, 1, e1) AS r1_qual, substr(s2, 1, e2) AS r2_seq, substr(q2, 1, e2) AS r2_qual FROM w WHERE e1 >= 20 AND e2 >= 20")
def workflow_parity(spark, sf_dir):
    return workflow.accepted(reads(spark, sf_dir, px.PAIRS), PARITY).drop("r1_header", "r2_header")


# Scalars


@query(f"WITH {cte(px.PAIRS)} SELECT record_index, cast(levenshtein(substr(r1_seq, 1, 30), substr(r2_seq, 1, 30)) AS INTEGER) AS edits FROM r")
def edit_distance(spark, sf_dir):
    head = lambda c: F.substring(c, 1, 30)
    return reads(spark, sf_dir, px.PAIRS).select("record_index", fs.edits(head("r1_seq"), head("r2_seq")).alias("edits"))


@query(f"WITH {cte(px.READS)} SELECT record_index, CASE WHEN length(r1_seq) - 80 = 0 THEN 0::DOUBLE ELSE (length(r1_seq) - length(replace(r1_seq, 'N', '')))::DOUBLE / (length(r1_seq) - 80) END AS share FROM r")
def fraction(spark, sf_dir):
    n = F.length("r1_seq")
    return reads(spark, sf_dir, px.READS).select("record_index", fs.fraction(fs.n_count(F.col("r1_seq")), n - 80).alias("share"))


_FAMILY = [e.r1 for e in catalogue.load()[:24]]
_FAMILY_ROWS = ", ".join(f"({k}, '{x}')" for k, x in enumerate(_FAMILY))


@query(f"""WITH l AS (SELECT * FROM (VALUES {_FAMILY_ROWS}) t(k, s)), p AS (SELECT x.k AS a, y.k AS b, x.s AS s, y.s AS t, least(length(x.s), length(y.s)) AS short FROM l x JOIN l y ON x.k < y.k),
q AS (SELECT *, least(greatest(12, short // 2), short) AS need FROM p), o AS (SELECT *, unnest(range(need - length(t), length(s) - need + 1)) AS off FROM q),
h AS (SELECT *, greatest(off, 0) AS lo, least(length(s), off + length(t)) AS hi FROM o), m AS (SELECT a, b, bool_or(hamming(substr(s, lo + 1, hi - lo), substr(t, lo - off + 1, hi - lo)) <= 0.1::DOUBLE * (hi - lo)) AS slide FROM h WHERE hi - lo >= need GROUP BY a, b)
SELECT cast(q.a AS INTEGER) AS a, cast(q.b AS INTEGER) AS b, coalesce(slide, false) OR (abs(length(s) - length(t)) <= floor(0.1::DOUBLE * short) AND levenshtein(s, t) <= floor(0.1::DOUBLE * short)) AS related FROM q LEFT JOIN m ON m.a = q.a AND m.b = q.b""")
def family(spark, sf_dir):
    """The family test on pairs of known sequences."""
    rows = [(i, j, fs.related(x, y)) for i, x in enumerate(_FAMILY) for j, y in enumerate(_FAMILY) if i < j]
    return spark.createDataFrame(rows, "a int, b int, related boolean")


@query(f"WITH {cte(px.PAIRS)} SELECT record_index, cast(list_sum({phreds('r1_qual')}) AS BIGINT) AS phred_sum FROM r")
def phred_sum(spark, sf_dir):
    return reads(spark, sf_dir, px.PAIRS).select("record_index", fs.phred_sum(F.col("r1_qual")).alias("phred_sum"))


@query(f"WITH {cte(px.READS)} SELECT record_index, reverse(translate(r1_seq, 'ACGTN', 'TGCAN')) AS revcomp FROM r")
def revcomp(spark, sf_dir):
    return reads(spark, sf_dir, px.READS).select("record_index", fs.reverse_complement(F.col("r1_seq")).alias("revcomp"))


@query(f"WITH {cte(px.READS)} SELECT record_index, cast(len(list_filter(range(2, length(r1_seq) + 1), lambda i: substr(r1_seq, i, 1) <> substr(r1_seq, i - 1, 1))) AS DOUBLE) / (length(r1_seq) - 1) AS complexity FROM r")
def complexity(spark, sf_dir):
    return reads(spark, sf_dir, px.READS).select("record_index", fs.complexity(F.col("r1_seq")).alias("complexity"))


@query(f"WITH {cte(px.READS)} SELECT record_index, cast(length(r1_seq) - length(replace(r1_seq, 'N', '')) AS INTEGER) AS n_count FROM r")
def n_count(spark, sf_dir):
    return reads(spark, sf_dir, px.READS).select("record_index", fs.n_count(F.col("r1_seq")).alias("n_count"))


@query("SELECT event_id AS record_index, cast(floor((event_id % 300) * 0.1::DOUBLE) AS INTEGER) AS n_limit, cast(least(floor((event_id % 300) * 0.1::DOUBLE), 4) AS INTEGER) AS capped FROM events")
def error_limit(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id") % 300
    return e.select(F.col("event_id").alias("record_index"), fs.error_limit(n, 0.1).alias("n_limit"), fs.error_limit(n, 0.1, 4).alias("capped"))


@query(f"WITH {cte(px.READS)} SELECT record_index, r1_seq FROM r WHERE record_index >= 100 AND record_index < 900")
def span_scan(spark, sf_dir):
    return sample.span(reads(spark, sf_dir, px.READS), 100, 900).select("record_index", "r1_seq")


@query(f"WITH {cte(px.READS)} SELECT sum(length(r1_seq))::BIGINT AS bases, count(*) AS records FROM r")
def decode_floor(spark, sf_dir):
    return reads(spark, sf_dir, px.READS).agg(F.sum(F.length("r1_seq")).cast("bigint").alias("bases"), F.count("*").alias("records"))


# Trims


def trimmed(spark, sf_dir, projection: str = px.READS, **options) -> DataFrame:
    t = TrimParams(**options)
    out = workflow.run(reads(spark, sf_dir, projection).drop("r2_seq", "r2_qual", "r2_header"), Plan(trim=(t, t)))
    return out.select("record_index", F.col("r1.start").alias("s"), F.col("r1.end").alias("e"))


def trim_sql(s: str, e: str, projection: str = px.READS) -> str:
    return f"WITH {cte(projection)}, x AS (SELECT *, {phreds('r1_qual')} AS qs, length(r1_seq) AS n FROM r) SELECT record_index, cast({s} AS INTEGER) AS s, cast({e} AS INTEGER) AS e FROM x"


@query(trim_sql("least(3, n)", "greatest(n - 30, least(3, n))"))
def trim_fixed(spark, sf_dir):
    return trimmed(spark, sf_dir, front=3, tail=30)


@query(trim_sql(sql_front("qs", "0", "n", 28), "n"))
def trim_quality_front(spark, sf_dir):
    return trimmed(spark, sf_dir, quality_front=28)


@query(trim_sql("0", sql_right("qs", "n", 20)))
def trim_quality_right(spark, sf_dir):
    return trimmed(spark, sf_dir, quality_right=20)


@query(trim_sql("0", sql_tail("qs", "0", "n", 30), px.PAIRS))
def trim_quality_tail(spark, sf_dir):
    return trimmed(spark, sf_dir, px.PAIRS, quality_tail=30)


@query(trim_sql("CASE WHEN trim(r1_seq, 'N') = '' THEN n ELSE n - length(ltrim(r1_seq, 'N')) END", "length(rtrim(r1_seq, 'N'))"))
def trim_terminal_n(spark, sf_dir):
    return trimmed(spark, sf_dir, terminal_n=True)


@query(trim_sql("0", f"n - {sql_poly('r1_seq', 'n', 'G')}"))
def trim_poly_g(spark, sf_dir):
    return trimmed(spark, sf_dir, poly_g=True)


@query(trim_sql("0", "n - greatest(" + ", ".join(sql_poly("r1_seq", "n", b) for b in "ACGT") + ")"))
def trim_poly_x(spark, sf_dir):
    return trimmed(spark, sf_dir, poly_x=True)


@query(trim_sql("0", "least(n, 30)"))
def trim_max_length(spark, sf_dir):
    return trimmed(spark, sf_dir, max_length=30)


@query(
    f"WITH {cte(px.READS)}, a AS (SELECT *, {phreds('r1_qual')} AS qs, least(1, length(r1_seq)) AS s1, length(r1_seq) - 1 AS e1 FROM r), b AS (SELECT *, {sql_tail('qs', 's1', 'e1', 22)} AS e2 FROM a), "
    "c AS (SELECT *, substr(r1_seq, s1 + 1, e2 - s1) AS x FROM b), d AS (SELECT *, CASE WHEN trim(x, 'N') = '' THEN e2 ELSE s1 + length(x) - length(ltrim(x, 'N')) END AS s3, CASE WHEN trim(x, 'N') = '' THEN e2 ELSE s1 + length(rtrim(x, 'N')) END AS e3 FROM c), "
    f"g AS (SELECT *, substr(r1_seq, s3 + 1, e3 - s3) AS y, e3 - s3 AS ny FROM d), h AS (SELECT *, e3 - {sql_poly('y', 'ny', 'G')} AS e4 FROM g) SELECT record_index, cast(s3 AS INTEGER) AS s, cast(least(e4, s3 + 28) AS INTEGER) AS e FROM h"
)
def trim_all(spark, sf_dir):
    return trimmed(spark, sf_dir, front=1, tail=1, quality_tail=22, terminal_n=True, poly_g=True, max_length=28)


# Filters and routing

FILTER = FilterParams(min_length=28, length_limit=44, max_n=1, max_n_fraction=0.06, qualified_quality=15, max_unqualified_bases=6, max_unqualified_fraction=0.2, min_mean_quality=24, min_complexity=0.72)
FILTER_SQL = f"""{cte(px.READS)}, x AS (SELECT *, length(r1_seq) AS n, length(r1_seq) - length(replace(r1_seq, 'N', '')) AS ns, {phreds("r1_qual")} AS qs, len(list_filter(range(2, length(r1_seq) + 1), lambda i: substr(r1_seq, i, 1) <> substr(r1_seq, i - 1, 1))) AS ch FROM r),
y AS (SELECT record_index, n < 28 AS b0, n > 44 AS b1, ns > 1 OR ns::DOUBLE / n > 0.06::DOUBLE AS b2, len(list_filter(qs, lambda v: v < 15)) > 6 OR len(list_filter(qs, lambda v: v < 15))::DOUBLE / n > 0.2::DOUBLE AS b3, list_sum(qs) < 24 * n AS b4, ch::DOUBLE / (n - 1) < 0.72::DOUBLE AS b5 FROM x)"""
_B = ("TOO_SHORT", "TOO_LONG", "TOO_MANY_N", "TOO_MANY_LOW_QUAL", "LOW_MEAN_QUAL", "LOW_COMPLEXITY")
LABEL_SQL = "coalesce(nullif(concat_ws('/', " + ", ".join(f"CASE WHEN b{i} THEN '{n}' END" for i, n in enumerate(_B)) + "), ''), 'PASS')"


def filtered(spark, sf_dir) -> DataFrame:
    return workflow.run(reads(spark, sf_dir, px.READS), Plan(filter=FILTER))


@query(f"WITH {FILTER_SQL} SELECT record_index, " + ", ".join(f"b{i} AS {n.lower()}" for i, n in enumerate(_B)) + " FROM y")
def filter_each(spark, sf_dir):
    return filtered(spark, sf_dir).select("record_index", *[(F.col("r1.reasons").bitwiseAND(1 << i) != 0).alias(n.lower()) for i, n in enumerate(_B)])


@query(f"WITH {FILTER_SQL} SELECT record_index, {LABEL_SQL} AS reasons FROM y")
def filter_reasons(spark, sf_dir):
    return filtered(spark, sf_dir).select("record_index", workflow.reason_label(F.col("r1.reasons")).alias("reasons"))


_ROUTE = "SELECT record_index, CASE WHEN e1 >= 20 AND e2 >= 20 THEN 'accepted' {} ELSE 'rejected' END AS disposition FROM w"


@query(f"WITH {PARITY_SQL} " + _ROUTE.format(""))
def route_strict(spark, sf_dir):
    return parity(spark, sf_dir).select("record_index", "disposition")


@query(f"WITH {PARITY_SQL} " + _ROUTE.format("WHEN e1 >= 20 THEN 'orphan_r1' WHEN e2 >= 20 THEN 'orphan_r2'"))
def route_orphan(spark, sf_dir):
    return parity(spark, sf_dir, pair_policy="orphan").select("record_index", "disposition")


@query(f"""WITH {PARITY_SQL}, z AS (SELECT * FROM w WHERE NOT (e1 >= 20 AND e2 >= 20))
SELECT record_index, 'R1' AS mate, CASE WHEN e1 >= 20 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN e1 >= 20 THEN 'PASS' ELSE 'TOO_SHORT' END AS reasons, 80 AS original_length, cast(c1 AS INTEGER) AS adapter_trimmed_length, cast(e1 AS INTEGER) AS final_length, CASE WHEN p1 IS NULL THEN '.' ELSE 'TruSeq R1' END AS adapter_name, coalesce(cast(p1 AS VARCHAR), '.') AS adapter_start FROM z
UNION ALL SELECT record_index, 'R2', CASE WHEN e2 >= 20 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN e2 >= 20 THEN 'PASS' ELSE 'TOO_SHORT' END, 80, cast(c2 AS INTEGER), cast(e2 AS INTEGER), CASE WHEN p2 IS NULL THEN '.' ELSE 'TruSeq R2' END, coalesce(cast(p2 AS VARCHAR), '.') FROM z""")
def reason_sidecar(spark, sf_dir):
    return outputs.reason_rows(parity(spark, sf_dir), NAMES)


@query(f"WITH {PARITY_SQL} SELECT r.* FROM r JOIN w USING (record_index) WHERE NOT (e1 >= 20 AND e2 >= 20)")
def failed_original(spark, sf_dir):
    return outputs.failed(parity(spark, sf_dir))


@query(f"WITH {PARITY_SQL} SELECT record_index, substr(s1, 1, e1) AS r1_seq, substr(q1, 1, e1) AS r1_qual, substr(s2, 1, e2) AS r2_seq, substr(q2, 1, e2) AS r2_qual FROM w WHERE NOT (e1 >= 20 AND e2 >= 20)")
def failed_processed(spark, sf_dir):
    return outputs.failed(parity(spark, sf_dir), "processed").drop("r1_header", "r2_header")


@query(f"WITH {PARITY_SQL} SELECT record_index, substr(s2, 1, e2) AS r1_seq, substr(q2, 1, e2) AS r1_qual FROM w WHERE e1 < 20 AND e2 >= 20")
def orphan_r2(spark, sf_dir):
    return outputs.orphans(parity(spark, sf_dir, pair_policy="orphan"), 2).drop("r1_header")


@query(f"WITH {PARITY_SQL} SELECT record_index, substr(s1, 1, e1) AS r1_seq, substr(q1, 1, e1) AS r1_qual FROM w WHERE e1 >= 20 AND e2 < 20")
def orphan_r1(spark, sf_dir):
    return outputs.orphans(parity(spark, sf_dir, pair_policy="orphan"), 1).drop("r1_header")


# Adapters


def hits_of(result: DataFrame) -> DataFrame:
    return report.by_mate(result).filter("f.adapter is not null").select("record_index", "mate", F.col("f.adapter").alias("adapter"), F.col("f.adapter_start").alias("start"), F.col("f.adapter_errors").alias("errors"))


_HITS = "SELECT record_index, mate, cast(k AS INTEGER) AS adapter, cast(p AS INTEGER) AS start, cast(e AS INTEGER) AS errors FROM hit"


@query(f"WITH {cte(px.PAIRS)}, {sql_mates()}, {sql_hits(TRUSEQ)} {_HITS}")
def adapter_3p(spark, sf_dir):
    return hits_of(workflow.run(reads(spark, sf_dir, px.PAIRS), Plan(adapter=ADAPTERS)))


_SEVERAL = ["GATCGGAAGAGCACACGTCT", px.NEXTERA, px.TRUSEQ_R1]


@query(f"WITH {cte(px.PAIRS)}, {sql_mates()}, {sql_hits([('R1', k, a) for k, a in enumerate(_SEVERAL)])} {_HITS}")
def adapter_multi(spark, sf_dir):
    stage = AdapterStage(tuple(Adapter(f"a{k}", a) for k, a in enumerate(_SEVERAL)))
    return hits_of(workflow.run(reads(spark, sf_dir, px.PAIRS), Plan(adapter=stage)))


@query()
def adapter_indel(spark, sf_dir):
    """By edits; no oracle, as the shadow window is a sequential rule: tested against a plain dynamic programme."""
    return hits_of(workflow.run(reads(spark, sf_dir, px.PAIRS), Plan(adapter=replace(ADAPTERS, match=MatchParams(allow_indels=True)))))


_LIBRARY = [("R2", k, e.sequence_of("R2")) for k, e in enumerate(catalogue.load())]


@query(f"WITH {cte(px.PAIRS)}, {sql_mates()}, {sql_hits(_LIBRARY)} SELECT mate, cast(k AS INTEGER) AS entry, count(*) AS reads FROM hit GROUP BY ALL")
def catalogue_lookup(spark, sf_dir):
    library = catalogue.load()
    return sniff.library_hits(sniff.by_mate(reads(spark, sf_dir, px.PAIRS)), {"R2": [e.sequence_of("R2") for e in library]}, MatchParams())


# Reports


@query(f"""WITH {PARITY_SQL}, v AS (SELECT *, e1 >= 20 AS g1, e2 >= 20 AS g2 FROM w) SELECT count(*) AS records_in, count(*) FILTER (g1 AND g2) AS records_out, count(*) FILTER (NOT g1 AND NOT g2) AS records_rejected,
count(*) FILTER (g1 AND NOT g2) AS orphaned_r1, count(*) FILTER (g2 AND NOT g1) AS orphaned_r2, sum(length(s1))::BIGINT AS bases_in_r1, sum(length(s2))::BIGINT AS bases_in_r2, coalesce(sum(e1) FILTER (g1 AND g2), 0)::BIGINT AS bases_out_r1, coalesce(sum(e2) FILTER (g1 AND g2), 0)::BIGINT AS bases_out_r2,
coalesce(sum(e1) FILTER (g1 AND NOT g2), 0)::BIGINT AS bases_orphaned_r1, coalesce(sum(e2) FILTER (g2 AND NOT g1), 0)::BIGINT AS bases_orphaned_r2, count(*) FILTER (NOT g1 AND g2) AS r1_only_failed, count(*) FILTER (g1 AND NOT g2) AS r2_only_failed, count(*) FILTER (NOT g1 AND NOT g2) AS both_failed FROM v""")
def report_counts(spark, sf_dir):
    return report.counts(parity(spark, sf_dir, pair_policy="orphan"))


@query(f"WITH {PARITY_SQL} SELECT mate, count(*) FILTER (e0 < length(s)) AS adapter_reads, sum(length(s) - e0)::BIGINT AS adapter_bases, 0::BIGINT AS overlap_reads, 0::BIGINT AS overlap_bases FROM t GROUP BY mate")
def report_adapters(spark, sf_dir):
    return report.adapters(parity(spark, sf_dir))


@query(f"WITH {PARITY_SQL} SELECT 'R1' AS mate, 'TruSeq R1' AS name, count(p1) AS hits FROM w UNION ALL SELECT 'R2', 'TruSeq R2', count(p2) FROM w")
def report_adapter_hits(spark, sf_dir):
    return report.adapter_hits(parity(spark, sf_dir), NAMES)


@query(f"WITH {PARITY_SQL} SELECT mate, 'quality' AS op, count(*) FILTER (e < e0) AS reads, sum(e0 - e)::BIGINT AS bases FROM t GROUP BY mate UNION ALL SELECT mate, 'max_length', 0, 0 FROM (VALUES ('R1'), ('R2')) v(mate)")
def report_trim(spark, sf_dir):
    """Trims that are on, also one that takes nothing."""
    both = (replace(TAIL20, max_length=1000),) * 2
    return report.trims(parity(spark, sf_dir, trim=both), both)


@query(f"WITH {PARITY_SQL} SELECT count(*) AS records, count(*) FILTER (e1 >= 20 AND e2 >= 20) AS kept FROM w")
def kept_pairs(spark, sf_dir):
    return report.kept_pairs(reads(spark, sf_dir, px.PAIRS), outputs.accepted(parity(spark, sf_dir)))


@query(f"WITH {FILTER_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) FILTER (b{i}) AS mates FROM y" for i, n in enumerate(_B)) + " UNION ALL SELECT 'LINKED_UNMATCHED', 0")
def report_reasons(spark, sf_dir):
    return report.reasons(filtered(spark, sf_dir))


@query(f"WITH {FILTER_SQL} SELECT {LABEL_SQL} AS reasons, count(*) AS records FROM y WHERE {LABEL_SQL} <> 'PASS' GROUP BY ALL")
def report_combinations(spark, sf_dir):
    return report.combinations(filtered(spark, sf_dir))


@query(f"WITH {cte(px.PAIRS)} SELECT count(*) AS reads, avg(length(r1_seq)) AS mean_length, sum(len(list_filter({phreds('r1_qual')}, lambda v: v >= 30)))::DOUBLE / sum(length(r1_qual)) AS q30, count(*) FILTER (contains(r1_seq, '{px.TRUSEQ_R1[:20]}')) * 1000000.0::DOUBLE / count(*) AS residue_ppm FROM r")
def bench_metrics(spark, sf_dir):
    return report.quality_metrics(reads(spark, sf_dir, px.PAIRS), px.TRUSEQ_R1[:20])


# UMIs

_H1, _H2 = "split_part(r1_header, ' ', 1)", "split_part(r2_header, ' ', 1)"


def umi_sql(tag: str, clip1: int = 0, clip2: int = 0) -> str:
    return f"WITH {cte(px.PAIRS)}, x AS (SELECT *, {tag} AS tag FROM r) SELECT record_index, substr(r1_seq, {clip1 + 1}) AS r1_seq, substr(r1_qual, {clip1 + 1}) AS r1_qual, concat({_H1}, tag, ' {px.HEADER_TAIL}') AS r1_header, substr(r2_seq, {clip2 + 1}) AS r2_seq, substr(r2_qual, {clip2 + 1}) AS r2_qual, concat({_H2}, tag, ' {px.HEADER_TAIL}') AS r2_header FROM x"


def umi_query(location: str, sql: str, **options) -> None:
    def run(spark, sf_dir):
        return umi.extract(reads(spark, sf_dir, px.PAIRS), UmiStage(location, **options))

    run.__name__ = f"umi_{location}"
    query(sql)(run)


umi_query("read1", umi_sql("concat(':', substr(r1_seq, 1, 8))", 10), length=8, skip=2)
umi_query("read2", umi_sql("concat(':', substr(r2_seq, 1, 6))", 0, 6), length=6)
umi_query("per_read", umi_sql("concat('_', 'UMI_', substr(r1_seq, 1, 8), '_', substr(r2_seq, 1, 8))", 8, 8), length=8, prefix="UMI", delimiter="_")
umi_query("index1", umi_sql("':TATAGCCT'"))
umi_query("index2", umi_sql("':GGTCCCGA'"))
umi_query("per_index", umi_sql("':TATAGCCT_GGTCCCGA'"))


@query(f"WITH {cte(px.PAIRS)} SELECT count(*) AS records_tagged, (count(*) * 10)::BIGINT AS bases_removed FROM r")
def report_umi(spark, sf_dir):
    return report.umi(workflow.run(reads(spark, sf_dir, px.PAIRS), Plan(umi=UmiStage("read1", 8, 2))))


# Duplicates


@query(f"WITH {cte(px.DUPLICATES)} SELECT min(record_index) AS record_index, r1_seq FROM r GROUP BY r1_seq")
def dedup_se(spark, sf_dir):
    return dedup.dedup(reads(spark, sf_dir, px.DUPLICATES).drop("r2_seq"))


@query(f"WITH {cte(px.DUPLICATES)} SELECT min(record_index) AS record_index, r1_seq, r2_seq FROM r GROUP BY r1_seq, r2_seq")
def dedup_pe(spark, sf_dir):
    return dedup.dedup(reads(spark, sf_dir, px.DUPLICATES))


@query(f"WITH {cte(px.DUPLICATES)}, g AS (SELECT count(*) AS n FROM r GROUP BY r1_seq) SELECT sum(n)::BIGINT AS records_seen, count(*) AS records_kept, (sum(n) - count(*))::BIGINT AS duplicates_removed, (sum(n) - count(*))::DOUBLE / sum(n) AS duplication_rate, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS candidate_records, count(*) FILTER (n > 1) AS candidate_families FROM g")
def dedup_stats(spark, sf_dir):
    return dedup.stats(reads(spark, sf_dir, px.DUPLICATES).drop("r2_seq"))


# Overlaps and correction

OVERLAP_SQL = f"""c AS (SELECT *, reverse(translate(r2_seq, 'ACGTN', 'TGCAN')) AS rc, length(r1_seq) AS n1, length(r2_seq) AS n2 FROM r),
d AS (SELECT *, greatest(o, 0) AS lo, least(n1, o + n2) - greatest(o, 0) AS ov FROM (SELECT *, unnest(range(30 - n2, n1 - 30 + 1)) AS o FROM c) x),
k AS (SELECT record_index, min((999 - ov) * 1000000 + e * 1000 + o + 500) AS key FROM (SELECT *, hamming(substr(r1_seq, lo + 1, ov), substr(rc, lo - o + 1, ov)) AS e FROM d WHERE ov >= 30) y WHERE e <= floor(ov * 0.1::DOUBLE) GROUP BY record_index),
ov AS (SELECT record_index, key % 1000 - 500 AS o, 999 - key // 1000000 AS ov, key // 1000 % 1000 AS e FROM k)"""
CORRECT = Plan(correction=CorrectionParams())


@query(f"WITH {cte(px.PAIRS)}, {OVERLAP_SQL} SELECT record_index, cast(o AS INTEGER) AS o, cast(ov AS INTEGER) AS n, cast(e AS INTEGER) AS mismatches, cast(o + 80 AS INTEGER) AS insert_length FROM ov")
def overlap(spark, sf_dir):
    out = workflow.run(reads(spark, sf_dir, px.PAIRS), Plan(adapter=AdapterStage(paired_overlap=True))).filter("overlap is not null")
    return out.select("record_index", F.col("overlap.offset").alias("o"), F.col("overlap.length").alias("n"), F.col("overlap.mismatches").alias("mismatches"), F.col("overlap.insert").alias("insert_length"))


@query(f"WITH {cte(px.PAIRS)}, {OVERLAP_SQL}, {sql_mates()}, {sql_hits(TRUSEQ)} SELECT r.record_index, cast(CASE WHEN ov.o IS NOT NULL THEN least(80, ov.o + 80) ELSE coalesce(a.p, 80) END AS INTEGER) AS n1, cast(CASE WHEN ov.o IS NOT NULL THEN least(80, ov.o + 80) ELSE coalesce(b.p, 80) END AS INTEGER) AS n2 FROM r LEFT JOIN ov USING (record_index) LEFT JOIN hit a ON a.record_index = r.record_index AND a.mate = 'R1' LEFT JOIN hit b ON b.record_index = r.record_index AND b.mate = 'R2'")
def overlap_trim(spark, sf_dir):
    out = workflow.run(reads(spark, sf_dir, px.PAIRS), Plan(adapter=replace(ADAPTERS, paired_overlap=True)))
    return out.select("record_index", F.col("r1.adapter_trimmed_length").alias("n1"), F.col("r2.adapter_trimmed_length").alias("n2"))


EDITS_SQL = f"""{cte(px.MISCALLS)}, {OVERLAP_SQL},
aln AS (SELECT record_index, r1_seq, r1_qual, r2_seq, r2_qual, r1_header, r2_header, o, ov, e, greatest(o, 0) + t AS p1, n2 - 1 - greatest(-o, 0) - t AS p2 FROM (SELECT c.*, ov.o, ov.ov, ov.e, unnest(range(0, ov.ov)) AS t FROM c JOIN ov USING (record_index)) x),
b AS (SELECT *, substr(r1_seq, p1 + 1, 1) AS b1, substr(r2_seq, p2 + 1, 1) AS b2, ascii(substr(r1_qual, p1 + 1, 1)) - 33 AS x1, ascii(substr(r2_qual, p2 + 1, 1)) - 33 AS x2 FROM aln),
mm AS (SELECT *, x1 >= 30 AND x2 <= 14 AS to2, x2 >= 30 AND x1 <= 14 AS to1 FROM b WHERE b1 <> translate(b2, 'ACGT', 'TGCA'))"""


def corrected(spark, sf_dir, plan: Plan = CORRECT) -> DataFrame:
    return workflow.run(reads(spark, sf_dir, px.MISCALLS), plan)


@query(f"""WITH {EDITS_SQL} SELECT record_index, 'R1' AS mate, cast(p1 AS INTEGER) AS read_position, 'R2' AS donor_mate, cast(p2 AS INTEGER) AS donor_position, b1 AS original_base, translate(b2, 'ACGT', 'TGCA') AS corrected_base, x1 AS original_phred, x2 AS corrected_phred, cast(o AS INTEGER) AS overlap_offset, cast(ov AS INTEGER) AS overlap_length, 'accepted' AS final_disposition FROM mm WHERE to1
UNION ALL SELECT record_index, 'R2', cast(p2 AS INTEGER), 'R1', cast(p1 AS INTEGER), b2, translate(b1, 'ACGT', 'TGCA'), x2, x1, cast(o AS INTEGER), cast(ov AS INTEGER), 'accepted' FROM mm WHERE to2""")
def correct_log_bases(spark, sf_dir):
    return outputs.correction_bases(corrected(spark, sf_dir))


@query(f"WITH {EDITS_SQL} SELECT record_index, any_value(r1_header) AS r1_header, any_value(r2_header) AS r2_header, cast(any_value(o) AS INTEGER) AS overlap_offset, cast(any_value(ov) AS INTEGER) AS overlap_length, cast(any_value(e) AS INTEGER) AS overlap_mismatches, cast(count(*) FILTER (to1) AS INTEGER) AS corrected_r1_bases, cast(count(*) FILTER (to2) AS INTEGER) AS corrected_r2_bases, cast(count(*) FILTER (NOT to1 AND NOT to2) AS INTEGER) AS unresolved_mismatches, 'accepted' AS final_disposition FROM mm GROUP BY record_index HAVING count(*) FILTER (to1 OR to2) > 0")
def correct_log_reads(spark, sf_dir):
    return outputs.correction_reads(corrected(spark, sf_dir))


@query(f"""WITH {EDITS_SQL}, ed AS (SELECT record_index, max(p1) FILTER (to1) AS i1, max(translate(b2, 'ACGT', 'TGCA')) FILTER (to1) AS c1, max(chr(x2 + 33)) FILTER (to1) AS q1, max(p2) FILTER (to2) AS i2, max(translate(b1, 'ACGT', 'TGCA')) FILTER (to2) AS c2, max(chr(x1 + 33)) FILTER (to2) AS q2 FROM mm GROUP BY record_index)
SELECT r.record_index, CASE WHEN i1 IS NULL THEN r1_seq ELSE concat(substr(r1_seq, 1, i1), c1, substr(r1_seq, i1 + 2)) END AS r1_seq, CASE WHEN i1 IS NULL THEN r1_qual ELSE concat(substr(r1_qual, 1, i1), q1, substr(r1_qual, i1 + 2)) END AS r1_qual,
CASE WHEN i2 IS NULL THEN r2_seq ELSE concat(substr(r2_seq, 1, i2), c2, substr(r2_seq, i2 + 2)) END AS r2_seq, CASE WHEN i2 IS NULL THEN r2_qual ELSE concat(substr(r2_qual, 1, i2), q2, substr(r2_qual, i2 + 2)) END AS r2_qual FROM r LEFT JOIN ed USING (record_index)""")
def correct_reads(spark, sf_dir):
    return outputs.accepted(corrected(spark, sf_dir)).drop("r1_header", "r2_header")


@query(f"""WITH {EDITS_SQL}, p AS (SELECT r.record_index, count(mm.record_index) AS mism, count(*) FILTER (to1) AS c1, count(*) FILTER (to2) AS c2, count(*) FILTER (mm.record_index IS NOT NULL AND NOT to1 AND NOT to2) AS un, any_value(ov.o) AS o FROM r LEFT JOIN ov USING (record_index) LEFT JOIN mm USING (record_index) GROUP BY r.record_index)
SELECT count(*) AS pairs_examined, count(o) AS overlapping_pairs, sum(mism)::BIGINT AS mismatches, count(*) FILTER (mism > 0) AS pairs_with_mismatches, sum(un)::BIGINT AS unresolved, 0::BIGINT AS skipped_noncanonical, count(*) FILTER (c1 + c2 > 0) AS corrected_pairs, count(*) FILTER (c1 > 0 AND c2 > 0) AS corrected_both_mates,
count(*) FILTER (c1 > 0) AS corrected_reads_r1, count(*) FILTER (c2 > 0) AS corrected_reads_r2, sum(c1)::BIGINT AS corrected_bases_r1, sum(c2)::BIGINT AS corrected_bases_r2 FROM p""")
def report_correction(spark, sf_dir):
    return report.correction(corrected(spark, sf_dir))


@query(f"WITH {EDITS_SQL} SELECT cast(n AS INTEGER) AS corrections, 'accepted' AS disposition, count(*) AS pairs FROM (SELECT count(*) FILTER (to1 OR to2) AS n FROM mm GROUP BY record_index) x WHERE n > 0 GROUP BY n")
def report_corrections_per_pair(spark, sf_dir):
    return report.corrections_per_pair(corrected(spark, sf_dir))


@query(f"WITH {EDITS_SQL} SELECT original, corrected, count(*) AS bases FROM (SELECT b1 AS original, translate(b2, 'ACGT', 'TGCA') AS corrected FROM mm WHERE to1 UNION ALL SELECT b2, translate(b1, 'ACGT', 'TGCA') FROM mm WHERE to2) x GROUP BY ALL")
def report_substitutions(spark, sf_dir):
    return report.substitutions(corrected(spark, sf_dir))


# Linked flanks

LINKED_SQL = f"""{cte(px.LINKED)}, a AS (SELECT record_index, r1_seq AS s, list_min(list_filter(range(0, 4), lambda p: p + 12 <= length(r1_seq) AND hamming(substr(r1_seq, p + 1, 12), '{px.FIVE}') <= 1)) AS p5 FROM r),
b AS (SELECT *, coalesce(p5 + 12, 0) AS s0, substr(s, coalesce(p5 + 12, 0) + 1) AS rest FROM a),
c AS (SELECT *, list_min(list_filter(range(0, greatest(length(rest) - 8 + 1, 0)), lambda p: hamming(substr(rest, p + 1, least(12, length(rest) - p)), substr('{px.THREE}', 1, least(12, length(rest) - p))) <= floor(least(12, length(rest) - p) * 0.1::DOUBLE))) AS p3 FROM b),
l AS (SELECT record_index, s, p5 IS NOT NULL AS h5, p3 IS NOT NULL AS h3, s0, s0 + coalesce(p3, length(rest)) AS e0 FROM c)"""


def linked_run(spark, sf_dir, require: str = "both", unmatched: str = "continue") -> DataFrame:
    stage = LinkedStage((Linked(px.FIVE, px.THREE),), options=LinkedParams(require=require), unmatched=unmatched)
    return workflow.run(reads(spark, sf_dir, px.LINKED), Plan(linked=stage, adapter=AdapterStage((Adapter("flank", px.THREE),)), filter=FilterParams(min_length=1)))


def linked_rows(out: DataFrame) -> DataFrame:
    return out.select("record_index", F.col("r1.linked").alias("status"), F.col("r1.start").alias("s"), F.col("r1.end").alias("e"), "disposition")


def linked_sql(ok: str, fallback: str, verdict: str = "'accepted'") -> str:
    status = f"CASE WHEN {ok} AND e0 - s0 >= 1 THEN 'matched' WHEN {ok} THEN 'insert_too_short' WHEN h5 THEN 'five_only' WHEN h3 THEN 'three_only' ELSE 'neither' END"
    return f"""WITH {LINKED_SQL}, st AS (SELECT *, {status} AS status, list_min(list_filter(range(0, greatest(length(s) - 8 + 1, 0)), lambda p: hamming(substr(s, p + 1, least(12, length(s) - p)), substr('{px.THREE}', 1, least(12, length(s) - p))) <= floor(least(12, length(s) - p) * 0.1::DOUBLE))) AS plain FROM l),
z AS (SELECT record_index, status, CASE WHEN status = 'matched' THEN s0 ELSE 0 END AS s, CASE WHEN status = 'matched' THEN e0 ELSE {fallback} END AS e FROM st)
SELECT record_index, status, cast(s AS INTEGER) AS s, cast(e AS INTEGER) AS e, CASE WHEN e - s < 1 THEN 'rejected' ELSE {verdict} END AS disposition FROM z"""


_PLAIN = "coalesce(plain, length(s))"


@query(linked_sql("(h5 AND h3)", _PLAIN))
def linked_both(spark, sf_dir):
    return linked_rows(linked_run(spark, sf_dir))


@query(linked_sql("(h5 AND h3)", _PLAIN))
def linked_unmatched_continue(spark, sf_dir):
    return linked_rows(linked_run(spark, sf_dir, unmatched="continue"))


@query(linked_sql("(h5 OR h3)", _PLAIN))
def linked_either(spark, sf_dir):
    return linked_rows(linked_run(spark, sf_dir, "either"))


@query(linked_sql("(h5 AND h3)", "length(s)"))
def linked_unmatched_keep(spark, sf_dir):
    return linked_rows(linked_run(spark, sf_dir, unmatched="keep"))


@query(linked_sql("(h5 AND h3)", "length(s)", "CASE WHEN status = 'matched' THEN 'accepted' ELSE 'rejected' END"))
def linked_unmatched_fail(spark, sf_dir):
    return linked_rows(linked_run(spark, sf_dir, unmatched="fail"))


@query(f"WITH {LINKED_SQL}, z AS (SELECT *, h5 AND h3 AND e0 - s0 >= 1 AS ok FROM l) SELECT 'R1' AS mate, count(*) FILTER (ok) AS both, count(*) FILTER (h5 AND NOT h3) AS five_only, count(*) FILTER (h3 AND NOT h5) AS three_only, count(*) FILTER (NOT h3 AND NOT h5) AS neither, count(*) FILTER (h5 AND h3 AND NOT ok) AS short_insert, 0::BIGINT AS invalid_order, coalesce(sum(s0) FILTER (ok), 0)::BIGINT AS leading_bases, coalesce(sum(length(s) - e0) FILTER (ok), 0)::BIGINT AS trailing_bases FROM z")
def report_linked(spark, sf_dir):
    return report.linked(linked_run(spark, sf_dir))


# Segments


def segment_plan(**options) -> SegmentPlan:
    return SegmentPlan((Adapter("A", px.DELIMITER_A), Adapter("B", px.DELIMITER_B)), options=SegmentParams(**options), filter=FilterParams(min_length=12))


#: Kept delimiters by walking from the left; then the pieces between them (record_index, i, b, e, lk, rk), empty ones left out.
SEGMENT_SQL = f"""RECURSIVE {cte(px.CONCATEMERS)}, m AS (SELECT record_index, 'R1' AS mate, r1_seq AS s FROM r),
laid AS (SELECT record_index, k, p, o, hamming(substr(s, p + 1, o), substr(a, 1, o)) AS e, length(s) AS n FROM (SELECT record_index, s, k, a, p, least(length(a), length(s) - p) AS o FROM (SELECT *, unnest(range(0, length(s) - 8 + 1)) AS p FROM m) x, (VALUES (0, '{px.DELIMITER_A}'), (1, '{px.DELIMITER_B}')) t(k, a)) y),
cand AS (SELECT record_index, p, min(e * 1000000000 + cast(floor(e::DOUBLE / o * 1000) AS BIGINT) * 1000000 + (999 - o) * 1000 + k) AS key FROM laid WHERE e <= floor(o * 0.1::DOUBLE) GROUP BY ALL),
cd AS (SELECT record_index, p, p + 999 - key // 1000 % 1000 AS stop, key % 1000 AS k FROM cand),
walk AS (SELECT record_index, 0 AS i, 0::BIGINT AS p, 0::BIGINT AS stop, -1::BIGINT AS k FROM m
  UNION ALL SELECT w.record_index, w.i + 1, c.p, c.stop, c.k FROM walk w, LATERAL (SELECT p, stop, k FROM cd WHERE cd.record_index = w.record_index AND cd.p >= w.stop ORDER BY p LIMIT 1) c),
pieces AS (SELECT w.record_index, w.i, w.stop AS b, coalesce(lead(w.p) OVER (PARTITION BY w.record_index ORDER BY i), length(s)) AS e, w.k AS lk, coalesce(lead(w.k) OVER (PARTITION BY w.record_index ORDER BY i), -1) AS rk FROM walk w JOIN m USING (record_index)),
out AS (SELECT *, row_number() OVER (PARTITION BY record_index ORDER BY i) - 1 AS idx FROM pieces WHERE e > b {{}})"""
_NAME = "CASE {} WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '.' END"
_SEGMENT_COLUMNS = f"SELECT record_index AS source_record_index, cast(idx AS INTEGER) AS segment_index, 'R1' AS source_mate, cast(b AS INTEGER) AS start, cast(e AS INTEGER) AS \"end\", cast(e - b AS INTEGER) AS length, {_NAME.format('lk')} AS left_adapter, {_NAME.format('rk')} AS right_adapter, r1_header AS original_header, CASE WHEN e - b < 12 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN e - b < 12 THEN 'TOO_SHORT' ELSE 'PASS' END AS filter_reasons FROM out JOIN r USING (record_index)"


def segmented(spark, sf_dir, **options) -> DataFrame:
    return segment.run(reads(spark, sf_dir, px.CONCATEMERS), segment_plan(**options))


@query(f"WITH {SEGMENT_SQL.format('')} {_SEGMENT_COLUMNS}")
def segment_sidecar(spark, sf_dir):
    return segment.sidecar(segmented(spark, sf_dir))


@query(f"WITH {SEGMENT_SQL.format('AND lk >= 0 AND rk >= 0')} {_SEGMENT_COLUMNS}")
def segment_terminal_discard(spark, sf_dir):
    return segment.sidecar(segmented(spark, sf_dir, terminal="discard"))


@query(f"WITH {SEGMENT_SQL.format('')} SELECT record_index, concat('segment', cast(idx AS VARCHAR)) AS mate, 'FAIL' AS status, 'TOO_SHORT' AS reasons, cast(e - b AS INTEGER) AS original_length, cast(e - b AS INTEGER) AS adapter_trimmed_length, cast(e - b AS INTEGER) AS final_length, '.' AS adapter_name, '.' AS adapter_start FROM out WHERE e - b < 12")
def segment_reasons(spark, sf_dir):
    return segment.reason_rows(segmented(spark, sf_dir))


@query(f"WITH {SEGMENT_SQL.format('')} SELECT record_index, cast(idx AS INTEGER) AS segment_index, substr(r1_seq, b + 1, e - b) AS r1_seq, concat(r1_header, '|segment=', cast(idx AS VARCHAR), '|span=', cast(b AS VARCHAR), '-', cast(e AS VARCHAR)) AS r1_header FROM out JOIN r USING (record_index) WHERE e - b >= 12")
def segment_fragments(spark, sf_dir):
    return segment.passed(segmented(spark, sf_dir))


@query(f"WITH {SEGMENT_SQL.format('')} SELECT cast(n AS INTEGER) AS fragments, count(*) AS records FROM (SELECT record_index, count(idx) AS n FROM r LEFT JOIN out USING (record_index) GROUP BY record_index) x GROUP BY n")
def segment_per_source(spark, sf_dir):
    return segment.per_source(segmented(spark, sf_dir))


@query(f"WITH {SEGMENT_SQL.format('')} SELECT {_NAME.format('k')} AS delimiter, count(*) AS hits FROM walk WHERE k >= 0 GROUP BY k")
def segment_delimiter_hits(spark, sf_dir):
    return segment.delimiter_hits(segmented(spark, sf_dir), segment_plan())


@query(f"""WITH {SEGMENT_SQL.format('')}, raw AS (SELECT count(*) AS n FROM laid WHERE e <= floor(o * 0.1::DOUBLE))
SELECT (SELECT count(*) FROM r) AS records, (SELECT n FROM raw) AS candidates, (SELECT count(*) FROM walk WHERE k >= 0) AS delimiters, (SELECT n FROM raw) - (SELECT count(*) FROM walk WHERE k >= 0) AS suppressed, (SELECT count(*) FROM pieces WHERE e <= b) AS empty, 0::BIGINT AS terminal_discarded, 0::BIGINT AS too_short, 0::BIGINT AS over_limit,
count(*) AS fragments, count(*) FILTER (e - b < 12) AS fragments_failed, cast(min(e - b) AS INTEGER) AS length_min, cast(max(e - b) AS INTEGER) AS length_max, sum(e - b)::BIGINT AS length_sum FROM out""")
def segment_stats(spark, sf_dir):
    return segment.stats(segmented(spark, sf_dir))


# Sampling and sniffing


@query("WITH n AS (SELECT count(*) AS n FROM events), i AS (SELECT unnest(range(0, 777)) AS i) SELECT cast((2 * i + 1) * n // (2 * 777) AS BIGINT) AS record_index FROM i, n WHERE n >= 777")
def sample_plan(spark, sf_dir):
    return sample.sample(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("record_index")), 777)


KMER_SQL = f"""{cte(px.PAIRS)}, {sql_mates()}, km AS (SELECT DISTINCT record_index, mate, substr(t, i, 10) AS kmer FROM (SELECT record_index, mate, t, unnest(range(1, length(t) - 10 + 2)) AS i FROM (SELECT record_index, mate, right(s, 60) AS t FROM m) x) y),
kc AS (SELECT mate, kmer, count(*) AS reads FROM km WHERE NOT contains(kmer, 'N') GROUP BY ALL)"""
SEED_SQL = f"""{KMER_SQL}, inf AS (SELECT * FROM kc WHERE mate = 'R1' AND reads >= 20 AND greatest(length(replace(kmer, 'A', '')) * -1 + 10, length(replace(kmer, 'C', '')) * -1 + 10, length(replace(kmer, 'G', '')) * -1 + 10, length(replace(kmer, 'T', '')) * -1 + 10) <= 7.5
  AND substr(kmer, 2) <> substr(kmer, 1, 9) AND substr(kmer, 3) <> substr(kmer, 1, 8) AND substr(kmer, 4) <> substr(kmer, 1, 7) AND len(list_filter(range(2, 11), lambda i: substr(kmer, i, 1) <> substr(kmer, i - 1, 1))) / 9.0::DOUBLE >= 0.3::DOUBLE),
sd AS (SELECT kmer, reads FROM inf ORDER BY reads DESC, kmer LIMIT 32)"""


@query(f"WITH {KMER_SQL} SELECT mate, kmer, reads FROM kc")
def tail_kmers(spark, sf_dir):
    return sniff.tail_kmers(sniff.by_mate(reads(spark, sf_dir, px.PAIRS)))


@query(f"WITH {SEED_SQL} SELECT kmer, reads FROM inf")
def informative_kmers(spark, sf_dir):
    counted = sniff.tail_kmers(sniff.by_mate(reads(spark, sf_dir, px.PAIRS)))
    return counted.filter((F.col("mate") == "R1") & (F.col("reads") >= 20) & fs.informative(F.col("kmer"), 10)).select("kmer", "reads")


@query(f"WITH {SEED_SQL} SELECT kmer, reads FROM sd")
def seed_top32(spark, sf_dir):
    return sniff.seeds(sniff.tail_kmers(sniff.by_mate(reads(spark, sf_dir, px.PAIRS))), "R1", 20)


_SEED = px.TRUSEQ_R1[:10]


@query(f"""WITH {cte(px.PAIRS)}, x AS (SELECT r1_seq AS s, instr(r1_seq, '{_SEED}') AS p FROM r WHERE contains(r1_seq, '{_SEED}')),
v AS (SELECT 'right' AS side, c AS col, substr(s, p + c, 1) AS base FROM (SELECT *, unnest(range(0, 60)) AS c FROM x) y WHERE p + c <= length(s) UNION ALL SELECT 'left', c, substr(s, p - 1 - c, 1) FROM (SELECT *, unnest(range(0, 60)) AS c FROM x) y WHERE p - 1 - c >= 1)
SELECT side, cast(col AS INTEGER) AS col, base, count(*) AS n FROM v WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL UNION ALL SELECT NULL, -1, NULL, count(*) FROM x""")
def consensus_votes(spark, sf_dir):
    votes = sniff.consensus_votes(sniff.by_mate(reads(spark, sf_dir, px.PAIRS)), {"R1": [_SEED]})
    return votes.select("side", "col", "base", "n")


@query(f"""WITH {cte(px.PAIRS)}, {OVERLAP_SQL}, x AS (SELECT 'R1' AS mate, r1_seq AS s, least(o + 80, 80) AS b FROM r JOIN ov USING (record_index) UNION ALL SELECT 'R2', r2_seq, least(o + 80, 80) FROM r JOIN ov USING (record_index)), h AS (SELECT * FROM x WHERE length(s) >= b + 10)
SELECT mate, cast(c AS INTEGER) AS col, substr(s, b + c + 1, 1) AS base, count(*) AS n FROM (SELECT *, unnest(range(0, 60)) AS c FROM h) y WHERE b + c < length(s) GROUP BY ALL UNION ALL SELECT mate, -1, NULL, count(*) FROM h GROUP BY mate""")
def overhang_votes(spark, sf_dir):
    return sniff.overhang_votes(reads(spark, sf_dir, px.PAIRS))


def tallies_of(t: DataFrame) -> dict[str, dict[str, dict[int, int]]]:
    """The tallies of one candidate a mate: mate, what, value."""
    out: dict[str, dict[str, dict[int, int]]] = {}
    for r in t.collect():
        out.setdefault(r["mate"], {}).setdefault(r["what"], {})[r["value"]] = r["n"]
    return out


@query(f"WITH {cte(px.PAIRS)}, {sql_mates()}, {sql_hits(TRUSEQ)} SELECT mate, count(*) AS supporting, count(*) FILTER (p + 33 >= 80) AS tail_connected, count(*) FILTER (p + 60 >= 80) AS tail, count(*) FILTER (p + 60 < 80) AS body, sum(e)::BIGINT AS errors, sum(o)::BIGINT AS overlap, cast(quantile_disc(p, 0.5) AS INTEGER) AS median_start FROM hit GROUP BY mate")
def candidate_support(spark, sf_dir):
    found = tallies_of(sniff.verify(sniff.by_mate(reads(spark, sf_dir, px.PAIRS)), {"R1": [px.TRUSEQ_R1], "R2": [px.TRUSEQ_R2]}, MatchParams()))
    names = ("supporting", "tail_connected", "tail", "body", "errors", "overlap")
    rows = [(mate, *[sum(t.get(x, {}).values()) for x in names], sniff.median(t.get("start", {}))) for mate, t in found.items()]
    return spark.createDataFrame(rows, "mate string, " + ", ".join(f"{x} long" for x in names) + ", median_start int")


_METRICS = "support_fraction double, tail_connected double, enrichment double, median_to_end int, mean_error double, confidence string"


@query(f"""WITH {cte(px.PAIRS)}, {sql_mates()}, {sql_hits(TRUSEQ)}, n AS (SELECT mate, count(*) AS reads, sum(least(60, length(s), greatest(length(s) - 7, 0)))::DOUBLE AS tp, sum(greatest(length(s) - 7, 0) - least(60, length(s), greatest(length(s) - 7, 0)))::DOUBLE AS bp FROM m GROUP BY mate),
g AS (SELECT mate, count(*)::DOUBLE AS k, count(*) FILTER (p + 33 >= 80) AS tc, count(*) FILTER (p + 60 >= 80)::DOUBLE AS tail, count(*) FILTER (p + 60 < 80)::DOUBLE AS body, sum(e)::DOUBLE AS errors, sum(o)::DOUBLE AS bases, quantile_disc(80 - p, 0.5) AS away FROM hit GROUP BY mate),
x AS (SELECT mate, k / reads AS support_fraction, tc / k AS tail_connected, (tail / tp) / (nullif(body, 0) / bp) AS enrichment, cast(away AS INTEGER) AS median_to_end, errors / bases AS mean_error, reads, k FROM n JOIN g USING (mate))
SELECT mate, support_fraction, tail_connected, enrichment, median_to_end, mean_error, CASE WHEN reads < 100 OR k < 20 OR mean_error > 0.1::DOUBLE THEN 'low' WHEN (median_to_end - 33 <= 3 OR tail_connected >= 0.8::DOUBLE) AND support_fraction >= 0.01::DOUBLE THEN 'high' ELSE 'medium' END AS confidence FROM x""")
def candidate_metrics(spark, sf_dir):
    """Shares, enrichment, medians and the confidence of a known candidate."""
    mates = sniff.by_mate(reads(spark, sf_dir, px.PAIRS))
    scans = {r["mate"]: r.asDict() for r in sniff.scan_totals(mates, 8).collect()}
    found = tallies_of(sniff.verify(mates, {"R1": [px.TRUSEQ_R1], "R2": [px.TRUSEQ_R2]}, MatchParams()))
    known = sniff.Candidate("", "TruSeq", "adapter", 0, ("known_database",))
    made = [(m, sniff.measured(replace(known, sequence=x), found[m], scans[m], sniff.Gates())) for m, x in (("R1", px.TRUSEQ_R1), ("R2", px.TRUSEQ_R2))]
    return spark.createDataFrame([(m, c.support_fraction, c.tail_connected, c.enrichment, c.median_to_end, c.mean_error, c.confidence) for m, c in made], f"mate string, {_METRICS}")


@query(f"""WITH {cte(px.PAIRS)}, x AS (SELECT r1_seq AS s, instr(r1_seq, '{_SEED}') AS p FROM r WHERE contains(r1_seq, '{_SEED}')), n AS (SELECT count(*) AS voting FROM x),
v AS (SELECT 'right' AS side, c, substr(s, p + c, 1) AS base FROM (SELECT *, unnest(range(0, 60)) AS c FROM x) y WHERE p + c <= length(s) UNION ALL SELECT 'left', c, substr(s, p - 1 - c, 1) FROM (SELECT *, unnest(range(0, 60)) AS c FROM x) y WHERE p - 1 - c >= 1),
k AS (SELECT side, c, base, count(*) AS n FROM v WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL), w AS (SELECT side, c, sum(n) AS total, max(n) AS top, arg_max(base, n * 10 - ascii(base) / 100.0) AS base FROM k GROUP BY ALL),
ok AS (SELECT side, c, base FROM w, n WHERE total >= 0.5::DOUBLE * voting AND top >= 0.6::DOUBLE * total), stop AS (SELECT side, min(c) AS c FROM (SELECT side, c FROM (VALUES ('left'), ('right')) s(side), range(0, 61) r(c) EXCEPT SELECT side, c FROM ok) z GROUP BY side),
l AS (SELECT coalesce(string_agg(base, '' ORDER BY ok.c DESC), '') AS s FROM ok JOIN stop USING (side) WHERE side = 'left' AND ok.c < stop.c), g AS (SELECT coalesce(string_agg(base, '' ORDER BY ok.c), '') AS s FROM ok JOIN stop USING (side) WHERE side = 'right' AND ok.c < stop.c)
SELECT substr(l.s || g.s, 1, 60) AS sequence FROM l, g""")
def consensus_sequence(spark, sf_dir):
    """What the votes around one seed read."""
    sides: dict[str, dict[int, dict[str, int]]] = {"right": {}, "left": {}}
    voting = 0
    for r in sniff.consensus_votes(sniff.by_mate(reads(spark, sf_dir, px.PAIRS)), {"R1": [_SEED]}).collect():
        if r["col"] < 0:
            voting = r["n"]
        else:
            sides[r["side"]].setdefault(r["col"], {})[r["base"]] = r["n"]
    return spark.createDataFrame([(sniff.read_off(sides["right"], sides["left"], voting),)], "sequence string")


@query(f"WITH {cte(px.PAIRS)}, {sql_mates()} SELECT mate, count(*) AS sampled, sum(least(60, length(s), greatest(length(s) - 7, 0)))::BIGINT AS tail_positions, sum(greatest(length(s) - 7, 0) - least(60, length(s), greatest(length(s) - 7, 0)))::BIGINT AS body_positions, count(*) FILTER (length(s) >= 60 AND 60 - length(replace(right(s, 60), 'A', '')) >= 54) AS poly_a, count(*) FILTER (length(s) >= 60 AND 60 - length(replace(right(s, 60), 'G', '')) >= 54) AS poly_g FROM m GROUP BY mate")
def sniff_scan(spark, sf_dir):
    return sniff.scan_totals(sniff.by_mate(reads(spark, sf_dir, px.PAIRS)), 8)


@query(f"SELECT * FROM (VALUES ('R1', 'confident', '{px.TRUSEQ_R1}', 'illumina-truseq', 'high'), ('R2', 'confident', '{px.TRUSEQ_R2}', 'illumina-truseq', 'high')) t(mate, decision, sequence, known_name, confidence)")
def sniff_decision(spark, sf_dir):
    """The planted adapters, found without being told."""
    rows = sample.with_offsets(reads(spark, sf_dir, px.PAIRS))
    found = sniff.sniff(rows, catalogue.load())
    out = [(m.mate, m.decision, m.recommended.sequence, m.recommended.known_name, m.recommended.confidence) for m in found.mates if m.recommended]
    return spark.createDataFrame(out, "mate string, decision string, sequence string, known_name string, confidence string")


# Strand

STRAND_SQL = f"""{cte(px.TRANSCRIPTS, "tr")}, {cte(px.TRANSCRIPT_READS)}, ix AS (SELECT transcript, i AS pos, substr(sequence, i, 21) AS kmer FROM (SELECT *, unnest(range(1, length(sequence) - 21 + 2)) AS i FROM tr) x),
o AS (SELECT record_index, 1 AS mate, true AS sense, r1_seq AS s FROM r UNION ALL SELECT record_index, 1, false, reverse(translate(r1_seq, 'ACGT', 'TGCA')) FROM r UNION ALL SELECT record_index, 2, true, r2_seq FROM r UNION ALL SELECT record_index, 2, false, reverse(translate(r2_seq, 'ACGT', 'TGCA')) FROM r),
k AS (SELECT DISTINCT record_index, mate, sense, substr(s, i, 21) AS kmer FROM (SELECT *, unnest(range(1, length(s) - 21 + 2)) AS i FROM o) x),
mp AS (SELECT record_index, mate, transcript, sense, count(*) AS hits, min(pos) AS pos FROM k JOIN ix USING (kmer) GROUP BY ALL),
b AS (SELECT x.record_index, x.hits + y.hits AS hits, concat(CASE WHEN x.sense = y.sense THEN 'M' WHEN (CASE WHEN x.sense THEN x.pos <= y.pos ELSE y.pos <= x.pos END) THEN 'I' ELSE 'O' END, 'S', CASE WHEN x.sense THEN 'F' ELSE 'R' END) AS f FROM mp x JOIN mp y ON x.record_index = y.record_index AND x.transcript = y.transcript AND x.mate = 1 AND y.mate = 2),
t AS (SELECT record_index, max(hits) AS hits FROM b GROUP BY record_index), fm AS (SELECT record_index, CASE WHEN min(f) = max(f) THEN min(f) ELSE 'ambiguous' END AS format FROM b JOIN t USING (record_index, hits) GROUP BY record_index)"""


@query(f"WITH {STRAND_SQL} SELECT record_index, format FROM fm")
def strand_kmer_map(spark, sf_dir):
    return strand.formats(reads(spark, sf_dir, px.TRANSCRIPT_READS), reads(spark, sf_dir, px.TRANSCRIPTS), 21)


@query(f"WITH {STRAND_SQL} SELECT format, count(*) AS records FROM fm GROUP BY format")
def strand_tally(spark, sf_dir):
    return strand.tally(strand.formats(reads(spark, sf_dir, px.TRANSCRIPT_READS), reads(spark, sf_dir, px.TRANSCRIPTS), 21))


_P = strand.StrandParams()


@query(f"""WITH {STRAND_SQL}, nr AS (SELECT record_index, row_number() OVER (ORDER BY record_index) - 1 AS ord FROM r), j AS (SELECT ord // {_P.batch} AS b, format FROM nr LEFT JOIN fm USING (record_index)),
bt AS (SELECT b, count(*) FILTER (format <> 'ambiguous') AS n FROM j GROUP BY b), cm AS (SELECT b, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bt),
used AS (SELECT format FROM j WHERE b <= (SELECT max(b) FROM cm WHERE before < {_P.target_informative})),
c AS (SELECT count(*) AS examined, count(*) FILTER (format = 'ambiguous') AS ambiguous, count(*) FILTER (format LIKE '%SF') AS f, count(*) FILTER (format LIKE '%SR') AS v, count(*) FILTER (format LIKE 'I%') AS i, count(*) FILTER (format LIKE 'O%') AS o, count(*) FILTER (format LIKE 'M%') AS m FROM used),
e AS (SELECT *, f + v > 0 AND f + v >= {_P.min_informative} AND (f + v)::DOUBLE / examined >= {_P.min_informative_fraction}::DOUBLE AS enough FROM c),
s AS (SELECT *, CASE WHEN NOT enough THEN 'undetermined' WHEN f::DOUBLE / (f + v) >= 0.8::DOUBLE THEN 'forward' WHEN v::DOUBLE / (f + v) >= 0.8::DOUBLE THEN 'reverse' WHEN abs(f - v)::DOUBLE / (f + v) < 0.1::DOUBLE THEN 'unstranded' ELSE 'undetermined' END AS strandedness,
  CASE WHEN NOT enough OR i + o + m = 0 THEN 'undetermined' WHEN i >= o AND i >= m THEN 'inward' WHEN o >= m THEN 'outward' ELSE 'matching' END AS orientation FROM e)
SELECT examined, ambiguous, f AS forward, v AS reverse, strandedness, orientation, CASE WHEN enough THEN (CASE orientation WHEN 'inward' THEN 'I' WHEN 'outward' THEN 'O' WHEN 'matching' THEN 'M' ELSE '' END) || (CASE strandedness WHEN 'forward' THEN 'SF' WHEN 'reverse' THEN 'SR' ELSE 'U' END) END AS library_type,
  CASE strandedness WHEN 'unstranded' THEN '0' WHEN 'forward' THEN '1' WHEN 'reverse' THEN '2' END AS featurecounts, CASE strandedness WHEN 'unstranded' THEN 'no' WHEN 'forward' THEN 'yes' WHEN 'reverse' THEN 'reverse' END AS htseq FROM s""")
def strand_classify(spark, sf_dir):
    """Batches in order up to the target, the evidence gate, strandedness, library type and what other tools call it."""
    rows = reads(spark, sf_dir, px.TRANSCRIPT_READS)
    found = strand.sniff(rows, reads(spark, sf_dir, px.TRANSCRIPTS))
    pick = lambda names: sum(found.counts.get(f, 0) for f in names)
    out = (found.examined, found.ambiguous, pick(strand.FORWARD), pick(strand.REVERSE), found.strandedness, found.orientation, found.library_type, None if found.featurecounts is None else str(found.featurecounts), found.htseq)
    return spark.createDataFrame([out], "examined long, ambiguous long, forward long, reverse long, strandedness string, orientation string, library_type string, featurecounts string, htseq string")
