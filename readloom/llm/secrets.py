"""Secret scans over an incremental ledger of content-addressed texts, in DataFrame functions only.

Every historical version of a path is a blob named by the SHA-256 of its text. The ledger
holds what each (blob, rule, rule version) gave, so a scan reads a blob only for the rule
versions that the ledger lacks, once however many paths share it; findings are joined
back to every path. Raise a rule's version when its pattern changes.

A stored ledger is a folder of Parquet: `update` scans what it lacks and appends, `load`
reads it. Only identities are compared with it; texts are shuffled for unseen blobs alone.

Ledger: blob_id string, results array<struct<kind, version, spans array<struct<start, end>>>>,
a row for each scan of a blob. Spans are in code points, the end exclusive.

Defined cases: null text is empty; empty texts have no findings; repeated rows share a
blob and are each reported; null ids are kept; very long texts are scanned whole; ties of
place are listed in the order of the rules; an empty table gives an empty result; other
columns are carried by `findings`, but for blob_id and results, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import shared

SPAN = "struct<start:int,end:int>"
RESULTS = f"array<struct<kind:string,version:int,spans:array<{SPAN}>>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: Least length of group `group`, or 0.
    group: int = 0
    least: int = 0


#: The first three are the base; hex and access runs are bounded in the pattern, which a maximal run allows.
RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("vendor", 1, r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost matches of a rule, without overlap. Their places follow from the lengths of the pieces between them."""
    pattern = F.lit(rule.pattern)
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        ok = x["hit"].isNotNull()
        if rule.least:
            ok &= F.length(F.regexp_extract(F.coalesce(x["hit"], F.lit("")), rule.pattern, rule.group)) >= rule.least
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(ok, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(rule.pattern), F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]).otherwise(none)


def blob_id() -> Column:
    return F.sha2(shared.text_of(), 256)


def _name(kind: Column | str, version: Column) -> Column:
    return F.concat_ws("@", kind, version.cast("string"))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the (blob, rule version) pairs of `history` (text) that `ledger` lacks."""
    texts = history.select(blob_id().alias("blob_id"), shared.text_of().alias("text"))
    if ledger is None:
        blobs = texts.dropDuplicates(["blob_id"]).withColumn("seen", F.array().cast("array<string>"))
    else:
        done = ledger.select("blob_id", F.explode("results").alias("r")).groupBy("blob_id").agg(F.collect_set(_name(F.col("r.kind"), F.col("r.version"))).alias("seen"))
        asked = history.select(blob_id().alias("blob_id")).distinct().join(done, "blob_id", "left").select("blob_id", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"))
        asked = asked.filter(~F.forall(F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules]), lambda k: F.array_contains("seen", k)))
        # written, so that the join deals out plain tables and Spark may send a small one or split a blob of many rows
        blobs = texts.join(shared.materialize(asked, "asked"), "blob_id").dropDuplicates(["blob_id"])
    each = [F.when(~F.array_contains("seen", f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    return blobs.select("blob_id", F.filter(F.array(*each), lambda x: x.isNotNull()).cast(RESULTS).alias("results"))


LEDGER = f"blob_id string, results {RESULTS}"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored at `path`, empty if there is none."""
    return spark.read.schema(LEDGER).parquet(path) if shared.exists(spark, path) else spark.createDataFrame([], LEDGER)


def update(history: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger stored at `path` lacks of `history` and append it; how many blobs were scanned."""
    spark = history.sparkSession
    ledger = load(spark, path) if shared.exists(spark, path) else None
    before = ledger.count() if ledger is not None else 0
    scan(history, ledger, rules).write.mode("append").parquet(path)
    return load(spark, path).count() - before


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`history`, without columns of these names, with blob_id and results: what the ledger holds for its text under `rules`, rules without spans left out."""
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    with_spans = lambda x: (F.size(x["spans"]) > 0) & F.array_contains(current, _name(x["kind"], x["version"]))
    found = ledger.select("blob_id", F.filter("results", with_spans).alias("results")).filter(F.size("results") > 0)
    # written, so that both sides of the join are plain and Spark may split a blob that many rows share
    found = shared.materialize(found.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("results"))).alias("results")), "findings")
    named = history.drop("blob_id", "results").withColumn("blob_id", blob_id())
    return named.join(found, "blob_id", "left").withColumn("results", F.coalesce("results", F.array().cast(RESULTS)))


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans of findings()."""
    order = {r.kind: k for k, r in enumerate(RULES)}

    def of(kind: str) -> Column:
        return F.flatten(F.transform(F.filter("results", lambda x: x["kind"] == kind), lambda x: x["spans"]))

    def placed(kind: str) -> Column:
        return F.transform(of(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order[kind]).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*map(placed, kinds))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(BASE), 256).alias("base_sha256"), listed(tuple(r.kind for r in RULES)).alias("spans"))
