"""Runs over whole tables: golden sidecars, metamorphic laws, schemas, sinks and the command line."""

import itertools
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from readloom import cli, reporting, sinks
from readloom.functions import scalars, umi
from readloom.kernels.trim import FilterParams, TrimParams
from readloom.operators import dedup, outputs, report, sample, segment, sniff, strand, workflow
from readloom.plans import projections as px
from readloom.plans.config import Adapter, AdapterStage, Plan, SegmentPlan, UmiStage, merge, plan_from
from readloom.queries import NAMES, PARITY, reads
from readloom.schema import Presence, checked
from readloom.sources import catalogue
from readloom.sources import reads as source


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def pairs(spark):
    df = reads(spark, "/root/testdata/sf0.001", px.PAIRS).cache()
    df.count()
    return df


def test_every_schema_is_kept(spark, pairs):
    full = pairs.withColumn("flag", F.lit(str(2**63 + 5)).cast("decimal(20,0)")).limit(40)
    for paired, quality, headers, flags in itertools.product((True, False), repeat=4):
        keep = Presence(paired, quality, headers, flags)
        own = full.select(*keep.columns())
        plan = Plan(adapter=AdapterStage((Adapter("a", px.TRUSEQ_R1),)), filter=FilterParams(min_length=30))
        out = outputs.accepted(workflow.run(own, plan))
        assert out.columns == keep.columns() and Presence.of(out) == keep
        for r in out.collect():
            if quality:
                assert len(r.r1_seq) == len(r.r1_qual)
            if flags:
                assert int(r.flag) == 2**63 + 5


def test_results_do_not_depend_on_partitions_or_batches(spark, pairs):
    want = rows(outputs.accepted(workflow.run(pairs.coalesce(1), PARITY)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(outputs.accepted(workflow.run(pairs.repartition(9), PARITY))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stages_one_by_one_are_the_fused_run(pairs):
    fused = outputs.accepted(workflow.run(pairs, PARITY))
    one = outputs.accepted(workflow.run(pairs, Plan(adapter=PARITY.adapter)))
    two = outputs.accepted(workflow.run(one, Plan(trim=PARITY.trim)))
    three = outputs.accepted(workflow.run(two, Plan(filter=PARITY.filter)))
    assert rows(three) == rows(fused)
    tagged = umi.extract(pairs, UmiStage("read1", 8, 2))
    assert rows(outputs.accepted(workflow.run(tagged, PARITY))) == rows(outputs.accepted(workflow.run(pairs, Plan(umi=UmiStage("read1", 8, 2), adapter=PARITY.adapter, trim=PARITY.trim, filter=PARITY.filter))))


def test_the_lean_run_gives_the_accepted_records(spark, pairs):
    umi_plan = replace(PARITY, umi=UmiStage("read1", 6, 1))
    for df, plan in ((pairs, PARITY), (pairs, umi_plan), (pairs.select("record_index", "r1_seq", "r1_qual"), Plan(filter=FilterParams(min_length=70))), (pairs.select("record_index", "r1_seq", "r2_seq").limit(0), Plan(filter=FilterParams(min_length=70)))):
        want = outputs.accepted(workflow.run(df, plan))
        got = workflow.accepted(df, plan)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)


def test_outputs_share_the_records(pairs):
    plan = Plan(adapter=PARITY.adapter, trim=PARITY.trim, filter=FilterParams(min_length=40), pair_policy="orphan")
    result = workflow.run(pairs, plan).cache()
    parts = [outputs.accepted(result), outputs.failed(result), outputs.orphans(result, 1), outputs.orphans(result, 2)]
    assert sum(p.count() for p in parts) == pairs.count() and all(p.count() for p in parts)
    c = report.counts(result).first()
    assert c.records_in == c.records_out + c.records_rejected + c.orphaned_r1 + c.orphaned_r2
    assert outputs.reason_rows(result, NAMES).count() == 2 * (c.records_in - c.records_out)
    gone = report.by_mate(result).selectExpr("f.original_length - f.adapter_trimmed_length + aggregate(f.removed, 0, (a, x) -> a + x) + (f.end - f.start) - f.original_length AS off").filter("off <> 0")
    assert gone.count() == 0
    assert sum(r.records for r in report.combinations(result).collect()) == c.records_in - c.records_out


def frame(spark, *rows_, schema="record_index bigint, r1_seq string, r1_qual string"):
    return spark.createDataFrame(list(rows_), schema)


def test_reason_sidecar_golden(spark):
    df = frame(spark, (0, "T" * 20 + px.TRUSEQ_R1, "I" * 53), (1, "ACGT", "!!!!"))
    plan = Plan(adapter=AdapterStage((Adapter("TruSeq", px.TRUSEQ_R1),)), filter=FilterParams(min_length=21, min_mean_quality=20))
    got = [tuple(r) for r in outputs.reason_rows(workflow.run(df, plan), (("TruSeq",), ())).orderBy("record_index").collect()]
    assert got == [(0, "R1", "FAIL", "TOO_SHORT", 53, 20, 20, "TruSeq", "20"), (1, "R1", "FAIL", "TOO_SHORT/LOW_MEAN_QUAL", 4, 4, 4, ".", ".")]


def test_errors_name_the_record(spark):
    bad = frame(spark, (7, "ACGT", "II I"))
    for job in (workflow.run(bad, Plan(filter=FilterParams(min_mean_quality=2))), checked(bad)):
        with pytest.raises(Exception, match="record 7"):
            job.collect()
    assert workflow.run(bad, Plan(filter=FilterParams(min_length=2))).count() == 1  # qualities that are not needed are not judged
    with pytest.raises(Exception, match="differ in length"):
        workflow.run(frame(spark, (1, "ACGT", "I")), Plan(filter=FilterParams(min_length=2))).collect()
    with pytest.raises(Exception, match="shorter than"):
        umi.extract(frame(spark, (1, "ACGT", "IIII", "h"), schema="record_index bigint, r1_seq string, r1_qual string, r1_header string"), UmiStage("read1", 8)).collect()


def test_umi_headers(spark):
    df = spark.createDataFrame([(0, "ACGTACGTTT", "read_0 1:N:0:TATAGCCT+GGTCCCGA"), (1, "ACGTACGTTT", "r:AB")], "record_index bigint, r1_seq string, r1_header string")
    one = umi.extract(df.filter("record_index = 0"), UmiStage("index1")).first()
    assert one.r1_header == "read_0:TATAGCCT 1:N:0:TATAGCCT+GGTCCCGA" and one.r1_seq == "ACGTACGTTT"
    assert umi.extract(df.filter("record_index = 1"), UmiStage("read1", 4)).first().r1_header == "r:AB:ACGT"
    # the last two characters never start an index
    got = spark.createDataFrame([("a:bc:d", "bc:d"), ("a:bcd+ef", "bcd"), ("a:bcd+e", "bcd+e"), ("aaa:bb", "bb")], "h string, want string")
    assert [r.x for r in got.select(umi.index1(F.col("h")).alias("x")).collect()] == [r.want for r in got.collect()]


def test_duplicates(spark):
    df = spark.createDataFrame([(5, "AC", "CGT"), (3, "ACC", "GT"), (9, "AC", "CGT"), (1, "AN", "A"), (2, "AN", "A")], "record_index bigint, r1_seq string, r2_seq string")
    assert sorted(r.record_index for r in dedup.dedup(df).collect()) == [1, 3, 5]
    assert tuple(dedup.stats(df).first()) == (5, 3, 2, 0.4, 4, 2)
    assert tuple(dedup.stats(df.limit(0)).first()) == (0, 0, 0, 0.0, 0, 0)


@pytest.mark.parametrize(("n", "size"), [(1000, 7), (13, 5), (7, 7), (10, 99), (1, 1)])
def test_sample_points(spark, n, size):
    got = [r.record_index for r in sample.sample(spark.range(n).withColumnRenamed("id", "record_index"), size).orderBy("record_index").collect()]
    s = min(n, size)
    assert got == [(2 * i + 1) * n // (2 * s) for i in range(s)]


def test_sample_of_a_span(spark):
    df = spark.range(2000).withColumnRenamed("id", "record_index")
    got = [r.record_index for r in sample.sample(df, 10, 500, 1500).orderBy("record_index").collect()]
    assert got[0] == 550 and len(got) == 10 and max(got) < 1500
    with pytest.raises(ValueError):
        sample.span(df, 10, 5)
    ranked = sample.with_offsets(df.filter("record_index % 3 = 0"))
    assert sorted(r.record_index for r in ranked.collect()) == list(range(667))


def test_plans_are_checked(pairs):
    with pytest.raises(ValueError, match="position 3"):
        Adapter.of("x", "ACX")
    for bad in ({}, {"trim": {"window": 0, "front": 1}}, {"filter": {}}, {"filter": {"max_n_fraction": 2.0}}, {"filter": {"min_length": 9, "length_limit": 3}}, {"adapter": {}}, {"adapter": {"r1": ["ACG"]}}, {"pair_policy": "orphan", "trim": {"front": 1}}, {"trim": {"quality_right": 1, "quality_tail": 1}}, {"linked": {"r1": []}}, {"correction": {"donor": 5, "recipient": 9}}, {"umi": {"location": "read1"}}):
        with pytest.raises(ValueError):
            plan_from(bad).validate(True, True, True)
    with pytest.raises(ValueError, match="unknown key"):
        plan_from({"trim": {"colour": 1}})
    with pytest.raises(ValueError):
        plan_from({"correction": {}}).validate(False, True, True)
    with pytest.raises(ValueError):
        Plan(trim=(TrimParams(front=1),) * 2).only(("filter",))
    with pytest.raises(ValueError):
        Plan(trim=(TrimParams(front=1),) * 2).without("trim")
    p = plan_from({"trim": {"front": 1, "front_r2": 4}, "adapter": {"r1": ["acgtacgtac"]}})
    assert (p.trim[0].front, p.trim[1].front, p.adapter.r1[0].sequence) == (1, 4, "ACGTACGTAC")
    assert merge({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2]}, "b": None}) == {"a": {"x": 1, "y": [2]}, "b": 2}
    assert PARITY.stages == ("adapter", "trim", "filter")
    with pytest.raises(ValueError):
        SegmentPlan((Adapter("d", "ACGTACGTAC"),)).validate(True)


def test_families():
    assert scalars.related("", "ACGT") and scalars.related(px.TRUSEQ_R1, px.TRUSEQ_R1[3:25])
    assert not scalars.related(px.TRUSEQ_R1, px.NEXTERA)
    for a, b in itertools.combinations([px.TRUSEQ_R1, px.TRUSEQ_R2, px.NEXTERA, px.FIVE, px.THREE], 2):
        assert scalars.related(a, b) == scalars.related(b, a)
    assert scalars.edit_distance("kitten", "sitting") == 3


def test_sniffing_is_sure_of_what_is_there_and_not_of_repeats(spark, pairs):
    found = sniff.sniff(sample.with_offsets(pairs), [], sniff.SniffParams(sample=1500))
    assert found.decision == "confident"
    for m, want in zip(found.mates, (px.TRUSEQ_R1, px.TRUSEQ_R2), strict=True):
        assert m.recommended.sequence.startswith(want[:20]) or want.startswith(m.recommended.sequence[:20])
        assert m.recommended.known_name is None
    plan = reporting.with_detected(Plan(filter=FilterParams(min_length=1)), found)
    assert plan.adapter.r1 and plan.adapter.r2 and reporting.config_toml(found).startswith("[adapter]")
    table = reporting.adapters_tsv(reporting.adapters_report(found, "x", sniff.SniffParams()))
    assert table.splitlines()[0].split("\t") == list(reporting.TSV_COLUMNS)
    repeat = spark.range(3000).selectExpr("id AS record_index", f"concat({px.bases('id', 'a', 'b')}, 'CCTGAGCTAAGCTT', {px.bases('id', 'c')}) AS r1_seq")
    none = sniff.sniff(repeat, [], sniff.SniffParams(sample=3000))
    assert none.decision == "inconclusive"
    with pytest.raises(ValueError):
        reporting.config_toml(none)


def test_strand_layers():
    p = strand.StrandParams(min_informative=100)
    assert strand.classify({"ISR": 900, "ISF": 100}, 1000, True, p).strandedness == "reverse"
    mixed = strand.classify({"ISR": 480, "ISF": 520, "ambiguous": 7}, 2000, True, p)
    assert (mixed.strandedness, mixed.library_type, mixed.featurecounts, mixed.htseq) == ("unstranded", "IU", 0, "no")
    few = strand.classify({"ISF": 50}, 1000, True, p)
    assert (few.strandedness, few.failure_reason, few.featurecounts) == ("undetermined", "insufficient_mapping_evidence", None)
    assert strand.classify({"SF": 700, "SR": 300}, 1000, False, p).strandedness == "undetermined"
    with pytest.raises(ValueError):
        strand.StrandParams(stranded=0.2).validate()


def test_the_catalogue_and_fasta(tmp_path):
    entries = catalogue.load()
    assert entries[0].sequence_of("R2") == px.TRUSEQ_R2 and entries[1].sequence_of("R2") == entries[1].r1
    assert {e.category for e in entries} == {"adapter", "primer", "control"}
    assert len(entries) == 234 == len({e.name for e in entries})
    assert [e.name for e in entries[:3]] == ["illumina-truseq", "nextera", "small-rna"] and entries[-1].name == "qiaseq-mirna"
    csv = tmp_path / "own.csv"
    csv.write_text("name,r1,r2\none,ACGT,\ntwo,GGGG,CCCC\n")
    assert [(e.name, e.sequence_of("R2")) for e in catalogue.load(csv)] == [("one", "ACGT"), ("two", "CCCC")]
    f = tmp_path / "a.fa"
    f.write_text(">one first\r\nACGT\r\n\r\nacgt\n>two\nTTTT\n")
    assert [(a.name, a.sequence) for a in catalogue.read_fasta(f)] == [("one", "ACGTACGT"), ("two", "TTTT")]
    for bad in ("", "ACGT\n", ">\nACGT\n", ">x\nAC-T\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            catalogue.read_fasta(f)


def test_publishing_is_whole_or_not_at_all(spark, pairs, tmp_path):
    path = str(tmp_path / "out")
    sinks.publish(pairs, path)
    with pytest.raises(ValueError, match="force"):
        sinks.publish(pairs.limit(1), path)
    assert spark.read.parquet(path).count() == pairs.count()
    sinks.publish(pairs.limit(0), path, force=True)
    assert spark.read.parquet(path).count() == 0  # no rows is a result too
    for outs, ins in (([path, path], []), ([path], [path])):
        with pytest.raises(ValueError):
            sinks.reserve(spark, ins, outs, force=True)
    assert sinks.as_tsv({"a": {"b": [1, None]}, "c": True}) == "a.b[0]\t1\na.b[1]\t\nc\ttrue\n"
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]


def test_record_indices_from_files(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(100).selectExpr("concat('ACGT', id) AS r1_seq").repartition(3).write.parquet(path)
    got = sorted(r.record_index for r in source.read(spark, path).collect())
    assert got == list(range(100)) and source.read(spark, path, 10, 20).count() == 10


def test_command_line(spark, pairs, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sinks.publish(pairs, src)
    config = tmp_path / "c.toml"
    config.write_text(f'[adapter]\nr1 = ["{px.TRUSEQ_R1}"]\nr2 = ["{px.TRUSEQ_R2}"]\n[trim]\nquality_tail = 20\n[filter]\nmin_length = 50\n')
    args = ["workflow", src, "-o", out, "--config", str(config), "--filter-min-length", "20", "--report", str(tmp_path / "r.json"), "--failed", str(tmp_path / "f"), "--failed-reasons", str(tmp_path / "why"), "-q"]
    assert cli.main(args, spark) == 0
    assert rows(spark.read.parquet(out)) == rows(outputs.accepted(workflow.run(pairs, PARITY)))
    found = json.loads((tmp_path / "r.json").read_text())
    assert found["counts"]["records_out"] == spark.read.parquet(out).count() and found["linked"] is None
    assert cli.main(args, spark) == 2  # the outputs exist
    assert cli.main(["dedup", src, "-o", str(tmp_path / "d"), "--report", str(tmp_path / "d.json"), "-q"], spark) == 0
    assert json.loads((tmp_path / "d.json").read_text())["records_seen"] == pairs.count()
    assert cli.main(["trim", src, "-o", str(tmp_path / "t"), "-q"], spark) == 2  # nothing to do
    assert cli.main(["sniff-adapters", src, "-o", str(tmp_path / "s.json"), "--sample", "300", "--require-confident"], spark) in (0, 3)
    pieces = str(tmp_path / "p")
    sinks.publish(reads(spark, "/root/testdata/sf0.001", px.CONCATEMERS), pieces)
    assert cli.main(["segment", pieces, "-o", str(tmp_path / "g"), "--delimiter", px.DELIMITER_A, "--segments", str(tmp_path / "gs"), "-q"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "g")).count() == spark.read.parquet(str(tmp_path / "gs")).filter("status = 'PASS'").count()


def test_segments_reconcile(spark):
    df = reads(spark, "/root/testdata/sf0.001", px.CONCATEMERS)
    plan = SegmentPlan((Adapter("A", px.DELIMITER_A), Adapter("B", px.DELIMITER_B)), filter=FilterParams(min_length=12))
    result = segment.run(df, plan).cache()
    s = segment.stats(result).first()
    assert s.fragments == segment.sidecar(result).count() == segment.passed(result).count() + segment.reason_rows(result).count()
    assert sum(r.hits for r in segment.delimiter_hits(result, plan).collect()) == s.delimiters == s.candidates - s.suppressed


def test_streams_give_what_batches_give(spark, pairs, tmp_path):
    from readloom.streaming import reads as streaming

    src = str(tmp_path / "src")
    pairs.withColumn("at", F.timestamp_seconds(F.col("record_index") + 10**6)).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    assert rows(drain(streaming.accepted(stream.drop("at"), PARITY), "kept")) == rows(outputs.accepted(workflow.run(pairs, PARITY)))
    assert drain(streaming.dedup(stream, "at", "1 day"), "once").count() == pairs.select("r1_seq", "r2_seq").distinct().count()
    assert drain(streaming.counts(stream, PARITY, "at", "1 day", "1 hour"), "counts", "complete").agg(F.sum("records")).first()[0] == pairs.count()


def test_a_run_is_evaluated_once(spark, pairs, tmp_path, monkeypatch):
    """Sidecars and the report read the written facts: no plan but the one that writes them holds the kernel."""
    src = str(tmp_path / "in")
    sinks.publish(pairs, src)
    plans = []
    real = sinks.publish
    monkeypatch.setattr(sinks, "publish", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().toString()), real(df, *a, **k))[1])
    seen = []
    report = reporting.run_report
    monkeypatch.setattr(reporting, "run_report", lambda result, *a: (seen.append(result._jdf.queryExecution().toString()), report(result, *a))[1])
    out = [str(tmp_path / x) for x in ("a", "f", "why", "r.json")]
    assert cli.main(["workflow", src, "-o", out[0], "--adapter-r1", px.TRUSEQ_R1, "--filter-min-length", "70", "--failed", out[1], "--failed-reasons", out[2], "--report", out[3], "-q"], spark) == 0
    assert len(plans) == 3 and len(seen) == 1 and not any("MapInArrow" in p for p in plans + seen)
    found = json.loads((tmp_path / "r.json").read_text())
    assert found["performance"]["records_per_second"] > 0 and found["counts"]["records_in"] == pairs.count()
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".crc") == ["a", "f", "in", "r.json", "why"]  # the facts are gone
    assert "Adapter" in reporting.summary(found) and "Performance" in reporting.summary(found)


def test_a_failed_rename_brings_back_what_was_there(spark, pairs, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    sinks.publish(pairs, path)
    with pytest.raises(OSError):
        sinks._replace(spark, str(tmp_path / "missing"), path)
    assert spark.read.parquet(path).count() == pairs.count()
    with pytest.raises(ValueError, match="one path"):
        sinks.reserve(spark, [], [path, path], True)


def test_spans_beyond_the_end_are_errors(spark, pairs, tmp_path):
    src = str(tmp_path / "in")
    sinks.publish(sample.with_offsets(pairs), src)
    n = pairs.count()
    assert source.read(spark, src, n - 1).count() == 1 and source.read(spark, src, n).count() == 0
    with pytest.raises(ValueError, match="outside"):
        source.read(spark, src, n + 1)
    assert cli.main(["filter", src, "-o", str(tmp_path / "o"), "--filter-min-length", "1", "--span", f"{n + 5}..", "-q"], spark) == 2


def test_strand_inputs_batches_and_decoys(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows, table = reads(spark, sf, px.TRANSCRIPT_READS), reads(spark, sf, px.TRANSCRIPTS)
    fasta = tmp_path / "t.fa"
    fasta.write_text("".join(f">{r.transcript} some words\n{r.sequence[:70].lower()}\n{r.sequence[70:]}\n" for r in table.collect()))
    from_fasta = strand.read_transcripts(spark, str(fasta))
    assert {(r.transcript, r.sequence) for r in from_fasta.collect()} == {(str(r.transcript), r.sequence) for r in table.collect()}
    p = strand.StrandParams(min_informative=100, batch=64, target_informative=200)
    found = strand.sniff(rows, from_fasta, p)
    every = {r.record_index: r.format for r in strand.formats(rows, table, p.k).collect()}
    ids = sorted(r.record_index for r in rows.collect())
    taken = next(e for e in range(64, len(ids) + 64, 64) if sum(every.get(i) not in (None, "ambiguous") for i in ids[:e]) >= 200)
    assert found.examined == min(taken, len(ids)) < len(ids) and sum(found.counts.values()) == sum(i in every for i in ids[: found.examined])
    index = str(tmp_path / "index")
    strand.build_index(from_fasta, index, p.k)
    assert strand.sniff_by(rows, strand.load_index(spark, index, p.k), p) == found
    with pytest.raises(ValueError, match="anew"):
        strand.load_index(spark, index, 15)
    names = tmp_path / "decoys.txt"
    names.write_text("\n".join(str(r.transcript) for r in table.collect()))
    decoy = strand.sniff(rows, strand.read_transcripts(spark, str(fasta), str(names)), p)
    assert decoy.informative == 0 and decoy.decoy_only > 0 and any("decoys" in w for w in decoy.warnings) and decoy.failure_reason
    src = str(tmp_path / "in")
    sinks.publish(rows, src)
    for form in ("json", "text"):
        assert cli.main(["sniff-strand", src, "--transcriptome", str(fasta), "--index", str(tmp_path / "made"), "--strand-min-informative", "100", "--format", form, "-o", str(tmp_path / form)], spark) == 0
    assert json.loads((tmp_path / "json").read_text())["index"]["transcripts"] == table.count() and "Strandedness: reverse" in (tmp_path / "text").read_text()


def test_trims_that_took_nothing_are_reported(spark, pairs):
    on = (TrimParams(quality_tail=20, poly_g=True), TrimParams(max_length=1000))
    got = {(r.mate, r.op): (r.reads, r.bases) for r in report.trims(workflow.run(pairs, Plan(trim=on)), on).collect()}
    assert set(got) == {("R1", "quality"), ("R1", "poly_g"), ("R2", "max_length")} and got["R2", "max_length"] == (0, 0)


def test_adapter_reports_for_readers(spark, pairs):
    found = reporting.adapters_report(sniff.sniff(sample.with_offsets(pairs), catalogue.load(), sniff.SniffParams(sample=1500)), "x", sniff.SniffParams())
    text = reporting.adapters_text(found)
    assert "R1 adapter result: confident" in text and "Known as: illumina-truseq" in text and "Confidence: high" in text
    table = [x.split("\t") for x in reporting.adapters_tsv(found).splitlines()]
    assert {len(x) for x in table} == {len(reporting.TSV_COLUMNS)} and "illumina-truseq" in table[1]
