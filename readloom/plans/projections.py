"""Reads made from the driver's tables, in SQL that both engines evaluate alike.

Each projection is a query over one base table with a unique key. Bases come from the key's
md5 digits; {orders} and {events} stand for the tables.
"""

from __future__ import annotations

#: Public vendor sequences.
TRUSEQ_R1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
TRUSEQ_R2 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
NEXTERA = "CTGTCTCTTATACACATCT"
FIVE, THREE = "AGGTCAGTCTAC", "CTTACGGATCCA"
DELIMITER_A, DELIMITER_B = "AGGTCAGTCTACAT", "CTTACGGATCCAGG"
HEADER_TAIL = "1:N:0:TATAGCCT+GGTCCCGA"


def _digits(tag: str, key: str, alphabet: str) -> str:
    return f"translate(md5(concat('{tag}|', cast({key} as string))), '0123456789abcdef', '{alphabet}')"


def bases(key: str, *tags: str) -> str:
    """32 bases for each tag."""
    return "concat(" + ", ".join([_digits(t, key, "ACGTACGTACGTACGT") for t in tags] + ["''"]) + ")"


def qualities(key: str, *tags: str) -> str:
    """32 qualities of Phred 2 to 40 for each tag."""
    return "concat(" + ", ".join([_digits(t, key, "#%+/5:?@ABCDEFGI") for t in tags] + ["''"]) + ")"


def _revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


_INSERT = f"substr({bases('o_orderkey', 'i1', 'i2', 'i3')}, 1, cast(20 + o_custkey % 70 as int))"

#: Pairs of 80 bases: an insert of 20 to 89, then an adapter and random bases; four tail qualities of 2 in every third.
PAIRS = f"""
select o_orderkey as record_index,
  substr(concat(ins, '{TRUSEQ_R1}', {bases("o_orderkey", "t1", "t2")}), 1, 80) as r1_seq,
  concat(substr({qualities("o_orderkey", "q1", "q2", "q3")}, 1, 76), case when o_orderkey % 3 = 0 then '####' else 'IIII' end) as r1_qual,
  concat('read_', cast(o_orderkey as string), ' {HEADER_TAIL}') as r1_header,
  substr(concat({_revcomp("ins")}, '{TRUSEQ_R2}', {bases("o_orderkey", "t3", "t4")}), 1, 80) as r2_seq,
  concat(substr({qualities("o_orderkey", "q4", "q5", "q6")}, 1, 76), case when o_orderkey % 5 = 0 then '####' else 'IIII' end) as r2_qual,
  concat('read_', cast(o_orderkey as string), ' {HEADER_TAIL}') as r2_header
from (select o_orderkey, o_custkey, {_INSERT} as ins from {{orders}}) x"""

#: Single-end reads: random bases, then NN, a G tail with one mismatch, or nothing; some begin with N.
READS = f"""
select event_id as record_index,
  concat(case when event_id % 7 = 0 then 'N' else '' end, substr({bases("event_id", "b")}, 1, cast(24 + user_id % 8 as int)),
    case event_id % 3 when 0 then 'NN' when 1 then 'GGGGGGGAGGGGGGGG' else '' end) as r1_seq,
  substr({qualities("event_id", "q1", "q2")}, 1, cast(24 + user_id % 8 + case when event_id % 7 = 0 then 1 else 0 end + case event_id % 3 when 0 then 2 when 1 then 16 else 0 end as int)) as r1_qual,
  concat('read_', cast(event_id as string)) as r1_header
from {{events}}"""

#: Sequences by customer, so that most have duplicates.
DUPLICATES = f"""
select o_orderkey as record_index, substr({bases("o_custkey", "d1", "d2")}, 1, 50) as r1_seq, substr({bases("(o_custkey % 97)", "d3", "d4")}, 1, 50) as r2_seq from {{orders}}"""

#: Overlapping pairs of 60 bases from inserts of 70, with a doubtful, a doubtless and an undecided miscall by turns.
MISCALLS = f"""
select o_orderkey as record_index,
  case o_orderkey % 4 when 0 then seq1 else concat(substr(seq1, 1, p - 1), translate(substr(seq1, p, 1), 'ACGT', 'CGTA'), substr(seq1, p + 1, 60)) end as r1_seq,
  concat(repeat('I', p - 1), case o_orderkey % 4 when 1 then '+' when 2 then 'I' else '5' end, repeat('I', 60 - p)) as r1_qual,
  concat('read_', cast(o_orderkey as string)) as r1_header, {_revcomp("substr(ins, 11, 60)")} as r2_seq,
  concat(repeat('I', 70 - p), case o_orderkey % 4 when 2 then '+' else 'I' end, repeat('I', p - 11)) as r2_qual,
  concat('read_', cast(o_orderkey as string)) as r2_header
from (select o_orderkey, ins, substr(ins, 1, 60) as seq1, cast(15 + o_custkey % 40 as int) as p from (select o_orderkey, o_custkey, substr({bases("o_orderkey", "m1", "m2", "m3")}, 1, 70) as ins from {{orders}}) y) x"""

#: Flanked inserts of 30: both flanks, both, no 3' flank, neither.
LINKED = f"""
select event_id as record_index, case event_id % 4 when 2 then concat('AT', '{FIVE}', {bases("event_id", "l1", "l2")})
  when 3 then {bases("event_id", "l1", "l2")} else concat('AT', '{FIVE}', substr({bases("event_id", "l1")}, 1, 30), '{THREE}', 'CCC') end as r1_seq
from {{events}}"""

#: Pieces joined by 0, 1 or 2 delimiters, or led by one.
CONCATEMERS = f"""
select event_id as record_index, concat('read_', cast(event_id as string)) as r1_header, case event_id % 4 when 0 then {bases("event_id", "c1", "c2")}
  when 1 then concat({bases("event_id", "c1")}, '{DELIMITER_A}', {bases("event_id", "c2")})
  when 2 then concat({bases("event_id", "c1")}, '{DELIMITER_A}', substr({bases("event_id", "c2")}, 1, 10), '{DELIMITER_B}', {bases("event_id", "c3")})
  else concat('{DELIMITER_B}', {bases("event_id", "c1", "c2")}) end as r1_seq
from {{events}}"""

#: Transcripts of 320 bases.
TRANSCRIPTS = f"select cast(n_nationkey as bigint) as transcript, {bases('n_nationkey', 'x0', 'x1', 'x2', 'x3', 'x4', 'x5', 'x6', 'x7', 'x8', 'x9')} as sequence from {{nation}}"

#: Pairs of 50 bases, 120 apart, of one strand in nine of ten.
TRANSCRIPT_READS = f"""
select o_orderkey as record_index, case when o_orderkey % 10 = 0 then a else b end as r1_seq, case when o_orderkey % 10 = 0 then b else a end as r2_seq
from (select o_orderkey, substr(t, cast(1 + o_custkey % 150 as int), 50) as a, {_revcomp("substr(t, cast(121 + o_custkey % 150 as int), 50)")} as b
  from (select o_orderkey, o_custkey, {bases("(o_orderkey % 25)", "x0", "x1", "x2", "x3", "x4", "x5", "x6", "x7", "x8", "x9")} as t from {{orders}}) y) x"""
