"""One query an operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontam, lm, minhash, mixing, pii, quality, secrets, shared, tokens, toxicity, urls

#: Path of the byte-level BPE file; a parameter of the token operators.
TOKENIZER_FILE = os.environ.get("READLOOM_TOKENIZER")


#: Key of the registered query, whose tables are invented; real data wants a secret one.
PII_KEY = os.environ.get("READLOOM_PII_KEY", "key for invented tables")


def tokenizer_file() -> str:
    if TOKENIZER_FILE:
        return TOKENIZER_FILE
    if importlib.util.find_spec("public_tokenizers") is None:
        raise ValueError("set READLOOM_TOKENIZER to a tokenizers file")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain: the quality that `labels` gives."""
    return table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", F.col("quality").cast("string").alias("domain"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture, members = mixing.fit(table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir), mixing.TARGETS)
    return mixing.rates(members, mixture)


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stored ledger: the first scan reads every blob, the second finds none that is new."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), shared.new_folder(spark, "ledger")
    scanned = [secrets.update(docs, path) for _ in range(2)]
    found = secrets.digest(secrets.findings(docs, secrets.load(spark, path)))
    return found.withColumns({name: F.lit(n).cast("long") for name, n in zip(("blobs_scanned", "blobs_rescanned"), scanned, strict=True)})


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), labels).drop("bad_rate", "bound")


def toxicity_index(docs: DataFrame, labels: DataFrame) -> toxicity.Index:
    """Fitted on labels outside the held-out fold."""
    return toxicity.fit(docs, labels.filter(shared.crc_mod(F.col("doc_id"), 5) != 0))


#: Nearest examples that the query shows, as id:toxic:similarity.
EVIDENCE = 5


def op5_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_index(docs, table(spark, sf_dir, "labels")), own="doc_id")
    shown = F.transform(F.slice("evidence", 1, EVIDENCE), lambda e: F.concat_ws(":", e["example"], e["toxic"].cast("string"), F.format_number(e["similarity"], 4)))
    return scored.select("doc_id", (shared.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join(shown, ",").alias("evidence"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs.filter(~lm.held_out()))
    return lm.score(docs, model).select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "token-store")
    tokens.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return tokens.verify_store(spark, path)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
one AS (SELECT text, any_value(ws) AS ws FROM w WHERE len(ws) > 0 GROUP BY text),
s AS (SELECT text, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT text, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM one)),
c AS (SELECT text, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT text, sum(n) AS n FROM c GROUP BY text),
o AS (SELECT a.text AS a, b.text AS b, sum(least(a.n, b.n)) AS both_n FROM c a JOIN c b ON a.g = b.g AND a.text <> b.text GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN t x ON x.text = a JOIN t y ON y.text = b WHERE both_n >= 0.8 * (x.n + y.n - both_n)),
reach(a, b) AS (SELECT text, text FROM one UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
cls AS (SELECT a AS text, min(b) AS k FROM reach GROUP BY a),
d AS (SELECT doc_id, coalesce('t' || k, 'd' || cast(doc_id AS VARCHAR)) AS k FROM w LEFT JOIN cls USING (text))
SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS class_size FROM d
"""

OP9_SQL = r"""
WITH lowered AS (SELECT 'd' AS src, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT src, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
q AS (SELECT DISTINCT id AS item, len(ws[i:i + 12]) AS k, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM w WHERE src = 'b' AND len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM q),
g AS (SELECT id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE src = 'd' AND len(ws) >= k)),
m AS (SELECT g.id, g.i, g.k, q.item FROM g JOIN q USING (k, g)),
hits AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS p FROM m) GROUP BY id),
marked AS (SELECT id, string_agg((i - 1) || ':' || (i + k - 1), ',' ORDER BY i, k) AS spans FROM (SELECT DISTINCT id, i, k FROM m) GROUP BY id),
qw AS (SELECT DISTINCT k, g FROM q WHERE k > 11),
qt AS (SELECT k, g, o, string_split(g, ' ')[o] AS word FROM (SELECT k, g, unnest(range(1, k + 1)) AS o FROM qw)),
dw AS (SELECT id, p, ws[p] AS word, len(ws) AS n FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE src = 'd')),
close AS (SELECT id, count(*) AS n_near FROM (SELECT dw.id, qt.g, dw.p - qt.o AS s FROM dw JOIN qt USING (word) WHERE dw.p - qt.o >= 0 AND dw.p - qt.o + qt.k <= dw.n GROUP BY dw.id, qt.g, dw.p - qt.o, qt.k HAVING count(*) >= 11 AND count(*) < qt.k) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, cast(item AS VARCHAR) AS item FROM m) GROUP BY id)
SELECT d.id AS doc_id, cast(len(d.ws) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated,
  cast(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(spans, '') AS spans
FROM w d LEFT JOIN hits USING (id) LEFT JOIN items USING (id) LEFT JOIN close USING (id) LEFT JOIN marked USING (id) WHERE d.src = 'd'
"""

def _op3_sql() -> str:
    """The base and vendor rules again: pieces between matches give the places."""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        p = rule.pattern.replace("'", "''")
        least = f"length(regexp_extract(m[i], '{p}', {rule.group})) >= {rule.least}" if rule.least else "true"
        parts.append(f"""SELECT id, {k} AS o, '{rule.kind}' AS kind, pos AS s, pos + length(m[i]) AS e FROM (SELECT *, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
          FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d))) WHERE {least}""")
    each = " UNION ALL ".join(parts)
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), f AS ({each}),
      a AS (SELECT id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM f GROUP BY id)
      SELECT d.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, (SELECT count(DISTINCT t) FROM d) AS blobs_scanned, 0::BIGINT AS blobs_rescanned FROM d LEFT JOIN a USING (id)"""


OP4_SQL = r"""
WITH lab AS (SELECT doc_id AS page_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY 1),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
b0 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*\z', '') AS bare FROM p),
b1 AS (SELECT *, regexp_matches(bare, '^([0-9]{1,3}\.){3}[0-9]{1,3}\z') OR starts_with(bare, '[') AS num, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM b0),
l AS (SELECT *, CASE WHEN num THEN '' WHEN two IN (SUFFIXES) THEN two ELSE split_part(bare, '.', -1) END AS suffix,
  CASE WHEN num THEN bare WHEN two IN (SUFFIXES) THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE two END AS domain FROM b1),
h AS (SELECT bare AS host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM l JOIN lab USING (page_id) WHERE bad IS NOT NULL GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT coalesce((sum(bad) + 0.5) / (sum(n) + 1), 0)::DOUBLE AS mu FROM s),
lv AS (SELECT 's' AS lv, n, bad FROM s UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 'h', n, bad FROM h),
m AS (SELECT lv, any_value(mu) AS mu, sum(n) AS n, sum(n * n) AS n2, count(*) AS k, sum(n * (bad / n - mu) ** 2) AS q FROM lv, g GROUP BY lv),
b AS (SELECT lv, mu, k, n, CASE WHEN n - n2 / n > 0 THEN (q - (k - 1) * mu * (1 - mu)) / (n - n2 / n) ELSE 0 END AS b FROM m),
w AS (SELECT lv, CASE WHEN k < 2 OR mu <= 0 OR mu >= 1 OR b <= 0 THEN 200.0::DOUBLE ELSE least(200.0::DOUBLE, greatest(2.0::DOUBLE, mu * (1 - mu) / b - 1)) END AS w FROM b),
ww AS (SELECT coalesce(max(w) FILTER (lv = 's'), 200) AS ws, coalesce(max(w) FILTER (lv = 'd'), 200) AS wd, coalesce(max(w) FILTER (lv = 'h'), 200) AS wh FROM w),
x AS (SELECT l.page_id, l.host, l.path, wh + coalesce(h.n, 0) AS m,
  (coalesce(h.bad, 0) + wh * ((coalesce(d.bad, 0) + wd * ((coalesce(s.bad, 0) + ws * mu) / (coalesce(s.n, 0) + ws))) / (coalesce(d.n, 0) + wd))) / (coalesce(h.n, 0) + wh) AS r
  FROM l CROSS JOIN g CROSS JOIN ww LEFT JOIN h ON h.host = l.bare LEFT JOIN d ON d.domain = l.domain LEFT JOIN s ON s.suffix = l.suffix),
y AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM x)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN r - 1.64 * sqrt(r * (1 - r) / (m + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM y
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in urls.SUFFIXES))


def _op7_sql() -> str:
    phrase = "(?i)" + "|".join(quality.BOILERPLATE)
    end = quality.LINE_END.replace("'", "''")
    fails = rf"""NOT regexp_matches(x, '{end}') OR length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > 0.2::DOUBLE * length(x) OR regexp_matches(x, '{phrase}')
    OR contains(x, '|') AND len(regexp_extract_all(replace(x, '|', ''), '[^\x20\x09-\x0D]+')) <= 3 * (length(x) - length(replace(x, '|', '')) + 1)"""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
o AS (SELECT doc_id, sum(length(x)) AS kept_chars FROM (SELECT doc_id, unnest(list_distinct(ls)) AS x FROM w) WHERE NOT ({fails}) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_chars - kept_chars <= 0.5::DOUBLE * line_chars AS kept FROM m
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bag_minhash, op2_soft_mixing, op3_blob_ledger, op4_host_reputation, op5_nearest_examples, op6_suffix_tree, op7_line_rules, op8_feistel, op9_positional_index, op10_token_store)}
ORACLES: dict[str, str] = {"op1_bag_minhash": OP1_SQL, "op3_blob_ledger": _op3_sql(), "op4_host_reputation": OP4_SQL, "op7_line_rules": _op7_sql(), "op9_positional_index": OP9_SQL}
