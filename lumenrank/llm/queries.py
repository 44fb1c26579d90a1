"""The contract queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, langid, mixing, packing, quality_rules, resampling, secret_scan, simhash, toxicity, url_filter, vector_codes
from .common import UPPER, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = simhash.decide(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return placed.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*first, F.array_join("broken_rules", ",").alias("broken_rules"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.replicate(table(spark, sf_dir, "documents"))
    out = copies.select("row.doc_id", "row.source", "copy", "copies", F.round("rate", 6).alias("rate"), "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.decide(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_langid": op9_langid,
    "op10_url_filter": op10_url_filter,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_resampling": op13_resampling,
}
SQL: dict[str, str] = {}

SQL["op3_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""

_STOPS = ", ".join(f"'{form(w)}'" for w in quality_rules.stop_word_list() for form in (str.lower, str.capitalize, str.upper))
_BROKEN = ", ".join(
    "CASE WHEN " + " OR ".join(f"{measure} {op} {bound}" for op, bound in (("<", least), (">", most)) if bound is not None) + f" THEN '{name}' END"
    for name, measure, least, most in quality_rules.THRESHOLDS
)
SQL["op6_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
gaps AS (SELECT doc_id, least(3, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -3)) AS gap FROM twice),
rep AS (SELECT doc_id, sum(gap)::BIGINT AS n FROM gaps GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(list_filter(ws, lambda w: w IN ({_STOPS})))::BIGINT AS n_stop_words,
         length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]\s')))::BIGINT AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))::BIGINT AS n_ellipsis_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
rated AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbols_per_word,
         coalesce(n_stop_words / nullif(n_words, 0)::DOUBLE, 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_ratio,
         coalesce(n_bullet_lines / nullif(n_lines, 0)::DOUBLE, 0) AS bullet_line_ratio, coalesce(n_ellipsis_lines / nullif(n_lines, 0)::DOUBLE, 0) AS ellipsis_line_ratio,
         coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeat_word_ratio
  FROM counted),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {_BROKEN}) AS broken_rules FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM ruled
"""

SQL["op8_mixing"] = f"""
WITH c AS (SELECT source, count(*) AS n, pow(count(*), {mixing.ALPHA}) AS w FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS docs, sum(w) AS ws FROM c),
r AS (SELECT source, w * docs / (ws * n) AS rate FROM c CROSS JOIN t),
p AS (SELECT source, rate, greatest(ceil(rate / {mixing.PART}), 1)::INT AS parts FROM r),
k AS (SELECT source, rate, parts, rate / parts AS m, unnest(range(0, ceil(rate / parts + 10 * sqrt(rate / parts) + 25)::INT + 1)) AS k FROM p),
cdf AS (SELECT source, rate, parts, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM k),
tab AS (SELECT source, rate, parts, list(p ORDER BY k) AS ps FROM cdf GROUP BY ALL),
u AS (SELECT doc_id, d.source, rate, ps, unnest(range(0, parts)) AS j FROM documents d JOIN tab ON d.source IS NOT DISTINCT FROM tab.source),
drawn AS (SELECT doc_id, source, rate, sum(len(list_filter(ps, lambda p: p < ('0x' || substr(md5('{mixing.SEED}|' || j || '|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0)))::BIGINT AS copies
          FROM u GROUP BY doc_id, source, rate),
each AS (SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy, copies, rate FROM drawn)
SELECT doc_id, source, copy, copies, round(rate, 6) AS rate, md5('{mixing.SEED}|at|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key FROM each
"""


def _nearest(books: str) -> str:
    """The parts with the distance to their nearest entry, times the entries, plus its index."""
    d = "list_sum(list_transform(range(1, len(parts.x) + 1), lambda i: (parts.x[i] - b.x[i]) * (parts.x[i] - b.x[i])))::BIGINT"
    return f"SELECT vec_id, label, p, any_value(parts.x) AS x, min({d} * {vector_codes.ENTRIES} + e) AS m FROM parts JOIN {books} b USING (p) GROUP BY vec_id, label, p"


_SUMS = f"SELECT p, m % {vector_codes.ENTRIES} AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM FOUND) GROUP BY ALL"
_MEANS = f"SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM ({_SUMS}) GROUP BY p, e"
_ROUNDS = "".join(
    f"a{r} AS MATERIALIZED ({_nearest(f'b{r}')}), b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b{r}.x) AS x FROM b{r} LEFT JOIN ({_MEANS.replace('FOUND', f'a{r}')}) m USING (p, e)), "
    for r in range(vector_codes.ROUNDS)
)
SQL["op11_vector_codes"] = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {vector_codes.PARTS} AS w
           FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM (SELECT *, unnest(range({vector_codes.PARTS})) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < {vector_codes.ENTRIES}),
{_ROUNDS}
last AS ({_nearest(f'b{vector_codes.ROUNDS}')}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {vector_codes.ENTRIES}), '' ORDER BY p) AS code, sum(m // {vector_codes.ENTRIES})::BIGINT AS error FROM last GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM b{vector_codes.ROUNDS})) AS codebooks_sha256
FROM coded
"""

#: CRC-32 a byte and a bit at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295::BIGINT)"
_BYTES = "list_transform(range(0, length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op13_resampling"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
sw AS (SELECT word, count(*) AS s FROM (SELECT unnest(ws) AS word FROM d) GROUP BY word),
tw AS (SELECT word, count(*) AS t FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY word),
w AS (SELECT word, coalesce(s, 0) AS s, coalesce(t, 0) AS t, {_CRC.format(bytes=_BYTES)} % {resampling.BUCKETS} AS bucket FROM sw FULL JOIN tw USING (word)),
b AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t, sum(sum(s)) OVER ()::DOUBLE AS ss, sum(sum(t)) OVER ()::DOUBLE AS ts FROM w GROUP BY bucket),
g AS (SELECT word, floor({resampling.UNIT} * ln((b.t + 1) * (ss + {resampling.BUCKETS}) / ((b.s + 1) * (ts + {resampling.BUCKETS}))))::BIGINT AS gain FROM w JOIN b USING (bucket)),
x AS (SELECT r, sum(gain)::BIGINT AS gain FROM (SELECT r, unnest(ws) AS word FROM d) JOIN g USING (word) GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) > 0 THEN (gain - ((gain % len(ws)) + len(ws)) % len(ws)) // len(ws) ELSE 0 END AS weight,
             ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (r)),
scored AS (SELECT doc_id, n_features, weight::BIGINT AS weight, (weight + floor(-{resampling.UNIT} * ln(-ln((h + 0.5) / 4294967296.0))))::BIGINT AS score FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id) AS n, count(*) OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS}) AS docs FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {resampling.LEAST_WORDS} AND n <= {resampling.PERCENT} * docs // 100 THEN n END AS rank FROM ranked
"""
