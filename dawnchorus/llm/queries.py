"""The registered queries ``opN_*`` and their SQL.

Each query applies its operator, with production parameters, to its whole table.
A query without an entry in ORACLE_SQL cannot be said in SQL (or is far too slow
there on whole tables); ``tests/llm`` holds it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.llm.cap_filters import near_duplicates
from dawnchorus.llm.chunk_bpe import round_trip_digests as chunked_digests
from dawnchorus.llm.common import hash60_sql, read_table, uniform_sql
from dawnchorus.llm.dom_marginals import extract_main_text
from dawnchorus.llm.filter_audit import LEAST_DISTINCT_PERCENT, LEAST_WORDS, MOST_CAPITALS_PERCENT, audit_filters
from dawnchorus.llm.importance_resampling import resample
from dawnchorus.llm.license_diagonals import K, LICENSES, PHRASES, scan_licenses
from dawnchorus.llm.line_frequency import Limits, apply_quality_rules
from dawnchorus.llm.ordinal_toxicity import judge_toxicity
from dawnchorus.llm.partition_jaccard import jaccard_components
from dawnchorus.llm.poisson_mixing import mix_sources
from dawnchorus.llm.recursive_bpe import round_trip_digests
from dawnchorus.llm.url_reputation import Reputation, judge_urls, path_of
from dawnchorus.llm.word_runs import run_digests, with_planted_periods

URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled page outcomes (url, bad): a page's path carries the id of the document it shows.

    A page is bad when that document is labelled as toxic or of low quality.
    """
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    shown = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?:[./]|$)", 1)
    keyed = pages.select("url", F.when(shown != "", shown).cast("long").alias("doc_id"))
    return keyed.join(bad, "doc_id", "left").select("url", "bad")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)


def op2_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(read_table(spark, sf_dir, "documents"))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge_toxicity(docs, toxic_labels(spark, sf_dir), columns=["doc_id"]).select(
        "row.doc_id", "severity", "toxic", (~F.col("toxic")).alias("kept"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return resample(docs, good_labels(spark, sf_dir), columns=["doc_id"]).select("row.doc_id", "n_grams", "log_weight", "key", "kept")


def bpe_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read_table(spark, sf_dir, "documents"), *bpe_vocabulary())


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources alike in expectation: ``alpha = 0``; as many rows as there are documents."""
    return mix_sources(read_table(spark, sf_dir, "documents"), alpha=0.0)


def op8_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def word_vocabulary() -> str:
    """The tokenizers library's file of a BPE vocabulary with word ends."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_digests(read_table(spark, sf_dir, "documents"), word_vocabulary())


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, chosen by the checksum of their id, is made periodic first."""
    docs = read_table(spark, sf_dir, "documents")
    return run_digests(docs, with_planted_periods(F.col("text"), F.col("doc_id")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_url_reputation, op2_license_diagonals, op3_line_frequency, op4_ordinal_toxicity, op5_importance_resampling,
    op6_recursive_bpe, op7_poisson_mixing, op8_partition_jaccard, op9_cap_filters, op10_dom_marginals,
    op11_chunk_bpe, op12_word_runs, op13_filter_audit)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1_sql() -> str:
    p = Reputation()
    url = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    host = _LOWER.format(f"coalesce(regexp_extract(url, {url}, 1), '')")
    rules = ", ".join(f"({i}, '{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')"
                      for i, (r, v) in enumerate(URL_RULES))
    long_suffixes = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in')"

    def weight(source: str, n: str, k: str, parent: str, pn: str, pk: str) -> str:
        return f"""(SELECT CASE WHEN c <= g OR n <= c THEN {p.most_weight} ELSE
          (SELECT CASE WHEN share <= 0 OR b <= w THEN {p.most_weight} ELSE least({p.most_weight},
              greatest({p.least_weight}, (1 - (b - w) / share) / ((b - w) / share))) END
           FROM (SELECT be / (c - g) AS b, wi / (n - c) AS w,
                        be / (c - g) + ((n - ev) / (c - g) - 1) * (wi / (n - c)) AS share)) END
        FROM (SELECT count(*) AS c, sum({n}) AS n, count(DISTINCT {parent}) AS g,
                sum({n} * ({k} / {n} - {pk} / {pn}) * ({k} / {n} - {pk} / {pn})) AS be,
                sum({n} * ({k} / {n}) * (1 - {k} / {n})) AS wi, sum({n} * {n} / {pn}) AS ev
              FROM {source} WHERE {n} > 0))"""

    return f"""
WITH p AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, {url}, 2), '') AS path FROM pages),
lab AS (SELECT doc_id, max(CAST(toxic = 1 OR quality = 0 AS INT)) AS bad FROM labels GROUP BY 1),
o AS (SELECT p.host, bad FROM p LEFT JOIN lab
      ON lab.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1) AS BIGINT)),
h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k,
       string_split(host, '.') AS parts FROM o GROUP BY host),
h1 AS (SELECT *, array_to_string(parts[-2:], '.') AS two FROM h0),
h AS (SELECT host, n, k, CASE WHEN two IN {long_suffixes} THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
      CASE WHEN two IN {long_suffixes} THEN two ELSE parts[-1] END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d GROUP BY 1),
a AS (SELECT sum(sn) AS an, sum(sk) AS ak FROM s),
sa AS (SELECT s.*, greatest(an, 1) AS an, ak, 0 AS root FROM s, a),
ds AS (SELECT * FROM d JOIN s USING (suffix)),
hd AS (SELECT * FROM h JOIN (SELECT domain, dn, dk FROM d) USING (domain)),
w AS (SELECT {weight('sa', 'sn', 'sk', 'root', 'an', 'ak')} AS ws, {weight('ds', 'dn', 'dk', 'suffix', 'sn', 'sk')} AS wd,
      {weight('hd', 'n', 'k', 'domain', 'dn', 'dk')} AS wh, (SELECT (ak + 0.1) / (an + 1.0) FROM a) AS rate),
u AS (SELECT domain, (dk + wd * (sk + ws * rate) / (sn + ws)) / (dn + wd) AS drate FROM ds, w),
r AS (SELECT host, (k + wh * drate) / (n + wh) AS m, n + wh AS size FROM h JOIN u USING (domain), w),
v AS (SELECT host, CASE WHEN m - {p.z} * sqrt(m * (1 - m) / (size + 1)) > {p.max_bad_rate} THEN 'block' ELSE 'allow'
      END AS verdict FROM r),
rules(i, rule, verdict, rh, rp) AS (VALUES {rules}),
fit AS (SELECT host, path, arg_min(rule, i - 1000 * length(rule)) AS rule, arg_min(rules.verdict, i - 1000 * length(rule))
        AS verdict FROM (SELECT DISTINCT host, path FROM p), rules
        WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, v.verdict) AS verdict
FROM p JOIN v USING (host) LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path"""


def _op2_sql() -> str:
    templates = [*PHRASES, *LICENSES]
    rows = ", ".join(f"({i}, {max(len(t.text.split()) - K + 1, 1)}, {str(t.exact).lower()}, '{t.label}', '{t.text}', "
                     f"CAST({t.telling_positions(K)} AS BIGINT[]))" for i, t in enumerate(templates))
    text = _LOWER.format("coalesce(text, '')")
    return rf"""
WITH t0(tpl, size, exact, label, body, telling) AS (VALUES {rows}),
t AS (SELECT tpl, size, exact, label, telling, g.i AS tpos, array_to_string(string_split(body, ' ')[g.i + 1:g.i + {K}], ' ') AS gram
      FROM t0, LATERAL (SELECT unnest(range(0, size)) AS i) g),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({text},
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT rid, i - 1 AS pos, array_to_string(words[i:i + {K - 1}], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - {K - 2})) AS i FROM d)),
votes AS (SELECT DISTINCT rid, tpl, size, exact, label, telling, pos - tpos AS diagonal, tpos FROM g JOIN t USING (gram)),
diagonals AS (SELECT DISTINCT rid, tpl, exact, diagonal FROM votes),
islands AS (SELECT *, sum(CASE WHEN exact OR before IS NULL OR diagonal - before > 3 THEN 1 ELSE 0 END)
      OVER (PARTITION BY rid, tpl ORDER BY diagonal) AS island
      FROM (SELECT *, lag(diagonal) OVER (PARTITION BY rid, tpl ORDER BY diagonal) AS before FROM diagonals)),
member AS (SELECT * FROM votes JOIN (SELECT rid, tpl, diagonal, island FROM islands) USING (rid, tpl, diagonal)),
spans AS (SELECT rid, tpl, island, any_value(label) AS label, any_value(size) AS size, bool_or(exact) AS exact,
      count(DISTINCT tpos) AS covered, count(DISTINCT tpos) / any_value(size) AS coverage, min(diagonal + tpos) AS start,
      count(DISTINCT tpos) FILTER (list_contains(telling, tpos)) = any_value(len(telling)) AS told FROM member GROUP BY 1, 2, 3),
place AS (SELECT rid, tpl, island, tpos, row_number() OVER (PARTITION BY rid, diagonal + tpos
      ORDER BY coverage DESC, covered DESC, tpl, island, tpos DESC) AS rank
      FROM member JOIN (SELECT rid, tpl, island, coverage, covered FROM spans WHERE NOT exact AND told AND coverage >= 0.7)
      USING (rid, tpl, island)),
won AS (SELECT rid, tpl, island, count(DISTINCT tpos) AS won FROM place WHERE rank = 1 GROUP BY 1, 2, 3),
ok AS (SELECT *, CASE WHEN exact THEN coverage = 1 ELSE coalesce(won / size >= 0.7, false) END AS accepted
      FROM spans LEFT JOIN won USING (rid, tpl, island)),
r AS (SELECT rid, count(*) FILTER (exact AND accepted) AS n_base, min(start) FILTER (exact AND accepted) AS first_word,
      max(start) FILTER (exact AND accepted) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND accepted) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (accepted) AS labels,
      max(coverage) FILTER (accepted OR NOT exact) AS score FROM ok GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score FROM d LEFT JOIN r USING (rid)"""


def _op3_sql() -> str:
    p = Limits()
    space = r"[\x20\x09-\x0D]+"
    norm = f"regexp_replace(lower(regexp_replace(line, '{space}', '', 'g')), '[0-9]+', '0', 'g')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(body, '{space}'), lambda x: x <> '') AS words FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS v
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS c FROM win) WHERE c > 1),
covered AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
l0 AS (SELECT rid, host, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM d),
l AS (SELECT rid, host, line, pos, {hash60_sql(f"host || chr(10) || {norm}")} AS key,
      length(regexp_replace(line, '{space}', '', 'g')) AS n
      FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ld AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, md5(string_agg(CAST(key AS VARCHAR), ',' ORDER BY pos)) AS document
       FROM l GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT document) AS hn FROM d LEFT JOIN ld USING (rid) GROUP BY host),
freq AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT document) AS c FROM l JOIN ld USING (rid) GROUP BY 1, 2)
         JOIN hosts USING (host) WHERE c > {p.max_documents} AND c > {p.max_share} * hn),
gone AS (SELECT rid, sum(n) AS g FROM l JOIN freq USING (host, key) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '{space}', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
      CAST(coalesce(g, 0) AS BIGINT) AS removed_chars
      FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN ld USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < {p.least_words} OR 100 * n_repeat_words > {p.most_repeated_percent} * n_words AS base_failed,
       NOT (n_words < {p.least_words} OR 100 * n_repeat_words > {p.most_repeated_percent} * n_words
            OR (removed_chars > 0 AND word_chars - removed_chars < {p.least_left} * word_chars)) AS kept FROM f"""


def mixing_sql(documents: str, columns: str, alpha: float, total: str, seed: str = "mix") -> str:
    """SQL of ``mix_sources`` over a relation that has doc_id and source."""
    return f"""
WITH d AS (SELECT *, coalesce(source, '') AS mix_source FROM {documents}),
n AS (SELECT mix_source, count(*) AS n, power(CAST(count(*) AS DOUBLE), {float(alpha)}) AS weight FROM d GROUP BY 1),
rates AS (SELECT mix_source, weight / (SELECT sum(weight) FROM n) * {total} / n AS rate FROM n),
grid AS (SELECT mix_source, rate, unnest(range(CAST(greatest(0, floor(rate - 12 * sqrt(rate) - 12)) AS BIGINT),
         CAST(ceil(rate + 12 * sqrt(rate) + 12) AS BIGINT) + 1)) AS k FROM rates),
cdf AS (SELECT mix_source, k, sum(exp(k * ln(rate) - rate - lgamma(CAST(k + 1 AS DOUBLE))))
        OVER (PARTITION BY mix_source ORDER BY k) AS c FROM grid),
tables AS (SELECT mix_source, min(k) AS first_k, list(c ORDER BY k) AS cs FROM cdf GROUP BY 1),
counted AS (SELECT d.*, first_k + len(list_filter(cs, lambda c: c <= {uniform_sql(seed, 'doc_id')})) AS copies
        FROM d JOIN tables USING (mix_source))
SELECT {columns}, CAST(mix_copy AS INT) AS mix_copy FROM (SELECT *, unnest(range(0, CAST(copies AS BIGINT))) AS mix_copy FROM counted)"""


def _op13_sql() -> str:
    space = r"[\x20\x09-\x0D]+"
    letters = "ABCDE"
    order = " || ".join(f"p{i}.l" for i in range(1, 6))
    tables = ", ".join(f"l p{i}" for i in range(1, 6))
    differ = " AND ".join(f"p{i}.l <> p{j}.l" for i in range(1, 6) for j in range(i + 1, 6))
    return rf"""
WITH l AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS l),
o AS (SELECT {order} AS filter_order FROM {tables} WHERE {differ}),
d0 AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
d1 AS (SELECT *, list_filter(string_split_regex(body, '{space}'), lambda x: x <> '') AS words,
       min(doc_id) OVER (PARTITION BY body) AS first_id FROM d0),
d2 AS (SELECT doc_id, part, [len(words) < {LEAST_WORDS},
       {LEAST_DISTINCT_PERCENT} * len(words) > 100 * len(list_distinct(words)),
       100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {MOST_CAPITALS_PERCENT} * length(body),
       regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM d1),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS good,
      count(*) FILTER (coalesce(toxic, false)) AS toxic FROM d2 LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
s AS (SELECT part, filter_order, g.step, substr(filter_order, g.step, 1) AS filter, n, good, toxic,
      len(list_filter(fails, lambda f: f)) AS n_fails,
      fails[strpos('{letters}', substr(filter_order, g.step, 1))] AS failed,
      list_bool_or([false] || list_transform(range(1, g.step), lambda i: fails[strpos('{letters}', substr(filter_order, i, 1))])) AS gone
      FROM m, o, LATERAL (SELECT unnest(range(1, 6)) AS step) g),
r AS (SELECT part, filter_order, step, filter,
      CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0) AS BIGINT) AS kept,
      CAST(coalesce(sum(n) FILTER (NOT gone AND failed), 0) AS BIGINT) AS removed,
      CAST(coalesce(sum(n) FILTER (gone AND failed), 0) AS BIGINT) AS redundant,
      CAST(coalesce(sum(n) FILTER (failed AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(sum(good) FILTER (NOT gone AND failed), 0) AS BIGINT) AS good_lost,
      CAST(coalesce(sum(toxic) FILTER (NOT gone AND failed), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""


ORACLE_SQL = {
    "op1_url_reputation": _op1_sql(),
    "op2_license_diagonals": _op2_sql(),
    "op3_line_frequency": _op3_sql(),
    "op7_poisson_mixing": mixing_sql("documents", "doc_id, text, lang, source, n_chars", 0.0,
                                     "(SELECT count(*) FROM documents)"),
    "op13_filter_audit": _op13_sql(),
}
