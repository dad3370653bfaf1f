"""The queries of this subpackage and their SQL, for registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.divergence import divergence
from lamella.llm.exact_dedup import exact_dedup
from lamella.llm.html_text import extracted
from lamella.llm.lz_dedup import remove_duplicates
from lamella.llm.media import stored_and_probed
from lamella.llm.mixing import mix
from lamella.llm.packing import packed
from lamella.llm.phrases import collocations
from lamella.llm.quality import classify
from lamella.llm.simhash import near_copies
from lamella.llm.suffix_dedup import remove_repeats
from lamella.llm.toxicity import score_toxicity
from lamella.llm.warc import written_and_read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    # documents that aren't taken come after the others, spread over the tasks of the range sort
    last = F.coalesce(F.col("positions")[0], 2 + F.pmod(F.xxhash64("row.doc_id"), F.lit(1 << 30)))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", F.col("positions")[0].alias("position"), F.col("positions")[1].alias("repeat_position")).orderBy(last)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = stored_and_probed(table(spark, sf_dir, "documents"))
    keys = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["size"])))
    feature = F.concat_ws(";", "codec", F.concat("duration", F.lit("/"), "timescale"), F.concat(F.size("keyframes"), F.lit("/"), "samples"), F.sha2(keys, 256))
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "perplexity", "threshold", "rejected")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_media": op2_media,
    "op3_suffix_array": op3_suffix_array,
    "op4_lempel_ziv": op4_lempel_ziv,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_divergence": op11_divergence,
    "op12_html_text": op12_html_text,
    "op13_phrases": op13_phrases,
}

ORACLES = {
    "op1_mixing": r"""
WITH sized AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS draw,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
ranked AS (
  SELECT skey, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 AS class FROM sized GROUP BY skey),
weighted AS (
  SELECT *, CASE class WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM ranked),
levels AS (
  SELECT *, ((1.5::DOUBLE * sum(source_size) OVER ())
     - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted),
targets AS (
  SELECT skey, source_size, class,
    CASE WHEN weight * level > most THEN most::DOUBLE
         ELSE weight * max(CASE WHEN weight * level > most THEN NULL ELSE level END) OVER () END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.class, t.target, floor(t.target)::BIGINT AS words,
    coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.draw, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM sized s JOIN targets t USING (skey)),
takes AS (
  SELECT *, greatest(0, least(size, words - b))::BIGINT AS t0, greatest(0, least(size, words - b - source_size))::BIGINT AS t1,
    b::DOUBLE / target AS q0, (b + source_size)::DOUBLE / target AS q1 FROM placed)
SELECT doc_id, size, source_size, target, t0 + t1 AS taken,
  CASE WHEN t0 > 0 THEN CASE class
    WHEN 0 THEN 0::DOUBLE + (sqrt(2.25::DOUBLE + (-2)::DOUBLE * (q0 * 1::DOUBLE - 0::DOUBLE)) - 1.5::DOUBLE) / (-1)::DOUBLE
    WHEN 1 THEN 0::DOUBLE + (q0 * 1::DOUBLE - 0::DOUBLE) / 1::DOUBLE
    ELSE CASE WHEN q0 * 0.9375::DOUBLE <= 0.3125::DOUBLE
      THEN 0::DOUBLE + (sqrt(0.25::DOUBLE + 1::DOUBLE * (q0 * 0.9375::DOUBLE - 0::DOUBLE)) - 0.5::DOUBLE) / 0.5::DOUBLE
      ELSE 0.5::DOUBLE + (sqrt(0.5625::DOUBLE + 4::DOUBLE * (q0 * 0.9375::DOUBLE - 0.3125::DOUBLE)) - 0.75::DOUBLE) / 2::DOUBLE END END END AS position,
  CASE WHEN t1 > 0 THEN CASE class
    WHEN 0 THEN 0::DOUBLE + (sqrt(2.25::DOUBLE + (-2)::DOUBLE * (q1 * 1::DOUBLE - 0::DOUBLE)) - 1.5::DOUBLE) / (-1)::DOUBLE
    WHEN 1 THEN 0::DOUBLE + (q1 * 1::DOUBLE - 0::DOUBLE) / 1::DOUBLE
    ELSE CASE WHEN q1 * 0.9375::DOUBLE <= 0.3125::DOUBLE
      THEN 0::DOUBLE + (sqrt(0.25::DOUBLE + 1::DOUBLE * (q1 * 0.9375::DOUBLE - 0::DOUBLE)) - 0.5::DOUBLE) / 0.5::DOUBLE
      ELSE 0.5::DOUBLE + (sqrt(0.5625::DOUBLE + 4::DOUBLE * (q1 * 0.9375::DOUBLE - 0.3125::DOUBLE)) - 0.75::DOUBLE) / 2::DOUBLE END END END AS repeat_position
FROM takes""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q""",
    "op4_lempel_ziv": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - 11, 1))) AS t(i) WHERE len(w) >= 13),
first AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN first USING (g) WHERE m < doc_id),
removed AS (SELECT doc_id, list(j) AS js FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)""",
    "op11_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
o AS (SELECT row, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) USING (lang)),
g AS (SELECT d.lang, d.source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) AS d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) AS t ON t.lang = d.lang AND t.source = d.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v))::BIGINT AS q
  FROM g JOIN l USING (lang) JOIN kept AS k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM words, unnest(range(1, 6)) AS x(m), unnest(range(1, greatest(len(w) - m + 2, 1))) AS y(i)),
counts AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND n >= 100),
longer AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(n) AS longer
  FROM cand, unnest(range(2, 5)) AS x(k), unnest(range(1, 5)) AS y(i) WHERE k < m AND i + k - 1 <= m GROUP BY ALL),
alive AS (SELECT c.* FROM cand AS c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * n),
cuts AS (SELECT lang, phrase, n AS a, k, array_to_string(w[1 : k], ' ') AS one, array_to_string(w[k + 1 : m], ' ') AS rest FROM alive, unnest(range(1, 5)) AS x(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, a, k, l.n AS l, r.n AS r, total::BIGINT AS n, (1000::HUGEINT * a * total // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts AS c JOIN counts AS l ON l.lang = c.lang AND l.phrase = one AND l.m = k JOIN counts AS r ON r.lang = c.lang AND r.phrase = rest JOIN totals AS t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= 2000""",
}
