"""One query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm.decontaminate import leaks
from gistmill.llm.hnsw import nearest
from gistmill.llm.html import main_text
from gistmill.llm.jaccard import jaccard_groups
from gistmill.llm.langid import identify
from gistmill.llm.lines import dedup_lines
from gistmill.llm.mixing import mix_sources
from gistmill.llm.quality import score_quality
from gistmill.llm.ranking import ranked
from gistmill.llm.substrings import remove_repeats
from gistmill.llm.tokens import token_counts
from gistmill.llm.urlfilter import judge_urls
from gistmill.llm.vectorcodes import PARTS, ROUNDS, vector_codes


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(_table(spark, folder, "documents"))


def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"))


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mix_sources(_table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(_table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


#: Host, path and verdict of the rules for pages.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, folder, "pages"), rules)


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 50)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(_table(spark, folder, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_counts": op3_token_counts,
    "op4_html_text": op4_html_text,
    "op5_source_mixing": op5_source_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_url_filter": op11_url_filter,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_codes": op13_vector_codes,
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_RULES = ", ".join(str(rule) for rule in URL_RULES)


def _codes_sql() -> str:
    """Codebooks by one step of assigning and moving after the other."""

    def assigned(i: int) -> str:
        return f"""near{i} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM cells JOIN book{i} USING (part, pos) GROUP BY ALL) t
  GROUP BY r, part)"""

    steps = []
    for i in range(ROUNDS):
        steps.append(f"""{assigned(i)},
book{i + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, c) AS c FROM book{i} LEFT JOIN (
    SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM cells JOIN near{i} USING (r, part) GROUP BY ALL) t USING (part, entry, pos))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT r, vec_id, i // (n // {PARTS}) AS part, i % (n // {PARTS}) AS pos, x
  FROM (SELECT r, vec_id, len(e) AS n, generate_subscripts(e, 1) - 1 AS i,
    CAST(floor(4096 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept) t),
book0 AS MATERIALIZED (
  SELECT part, entry, pos, x AS c FROM cells JOIN (
    SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16) f USING (r)),
{", ".join(steps)},
{assigned(ROUNDS)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


SQL: dict[str, str] = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS d, doc_id AS c FROM documents
  UNION SELECT b, c FROM reached JOIN both_ways ON d = a)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT d AS doc_id, min(c) AS component_id FROM reached GROUP BY d) USING (doc_id)""",
    "op5_source_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len({_SPLIT.format("text")}), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7') AS place FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0 * source_size AS most, (2.0::DOUBLE * source_size) / weight AS own,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sums WINDOW before AS (ORDER BY (2.0::DOUBLE * source_size) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, own) FROM levels WHERE level * weight <= most) * weight, 2.0::DOUBLE * source_size)) AS target
  FROM levels),
placed AS (
  SELECT s.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
    sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ASC NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0
    ELSE size * (goal // source_size) + greatest(0, least(size, goal % source_size - before)) END AS BIGINT) AS taken
FROM placed""",
    "op7_substring_dedup": f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SPLIT.format("text")}, []) AS w FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
repeated AS (SELECT r, i FROM windows JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) USING (g)),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM repeated),
gone AS (SELECT r, count(*) AS n_removed FROM covered GROUP BY r),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS text
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words) ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
    "op11_url_filter": rf"""
WITH split_up AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(h, p, v) AS (VALUES {_RULES}),
judged AS (
  SELECT *, (SELECT arg_max({{'rule': h || p, 'verdict': v}}, length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS found
  FROM split_up)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, 'allow') AS verdict FROM judged""",
    "op12_ranked_search": rf"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT r, doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
sizes AS (SELECT r, count(*) AS n FROM found GROUP BY r),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
measured AS (SELECT r, 100 - 50 + ((50 * n * n_docs) // length) AS m FROM sizes, corpus),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY term, n_docs),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN measured USING (r) GROUP BY item_id, r, doc_id),
placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 50""",
    "op13_vector_codes": _codes_sql(),
}
