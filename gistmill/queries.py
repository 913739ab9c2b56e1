"""Every operator as a query over the test tables, with the SQL that checks it.

``QUERIES`` maps a name to ``run(spark, folder)``; ``SQL`` to the same result in
plain SQL where there is one. Whole numbers are 64-bit and decimals rounded to
six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions import text as tx
from gistmill.functions.wordlists import ABBREVIATIONS, PUNCTUATION, STOP_WORDS
from gistmill.operators import clean, crawl, evaluate, greedy, scoring, selection, splitting, terms, topics, transcripts, vectors
from gistmill.plans import corpus
from gistmill.plans import summarize as plans
from gistmill.session import ship, spread, stage, staging_dir
from gistmill.sources import readers, sinks
from gistmill.sources.schemas import UTTERANCES
from gistmill.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        name = run.__name__
        QUERIES[name] = lambda spark, folder: tidy(run(_Tables(ship(spark), folder)))
        if sql is not None:
            SQL[name] = sql
        return run

    return add


class _Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    def plain(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        return c.alias(field.name)

    return df.select(*(plain(f) for f in df.schema.fields))


def final(source: str, texts: str = "", ints: str = "", floats: str = "", where: str = "") -> str:
    """Last SELECT of a check: columns by kind, typed as ``tidy`` types them."""
    columns = [
        *texts.split(),
        *(f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()),
        *(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in floats.split()),
    ]
    return f"SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {where}" if where else "")


# --- SQL pieces ------------------------------------------------------------

WS = tx.SPACE


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP_LIST = "[" + ", ".join(lit(w) for w in STOP_WORDS) + "]"
PLAIN_BREAK = lit(rf"""([.!?]+["')\]]*){WS}+""")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {lit(WS + '+')}), lambda w: w <> '')"


def split_sql(c: str) -> str:
    parts = f"string_split(regexp_replace({c}, {PLAIN_BREAK}, '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip_sql('s')}), lambda s: s <> '')"


def sentences_sql(table: str, keys: str, order: str, text: str) -> str:
    """CTEs ``parts`` and ``sen``: the sentence table, terms lower-cased."""
    place = ", ".join(c for c in (keys, order) if c)
    return f"""
parts AS (
  SELECT {place}, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sen_pos
  FROM (SELECT {place}, {split_sql(text)} AS parts FROM {table}) split_up
),
closed AS (
  SELECT *, len({words_sql('part')}) AS raw_words,
    CASE WHEN regexp_matches(right(part, 1), '[[:punct:]]') THEN part ELSE part || '.' END AS sentence
  FROM parts
),
worded AS (
  SELECT *, {words_sql(f"translate(sentence, {lit(PUNCTUATION)}, '')")} AS words FROM closed
),
sen AS (
  SELECT {place}, sen_pos, sentence, raw_words, len(words) AS og_words,
    len(list_filter(words, lambda w: NOT list_contains({STOP_LIST}, w))) AS filt_words,
    list_transform(list_filter(words, lambda w: NOT list_contains({STOP_LIST}, w)), lambda w: lower(w)) AS terms
  FROM worded
)"""


def counts_sql(keys: str, order: str) -> str:
    """CTEs ``st`` (sentence terms), ``gt`` (group terms), ``tot`` (group totals)."""
    place = ", ".join(c for c in (keys, order, "sen_pos") if c)
    return f""",
st AS (
  SELECT {place}, term, count(*) AS tf FROM (SELECT {place}, unnest(terms) AS term FROM sen) t GROUP BY ALL
),
gt AS (SELECT {keys}, term, sum(tf) AS "count", count(*) AS df FROM st GROUP BY {keys}, term),
tot AS (
  SELECT {keys}, count(*) AS n_sentences, sum(CAST(sen_pos = 0 AS INT)) AS n_responses,
    sum(raw_words) AS total_words, sum(filt_words) AS filt_total
  FROM sen GROUP BY {keys}
)"""


PARTS = {
    "kl": "(\"count\" / filt_total) * ln((\"count\" / filt_total) / (tf / filt_words))",
    "tfidf": "CASE WHEN n_sentences > df THEN log2(n_sentences / df)"
             " * ln(log2(n_sentences / df) / (tf / max_tf)) ELSE 'nan'::DOUBLE END",
    "topics": "(\"count\" / filt_total) * ln((\"count\" / filt_total)"
              " / ((tf / filt_words) * (n_term_topics / {n_topics})))",
}


def scores_sql(keys: str, order: str, method: str = "kl", n_topics: int = 0) -> str:
    """CTE ``sc``: sentences with a score (null where it has no value)."""
    place = ", ".join(c for c in (keys, order, "sen_pos") if c)
    topical = "JOIN km USING (term)" if method == "topics" else ""
    return f""",
mx AS (SELECT {place}, max(tf) AS max_tf FROM st GROUP BY ALL),
ss AS MATERIALIZED (
  SELECT {place}, term, tf, max_tf, sentence, og_words, filt_words FROM st JOIN mx USING ({place}) JOIN sen USING ({place})
),
gd AS MATERIALIZED (SELECT * FROM gt JOIN tot USING ({keys})),
sc AS (
  SELECT {place}, any_value(sentence) AS sentence, any_value(og_words) AS og_words, any_value(filt_words) AS filt_words,
    CASE WHEN isnan(sum(part)) THEN NULL ELSE sum(part) / any_value(filt_words) END AS score
  FROM (
    SELECT {place}, sentence, og_words, filt_words,
      {PARTS[method].format(n_topics=float(n_topics))} AS part
    FROM ss JOIN gd USING ({keys}, term) {topical}
  ) p GROUP BY {place}
)"""


LIMITS = {
    "percent": "floor(n_sentences * CAST({share} AS DOUBLE))",
    "rev_count": "floor(n_responses / 5) * 25",
    "doc": "floor(total_words * CAST(0.8 AS DOUBLE))",
    "250": "250",
}


def picks_sql(keys: str, order: str, limit: str, share: float = 0.15, gate: str = "TRUE", first_only: bool = True) -> str:
    """CTE ``picks``: the summary, ranked. ``first_only`` adds the first
    sentence of groups that have no term at all."""
    ahead = ", ".join(c for c in ("score", order, "sen_pos") if c)
    first = ", ".join(c for c in (order, "sen_pos") if c)
    within = "rank <= lim" if limit == "percent" else "run_words - og_words < lim"
    no_terms = f"""
  UNION ALL
  SELECT 1 AS rank, f.* FROM (
    SELECT {keys}, {first}, sentence, og_words, 1000.0 AS score
    FROM sen JOIN tot USING ({keys})
    WHERE filt_total = 0 AND {gate} AND {LIMITS[limit].format(share=share)} > 0
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {first}) = 1
  ) f WHERE og_words BETWEEN 5 AND 29""" if first_only else ""
    return f""",
pool AS (
  SELECT {keys}, {first}, sentence, og_words, round(score, 9) AS score, {LIMITS[limit].format(share=share)} AS lim
  FROM sc JOIN tot USING ({keys})
  WHERE score IS NOT NULL AND og_words BETWEEN 5 AND 29 AND {gate}
),
fresh AS (
  SELECT *, coalesce(sentence = lag(sentence) OVER (PARTITION BY {keys} ORDER BY {ahead}), FALSE) AS repeated FROM pool
),
taken AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ahead}) AS rank,
    sum(og_words) OVER (PARTITION BY {keys} ORDER BY {ahead} ROWS UNBOUNDED PRECEDING) AS run_words
  FROM fresh WHERE NOT repeated
),
picks AS (
  SELECT rank, {keys}, {first}, sentence, og_words, score FROM taken WHERE {within}{no_terms}
)"""


CONV = ("conv_id", "turn")
DIGITS = 9  # scores are ranked as rounded here, so that both engines agree on ties


def conversation_sentences(t: _Tables) -> DataFrame:
    return terms.sentence_table(t.conversations, ["conv_id"], ["turn"], "text", rule="plain", normalize="lower")


def document_sentences(t: _Tables, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ()) -> DataFrame:
    return terms.sentence_table(t.documents, keys, order, "text", rule="plain", normalize="lower")


CONV_SEN = "WITH" + sentences_sql("conversations", *CONV, "text")
DOC_SEN = "WITH" + sentences_sql("documents", "doc_id", "", "text")
SRC_SEN = "WITH" + sentences_sql("documents", "source", "doc_id", "text")


# --- cleaning --------------------------------------------------------------

_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


@query(f"SELECT doc_id, regexp_replace(chr(9) || text || chr(160) || chr(127) || ' end', {lit(_PRINTABLE)}, '', 'g') AS text"
       " FROM documents")
def sanitize_text(t):
    dirty = F.concat(F.lit("\t"), "text", F.lit(" \u007f end"))
    return t.documents.select("doc_id", tx.sanitize(dirty).alias("text"))


@query(f"SELECT page_id, regexp_replace(coalesce(html, ''), {lit(_PRINTABLE)}, '', 'g') AS html FROM pages")
def sanitize_pages(t):
    return t.pages.select("page_id", tx.sanitize("html").alias("html"))


# All turns, and for each one more that is null, blank or a missing mark.
_BLANKED = """(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 100000,
  CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(10) || chr(9) ELSE 'NA' END FROM conversations)"""


def _with_blanks(t) -> DataFrame:
    blank = F.when(F.col("turn") % 3 == 0, F.lit(None)).when(F.col("turn") % 3 == 1, F.lit("  \n\t")).otherwise(F.lit("NA"))
    more = t.conversations.select("conv_id", (F.col("turn") + 100_000).alias("turn"), blank.alias("text"))
    return t.conversations.select("conv_id", "turn", "text").union(more)


@query(f"SELECT * FROM {_BLANKED} b WHERE text IS NOT NULL AND {strip_sql('text')} <> '' AND text <> 'NA'")
def drop_blank(t):
    return clean.drop_blank(_with_blanks(t), "text", na_tokens=["NA"])


_LISTED = ["eauxpal", "ingthesh", "ungver", "handndre", "ciónadlos", "leauouai"]
_HOLDS = "(" + " OR ".join(f"contains(lower(text), {lit(w)})" for w in _LISTED) + ")"


@query(f"SELECT conv_id, turn, {_HOLDS} AS has_profanity FROM conversations")
def flag_profanity(t):
    return clean.flag_profanity(t.conversations, "text", _LISTED).select("conv_id", "turn", "has_profanity")


@query(f"SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE {_HOLDS})")
def drop_profane_conversations(t):
    return clean.drop_profane_conversations(t.conversations, "text", _LISTED).select("conv_id", "turn", "text")


# A list of thousands: names, and the long words of benchmark items.
_LONG_LIST = """(SELECT lower(p_name) AS word FROM part UNION SELECT lower(c_name) FROM customer UNION
  SELECT lower(x) FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS x FROM benchmark) b WHERE length(x) >= 10)"""


def _long_list(t) -> DataFrame:
    found = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("x")).filter(F.length("x") >= 10)
    return t.part.select(F.lower("p_name").alias("word")).union(t.customer.select(F.lower("c_name"))).union(found.select(F.lower("x")))


@query(f"SELECT doc_id, EXISTS (SELECT 1 FROM {_LONG_LIST} w WHERE contains(lower(text), word)) AS has_profanity FROM documents")
def flag_long_list(t):
    return clean.flag_profanity(t.documents, "text", _long_list(t)).select("doc_id", "has_profanity")


@query(f"""SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (
  SELECT conv_id FROM conversations WHERE EXISTS (SELECT 1 FROM {_LONG_LIST} w WHERE contains(lower(text), word)))""")
def drop_conversations_long_list(t):
    return clean.drop_profane_conversations(t.conversations, "text", _long_list(t)).select("conv_id", "turn", "text")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'blue b'))")
def profane_names(t):
    return clean.drop_profane_names(t.part, "p_name", ["ring", "blue b"]).select("p_partkey", "p_name")


_CORPORA = """SELECT source FROM (
  SELECT source, count(DISTINCT doc_id) AS n_conversations, sum(length(coalesce(text, ''))) AS n_chars
  FROM documents GROUP BY source) c WHERE n_conversations >= 10 AND n_chars >= 120000"""


@query(final("(SELECT source, count(DISTINCT doc_id) AS n_conversations, sum(length(coalesce(text, ''))) AS n_chars"
             " FROM documents GROUP BY source) c", "source", "n_conversations n_chars",
             where="n_conversations >= 10 AND n_chars >= 120000"))
def valid_corpora(t):
    return clean.valid_corpora(t.documents, "source", "doc_id", "text", min_text_length=120_000)


@query(f"SELECT doc_id, source FROM documents WHERE source IN ({_CORPORA})")
def keep_valid_corpora(t):
    return clean.keep_valid_corpora(t.documents, "source", "doc_id", "text", min_text_length=120_000).select("doc_id", "source")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS res_id FROM conversations")
def number_utterances(t):
    return corpus.number_utterances(t.conversations, ["conv_id"], ["turn"]).select("conv_id", "turn", "res_id")


@query(f"""SELECT source AS corpus_name, CAST(doc_id AS VARCHAR) AS conv_id, CAST(1 AS BIGINT) AS res_id,
  'DUMMY DATA' AS question_text, regexp_replace(coalesce(text, ''), {lit(_PRINTABLE)}, '', 'g') AS answer_text
  FROM documents WHERE source IN ({_CORPORA})""")
def build_corpus(t):
    return corpus.build_corpus(t.documents.withColumn("turn", F.lit(0)), "source", "doc_id", "turn", "text", min_text_length=120_000)


@query(f"""WITH u AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, text FROM {_BLANKED} b
), present AS (SELECT * FROM u WHERE text IS NOT NULL AND {strip_sql('text')} <> '')
SELECT conv_id, turn, text AS answer_text FROM present
WHERE conv_id NOT IN (SELECT conv_id FROM present WHERE {_HOLDS})""")
def clean_corpus(t):
    rows = _with_blanks(t).select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.col("text").alias("answer_text"))
    return corpus.clean_corpus(rows, _LISTED).select("conv_id", "turn", "answer_text")


@query("SELECT c_custkey, c_name, CAST(floor((row_number() OVER (ORDER BY c_name, c_custkey) - 1) / 100) AS BIGINT) AS batch FROM customer")
def batches(t):
    return clean.batches(t.customer.select("c_custkey", "c_name"), ["c_name", "c_custkey"], 100)


_LINE = "event_type || '$#$' || user_id || CASE WHEN event_id % 7 = 0 THEN '' ELSE '$#$' || props END || CASE WHEN event_id % 11 = 0 THEN '$#$' ELSE '' END"


def _index_lines(t):
    mark = F.lit("$#$")
    line = F.concat(
        "event_type", mark, "user_id",
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(mark, "props")),
        F.when(F.col("event_id") % 11 == 0, mark).otherwise(F.lit("")),
    )
    return t.events.select("event_id", line.alias("line"))


@query(f"SELECT event_id, line, len(string_split(line, '$#$')) AS n_parts, line_number"
       f" FROM (SELECT event_id, {_LINE} AS line, row_number() OVER (ORDER BY event_id, {_LINE}) AS line_number FROM events) l"
       " WHERE len(string_split(line, '$#$')) <> 3")
def malformed_lines(t):
    return clean.malformed_lines(_index_lines(t), "line", ["event_id", "line"])


@query(f"SELECT event_id, line FROM (SELECT event_id, {_LINE} AS line FROM events) l"
       " WHERE string_split(line, '$#$')[1] NOT IN (SELECT event_type FROM events GROUP BY event_type HAVING min(event_type) < 'e')")
def remove_entries(t):
    names = t.events.filter(F.col("event_type") < "e").select("event_type").distinct()
    return clean.remove_entries(_index_lines(t), "line", names, "event_type")


@query(f"""SELECT {strip_sql('v')} AS value FROM (SELECT ' ' || p_name || CASE WHEN p_size % 4 = 0 THEN ':' ELSE '' END || chr(9) AS v FROM part) p WHERE {strip_sql('v')} <> '' AND NOT regexp_matches(v, '[<>:"/\\\\|?*]')""")
def clean_list(t):
    raw = F.concat(F.lit(" "), "p_name", F.when(F.col("p_size") % 4 == 0, F.lit(":")).otherwise(F.lit("")), F.lit("\t"))
    return readers.clean_list(t.part.select(raw.alias("value")))


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS res_id,
  regexp_replace(coalesce(text, ''), {lit(_PRINTABLE)}, '', 'g') AS answer_text FROM conversations""")
def ingested_batches(t):
    """Three landings with repeats, each followed by a run that starts anew."""
    folder = f"{staging_dir(t.spark)}/gistmill/ingest-{uuid.uuid4().hex}"
    rows = t.conversations.select(F.lit("c").alias("corpus"), "conv_id", "turn", "text")
    part = F.col("conv_id") % 3
    for number, landed in enumerate((rows.filter(part < 1), rows.filter(part < 2).union(rows.filter(part == 1)), rows)):
        landed.write.parquet(f"{folder}/landing/{number}")
        ingest.ingest_keyed(
            t.spark, f"{folder}/landing/*", rows.schema, ["conv_id", "turn"],
            lambda batch: corpus.flatten(batch, "corpus", "conv_id", "turn", "text"), f"{folder}/table", f"{folder}/checkpoint",
        ).awaitTermination()
    return ingest.read_ingested(t.spark, f"{folder}/table", UTTERANCES).select("conv_id", "res_id", "answer_text")


# Turns as CSV where some numbers are missing or no numbers, some rows have a cell
# too few or too many, and some texts hold line feeds.
_CSV_KIND = "(conv_id * 31 + turn) % 7"


def _csv_text(kind, text, other):
    return F.when(kind == 4, F.concat(F.lit('"so"\nand, '), text)).otherwise(other)


def _csv_lines(t) -> DataFrame:
    kind = (F.col("conv_id") * 31 + F.col("turn")) % 7
    said = _csv_text(kind, F.col("text"), F.col("text"))
    quoted = F.concat(F.lit('"'), F.replace(said, F.lit('"'), F.lit('""')), F.lit('"'))
    first = F.when(kind == 1, F.concat(F.lit("x"), "conv_id")).otherwise(F.col("conv_id").cast("string"))
    second = F.when(kind == 0, F.lit("NA")).otherwise(F.col("turn").cast("string"))
    rest = F.when(kind == 2, F.lit("")).when(kind == 3, F.concat(F.lit(","), quoted, F.lit(",more"))).otherwise(F.concat(F.lit(","), quoted))
    return t.conversations.select(F.concat(first, F.lit(","), second, F.lit(","), "role", rest).alias("value"))


@query(f"""WITH k AS (SELECT *, {_CSV_KIND} AS kind, '"' || replace(text, '"', '""') || '"' AS quoted FROM conversations)
SELECT CASE WHEN kind NOT IN (1, 2, 3) THEN conv_id END AS conv_id, CASE WHEN kind NOT IN (0, 2, 3) THEN CAST(turn AS BIGINT) END AS turn,
  CASE WHEN kind NOT IN (2, 3) THEN role END AS role,
  CASE WHEN kind IN (2, 3) THEN NULL WHEN kind = 4 THEN '"so"' || chr(10) || 'and, ' || text ELSE text END AS text,
  CASE WHEN kind IN (2, 3) THEN 'columns' WHEN kind = 1 THEN 'conv_id' END AS damage,
  CASE WHEN kind = 1 THEN 'x' || conv_id WHEN kind = 2 THEN conv_id || ',' || turn || ',' || role
    WHEN kind = 3 THEN conv_id || ',' || turn || ',' || role || ',' || quoted || ',more' END AS record
FROM k""")
def checked_csv(t):
    path = f"{staging_dir(t.spark)}/gistmill/csv-{uuid.uuid4().hex}"
    _csv_lines(t).write.text(path)
    schema = T.StructType.fromDDL("conv_id long, turn int, role string, text string")
    return readers.read_checked(t.spark, path, schema, ["NA"], header=False)


# --- transcripts and markup ------------------------------------------------

def _transcript_sql(c="text"):
    return (f"'intro' || chr(10) || '>> USER: ' || {c} || chr(10) || CASE WHEN turn % 3 = 0 THEN '>> USER: again' || chr(10) ELSE '' END"
            f" || '>> ASSISTANT:' || role || chr(10) || chr(10) || {c} || CASE WHEN turn % 2 = 0 THEN chr(10) || '>> ASSISTANT: more' ELSE '' END")


def _transcripts(t):
    value = F.concat(
        F.lit("intro\n>> USER: "), "text", F.lit("\n"),
        F.when(F.col("turn") % 3 == 0, F.lit(">> USER: again\n")).otherwise(F.lit("")),
        F.lit(">> ASSISTANT:"), "role", F.lit("\n\n"), "text",
        F.when(F.col("turn") % 2 == 0, F.lit("\n>> ASSISTANT: more")).otherwise(F.lit("")),
    )
    return t.conversations.select("conv_id", "turn", value.alias("value"))


_BLOCKS_SQL = f"""WITH cut AS (
  SELECT conv_id, turn, string_split(regexp_replace({_transcript_sql()}, '(?m)^>> (USER|ASSISTANT):', chr(2) || '\\1:', 'g'), chr(2))[2:] AS b
  FROM conversations
), numbered AS (
  SELECT conv_id, turn, generate_subscripts(b, 1) - 1 AS block, unnest(b) AS raw FROM cut
), roles AS (SELECT *, lower(string_split(raw, ':')[1]) AS role FROM numbered),
blocks AS (
  SELECT conv_id, turn, block, role, {strip_sql('substr(raw, length(role) + 2)')} AS text FROM (
    SELECT *, lead(role) OVER (PARTITION BY conv_id, turn ORDER BY block) AS nxt FROM roles) r
  WHERE nxt IS NULL OR nxt <> role
)"""


@query(_BLOCKS_SQL + " SELECT conv_id, turn, block, role, text FROM blocks")
def transcript_blocks(t):
    return transcripts.transcript_blocks(_transcripts(t), ["conv_id", "turn"])


_PAIRS_SQL = """numbered_turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations
), pairs AS (
  SELECT conv_id, n, q.text AS question_text, a.text AS answer_text
  FROM (SELECT * FROM numbered_turns WHERE role = 'user') q
  JOIN (SELECT * FROM numbered_turns WHERE role = 'assistant') a USING (conv_id, n)
)"""


@query(f"WITH {_PAIRS_SQL} SELECT * FROM pairs")
def pair_turns(t):
    return transcripts.pair_turns(t.conversations, "conv_id", ["turn"])


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, n, question_text, answer_text, 1000 + row_number() OVER (ORDER BY conv_id, n) AS res_id FROM pairs")
def number_responses(t):
    return transcripts.number_responses(transcripts.pair_turns(t.conversations, "conv_id", ["turn"]), "conv_id", start=1000)


_PRUNE_CODE = "regexp_replace({0}, '(?s)```.*?```', '', 'g')"
_PRUNE_TITLES = f"regexp_replace('  #### head' || chr(10) || text, {lit(rf'(?m)^{WS}*#{{3,}}.*$')}, '', 'g')"
_CODED = "'a ```x' || chr(10) || text || '``` b ' || text || ' ```open'"


@query(f"SELECT conv_id, turn, {_PRUNE_CODE.format(_CODED)} AS text FROM conversations")
def prune_code(t):
    coded = F.concat(F.lit("a ```x\n"), "text", F.lit("``` b "), "text", F.lit(" ```open"))
    return t.conversations.select("conv_id", "turn", tx.prune_code(coded).alias("text"))


@query(f"SELECT doc_id, {_PRUNE_TITLES} AS text FROM documents")
def prune_titles(t):
    return t.documents.select("doc_id", tx.prune_titles(F.concat(F.lit("  #### head\n"), "text")).alias("text"))


@query("""WITH p AS (SELECT doc_id, string_split('**top** ' || text || CASE WHEN doc_id % 3 = 0 THEN '**' ELSE '' END, '**') AS x FROM documents),
runs AS (
  SELECT doc_id, unnest(CASE WHEN len(x) % 2 = 1 THEN x ELSE list_append(x[:-3], x[-2] || '**' || x[-1]) END) AS text,
    generate_subscripts(CASE WHEN len(x) % 2 = 1 THEN x ELSE list_append(x[:-3], x[-2] || '**' || x[-1]) END, 1) - 1 AS nth FROM p
)
SELECT doc_id, nth % 2 = 1 AS bold, text FROM runs WHERE text <> '' OR nth % 2 = 1""")
def bold_runs(t):
    marked = F.concat(F.lit("**top** "), "text", F.when(F.col("doc_id") % 3 == 0, F.lit("**")).otherwise(F.lit("")))
    return t.documents.select("doc_id", F.inline(tx.bold_runs(marked)))


# --- pages -----------------------------------------------------------------

_HREF_SQL = lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""")


@query(f"""SELECT page_id, pos, href FROM (
  SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, {_HREF_SQL}, 1) AS h FROM pages) x) y WHERE pos > 0""")
def page_links(t):
    return crawl.page_hrefs(t.pages, ["page_id"])


_BASE_SQL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"


@query(f"""WITH links AS (
  SELECT page_id, url, '<a href="/up">u</a><a href="name%20' || page_id || '%C3%A9.corpus.zip">z</a><a href="x.txt">t</a>' || html AS html FROM pages
), hrefs AS (
  SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, {_HREF_SQL}, 1) AS h FROM links) x
), decoded AS (
  SELECT page_id, pos, url_decode({_BASE_SQL}) AS base, url_decode({_BASE_SQL} || href) AS link FROM hrefs WHERE pos > 0 AND href LIKE '%.zip'
)
SELECT page_id, pos, 'subreddit-' || left(substr(link, length(base) + 1), length(link) - length(base) - length('.corpus.zip')) AS name FROM decoded""")
def archive_names(t):
    html = F.concat(F.lit('<a href="/up">u</a><a href="name%20'), "page_id", F.lit('%C3%A9.corpus.zip">z</a><a href="x.txt">t</a>'), "html")
    return crawl.archive_names(t.pages.select("page_id", "url", html.alias("html")), ["page_id"])


_HOST_SQL = "regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_PATH_SQL = "regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ROBOTS_SQL = f"""robots AS (
  SELECT {_HOST_SQL.format('url')} AS domain, unnest(['User-agent: *', 'Disallow: /' || (page_id % 10), 'Disallow: /fr', 'Allow: /en']) AS value
  FROM pages
), rules AS (SELECT domain, substr(value, 11) AS prefix FROM robots WHERE value LIKE 'Disallow: %')"""


def _robots(t):
    host, _ = crawl.split_url("url")
    lines = F.array(F.lit("User-agent: *"), F.concat(F.lit("Disallow: /"), F.col("page_id") % 10), F.lit("Disallow: /fr"), F.lit("Allow: /en"))
    return t.pages.select(host.alias("domain"), F.explode(lines).alias("value"))


@query(f"WITH {_ROBOTS_SQL} SELECT domain, prefix, count(*) AS n FROM rules GROUP BY ALL")
def robots_prefixes(t):
    return crawl.robots_prefixes(_robots(t), ["domain"]).groupBy("domain", "prefix").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ROBOTS_SQL} SELECT page_id, url FROM pages p WHERE {_HOST_SQL.format('url')} IN (SELECT domain FROM rules)
  AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.domain = {_HOST_SQL.format('p.url')} AND starts_with({_PATH_SQL.format('p.url')}, r.prefix))""")
def crawl_allowed(t):
    rules = crawl.robots_prefixes(_robots(t), ["domain"])
    return crawl.allowed_links(t.pages.select("page_id", "url"), "url", rules)


# Pages that link to others of their host like a tree, in three ways, and back.
_REST_SQL = "regexp_replace({0}, '^[a-zA-Z]+://[^/?#]*', '')"
_ADDRESS_SQL = "url_decode(regexp_replace({0}, '#.*$', ''))"
_LINKED_SQL = f"""numbered AS (
  SELECT page_id, url, html, {_HOST_SQL.format('url')} AS host, {_REST_SQL.format('url')} AS rest,
    row_number() OVER (PARTITION BY {_HOST_SQL.format('url')} ORDER BY page_id) AS n FROM pages
), added AS (
  SELECT p.page_id, string_agg('<a href="' || CASE c.n % 3 WHEN 0 THEN c.url WHEN 1 THEN c.rest ELSE '//' || c.host || c.rest END || '">x</a>', '' ORDER BY c.n) AS links
  FROM numbered p JOIN numbered c ON p.host = c.host AND (c.n // 2 = p.n OR p.n // 2 = c.n) GROUP BY p.page_id
), linked AS (
  SELECT page_id, url, n, '<a href="/">top</a>' || coalesce(links, '') || '<a href="set%20' || page_id || '.corpus.zip">z</a>' || html AS html
  FROM numbered LEFT JOIN added USING (page_id)
)"""


def _linked_pages(t):
    host, _ = crawl.split_url("url")
    rest = F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", "")
    pages = t.pages.withColumn("host", host).withColumn("rest", rest)
    pages = pages.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))
    href = F.when(F.col("n") % 3 == 0, F.col("url")).when(F.col("n") % 3 == 1, F.col("rest")).otherwise(F.concat(F.lit("//"), "host", "rest"))
    child = pages.select("host", F.col("n").alias("c"), href.alias("href"))
    above = pages.select("page_id", "host", F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1, F.floor(F.col("n") / 2))).alias("c"))
    # Number 1 is above itself by this rule only through 0, which is no page.
    links = above.join(child, ["host", "c"]).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("c", "href"))).alias("links"))
    anchors = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<a href="'), x["href"], F.lit('">x</a>'))), "")
    html = F.concat(F.lit('<a href="/">top</a>'), F.coalesce(anchors, F.lit("")), F.lit('<a href="set%20'), "page_id", F.lit('.corpus.zip">z</a>'), "html")
    return pages.join(links, "page_id", "left").select("page_id", "url", "n", html.alias("html"))


_FOLLOWED_SQL = f"""WITH RECURSIVE {_ROBOTS_SQL}, {_LINKED_SQL}, hrefs AS (
  SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, {_HREF_SQL}, 1) AS h FROM linked) x
), graph AS (
  SELECT DISTINCT {_ADDRESS_SQL.format('url')} AS source, {_ADDRESS_SQL.format("""CASE
    WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-zA-Z]+:') || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END""")} AS target
  FROM hrefs WHERE pos > 0
), open_pages AS (
  SELECT DISTINCT {_ADDRESS_SQL.format('p.url')} AS address FROM pages p WHERE NOT EXISTS (
    SELECT 1 FROM rules r WHERE r.domain = {_HOST_SQL.format('p.url')} AND starts_with({_PATH_SQL.format('p.url')}, r.prefix))
), steps AS (
  SELECT address, 0 AS step FROM open_pages WHERE address IN (SELECT {_ADDRESS_SQL.format('url')} FROM linked WHERE n = 1)
  UNION
  SELECT target, step + 1 FROM steps JOIN graph ON source = steps.address JOIN open_pages o ON o.address = target
  WHERE step < 24 AND {_HOST_SQL.format('source')} = {_HOST_SQL.format('target')}
), reached AS (SELECT address, min(step) AS step FROM steps GROUP BY address)"""


@query(_FOLLOWED_SQL + " SELECT address, CAST(step AS BIGINT) AS step FROM reached")
def followed_pages(t):
    pages = _linked_pages(t)
    rules = crawl.robots_prefixes(_robots(t), ["domain"])
    return crawl.followed_pages(pages, pages.filter("n = 1").select("url"), rules)


@query(_FOLLOWED_SQL + f""", decoded AS (
  SELECT page_id, pos, step, url_decode({_BASE_SQL}) AS base, url_decode({_BASE_SQL} || href) AS link
  FROM hrefs JOIN reached ON address = {_ADDRESS_SQL.format('url')} WHERE pos > 0 AND href LIKE '%.zip'
)
SELECT page_id, pos, CAST(step AS BIGINT) AS step,
  'subreddit-' || left(substr(link, length(base) + 1), length(link) - length(base) - length('.corpus.zip')) AS name FROM decoded""")
def archive_names_followed(t):
    pages = _linked_pages(t)
    rules = crawl.robots_prefixes(_robots(t), ["domain"])
    return crawl.archive_names_followed(pages, pages.filter("n = 1").select("url"), rules, ["page_id"])


# --- sentences and terms ---------------------------------------------------

@query(DOC_SEN + final("sen", "sentence", "doc_id sen_pos raw_words og_words filt_words"))
def sentences(t):
    return document_sentences(t).select("doc_id", "sen_pos", "sentence", "raw_words", "og_words", "filt_words")


@query()
def sentences_full_rule(t):
    return terms.explode_sentences(t.documents, ["doc_id"], [], "text")


# Texts with an abbreviation and an initial, as the tables have none.
_STOPS_SQL = r"regexp_replace(regexp_replace(text, ' (de|the|of) ', ' ca. \1 ', 'g'), ' (and|la|und) ', ' K. \1 ', 'g')"


def _with_stops(t):
    text = F.regexp_replace(F.regexp_replace("text", " (de|the|of) ", " ca. $1 "), " (and|la|und) ", " K. $1 ")
    return t.documents.select("doc_id", text.alias("text"))


def _core_sql(c: str) -> str:
    edges = lit(r"""^["'(\[{]+|["')\]}]+$""")
    return f"regexp_replace({c}, {edges}, '', 'g')"


def _kind_sql(c: str) -> str:
    return (rf"CASE WHEN regexp_matches({_core_sql(c)}, '[!?][.!?]*$') THEN 'mark' WHEN regexp_matches({_core_sql(c)}, '\.\.$') THEN 'dots'"
            f" WHEN ends_with({_core_sql(c)}, '.') THEN 'stop' ELSE 'word' END")


def _word_sql(c: str) -> str:
    word = f"lower(regexp_replace({_core_sql(c)}, '[.!?,;:]+$', ''))"
    return f"CASE WHEN regexp_matches({word}, '^[+-]?[0-9][0-9.,]*$') THEN '##' ELSE {word} END"


def _chance_sql(hits: str, tries: str, p: str) -> str:
    part = lambda n, q: f"CASE WHEN {n} > 0 THEN {n} * ln({q}) ELSE 0.0 END"
    return f"({part(hits, p)} + {part(f'({tries} - {hits})', f'(1 - {p})')})"


def _association_sql(together: str, first: str, second: str, total: str) -> str:
    p, p1 = f"(CAST({second} AS DOUBLE) / {total})", f"(CAST({together} AS DOUBLE) / {first})"
    apart, rest = f"({second} - {together})", f"({total} - {first})"
    p2 = f"(CAST({apart} AS DOUBLE) / {rest})"
    return (f"-2 * ({_chance_sql(together, first, p)} + {_chance_sql(apart, rest, p)}"
            f" - {_chance_sql(together, first, p1)} - {_chance_sql(apart, rest, p2)})")


_TOKENS_SQL = rf"""WITH tokens AS (
  SELECT unnest(w) AS token, unnest(list_concat([NULL], w[:len(w) - 1])) AS before
  FROM (SELECT {words_sql(_STOPS_SQL)} AS w FROM documents) x
), counts AS (
  SELECT CASE WHEN before IS NULL THEN 'start' ELSE {_kind_sql('before')} END AS kind,
    CASE WHEN before IS NOT NULL AND {_kind_sql('before')} = 'stop' THEN {_word_sql('before')} ELSE '' END AS before,
    {_word_sql('token')} AS word, {_kind_sql('token')} = 'stop' AS stop,
    regexp_matches({_core_sql('token')}, '^\p{{Lu}}') AS upper, regexp_matches({_core_sql('token')}, '^\p{{Ll}}') AS lower, count(*) AS n
  FROM tokens WHERE {_word_sql('token')} <> '' GROUP BY ALL
), totals AS (
  SELECT word, sum(n) AS n, sum(CASE WHEN stop THEN n ELSE 0 END) AS with_stop FROM counts GROUP BY word
), abbreviations AS (
  SELECT word, n, with_stop,
    -2 * ({_chance_sql('with_stop', 'n', '(CAST(stops AS DOUBLE) / total)')} - {_chance_sql('with_stop', 'n', 'CAST(0.99 AS DOUBLE)')})
      * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1)
      * pow(CAST(length(replace(word, '.', '')) AS DOUBLE), -(n - with_stop)) AS score
  FROM totals, (SELECT sum(n) AS total, sum(with_stop) AS stops FROM totals) s
  WHERE with_stop > 0 AND regexp_matches(word, '\p{{L}}')
)"""
_MODEL_SQL = _TOKENS_SQL + rf""", known AS (
  SELECT word FROM abbreviations WHERE score >= 0.3 UNION SELECT unnest([{", ".join(lit(w) for w in ABBREVIATIONS)}])
), ended AS (
  SELECT *, kind = 'mark' OR (kind = 'stop' AND before NOT IN (SELECT word FROM known)) AS after_end FROM counts
), starters AS (
  SELECT word, n, after_end, {_association_sql('after_end', 'ends', 'n', 'total')} AS ratio
  FROM (SELECT word, sum(n) AS n, sum(CASE WHEN after_end THEN n ELSE 0 END) AS after_end FROM ended GROUP BY word) w,
    (SELECT sum(n) AS total, sum(CASE WHEN after_end THEN n ELSE 0 END) AS ends FROM ended) s
  WHERE regexp_matches(word, '^\p{{L}}') AND after_end > 0 AND after_end * total > n * ends
), collocations AS (
  SELECT first, second, n, {_association_sql('n', 'n1', 'n2', 'total')} AS ratio
  FROM (SELECT before AS first, word AS second, sum(n) AS n FROM counts
    WHERE kind = 'stop' AND (regexp_matches(before, '^\p{{L}}$') OR before = '##') AND regexp_matches(word, '^\p{{L}}') GROUP BY ALL) p
  JOIN (SELECT word AS first, n AS n1 FROM totals) USING (first) JOIN (SELECT word AS second, n AS n2 FROM totals) USING (second),
    (SELECT sum(n) AS total FROM totals) s
  WHERE n * total > n1 * n2
)"""


@query(_TOKENS_SQL + final("abbreviations", "word", "n with_stop", "score"))
def abbreviation_scores(t):
    return splitting.abbreviation_scores(stage(splitting.token_counts(spread(_with_stops(t)), "text"), "counts"))


def _ended(t):
    counts = stage(splitting.token_counts(spread(_with_stops(t)), "text"), "counts")
    model = splitting.fit_splitter(_with_stops(t), "text", counts=counts)
    return counts, splitting.with_ends(counts, model.abbreviations)


@query(_MODEL_SQL + final("starters", "word", "n after_end", "ratio"))
def sentence_starters(t):
    return splitting.sentence_starters(_ended(t)[1])


@query(_MODEL_SQL + final("collocations", "first second", "n", "ratio"))
def stop_collocations(t):
    return splitting.stop_collocations(stage(splitting.token_counts(spread(_with_stops(t)), "text"), "counts"))


_NOT_WS = WS.replace("[", "[^", 1)
_FITTED_BREAK = lit(rf"""([.!?]+["')\]}}]*{WS}+)""")


@query(_MODEL_SQL + rf""", cases AS (
  SELECT word AS second, sum(CASE WHEN kind NOT IN ('start', 'dots') AND NOT after_end AND upper THEN n ELSE 0 END) AS upper_inside,
    sum(CASE WHEN lower THEN n ELSE 0 END) AS n_lower FROM ended GROUP BY word
), cut AS (
  SELECT doc_id, unnest(p) AS piece, unnest(list_concat(p[2:], [NULL])) AS next, generate_subscripts(p, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(regexp_replace({_STOPS_SQL}, {_FITTED_BREAK}, '\1' || chr(1), 'g'), chr(1)) AS p FROM documents) x
), sides AS (
  SELECT *, regexp_extract(piece, {lit(f'({_NOT_WS}+){WS}*$')}, 1) AS l, regexp_extract(next, {lit(f'^{WS}*({_NOT_WS}+)')}, 1) AS f FROM cut
), forms AS (
  SELECT doc_id, pos, piece, next, {_kind_sql('l')} AS kind, {_word_sql('l')} AS first, {_word_sql('f')} AS second,
    regexp_matches({_core_sql('f')}, '^\p{{Lu}}') AS upper, regexp_matches({_core_sql('f')}, '^\p{{Ll}}') AS lower FROM sides
), met AS (
  SELECT forms.*, first IN (SELECT word FROM known) AS is_known,
    (first, second) IN (SELECT (first, second) FROM collocations WHERE ratio >= 7.88 AND second NOT IN (SELECT word FROM starters WHERE ratio >= 30)) AS paired,
    second IN (SELECT word FROM starters WHERE ratio >= 30) AS starter,
    CASE WHEN upper AND coalesce(n_lower, 0) > 0 AND coalesce(upper_inside, 0) = 0 THEN TRUE WHEN lower THEN FALSE END AS starts,
    coalesce(n_lower, 0) > 0 AS seen_lower
  FROM forms LEFT JOIN cases USING (second)
), decided AS (
  SELECT doc_id, pos, piece, CASE
    WHEN next IS NULL OR kind NOT IN ('stop', 'dots') THEN TRUE
    WHEN kind = 'dots' THEN upper
    WHEN (regexp_matches(first, '^\p{{L}}$') OR first = '##') AND paired THEN FALSE
    WHEN regexp_matches(first, '^\p{{L}}$') THEN coalesce(starts, NOT (upper AND NOT seen_lower))
    WHEN is_known THEN coalesce(starts, starter AND upper)
    WHEN first = '##' THEN coalesce(starts, TRUE) ELSE TRUE END AS ends FROM met
), numbered AS (
  SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sen_pos FROM decided
)
SELECT doc_id, CAST(sen_pos AS BIGINT) AS sen_pos, {strip_sql("string_agg(piece, '' ORDER BY pos)")} AS part
FROM numbered GROUP BY doc_id, sen_pos HAVING {strip_sql("string_agg(piece, '' ORDER BY pos)")} <> ''""")
def fitted_sentences(t):
    texts = _with_stops(t)
    return splitting.split_fitted(texts, ["doc_id"], "text", splitting.fit_splitter(texts, "text")).select("doc_id", "sen_pos", "part")


@query()
def stems(t):
    found = terms.sentence_table(t.documents, ["doc_id"], [], "text")
    return terms.sentence_terms(found, ["doc_id"], [])


@query(f"""SELECT doc_id, word, count(*) AS n FROM (
  SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(translate(text, {lit(PUNCTUATION)}, '')), '\\p{{L}}+'),
    lambda w: length(w) BETWEEN 2 AND 15 AND NOT list_contains({STOP_LIST}, w))) AS word FROM documents) w GROUP BY ALL""")
def topic_words(t):
    words = t.documents.select("doc_id", F.explode(tx.topic_words("text")).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(DOC_SEN + counts_sql("doc_id", "") + final("st", "term", "doc_id sen_pos tf"))
def term_counts(t):
    return terms.sentence_terms(document_sentences(t), ["doc_id"], [])


@query(SRC_SEN + counts_sql("source", "doc_id") + final("gt", "source term", '"count" df'))
def group_terms(t):
    return terms.group_terms(document_sentences(t, ["source"], ["doc_id"]), ["source"])


@query(SRC_SEN + counts_sql("source", "doc_id") + final("tot", "source", "n_sentences n_responses total_words filt_total"))
def group_totals(t):
    return terms.group_totals(document_sentences(t, ["source"], ["doc_id"]), ["source"])


@query(DOC_SEN + counts_sql("doc_id", "") + final("tot", "", "doc_id n_sentences n_responses total_words filt_total"))
def document_totals(t):
    return terms.group_totals(document_sentences(t), ["doc_id"])


@query(CONV_SEN + counts_sql(*CONV) + final("gt", "term", "conv_id df"))
def doc_freq(t):
    return terms.group_terms(conversation_sentences(t), ["conv_id"]).select("conv_id", "term", "df")


@query(CONV_SEN + counts_sql(*CONV) +
       " SELECT conv_id, turn, sen_pos, CAST(coalesce(max(tf), 0) AS BIGINT) AS max_tf"
       " FROM sen LEFT JOIN st USING (conv_id, turn, sen_pos) GROUP BY ALL")
def max_tf(t):
    return terms.max_frequency(conversation_sentences(t), ["conv_id"], ["turn"])


# --- scores ----------------------------------------------------------------

_LISTING = """ SELECT conv_id, turn, CAST(sen_pos AS BIGINT) AS sen_pos, sentence, CAST(og_words AS BIGINT) AS og_words,
  round(score, 6) + 0.0 AS score FROM sc UNION ALL
  SELECT conv_id, turn, CAST(sen_pos AS BIGINT), sentence, CAST(og_words AS BIGINT), {0} FROM sen WHERE filt_words = 0"""


@query(CONV_SEN + counts_sql(*CONV) + scores_sql(*CONV) + _LISTING.format("1000.0"))
def kl_scores(t):
    found = stage(conversation_sentences(t), "sentences")
    return scoring.score_listing(found, ["conv_id"], ["turn"])


@query(CONV_SEN + counts_sql(*CONV) + scores_sql(*CONV, "tfidf") + _LISTING.format("0.0"))
def kl_tfidf_scores(t):
    found = stage(conversation_sentences(t), "sentences")
    return scoring.score_listing(found, ["conv_id"], ["turn"], "tfidf")


@query(CONV_SEN + counts_sql(*CONV) + scores_sql(*CONV) +
       " SELECT conv_id, bool_or(score > 0 AND score < 100) AS has_positive FROM sc GROUP BY conv_id")
def kl_positive(t):
    found = stage(conversation_sentences(t), "sentences")
    scored = scoring.score_sentences(found, ["conv_id"], ["turn"])
    return scoring.has_positive(scored.filter("filt_words > 0"), ["conv_id"])


@query("""SELECT vec_id, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x * len(p)) ELSE 0 END)), 6) + 0.0 AS kl FROM (
  SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS p
  FROM embeddings) e""")
def kl_distributions(t):
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    shares = t.embeddings.select("vec_id", size.alias("size")).withColumn(
        "total", F.aggregate("size", F.lit(0.0), lambda a, x: a + x))
    p = F.transform("size", lambda x: x / F.col("total"))
    q = F.transform("size", lambda x: F.lit(1.0) / F.size("size"))
    return shares.select("vec_id", p.alias("p"), q.alias("q")).select("vec_id", scoring.kl_divergence("p", "q").alias("kl"))


# --- summaries -------------------------------------------------------------

PICKED = " SELECT {keys}, CAST(rank AS BIGINT) AS rank, {order}CAST(sen_pos AS BIGINT) AS sen_pos, sentence, CAST(og_words AS BIGINT) AS og_words, round(score, 6) + 0.0 AS score FROM picks"


def summary_sql(sen: str, keys: str, order: str, limit: str, share=0.15, gate="TRUE", method="kl", end=PICKED):
    tail = end.replace("{keys}", keys).replace("{order}", order + ", " if order else "")
    return (sen + counts_sql(keys, order) + scores_sql(keys, order, method)
            + picks_sql(keys, order, limit, share, gate, method == "kl") + tail)


CHECKED = dict(rule="plain", normalize="lower", score_digits=DIGITS)


@query(summary_sql(CONV_SEN, *CONV, "percent", gate="total_words > 100"))
def summary_percent(t):
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", min_words=100, **CHECKED)


@query(summary_sql(CONV_SEN, *CONV, "250", gate="total_words > 20"))
def summary_250(t):
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", limit="250", min_words=20, **CHECKED)


@query(summary_sql(SRC_SEN, "source", "doc_id", "rev_count"))
def summary_rev_count(t):
    return plans.summarize(t.documents, ["source"], ["doc_id"], "text", limit="rev_count", **CHECKED)


@query(summary_sql(DOC_SEN, "doc_id", "", "doc"))
def summary_doc(t):
    return plans.summarize(t.documents, ["doc_id"], [], "text", limit="doc", **CHECKED)


@query(summary_sql(SRC_SEN, "source", "doc_id", "percent", share=0.10))
def summary_items(t):
    return plans.summarize(t.documents, ["source"], ["doc_id"], "text", share=0.10, **CHECKED)


# Reviews without an order: (source, text) alone. Sentences that differ only in
# their place have equal scores, so what is checked is what was picked.
@query(summary_sql(SRC_SEN, "source", "doc_id", "percent", share=0.10,
                   end=" SELECT {keys}, sentence, round(score, 6) + 0.0 AS score, count(*) AS n FROM picks GROUP BY ALL"))
def summary_without_order(t):
    picked = plans.summarize(t.documents, ["source"], [], "text", share=0.10, **CHECKED)
    return picked.groupBy("source", "sentence", F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query(summary_sql("WITH" + sentences_sql("conversations", "turn", "conv_id", "text"), "turn", "conv_id", "percent", gate="total_words > 0"))
def summary_by_response(t):
    return plans.summarize(t.conversations, ["turn"], ["conv_id"], "text", min_words=0, **CHECKED)


@query(summary_sql(CONV_SEN, *CONV, "percent", share=0.10, method="tfidf"))
def summary_tfidf(t):
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", method="tfidf", share=0.10, **CHECKED)


@query()
def summary_stemmed(t):
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", min_words=100)


def greedy_sql(sen: str, keys: str, order: str, level: int, limit: int, n_topics: int = 0, gate: str = "TRUE") -> str:
    """The greedy loop as a recursive CTE: one pick or rejection per group and step.
    ``n_topics`` scores by the keyword tables ``km`` and ``kw``, covering topics."""
    place = ", ".join(c for c in (keys, order, "sen_pos") if c)
    first = ", ".join(c for c in (order, "sen_pos") if c)
    topical = "JOIN km USING (term)" if n_topics else ""
    width = f" * (n_term_topics / {float(n_topics)})" if n_topics else ""
    topics_of = f"""topics_of AS (SELECT {place}, list(DISTINCT topic) AS own FROM tok JOIN kw USING (term) GROUP BY ALL),""" if n_topics else ""
    own = "own" if n_topics else "NULL::BIGINT[]"
    weight = f" * (({float(n_topics)} / len(x.own)) / pow(1.25, len(list_intersect(x.own, covered))))" if n_topics else ""
    left = {0: "cnt", 1: "list_transform(cnt, lambda c, j: c - coalesce(list_filter(x.toks, lambda k: k.t = j)[1].f, 0))",
            2: "list_transform(cnt, lambda c, j: c / coalesce(list_filter(x.toks, lambda k: k.t = j)[1].f, 1))"}[level]
    no_terms = "" if n_topics else f"""
  UNION ALL SELECT {keys}, 1, {first}, sentence, og_words, 1000.0 FROM (
    SELECT * FROM sen JOIN tot USING ({keys}) WHERE filt_total = 0 AND {gate}
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {first}) = 1) f WHERE og_words BETWEEN 5 AND 29"""
    return sen.replace("WITH", "WITH RECURSIVE", 1) + f""",
tok AS (
  SELECT {place}, term, min(i) AS first, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT {place}, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM sen) u GROUP BY ALL
), {topics_of}
tid AS (SELECT {keys}, term, row_number() OVER (PARTITION BY {keys} ORDER BY term) AS t, sum(tf) AS n FROM tok GROUP BY {keys}, term),
tot AS (SELECT {keys}, CAST(sum(filt_words) AS DOUBLE) AS filt_total, sum(raw_words) AS total_words FROM sen GROUP BY {keys}),
one AS (
  SELECT {place}, list(struct_pack(t := t, f := tf, b := (tf / filt_words){width}) ORDER BY first) AS toks
  FROM tok JOIN tid USING ({keys}, term) JOIN sen USING ({place}) {topical} GROUP BY {place}
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {first}) AS i FROM sen),
pool AS MATERIALIZED (
  SELECT {keys}, list(struct_pack(i := i, og := og_words, n := filt_words, s := sentence, toks := toks, own := {own}) ORDER BY i) AS xs
  FROM numbered JOIN one USING ({place}) {f"JOIN topics_of USING ({place})" if n_topics else ""} GROUP BY {keys}
),
rec AS (
  SELECT {keys}, cnt, filt_total AS total, []::BIGINT[] AS used, 0::BIGINT AS taken, 0 AS rank, NULL::VARCHAR AS last,
    []::BIGINT[] AS covered, FALSE AS ok, 0::BIGINT AS i, 0::DOUBLE AS score
  FROM (SELECT {keys}, list(n ORDER BY t) AS cnt FROM tid GROUP BY {keys}) c JOIN tot USING ({keys}) JOIN pool USING ({keys}) WHERE {gate}
  UNION ALL
  SELECT {keys}, {left}, total - {"x.n" if level else "0"}, list_append(used, x.i), taken + CASE WHEN pick THEN x.og ELSE 0 END,
    rank + CAST(pick AS INT), CASE WHEN pick THEN x.s ELSE last END,
    CASE WHEN pick THEN list_distinct(covered || coalesce(x.own, []::BIGINT[])) ELSE covered END, pick, x.i, best.score
  FROM (
    SELECT *, x.og BETWEEN 5 AND 29 AND x.s IS DISTINCT FROM last AS pick FROM (
      SELECT *, list_filter(xs, lambda y: y.i = best.i)[1] AS x FROM (
        SELECT *, list_min(list_transform(list_filter(xs, lambda x: NOT list_contains(used, x.i)), lambda x: struct_pack(
          score := list_sum(list_transform(x.toks, lambda k: CASE WHEN cnt[k.t] > 0 THEN (cnt[k.t] / total) * ln((cnt[k.t] / total) / k.b) ELSE 0 END)){weight} / x.n,
          i := x.i))) AS best
        FROM rec JOIN pool USING ({keys}) WHERE taken < {limit} AND len(used) < len(xs)) a) b) c
)
SELECT {keys}, CAST(rank AS BIGINT) AS rank, {order + ", " if order else ""}CAST(sen_pos AS BIGINT) AS sen_pos, sentence,
  CAST(og_words AS BIGINT) AS og_words, round(score, 6) + 0.0 AS score
FROM (SELECT {keys}, rank, {first}, sentence, og_words, score FROM rec JOIN numbered USING ({keys}, i) WHERE ok{no_terms}) p"""


PLAIN = dict(rule="plain", normalize="lower")


@query(greedy_sql(CONV_SEN, *CONV, 1, 250))
def summary_level_1(t):
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", limit="250", redundancy=1, **PLAIN)


@query(greedy_sql(CONV_SEN, *CONV, 2, 250))
def summary_level_2_conversations(t):
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", limit="250", redundancy=2, **PLAIN)


@query()
def summary_level_1_stemmed(t):
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", limit="250", redundancy=1)


@query(greedy_sql(SRC_SEN, "source", "doc_id", 2, 250))
def summary_level_2(t):
    return plans.summarize(t.documents, ["source"], ["doc_id"], "text", limit="250", redundancy=2, **PLAIN)


@query()
def summary_level_2_stemmed(t):
    return plans.summarize(t.documents, ["source"], ["doc_id"], "text", limit="250", redundancy=2)


@query(summary_sql(CONV_SEN, *CONV, "percent", gate="total_words > 100",
                   end=" SELECT {keys}, string_agg(sentence, ' ' ORDER BY rank) AS paragraph,"
                       " CAST(sum(og_words) AS BIGINT) AS n_words FROM picks GROUP BY {keys}"))
def paragraph(t):
    return plans.paragraphs(summary_percent(t), ["conv_id"])


@query(summary_sql(CONV_SEN, *CONV, "250", gate="total_words > 20", end=f""", counted AS (
  SELECT *, len({words_sql('sentence')}) AS w, sum(len({words_sql('sentence')})) OVER (PARTITION BY conv_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM picks
) SELECT conv_id, CAST(rank AS BIGINT) AS rank, sentence FROM counted WHERE run - w <= 60 + conv_id % 50 - 1"""))
def shorten_extract(t):
    short = plans.shorten_extract(summary_250(t), ["conv_id"], F.lit(60) + F.col("conv_id") % 50)
    return short.select("conv_id", "rank", "sentence")


@query(DOC_SEN + f""", counted AS (
  SELECT *, sum(raw_words) OVER (PARTITION BY doc_id ORDER BY sen_pos ROWS UNBOUNDED PRECEDING) AS run FROM parts_counted
) SELECT doc_id, string_agg(part, ' ' ORDER BY sen_pos) AS shortened, CAST(sum(raw_words) AS BIGINT) AS n_words
FROM counted WHERE run - raw_words <= CASE WHEN 100 + doc_id % 300 > 250 THEN 250 ELSE 100 + doc_id % 300 - 1 END GROUP BY doc_id""".replace(
    "parts_counted", "closed"))
def shorten_text(t):
    short = plans.shorten_text(t.documents, "text", F.lit(100) + F.col("doc_id") % 300, rule="plain")
    return short.filter("n_words > 0").select("doc_id", "shortened", "n_words")


@query("""SELECT source, row_number() OVER (ORDER BY first_doc, source) AS val
  FROM (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY source) f""")
def number_groups(t):
    return plans.number_groups(t.documents, ["source"], ["doc_id"])


# --- summaries as files ----------------------------------------------------

@query(summary_sql(SRC_SEN, "source", "doc_id", "percent", share=0.10, end="") + """
SELECT source, part, idx, replace(sentence, chr(10), ' ') AS sentence FROM (
  SELECT source, 'source' AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id, sen_pos) - 1 AS idx, sentence FROM sen
  UNION ALL SELECT source, 'summary', row_number() OVER (PARTITION BY source ORDER BY rank) - 1, sentence FROM picks) r""")
def summary_folders(t):
    """Source and summary of each group written as text files, and parsed again."""
    path = f"{staging_dir(t.spark)}/gistmill/summaries-{uuid.uuid4().hex}"
    sentences = stage(document_sentences(t, ["source"], ["doc_id"]), "sentences")
    summary = plans.summarize_sentences(sentences, ["source"], ["doc_id"], share=0.10, score_digits=DIGITS)
    sinks.write_summary_files(sentences, summary, "source", ["doc_id", "sen_pos"], path)
    return readers.read_summary_folders(t.spark, path, "source")


# --- topics ----------------------------------------------------------------

N_TOPICS = 10


def _keywords(t) -> DataFrame:
    """Keyword table made from the benchmark texts: ten topics, words of seven letters or more."""
    words = tx.lowered(tx.split_words(tx.strip_punctuation("text")))
    listed = t.benchmark.select((F.col("item_id") % N_TOPICS).cast("int").alias("topic"), F.filter(words, lambda w: F.length(w) >= 7).alias("terms"))
    return topics.keyword_map(listed)


_TOPIC_SQL = f""",
kw AS (
  SELECT DISTINCT item_id % {N_TOPICS} AS topic, unnest(list_filter(list_transform({words_sql(f"translate(text, {lit(PUNCTUATION)}, '')")},
    lambda w: lower(w)), lambda w: length(w) >= 7)) AS term FROM benchmark
),
km AS (SELECT term, count(*) AS n_term_topics FROM kw GROUP BY term)"""
_DOC_TOPICS = SRC_SEN + counts_sql("source", "doc_id") + _TOPIC_SQL


@query(f"WITH {_TOPIC_SQL.lstrip(',')} SELECT term, topic FROM kw")
def keyword_map(t):
    return _keywords(t).select("term", F.explode("topics").alias("topic"))


@query(_DOC_TOPICS + " SELECT DISTINCT source, doc_id, CAST(sen_pos AS BIGINT) AS sen_pos, topic FROM st JOIN kw USING (term)")
def sentence_topics(t):
    found = topics.sentence_topics(document_sentences(t, ["source"], ["doc_id"]), ["source"], ["doc_id"], _keywords(t))
    return found.withColumn("topic", F.explode("sen_topics")).drop("sen_topics")


@query(_DOC_TOPICS + scores_sql("source", "doc_id", "topics", N_TOPICS) + final("sc", "source", "doc_id sen_pos og_words", "score"))
def topic_scores(t):
    found = stage(document_sentences(t, ["source"], ["doc_id"]), "sentences")
    scored = scoring.score_sentences(found, ["source"], ["doc_id"], "topics", keywords=_keywords(t), n_topics=N_TOPICS)
    return scored.select("source", "doc_id", "sen_pos", "og_words", "score")


def _given_model(t) -> topics.TopicModel:
    return topics.TopicModel(None, _keywords(t), N_TOPICS)


@query(_DOC_TOPICS + scores_sql("source", "doc_id", "topics", N_TOPICS) + picks_sql("source", "doc_id", "percent", 0.10, "TRUE", False)
       + PICKED.format(keys="source", order="doc_id, "))
def topic_summary_v1(t):
    return plans.summarize(t.documents, ["source"], ["doc_id"], "text", method="topics", share=0.10, model=_given_model(t), **CHECKED)


@query(greedy_sql(SRC_SEN + _TOPIC_SQL, "source", "doc_id", 0, 250, N_TOPICS))
def topic_summary_v2(t):
    return plans.summarize(t.documents, ["source"], ["doc_id"], "text", method="topics", variant="v2", limit="250",
                           model=_given_model(t), rule="plain", normalize="lower")


@query()
def fitted_topics(t):
    model = topics.fit_topics(t.documents, "text", n_topics=20)
    return model.topics.select("topic", F.explode("terms").alias("term"))


@query()
def group_topics(t):
    return topics.fit_topics(t.documents, "text", ["source"]).topics.select("source", "topic", F.explode("terms").alias("term"))


@query()
def group_topic_summary(t):
    model = topics.fit_topics(t.documents, "text", ["source"])
    return plans.summarize(t.documents, ["source"], ["doc_id"], "text", method="topics", share=0.10, model=model, rule="plain")


@query()
def fitted_topic_summary(t):
    model = topics.fit_topics(t.conversations, "text", n_topics=10)
    return plans.summarize(t.conversations, ["conv_id"], ["turn"], "text", method="topics", share=0.10, model=model)


_COHERENCE_SQL = f"""WITH listed AS (
  SELECT DISTINCT item_id % {N_TOPICS} AS topic, unnest(list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: length(w) BETWEEN 9 AND 15)) AS term
  FROM benchmark
), held AS (
  SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(translate(text, {lit(PUNCTUATION)}, '')), '\\p{{L}}+'),
    lambda w: length(w) BETWEEN 2 AND 15 AND NOT list_contains({STOP_LIST}, w))) AS term FROM documents
), met AS (SELECT doc_id, topic, term FROM held JOIN listed USING (term)),
single AS (SELECT topic, term, count(*) AS df FROM met GROUP BY ALL),
pairs AS (SELECT topic, a.term AS a, b.term AS b, count(*) AS n FROM met a JOIN met b USING (doc_id, topic) WHERE a.term < b.term GROUP BY ALL),
total AS (SELECT count(*) AS texts FROM documents),
scored AS (
  SELECT topic, CASE WHEN n = texts THEN 1 ELSE ln(n * texts / (x.df * y.df)) / ln(texts / n) END AS npmi
  FROM pairs JOIN single x USING (topic) JOIN single y USING (topic), total WHERE x.term = a AND y.term = b
), sums AS (SELECT topic, sum(npmi) AS s, count(*) AS f FROM scored GROUP BY topic),
sized AS (SELECT topic, count(*) * (count(*) - 1) // 2 AS n_pairs FROM listed GROUP BY topic)
SELECT topic, CAST(n_pairs AS BIGINT) AS n_pairs, round((coalesce(s, 0) - (n_pairs - coalesce(f, 0))) / nullif(n_pairs, 0), 6) + 0.0 AS coherence
FROM sized LEFT JOIN sums USING (topic)"""


@query(_COHERENCE_SQL)
def topic_coherence(t):
    """How well the terms of given topics, long words of benchmark items, go together in the documents."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    listed = t.benchmark.select((F.col("item_id") % N_TOPICS).alias("topic"), found.alias("term")).filter(F.length("term").between(9, 15))
    given = listed.groupBy("topic").agg(F.collect_set("term").alias("terms"))
    return topics.coherence(given, t.documents.select(tx.topic_words("text").alias("words")))


@query()
def topic_perplexity(t):
    """Topics fitted to four fifths of the documents, measured on the others."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = topics.fit_topics(t.documents.filter(~fold), "text", n_topics=20)
    return topics.perplexity(model.weights, topics.topic_terms(t.documents.filter(fold), "text").select("words"))


# --- evaluation ------------------------------------------------------------

# DuckDB's edit distance counts bytes, so there each accented letter becomes a
# control character of one byte; all other tests see the text as it is.
_ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßáàâäçèéêíîñóôöúü"
_BYTES = [*range(1, 9), *range(14, 32), 127]
_NARROW = f"translate({{0}}, {lit(_ACCENTED)}, {' || '.join(f'chr({b})' for b in _BYTES)})"
_BIGRAMS = f""", allw AS (
  SELECT conv_id, {words_sql("string_agg(sentence, ' ' ORDER BY rank)")} AS w FROM picks GROUP BY conv_id
), grams AS (
  SELECT conv_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM allw
), ratio AS (SELECT conv_id, count(DISTINCT g) / count(*) AS ratio FROM grams GROUP BY conv_id)"""
_SUM_250 = summary_sql(CONV_SEN, *CONV, "250", gate="total_words > 20", end="")


@query(_SUM_250 + _BIGRAMS + " SELECT conv_id, round(ratio - 1, 6) + 0.0 AS redundancy FROM ratio")
def ngram_redundancy(t):
    return evaluate.ngram_redundancy(summary_250(t), ["conv_id"])


_PAIRS_TEST = f""", items AS (
  SELECT conv_id, rank, sentence AS s FROM picks
), worded2 AS (
  SELECT *, length(s) AS n, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]') AS w FROM items
), pairs AS (
  SELECT a.conv_id, a.s AS s1, b.s AS s2, a.w AS w1, b.w AS w2, least(a.n, b.n) AS m, least(len(a.w), len(b.w)) AS k,
    CASE WHEN a.n > b.n THEN b.s ELSE a.s END AS short, CASE WHEN a.n > b.n THEN a.s ELSE b.s END AS long,
    CASE WHEN len(a.w) > len(b.w) THEN b.w ELSE a.w END AS few, CASE WHEN len(a.w) > len(b.w) THEN a.w ELSE b.w END AS many
  FROM worded2 a JOIN worded2 b ON a.conv_id = b.conv_id AND a.rank < b.rank
), tests AS (
  SELECT conv_id,
    CAST(len(list_filter(range(1, m - (4 * m + 4) // 5 + 2), lambda i: contains(long, substr(short, i, (4 * m + 4) // 5)))) > 0 AS INT)
    + CAST(len(list_filter(range(1, k - (4 * k + 4) // 5 + 2),
        lambda i: contains(' ' || array_to_string(many, ' ') || ' ', ' ' || array_to_string(few[i:i + (4 * k + 4) // 5 - 1], ' ') || ' '))) > 0 AS INT)
    + CAST(levenshtein({_NARROW.format('s1')}, {_NARROW.format('s2')}) * 5 <= m * 3 AS INT)
    + CAST(len(list_distinct(list_intersect(w1, w2))) * 5 >= k * 4 AS INT) AS passed
  FROM pairs
)
SELECT conv_id, round(CAST(-0.1 * coalesce(sum(passed), 0) AS DOUBLE), 6) + 0.0 AS redundancy
FROM (SELECT DISTINCT conv_id FROM picks) c LEFT JOIN tests USING (conv_id) GROUP BY conv_id"""


@query(_SUM_250 + _PAIRS_TEST)
def pair_redundancy(t):
    return evaluate.pair_redundancy(summary_250(t), ["conv_id"])


_FOCUS_SQL = """v AS (
  SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings
), sims AS (
  SELECT a.label, a.rank, coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 1) AS sim, b.rank IS NOT NULL AS paired
  FROM v a LEFT JOIN v b ON a.label = b.label AND b.rank = a.rank + 1
), foc AS (SELECT label, -0.1 * sum(CAST(paired AND sim < 0.05 AS INT)) AS focus FROM sims GROUP BY label)"""


def _ranked_vectors(t) -> DataFrame:
    return corpus.number_utterances(t.embeddings, ["label"], ["vec_id"], "rank")


@query(f"WITH {_FOCUS_SQL} SELECT label, round(CAST(focus AS DOUBLE), 6) + 0.0 AS focus FROM foc")
def focus(t):
    return evaluate.focus(_ranked_vectors(t), ["label"], "embedding").withColumn("label", F.col("label").cast("long"))


_ERRORS = "CAST(length(sentence) - length(replace(sentence, 'z', '')) + og_words % 3 AS BIGINT)"
_GRAMMAR_SQL = f""", gram AS (
  SELECT conv_id, sum({_ERRORS}) AS n_errors, sum(len({words_sql('sentence')})) AS n_words FROM picks GROUP BY conv_id
)"""


def _with_errors(summary: DataFrame) -> DataFrame:
    z = F.length("sentence") - F.length(F.replace("sentence", F.lit("z"), F.lit("")))
    return summary.withColumn("n_errors", z + F.col("og_words") % 3)


@query(_SUM_250 + _GRAMMAR_SQL + " SELECT conv_id, CAST(n_errors AS BIGINT) AS n_errors, CAST(n_words AS BIGINT) AS n_words,"
       " round(1 - n_errors / n_words, 6) + 0.0 AS grammar FROM gram")
def grammar(t):
    return evaluate.grammar(_with_errors(summary_250(t)), ["conv_id"])


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part))"
       " / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 6) + 0.0 AS scaled FROM part")
def min_max(t):
    return evaluate.min_max(t.part, "p_retailprice").select("p_partkey", "scaled")


@query("SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, round((s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 6) + 0.0 AS scaled"
       " FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def min_max_by_group(t):
    return evaluate.min_max(t.supplier, "s_acctbal", ["s_nationkey"]).select("s_suppkey", "s_nationkey", "scaled")


# Focus per conversation needs a vector per sentence; here its first letters stand in for one.
def _letter_vectors(summary: DataFrame) -> DataFrame:
    counts = [F.length("sentence") - F.length(F.replace(F.lower("sentence"), F.lit(c), F.lit(""))) for c in "zjqkwy"]
    return summary.withColumn("vector", F.array(*(c.cast("double") for c in counts)))


_LETTERS_SQL = "[" + ", ".join(f"CAST(length(sentence) - length(replace(lower(sentence), '{c}', '')) AS DOUBLE)" for c in "zjqkwy") + "]"
_READ_SQL = _BIGRAMS + _GRAMMAR_SQL + f""", lv AS (SELECT conv_id, rank, {_LETTERS_SQL} AS vec FROM picks),
sims AS (
  SELECT a.conv_id, b.rank IS NOT NULL AS paired,
    CASE WHEN list_sum(list_transform(a.vec, lambda x: x * x)) * list_sum(list_transform(b.vec, lambda x: x * x)) > 0
      THEN list_cosine_similarity(a.vec, b.vec) ELSE 0 END AS sim
  FROM lv a LEFT JOIN lv b ON a.conv_id = b.conv_id AND b.rank = a.rank + 1
), foc AS (SELECT conv_id, -0.1 * sum(CAST(paired AND sim < 0.05 AS INT)) AS focus FROM sims GROUP BY conv_id),
siz AS (SELECT conv_id, count(*) AS n_sentences FROM picks GROUP BY conv_id)"""


@query(_SUM_250 + _READ_SQL + """ SELECT conv_id, round(CAST(focus AS DOUBLE), 6) + 0.0 AS focus, round(ratio - 1, 6) + 0.0 AS redundancy, round(1 - n_errors / n_words, 6) + 0.0 AS grammar,
  round(focus + ratio - 1 + 1 - n_errors / n_words, 6) + 0.0 AS readability FROM foc JOIN ratio USING (conv_id) JOIN gram USING (conv_id)""")
def readability(t):
    summary = stage(_letter_vectors(_with_errors(summary_250(t))), "summary")
    return _readability(summary)


def _readability(summary: DataFrame) -> DataFrame:
    return evaluate.readability(
        evaluate.ngram_redundancy(summary, ["conv_id"]), evaluate.focus(summary, ["conv_id"], "vector"),
        evaluate.grammar(summary, ["conv_id"]), ["conv_id"],
    )


@query(_SUM_250 + _READ_SQL + """ SELECT conv_id, round((1 - n_errors / n_words) / 3, 6) + 0.0 AS grammar,
  round((1 - abs(ratio - 1) * 10 / n_sentences) / 3, 6) + 0.0 AS redundancy, round((1 - abs(focus) * 10 / n_sentences) / 3, 6) + 0.0 AS focus,
  round((1 - n_errors / n_words) / 3 + (1 - abs(ratio - 1) * 10 / n_sentences) / 3 + (1 - abs(focus) * 10 / n_sentences) / 3, 6) + 0.0 AS readability
  FROM foc JOIN ratio USING (conv_id) JOIN gram USING (conv_id) JOIN siz USING (conv_id)""")
def readability_thirds(t):
    summary = stage(_letter_vectors(_with_errors(summary_250(t))), "summary")
    keys = ["conv_id"]
    return evaluate.readability_thirds(
        evaluate.ngram_redundancy(summary, keys), evaluate.focus(summary, keys, "vector"),
        evaluate.grammar(summary, keys), evaluate.summary_sizes(summary, keys), keys,
    )


@query("""SELECT doc_id, CAST(quality AS BIGINT) AS first_score, CAST(toxic AS BIGINT) AS second_score,
  CASE WHEN quality > toxic THEN 'first' ELSE 'second' END AS chosen FROM labels""")
def choose_candidate(t):
    return evaluate.choose_candidate(
        t.labels.select("doc_id", F.col("quality").alias("readability")), t.labels.select("doc_id", F.col("toxic").alias("readability")), ["doc_id"])


_TO_CHOOSE = """SELECT conv_id, focus + ratio - 1 + 1 - n_errors / n_words AS readability
  FROM foc JOIN ratio USING (conv_id) JOIN gram USING (conv_id)"""
_BY_WORDS = f"WITH picks AS ({greedy_sql(CONV_SEN, *CONV, 2, 250)}){_READ_SQL} {_TO_CHOOSE}"
_BY_SHARE = f"""WITH picks AS ({summary_sql(CONV_SEN, *CONV, "percent", share=0.10)}){_READ_SQL} {_TO_CHOOSE}"""


@query(f"""SELECT conv_id, round(f.readability, 6) + 0.0 AS first_score, round(s.readability, 6) + 0.0 AS second_score,
  CASE WHEN f.readability > s.readability THEN 'first' ELSE 'second' END AS chosen FROM ({_BY_WORDS}) f LEFT JOIN ({_BY_SHARE}) s USING (conv_id)""")
def chosen_summaries(t):
    return _chosen(t, **PLAIN)


@query()
def chosen_summaries_stemmed(t):
    return _chosen(t)


def _chosen(t, **options) -> DataFrame:
    by_words, by_share = plans.two_candidates(t.conversations, ["conv_id"], ["turn"], "text", **options)
    first = _readability(stage(_letter_vectors(_with_errors(by_words)), "first"))
    second = _readability(stage(_letter_vectors(_with_errors(by_share)), "second"))
    return evaluate.choose_candidate(first, second, ["conv_id"])


# Words of each conversation turn without marks, in lower case.
_VECTOR_SIZE, _WINDOW = 16, 4
_SIGNED = ", ".join(f"sum(CASE WHEN substr(md5(context), {i + 1}, 1) >= '8' THEN w ELSE -w END) AS v{i}" for i in range(_VECTOR_SIZE))
_VECTOR_LIST = "[" + ", ".join(f"coalesce(v{i}, 0)" for i in range(_VECTOR_SIZE)) + "]"
_VECTORS_SQL = f"""said AS (
  SELECT list_transform({words_sql(f"translate(text, {lit(PUNCTUATION)}, '')")}, lambda w: lower(w)) AS ws FROM conversations
), near_words AS (
  SELECT unnest(list_transform(range(1, len(ws) - d + 1), lambda i: {{'word': ws[i], 'context': ws[i + d]}})) AS p FROM said, (SELECT unnest(range(1, {_WINDOW + 1})) AS d) ds
), meets AS (
  SELECT word, context, count(*) AS n FROM (SELECT p.word AS word, p.context AS context FROM near_words UNION ALL SELECT p.context, p.word FROM near_words) b GROUP BY ALL
), word_totals AS (SELECT word, sum(n) AS total FROM meets GROUP BY word),
weighed AS (
  SELECT meets.word, context, n * CAST((SELECT sum(total) FROM word_totals) AS DOUBLE) / (CAST(o.total AS DOUBLE) * CAST(c.total AS DOUBLE)) AS chance
  FROM meets JOIN word_totals o ON o.word = meets.word JOIN word_totals c ON c.word = meets.context
), signed AS (
  SELECT word, {_SIGNED} FROM (SELECT word, context, CAST(round(ln(chance) * 1000000) AS BIGINT) AS w FROM weighed WHERE chance > 1) x GROUP BY word
), word_vecs AS (SELECT word, {_VECTOR_LIST} AS vec FROM word_totals LEFT JOIN signed USING (word))"""


def _learned(t) -> DataFrame:
    words = tx.lowered(tx.split_words(tx.strip_punctuation("text")))
    return vectors.learn_vectors(spread(t.conversations.select(words.alias("words"))), "words", _VECTOR_SIZE, _WINDOW)


@query(f"WITH {_VECTORS_SQL} SELECT word, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim, CAST(unnest(vec) AS BIGINT) AS value FROM word_vecs")
def learned_vectors(t):
    return _learned(t).select("word", F.posexplode("vector").alias("dim", "value"))


_MEANS = ", ".join(f"avg(CAST(vec[{i + 1}] AS DOUBLE))" for i in range(_VECTOR_SIZE))


@query(_SUM_250 + f""", {_VECTORS_SQL}, opened AS (
  SELECT conv_id, rank, unnest(list_transform({words_sql(f"translate(sentence, {lit(PUNCTUATION)}, '')")}, lambda w: lower(w))) AS word FROM picks
), means AS (SELECT conv_id, rank, [{_MEANS}] AS vec FROM opened JOIN word_vecs USING (word) GROUP BY ALL),
placed AS (SELECT conv_id, rank, vec FROM picks LEFT JOIN means USING (conv_id, rank)),
sims AS (
  SELECT a.conv_id, b.rank IS NOT NULL AS paired, coalesce(CASE WHEN list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec) > 0
    THEN list_cosine_similarity(a.vec, b.vec) END, 0) AS sim
  FROM placed a LEFT JOIN placed b ON a.conv_id = b.conv_id AND b.rank = a.rank + 1
) SELECT conv_id, round(CAST(-0.1 * sum(CAST(paired AND sim < 0.5 AS INT)) AS DOUBLE), 6) + 0.0 AS focus FROM sims GROUP BY conv_id""")
def focus_trained(t):
    """Focus by vectors learned from the conversations; unlike is below 0.5 here, as
    words of one table keep much of the same company."""
    words = tx.lowered(tx.split_words(tx.strip_punctuation("sentence")))
    summary = stage(summary_250(t).select("conv_id", "rank", words.alias("words")), "summary")
    placed = vectors.sentence_vectors(summary, ["conv_id", "rank"], "words", _learned(t), _VECTOR_SIZE)
    return evaluate.focus(placed, ["conv_id"], "vector", low=0.5)


@query(f"""WITH said AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]') AS w FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, least(len(a.w), len(b.w)) AS shorter FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
opened AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM said),
met AS (
  SELECT a.conv_id, a.turn, a.pos - b.pos AS diagonal, a.pos AS i FROM opened a JOIN opened b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word
), islands AS (SELECT conv_id, turn, diagonal, i - row_number() OVER (PARTITION BY conv_id, turn, diagonal ORDER BY i) AS island FROM met),
runs AS (SELECT conv_id, turn, count(*) AS run FROM islands GROUP BY conv_id, turn, diagonal, island),
longest AS (SELECT conv_id, turn, max(run) AS run FROM runs GROUP BY ALL)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(run, 0) AS run, round(coalesce(run / nullif(shorter, 0), 0), 6) + 0.0 AS share
FROM pairs LEFT JOIN longest USING (conv_id, turn)""")
def common_runs(t):
    return evaluate.common_runs(t.conversations, ["conv_id"], "turn", "text")


_ROUGE_WORDS = "list_transform({0}, lambda w: lower(w))"
_ROUGE_SQL = f"""WITH said AS (SELECT conv_id, turn, role, {_ROUGE_WORDS.format(words_sql(f"translate(text, {lit(PUNCTUATION)}, '')"))} AS w FROM conversations),
c AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM said) x GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, g, n FROM c),
both_sides AS (SELECT conv_id, turn, sum(least(c.n, r.n)) AS b FROM c JOIN r USING (conv_id, turn, g) GROUP BY ALL),
ct AS (SELECT conv_id, turn, sum(n) AS cn FROM c GROUP BY ALL), rt AS (SELECT conv_id, turn, sum(n) AS rn FROM r GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(b, 0) / cn, 6) + 0.0 AS "precision", round(coalesce(b, 0) / rn, 6) + 0.0 AS recall,
  round(CASE WHEN b > 0 THEN 2 * (b / cn) * (b / rn) / (b / cn + b / rn) ELSE 0 END, 6) + 0.0 AS f1
FROM ct JOIN rt USING (conv_id, turn) LEFT JOIN both_sides USING (conv_id, turn)"""


def _said(t, back: int) -> DataFrame:
    words = tx.lowered(tx.split_words(tx.strip_punctuation("text")))
    return t.conversations.select("conv_id", (F.col("turn") - back).alias("turn"), words.alias("words"))


@query(_ROUGE_SQL)
def rouge_2(t):
    return evaluate.rouge_n(_said(t, 0), _said(t, 1), ["conv_id", "turn"], n=2)


# Longest common subsequences, row by row: a fold over one side's words whose
# state is the last row of the table, itself a fold over the other side's words.
_LCS_ROW = """list_reduce(list_prepend([0], list_transform(range(1, len(r) + 1), lambda j: [j])), lambda row, j:
    list_append(row, CASE WHEN r[j[1]] = w THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], row[-1]) END))"""


@query(f"""WITH RECURSIVE said AS (SELECT conv_id, turn, {_ROUGE_WORDS.format(words_sql(f"translate(text, {lit(PUNCTUATION)}, '')"))} AS w FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.w AS c, b.w AS r FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
fold AS (
  SELECT conv_id, turn, c, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda j: 0::BIGINT) AS above FROM pairs
  UNION ALL
  SELECT conv_id, turn, c, r, i + 1, {_LCS_ROW.replace("= w", "= c[i + 1]")} FROM fold WHERE i < len(c)
),
lcs AS (SELECT conv_id, turn, len(c) AS cn, len(r) AS rn, above[-1] AS b FROM fold WHERE i = len(c))
SELECT conv_id, turn, round(coalesce(b / nullif(cn, 0), 0), 6) + 0.0 AS "precision", round(coalesce(b / nullif(rn, 0), 0), 6) + 0.0 AS recall,
  round(CASE WHEN b > 0 THEN 2 * (b / cn) * (b / rn) / (b / cn + b / rn) ELSE 0 END, 6) + 0.0 AS f1 FROM lcs""")
def rouge_l(t):
    return evaluate.rouge_l(_said(t, 0), _said(t, 1), ["conv_id", "turn"])
