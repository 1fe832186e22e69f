"""Queries of text functions, chunking, conversations and answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import chunking, classify, context, html, metrics, vectors
from .registry import query, table

COUNT = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'))"
LINES = """lines AS (
    SELECT doc_id, i - 1 AS ordinal, trim(l[i]) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ordinal, text): each line of each document, as its sections."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.trim("text").alias("text"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS words, """ + COUNT.format("text") + r"""::BIGINT AS tokens,
    floor(length(text) / 4)::BIGINT AS estimate, md5(text) AS content_hash, substr(md5(source || '|' || lang || '|' || doc_id), 1, 16) AS chunk_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) < 50 AS is_stub FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select(
        "doc_id", T.word_count(t).alias("words"), T.token_count(t).alias("tokens"), T.token_estimate(F.lit(None).cast("bigint"), t).alias("estimate"), T.content_hash(t).alias("content_hash"),
        T.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("chunk_id"), (T.word_count(t) < T.STUB_WORDS).alias("is_stub"),
    )


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_md5, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::BIGINT AS n_sentences,
    len(regexp_extract_all(lower(text), '[a-z]+'))::BIGINT AS n_alpha, md5(source || chr(10) || '- ' || lang || chr(10) || text) AS embedding_md5 FROM documents""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select(
        "doc_id", F.md5(T.clean_text(t)).alias("clean_md5"), F.size(T.sentences(t)).cast("bigint").alias("n_sentences"), F.size(T.alpha_tokens(t)).cast("bigint").alias("n_alpha"),
        F.md5(T.embedding_text(F.col("source"), F.col("lang"), t)).alias("embedding_md5"),
    )


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * (x::DOUBLE))), 4) AS square, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * (x::DOUBLE)))), 6) AS first FROM embeddings""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(T.dot(v, v), 4).alias("square"), F.round(T.normalized(v)[0], 6).alias("first"))


@query("""SELECT conv_id, turn, md5(trim(regexp_replace('<think>' || role || chr(10) || '</think> ' || text || ' <THINK>x</THINK>', '<think>.*?</think>', '', 'gis'))) AS answer_md5 FROM conversations""")
def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<think>"), "role", F.lit("\n</think> "), "text", F.lit(" <THINK>x</THINK>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.strip_thinking(marked)).alias("answer_md5"))


@query("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, length(props)::BIGINT AS size FROM events""")
def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of an event, found again in a fenced block, inside prose, and plain."""
    p = F.col("props")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\n"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Result "), p, F.lit(" as asked"))).otherwise(p)
    found = T.json_object(wrapped)
    return table(spark, sf_dir, "events").select("event_id", F.map_values(F.from_json(found, "map<string,string>"))[0].alias("first_value"), F.length(found).cast("bigint").alias("size"))


@query("SELECT doc_id, lang || ',' || source AS labels, 2::BIGINT AS n FROM documents")
def json_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.json_labels(F.concat(F.lit('I pick ["'), "lang", F.lit('", "'), "source", F.lit('"] and [more]')))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("labels"), F.size(found).cast("bigint").alias("n"))


TAG_TEXT = "'[heading]' || source || '[/heading] ' || lang || ' [tip]' || doc_id || '[/tip] [note]open'"


@query(f"""SELECT doc_id, replace(replace({TAG_TEXT}, '[heading]' || source || '[/heading]', '§6§l' || source || '§r'), '[tip]' || doc_id || '[/tip]', '§a' || doc_id || '§r') AS coded,
    '<span style="color: #FFAA00">' || '</span><span style="color: #FFAA00; font-weight: bold">' || source || '</span> ' || lang || ' <span style="color: #55FF55">' || doc_id || '</span> [note]open' AS spans FROM documents""")
def tags_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("[heading]"), "source", F.lit("[/heading] "), "lang", F.lit(" [tip]"), F.col("doc_id").cast("string"), F.lit("[/tip] [note]open"))
    return table(spark, sf_dir, "documents").select("doc_id", T.expand_tags(text).alias("coded")).select("doc_id", "coded", T.format_spans(F.col("coded")).alias("spans"))


@query("""SELECT doc_id, 'chunks_' || translate('baai/bge-m3.' || source, '/-.', '___') AS collection, replace('baai/bge-m3/' || source, '/', '_') AS folder,
    replace(source || '_x', '_', ' ') AS description, regexp_matches(source, '(?i)edition\\b|\\b1\\.\\d+|\\b\\d{2}w\\d+[a-z]?|launcher|mojang|protocol|tracker') AS meta FROM documents""".replace("\\\\", "\\"))
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.collection_name(F.concat(F.lit("baai/bge-m3."), s)).alias("collection"), T.model_folder(F.concat(F.lit("baai/bge-m3/"), s)).alias("folder"),
        T.description_of(F.concat(s, F.lit("_x.webp"))).alias("description"), T.is_meta(s).alias("meta"),
    )


@query(f"""WITH {LINES}, c AS (SELECT *, {COUNT.format('text')}::BIGINT AS token_count FROM lines WHERE text <> '')
    SELECT doc_id, ordinal, token_count, substr(md5(doc_id || '|line|0'), 1, 16) AS chunk_id FROM c WHERE token_count BETWEEN 10 AND 512""")
def chunk_sections_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines are chunked; those that fit whole are returned, the pieces of the others are chunk_split_structured's matter."""
    sections = lines(spark, sf_dir).withColumns({"heading": F.lit("line"), "level": F.lit(2), "section_type": F.lit("content"), "whole": T.token_count(F.col("text"))})
    out = chunking.section_chunks(sections, "doc_id").where(F.col("whole") <= chunking.MAX_TOKENS)
    return out.select("doc_id", "ordinal", "token_count", "chunk_id")


def _tokens(sql: str) -> str:
    """Writes out TOKENS(x), the number of tokens of x, in SQL."""
    return re.sub(r"TOKENS\(((?:[^()]|\([^()]*\))*)\)", lambda m: COUNT.format(m[1]) + "::BIGINT", sql)


#: Sentences and list lines packed step by step: of each text a row a unit, that says what was sent out before it.
PACKED = _tokens(r"""WITH RECURSIVE whole AS (SELECT doc_id, trim(text) AS text, TOKENS(trim(text)) AS n FROM documents WHERE trim(text) <> ''),
 long_ AS (SELECT doc_id, text FROM whole WHERE n > 512),
 rows_ AS (SELECT doc_id, k, l[k] AS line, regexp_matches(l[k], '^\s*([-*]|\d+\.)\s+') AS is_list FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM long_), unnest(range(1, len(l) + 1)) AS r(k)),
 marked AS (SELECT *, CASE WHEN is_list = lag(is_list) OVER (PARTITION BY doc_id ORDER BY k) THEN 0 ELSE 1 END AS edge FROM rows_ WHERE is_list OR trim(line, ' ' || chr(9) || chr(13)) <> ''),
 numbered AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM marked),
 parts AS (
   SELECT doc_id, block, k AS pos, 0 AS nth, line AS unit, TRUE AS is_list FROM numbered WHERE is_list
   UNION ALL SELECT doc_id, block, pos, nth, trim(u[nth], ' ' || chr(9) || chr(10) || chr(13)), FALSE FROM (SELECT doc_id, block, min(k) AS pos, string_split(regexp_replace(string_agg(line, chr(10) ORDER BY k), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS u FROM numbered WHERE NOT is_list GROUP BY ALL), unnest(range(1, len(u) + 1)) AS r(nth)
 ), units AS (SELECT doc_id, unit, is_list, TOKENS(unit) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos, nth) AS i FROM parts WHERE is_list OR unit <> ''),
 summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS m FROM units),
 lapped AS (SELECT a.doc_id, a.i, count(b.i) AS back FROM summed a LEFT JOIN summed b ON b.doc_id = a.doc_id AND b.i < a.i AND NOT a.is_list AND a.upto - a.n - (b.upto - b.n) <= least(50, 512 - a.n) GROUP BY ALL),
 stepped AS (SELECT s.*, s.i - back AS carried FROM summed s JOIN lapped USING (doc_id, i)),
 walk AS (
   SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS start, 0::BIGINT AS base, 0::BIGINT AS first, 0::BIGINT AS last FROM long_
   UNION ALL SELECT doc_id, i, CASE WHEN n > 512 THEN i + 1 WHEN full_ THEN greatest(carried, start) ELSE start END, CASE WHEN n > 512 THEN upto WHEN full_ THEN carried_base ELSE base END, CASE WHEN full_ THEN start ELSE 0 END, i - 1
   FROM (SELECT w.doc_id, s.i, s.n, s.upto, w.start, w.base, s.carried, w.start < s.i AND (s.n > 512 OR s.upto - w.base > 512) AS full_,
       (SELECT max(z.upto - z.n) FROM stepped z WHERE z.doc_id = w.doc_id AND z.i = greatest(s.carried, w.start)) AS carried_base FROM walk w JOIN stepped s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
 ), words AS (SELECT doc_id, i, j, w[j] AS word, TOKENS(w[j]) AS n FROM (SELECT doc_id, i, string_split(unit, ' ') AS w FROM units WHERE n > 512), unnest(range(1, len(w) + 1)) AS r(j)),
 places AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, i ORDER BY j) AS upto FROM words),
 packs AS (
   SELECT doc_id, i, 0::BIGINT AS first, 0::BIGINT AS last, 0::BIGINT AS base, max(j) AS m FROM places GROUP BY ALL
   UNION ALL SELECT doc_id, i, first, last, (SELECT max(z.upto) FROM places z WHERE z.doc_id = q.doc_id AND z.i = q.i AND z.j = q.last), m
   FROM (SELECT p.doc_id, p.i, p.last + 1 AS first, p.m, (SELECT greatest(p.last + 1, coalesce(max(z.j), 0)) FROM places z WHERE z.doc_id = p.doc_id AND z.i = p.i AND z.upto - p.base <= 512) AS last FROM packs p WHERE p.last < p.m) q
 ), cuts AS (
   SELECT doc_id, first, last FROM walk WHERE first > 0
   UNION ALL SELECT doc_id, start, i FROM (SELECT * FROM walk w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) WHERE start <= i
 ), pieces AS (
   SELECT doc_id, last AS place, 0 AS nth, string_agg(unit, ' ' ORDER BY i) AS text FROM cuts JOIN (SELECT doc_id AS d, i, unit FROM units) ON d = doc_id AND i BETWEEN first AND last GROUP BY doc_id, first, last
   UNION ALL SELECT doc_id, i, first, string_agg(word, ' ' ORDER BY j) FROM packs JOIN (SELECT doc_id AS d, i AS u, j, word FROM words) ON d = doc_id AND u = i AND j BETWEEN first AND last WHERE first > 0 GROUP BY doc_id, i, first
 ), chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, nth) - 1 AS chunk_index, text FROM pieces
   UNION ALL SELECT doc_id, 0, text FROM whole WHERE n BETWEEN 10 AND 512)
SELECT doc_id, chunk_index::BIGINT AS chunk_index, substr(md5(doc_id || '|Introduction|' || chunk_index), 1, 16) AS chunk_id, TOKENS(text) AS token_count, md5(text) AS text_md5 FROM chunks""")
#: Runs of small lines, packed from piece to piece.
MERGED = _tokens(rf"""WITH RECURSIVE {LINES}, c AS (SELECT doc_id, ordinal, text, TOKENS(text) AS n FROM lines WHERE text <> ''),
 edges AS (SELECT *, CASE WHEN n < 50 AND lag(n) OVER w < 50 THEN 0 ELSE 1 END AS edge FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
 runs AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY ordinal) AS run FROM edges),
 small AS (SELECT *, row_number() OVER w AS j, sum(n) OVER w AS upto FROM runs WHERE n < 50 WINDOW w AS (PARTITION BY doc_id, run ORDER BY ordinal)),
 packs AS (
   SELECT doc_id, run, 0::BIGINT AS first, 0::BIGINT AS last, 0::BIGINT AS base, max(j) AS m FROM small GROUP BY ALL
   UNION ALL SELECT doc_id, run, first, last, (SELECT max(z.upto) FROM small z WHERE z.doc_id = q.doc_id AND z.run = q.run AND z.j = q.last), m
   FROM (SELECT p.doc_id, p.run, p.last + 1 AS first, p.m, (SELECT max(z.j) FROM small z WHERE z.doc_id = p.doc_id AND z.run = p.run AND z.upto - p.base <= 512) AS last FROM packs p WHERE p.last < p.m) q
 ), merged AS (
   SELECT p.doc_id, min(ordinal) AS ordinal, string_agg('line ' || ordinal, ' + ' ORDER BY ordinal) AS heading, sum(n)::BIGINT AS token_count, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text, TRUE AS small
   FROM packs p JOIN small s ON s.doc_id = p.doc_id AND s.run = p.run AND s.j BETWEEN p.first AND p.last WHERE p.first > 0 GROUP BY p.doc_id, p.run, p.first
   UNION ALL SELECT doc_id, ordinal, 'line ' || ordinal, n, text, FALSE FROM runs WHERE n >= 50
 ), lone AS (SELECT doc_id FROM c GROUP BY doc_id HAVING count(*) = 1),
 placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS place FROM merged)
 SELECT doc_id, place, heading, token_count, md5(text) AS text_md5, substr(md5(doc_id || '|' || heading || '|' || CASE WHEN small AND doc_id NOT IN (SELECT doc_id FROM lone) THEN place ELSE 0 END), 1, 16) AS chunk_id FROM placed""")


@query(PACKED)
def chunk_split_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.lit("Introduction").alias("heading"), F.lit(1).alias("level"), "text", F.lit("content").alias("section_type"))
    return chunking.section_chunks(sections, "doc_id").select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id", "token_count", F.md5("text").alias("text_md5"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.split_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", "recursive")
    return out.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query(MERGED)
def chunk_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where("text <> ''").withColumns({"heading": F.concat(F.lit("line "), F.col("ordinal").cast("string")), "token_count": T.token_count(F.col("text")), "chunk_type": F.lit("section")})
    rows = rows.withColumn("chunk_id", T.chunk_id(F.col("doc_id"), F.col("heading"), F.lit(0)))
    out = chunking.merge_small(rows, "doc_id")
    return out.select("doc_id", F.col("place").cast("bigint").alias("place"), "heading", "token_count", F.md5("text").alias("text_md5"), "chunk_id")


BULLETS = f"""WITH {LINES}, marked AS (SELECT doc_id, ordinal, CASE WHEN ordinal % 5 IN (2, 3) THEN '- ' || text ELSE text END AS line FROM lines),
    kinds AS (SELECT *, regexp_matches(line, '^\\s*[-*]\\s+') OR regexp_matches(line, '^\\s*\\d+\\.\\s+') AS is_list FROM marked WHERE line <> ''),
    edges AS (SELECT *, CASE WHEN is_list = lag(is_list) OVER w THEN 0 ELSE 1 END AS edge FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
    runs AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM edges)"""


@query(f"{BULLETS} SELECT doc_id, block, any_value(is_list) AS is_list, count(*) AS n_lines FROM runs GROUP BY doc_id, block")
def list_block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of list lines and of prose lines, by a running sum of changes."""
    from pyspark.sql import Window

    rows = lines(spark, sf_dir).withColumn("line", F.when((F.col("ordinal") % 5).isin(2, 3), F.concat(F.lit("- "), "text")).otherwise(F.col("text"))).where("line <> ''")
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = rows.withColumn("is_list", T.is_list_item(F.col("line")))
    edge = F.when(F.col("is_list") == F.lag("is_list").over(order), 0).otherwise(1)
    runs = rows.withColumn("edge", edge).withColumn("block", F.sum("edge").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "block").agg(F.first("is_list").alias("is_list"), F.count("*").alias("n_lines"))


HEADINGS = f"""{LINES}, heads AS (SELECT doc_id, ordinal, 2 + (length(text) % 3)::INT AS level, text AS heading FROM lines WHERE text <> '')"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ordinal, level, heading): lines as headings, their level by their length."""
    return lines(spark, sf_dir).where("text <> ''").select("doc_id", "ordinal", (F.length("text") % 3 + 2).alias("level"), F.col("text").alias("heading"))


@query(f"""WITH {HEADINGS}, up AS (
        SELECT a.doc_id, a.ordinal, a.level, a.heading, b.ordinal AS bo, b.heading AS bh
        FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.ordinal <= a.ordinal AND (b.ordinal = a.ordinal OR (b.level < a.level AND NOT EXISTS (
            SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.ordinal > b.ordinal AND c.ordinal <= a.ordinal AND c.level <= b.level)))
    ) SELECT doc_id, ordinal, level, string_agg(bh, ' > ' ORDER BY bo) AS path FROM up GROUP BY doc_id, ordinal, level""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.breadcrumbs(headings(spark, sf_dir), "doc_id")
    return out.select("doc_id", "ordinal", F.col("level").cast("int").alias("level"), "path")


@query(f"""WITH {HEADINGS}, named AS (SELECT *, CASE WHEN ordinal % 7 = 0 THEN 'History' WHEN ordinal % 7 = 3 THEN 'Upcoming' WHEN ordinal % 7 = 5 THEN 'See also' ELSE heading END AS name FROM heads),
    marks AS (SELECT *, CASE WHEN level = 2 THEN CASE WHEN regexp_matches(lower(name), 'history|legacy|past version') THEN 'history' WHEN regexp_matches(lower(name), 'future|upcoming|snapshot|preview|experimental') THEN 'future'
            WHEN lower(name) IN ('gallery', 'references', 'see also', 'external links') THEN 'navigation' ELSE 'content' END
        WHEN regexp_matches(lower(name), 'history|past|legacy') THEN 'history' WHEN regexp_matches(lower(name), 'future|upcoming') THEN 'future' END AS mark FROM named)
    SELECT doc_id, ordinal, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING), 'content') AS section_type FROM marks""")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the section type as the last mark set: second-level headings always set one, deeper ones may."""
    from pyspark.sql import Window

    rows = headings(spark, sf_dir)
    name = F.when(F.col("ordinal") % 7 == 0, "History").when(F.col("ordinal") % 7 == 3, "Upcoming").when(F.col("ordinal") % 7 == 5, "See also").otherwise(F.col("heading"))
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    mark = html.section_mark(F.col("level"), name)
    return rows.withColumn("mark", mark).select("doc_id", "ordinal", F.coalesce(F.last("mark", ignorenulls=True).over(order), F.lit("content")).alias("section_type"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back > 1 AND back <= 7""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.recent_history(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("""SELECT conv_id, turn, role FROM conversations JOIN (SELECT conv_id, max(turn) AS cut FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (conv_id) WHERE turn < cut""")
def regenerate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.regenerated(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 7)
    SELECT conv_id, count(*) FILTER (back > 1) + 2 AS n_messages, md5('system:S' || coalesce(string_agg('|' || role || ':' || text, '' ORDER BY turn) FILTER (back > 1), '') || '|user:Question: ' || any_value(text) FILTER (back = 1) || chr(10) || chr(10) || 'Sources:' || chr(10)) AS prompt_md5 FROM h GROUP BY conv_id""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    history = context.recent_history(c, "conv_id", "turn")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumn("context", F.lit(""))
    out = context.prompt(history, last, "conv_id", "turn", "S")
    spelt = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.md5(spelt).alias("prompt_md5"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): each user message with the next message, if the assistant's."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


ANSWERS = "answers AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


@query(rf"""WITH {ANSWERS}, sets AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(question), '\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(answer), '\s+'), lambda w: w <> '')) AS b FROM answers)
    SELECT conv_id, turn, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS token_f1 FROM sets""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_f1(F.col("question"), F.col("answer")), 6).alias("token_f1"))


@query(rf"""WITH {ANSWERS}, sets AS (SELECT conv_id, turn, question, answer, list_distinct(list_filter(string_split_regex(lower(question), '\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(answer), '\s+'), lambda w: w <> '')) AS b FROM answers),
    scored AS (SELECT turn, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS token_f1, length(question) // 4 AS prompt, length(answer) // 4 AS completion FROM sets)
    SELECT 'model-' || (turn % 3) AS model, count(*) AS n, round(avg(token_f1), 6) AS token_f1, round(avg(CASE WHEN turn % 5 <> 0 THEN token_f1 END), 6) AS faithfulness, count(token_f1) AS n_token_f1, count(CASE WHEN turn % 5 <> 0 THEN token_f1 END) AS n_faithfulness,
        sum(prompt)::BIGINT AS prompt_tokens, sum(CASE WHEN turn % 5 <> 0 THEN completion ELSE 0 END)::BIGINT AS completion_tokens FROM scored GROUP BY 1""")
def generator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, those of a metric that some answers lack, numbers of values and token sums of each model."""
    a = answers(spark, sf_dir)
    known = F.col("turn") % 5 != 0
    rows = a.select(
        F.concat(F.lit("model-"), (F.col("turn") % 3).cast("string")).alias("model"), F.round(metrics.token_f1(F.col("question"), F.col("answer")), 6).alias("token_f1"),
        F.floor(F.length("question") / 4).alias("prompt_tokens"), F.when(known, F.floor(F.length("answer") / 4)).alias("completion_tokens"), known.alias("known"),
    )
    return metrics.summary(rows.withColumn("faithfulness", F.when(F.col("known"), F.col("token_f1"))), ["model"], ["token_f1", "faithfulness"], ["prompt_tokens", "completion_tokens"])


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.rouge_l(answers(spark, sf_dir), ["conv_id", "turn"], "answer", "question")
    return out.select("conv_id", "turn", F.round("rouge_l", 6).alias("rouge_l"))


@query(f"""WITH {ANSWERS}, m AS (SELECT conv_id, turn, turn % 4 AS cited, length(answer) % 7 AS place, length(question) % 3 AS more FROM answers)
    SELECT conv_id, turn, CASE WHEN place BETWEEN 1 AND 5 THEN (cited + 1 = place OR more + 4 = place)::INT::DOUBLE END AS faithfulness FROM m""")
def citation_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers marked with two citations, against five titles of which one, or none, is the source page."""
    a = answers(spark, sf_dir)
    marked = F.concat("answer", F.lit(" ["), (F.col("turn") % 4 + 1).cast("string"), F.lit("] [Source "), (F.length("question") % 3 + 4).cast("string"), F.lit("]"))
    place = F.length("answer") % 7
    titles = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.when(i == place, "The Source Page").otherwise("Another"))
    # texts of the conversation may hold numbers in brackets: only the marks are scored
    only = F.regexp_extract(marked, r"( \[\d+\] \[Source \d+\])$", 1)
    return a.select("conv_id", "turn", metrics.citation_faithfulness(only, titles, F.lit("source page")).alias("faithfulness"))


@query(rf"""WITH {ANSWERS}, cut AS (
        SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS words,
            unnest(list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM answers
    ), best AS (
        SELECT conv_id, turn, arg_max(s, (n, -length(s), s)) AS s FROM (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')), words)) AS n FROM cut) GROUP BY ALL
    ) SELECT conv_id, turn, coalesce(s || ' [1]', '') AS answer FROM answers LEFT JOIN best USING (conv_id, turn)""")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("conv_id", "turn", "question", F.col("answer").alias("context"))
    return context.answered(rows).select("conv_id", "turn", "answer")


@query()
def hashing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.embedded(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.round(T.dot(F.col("embedding"), F.col("embedding")), 4).alias("square"), F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), ",")).alias("vector_md5"))


IMAGES = """images AS (
    SELECT doc_id, i AS nth, 'img_' || ((doc_id * 7 + i) % 50) || '.webp' AS local_filename, CASE WHEN (doc_id + i) % 3 = 0 THEN '' ELSE 'cap ' || lang || i END AS caption, CASE WHEN (doc_id + i) % 2 = 0 THEN '' ELSE 'alt ' || source END AS alt_text, substr(text, 1, 200) AS surrounding_text
    FROM documents, unnest(range(0, (doc_id % 4)::BIGINT)) AS r(i))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, nth, local_filename, caption, alt_text, surrounding_text): image rows derived from documents, up to three each."""
    n = (F.col("doc_id") % 4).cast("int")
    rows = table(spark, sf_dir, "documents").where("doc_id % 4 > 0").withColumn("nth", F.explode(F.sequence(F.lit(0), n - 1)))
    name = F.concat(F.lit("img_"), ((F.col("doc_id") * 7 + F.col("nth")) % 50).cast("string"), F.lit(".webp"))
    return rows.select(
        "doc_id", "nth", name.alias("local_filename"), F.when((F.col("doc_id") + F.col("nth")) % 3 == 0, "").otherwise(F.concat(F.lit("cap "), "lang", F.col("nth").cast("string"))).alias("caption"),
        F.when((F.col("doc_id") + F.col("nth")) % 2 == 0, "").otherwise(F.concat(F.lit("alt "), "source")).alias("alt_text"), F.substring("text", 1, 200).alias("surrounding_text"),
    )


def _context() -> Column:
    parts = F.filter(F.array(F.col("alt_text"), F.col("caption"), F.substring("surrounding_text", 1, 120)), lambda p: p != "")
    return F.array_join(parts, " ")


@query(f"""WITH {IMAGES}, c AS (SELECT *, list_aggregate(list_filter([alt_text, caption, substr(surrounding_text, 1, 120)], lambda p: p <> ''), 'string_agg', ' ') AS ctx FROM images),
    firsts AS (SELECT local_filename, ctx, min(doc_id * 10 + nth) AS seen FROM c GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY local_filename ORDER BY seen) AS n FROM firsts)
    SELECT local_filename, string_agg(ctx, ' | ' ORDER BY n) AS contexts FROM placed WHERE n <= 3 GROUP BY local_filename""")
def image_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three distinct contexts of each image."""
    from pyspark.sql import Window

    rows = images(spark, sf_dir).withColumn("ctx", _context()).groupBy("local_filename", "ctx").agg(F.min(F.col("doc_id") * 10 + F.col("nth")).alias("seen"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("local_filename").orderBy("seen"))).where("n <= 3")
    return placed.groupBy("local_filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ctx"))), lambda s: s["ctx"]), " | ").alias("contexts"))


@query(f"""WITH {IMAGES}, l AS (SELECT local_filename, doc_id * 10 + nth AS seen, coalesce(nullif(caption, ''), nullif(alt_text, ''), nullif(substr(surrounding_text, 1, 80), ''), replace(regexp_replace(local_filename, '\\.[^.]*$', ''), '_', ' ')) AS label FROM images)
    SELECT local_filename, arg_min(label, seen) AS label FROM l GROUP BY local_filename""")
def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.lit("")
    label = F.coalesce(F.nullif("caption", empty), F.nullif("alt_text", empty), F.nullif(F.substring("surrounding_text", 1, 80), empty), T.description_of(F.col("local_filename")))
    return images(spark, sf_dir).groupBy("local_filename").agg(F.min_by(label, F.col("doc_id") * 10 + F.col("nth")).alias("label"))


@query(f"""WITH {IMAGES} SELECT doc_id, string_agg(DISTINCT local_filename, ',' ORDER BY local_filename) AS files, count(DISTINCT local_filename) AS n FROM images JOIN (SELECT DISTINCT 'img_' || (label * 5) || '.webp' AS local_filename FROM embeddings) USING (local_filename) GROUP BY doc_id""")
def page_images_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's images that were fetched, by file name."""
    fetched = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("img_"), (F.col("label") * 5).cast("string"), F.lit(".webp")).alias("local_filename")).distinct()
    rows = images(spark, sf_dir).join(fetched, "local_filename").select("doc_id", "local_filename").distinct()
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("local_filename")), ",").alias("files"), F.count("*").alias("n"))


@query(f"WITH {IMAGES} SELECT count(DISTINCT doc_id) AS pages_with_images, count(*) AS refs, count(*) FILTER (caption <> '') AS with_caption, round(count(*) / count(DISTINCT doc_id), 6) AS mean_refs FROM images")
def image_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).agg(F.countDistinct("doc_id").alias("pages_with_images"), F.count("*").alias("refs"), F.count(F.when(F.col("caption") != "", 1)).alias("with_caption"), F.round(F.count("*") / F.countDistinct("doc_id"), 6).alias("mean_refs"))


@query("""WITH c AS (SELECT doc_id, list_distinct(list_filter(['Blocks', 'Stub', source, CASE WHEN lang = 'fr' THEN 'Items' ELSE 'Pages with x' END, CASE WHEN doc_id % 3 = 0 THEN 'Biomes' ELSE '' END], lambda x: x <> '' AND x <> 'Stub' AND NOT starts_with(x, 'Pages with') AND NOT (x = 'Blocks' AND doc_id % 2 = 0))) AS cats FROM documents)
    SELECT doc_id, len(cats)::BIGINT AS n_categories, CASE WHEN list_contains(cats, 'Blocks') THEN 'block' WHEN list_contains(cats, 'Items') THEN 'item' WHEN list_contains(cats, 'Biomes') THEN 'biome' ELSE 'other' END AS page_type FROM c""")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("doc_id", F.size("semantic_categories").cast("bigint").alias("n_categories"), "page_type")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(" Blocks "), F.lit("Stub"), F.col("source"), F.when(F.col("lang") == "fr", "Items").otherwise("Pages with x"), F.when(F.col("doc_id") % 3 == 0, "Biomes").otherwise("")
    )
    return classify.classified(table(spark, sf_dir, "documents").withColumn("raw_categories", raw), "raw_categories")


@query("SELECT CASE WHEN doc_id % 2 = 1 THEN 'block' WHEN lang = 'fr' THEN 'item' WHEN doc_id % 3 = 0 THEN 'biome' ELSE 'other' END AS page_type, count(*) AS n FROM documents GROUP BY 1")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.type_counts(classified(spark, sf_dir))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN p_size > 25 THEN 'large' ELSE 'other' END AS kind FROM part")
def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over another table: words of the type and a size class as categories."""
    cats = F.concat(F.split("p_type", " "), F.array(F.when(F.col("p_size") > 25, "size:large").otherwise("size:small")))
    kind = classify.page_type(F.transform(cats, lambda c: F.when(F.contains(c, F.lit("STEEL")), "STEEL").otherwise(c)), (("steel", ("STEEL",)), ("large", ("size:large",))))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


WIKI = "'/w/' || replace(source, 'src', 'Page_') || '_%C3%A9+x'"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE replace(source, 'src', 'Page ') || ' é+x' END AS title, 'https://wiki.example.org/w/' || replace(source, ' ', '_') AS url, lower(source || '/' || doc_id) AS path,
    regexp_replace(source, '[<>:"/\\\\|?*]', '_', 'g') || '_' || doc_id || '.html' AS file FROM documents""".replace("\\\\\\\\", "\\\\"))
def title_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, i = F.col("source"), F.col("doc_id").cast("string")
    href = F.concat(F.when(F.col("doc_id") % 5 == 0, "/w/File:").otherwise("/w/"), F.replace(s, F.lit("src"), F.lit("Page_")), F.lit("_%C3%A9+x#part?y"))
    page = F.concat(F.lit("https://wiki.example.org/w/"), s, F.lit("/"), i, F.lit("?a=b"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", U.href_to_title(href).alias("title"), U.title_to_url(s).alias("url"), U.normal_path(F.concat(F.lit("https://wiki.example.org/w/"), s, F.lit("/"), i)).alias("path"), U.path_to_filename(page).alias("file")
    )


@query("""SELECT doc_id, source || '_' || (doc_id % 9) || '.webp' AS file, 'https://wiki.example.org/images/a/' || source || '_' || (doc_id % 9) || '.png' AS original, doc_id % 4 = 0 AS decoration FROM documents""")
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("_"), (F.col("doc_id") % 9).cast("string"), F.lit(".png"))
    thumb = F.concat(F.lit("/images/thumb/a/"), name, F.lit("/300px-"), F.when(F.col("doc_id") % 4 == 0, "Sprite-").otherwise(""), name)
    url = U.absolute(thumb)
    return table(spark, sf_dir, "documents").select("doc_id", U.image_filename(F.concat(url, F.lit("?v=1"))).alias("file"), U.original_url(url).alias("original"), U.is_decoration(url).alias("decoration"))
