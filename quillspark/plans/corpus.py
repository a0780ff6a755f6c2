"""Registered queries: text functions, ids, records, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import profile as P
from ..operators import records as R
from ..registry import query, table

Q = r"trim(regexp_extract(text, '^[^.!?\n]*[.!?]?', 0))"
A = r"trim(substr(text, length(regexp_extract(text, '^[^.!?\n]*[.!?]?', 0)) + 1))"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 2)"
RECORDS = f"""rec0 AS (SELECT doc_id, {Q} AS question, {A} AS answer, coalesce(trim(lang), '') AS lang, coalesce(trim(source), '') AS folder FROM documents),
rec AS (SELECT sha256(concat_ws('::', folder, doc_id::VARCHAR, substr(question, 1, 40)))[1:16] AS id, doc_id, question, answer,
        coalesce(nullif(lang, ''), folder) AS category, folder, 'Q: ' || question || ' A: ' || answer AS text
        FROM rec0 WHERE NOT (question = '' AND answer = ''))"""


@query(rf"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, array_to_string(list_slice({TOKENS}, 1, 8), ' ') AS head FROM documents")
def text_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.slice(t, 1, 8), " ").alias("head"))


@query(rf"""SELECT doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 18), ' ') AS keywords FROM (
  SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (
  SELECT doc_id, list_filter({TOKENS}, lambda x: length(x) >= 3 AND x NOT IN {T.STOP_WORDS!r}) AS t FROM documents))""")
def text_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.ordered_unique(T.tokens(F.col("text"), 3, T.STOP_WORDS), 18), " ").alias("keywords"))


@query(r"SELECT doc_id, round(CASE WHEN length(replace(text, ' ', '')) > 0 THEN len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / length(replace(text, ' ', '')) ELSE 0 END, 6) AS latin_share, round(CASE WHEN length(replace(text, ' ', '')) > 0 THEN len(regexp_extract_all(text, '[؀-ۿ]'))::DOUBLE / length(replace(text, ' ', '')) ELSE 0 END, 6) AS arabic_share FROM documents")
def text_script_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.share_of(F.col("text"), "[A-Za-z]"), 6).alias("latin_share"), F.round(T.share_of(F.col("text"), T.ARABIC), 6).alias("arabic_share"))


@query(rf"SELECT doc_id, floor(len({WORDS}) * 1.3)::BIGINT AS by_words, greatest(1, length(text) // 4)::BIGINT AS by_chars FROM documents")
def text_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("by_words"), T.char_estimate(F.col("text")).alias("by_chars"))


@query(rf"SELECT CASE WHEN e < 10 THEN 'too_short' WHEN e >= 500 THEN 'long' ELSE 'normal' END AS length_class, count(*) AS n FROM (SELECT floor(len({WORDS}) * 1.3) AS e FROM documents) GROUP BY 1")
def text_length_class(spark, d):
    return table(spark, d, "documents").groupBy(T.length_class(T.token_estimate(F.col("text"))).alias("length_class")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(s[1], '') AS first_sentence FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def text_sentences(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first_sentence"))


@query(rf"""SELECT doc_id, i::BIGINT AS window_index, md5(array_to_string(list_slice(w, i * 346 + 1, i * 346 + 384), ' ')) AS window_md5 FROM (
  SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - 38) / 346.0))::BIGINT)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)""")
def text_windows(spark, d):
    w = T.sliding_windows(T.words(F.col("text")), 384, 38)
    return table(spark, d, "documents").select("doc_id", F.posexplode_outer(w).alias("i", "w")).where("w is not null").select("doc_id", F.col("i").cast("long").alias("window_index"), F.md5("w").alias("window_md5"))


@query(r"SELECT doc_id, md5(translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩')) AS eastern, md5(text) AS western FROM documents")
def text_digits(spark, d):
    east = F.translate("text", "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return table(spark, d, "documents").select("doc_id", F.md5(east).alias("eastern"), F.md5(T.western_digits(east)).alias("western"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{3,}'))::BIGINT AS latin_words, len(regexp_extract_all(text, 'Ã.|â€'))::BIGINT AS mojibake, len(regexp_extract_all(text, '[0-9]{2,}'))::BIGINT AS numbers FROM documents")
def text_patterns(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n("[A-Za-z]{3,}").alias("latin_words"), n("Ã.|â€").alias("mojibake"), n("[0-9]{2,}").alias("numbers"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[^\p{L}\p{N}\p{M}\s!؟?.,،؛;:\-()\[\]"''۔]', ' ', 'g'), '[\x{064B}-\x{065F}\x{0670}]', '', 'g'), '([!?.,;:])[!?.,;:]+', '\1', 'g'), '\s+', ' ', 'g'))) AS normal_md5 FROM documents""")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise(T.composed(F.col("text")))).alias("normal_md5"))


@query(r"""SELECT doc_id, length(w)::BIGINT AS kept_chars, md5(w) AS cut_md5 FROM (SELECT doc_id, CASE WHEN len(ws) <= 60 THEN text WHEN h <> '' THEN h ELSE head || ' …' END AS w FROM (
 SELECT *, regexp_extract(head, '(?s)^(.*[.!?])', 1) AS h FROM (SELECT doc_id, text, ws, array_to_string(list_slice(ws, 1, 60), ' ') AS head FROM (SELECT doc_id, text, """ + WORDS + r""" AS ws FROM documents))))""")
def text_truncate(spark, d):
    t = T.truncate_words(F.col("text"), 60)
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("kept_chars"), F.md5(t).alias("cut_md5"))


@query(f"WITH {RECORDS} SELECT doc_id, id AS record_id FROM rec")
def id_sha256(spark, d):
    return R.unified(table(spark, d, "documents")).select("doc_id", F.col("id").alias("record_id"))


@query("SELECT doc_id, concat_ws('__', lang, source, doc_id::VARCHAR) AS composite FROM documents")
def id_composite(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("__", "lang", "source", F.col("doc_id").cast("string")).alias("composite"))


@query(r"SELECT item_id, sha1(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')))[1:24] AS cache_key FROM benchmark")
def cache_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.cache_key(F.col("text")).alias("cache_key"))


@query(rf"""SELECT term, list_reduce([2166136261::BIGINT] || list_transform(range(1, octet_length(encode(term)) + 1), lambda i: ('0x' || hex(encode(term))[2*i-1:2*i])::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295) & 2147483647 AS hash
FROM (SELECT DISTINCT unnest({TOKENS}) AS term FROM benchmark)""")
def fnv_tokens(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.fnv1a(F.col("term")).alias("hash"))


@query(f"WITH {RECORDS} SELECT id, doc_id, category, folder, md5(question) AS q, md5(answer) AS a, md5(text) AS t FROM rec")
def unified_records(spark, d):
    r = R.unified(table(spark, d, "documents"))
    return r.select("id", "doc_id", "category", "folder", F.md5("question").alias("q"), F.md5("answer").alias("a"), F.md5("text").alias("t"))


@query(f"WITH {RECORDS} SELECT doc_id, md5(CASE WHEN question <> '' THEN question ELSE substr(answer, 1, 1500) END) AS e, md5(concat_ws(chr(10), nullif(question, ''), nullif(answer, ''))) AS i FROM rec")
def embedding_and_index_text(spark, d):
    r, q, a = R.unified(table(spark, d, "documents")), F.col("question"), F.col("answer")
    return r.select("doc_id", F.md5(R.embedding_text(q, a)).alias("e"), F.md5(R.index_text(q, a)).alias("i"))


@query(f"SELECT count(*) AS kept FROM (SELECT {Q} AS q, {A} AS a FROM documents) WHERE NOT (q = '' AND a = '')")
def drop_empty(spark, d):
    return R.unified(table(spark, d, "documents")).agg(F.count("*").alias("kept"))


@query(rf"SELECT doc_id FROM documents WHERE floor(len({WORDS}) * 1.3) >= 10")
def too_short_filter(spark, d):
    return table(spark, d, "documents").where(T.token_estimate(F.col("text")) >= 10).select("doc_id")


@query("SELECT batch_id, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch_id FROM documents) GROUP BY 1")
def batch_assignment(spark, d):
    b = R.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 100)
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def checkpoint_pending(spark, d):
    return R.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT e AS expected, i AS indexed, e - i AS missing, round(100.0 * i / e, 2) AS percent, round(100.0 * i / e, 2) >= 99.9 AS complete FROM (SELECT count(DISTINCT d.doc_id) AS e, count(DISTINCT l.doc_id) AS i FROM documents d LEFT JOIN labels l USING (doc_id))")
def index_coverage(spark, d):
    return R.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT count(DISTINCT CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS upserted, count(l.doc_id) AS skipped, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def batch_counters(spark, d):
    return R.upsert(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")[1]


@query(f"WITH {RECORDS} SELECT id, md5(substr(question, 1, 2000)) AS q, md5(substr(answer, 1, 2000)) AS a, coalesce(nullif(category, ''), 'GENERAL') AS category, folder FROM rec")
def metadata_projection(spark, d):
    m = R.metadata(R.unified(table(spark, d, "documents")))
    return m.select("id", F.md5("question").alias("q"), F.md5("answer").alias("a"), "category", "folder")


TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}
CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {k} AS row_key, '{c}' AS column_name, {n} AS ordinal, {c}::VARCHAR AS value FROM {t}"
    for t, k, cols in (("documents", "doc_id", ["doc_id", "text", "lang", "source", "n_chars"]), ("conversations", "conv_id", ["conv_id", "turn", "role", "text"]), ("pages", "page_id", ["page_id", "url", "html"]))
    for n, c in enumerate(cols)) + ")"
SAMPLE = "smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY row_key, value) AS r FROM cells WHERE trim(value) <> '') WHERE r <= {n})"


def _cells(spark, d):
    return P.union_cells([P.melt(table(spark, d, t), k, t) for t, k in TABLES.items()])


@query(f"""WITH {CELLS}, f AS (SELECT table_name, column_name, trim(value) AS value, min(row_key) AS row_key FROM cells WHERE trim(value) <> '' GROUP BY 1, 2, 3),
 s AS (SELECT table_name, column_name, string_agg(substr(value, 1, 120), ' | ' ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY row_key, value) AS r FROM f) WHERE r <= 3 GROUP BY 1, 2)
 SELECT c.table_name, c.column_name, round(avg(CASE WHEN value IS NULL OR trim(value) = '' THEN 1.0 ELSE 0.0 END), 4) AS null_ratio, count(DISTINCT CASE WHEN trim(value) <> '' THEN value END) AS distinct_values, coalesce(any_value(samples), '') AS samples
 FROM cells c LEFT JOIN s USING (table_name, column_name) GROUP BY 1, 2""")
def profile_columns(spark, d):
    return P.profile(_cells(spark, d))


LATIN = "CASE WHEN length(replace(value, ' ', '')) > 0 THEN len(regexp_extract_all(value, '[؀-ۿ]'))::DOUBLE / length(replace(value, ' ', '')) ELSE 0 END"


@query(f"WITH {CELLS}, {SAMPLE.format(n=20)} SELECT table_name, column_name, CASE WHEN s >= .7 THEN 'urdu' WHEN s >= .2 THEN 'mixed' ELSE 'latin' END AS language FROM (SELECT table_name, column_name, avg(CASE WHEN {LATIN} >= .3 THEN 1.0 ELSE 0 END) AS s FROM smp GROUP BY 1, 2)")
def profile_language(spark, d):
    return P.column_language(P.sample_values(_cells(spark, d), 20))


def _columns(spark, d):
    return P.columns_of({t: table(spark, d, t) for t in TABLES})


COLS = "cols AS (SELECT DISTINCT table_name, column_name, ordinal FROM cells)"


@query(f"WITH {CELLS}, {COLS} SELECT lower(trim(column_name)) AS column_key, count(DISTINCT table_name) AS tables, count(DISTINCT table_name) = 3 AS common, 3 - count(DISTINCT table_name) AS missing_in, count(DISTINCT column_name) AS spellings FROM cols GROUP BY 1")
def profile_summary(spark, d):
    return P.summary(_columns(spark, d))


ROLES = "roles AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{p}', {w}::DOUBLE)" for r, p, w in P.ROLE_NAMES) + ") t(role, pattern, weight))"
NAMES = "nm AS (SELECT table_name, column_name, ordinal, role, max(CASE WHEN regexp_matches(lower(trim(column_name)), pattern) THEN weight ELSE 0 END) AS name_score FROM cols, roles GROUP BY ALL)"


@query(f"WITH {CELLS}, {COLS}, {ROLES}, {NAMES} SELECT table_name, column_name, role, name_score FROM nm")
def role_name_score(spark, d):
    return P.name_scores(_columns(spark, d)).drop("ordinal")


CONTENT = f"""st AS (SELECT table_name, column_name, avg({LATIN}) AS u, avg(length(value)) AS l, avg(CASE WHEN regexp_matches(value, '[?؟]\\s*$') THEN 1.0 ELSE 0 END) AS ask,
 avg(CASE WHEN regexp_matches(value, '^https?://|^www\\.') THEN 1.0 ELSE 0 END) AS url, avg(CASE WHEN regexp_matches(value, '^https?://|^www\\.') OR regexp_matches(value, '^[A-Za-z0-9_\\-./]+$') THEN 1.0 ELSE 0 END) AS ident,
 avg(CASE WHEN regexp_matches(value, '[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}') THEN 1.0 ELSE 0 END) AS dt, count(DISTINCT value) AS uniq FROM smp GROUP BY 1, 2),
ct AS (SELECT table_name, column_name, unnest(['question', 'answer', 'category', 'date', 'reference']) AS role, unnest([
 0.4 * least(u / 0.5, 1) + 0.3 * CASE WHEN l BETWEEN 30 AND 400 THEN 1 ELSE greatest(0, 1 - abs(l - 200) / 500) END + 0.3 * ask,
 0.5 * least(u / 0.5, 1) + 0.5 * CASE WHEN l >= 100 THEN 1 ELSE l / 100 END,
 0.5 * CASE WHEN l <= 30 THEN 1 ELSE greatest(0, 1 - (l - 30) / 100) END + 0.5 * CASE WHEN uniq <= 20 THEN 1 ELSE greatest(0, 1 - (uniq - 20) / 80) END,
 dt + 0.1, 0.6 * url + 0.4 * ident]::DOUBLE[]) AS s FROM st),
cs AS (SELECT table_name, column_name, role, least(1, s) AS content_score FROM ct)"""


@query(f"WITH {CELLS}, {SAMPLE.format(n=3)}, {CONTENT} SELECT table_name, column_name, role, round(content_score, 6) AS content_score FROM cs")
def role_content_score(spark, d):
    c = P.content_scores(P.sample_values(_cells(spark, d), 3))
    return c.withColumn("content_score", F.round("content_score", 6))


@query(f"""WITH {CELLS}, {SAMPLE.format(n=3)}, {CONTENT}, {COLS}, {ROLES}, {NAMES}, b AS (SELECT *, row_number() OVER (PARTITION BY table_name, role ORDER BY confidence DESC, ordinal) AS r FROM (
 SELECT nm.*, round(0.65 * name_score + 0.35 * coalesce(content_score, 0), 4) AS confidence FROM nm LEFT JOIN cs USING (table_name, column_name, role)))
 SELECT table_name, role, CASE WHEN confidence >= 0.25 THEN column_name END AS column_name, confidence FROM b WHERE r = 1""")
def role_mapping(spark, d):
    return P.role_mapping(P.name_scores(_columns(spark, d)), P.content_scores(P.sample_values(_cells(spark, d), 3)))


@query(rf"""SELECT count(*) AS records, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank, count(*) FILTER (regexp_matches(text, '�')) AS replacement_chars, count(*) FILTER (regexp_matches(text, '[\x00-\x08]')) AS control_chars,
 count(*) FILTER (regexp_matches(text, 'Ã.|â€')) AS mojibake, count(*) FILTER (length(text) < 40) AS short, count(*) FILTER (regexp_matches(text, '<[a-zA-Z/]')) AS markup, round(avg(len({WORDS})), 4) AS avg_words,
 round(avg(CASE WHEN length(replace(text, ' ', '')) > 0 THEN len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / length(replace(text, ' ', '')) ELSE 0 END), 4) AS avg_latin FROM documents""")
def integrity_stats(spark, d):
    return P.integrity(table(spark, d, "documents"), F.col("text"))
