"""Registered queries: guards and validation of conversations, evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guards as G
from ..operators import lexical as L
from ..registry import query, table
from . import retrieval as V
from .retrieval import FULL, _top

PAIRS = "pr AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def _w(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> ''))"


def _t(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2))"


def _share(c: str, cls: str) -> str:
    return f"CASE WHEN length(replace({c}, ' ', '')) > 0 THEN len(regexp_extract_all({c}, '{cls}'))::DOUBLE / length(replace({c}, ' ', '')) ELSE 0 END"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({_t(a)}) > 0 THEN len(list_intersect({_t(a)}, {_t(b)}))::DOUBLE / len({_t(a)}) ELSE 0 END"


LATIN = _share("{c}", "[A-Za-zÀ-ÿ]")


def pairs(spark, d):
    return G.answer_pairs(table(spark, d, "conversations"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, md5(question) AS q, md5(answer) AS a FROM pr")
def turn_pairs(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query(f"WITH v AS (SELECT conv_id, turn, trim(text) = '' AS blank, {_w('text')} AS n, {_share('text', '[A-Za-z]')} AS s FROM conversations WHERE role = 'user') SELECT conv_id, turn, NOT blank AND n >= 3 AND s >= 0.25 AS passed, CASE WHEN NOT blank AND n >= 3 AND s >= 0.25 THEN 'ok' WHEN blank THEN 'empty' WHEN n < 3 THEN 'too_few_words' ELSE 'script' END AS reason FROM v")
def guard_query(spark, d):
    v = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", G.query_guard(F.col("text"), 3).alias("v"))
    return v.select("conv_id", "turn", "v.passed", "v.reason")


MM = "mm AS (SELECT query_id, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM t)), cg AS (SELECT query_id, count(*) FILTER (trim(text) <> '') AS f, avg(score) AS m, max(score) AS x FROM mm JOIN documents USING (doc_id) GROUP BY 1)"


def _contexts(spark, d):
    from ..operators.fusion import min_max

    hits = min_max(V.full_top(spark, d, 5)).select("query_id", "doc_id", F.col("norm").alias("score"))
    return G.context_guards(V.of_docs(spark, d, hits, "text"))


@query(f"WITH {FULL}, {_top('sc', 5, 't')}, {MM} SELECT query_id, f >= 1 AND m >= 0.1 AS passed, CASE WHEN f >= 1 AND m >= 0.1 THEN 'ok' WHEN f < 1 THEN 'no_chunks' ELSE 'low_mean' END AS reason FROM cg")
def guard_context(spark, d):
    return _contexts(spark, d).select("query_id", "context.passed", "context.reason")


@query(f"WITH {FULL}, {_top('sc', 5, 't')}, {MM} SELECT query_id, x >= 0.2 AS passed, CASE WHEN x >= 0.2 THEN 'ok' ELSE 'low_top' END AS reason FROM cg")
def guard_confidence(spark, d):
    return _contexts(spark, d).select("query_id", "confidence.passed", "confidence.reason")


@query(f"WITH {PAIRS} SELECT conv_id, turn, round({_overlap('answer', 'question')}, 6) AS overlap, trim(answer) = '' OR contains(lower(answer), 'no answer found') OR {_overlap('answer', 'question')} >= 0.1 AS passed FROM pr")
def guard_overlap(spark, d):
    a, q = F.col("answer"), F.col("question")
    return pairs(spark, d).select("conv_id", "turn", F.round(G.overlap(a, q), 6).alias("overlap"), G.overlap_guard(a, q)["passed"].alias("passed"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {LATIN.format(c='answer')} >= 0.4 AS passed FROM pr")
def guard_language(spark, d):
    return pairs(spark, d).select("conv_id", "turn", G.language_guard(F.col("answer"))["passed"].alias("passed"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN n < 5 THEN 'short' WHEN n > 800 THEN 'truncated' ELSE 'ok' END AS reason FROM (SELECT *, {_w('answer')} AS n FROM pr)")
def guard_length(spark, d):
    return pairs(spark, d).select("conv_id", "turn", G.length_guard(F.col("answer"))["reason"].alias("reason"))


@query(f"WITH {PAIRS}, v AS (SELECT conv_id, turn, CASE WHEN NOT (trim(question) <> '' AND {_w('question')} >= 1 AND {_share('question', '[A-Za-z]')} >= 0.25) THEN 'query' WHEN NOT (trim(answer) = '' OR contains(lower(answer), 'no answer found') OR {_overlap('answer', 'question')} >= 0.1) THEN 'overlap' WHEN NOT ({LATIN.format(c='answer')} >= 0.4) THEN 'language' WHEN NOT ({_w('answer')} BETWEEN 5 AND 800) THEN 'length' END AS failed FROM pr) SELECT coalesce(failed, 'none') AS failed, count(*) AS n FROM v GROUP BY 1")
def guard_pipeline(spark, d):
    q, a = F.col("question"), F.col("answer")
    v = F.array(G.query_guard(q), G.overlap_guard(a, q), G.language_guard(a), G.length_guard(a))
    failed = pairs(spark, d).select(G.first_failure(v).alias("v")).select(F.coalesce("v.guard", F.lit("none")).alias("failed"))
    return failed.groupBy("failed").agg(F.count("*").alias("n"))


VAL = rf"""v0 AS (SELECT conv_id, turn, answer, round({_overlap('answer', 'question')}, 6) AS g, round({LATIN.format(c='answer')}, 6) AS s, list_distinct(regexp_extract_all(answer, '[0-9]{{2,}}')) AS na, list_distinct(regexp_extract_all(question, '[0-9]{{2,}}')) AS ns, {_w('answer')} AS n, trim(answer) = '' AS blank FROM pr),
v1 AS (SELECT *, len(list_filter(na, lambda x: NOT list_contains(ns, x))) AS invented FROM v0), v2 AS (SELECT *, round(CASE WHEN len(na) > 0 THEN invented::DOUBLE / len(na) ELSE 0 END, 6) AS risk FROM v1),
vv AS (SELECT *, list_filter([CASE WHEN blank THEN 'EMPTY' END, CASE WHEN NOT blank AND g < 0.08 THEN 'UNGROUNDED' END, CASE WHEN NOT blank AND g BETWEEN 0.08 AND 0.16 THEN 'LOW_GROUNDEDNESS' END, CASE WHEN NOT blank AND s < 0.1 THEN 'WRONG_SCRIPT' END,
 CASE WHEN len(regexp_extract_all(answer, 'Ã.|â€')) >= 2 THEN 'MOJIBAKE' END, CASE WHEN risk > 0.4 AND invented >= 2 THEN 'NUMBER_RISK' END, CASE WHEN NOT blank AND n < 6 THEN 'WEAK' END, CASE WHEN n > 1000 THEN 'LONG' END], lambda x: x IS NOT NULL) AS codes FROM v2)"""


def validated(spark, d):
    return G.validate(pairs(spark, d), F.col("answer"), F.col("question"))


@query(f"WITH {PAIRS}, {VAL} SELECT conv_id, turn, g AS groundedness, s AS script, risk, n::INT AS n_words, array_to_string(codes, ',') AS codes, NOT list_has_any(codes, ['EMPTY', 'UNGROUNDED', 'WRONG_SCRIPT']) AS valid FROM vv")
def val_report(spark, d):
    return validated(spark, d).select("conv_id", "turn", "groundedness", "script", "risk", "n_words", F.array_join(F.transform("issues", lambda x: x.code), ",").alias("codes"), "valid")


@query(f"WITH {PAIRS}, {VAL} SELECT count(*) AS answers, count(*) FILTER (NOT list_has_any(codes, ['EMPTY', 'UNGROUNDED', 'WRONG_SCRIPT'])) AS valid, round(avg(g), 4) AS groundedness, round(avg(risk), 4) AS risk, sum(len(codes))::BIGINT AS issues FROM vv")
def val_batch_summary(spark, d):
    return validated(spark, d).agg(F.count("*").alias("answers"), F.count_if("valid").alias("valid"), F.round(F.avg("groundedness"), 4).alias("groundedness"), F.round(F.avg("risk"), 4).alias("risk"), F.sum(F.size("issues")).cast("long").alias("issues"))


@query(f"WITH {PAIRS}, {VAL} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM vv) GROUP BY 1")
def val_issue_counts(spark, d):
    return validated(spark, d).select(F.explode("issues").alias("x")).groupBy(F.col("x.code").alias("code")).agg(F.count("*").alias("n"))


# ---- evaluation --------------------------------------------------------------------------

TRUTH = r"""tl AS (SELECT item_id AS query_id, CASE WHEN regexp_matches(lower(text), '\b(und|der|die|sch)\b') THEN 'de' WHEN regexp_matches(lower(text), '\b(et|les|le)\b') THEN 'fr' WHEN regexp_matches(lower(text), '\b(los|las|el)\b') THEN 'es' ELSE 'en' END AS wanted FROM benchmark)"""
EVAL = "ev AS (SELECT tl.query_id, min(CASE WHEN lang = wanted THEN rank END) AS fr, avg(CASE WHEN rank IS NOT NULL THEN (lang = wanted)::INT::DOUBLE END) AS p FROM tl LEFT JOIN (SELECT t.*, lang FROM t JOIN documents USING (doc_id)) h ON h.query_id = tl.query_id GROUP BY 1)"


def _evaluated(spark, d):
    t = F.lower("text")
    wanted = F.when(t.rlike(r"\b(und|der|die|sch)\b"), "de").when(t.rlike(r"\b(et|les|le)\b"), "fr").when(t.rlike(r"\b(los|las|el)\b"), "es").otherwise("en")
    truth = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), wanted.alias("wanted"))
    hits = V.of_docs(spark, d, V.full_top(spark, d, 5), F.col("lang").alias("label"))
    return G.evaluate(hits, truth)


@query(f"WITH {FULL}, {_top('sc', 5, 't')}, {TRUTH}, {EVAL} SELECT query_id, fr AS first_rank, round(coalesce(1 / fr::DOUBLE, 0), 6) AS reciprocal_rank, round(coalesce(p, 0), 6) AS precision FROM ev")
def eval_queries(spark, d):
    return _evaluated(spark, d).select("query_id", F.col("first_rank").cast("long").alias("first_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("precision", 6).alias("precision"))


@query(f"WITH {FULL}, {_top('sc', 5, 't')}, {TRUTH}, {EVAL} SELECT count(*) AS queries, round(avg(coalesce(1 / fr::DOUBLE, 0)), 6) AS mrr, round(avg(coalesce(p, 0)), 6) AS precision, count(*) FILTER (fr IS NULL) AS missed FROM ev")
def eval_summary(spark, d):
    return _evaluated(spark, d).agg(F.count("*").alias("queries"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("precision"), 6).alias("precision"), F.count_if(F.col("first_rank").isNull()).alias("missed"))


@query(rf"""WITH {FULL}, {_top('sc', 5, 't')}, kw AS (SELECT item_id AS query_id, unnest(list_filter(ws, lambda x, i: list_position(ws, x) = i AND i <= 100)[1:5]) AS keyword FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 5) AS ws FROM benchmark)),
k1 AS (SELECT query_id, keyword, max(contains(lower(text), keyword)::INT) AS hit FROM t JOIN documents USING (doc_id) JOIN kw USING (query_id) GROUP BY 1, 2) SELECT query_id, count(*) AS n_keywords, sum(hit)::BIGINT AS n_found, round(avg(hit), 6) AS coverage FROM k1 GROUP BY 1""")
def eval_keyword_hits(spark, d):
    kw = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.ordered_unique(T.tokens(F.col("text"), 5), 5)).alias("keyword"))
    hits = V.of_docs(spark, d, V.full_top(spark, d, 5), "text")
    return G.keyword_hits(hits, kw, F.col("text"))
