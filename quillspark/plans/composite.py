"""Registered queries: whole retrieval paths, dispatch by group, reranking, retrieval-augmented answers, tree descent."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import citations as S
from ..operators import composites as M
from ..operators import dense as D
from ..operators import fusion as U
from ..operators import gates as G
from ..operators import guards as N
from ..operators import lexical as L
from ..operators import tree as X
from ..registry import query, table
from ..sources.sinks import written
from . import retrieval as V
from .content import LEVELS, NAV, NTERMS, TRIM
from .corpus import A, Q, TOKENS
from .retrieval import ANCH, CKEY, DEDUPED, FAST, FIELDS, FILTER, FULL, HYBRID, LANG_WORDS, MARKS, QUEST, STOPPED, WQ, _mm, _top


def _docs(spark, d):
    return table(spark, d, "documents")


def _bench(spark, d):
    return table(spark, d, "benchmark")


PKEY = f"sha1(substr({Q}, 1, 200) || '|' || substr({A}, 1, 400))"
GRP = "gr AS (SELECT DISTINCT source, 'g' || (substr(source, 4)::INT % 3) AS grp FROM documents), wn AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'g' || (item_id % 3) END AS wanted FROM benchmark)"
PATH = f"""{FAST}, p0 AS (SELECT query_id, doc_id, score, source FROM (SELECT fc.*, source, row_number() OVER (PARTITION BY query_id, {PKEY} ORDER BY score DESC, doc_id) AS r FROM fc JOIN documents USING (doc_id)) WHERE r = 1), {GRP},
p1 AS (SELECT query_id, doc_id, score FROM p0 LEFT JOIN gr USING (source) LEFT JOIN wn USING (query_id) WHERE wanted IS NULL OR grp = wanted), {_top("p1", 30, "fr")}, {ANCH}, {FILTER},
g0 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM af), g1 AS (SELECT * FROM g0 WHERE score >= 1.5 AND (rank = 1 OR score >= 0.55 * best)),
g2 AS (SELECT * FROM (SELECT *, max(aq) OVER (PARTITION BY query_id) AS ba FROM g1) WHERE ba < 2 OR aq >= greatest(1, ceil(ba * 0.5))),
g3 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY aq DESC, score DESC, doc_id) AS rank FROM g2), {MARKS},
g4 AS (SELECT query_id, doc_id, mode, mark, row_number() OVER (PARTITION BY query_id ORDER BY mark DESC, score DESC, doc_id) AS rank FROM g3 JOIN mk USING (doc_id) WHERE rank <= 12 AND mark >= 0.75)"""


def _path(spark, d):
    docs, bench = _docs(spark, d), _bench(spark, d)
    grp = docs.select("source", F.concat(F.lit("g"), (F.substring("source", 4, 9).cast("int") % 3).cast("string")).alias("grp")).distinct()
    wanted = bench.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string"))).alias("wanted"))
    combined = written(V.fast(spark, d), "fast")
    texts = V.hit_texts(spark, d, combined, "text", "source")
    return M.fast_retrieve(combined, texts, bench, "item_id", F.col("text"), grp, wanted, V.marks(spark, d), cut=lambda df: written(df, "fast"))


@query(f"WITH {PATH} SELECT query_id, doc_id, mode, mark, rank FROM g4 WHERE rank <= 6")
def fast_path(spark, d):
    return _path(spark, d)[0].select("query_id", "doc_id", "mode", "mark", "rank")


@query(f"WITH {PATH} SELECT item_id AS query_id, CASE WHEN item_id NOT IN (SELECT query_id FROM fc) THEN 'empty_query' WHEN item_id NOT IN (SELECT query_id FROM p1) THEN 'group_filter_empty' WHEN item_id NOT IN (SELECT query_id FROM af) THEN 'rare_anchor_miss' WHEN item_id NOT IN (SELECT query_id FROM g1) THEN 'top_score_below_floor' WHEN item_id NOT IN (SELECT query_id FROM g4) THEN 'rerank_threshold_miss' ELSE 'ok' END AS reason FROM benchmark")
def fast_path_reasons(spark, d):
    return _path(spark, d)[1]


WANTED = r"wl AS (SELECT item_id AS query_id, CASE " + " ".join(f"WHEN {'contains(lower(text), ' + repr(w) + ')' if ' ' in w else 'list_contains(ts, ' + repr(w) + ')'} THEN '{g}'" for g, w in LANG_WORDS) + r" END AS wanted FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM benchmark))"


def _lang(spark, d):
    return _docs(spark, d).select("doc_id", F.col("lang").alias("grp"))


@query(f"WITH {FULL}, {_top('sc', 200, 'p')}, {WANTED}, x AS (SELECT p.query_id, doc_id, score, lang AS grp, wanted FROM p JOIN documents USING (doc_id) LEFT JOIN wl USING (query_id) WHERE wanted IS NULL OR lang = wanted), {_top('x', 5, 't')} SELECT query_id, doc_id, grp, coalesce(wanted, 'all') AS wanted, rank FROM t")
def group_dispatch(spark, d):
    wanted = G.detect_group(_bench(spark, d), "item_id", F.col("text"), LANG_WORDS).withColumnRenamed("grp", "wanted")
    done = M.dispatch(V.full_top(spark, d, 200).drop("rank"), _lang(spark, d), wanted, 5)
    return done.select("query_id", "doc_id", "grp", F.coalesce("wanted", F.lit("all")).alias("wanted"), "rank")


@query(f"WITH {FULL}, {_top('sc', 200, 'p')}, x AS (SELECT query_id, lang AS grp, doc_id, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS rank FROM p JOIN documents USING (doc_id)) SELECT query_id, grp, doc_id, rank FROM x WHERE rank <= 3")
def all_groups(spark, d):
    return M.by_group(V.full_top(spark, d, 200).drop("rank"), _lang(spark, d), 3).select("query_id", "grp", "doc_id", "rank")


@query(f"""WITH {FIELDS}, {WQ}, x AS (SELECT query_id, lang AS grp, doc_id, percent, row_number() OVER (PARTITION BY query_id, lang ORDER BY percent DESC, doc_id) AS r FROM wp JOIN documents USING (doc_id))
SELECT item_id AS query_id, g.grp, doc_id, coalesce(percent, 0) AS percent, CASE WHEN doc_id IS NULL THEN 0 ELSE greatest(30, 95 - 15 * (r - 1)) END::INT AS relevance FROM benchmark CROSS JOIN (SELECT DISTINCT lang AS grp FROM documents) g LEFT JOIN (SELECT * FROM x WHERE r <= 4) y ON y.query_id = item_id AND y.grp = g.grp""")
def per_group_search(spark, d):
    best = M.by_group(V.weighted(spark, d).withColumn("score", F.col("percent")), _lang(spark, d), 4)
    # every query has a card of every group: as many rows as the answer itself has
    every = _bench(spark, d).select(F.col("item_id").alias("query_id")).crossJoin(F.broadcast(_lang(spark, d).select("grp").distinct()))
    rows = every.join(best, ["query_id", "grp"], "left")
    relevance = F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.lit(30), 95 - 15 * (F.col("rank") - 1)))
    return rows.select("query_id", "grp", "doc_id", F.coalesce("score", F.lit(0)).alias("percent"), relevance.cast("int").alias("relevance"))


MARKED = rf"""q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2)) AS qw FROM benchmark),
om AS (SELECT t.query_id, doc_id, score, CASE WHEN len(qw) > 0 THEN round(len(list_intersect(qw, list_distinct(list_filter(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2))))::DOUBLE / len(qw), 6) ELSE 0 END AS mark FROM t JOIN q USING (query_id) JOIN documents d USING (doc_id))"""


@query(f"WITH {FULL}, {_top('sc', 12, 't')}, {MARKED}, r AS (SELECT query_id, doc_id, mark, row_number() OVER (PARTITION BY query_id ORDER BY mark DESC, score DESC, doc_id) AS rank FROM om WHERE mark >= 0.2) SELECT query_id, doc_id, mark, rank FROM r WHERE rank <= 5")
def rerank_listwise(spark, d):
    from ..operators.plugins import overlap_mark

    hits = V.full_top(spark, d, 12)
    asked = _bench(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    marks = V.of_docs(spark, d, hits.select("query_id", "doc_id"), "text").join(asked, "query_id").select("query_id", "doc_id", overlap_mark(F.col("query"), F.col("text")).alias("mark"))
    return M.reranked(hits, marks, 12, 5, 0.2).select("query_id", "doc_id", "mark", "rank")


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')}, {_mm('fr', 'nm')}, {MARKS}, j AS (SELECT query_id, doc_id, round(norm, 6) AS score, mark, coalesce(mark >= 0.42, false) AS o FROM nm LEFT JOIN mk USING (doc_id)), a AS (SELECT *, max(o::INT) OVER (PARTITION BY query_id) = 1 AS any_o FROM j), x AS (SELECT query_id, doc_id, any_o AS reranked, CASE WHEN any_o THEN round(0.45::DOUBLE * score + (1 - 0.45::DOUBLE) * coalesce(mark, 0), 6) ELSE score END AS score FROM a WHERE o OR NOT any_o), {_top('x', 5, 't')} SELECT query_id, doc_id, score, reranked, rank FROM t")
def legacy_rerank(spark, d):
    rows = U.min_max(L.top(V.fast(spark, d), 30)).select("query_id", "doc_id", F.round("norm", 6).alias("score"))
    return M.legacy_rerank(rows, V.marks(spark, d), 5).select("query_id", "doc_id", "score", "reranked", "rank")


# ---- dense leg of the documents' own vectors ---------------------------------------------

DOCVEC = f"""dv AS (SELECT b.item_id AS query_id, d.doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings v ON true JOIN documents d ON d.doc_id = v.vec_id),
{_top('dv', 30, 'dt')}, dl1 AS (SELECT query_id, doc_id, score FROM dt WHERE score >= 0.18)"""
TRUE_HYBRID = HYBRID[: HYBRID.index(f"{FIELDS}")] + DOCVEC + HYBRID[HYBRID.index(f", {_top('sc', 30, 's1')}") :]


def _dense(spark, d):
    vectors = table(spark, d, "embeddings").join(_docs(spark, d).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = table(spark, d, "embeddings").join(_bench(spark, d).select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return D.search(vectors, asked, 30, floor=0.18, own=True)


def _hybrid(spark, d, k):
    rows = U.weighted(written(_dense(spark, d), "dense"), V.full_top(spark, d, 30), V.question_top(spark, d, 30)).select("query_id", "doc_id", "score")
    rows = V.of_docs(spark, d, written(rows, "hybrid"), "text")
    return L.top(U.dedupe(rows, T.content_key(F.col("text"))), k)


@query(f"WITH {TRUE_HYBRID}, {DEDUPED}, {_top('dd', 6, 't')} SELECT query_id, doc_id, score, rank FROM t")
def hybrid_document_vectors(spark, d):
    return _hybrid(spark, d, 6).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {TRUE_HYBRID}, {DEDUPED}, {_top('dd', 6, 't')} SELECT query_id || '/' || doc_id AS chunk_id, query_id, md5(text) AS body, score FROM t JOIN documents USING (doc_id)")
def hybrid_chunks(spark, d):
    rows = _hybrid(spark, d, 6)
    return rows.select(F.concat_ws("/", F.col("query_id").cast("string"), F.col("doc_id").cast("string")).alias("chunk_id"), "query_id", F.md5("text").alias("body"), "score")


TEMPLATE = "Question: %s\n\nContext:\n%s\n\nAnswer:"
RAG = f"""WITH {TRUE_HYBRID}, {DEDUPED}, {_top('dd', 6, 't')}, {TRIM}, kp AS (SELECT * FROM tm WHERE (before + tokens <= 300 OR 300 - before > 20) AND 300 - before > 0),
cx AS (SELECT query_id, count(*) AS n, string_agg('[' || rank || '] ' || substr({Q}, 1, 80), chr(10) ORDER BY rank) AS ctx FROM kp JOIN documents USING (doc_id) GROUP BY 1), an AS (SELECT query_id, substr({A}, 1, 2500) AS answer FROM t JOIN documents USING (doc_id) WHERE rank = 1),
rg AS (SELECT item_id AS query_id, coalesce(n, 0) AS n_sources, 'Question: ' || text || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(ctx, '') || chr(10) || chr(10) || 'Answer:' AS prompt, coalesce(nullif(trim(answer, ' '), ''), 'no answer found') AS answer, text AS question FROM benchmark LEFT JOIN cx ON cx.query_id = item_id LEFT JOIN an ON an.query_id = item_id)"""


def _rag(spark, d):
    return M.rag(_hybrid(spark, d, 6), _bench(spark, d), "item_id", F.col("text"), 300, TEMPLATE)


@query(f"{RAG} SELECT query_id, n_sources, md5(prompt) AS prompt, md5(answer) AS answer FROM rg")
def rag_query(spark, d):
    return _rag(spark, d).select("query_id", "n_sources", F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"))


_N = r"len(list_filter(regexp_split_to_array(answer, '\s+'), lambda w: w <> ''))"
_L = "CASE WHEN length(replace(answer, ' ', '')) > 0 THEN len(regexp_extract_all(answer, '[A-Za-zÀ-ÿ]'))::DOUBLE / length(replace(answer, ' ', '')) ELSE 0 END"


@query(f"{RAG} SELECT query_id, CASE WHEN {_L} < 0.4 THEN 'language' WHEN {_N} < 5 OR {_N} > 800 THEN 'length' ELSE 'none' END AS failed FROM rg")
def guarded_rag(spark, d):
    a = F.col("answer")
    failed = N.first_failure(F.array(N.language_guard(a), N.length_guard(a)))
    return _rag(spark, d).select("query_id", F.coalesce(failed["guard"], F.lit("none")).alias("failed"))


# ---- fallbacks and descent ---------------------------------------------------------------


@query(f"WITH {FULL}, {_top('sc', 10, 'p')}, x AS (SELECT query_id, doc_id, score, lang = 'fr' AS k, max((lang = 'fr')::INT) OVER (PARTITION BY query_id) AS h FROM p JOIN documents USING (doc_id)), y AS (SELECT query_id, doc_id, score FROM x WHERE h = 0 OR k), {_top('y', 3, 't')} SELECT query_id, doc_id, rank FROM t")
def filtered_or_all(spark, d):
    rows = V.of_docs(spark, d, V.full_top(spark, d, 10).drop("rank"), "lang")
    return M.filtered_or_all(rows, F.col("lang") == "fr", 3).select("query_id", "doc_id", "rank")


@query(f"WITH {NTERMS}, {NAV}, q AS (SELECT item_id AS query_id, list_distinct(list_filter({STOPPED % 'text'}, lambda t: length(t) >= 3)) AS terms FROM benchmark), r AS (SELECT lang || '/' || source AS path, doc_id, {Q} AS title FROM documents), s AS (SELECT n2.query_id, doc_id, r.path, title, len(list_filter(terms, lambda x: contains(lower(title), x))) AS hits FROM n2 JOIN r ON r.path = n2.path JOIN q ON q.query_id = n2.query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, title, doc_id) AS rank FROM s WHERE hits > 0) SELECT query_id, doc_id, path, hits::INT AS hits, rank, (greatest(30, 95 - 15 * (rank - 1)) + least(5, hits // 20))::INT AS relevance FROM k WHERE rank <= 5")
def tree_descent(spark, d):
    docs, bench = _docs(spark, d), _bench(spark, d)
    title = T.question_of(F.col("text"))
    picks = X.navigate(X.node_terms(docs, LEVELS, title), bench, "item_id", F.col("text")).where("level = 2").select("query_id", "path")
    return M.descend(picks, docs.select(F.concat_ws("/", *LEVELS).alias("path"), "doc_id", title.alias("title")), bench, "item_id", F.col("text"))


@query(f"WITH {FULL}, {_top('sc', 5, 't')} SELECT query_id, arg_max(doc_id, score * 1000000 - rank) AS doc_id, md5(substr(arg_max({A}, score * 1000000 - rank), 1, 300)) AS answer FROM t JOIN documents USING (doc_id) GROUP BY 1")
def best_block(spark, d):
    rows = V.of_docs(spark, d, V.full_top(spark, d, 5), "text")
    best = F.max_by(F.struct("doc_id", T.answer_of(F.col("text")).alias("a")), F.col("score") * 1_000_000 - F.col("rank"))
    return rows.groupBy("query_id").agg(best.alias("x")).select("query_id", "x.doc_id", F.md5(F.substring("x.a", 1, 300)).alias("answer"))


@query("SELECT doc_id, n_chars, md5(substr(text, 1, 6000)) AS body, length(text) > 6000 AS cut FROM documents")
def summary_inputs(spark, d):
    return _docs(spark, d).select("doc_id", "n_chars", F.md5(F.substring("text", 1, 6000)).alias("body"), (F.length("text") > 6000).alias("cut"))


@query(f"WITH {QUEST}, {_top('(SELECT * FROM qsc WHERE score > 0)', 4, 't')} SELECT query_id, doc_id, rank FROM t JOIN documents USING (doc_id) WHERE lang <> 'de'")
def question_overfetch(spark, d):
    t = V.of_docs(spark, d, V.question_top(spark, d, 4), "lang")
    return t.where("lang <> 'de'").select("query_id", "doc_id", "rank")


# ---- retrieve, rerank, answer, cite as one path ------------------------------------------

CITED = f"""WITH {TRUE_HYBRID}, {DEDUPED}, {_top('dd', 30, 't')}, {MARKED},
pk AS (SELECT * FROM (SELECT query_id, doc_id, mark, row_number() OVER (PARTITION BY query_id ORDER BY mark DESC, score DESC, doc_id) AS place FROM om WHERE mark >= 0.2) WHERE place <= 3),
src AS (SELECT query_id, place, doc_id, {Q} AS sentence, list_distinct({TOKENS}) AS has FROM pk JOIN documents USING (doc_id)),
cm AS (SELECT query_id, place, sentence, CASE query_id % 4 WHEN 1 THEN place + 3 WHEN 3 THEN 4 - place ELSE place END AS m FROM src)"""


def _answer_sources(spark, d):
    """The three best of a pool of max(30, 3 k) hybrid hits after reranking."""
    from ..operators.plugins import overlap_mark

    hits = written(_hybrid(spark, d, max(30, 3 * 5)).select("query_id", "doc_id", "score", "rank"), "pool")
    asked = _bench(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    marks = V.of_docs(spark, d, hits.select("query_id", "doc_id"), "text").join(asked, "query_id").select("query_id", "doc_id", overlap_mark(F.col("query"), F.col("text")).alias("mark"))
    best = M.reranked(hits, marks, 30, 3, 0.2).select("query_id", "doc_id", F.col("rank").alias("place"))
    t = F.col("text")
    return V.of_docs(spark, d, written(best, "best"), "text", "source").select("query_id", "place", "doc_id", F.concat_ws(" ", "source", "doc_id").alias("title"), "text", T.question_of(t).alias("sentence"))


@query(f"{CITED} SELECT query_id, md5(string_agg(rtrim(sentence, ' ') || ' [' || place || ']', chr(10) ORDER BY place)) AS answer, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS sources FROM src GROUP BY 1")
def reranked_answer(spark, d):
    s = _answer_sources(spark, d)
    given = s.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x.doc_id.cast("string")), ",").alias("sources"))
    return S.cited_answer(s).join(given, "query_id").select("query_id", F.md5("answer").alias("answer"), "sources")


@query(f"""{CITED}, mw AS (SELECT query_id, place, list_distinct({TOKENS.replace("lower(text)", "lower(sentence)")}) AS words, m FROM cm),
mst AS (SELECT mw.query_id, m, CASE WHEN has IS NULL THEN 'unknown' WHEN len(words) > 0 AND len(list_intersect(words, has))::DOUBLE / len(words) < 0.5 THEN 'wrong' ELSE 'right' END AS state FROM mw LEFT JOIN src ON src.query_id = mw.query_id AND src.place = m WHERE mw.query_id % 4 <> 2),
mc AS (SELECT query_id, count(*) AS n_marks, count(DISTINCT CASE WHEN state = 'right' THEN m END) AS cited, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'wrong') AS wrong FROM mst GROUP BY 1),
nsr AS (SELECT query_id, count(*) AS n_sources FROM src GROUP BY 1),
mj AS (SELECT query_id, n_sources, coalesce(n_marks, 0) AS n_marks, coalesce(cited, 0) AS cited, coalesce(unknown, 0) AS unknown, coalesce(wrong, 0) AS wrong FROM nsr LEFT JOIN mc USING (query_id))
SELECT *, round(CASE WHEN n_marks = 0 THEN 0 ELSE 0.5 + 0.5 * cited / n_sources END, 3) AS citation_score,
 array_to_string(list_filter([CASE WHEN n_marks = 0 THEN 'MISSING_CITATION' END, CASE WHEN n_marks > 0 AND cited < n_sources THEN 'PARTIAL_CITATION' END, CASE WHEN unknown > 0 THEN 'UNKNOWN_CITATION' END, CASE WHEN wrong > 0 THEN 'WRONG_CITATION' END], lambda x: x IS NOT NULL), ',') AS codes FROM mj""")
def citation_report(spark, d):
    """Answers whose marks are as they should be, out of range, left out or exchanged, by the query's id, against their own sources."""
    s = _answer_sources(spark, d)
    kind = F.pmod("query_id", F.lit(4))
    moved = s.withColumn("place", F.when(kind == 1, F.col("place") + 3).when(kind == 3, 4 - F.col("place")).otherwise(F.col("place")))
    answers = S.cited_answer(moved).withColumn("answer", F.when(F.pmod("query_id", F.lit(4)) == 2, F.regexp_replace("answer", r"\[[0-9]+\]", "")).otherwise(F.col("answer")))
    done = S.checked(answers, s)
    return done.select("query_id", "n_sources", "n_marks", "cited", "unknown", "wrong", "citation_score", F.array_join("codes", ",").alias("codes"))
