"""Registered queries: lexical, dense, fused and gated retrieval of benchmark passages from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense as D
from ..operators import fusion as U
from ..operators import gates as G
from ..operators import impacts as I
from ..operators import keywords as K
from ..operators import lexical as L
from ..operators import vector_index as V
from ..registry import query, table
from ..operators.sizes import checked_broadcast
from ..sources.sinks import index_once, written
from .corpus import A, Q, TOKENS


def _tok(field: str, src: str = "documents", ident: str = "doc_id", name: str = "tok") -> str:
    return f"{name} AS (SELECT {ident}, unnest({TOKENS.replace('text', field) if field != 'text' else TOKENS}) AS term FROM {src})"


def _bm25(text_sql: str, p: str = "") -> str:
    """CTEs that end in {p}sc(query_id, doc_id, score)."""
    return rf"""{p}tok AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower({text_sql}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2)) AS term FROM documents),
{p}dl AS (SELECT doc_id, count(*) AS dl FROM {p}tok GROUP BY 1), {p}st AS (SELECT count(*) AS n, avg(dl) AS adl FROM {p}dl),
{p}tf AS (SELECT term, doc_id, count(*) AS tf FROM {p}tok GROUP BY 1, 2), {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),
{p}qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
{p}sc AS (SELECT query_id, doc_id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / adl))), 6) AS score
 FROM {p}tf JOIN {p}qt USING (term) JOIN {p}df USING (term) JOIN {p}dl USING (doc_id), {p}st GROUP BY 1, 2)"""


def _top(src: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k})"


FULL = _bm25("text")
QUEST = _bm25(Q, "q")


def _index(spark, d, kind):
    """The lexical index of the documents' whole texts, or of their questions: written once, read by every query."""
    text = {"full": F.col("text"), "question": T.question_of(F.col("text"))}[kind]
    return index_once(spark, f"{d}/documents.parquet", kind, lambda: L.build(table(spark, d, "documents"), "doc_id", text))


def full_top(spark, d, k):
    return L.search(_index(spark, d, "full"), table(spark, d, "benchmark"), "item_id", F.col("text"), k)


def question_top(spark, d, k):
    return L.search(_index(spark, d, "question"), table(spark, d, "benchmark"), "item_id", F.col("text"), k)


def of_docs(spark, d, hits, *columns):
    """hits with columns of their documents: the hits are sent to the documents, whose texts stay where they are."""
    return table(spark, d, "documents").select("doc_id", *columns).join(checked_broadcast(hits), "doc_id")


def hit_texts(spark, d, hits, *columns):
    """The documents among the hits with some columns, written: what several later steps join."""
    return written(of_docs(spark, d, hits.select("doc_id").distinct(), *columns), "texts")


@query(f"WITH {FULL} SELECT n AS n_docs, round(adl, 6) AS avg_dl, (SELECT count(*) FROM df) AS vocabulary, (SELECT sum(tf)::BIGINT FROM tf) AS terms FROM st")
def bm25_stats(spark, d):
    i = _index(spark, d, "full")
    t = i.terms.agg(F.count("*").alias("vocabulary")).crossJoin(i.docs.agg(F.sum("dl").alias("terms")))  # one row each
    return i.stats.crossJoin(t).select("n_docs", F.round("avg_dl", 6).alias("avg_dl"), "vocabulary", "terms")


@query(f"WITH {FULL}, {_top('sc', 5, 't')} SELECT query_id, doc_id, score, rank FROM t")
def bm25_topk(spark, d):
    return full_top(spark, d, 5)


def _impacts(spark, d):
    """The impact index of the whole texts: built from the lexical index, written once, read by every query."""
    return index_once(spark, f"{d}/documents.parquet", "impacts", lambda: I.build(_index(spark, d, "full")), I)


@query(f"WITH {FULL}, {_top('sc', 5, 't')} SELECT query_id, doc_id, score, rank FROM t")
def impact_topk(spark, d):
    return I.search(_impacts(spark, d), table(spark, d, "benchmark"), "item_id", F.col("text"), 5)[0]


@query(f"WITH {FULL} SELECT query_id, sum(df)::BIGINT AS postings FROM qt JOIN df USING (term) GROUP BY 1")
def impact_work(spark, d):
    """Postings of each query's terms; how many a search reads of them is in the tests and README."""
    return I.work(_impacts(spark, d), table(spark, d, "benchmark"), "item_id", F.col("text"))


@query(f"WITH {QUEST}, {_top('(SELECT * FROM qsc WHERE score > 0)', 5, 't')} SELECT query_id, doc_id, score, rank FROM t")
def bm25_question_topk(spark, d):
    return question_top(spark, d, 5)


@query(rf"""WITH tok AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM tok WHERE NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1, 2),
v AS (SELECT item_id, count(*) AS v FROM tf GROUP BY 1), h AS (SELECT item_id, tf, v, list_reduce([2166136261::BIGINT] || list_transform(range(1, octet_length(encode(term)) + 1), lambda i: ('0x' || hex(encode(term))[2*i-1:2*i])::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295) & 2147483647 AS idx FROM tf JOIN v USING (item_id))
SELECT item_id, idx, round(sum(ln(1.0 + tf) / (1 + ln(1.0 + v))), 6) AS weight FROM h GROUP BY 1, 2""")
def sparse_vectors(spark, d):
    return L.sparse_vectors(table(spark, d, "benchmark"), "item_id", F.col("text"))


STOPPED = rf"list_filter(regexp_extract_all(lower(%s), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2 AND t NOT IN {T.STOP_WORDS!r})"
FIELDS = f"""fp AS (SELECT DISTINCT doc_id, field, term FROM (
 SELECT doc_id, 'title' AS field, unnest({STOPPED % "lang || ' ' || source"}) AS term FROM documents UNION ALL
 SELECT doc_id, 'question', unnest({STOPPED % Q}) FROM documents UNION ALL SELECT doc_id, 'answer', unnest({STOPPED % f"substr({A}, 1, 500)"}) FROM documents))"""
WQ = f"""wt AS (SELECT query_id, n_terms, unnest(t) AS term FROM (SELECT query_id, t, len(t) AS n_terms FROM (SELECT item_id AS query_id, list_distinct({STOPPED % 'text'}) AS t FROM benchmark))),
ws AS (SELECT query_id, doc_id, n_terms, sum(CASE field WHEN 'title' THEN 3 WHEN 'question' THEN 2 ELSE 1 END)::BIGINT AS raw FROM fp JOIN wt USING (term) GROUP BY 1, 2, 3),
wp AS (SELECT query_id, doc_id, raw, least(100, round_even(100.0 * raw / (6 * n_terms), 0)::INT) AS percent FROM ws)"""


def _fields():
    t = F.col("text")
    return {"title": F.concat_ws(" ", "lang", "source"), "question": T.question_of(t), "answer": F.substring(T.answer_of(t), 1, 500)}


def fields(spark, d):
    return L.field_postings(table(spark, d, "documents"), "doc_id", _fields())


@query(f"WITH {FIELDS} SELECT field, count(*) AS postings, count(DISTINCT term) AS terms FROM fp GROUP BY 1")
def inverted_index(spark, d):
    return fields(spark, d).groupBy("field").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"))


def weighted(spark, d):
    return L.weighted_search(fields(spark, d), table(spark, d, "benchmark"), "item_id", F.col("text"))


def weighted_top(spark, d, k, **how):
    return L.field_search(table(spark, d, "documents"), "doc_id", _fields(), table(spark, d, "benchmark"), "item_id", F.col("text"), k, **how)


def _percent(spark, d):
    """The percentage of a raw score, from the number of its query's terms."""
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.size(F.array_distinct(T.tokens(F.col("text"), 2, T.STOP_WORDS))).alias("n_terms"))
    return lambda rows: rows.withColumn("raw", F.col("score").cast("long")).join(terms, "query_id").withColumn("percent", F.least(F.lit(100), F.bround(100.0 * F.col("raw") / (6 * F.col("n_terms"))).cast("int")))


@query(f"WITH {FIELDS}, {WQ}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM wp) SELECT query_id, doc_id, raw, percent, rank FROM t WHERE rank <= 10")
def weighted_field_search(spark, d):
    return _percent(spark, d)(weighted_top(spark, d, 10, by="raw")).select("query_id", "doc_id", "raw", "percent", "rank")


@query(f"WITH {FIELDS}, {WQ}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM wp WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT query_id, doc_id, percent, greatest(30, 95 - 15 * (rank - 1))::INT AS relevance FROM t WHERE rank <= 10")
def search_within_allowed(spark, d):
    allowed = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    t = _percent(spark, d)(weighted_top(spark, d, 10, by="raw", allowed=allowed))
    return t.select("query_id", "doc_id", "percent", F.greatest(F.lit(30), 95 - 15 * (F.col("rank") - 1)).cast("int").alias("relevance"))


def _cos(keep: str = "true", k: int = 5) -> str:
    return f"""dn AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
 FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON v.vec_id <> q.vec_id WHERE {keep}), {_top('dn', k, 'dt')}"""


def vectors(spark, d, **how):
    v = table(spark, d, "embeddings")
    return D.search(v, v.where("vec_id % 100 = 0"), **how)


@query(f"WITH {_cos()} SELECT query_id, doc_id, score, rank FROM dt")
def cosine_topk(spark, d):
    return vectors(spark, d, k=5)


def _vector_index(spark, d, k):
    """Lists about the root of the number of vectors, and the probes that a sample of its own asks for."""
    v = table(spark, d, "embeddings")
    index = V.build(v, lists=max(1, round(v.count() ** 0.5)))
    return v, v.where("vec_id % 100 = 0"), index, V.calibrated(index, v, k)


@query()
def vector_index_topk(spark, d):
    _, asked, index, probes = _vector_index(spark, d, 10)
    return V.search(index, asked, 10, probes=probes)


@query("SELECT count(*) AS asked, true AS recall_reached, true AS compared_less FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, d):
    """Whether nine of ten exact neighbours of all queries are found, and with fewer comparisons than all."""
    v, asked, index, probes = _vector_index(spark, d, 10)
    found = V.recall(V.search(index, asked, 10, probes=probes), D.search(v, asked, 10)).agg((F.avg("recall") >= 0.9).alias("recall_reached"))
    less = V.work(index, asked, probes=probes).select((F.col("compared") < F.col("all_pairs")).alias("compared_less"))
    return asked.agg(F.count("*").alias("asked")).crossJoin(found).crossJoin(less)  # one row each


@query("SELECT label::VARCHAR AS namespace, count(embedding) AS vectors, max(len(embedding)) AS dimension, count_if(embedding IS NULL)::BIGINT AS empty FROM embeddings GROUP BY 1")
def vector_stats(spark, d):
    return V.stats(table(spark, d, "embeddings"), F.col("label").cast("string"))


@query(f"WITH {_cos('v.label = 1')} SELECT query_id, doc_id, score, rank FROM dt")
def cosine_filtered_topk(spark, d):
    return vectors(spark, d, k=5, keep=F.col("label") == 1)


@query(f"WITH {_cos(k=30)} SELECT query_id, doc_id, score, rank FROM dt WHERE score >= 0.18")
def dense_floor(spark, d):
    return vectors(spark, d, k=30, floor=0.18)


# A document's dense score here is a deterministic stand-in: the weighted field percentage.
DENSE = f"dl0 AS (SELECT query_id, doc_id, percent / 100.0::DOUBLE AS score FROM wp WHERE percent >= 18), {_top('dl0', 30, 'dl1')}"


def dense_like(spark, d):
    return weighted_top(spark, d, 30, least=18).withColumn("score", F.col("score") / 100.0)


def _mm(src: str, name: str) -> str:
    return f"{name} AS (SELECT query_id, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS norm FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {src}))"


@query(f"WITH {FULL}, {_top('sc', 30, 't')}, {_mm('t', 'm')} SELECT query_id, doc_id, round(norm, 6) AS norm FROM m")
def minmax_scores(spark, d):
    m = U.min_max(full_top(spark, d, 30))
    return m.select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


HYBRID = f"""{FULL}, {QUEST}, {FIELDS}, {WQ}, {DENSE}, {_top('sc', 30, 's1')}, {_top('(SELECT * FROM qsc WHERE score > 0)', 30, 'q0')},
q1 AS (SELECT q0.* FROM q0 SEMI JOIN (SELECT query_id, doc_id FROM dl1 UNION SELECT query_id, doc_id FROM s1) c ON q0.query_id = c.query_id AND q0.doc_id = c.doc_id),
{_mm('dl1', 'dm')}, {_mm('s1', 'sm')}, {_mm('q1', 'qm')},
hy AS (SELECT query_id, doc_id, round(0.7 * dd + 0.3 * ss + 0.28 * qq + CASE WHEN dd > 0 AND ss > 0 THEN 0.06 ELSE 0 END, 6) AS score FROM (
 SELECT query_id, doc_id, coalesce(max(norm) FILTER (tag = 'd'), 0) AS dd, coalesce(max(norm) FILTER (tag = 's'), 0) AS ss, coalesce(max(norm) FILTER (tag = 'q'), 0) AS qq FROM (
 SELECT *, 'd' AS tag FROM dm UNION ALL SELECT *, 's' FROM sm UNION ALL SELECT *, 'q' FROM qm) GROUP BY 1, 2))"""
CKEY = r"lower(regexp_replace(substr(trim(text), 1, 120), '[\s\p{P}\p{S}\x{200B}-\x{200F}\x{064B}-\x{065F}]', '', 'g'))"
DEDUPED = f"""dd AS (SELECT query_id, doc_id, score FROM (SELECT h.*, {CKEY} AS k, row_number() OVER (PARTITION BY query_id, {CKEY} ORDER BY score DESC, h.doc_id) AS r FROM hy h JOIN documents USING (doc_id)) WHERE r = 1 OR k = '')"""


def hybrid(spark, d):
    return U.weighted(dense_like(spark, d), full_top(spark, d, 30), question_top(spark, d, 30))


@query(f"WITH {HYBRID} SELECT query_id, doc_id, score FROM hy")
def weighted_fusion(spark, d):
    return hybrid(spark, d).select("query_id", "doc_id", "score")


@query(f"WITH {HYBRID}, {DEDUPED}, {_top('dd', 6, 't')} SELECT query_id, doc_id, score, rank FROM t")
def hybrid_search(spark, d):
    rows = of_docs(spark, d, written(hybrid(spark, d).select("query_id", "doc_id", "score"), "hybrid"), "text")
    return L.top(U.dedupe(rows, T.content_key(F.col("text"))).drop("text"), 6).select("query_id", "doc_id", "score", "rank")


RRF = f"""{FULL}, {QUEST}, {FIELDS}, {WQ}, {DENSE}, {_top('sc', 50, 'r1')}, {_top('(SELECT * FROM qsc WHERE score > 0)', 50, 'r2')},
rr AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank::DOUBLE)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM r1 UNION ALL SELECT query_id, doc_id, rank FROM r2 UNION ALL SELECT query_id, doc_id, rank FROM dl1) GROUP BY 1, 2)"""


def rrf(spark, d):
    return U.reciprocal_rank([full_top(spark, d, 50), question_top(spark, d, 50), dense_like(spark, d)])


@query(f"WITH {RRF}, {_top('rr', 20, 't')} SELECT query_id, doc_id, score, rank FROM t")
def rrf_fusion(spark, d):
    return L.top(rrf(spark, d), 20)


FAST = f"{FULL}, {QUEST}, {_top('sc', 36, 'f1')}, {_top('(SELECT * FROM qsc WHERE score > 0)', 36, 'f2')}, fc AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, score FROM f1 UNION ALL SELECT query_id, doc_id, score * 1.5 FROM f2) GROUP BY 1, 2)"


def fast(spark, d):
    return U.combine_question(full_top(spark, d, 36), question_top(spark, d, 36))


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')} SELECT query_id, doc_id, score, rank FROM fr")
def fast_combined_score(spark, d):
    return L.top(fast(spark, d), 30)


MARKS = "mk AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 0.8 ELSE 0.5 END)::DOUBLE AS mark FROM labels GROUP BY 1)"


def marks(spark, d):
    return table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 0.8).otherwise(0.5)).alias("mark"))


@query(f"WITH {RRF}, {MARKS}, x AS (SELECT query_id, doc_id, 0.3::DOUBLE * score + 0.7::DOUBLE * mark AS score FROM rr JOIN mk USING (doc_id) WHERE mark >= 0.55), {_top('x', 5, 't')} SELECT query_id, doc_id, score, rank FROM t")
def heavy_search(spark, d):
    fused = rrf(spark, d)
    scored = fused.select("query_id", "doc_id").join(marks(spark, d), "doc_id")
    return L.top(U.rerank_mix(fused, scored).select("query_id", "doc_id", "score"), 5)


@query(f"WITH {RRF}, {_top('rr', 12, 't')}, {MARKS} SELECT query_id, doc_id, score, mark, CASE WHEN mark IS NULL THEN 'unscored' WHEN mark < 0.75 THEN 'rejected' ELSE 'kept' END AS verdict FROM t LEFT JOIN mk USING (doc_id)")
def rerank_gate(spark, d):
    t = L.top(rrf(spark, d), 12).join(marks(spark, d), "doc_id", "left")
    return t.select("query_id", "doc_id", "score", "mark", F.when(F.col("mark").isNull(), "unscored").when(F.col("mark") < 0.75, "rejected").otherwise("kept").alias("verdict"))


# ---- gates -------------------------------------------------------------------------------

FLOORS = "fl AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM fr) WHERE score >= 1.5 AND (rank = 1 OR score >= 0.55 * best))"


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')}, {FLOORS} SELECT query_id, doc_id, score, rank FROM fl")
def score_floors(spark, d):
    return G.score_floors(L.top(fast(spark, d), 30))


ANCH = rf"""hw AS (SELECT query_id, doc_id, unnest(list_distinct({TOKENS})) AS term FROM fr JOIN documents USING (doc_id)), ps AS (SELECT query_id, count(*) AS pool FROM fr GROUP BY 1),
aw AS (SELECT item_id AS query_id, unnest(list_distinct({STOPPED % 'text'})) AS term FROM benchmark),
an AS (SELECT query_id, term FROM (SELECT query_id, term, count(*) AS df FROM hw JOIN aw USING (query_id, term) GROUP BY 1, 2) JOIN ps USING (query_id) WHERE df < 0.3 * pool)"""
FILTER = rf"""qa AS (SELECT query_id, doc_id, count(*) AS aq FROM (SELECT query_id, doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower({Q}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2))) AS term FROM fr JOIN documents USING (doc_id)) JOIN an USING (query_id, term) GROUP BY 1, 2),
ba AS (SELECT query_id, doc_id, count(*) AS ab FROM hw JOIN an USING (query_id, term) GROUP BY 1, 2), na AS (SELECT query_id, count(*) AS n FROM an GROUP BY 1),
am AS (SELECT *, CASE WHEN n IS NULL THEN 'no_anchors' WHEN mq > 0 THEN 'question' WHEN mb > 0 THEN 'body_fallback' ELSE 'miss' END AS mode FROM (
 SELECT fr.query_id, fr.doc_id, score, rank, coalesce(aq, 0) AS aq, coalesce(ab, 0) AS ab, n, max(coalesce(aq, 0)) OVER (PARTITION BY fr.query_id) AS mq, max(coalesce(ab, 0)) OVER (PARTITION BY fr.query_id) AS mb
 FROM fr LEFT JOIN qa USING (query_id, doc_id) LEFT JOIN ba USING (query_id, doc_id) LEFT JOIN na USING (query_id))),
af AS (SELECT * FROM am WHERE mode = 'no_anchors' OR (mode = 'question' AND aq > 0) OR (mode = 'body_fallback' AND ab > 0))"""


def _anchored(spark, d):
    hits = written(L.top(fast(spark, d), 30), "hits")
    texts = hit_texts(spark, d, hits, "text")
    found = G.anchors(hits, texts, table(spark, d, "benchmark"), "item_id", F.col("text"))
    in_q, in_b = (G.anchor_hits(hits, texts, found, c) for c in (T.question_of(F.col("text")), F.col("text")))
    return found, G.anchor_filter(hits, in_q, in_b, found)


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')}, {ANCH} SELECT query_id, term FROM an")
def anchor_tokens(spark, d):
    return _anchored(spark, d)[0]


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')}, {ANCH}, {FILTER} SELECT query_id, doc_id, mode, aq, ab FROM af")
def anchor_filter(spark, d):
    return _anchored(spark, d)[1].select("query_id", "doc_id", "mode", "aq", "ab")


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')}, {ANCH}, {FILTER} SELECT query_id, doc_id, aq FROM (SELECT *, max(aq) OVER (PARTITION BY query_id) AS best FROM af) WHERE best < 2 OR aq >= greatest(1, ceil(best * 0.5))")
def anchor_coverage(spark, d):
    return G.coverage_floor(_anchored(spark, d)[1]).select("query_id", "doc_id", "aq")


GROUPS = "gr AS (SELECT DISTINCT source, 'g' || (substr(source, 4)::INT % 3) AS grp FROM documents), wn AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'g' || (item_id % 3) END AS wanted FROM benchmark), al AS (SELECT h.*, wanted, grp FROM (SELECT fr.*, source FROM fr JOIN documents USING (doc_id)) h LEFT JOIN gr USING (source) LEFT JOIN wn USING (query_id) WHERE wanted IS NULL OR grp = wanted)"


def _allowed(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    grp = docs.select("source", F.concat(F.lit("g"), (F.substring("source", 4, 9).cast("int") % 3).cast("string")).alias("grp")).distinct()
    wanted = bench.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string"))).alias("wanted"))
    return G.allow(of_docs(spark, d, written(L.top(fast(spark, d), 30), "hits"), "source"), grp, wanted)


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')}, {GROUPS} SELECT query_id, doc_id, source, wanted FROM al")
def allowlist_filter(spark, d):
    return _allowed(spark, d).select("query_id", "doc_id", "source", "wanted")


@query(f"WITH {FAST}, {_top('fc', 30, 'fr')}, {GROUPS} SELECT count(*) AS leaks FROM al WHERE wanted IS NOT NULL AND (grp IS NULL OR grp <> wanted)")
def leak_check(spark, d):
    return G.leaks(_allowed(spark, d)).agg(F.count("*").alias("leaks"))


LANG_WORDS = [("en", "the"), ("de", "und"), ("fr", "et"), ("es", "los"), ("es", "de la")]


@query(rf"""SELECT item_id AS query_id, CASE """ + " ".join(f"WHEN {'contains(lower(text), ' + repr(w) + ')' if ' ' in w else 'list_contains(ts, ' + repr(w) + ')'} THEN '{g}'" for g, w in LANG_WORDS) + r""" END AS grp FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM benchmark)""")
def group_detection(spark, d):
    return G.detect_group(table(spark, d, "benchmark"), "item_id", F.col("text"), LANG_WORDS)


PAIRS = rf"""rl AS (SELECT p AS pattern, min(item_id)::VARCHAR AS value FROM (SELECT item_id, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS p FROM (SELECT item_id, string_split(lower(trim(text)), ' ') AS ts FROM benchmark))
 WHERE regexp_matches(p, '^[\p{{L}}\p{{N}}_]+ [\p{{L}}\p{{N}}_]+$') GROUP BY 1)"""


def _pair_rules(spark, d):
    """Rules from a table: every two words of a benchmark passage, parted by one blank, name the first passage that has them."""
    ts = F.split(F.lower(F.trim("text")), " ")
    pairs = table(spark, d, "benchmark").select("item_id", ts.alias("ts")).where(F.size("ts") > 1)
    pairs = pairs.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda i: F.concat_ws(" ", F.get("ts", i - 1), F.get("ts", i)))).alias("pattern"))
    pairs = pairs.where(F.col("pattern").rlike(r"^[\p{L}\p{N}_]+ [\p{L}\p{N}_]+$"))
    return pairs.groupBy("pattern").agg(F.min("item_id").cast("string").alias("value")).withColumn("priority", F.lit(0))


@query(rf"""WITH {PAIRS}, s AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_ ]', ' | ', 'g'), ' ') AS ts FROM documents),
 dp AS (SELECT doc_id, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS pattern FROM s)
SELECT doc_id, count(*) AS rules, sum(n)::BIGINT AS found FROM (SELECT doc_id, pattern, count(*) AS n FROM dp GROUP BY 1, 2) JOIN rl USING (pattern) GROUP BY 1""")
def keyword_rules(spark, d):
    """All rules against whole texts in one pass each: how many a document holds, and how often."""
    found = K.matches(table(spark, d, "documents"), "doc_id", F.col("text"), _pair_rules(spark, d))
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("rules"), F.sum("n").alias("found"))
