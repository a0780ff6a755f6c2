"""Registered queries: deduplication, hierarchies, contexts, query understanding, routing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..operators import context as C
from ..operators import lexical as L
from ..operators import markdown as MD
from ..operators import models as M
from ..operators import records as R
from ..operators import routing as O
from ..operators import tree as X
from ..registry import query, table
from ..sources.sinks import written
from . import retrieval as V
from .corpus import A, Q, WORDS
from .retrieval import CKEY, FIELDS, FULL, MARKS, RRF, STOPPED, WQ, _top


def _docs(spark, d):
    return table(spark, d, "documents")


# ---- deduplication -----------------------------------------------------------------------


def _first(key: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM (SELECT doc_id, {key} AS k FROM documents)) WHERE r = 1 OR k = ''"


@query(_first(CKEY))
def dedupe_content_key(spark, d):
    return R.keep_first(_docs(spark, d), T.content_key(F.col("text")), ["doc_id"]).select("doc_id")


@query(_first(f"sha1(substr({Q}, 1, 200) || '|' || substr({A}, 1, 400))"))
def dedupe_sha1(spark, d):
    t = F.col("text")
    key = F.sha1(F.concat_ws("|", F.substring(T.question_of(t), 1, 200), F.substring(T.answer_of(t), 1, 400)))
    return R.keep_first(_docs(spark, d), key, ["doc_id"]).select("doc_id")


@query(_first(rf"trim(regexp_replace({Q} || ' ' || substr({A}, 1, 200), '\s+', ' ', 'g'))"))
def dedupe_whitespace(spark, d):
    t = F.col("text")
    key = F.trim(F.regexp_replace(F.concat_ws(" ", T.question_of(t), F.substring(T.answer_of(t), 1, 200)), r"\s+", " "))
    return R.keep_first(_docs(spark, d), key, ["doc_id"]).select("doc_id")


@query(r"""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN NULL WHEN len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 2)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
 count(*) OVER (PARTITION BY text) AS copies FROM documents""")
def embed_unique_texts(spark, d):
    """Every distinct text sent once to the default model; the length of each row's vector, and how many rows share it."""
    v = M.call(_docs(spark, d).select("doc_id", "text"), "text", "hashed vectors", M.HashedVectors, ST.ArrayType(ST.DoubleType()), out="v")
    key = F.coalesce(F.md5("text"), F.lit(""))
    shared = v.groupBy(key.alias("k")).agg(F.count("*").alias("copies"))
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return v.select("doc_id", norm.alias("norm"), key.alias("k")).join(shared, "k").select("doc_id", "norm", "copies")


# ---- hierarchies -------------------------------------------------------------------------

HEADS = r"""hd AS (SELECT id, (line - 1)::BIGINT AS line, h[3:3]::INT AS level, substr(trim(regexp_replace(h, '<[^>]*>', '', 'g')), 1, 200) AS title FROM (
 SELECT page_id AS id, unnest(l) AS h, generate_subscripts(l, 1) AS line FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*') AS l FROM pages)))"""


@query(f"WITH {HEADS} SELECT id, line, level, title, greatest(" + ", ".join(f"CASE WHEN {k} < level THEN max(CASE WHEN level = {k} THEN line END) OVER w END" for k in range(1, 6)) + ") AS parent FROM hd WINDOW w AS (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def tree_headings(spark, d):
    return X.heading_tree(X.headings(table(spark, d, "pages"), "page_id", F.col("html")))


LEVELS = ["lang", "source"]


@query("SELECT concat_ws('/', lang, source) AS path, CASE WHEN source IS NULL THEN 1 ELSE 2 END AS level, count(*) AS n_leaves FROM documents GROUP BY ROLLUP (lang, source) HAVING grouping(lang) = 0")
def tree_leaf_counts(spark, d):
    return X.nodes(_docs(spark, d), LEVELS)


NTERMS = f"""nt0 AS (SELECT DISTINCT lang, source, term FROM (SELECT lang, source, unnest(list_filter({STOPPED % Q}, lambda t: length(t) >= 3)) AS term FROM documents)),
nt AS (SELECT DISTINCT lang AS path, 1 AS level, term FROM nt0 UNION ALL SELECT DISTINCT lang || '/' || source, 2, term FROM nt0)"""


@query(f"WITH {NTERMS} SELECT path, level, count(*) AS terms FROM nt GROUP BY 1, 2")
def tree_keywords(spark, d):
    return X.node_terms(_docs(spark, d), LEVELS, T.question_of(F.col("text"))).groupBy("path", "level").agg(F.count("*").alias("terms"))


NAV = f"""aq AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({STOPPED % 'text'}, lambda t: length(t) >= 3))) AS term FROM benchmark),
nh AS (SELECT query_id, path, level, count(*) AS hits FROM nt JOIN aq USING (term) GROUP BY 1, 2, 3),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, path) AS rank FROM nh WHERE level = 1) WHERE rank <= 2),
n2 AS (SELECT * FROM (SELECT nh.*, row_number() OVER (PARTITION BY nh.query_id ORDER BY nh.hits DESC, nh.path) AS rank FROM nh SEMI JOIN n1 ON nh.query_id = n1.query_id AND split_part(nh.path, '/', 1) = n1.path WHERE nh.level = 2) WHERE rank <= 3)"""


@query(f"WITH {NTERMS}, {NAV} SELECT query_id, path, level, hits, rank FROM n1 UNION ALL SELECT query_id, path, level, hits, rank FROM n2")
def tree_navigation(spark, d):
    terms = X.node_terms(_docs(spark, d), LEVELS, T.question_of(F.col("text")))
    return X.navigate(terms, table(spark, d, "benchmark"), "item_id", F.col("text"))


DEEP = ["lang", "source", "letter", "size"]
_LETTER = "coalesce(nullif(lower(substr(trim(text), 1, 1)), ''), '-')"
_SIZE = "CASE WHEN length(text) < 300 THEN 'short' WHEN length(text) < 3000 THEN 'middle' ELSE 'long' END"


def _descent(beam: int = 2) -> str:
    """A tree of four levels: one CTE for each level's own children, one for those of the siblings."""
    paths = ["lang", "lang || '/' || source", "lang || '/' || source || '/' || letter", "lang || '/' || source || '/' || letter || '/' || size"]
    ctes = [
        f"dt0 AS (SELECT DISTINCT lang, source, {_LETTER} AS letter, {_SIZE} AS size, unnest(list_filter({STOPPED % Q}, lambda t: length(t) >= 3)) AS term FROM documents WHERE text IS NOT NULL)",
        "dt AS (" + " UNION ".join(f"SELECT {p} AS path, {k} AS level, term FROM dt0" for k, p in enumerate(paths, 1)) + ")",
        f"aq AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({STOPPED % 'text'}, lambda t: length(t) >= 3))) AS term FROM benchmark)",
        "hh AS (SELECT query_id, level, path, count(*) AS hits FROM dt JOIN aq USING (term) GROUP BY 1, 2, 3)",
        f"w1 AS (SELECT *, 'beam' AS via FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, path) AS rank FROM hh WHERE level = 1) WHERE rank <= {beam})",
    ]
    up = lambda c: f"regexp_extract({c}, '^(.*)/[^/]*$', 1)"
    for k in range(2, 5):
        rank = f"row_number() OVER (PARTITION BY h.query_id ORDER BY h.hits DESC, h.path) AS rank FROM hh h SEMI JOIN"
        ctes.append(f"o{k} AS (SELECT *, 'beam' AS via FROM (SELECT h.*, {rank} w{k - 1} f ON f.query_id = h.query_id AND f.path = {up('h.path')} WHERE h.level = {k}) WHERE rank <= {beam})")
        ctes.append(f"k{k} AS (SELECT DISTINCT query_id, {up('path')} AS upper FROM w{k - 1} WHERE query_id NOT IN (SELECT query_id FROM o{k}))")
        ctes.append(f"x{k} AS (SELECT *, 'siblings' AS via FROM (SELECT h.*, {rank} k{k} f ON f.query_id = h.query_id AND f.upper = {up(up('h.path'))} WHERE h.level = {k}) WHERE rank <= {beam})")
        ctes.append(f"w{k} AS (SELECT * FROM o{k} UNION ALL SELECT * FROM x{k})")
    return f"WITH {', '.join(ctes)} SELECT query_id, level, path, hits, rank, via FROM (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, 5)) + ")"


@query(_descent())
def deep_descent(spark, d):
    t = F.col("text")
    size = F.when(F.length(t) < 300, "short").when(F.length(t) < 3000, "middle").otherwise("long")
    letter = F.coalesce(F.nullif(F.lower(F.substring(F.trim(t), 1, 1)), F.lit("")), F.lit("-"))
    terms = X.node_terms(_docs(spark, d).where("text is not null").withColumns({"letter": letter, "size": size}), DEEP, T.question_of(t))
    return X.descend(terms, table(spark, d, "benchmark"), "item_id", t, beam=2)


@query(r"""WITH p AS (SELECT doc_id AS id, string_split(text, '. ') AS ps FROM documents WHERE text IS NOT NULL), l AS (SELECT id, i - 1 AS i, replace(ps[i], chr(10), ' ') AS s FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
 m AS (SELECT id, i + 1 AS line, CASE WHEN i % 11 = 3 THEN '```' WHEN i % 4 = 0 THEN repeat('#', (1 + i // 4 % 3)::INT) || ' ' || s ELSE s END AS text FROM l),
 f AS (SELECT *, sum((starts_with(text, '```'))::INT) OVER (PARTITION BY id ORDER BY line) % 2 AS inside FROM m),
 h AS (SELECT *, CASE WHEN inside = 0 AND NOT starts_with(text, '```') AND regexp_matches(trim(text), '^#{1,6}\s+.+$') THEN line END AS own FROM f),
 b AS (SELECT *, max(own) OVER (PARTITION BY id ORDER BY line) AS head FROM h)
SELECT id, head AS line, max(length(regexp_extract(trim(text), '^(#{1,6})\s', 1))) FILTER (own IS NOT NULL) AS level, md5(trim(string_agg(text, chr(10) ORDER BY line), chr(10) || ' ')) AS body FROM b WHERE head IS NOT NULL GROUP BY 1, 2""")
def markdown_sections(spark, d):
    """Documents as markdown, a sentence a line, some as headings and some as fences, in splits of seven lines."""
    p = _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    s = F.replace("s", F.lit("\n"), F.lit(" "))
    line = F.when(F.col("i") % 11 == 3, "```").when(F.col("i") % 4 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.floor(F.col("i") / 4) % 3).cast("int")), F.lit(" "), s)).otherwise(s)
    rows = p.select("id", F.floor(F.col("i") / 7).alias("block"), F.col("i").alias("at"), line.alias("text"))
    return MD.sections(rows).select("id", "line", "level", F.md5(F.regexp_replace("body", "^[\n ]+|[\n ]+$", "")).alias("body"))


SUBGROUPS = [("articles", ["the", "der", "le ", "el "]), ("joins", ["and", "und", " et ", " y "]), ("other", ["zzz"])]


@query(f"SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({Q}), '{w}')" for w in ws) + f" THEN '{g}'" for g, ws in SUBGROUPS) + " ELSE 'other' END AS subgroup FROM documents")
def subgroup_assignment(spark, d):
    return _docs(spark, d).select("doc_id", X.assign_group(T.question_of(F.col("text")), SUBGROUPS).alias("subgroup"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) >= 10")
def large_groups(spark, d):
    return _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n")).where("n >= 10")


@query(f"""SELECT lang || '/' || source || ' (' || n || '): ' || titles AS line FROM (SELECT lang, source, count(*) AS n, string_agg(title, '; ' ORDER BY r) FILTER (r <= 3) AS titles FROM (
 SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY title, doc_id) AS r FROM (SELECT lang, source, doc_id, substr({Q}, 1, 60) AS title FROM documents)) GROUP BY 1, 2)""")
def compact_summary(spark, d):
    return X.compact_summary(_docs(spark, d), LEVELS, F.substring(T.question_of(F.col("text")), 1, 60))


@query("SELECT r_name AS region, n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def taxonomy_rollup(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("suppliers"))


# ---- context -----------------------------------------------------------------------------


def _hits(spark, d, k=5):
    return V.full_top(spark, d, k)


TRIM = f"""tm AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (
 SELECT query_id, doc_id, rank, floor(len({WORDS}) * 1.3)::BIGINT AS tokens FROM t JOIN documents USING (doc_id)))"""


@query(f"WITH {FULL}, {_top('sc', 5, 't')}, {TRIM} SELECT query_id, doc_id, rank, tokens, least(tokens, 300 - before) AS used FROM tm WHERE (before + tokens <= 300 OR 300 - before > 20) AND 300 - before > 0")
def trim_budget(spark, d):
    rows = V.of_docs(spark, d, _hits(spark, d), "text")
    return C.trim_to_budget(rows, T.token_estimate(F.col("text")), 300).select("query_id", "doc_id", "rank", "tokens", "used")


@query(f"WITH {FULL}, {_top('sc', 5, 't')} SELECT query_id, string_agg('[' || rank || '] ' || substr({Q}, 1, 80), chr(10) ORDER BY rank) AS context FROM t JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1")
def context_blocks(spark, d):
    rows = V.of_docs(spark, d, _hits(spark, d), "text")
    return C.blocks(rows, T.question_of(F.col("text")))


@query(f"WITH {FULL}, {_top('sc', 5, 't')} SELECT query_id, doc_id, md5(substr({A}, 1, 2500)) AS answer FROM t JOIN documents USING (doc_id) WHERE rank = 1")
def extractive_answer(spark, d):
    rows = V.of_docs(spark, d, _hits(spark, d), "text")
    return C.extractive(rows, T.answer_of(F.col("text"))).withColumn("answer", F.md5("answer"))


SYNONYMS = [["the", "der", "le"], ["and", "und", "et", "as well as"], ["of", "von", "de"]]
_ARR = lambda g: "[" + ", ".join(f"'{w}'" for w in g) + "]"


@query(rf"""SELECT query_id, array_to_string(list_slice(list_filter(e, lambda x, i: list_position(e, x) = i), 1, 32), ' ') AS expanded FROM (SELECT item_id AS query_id, list_concat(t, {", ".join(f"CASE WHEN list_has_any(t, {_ARR([w for w in g if ' ' not in w])}) THEN {_ARR(g)} ELSE [] END" for g in SYNONYMS)}) AS e FROM (
 SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2) AS t FROM benchmark))""")
def synonym_append(spark, d):
    return C.expand_terms(table(spark, d, "benchmark"), "item_id", F.col("text"), SYNONYMS)


MAPPING = {"the": "der", "and": "und", "of": "von"}


@query(f"SELECT item_id, array_to_string(list_transform({WORDS}, lambda w: CASE lower(w) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MAPPING.items()) + " ELSE w END), ' ') AS mapped FROM benchmark")
def token_map(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.map_tokens(F.col("text"), MAPPING).alias("mapped"))


RULES = [("german", r"\b(und|der|die)\b"), ("french", r"\b(et|les|le)\b"), ("spanish", r"\b(los|las|el)\b"), ("english", r"\b(the|and)\b")]


@query("SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'general' END AS domain FROM benchmark")
def domain_rules(spark, d):
    return table(spark, d, "benchmark").select("item_id", C.rule_domain(F.col("text"), RULES, "general").alias("domain"))


PH = rf"(SELECT item_id, text, list_slice(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2), 1, 4) AS w FROM benchmark)"


@query(f"""SELECT item_id, doc_id, (CASE WHEN contains(lower(d.text), array_to_string(w, ' ')) THEN 20 ELSE 0 END + 8 * len(list_filter(range(1, len(w)), lambda i: contains(lower(d.text), array_to_string(list_slice(w, i, i + 1), ' ')))) + 10 * len(list_filter(range(1, len(w) - 1), lambda i: contains(lower(d.text), array_to_string(list_slice(w, i, i + 2), ' ')))))::INT AS bonus
 FROM (WITH {FULL}, {_top('sc', 5, 't')} SELECT * FROM t) t JOIN {PH} q ON t.query_id = q.item_id JOIN documents d USING (doc_id)""")
def phrase_bonus(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(T.tokens(F.col("text"), 2), 1, 4).alias("w"))
    rows = V.of_docs(spark, d, _hits(spark, d), "text").join(q, "query_id")
    return rows.select(F.col("query_id").alias("item_id"), "doc_id", T.phrase_bonus(F.lower("text"), F.col("w")).cast("int").alias("bonus"))


# ---- routing -----------------------------------------------------------------------------

KW = f"kw AS (SELECT query_id, lang AS grp, percent FROM wp JOIN documents USING (doc_id) WHERE percent >= 20)"
KC = """k1 AS (SELECT query_id, grp, max(percent) AS percent FROM kw GROUP BY 1, 2), k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY percent DESC, grp) AS r FROM k1),
k3 AS (SELECT query_id, count(*) AS groups, max(percent) AS top, avg(CASE WHEN r <= 3 THEN percent END) AS m3 FROM k2 GROUP BY 1),
k4 AS (SELECT *, (0.55::DOUBLE * least(top / 100.0::DOUBLE, 1) + 0.1::DOUBLE * CASE WHEN m3 > 0 THEN greatest(0, least(1, top / m3 - 1)) ELSE 0 END) * (0.35::DOUBLE + 0.65::DOUBLE * (groups / 4.0::DOUBLE)) AS c FROM k3),
kc AS (SELECT query_id, groups, top, round(CASE WHEN groups < 2 THEN least(c, 0.5) ELSE c END, 3) AS confidence FROM k4)"""


def _kw(spark, d):
    rows = V.weighted_top(spark, d, None, least=20)
    return V.of_docs(spark, d, rows.select("query_id", "doc_id", F.col("score").cast("int").alias("percent")), F.col("lang").alias("grp"))


@query(f"WITH {FIELDS}, {WQ}, {KW}, {KC} SELECT query_id, groups, top, confidence FROM kc")
def conf_keyword(spark, d):
    return O.keyword_confidence(_kw(spark, d), 4)


RC = f"""rk0 AS (SELECT query_id, lang AS grp, mark FROM rt JOIN documents USING (doc_id) JOIN mk USING (doc_id) WHERE mark >= 0.75), rk1 AS (SELECT query_id, grp, max(coalesce(mark, 0.75)) AS mark, count(*) AS n FROM rk0 GROUP BY 1, 2),
rc AS (SELECT query_id, count(*) AS groups, max(n) AS pool, round(0.35::DOUBLE * (count(*) / 4.0::DOUBLE) + 0.65::DOUBLE * avg(mark), 3) AS confidence FROM rk1 GROUP BY 1)"""


def _rk(spark, d):
    t = written(L.top(V.rrf(spark, d), 12).join(V.marks(spark, d), "doc_id").where("mark >= 0.75"), "marked")
    return V.of_docs(spark, d, t, F.col("lang").alias("grp"))


@query(f"WITH {RRF}, {_top('rr', 12, 'rt')}, {MARKS}, {RC} SELECT query_id, groups, pool, confidence FROM rc")
def conf_reranked(spark, d):
    return O.reranked_confidence(_rk(spark, d), 4)


TC = "tc AS (SELECT query_id, round(0.4::DOUBLE * (count(DISTINCT grp) / 4.0::DOUBLE) + 0.6::DOUBLE * least(max(percent) / 100.0::DOUBLE, 1), 3) AS confidence FROM kw GROUP BY 1)"


@query(f"WITH {FIELDS}, {WQ}, {KW}, {TC} SELECT query_id, confidence FROM tc")
def conf_tree(spark, d):
    return O.tree_confidence(_kw(spark, d), 4)


@query(f"""WITH {RRF}, {_top('rr', 12, 'rt')}, {MARKS}, {RC}, {KW}, {KC}, {TC} SELECT query_id, route, CASE route WHEN 'keyword' THEN kcc WHEN 'reranked' THEN rcc WHEN 'tree' THEN tcc ELSE 0 END AS confidence FROM (
 SELECT item_id AS query_id, kc.confidence AS kcc, rc.confidence AS rcc, tc.confidence AS tcc, CASE WHEN kc.confidence >= 0.8 THEN 'keyword' WHEN rc.confidence IS NOT NULL THEN 'reranked' WHEN tc.confidence >= 0.45 AND coalesce(pool, 20) >= 20 THEN 'tree' ELSE 'none' END AS route
 FROM benchmark LEFT JOIN kc ON kc.query_id = item_id LEFT JOIN rc ON rc.query_id = item_id LEFT JOIN tc ON tc.query_id = item_id)""")
def route_decision(spark, d):
    kw = _kw(spark, d)
    return O.route(table(spark, d, "benchmark"), "item_id", O.keyword_confidence(kw, 4), O.reranked_confidence(_rk(spark, d), 4), O.tree_confidence(kw, 4))


@query(f"""WITH {FULL}, {_top('sc', 30, 't')}, b AS (SELECT query_id, lang AS grp, doc_id, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS r FROM t JOIN documents USING (doc_id)),
c AS (SELECT query_id, grp, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY r) AS doc_ids FROM b WHERE r <= 5 GROUP BY 1, 2)
SELECT item_id AS query_id, g.grp, coalesce(n, 0) AS n, coalesce(doc_ids, '') AS doc_ids FROM benchmark CROSS JOIN (SELECT DISTINCT lang AS grp FROM documents) g LEFT JOIN c ON c.query_id = item_id AND c.grp = g.grp""")
def merge_groups_top5(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("lang").alias("grp"))
    return O.group_cards(V.of_docs(spark, d, _hits(spark, d, 30), F.col("lang").alias("grp")), docs.select("grp").distinct(), table(spark, d, "benchmark"), "item_id")
