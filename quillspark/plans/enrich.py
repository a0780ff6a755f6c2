"""Registered queries: dimensions and cards, filters after ranking, decays and cuts, text tests, scorers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import context as C
from ..operators import enrich as E
from ..operators import greedy
from ..operators import lexical as L
from ..operators import records as R
from ..registry import query, table
from ..sources.sinks import written
from . import retrieval as V
from .corpus import A, Q, RECORDS, WORDS
from .retrieval import FULL, STOPPED, _top


def _docs(spark, d):
    return table(spark, d, "documents")


def _bench(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hits(spark, d, k):
    return V.full_top(spark, d, k)


def _asked(text):
    return F.array_distinct(T.tokens(text, 3, T.STOP_WORDS))


ASKED = f"list_distinct(list_filter({STOPPED % 'text'}, lambda t: length(t) >= 3))"

# ---- dimensions and cards ----------------------------------------------------------------


@query("SELECT doc_id, coalesce(n.n_name, array_to_string(list_transform(string_split(replace(CASE WHEN d.source LIKE '%9' THEN left(d.source, length(d.source) - 1) ELSE d.source END, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS name FROM documents d LEFT JOIN nation n ON n.n_nationkey = try_cast(substr(d.source, 4) AS INT) * 2")
def source_display_names(spark, d):
    names = table(spark, d, "nation").select((F.col("n_nationkey") / 2).alias("k"), "n_name")
    docs = _docs(spark, d).withColumn("k", F.substring("source", 4, 9).cast("double"))
    return docs.join(E.dimension(names), "k", "left").select("doc_id", E.display_name(F.col("source"), F.col("n_name"), "9").alias("name"))


PATH_RULES = [("site1", "first"), ("site2", "second"), ("http", "other")]


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(url), '{a}') THEN '{b}'" for a, b in PATH_RULES) + " ELSE '' END AS grp FROM pages")
def path_groups(spark, d):
    return table(spark, d, "pages").select("page_id", E.by_substring(F.col("url"), PATH_RULES).alias("grp"))


@query(r"SELECT page_id, coalesce(string_split(url, '/')[-2], '') AS category, trim(regexp_replace(regexp_replace(regexp_replace(string_split(url, '/')[-1], '\.[A-Za-z0-9]+$', ''), '_output$', ''), '[_-]+', ' ', 'g')) AS subtopic FROM pages")
def path_topics(spark, d):
    category, subtopic = E.path_topic(F.col("url"))
    return table(spark, d, "pages").select("page_id", category.alias("category"), subtopic.alias("subtopic"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END), ''), nullif(trim(source), ''), '') AS value FROM documents")
def first_filled_column(spark, d):
    first = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return _docs(spark, d).select("doc_id", E.filled(first, F.col("source")).alias("value"))


@query("SELECT c.c_custkey, c.c_mktsegment, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END), ''), nullif(trim(s_name), ''), '') AS name FROM customer c LEFT JOIN supplier ON s_suppkey = c_custkey")
def enrich_blanks(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("name"))
    side = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    return E.fill_blanks(rows, side, "c_custkey", ["name"])


@query("""WITH f AS (SELECT unnest(list_distinct([md5(coalesce(lang, '') || '-' || source), md5(source)])) AS id, doc_id, nullif(trim(lang), '') AS lang, nullif(trim(source), '') AS source FROM documents)
SELECT id, coalesce(arg_min(lang, doc_id) FILTER (lang IS NOT NULL), '') AS lang, coalesce(arg_min(source, doc_id) FILTER (source IS NOT NULL), '') AS source FROM f GROUP BY 1""")
def id_fanout(spark, d):
    ids = F.array(F.md5(F.concat(F.coalesce("lang", F.lit("")), F.lit("-"), "source")), F.md5("source"))
    return E.first_filled_by_id(_docs(spark, d), ids, {"lang": F.col("lang"), "source": F.col("source")}, "doc_id")


@query(f"""WITH {FULL}, {_top('sc', 5, 't')} SELECT query_id, t.doc_id, CASE WHEN regexp_matches(trim(coalesce(url, '')), '^https?://') THEN trim(url) ELSE '' END AS link, md5({Q.replace('text', 'd.text')}) AS question, md5(substr({A.replace('text', 'd.text')}, 1, 1500)) AS answer, round(greatest(0, least(1, score / 100)), 4) AS score
 FROM t JOIN documents d USING (doc_id) LEFT JOIN pages p ON p.page_id = t.doc_id""")
def source_cards(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    rows = V.of_docs(spark, d, _hits(spark, d, 5), "text").join(E.dimension(pages), "doc_id", "left")
    t = F.col("text")
    card = E.source_card([F.lit(""), F.col("url")], T.question_of(t), T.answer_of(t), F.col("score") / 100)
    return rows.select("query_id", "doc_id", *[(F.md5(c) if n in ("question", "answer") else c).alias(n) for n, c in card.items()])


@query(f"WITH {RECORDS}, lk AS (SELECT id, category, md5(question) AS q FROM rec WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT r.id AS leaf, coalesce(lk.category, 'missing') AS category, lk.q AS question FROM rec r LEFT JOIN lk USING (id)")
def lookup_leaves(spark, d):
    """Leaves of the tree, the ids of all records, with what a lookup of the good ones holds of them; a leaf that it lacks stays."""
    rec = R.unified(_docs(spark, d))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    lookup = rec.join(good, "doc_id", "left_semi").select(F.col("id").alias("leaf"), "category", F.md5("question").alias("question"))
    return rec.select(F.col("id").alias("leaf")).join(lookup, "leaf", "left").select("leaf", F.coalesce("category", F.lit("missing")).alias("category"), "question")


@query(f"WITH {RECORDS} SELECT id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Q: ' || question || ' A: ' || answer END) AS body, category FROM rec")
def docs_from_metadata(spark, d):
    r = R.unified(_docs(spark, d))
    meta = F.to_json(F.struct("question", "answer", "category", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("text")))
    back = r.select("id", F.from_json(meta, "question string, answer string, category string, text string").alias("m"))
    body = F.coalesce(F.nullif("m.text", F.lit("")), F.concat(F.lit("Q: "), "m.question", F.lit(" A: "), "m.answer"))
    return back.select("id", F.md5(body).alias("body"), "m.category")


@query("SELECT doc_id, CASE WHEN n > 0 THEN 'own' WHEN source IS NOT NULL THEN 'source' ELSE 'none' END AS origin, coalesce(own, source, '') AS src FROM (SELECT doc_id, source, count(quality) AS n, max('q' || quality) AS own FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)")
def candidate_origin(spark, d):
    own = table(spark, d, "labels").where("quality is not null").groupBy("doc_id").agg(F.max(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("own"))
    rows = _docs(spark, d).select("doc_id", "source").distinct().join(own, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("own").isNotNull(), "own").when(F.col("source").isNotNull(), "source").otherwise("none").alias("origin"), F.coalesce("own", "source", F.lit("")).alias("src"))


# ---- filters and cuts after ranking ------------------------------------------------------

HIT_DOCS = f"{FULL}, {_top('sc', 60, 't')}, hd AS (SELECT t.*, lang, source, text FROM t JOIN documents USING (doc_id))"


def _hit_docs(spark, d, k=60):
    return V.of_docs(spark, d, _hits(spark, d, k), "lang", "source", "text")


@query(f"WITH {HIT_DOCS} SELECT query_id, doc_id, rank FROM hd WHERE lang = 'en' AND rank <= 30")
def category_after_topk(spark, d):
    return _hit_docs(spark, d, 30).where("lang = 'en'").select("query_id", "doc_id", "rank")


SPELLINGS = [("romance", ["fr", "es"]), ("germanic", ["en", "de"])]


@query(f"WITH {HIT_DOCS} SELECT query_id, doc_id FROM hd WHERE lang IN ('fr', 'es') AND rank <= 30")
def canonical_group_filter(spark, d):
    return _hit_docs(spark, d, 30).where(T.canonical(F.col("lang"), SPELLINGS) == "romance").select("query_id", "doc_id")


@query(f"WITH {HIT_DOCS}, w AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'mixed' WHEN 2 THEN '' ELSE 'de' END AS wanted FROM benchmark) SELECT query_id, doc_id, wanted FROM hd JOIN w USING (query_id) WHERE rank <= 30 AND (wanted IN ('mixed', 'unknown', '') OR lang = wanted)")
def corpus_language_filter(spark, d):
    q = F.col("query_id") % 4
    rows = _hit_docs(spark, d, 30).withColumn("wanted", F.when(q == 0, "en").when(q == 1, "mixed").when(q == 2, "").otherwise("de"))
    return rows.where(F.col("wanted").isin("mixed", "unknown", "") | (F.col("lang") == F.col("wanted"))).select("query_id", "doc_id", "wanted")


@query(f"WITH {HIT_DOCS}, p AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hd WHERE lang = 'en' AND rank <= 15) SELECT query_id, doc_id, r AS rank FROM p WHERE r <= 5")
def overfetch_then_filter(spark, d):
    return E.overfetch(_hit_docs(spark, d), 5, 3, F.col("lang") == "en").select("query_id", "doc_id", "rank")


@query(f"WITH {HIT_DOCS}, p AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) AS r FROM hd WHERE rank <= 15), s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM p WHERE r = 1) SELECT query_id, doc_id, rank FROM s WHERE rank <= 5")
def overfetch_then_dedupe(spark, d):
    rows = R.keep_first(_hit_docs(spark, d, 15), F.md5("text"), ["rank"], ["query_id"])
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "doc_id", "rank")


@query(f"WITH {HIT_DOCS}, b AS (SELECT query_id, max(score) AS best FROM hd GROUP BY 1), p AS (SELECT hd.query_id, doc_id, floor(score) AS s, floor(best) AS best FROM hd JOIN b USING (query_id)), m AS (SELECT *, s >= greatest(1, floor(best * 0.25::DOUBLE)) AS o FROM p WHERE best > 0), n AS (SELECT *, count(*) FILTER (o) OVER (PARTITION BY query_id) AS n FROM m) SELECT query_id, doc_id FROM n WHERE n < 24 OR o")
def prune_weak(spark, d):
    return E.prune(_hits(spark, d, 60).withColumn("s", F.floor("score")), "s").select("query_id", "doc_id")


@query(f"WITH {FULL}, {_top('sc', 400, 't')} SELECT query_id, count(*) AS pool, count(*) FILTER (rank <= 36) AS fast_pool FROM t GROUP BY 1")
def pool_sizes(spark, d):
    k = 6
    t = _hits(spark, d, max(40 * k, 400))
    return t.groupBy("query_id").agg(F.count("*").alias("pool"), F.count_if(F.col("rank") <= max(6 * k, 30)).alias("fast_pool"))


@query(f"WITH {HIT_DOCS} SELECT query_id, doc_id, round(greatest(0, least(1, score / 100) - 0.04::DOUBLE * (rank - 1)), 6) AS by_rank, round(greatest(0, 0.55::DOUBLE - 0.03::DOUBLE * (rank - 1)), 6) AS unscored, greatest(20, 90 - 15 * (rank - 1))::INT AS page FROM hd WHERE rank <= 12")
def rank_decays(spark, d):
    r, s = F.col("rank"), F.least(F.lit(1.0), F.col("score") / 100)
    return _hits(spark, d, 12).select("query_id", "doc_id", F.round(E.decay(0, 0.04, 0.0, r, s), 6).alias("by_rank"), F.round(E.decay(0.55, 0.03, 0.0, r), 6).alias("unscored"), E.decay(90, 15, 20, r).cast("int").alias("page"))


@query(f"WITH {HIT_DOCS}, q AS (SELECT item_id AS query_id, {ASKED} AS terms FROM benchmark) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, score DESC, doc_id) AS place FROM (SELECT hd.query_id, doc_id, score, len(list_filter(terms, lambda x: contains(lower({Q}), x))) AS hits FROM hd JOIN q USING (query_id) WHERE rank <= 20)")
def anchor_order(spark, d):
    rows = _hit_docs(spark, d, 20).join(_bench(spark, d).select("query_id", _asked(F.col("query")).alias("terms")), "query_id")
    hits = F.size(F.filter("terms", lambda x: F.contains(F.lower(T.question_of(F.col("text"))), x)))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("score"), "doc_id")
    return rows.withColumn("hits", hits).select("query_id", "doc_id", F.row_number().over(w).alias("place"))


@query("SELECT lang, doc_id, title, place FROM (SELECT lang, doc_id, title, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, title, doc_id) AS place FROM (SELECT lang, doc_id, n_chars, substr(" + Q + ", 1, 40) AS title FROM documents)) WHERE place <= 100")
def top_titles(spark, d):
    rows = _docs(spark, d).select("lang", "doc_id", "n_chars", F.substring(T.question_of(F.col("text")), 1, 40).alias("title"))
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "title", "doc_id")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 100").select("lang", "doc_id", "title", "place")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 150")
def sampled_titles(spark, d):
    return E.sample_by_hash(_docs(spark, d), "doc_id", 42, 150, "lang").select("lang", "doc_id")


@query("SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS place FROM documents")
def record_order(spark, d):
    w = Window.partitionBy("lang", "source").orderBy("n_chars", "doc_id")
    return _docs(spark, d).select("lang", "source", "doc_id", F.row_number().over(w).alias("place"))


@query("WITH c AS (SELECT p_brand AS query_id, p_type AS category, sum(CASE WHEN p_size > 40 THEN 1 ELSE 0 END)::BIGINT AS s FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, category) AS rank FROM c) SELECT query_id, category, s, rank FROM r WHERE rank <= 3 AND (s > 0 OR rank = 1)")
def top_categories(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("query_id"), F.col("p_type").alias("category")).agg(F.count_if(F.col("p_size") > 40).alias("s"))
    return E.best_or_first(c, ["query_id"], "s", "category", 3).select("query_id", "category", "s", "rank")


@query("SELECT conv_id, list_sort(list(turn)) = range(0, count(*)::BIGINT) AS complete FROM conversations GROUP BY 1")
def turn_permutation(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list((F.col("turn") + 1).cast("int")).alias("o"), F.count("*").cast("int").alias("n"))
    return c.select("conv_id", E.is_permutation(F.col("o"), F.col("n")).alias("complete"))


@query("WITH p AS (SELECT item_id AS query_id, unnest([item_id * 7, item_id, item_id * 7, 10000000, item_id + 3]) AS doc_id, unnest([1, 2, 3, 4, 5]) AS pos FROM benchmark), f AS (SELECT query_id, doc_id, min(pos) AS pos FROM p SEMI JOIN documents d ON p.doc_id = d.doc_id GROUP BY 1, 2), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM f) SELECT query_id, doc_id, rank FROM r WHERE rank <= 3")
def validated_picks(spark, d):
    i = F.col("item_id")
    picks = table(spark, d, "benchmark").select(i.alias("query_id"), F.array(i * 7, i, i * 7, F.lit(10_000_000).cast("long"), i + 3).alias("picks"))
    return E.picked(picks, _docs(spark, d), "doc_id", 3)


@query("""WITH RECURSIVE r AS (SELECT doc_id, coalesce(length(text), 0) AS l, row_number() OVER (ORDER BY doc_id) AS pos FROM documents),
b AS (SELECT pos, doc_id, 0::BIGINT AS batch_id, 1 AS n, l AS held FROM r WHERE pos = 1 UNION ALL
 SELECT r.pos, r.doc_id, CASE WHEN b.n = 100 OR b.held + r.l > 120000 THEN b.batch_id + 1 ELSE b.batch_id END, CASE WHEN b.n = 100 OR b.held + r.l > 120000 THEN 1 ELSE b.n + 1 END,
  CASE WHEN b.n = 100 OR b.held + r.l > 120000 THEN r.l ELSE b.held + r.l END FROM b JOIN r ON r.pos = b.pos + 1)
SELECT batch_id, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM b GROUP BY 1""")
def char_batches(spark, d):
    """Batches of at most 100 documents and 120,000 characters, cut greedily in the order of their ids."""
    rows = _docs(spark, d).select("doc_id", F.length("text").alias("l"))
    b = greedy.batches(rows, [F.col("doc_id").asc()], "l", most=100, limit=120_000)
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"WITH {HIT_DOCS}, q AS (SELECT item_id AS query_id, {ASKED} AS terms FROM benchmark) SELECT query_id, count(*) FILTER (len(list_filter(terms, lambda x: contains(lower({Q} || ' ' || substr({A}, 1, 800) || ' ' || source), x))) > 0) AS relevant FROM hd JOIN q USING (query_id) WHERE rank <= 3 GROUP BY 1")
def source_relevance(spark, d):
    rows = _hit_docs(spark, d, 3).join(_bench(spark, d).select("query_id", _asked(F.col("query")).alias("terms")), "query_id")
    t = F.col("text")
    return E.relevant_sources(rows, F.concat_ws(" ", T.question_of(t), F.substring(T.answer_of(t), 1, 800), "source"), F.col("terms"))


# ---- texts -------------------------------------------------------------------------------


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2) AS w FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, unnest(range(1, len(w))) AS i FROM w), f AS (SELECT doc_id, g, min(i) AS i FROM p GROUP BY 1, 2),
a AS (SELECT doc_id, string_agg(g, '|' ORDER BY i) AS s FROM f GROUP BY 1) SELECT doc_id, CASE WHEN w IS NOT NULL THEN md5(coalesce(s, '')) END AS pairs FROM w LEFT JOIN a USING (doc_id)""")
def ordered_bigrams(spark, d):
    # the words in a column of their own: inside the pairs' function they would be split again for every pair
    rows = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), F.md5(F.array_join(T.bigrams(F.col("w")), "|"))).alias("pairs"))


@query(f"WITH {RECORDS}, b AS (SELECT item_id AS doc_id, text AS query FROM benchmark) SELECT doc_id, md5(CASE WHEN coalesce(query, '') = '' OR query = question THEN question WHEN question = '' THEN query ELSE query || chr(10) || question END) AS target FROM rec LEFT JOIN b USING (doc_id)")
def preprocess_target(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("query"))
    r = R.unified(_docs(spark, d)).join(E.dimension(q), "doc_id", "left")
    return r.select("doc_id", F.md5(R.target_text(F.col("query"), F.col("question"))).alias("target"))


LAT = "CASE WHEN length(replace(text, ' ', '')) > 0 THEN len(regexp_extract_all(text, '[a-z]'))::DOUBLE / length(replace(text, ' ', '')) ELSE 0 END"


@query(f"SELECT doc_id, {LAT} > 0.6 AND len(regexp_extract_all(text, '[A-Za-z]')) < 300 AS formal FROM documents")
def formal_script(spark, d):
    return _docs(spark, d).select("doc_id", T.is_formal(F.col("text"), "[a-z]", 0.6, 300).alias("formal"))


@query(r"SELECT doc_id, regexp_matches(text, '[A-Za-z]{3,}') AS latin, md5(trim(regexp_replace(regexp_replace(text, '[A-Za-z]{2,}', ' ', 'g'), '\s+', ' ', 'g'))) AS rest FROM documents")
def latin_residue(spark, d):
    return _docs(spark, d).select("doc_id", F.col("text").rlike("[A-Za-z]{3,}").alias("latin"), F.md5(T.strip_latin_words(F.col("text"))).alias("rest"))


TYPOS = [("  ", " "), ("teh", "the"), (" ,", ",")]


@query("SELECT item_id, md5(replace(replace(replace(text, '  ', ' '), 'teh', 'the'), ' ,', ',')) AS fixed FROM benchmark")
def query_typos(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(T.replace_all(F.col("text"), TYPOS)).alias("fixed"))


SNIPPETS = ["license", "copyright", "all rights"]


@query("SELECT doc_id, " + " OR ".join(f"contains(lower({Q}), '{s}')" for s in SNIPPETS) + f" AS boilerplate, md5(lower(concat_ws(' ', nullif(trim(lang), ''), nullif(trim({Q}), ''), nullif(trim(source), '')))) AS hay FROM documents")
def boilerplate_and_haystack(spark, d):
    q = T.question_of(F.col("text"))
    return _docs(spark, d).select("doc_id", T.is_boilerplate(q, SNIPPETS).alias("boilerplate"), F.md5(T.haystack(F.col("lang"), q, F.col("source"))).alias("hay"))


@query("SELECT p_partkey, upper(split_part(p_type, ' ', 1)) <> '' AND (starts_with(upper(trim(p_type)), upper(split_part(p_type, ' ', 1))) OR trim(split_part(upper(trim(p_type)), '-', 1)) = upper(split_part(p_type, ' ', 1))) AS same, starts_with(upper(trim(p_type)), 'SMALL') OR trim(split_part(upper(trim(p_type)), '-', 1)) = 'SMALL' AS small FROM part")
def category_hints(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", T.title_matches(t, F.split_part(t, F.lit(" "), F.lit(1))).alias("same"), T.title_matches(t, F.lit("small")).alias("small"))


@query("SELECT doc_id, CASE WHEN contains(lower(lang), 'fr') OR contains(lower(lang), 'es') THEN 'romance' WHEN contains(lower(lang), 'en') OR contains(lower(lang), 'de') THEN 'germanic' ELSE '' END AS grp FROM documents")
def canonical_groups(spark, d):
    return _docs(spark, d).select("doc_id", T.canonical(F.col("lang"), SPELLINGS).alias("grp"))


@query("SELECT event_id, regexp_extract('Here: ```json' || props || '``` done', '(?s)(\\{.*\\})', 1) AS found, (props->>'k')::INT AS k FROM events")
def json_recovery(spark, d):
    reply = F.concat(F.lit("Here: ```json"), "props", F.lit("``` done"))
    found = table(spark, d, "events").select("event_id", T.first_json(reply).alias("found"))
    return found.select("event_id", "found", F.from_json("found", "k int").k.alias("k"))


@query(f"SELECT event_type, round(greatest(0, least(1, avg(value) / 100)), 6) AS share, repeat('#', round_even(greatest(0, least(1, round(avg(value) / 100, 6))) * 20, 0)::INT) || repeat('.', 20 - round_even(greatest(0, least(1, round(avg(value) / 100, 6))) * 20, 0)::INT) AS bar FROM events GROUP BY 1")
def score_bars(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value") / 100, 6).alias("share"))
    return m.select("event_type", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "share")), 6).alias("share"), T.score_bar(F.col("share")).alias("bar"))


# ---- rule tables -------------------------------------------------------------------------


@query(rf"""WITH g AS (SELECT r_name AS grp, lower(n_name) AS member FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'articles', unnest(['the', 'der', 'le'])),
t AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2)) AS term FROM benchmark), h AS (SELECT DISTINCT query_id, grp FROM t JOIN g ON member = term)
SELECT query_id, term FROM t UNION SELECT query_id, member FROM h JOIN g USING (grp)""")
def synonyms_by_table(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("grp"), F.lower("n_name").alias("member"))
    groups = own.union(spark.range(1).select(F.lit("articles"), F.explode(F.array(F.lit("the"), F.lit("der"), F.lit("le")))))
    terms = _bench(spark, d).select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).distinct()
    return E.expand_by_table(terms, groups)


@query(rf"""WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), m AS (SELECT lower(w[1]) AS src, min(lower(w[len(w)])) AS dst FROM w WHERE len(w) > 0 GROUP BY 1),
t AS (SELECT item_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT item_id AS query_id, md5(string_agg(coalesce(dst, x), ' ' ORDER BY i)) AS mapped FROM t LEFT JOIN m ON lower(x) = src GROUP BY 1""")
def map_by_table(spark, d):
    """A table that maps each passage's first word to its last, over all passages."""
    w = _bench(spark, d).select(T.words(F.col("query")).alias("w")).where(F.size("w") > 0)
    mapping = w.groupBy(F.lower(F.get("w", F.lit(0))).alias("src")).agg(F.min(F.lower(F.element_at("w", -1))).alias("dst"))
    return E.map_by_table(_bench(spark, d), "query_id", F.col("query"), mapping).select("query_id", F.md5("mapped").alias("mapped"))


@query(rf"SELECT item_id, array_to_string(list_slice(list_filter(x, lambda t, i: list_position(x, t) = i), 1, 16), ' ') AS added FROM (SELECT item_id, list_filter(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND t NOT IN {T.STOP_WORDS!r}), lambda t: NOT list_contains(h, t)) AS x FROM (SELECT item_id, text, list_slice(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), 1, 10) AS h FROM benchmark))")
def expansion_cleanup(spark, d):
    raw = F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", F.array_join(C.clean_expansion(F.col("text"), F.slice(raw, 1, 10), 4, 16), " ").alias("added"))


@query(rf"""WITH t0 AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2) AS w FROM benchmark), t AS (SELECT DISTINCT query_id, unnest(w) AS term FROM t0),
df AS (SELECT term, min(query_id) AS grp, count(*) AS n FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3), h AS (SELECT DISTINCT query_id, grp FROM t JOIN df USING (term)),
x AS (SELECT DISTINCT h.query_id, df.term FROM h JOIN df USING (grp) ANTI JOIN t ON t.query_id = h.query_id AND t.term = df.term), c AS (SELECT query_id, count(*) AS added FROM x GROUP BY 1)
SELECT query_id, coalesce(added, 0) AS added, md5(array_to_string(w, ' ')) AS stripped FROM t0 LEFT JOIN c USING (query_id)""")
def strip_added_terms(spark, d):
    """Queries expanded by a table of groups (rare words that occur together first in one passage), and the query for the reranker, without what
    was added."""
    own = written(_bench(spark, d).select("query_id", T.tokens(F.col("query")).alias("w")), "own")
    terms = own.select("query_id", F.explode("w").alias("term")).distinct()
    groups = terms.groupBy("term").agg(F.min("query_id").alias("grp"), F.count("*").alias("n")).where("n between 2 and 3").select("grp", F.col("term").alias("member"))
    more = E.expand_by_table(terms, groups).join(terms, ["query_id", "term"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("plus"))
    both = own.join(more, "query_id", "left").withColumn("plus", F.coalesce("plus", F.array().cast("array<string>")))
    expanded = both.withColumn("expanded", F.concat("w", "plus"))
    return expanded.select("query_id", F.size("plus").cast("long").alias("added"), F.md5(F.array_join(T.strip_trailing(F.col("expanded"), F.col("plus")), " ")).alias("stripped"))


# ---- scorers -----------------------------------------------------------------------------


@query(f"WITH {HIT_DOCS}, q AS (SELECT item_id AS query_id, list_slice({ASKED.replace('list_distinct(', '(')}, 1, 12) AS terms FROM benchmark) SELECT query_id, doc_id, list_sum(list_transform(terms, lambda k: (CASE WHEN contains(lower({Q}), k) THEN 4 WHEN contains(lower(source), k) THEN 3 WHEN contains(lower(text), k) THEN 2 ELSE 0 END + CASE WHEN length(k) >= 5 AND contains(lower(text), k) THEN 1 ELSE 0 END)))::INT AS score, round_even(100.0 * len(list_filter(terms, lambda t: contains(lower(text), t))) / len(terms), 0)::INT AS percent FROM hd JOIN q USING (query_id) WHERE rank <= 10 AND len(terms) > 0")
def keyword_scores(spark, d):
    rows = _hit_docs(spark, d, 10).join(_bench(spark, d).select("query_id", F.slice(T.tokens(F.col("query"), 3, T.STOP_WORDS), 1, 12).alias("terms")), "query_id").where(F.size("terms") > 0)
    t, hay = F.col("terms"), F.lower("text")
    return rows.select("query_id", "doc_id", T.keyword_score(t, F.lower(T.question_of(F.col("text"))), F.lower("source"), hay).alias("score"), T.overlap_percent(t, hay).alias("percent"))


_SH = "CASE WHEN len(q) > 0 THEN len(list_intersect(q, {w}))::DOUBLE / len(q) ELSE 0 END"


@query(rf"""WITH {HIT_DOCS}, q AS (SELECT item_id AS query_id, list_distinct({STOPPED % 'text'}) AS q FROM benchmark), x AS (SELECT query_id, doc_id, q, {STOPPED % Q} AS a, {STOPPED % 'hd.text'} AS b FROM hd JOIN q USING (query_id) WHERE rank <= 10), y AS (SELECT query_id, doc_id, {_SH.format(w='a')} AS oq, {_SH.format(w='b')} AS ot, least(1.0::DOUBLE, len(b) / 100.0::DOUBLE) AS l FROM x)
SELECT query_id, doc_id, CASE WHEN oq > 0 OR ot > 0 THEN round(least(1.5::DOUBLE, 0.70::DOUBLE + 0.45::DOUBLE * oq + 0.20::DOUBLE * ot + 0.04::DOUBLE * l), 6) ELSE 0.25::DOUBLE END AS relevance FROM y""")
def overlap_relevance(spark, d):
    rows = _hit_docs(spark, d, 10).join(_bench(spark, d), "query_id")
    tok = lambda c: T.tokens(c, 2, T.STOP_WORDS)
    return rows.select("query_id", "doc_id", T.overlap_relevance(tok(F.col("query")), tok(T.question_of(F.col("text"))), tok(F.col("text"))).alias("relevance"))


@query("SELECT doc_id, round(100.0::DOUBLE * quality, 1) AS quality_percent, coalesce(nullif(CASE WHEN toxic = 1 THEN 'blocked' ELSE '' END, ''), lang) AS grp FROM labels JOIN documents USING (doc_id)")
def override_and_percent(spark, d):
    rows = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    override = F.when(F.col("toxic") == 1, "blocked").otherwise("")
    return rows.select("doc_id", F.round(100.0 * F.col("quality"), 1).alias("quality_percent"), E.filled(override, F.col("lang")).alias("grp"))
