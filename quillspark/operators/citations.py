"""Citations of an answer checked against the sources that it was given.

A mark is ``[n]`` or ``[n, m]``, the places of sources from 1, or ``(source: Title)``, a source's title whatever its case. A mark belongs to the
sentence that it stands in or right after. It is unknown if no source has the place or title, and wrong if the sentence shares less than
``SUPPORT`` of its different words with the source that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Share of a sentence's words that a source it cites has at least.
SUPPORT = 0.5
PLACES, TITLE, EVERY = r"\[([0-9]{1,3}(?: *, *[0-9]{1,3})*)\]", r"\(source: *([^()]{1,200})\)", r"\[[0-9, ]{1,40}\]|\(source: *[^()]{1,200}\)"
#: A sentence with the marks that follow it.
SENTENCE = r"[^.?!\n]*(?:[.?!]+(?:\s*\[[0-9, ]{1,40}\]|\s*\(source: *[^()]{1,200}\))*|\n|$)"


def marks(answers: DataFrame) -> DataFrame:
    """``(query_id, sentence, place, title, words)`` of answers(query_id, answer): a row for each mark, with the different words of its sentence."""
    s = answers.select("query_id", F.posexplode(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(f"({SENTENCE})"), F.lit(1))).alias("sentence", "s"))
    s = s.withColumn("words", F.array_distinct(T.tokens(F.regexp_replace("s", EVERY, " "))))
    places = F.flatten(F.transform(F.regexp_extract_all("s", F.lit(PLACES), F.lit(1)), lambda m: F.split(m, " *, *")))
    none = F.lit(None)
    found = F.concat(
        F.transform(places, lambda p: F.struct(p.cast("int").alias("place"), none.cast("string").alias("title"))),
        F.transform(F.regexp_extract_all("s", F.lit(TITLE), F.lit(1)), lambda t: F.struct(none.cast("int").alias("place"), F.lower(F.trim(t)).alias("title"))),
    )
    return s.select("query_id", "sentence", "words", F.explode(found).alias("m")).select("query_id", "sentence", "m.place", "m.title", "words").distinct()


def checked(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``(query_id, n_sources, n_marks, cited, unknown, wrong, citation_score, codes)`` of every answer.

    ``sources(query_id, place, title, text)``: what the answer was made from. The score is 0 without a mark, else half and the other half by the share of
    sources that are cited rightly. Codes: ``MISSING_CITATION``, ``PARTIAL_CITATION``, ``UNKNOWN_CITATION``, ``WRONG_CITATION``."""
    own = sources.select("query_id", "place", F.lower(F.trim("title")).alias("title"), F.array_distinct(T.tokens(F.col("text"))).alias("has"))
    made = marks(answers)
    by_place = made.where("place is not null").join(own.drop("title"), ["query_id", "place"], "left")
    named = own.select("query_id", "title", F.col("place").alias("own"), F.col("has").alias("its"))
    first = named.groupBy("query_id", "title").agg(F.min(F.struct("own", "its")).alias("x")).select("query_id", "title", "x.own", "x.its")
    by_title = made.where("place is null").join(first, ["query_id", "title"], "left").select("query_id", "sentence", F.col("own").alias("place"), "words", F.col("its").alias("has"))
    every = by_place.select("query_id", "sentence", "place", "words", "has").unionByName(by_title)
    shared = F.when(F.size("words") > 0, F.size(F.array_intersect("words", "has")) / F.size("words")).otherwise(1.0)
    every = every.withColumn("state", F.when(F.col("has").isNull(), "unknown").when(shared < SUPPORT, "wrong").otherwise("right"))
    count = every.groupBy("query_id").agg(
        F.count("*").alias("n_marks"), F.countDistinct(F.when(F.col("state") == "right", F.col("place"))).alias("cited"),
        F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_if(F.col("state") == "wrong").alias("wrong"),
    )
    given = sources.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    done = answers.select("query_id").join(given, "query_id", "left").join(count, "query_id", "left").na.fill(0)
    code = lambda name, when: F.when(when, F.lit(name))
    n, m, c = F.col("n_sources"), F.col("n_marks"), F.col("cited")
    codes = F.array_compact(F.array(code("MISSING_CITATION", (m == 0) & (n > 0)), code("PARTIAL_CITATION", (m > 0) & (c < n)), code("UNKNOWN_CITATION", F.col("unknown") > 0), code("WRONG_CITATION", F.col("wrong") > 0)))
    score = F.when(m == 0, 0.0).otherwise(0.5 + F.when(n > 0, 0.5 * c / n).otherwise(0.0))
    return done.select("query_id", "n_sources", "n_marks", "cited", "unknown", "wrong", F.round(score, 3).alias("citation_score"), codes.alias("codes"))


def cited_answer(sources: DataFrame) -> DataFrame:
    """``(query_id, answer)``: the default generator's answer, the first sentence of every source(query_id, place, sentence), each with its mark."""
    part = F.struct("place", F.concat(F.rtrim("sentence"), F.lit(" ["), F.col("place").cast("string"), F.lit("]")).alias("s"))
    parts = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("p"))  # a query's sources: a handful
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x.s), "\n").alias("answer"))
