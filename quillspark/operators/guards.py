"""Guards before and after generation, answer validation, retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T

#: Fixed value: an answer that says there is none.
SENTINEL = "no answer found"


def verdict(name: str, passed: Column, reason: Column) -> Column:
    return F.struct(F.lit(name).alias("guard"), passed.alias("passed"), F.when(passed, "ok").otherwise(reason).alias("reason"))


def query_guard(text: Column, min_words: int = 1, script: str = "[A-Za-z]", least: float = 0.25) -> Column:
    blank, n = F.trim(F.coalesce(text, F.lit(""))) == "", F.size(T.words(text))
    share = T.share_of(text, script)
    return verdict("query", ~blank & (n >= min_words) & (share >= least), F.when(blank, "empty").when(n < min_words, "too_few_words").otherwise("script"))


def context_guards(hits: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, context, confidence): verdicts on the scores of a query's hits."""
    s = hits.groupBy("query_id").agg(F.count_if(F.trim("text") != "").alias("filled"), F.avg("score").alias("mean"), F.max("score").alias("top"))
    context = verdict("context", (F.col("filled") >= 1) & (F.col("mean") >= cfg.min_context), F.when(F.col("filled") < 1, "no_chunks").otherwise("low_mean"))
    return s.select("query_id", context.alias("context"), verdict("confidence", F.col("top") >= cfg.min_top, F.lit("low_top")).alias("confidence"))


def overlap(answer: Column, source: Column) -> Column:
    """Share of the answer's distinct words that its source holds."""
    a, b = F.array_distinct(T.tokens(answer)), F.array_distinct(T.tokens(source))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def overlap_guard(answer: Column, source: Column, cfg: EngineConfig = DEFAULT) -> Column:
    skip = (F.trim(answer) == "") | F.contains(F.lower(answer), F.lit(SENTINEL))
    return verdict("overlap", skip | (overlap(answer, source) >= cfg.min_overlap), F.lit("low_overlap"))


def language_guard(answer: Column, script: str = "[A-Za-zÀ-ÿ]", least: float = 0.40) -> Column:
    return verdict("language", T.share_of(answer, script) >= least, F.lit("script"))


def length_guard(answer: Column, cfg: EngineConfig = DEFAULT) -> Column:
    n = F.size(T.words(answer))
    return verdict("length", (n >= cfg.min_words) & (n <= cfg.max_words), F.when(n < cfg.min_words, "short").otherwise("truncated"))


def first_failure(verdicts: Column) -> Column:
    """The first verdict that did not pass, or null."""
    return F.get(F.filter(verdicts, lambda v: ~v.passed), F.lit(0))


def answer_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user turns with the assistant turn right after."""
    u = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.western_digits(text), F.lit("[0-9]{2,}"), F.lit(0)))


def validate(rows: DataFrame, answer: Column, source: Column) -> DataFrame:
    """rows with scores, ``issues`` (code and severity) and ``valid``: no error among them."""
    ground, script = overlap(answer, source), T.share_of(answer, "[A-Za-zÀ-ÿ]")
    nums = numbers(answer)
    invented = F.size(F.array_except(nums, numbers(source)))
    risk = F.when(F.size(nums) > 0, invented / F.size(nums)).otherwise(0.0)
    n, blank = F.size(T.words(answer)), F.trim(F.coalesce(answer, F.lit(""))) == ""
    issue = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    scored = rows.withColumns({"groundedness": F.round(ground, 6), "script": F.round(script, 6), "risk": F.round(risk, 6), "n_words": n, "invented": invented, "is_blank": blank})
    c, mojibake = F.col, F.regexp_count(answer, F.lit("Ã.|â€")) >= 2
    found = F.array_compact(F.array(
        F.when(c("is_blank"), issue("EMPTY", "error")),
        F.when(~c("is_blank") & (c("groundedness") < 0.08), issue("UNGROUNDED", "error")),
        F.when(~c("is_blank") & c("groundedness").between(0.08, 0.16), issue("LOW_GROUNDEDNESS", "info")),
        F.when(~c("is_blank") & (c("script") < 0.10), issue("WRONG_SCRIPT", "error")),
        F.when(mojibake, issue("MOJIBAKE", "warning")),
        F.when((c("risk") > 0.40) & (c("invented") >= 2), issue("NUMBER_RISK", "warning")),
        F.when(~c("is_blank") & (c("n_words") < 6), issue("WEAK", "warning")),
        F.when(c("n_words") > 1000, issue("LONG", "info")),
    ))
    return scored.withColumn("issues", found).withColumn("valid", ~F.exists("issues", lambda x: x.severity == "error"))


def evaluate(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, first_rank, reciprocal_rank, precision): ``hits(query_id, rank, label)`` against ``truth(query_id, wanted)``."""
    good = F.col("label") == F.col("wanted")
    both = truth.join(hits, "query_id", "left")
    first = F.min(F.when(good, F.col("rank")))
    return both.groupBy("query_id").agg(first.alias("first_rank"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.avg(F.when(F.col("rank").isNotNull(), good.cast("double"))), F.lit(0.0)).alias("precision"))


def keyword_hits(hits: DataFrame, keywords: DataFrame, text: Column) -> DataFrame:
    """(query_id, n_keywords, n_found, coverage): keywords that any hit's text holds."""
    t = F.lower(text)
    pairs = hits.select("query_id", t.alias("t")).join(keywords, "query_id")
    one = pairs.groupBy("query_id", "keyword").agg(F.max(F.contains("t", F.lower("keyword")).cast("int")).alias("hit"))
    return one.groupBy("query_id").agg(F.count("*").alias("n_keywords"), F.sum("hit").alias("n_found"), F.round(F.avg("hit"), 6).alias("coverage"))
