"""Many keywords against many texts: an automaton over a table of rules.

``rules(pattern, value, priority)`` may have tens of thousands of rows. Their patterns become one automaton that passes over a text
once, however many there are; it is built once a worker, from rules that are sent to the tasks after a check of their bytes. Larger tables of rules are
joined instead: every run of tokens of a text that is as long as some pattern meets the rules by equality.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import small

#: Bytes of rules that an automaton is built from.
RULE_BYTES = 32 << 20
WORD = re.compile(r"\w")

#: Automata of a worker process, by what they were built from.
_BUILT: dict[str, object] = {}


def cleaned(rules: DataFrame) -> DataFrame:
    """``(pattern, value, priority)``: lower-cased and trimmed, blank ones left out; of a pattern that occurs again the rule of least priority
    and then least value."""
    rows = rules.select(F.lower(F.trim("pattern")).alias("pattern"), F.col("value").cast("string").alias("value"), F.coalesce(F.col("priority").cast("long"), F.lit(0)).alias("priority"))
    best = F.min(F.struct("priority", "value"))
    return rows.where("pattern != '' and value is not null").groupBy("pattern").agg(best.alias("b")).select("pattern", "b.value", "b.priority")


def matches(docs: DataFrame, id_col: str, text: Column, rules: DataFrame, *, whole_tokens: bool = True) -> DataFrame:
    """``(id, pattern, value, priority, n, first)``: every rule that a text holds, how often, and the place of the first, from 1, in characters of the lower-cased text.

    ``whole_tokens``: no letter, digit or underscore stands right before or after; matches may overlap. Nulls hold nothing."""
    ready = cleaned(rules)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("text"))
    if not small(ready, RULE_BYTES):
        if not whole_tokens:
            raise ValueError("so many rules can only be joined by whole tokens")
        return joined(texts, ready)
    rows = sorted((r.pattern, r.value, r.priority) for r in ready.collect())  # bytes checked
    id_type = texts.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        name = f"{len(rows)} {hash(tuple(rows))}"
        if name not in _BUILT:
            _BUILT.clear()
            automaton = ahocorasick.Automaton()
            for k, (pattern, _, _) in enumerate(rows):
                automaton.add_word(pattern, k)
            if rows:
                automaton.make_automaton()
            _BUILT[name] = automaton
        automaton = _BUILT[name]
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row, value in enumerate(batch.column(1)):
                found: dict[int, list[int]] = {}
                text = value.as_py() or ""
                for end, k in automaton.iter(text) if rows else ():
                    start = end + 1 - len(rows[k][0])
                    if not whole_tokens or not (start and WORD.match(text[start - 1])) and not (end + 1 < len(text) and WORD.match(text[end + 1])):
                        found.setdefault(k, []).append(start)
                out += [(row, k, len(at), at[0] + 1) for k, at in found.items()]
            at, k, n, first = zip(*out) if out else ((), (), (), ())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([rows[x][0] for x in k], pa.string()), pa.array([rows[x][1] for x in k], pa.string()), pa.array([rows[x][2] for x in k], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(first, pa.int64())], names=["id", "pattern", "value", "priority", "n", "first"])

    return texts.mapInArrow(run, f"id {id_type.simpleString()}, pattern string, value string, priority long, n long, first long")


def joined(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by equality, for patterns of tokens parted by single blanks: runs of a text's tokens as long as a pattern may be."""
    lengths = sorted(r[0] for r in rules.select(F.size(F.split("pattern", " "))).distinct().collect())  # one row for each number of tokens
    rows = texts.select("id", "text", F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)).alias("t"))

    def of(n: int) -> Column:
        places = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(F.col("t"), i, n), " "))

    runs = F.flatten(F.array(*[of(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    flat = rows.select("id", "text", F.explode_outer(F.array_distinct(runs)).alias("pattern")).where("pattern is not null")
    hit = flat.join(rules, "pattern")
    # a run counts where its tokens are parted by single blanks in the text as well
    at = F.concat(F.lit(r"(?U)(?<!\w)"), F.lit(r"\Q"), F.col("pattern"), F.lit(r"\E"), F.lit(r"(?!\w)"))
    n = F.regexp_count("text", at).cast("long")
    first = F.regexp_instr("text", at).cast("long")
    return hit.select("id", "pattern", "value", "priority", n.alias("n"), first.alias("first")).where("n > 0")


def best(found: DataFrame) -> DataFrame:
    """``(id, value, pattern)``: of each text the match of least priority, then the first, then the longest."""
    order = F.struct("priority", "first", (-F.length("pattern")).alias("l"), "pattern", "value")
    return found.groupBy("id").agg(F.min(order).alias("b")).select("id", "b.value", "b.pattern")


def assigned(docs: DataFrame, id_col: str, text: Column, rules: DataFrame, default: str, **how) -> DataFrame:
    """``(id, value)`` of every row of docs with different ids: its best rule's value, else the default."""
    return docs.select(F.col(id_col).alias("id")).join(best(matches(docs, id_col, text, rules, **how)), "id", "left").select("id", F.coalesce("value", F.lit(default)).alias("value"))
