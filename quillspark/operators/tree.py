"""Hierarchies: heading trees of pages, category trees of records, keyword navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.sinks import written
from .sizes import small


def headings(pages: DataFrame, id_col: str, html: Column) -> DataFrame:
    """(id, line, level, title) of a page's headings in order."""
    found = F.regexp_extract_all(html, F.lit(r"(<h[1-6][^>]*>[^<]*)"), F.lit(1))
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode_outer(found).alias("line", "h")).where("h is not null")
    title = F.trim(F.regexp_replace("h", r"<[^>]*>", ""))
    return rows.select("id", F.col("line").cast("long"), F.substring("h", 3, 1).cast("int").alias("level"), F.substring(title, 1, 200).alias("title"))


def heading_tree(rows: DataFrame) -> DataFrame:
    """headings with ``parent``: the line of the nearest heading above of a lower level."""
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.greatest(*[F.when(F.lit(level) < F.col("level"), F.max(F.when(F.col("level") == level, F.col("line"))).over(w)) for level in range(1, 6)])
    return rows.withColumn("parent", parent)


def markdown_headings(lines: DataFrame) -> DataFrame:
    """``lines(id, line, text)`` -> (id, line, level, title) outside fenced blocks."""
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(F.when(F.col("text").rlike("^\\s*```"), 1).otherwise(0)).over(w) % 2 == 1
    mark = F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 2), r"<!-- id:[^>]*-->", ""))
    return lines.withColumn("inside", inside).where(~F.col("inside") & (mark != "")).select("id", "line", F.length(mark).alias("level"), title.alias("title"), F.regexp_extract("text", r"<!-- id:\s*(\S+?)\s*-->", 1).alias("ref"))


def nodes(records: DataFrame, levels: list[str]) -> DataFrame:
    """(path, level, n_leaves): every inner node with its record count at any depth, by one rollup."""
    counted = records.rollup(*levels).agg(F.count("*").alias("n_leaves"), F.grouping_id().alias("gid"))
    depth = len(levels) - F.bit_count("gid")
    return counted.select(F.concat_ws("/", *levels).alias("path"), depth.cast("int").alias("level"), "n_leaves").where("level > 0")


def node_terms(records: DataFrame, levels: list[str], text: Column) -> DataFrame:
    """(path, level, term): the words under every node, each once."""
    paths = F.array(*[F.struct(F.concat_ws("/", *levels[: k + 1]).alias("path"), F.lit(k + 1).alias("level")) for k in range(len(levels))])
    flat = records.select(*levels, F.explode_outer(F.array_distinct(T.tokens(text, 3, T.STOP_WORDS))).alias("term")).where("term is not null").distinct()
    return flat.select(F.explode(paths).alias("x"), "term").select("x.path", "x.level", "term").distinct()


def navigate(terms: DataFrame, queries: DataFrame, query_id: str, query_text: Column, widths: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(query_id, path, level, hits, rank): the best nodes of each level under the best of the level above."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(F.array_distinct(T.tokens(query_text, 3, T.STOP_WORDS))).alias("term")).where("term is not null")
    hits = terms.join(asked, "term").groupBy("query_id", "path", "level").agg(F.count("*").alias("hits"))
    out, above = None, None
    for k, width in enumerate(widths, 1):
        here = hits.where(F.col("level") == k)
        if above is not None:
            here = here.withColumn("up", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).join(above.select("query_id", F.col("path").alias("up")), ["query_id", "up"], "left_semi").drop("up")
        w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "path")
        above = here.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width)
        out = above if out is None else out.unionByName(above)
    return out


def descend(terms: DataFrame, queries: DataFrame, query_id: str, query_text: Column, *, beam: int = 3) -> DataFrame:
    """(query_id, level, path, hits, rank, via): the way of every query down a tree of any depth, ``beam`` nodes a level.

    ``terms(path, level, term)``: the words under every node. A frontier of nodes is joined with its children, level by level; children are
    ranked by how many of the query's words they have, ties by path. A query none of whose children has any goes on with the children of its frontier's
    siblings (``via``: ``siblings``); if these have none either, its way ends."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(F.array_distinct(T.tokens(query_text, 3, T.STOP_WORDS))).alias("term")).where("term is not null")
    asked = written(asked, "asked")
    up = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    nodes = written(terms.select("path", "level").distinct().withColumn("up", up("path")).withColumn("upper", up("up")), "nodes")
    depth = nodes.agg(F.max("level")).first()[0] or 0

    def best(pairs: DataFrame, via: str) -> DataFrame:
        """The beam among (query_id, path)."""
        hits = pairs.join(terms, "path").join(asked, ["query_id", "term"]).groupBy("query_id", "level", "path").agg(F.count("*").alias("hits"))
        order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "path")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= beam).withColumn("via", F.lit(via))

    top = nodes.where("level = 1").select("path")
    frontier = written(best(asked.select("query_id").distinct().crossJoin(F.broadcast(top)), "beam"), "frontier") if depth and small(top) else None
    if depth and frontier is None:
        raise ValueError("a tree of so many roots needs a level above them")
    out = frontier
    for level in range(2, depth + 1):
        here = nodes.where(F.col("level") == level)
        own = written(best(here.join(frontier.select("query_id", F.col("path").alias("up")), "up").select("query_id", "path"), "beam"), "own")
        stuck = frontier.join(own.select("query_id").distinct(), "query_id", "left_anti")
        # siblings: whatever stands under the same node above (at the second level, all roots)
        kin = stuck.select("query_id", up("path").alias("upper")).distinct()
        other = written(best(here.join(kin, "upper").select("query_id", "path").distinct(), "siblings"), "siblings")
        frontier = own.unionByName(other)
        out = out.unionByName(frontier)
    return out if out is not None else asked.select("query_id", F.lit(0).alias("level"), F.lit("").alias("path"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("rank"), F.lit("").alias("via")).limit(0)


def assign_group(title: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """The first group with a keyword in the title, else the last group."""
    out = F.lit(groups[-1][0])
    for name, words in reversed(groups):
        out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(title), w)), F.lit(name)).otherwise(out)
    return out


def compact_summary(records: DataFrame, group: list[str], title: Column, samples: int = 3) -> DataFrame:
    """One line for each group: its path, its count and its first titles, kept by a ranked cut."""
    w = Window.partitionBy(*group).orderBy("title", "doc_id")
    first = records.select(*group, "doc_id", title.alias("title")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    shown = first.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x.title), "; ").alias("titles"))
    return records.groupBy(*group).agg(F.count("*").alias("n")).join(shown, group).select(F.format_string("%s (%d): %s", F.concat_ws("/", *group), "n", "titles").alias("line"))
