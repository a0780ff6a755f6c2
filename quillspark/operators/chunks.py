"""Greedy sentence packing with overlap, as an Arrow-batched function (state runs along the sentences)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import DEFAULT, EngineConfig

_END = re.compile(r"(?<=[.!?۔؟\n])\s+")


def pack(text: str | None, most: int, overlap: int) -> list[str]:
    """Chunks of at most ``most`` words: whole sentences while they fit, the next chunk starting with the last
    ``overlap`` words; a sentence that is longer alone is cut into overlapping windows."""
    out: list[str] = []
    held: list[str] = []
    fresh = 0
    for sentence in filter(None, (s.strip() for s in _END.split(text or ""))):
        ws = sentence.split()
        if fresh and len(held) + len(ws) > most:
            out.append(" ".join(held))
            held, fresh = held[-overlap:] if overlap else [], 0
        if len(held) + len(ws) > most:
            held = []
        if len(ws) > most:
            at = 0
            while True:
                out.append(" ".join(ws[at : at + most]))
                if at + most >= len(ws):
                    break
                at += most - overlap
            held, fresh = ws[-overlap:] if overlap else [], 0
            continue
        held, fresh = held + ws, fresh + len(ws)
    if fresh:
        out.append(" ".join(held))
    return out


def chunk(docs: DataFrame, id_col: str, text_col: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(chunk_id, doc, chunk_index, total_chunks, text); texts of one chunk never leave the JVM."""
    most, overlap = int(cfg.chunk_tokens / 1.3), int(cfg.overlap_tokens / 1.3)

    @F.pandas_udf(ArrayType(StringType()))
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack(t, most, overlap))

    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    short = F.size(F.split(squeezed, " ")) <= most
    whole = F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.array(squeezed))
    few = docs.where(short).select(F.col(id_col).alias("doc"), whole.alias("c"))
    many = docs.where(~short).select(F.col(id_col).alias("doc"), packed(text_col).alias("c"))
    rows = few.unionByName(many).select("doc", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "text"))
    return rows.select(F.concat_ws("_", F.col("doc").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc", "chunk_index", "total_chunks", "text")
