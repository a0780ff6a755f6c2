"""Token ids: encoding, wavelet-matrix shard files, exact length histograms.

Shard files. Plan: texts are range-partitioned by id and sorted, each task encodes its range and
writes one file; the files' token counts give every shard's first position; the files are read
back for the result. A file is a wavelet matrix: one bit-plane a bit of the ids, from the
highest, where each plane keeps the order of the one above with zeros before ones. Planes are
cut into blocks that are compressed on their own and carry the ones before them, so access,
counts and occurrences read a few blocks.

Defined results: a null text is empty and gives the end id alone (shards) or length 0 (histogram);
documents come in ascending id, null ids first, ties in the order of a hash of their text (which also
parts many rows of one id, or of none, among shards); an empty table gives no file
and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import sys
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Bytes of text for a shard, about; and words that an encoder remembers.
SHARD_BYTES, REMEMBER = 16 << 20, 1_600_000
END_ID = 1


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a vocabulary's settings show if its words can be encoded one by one.
WORDWISE = {
    "normalizer": [r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'],
    "pre_tokenizer": [r"""Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True""", "ByteLevel(add_prefix_space=False"],
}


class Encoder:
    """Whole texts to ids as the tokenizers library gives them, each word encoded once.

    The vocabulary's splitter never joins what white space parts, nor a mark of ``.,;:!?`` that
    ends a word after a letter or digit with that word, and A-Z are lower-cased by it; so a
    text's ids are its words' ids in order. New words are encoded together, with a
    special token between those that are more than letters. Texts with ``<|`` may hold special tokens and go to the library whole,
    as all texts do where the vocabulary's normaliser and splitter are not those of ``WORDWISE``.
    """

    between = "<|endoftext|>"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.kind = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        self.unit = np.dtype(self.kind).itemsize
        self.known: dict[bytes, bytes] = {}
        self.code = "H" if self.kind == "<u2" else "I"
        self.stop = self.lib.token_to_id(self.between)
        self.by_word = self.stop is not None and all(x in str(getattr(self.lib, k)) for k, parts in WORDWISE.items() for x in parts)
        # the byte alphabet of such vocabularies: printable Latin-1 as itself, the other bytes from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.spell = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One of a worker process: what earlier tasks learned stays."""
        held = vars(sys).setdefault("_quillspark_encoders", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _store(self, words, ids, starts: np.ndarray, ends: np.ndarray) -> None:
        data, u = np.array(ids, self.kind).tobytes(), self.unit
        self.known.update(zip(words, (data[i:j] for i, j in zip((starts * u).tolist(), (ends * u).tolist(), strict=True)), strict=True))

    def _learn(self, words: set[bytes]) -> None:
        known, plain, ended = self.known, {}, []
        for w in words:
            text = w.decode("utf-8")
            if len(text) > 1 and text[-1] in ".,;:!?" and text[-2].isalnum():
                body, mark = text[:-1].encode("utf-8"), text[-1:].encode()
                ended.append((w, body, mark))
                for x in (body, mark):
                    if x not in known:
                        plain[x] = None
            else:
                plain[w] = None
        texts = {x: x.decode("utf-8") for x in plain}
        # a word of letters alone is one piece of the splitter and goes to the model as it is, its bytes spelled in the vocabulary's way
        split, spell, pack = self.lib.model.tokenize, self.spell, struct.Struct
        for x, s in texts.items():
            if s.isalpha() and s == s.lower() and (s.isascii() or unicodedata.is_normalized("NFC", s)):
                ids = [k.id for k in split(s if s.isascii() else "".join([spell[c] for c in x]))]
                known[x] = pack(f"<{len(ids)}{self.code}").pack(*ids)
                del plain[x]
        if plain:
            ids = np.array(self.lib.encode_batch_fast([self.between.join(texts[x] for x in plain)], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self.stop)
            self._store(plain, ids, np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(ids)]]))
        for w, body, mark in ended:
            known[w] = known[body] + known[mark]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of ``kind`` for each text, in pieces that bound memory."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < 1 << 20 or end == at):
                size, end = size + len(texts[end] or ""), end + 1
            if len(self.known) > REMEMBER:
                self.known.clear()
            get = self.known.get
            parts, missing = [], set()
            for text in texts[at:end]:
                if not text:
                    parts.append((b"", ()))
                elif "<|" in text or not self.by_word:
                    parts.append((self._whole(text), ()))
                else:
                    words = text.encode("utf-8").lower().split()
                    ids = list(map(get, words))
                    if None in ids:
                        missing.update(w for w, x in zip(words, ids) if x is None)
                        parts.append((ids, words))
                    else:
                        parts.append((b"".join(ids), ()))
            if missing:
                self._learn(missing)
            out += [b"".join([get(w) if x is None else x for w, x in zip(words, ids)]) if words else ids for ids, words in parts]
            at = end
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


# ---- wavelet matrix file -----------------------------------------------------------------

MAGIC = b"WVMX1\n"
#: Bits in a block of a plane.
BLOCK_BITS = 1 << 16


def write_wavelet(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """File bytes: header, document table, block table (offset, ones before), blocks."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1)
    blocks, offsets, before, zeros, at = [], [], [], [], 0
    seq = ids
    for level in range(levels - 1, -1, -1):
        bits = (seq >> level).astype(np.uint8) & 1
        ones = 0
        for k in range(0, len(bits), BLOCK_BITS):
            part = bits[k : k + BLOCK_BITS]
            data = press.compress(np.packbits(part, bitorder="little").tobytes())
            blocks.append(data), offsets.append(at), before.append(ones)
            at += len(data)
            ones += int(part.sum(dtype=np.int64))
        zeros.append(len(bits) - ones)
        mask = bits.view(bool)
        seq = np.concatenate([seq[~mask], seq[mask]])
    docs = press.compress(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + bytes(d is None for d in doc_ids))
    table = np.array([*offsets, at], "<u8").tobytes() + np.array(before, "<u8").tobytes()
    head = struct.pack("<QQQQ", levels, len(ids), len(doc_ids), len(docs)) + np.array(zeros, "<u8").tobytes()
    return MAGIC + head + docs + table + b"".join(blocks)


class WaveletFile:
    """Reads one file: ``access``, ``rank``, ``count``, ``occurrences`` and ``decode``."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet file")
        at = len(MAGIC)
        self.levels, self.n, n_docs, size = struct.unpack_from("<QQQQ", data, at)
        at += 32
        self.zeros = np.frombuffer(data, "<u8", self.levels, at).astype(np.int64)
        at += 8 * self.levels
        docs = zstandard.ZstdDecompressor().decompress(data[at : at + size])
        at += size
        missing = docs[16 * n_docs :]
        self.doc_ids = [None if m else d for d, m in zip(np.frombuffer(docs, "<i8", n_docs).tolist(), missing)]
        self.lengths = np.frombuffer(docs, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.per = -(-self.n // BLOCK_BITS)
        count = self.per * self.levels
        self.offsets = np.frombuffer(data, "<u8", count + 1, at).astype(np.int64)
        self.before = np.frombuffer(data, "<u8", count, at + 8 * (count + 1)).astype(np.int64)
        self.data, self.start, self.held = data, at + 8 * (2 * count + 1), {}

    def _bits(self, level: int, block: int) -> np.ndarray:
        k = level * self.per + block
        if k not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            raw = zstandard.ZstdDecompressor().decompress(self.data[self.start + self.offsets[k] : self.start + self.offsets[k + 1]])
            self.held[k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self.held[k]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, off = divmod(i, BLOCK_BITS)
        if block == self.per:
            return self.n - int(self.zeros[level])
        return int(self.before[level * self.per + block]) + (int(self._bits(level, block)[:off].sum(dtype=np.int64)) if off else 0)

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for level in range(self.levels):
            bit = int(self._bits(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            z = int(self.zeros[level])
            lo, hi = (z + a, z + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        lo, hi = 0, self.per - 1
        row = self.before[level * self.per : (level + 1) * self.per]
        held = row if bit else np.arange(self.per) * BLOCK_BITS - row
        block = int(np.searchsorted(held, k, side="right")) - 1
        bits = self._bits(level, block)[: min(BLOCK_BITS, self.n - block * BLOCK_BITS)]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(held[block])])

    def select(self, token: int, k: int) -> int:
        """Position of a token's k-th occurrence, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.levels - 1, -1, -1):
            z = int(self.zeros[level])
            at = self._select(level, 1, at - z) if at >= z else self._select(level, 0, at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens in order: the planes undone from the lowest up."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = np.concatenate([self._bits(level, k) for k in range(self.per)])[: self.n] if self.n else np.empty(0, np.uint8)
            mask, z = bits.view(bool), int(self.zeros[level])
            up = np.empty_like(out)
            up[~mask], up[mask] = out[:z], out[z:]
            out = up | (bits.astype(out.dtype) << (self.levels - 1 - level))
        return out


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_shards(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``folder/shard-<k>.wvm`` in ascending id and returns the lazy ``(shard, file, n_tokens, n_docs)``
    whose evaluation writes them. Files are moved into place whole, so a task that runs again replaces its own."""
    path = path or vocabulary()
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange(int(n), "id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.shared(path), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        ids, doc_ids, lengths, unit = [], [], [], len(end)
        for batch in batches:
            for d, got in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist())):
                ids.append(got + end), doc_ids.append(d), lengths.append(len(got) // unit + 1)
        if not doc_ids:
            return
        data = write_wavelet(np.frombuffer(b"".join(ids), encoder.kind), doc_ids, lengths)
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/shard-{shard:06d}.wvm"
        with store.open_output_stream(part := f"{base}/.{uuid.uuid4().hex}") as out:
            out.write(data)
        store.move(part, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [f"{folder}/shard-{shard:06d}.wvm"], "n_tokens": pa.array([sum(lengths)], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64())})

    return rows.mapInArrow(run, "shard long, file string, n_tokens long, n_docs long")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files of ``(shard, file, n_tokens)``."""
    first = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.withColumn("first", first).select("file", F.col("first").cast("long"), "shard")  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = _open(name)
                with store.open_input_file(at) as f:
                    file = WaveletFile(f.read())
                ids = file.decode()
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids, pa.int64()), "start": pa.array(starts + first), "n_tokens": pa.array(file.lengths), "ids_crc32": pa.array(crc, pa.int64())})

    width = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(width, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


# ---- length histogram --------------------------------------------------------------------


def length_histogram(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(n_tokens, docs)``: exact, over all rows."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = Encoder.shared(path), Counter()
        for batch in batches:
            found.update(len(ids) // encoder.unit for ids in encoder.encode_many(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(found), pa.int64()), "docs": pa.array(list(found.values()), pa.int64())})

    made = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "n_tokens long, docs long")
    return made.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def length_table(histogram: DataFrame) -> DataFrame:
    """The histogram with sums over it, a row for each length n: documents and tokens of n or more, documents up
    to n and their share, and the tokens kept when every document is cut at n. Only lengths, not
    documents, meet in one task."""
    down = Window.orderBy(F.col("n_tokens").desc())
    up, every = Window.orderBy("n_tokens"), Window.partitionBy()
    t = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    t = t.withColumn("docs_from", F.sum("docs").over(down)).withColumn("tokens_from", F.sum("tokens").over(down)).withColumn("docs_upto", F.sum("docs").over(up))
    t = t.withColumn("share_upto", F.col("docs_upto") / F.sum("docs").over(every))
    kept = F.sum("tokens").over(every) - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return t.withColumn("tokens_kept", kept)


def truncated_totals(table: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits(max_tokens)`` with the tokens kept and documents cut at each: for any limit, from the next longer length.
    Lengths and limits, not documents, are put in one order and passed over once; limits that are null are left out."""
    last = table.agg(F.sum("tokens").alias("all"))
    asked = limits.where("max_tokens is not null").select(F.col("max_tokens").cast("long").alias("max_tokens")).distinct()
    both = table.select(F.col("n_tokens").alias("at"), F.lit(False).alias("asks"), F.struct("docs_from", "tokens_from").alias("x")).unionByName(asked.select(F.col("max_tokens").alias("at"), F.lit(True).alias("asks")), allowMissingColumns=True)
    before = Window.orderBy(F.col("at").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("x", F.last("x", ignorenulls=True).over(before)).where("asks").select(F.col("at").alias("max_tokens"), "x")
    cut = F.coalesce(F.col("x.docs_from"), F.lit(0))
    return near.join(F.broadcast(last)).select("max_tokens", (F.coalesce("all", F.lit(0)) - F.coalesce(F.col("x.tokens_from"), F.lit(0)) + cut * F.col("max_tokens")).alias("tokens_kept"), cut.alias("docs_cut"))


def quantiles(table: DataFrame, shares: DataFrame) -> DataFrame:
    """``shares(q)`` with the shortest length that at least this share of the documents does not exceed."""
    asked = shares.where("q is not null").select(F.col("q").cast("double").alias("at"), F.lit(True).alias("asks")).distinct()
    both = table.select(F.col("share_upto").alias("at"), F.lit(False).alias("asks"), "n_tokens").unionByName(asked, allowMissingColumns=True)
    before = Window.orderBy(F.col("at").desc(), "asks", F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("n_tokens", F.last("n_tokens", ignorenulls=True).over(before)).where("asks and n_tokens is not null").select(F.col("at").alias("q"), "n_tokens")


# ---- registered queries ------------------------------------------------------------------


def op5_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "tokens")
    shards = scratch.write(write_token_shards(docs, scratch.path("wavelet")), "shards")
    return read_token_shards(shards)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
