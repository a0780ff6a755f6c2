"""Language identification by interpolated Kneser-Ney character models.

Plan: a hash sample of the labelled rows, bounded by ``docs_per_lang`` and ``bytes_per_lang``, gives character n-gram
counts (counted in the tasks, summed by Spark); the driver turns them into one table per order
of sorted gram hashes with the interpolated log-probability in every language; the tables
(bounded by the sample) are broadcast, and every whole text is scored in bounded pieces.

Words are runs of letters, lower-cased, with ``^`` before and ``$`` after; a context never leaves
its word. A text's cross-entropy in a language is the mean over its symbols; the lowest wins.
It is rejected if that cross-entropy exceeds what texts of the language show that were held out of the fit.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; with
no labelled row at all every text is ``und``; repeated rows get equal results; the columns lang,
source and id never reach the scorer, and other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 5
#: Labelled documents that a language's model is fitted on, about: a hash sample, all where there are fewer.
DOCS_PER_LANG = 2000
#: Bytes of their texts, about: bounds what the driver gathers where documents are books.
BYTES_PER_LANG = 64 << 20
#: One in so many sampled documents of a language calibrates its rejection and is not fitted on; a language of
#: fewer than ten times as many documents is calibrated on the fitted ones.
CALIBRATE = 10
#: Characters scored at a time, which bounds memory for very long texts.
PIECE = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut only where no letter is."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def grams_of(word: str) -> list[str]:
    """The longest n-gram that ends at each symbol of a word."""
    p = f"^{word}$"
    return [p[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(p))]


_B = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hashes(points: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` code points that end at each position of last."""
    h = np.zeros(len(last), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length - 1, -1, -1):
            h = h * _B + points[last - k] + np.uint64(1)
    return _mix(h)


def gram_hash(gram: str) -> int:
    points = np.frombuffer(gram.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return int(_hashes(points, np.array([len(points) - 1]), len(points))[0])


class Model:
    """Kneser-Ney models of all languages over shared sorted hash arrays.

    ``grams[k]``: (sorted hashes, log-probabilities by language) of all k-grams;
    ``contexts[k]``: (sorted hashes, log of the weight given to the lower order) of contexts of k symbols.
    """

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        n = len(self.langs)
        self.limits = np.full(n, np.inf)
        if not n:
            return  # nothing to learn from: every text is undetermined
        by_order: list[list[dict[str, int]]] = []
        for lang in self.langs:
            orders: list[dict[str, int]] = [defaultdict(int) for _ in range(ORDER + 1)]
            for gram, c in counts[lang].items():
                orders[len(gram)][gram] += c  # of the full order, or at a word's start: as counted
            for k in range(ORDER, 1, -1):
                for gram in orders[k]:
                    orders[k - 1][gram[1:]] += 1  # else by how many symbols come before
            by_order.append(orders)
        alphabet = {g for o in by_order for g in o[1]}
        self.base = -math.log(len(alphabet) + 1)
        self.grams: list = [None]
        self.contexts: list = [None] * ORDER
        below: dict[str, list[float]] = {}
        for k in range(1, ORDER + 1):
            union = sorted({g for o in by_order for g in o[k]})
            weights: dict[str, list[float]] = defaultdict(lambda: [1.0] * n)
            probs = {g: (below[g[1:]] if k > 1 else [math.exp(self.base)] * n)[:] for g in union}
            for x, orders in enumerate(by_order):
                table = orders[k]
                if not table:
                    continue
                ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                total, kinds = defaultdict(int), defaultdict(int)
                for g, c in table.items():
                    total[g[:-1]] += c
                    kinds[g[:-1]] += 1
                for ctx in total:
                    weights[ctx][x] = discount * kinds[ctx] / total[ctx]
                for g in union:
                    ctx = g[:-1]
                    if ctx in total:
                        probs[g][x] = max(table.get(g, 0) - discount, 0) / total[ctx] + weights[ctx][x] * probs[g][x]
            below = probs
            self.grams.append(self._sorted(probs, n))
            self.contexts[k - 1] = self._sorted(weights, n) if k > 1 else (np.empty(0, np.uint64), np.array([[math.log(w) for w in weights[""]]]))

    @classmethod
    def of(cls, state: dict) -> Model:
        """From the plain arrays that a broadcast carries."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    @staticmethod
    def _sorted(table: dict[str, list[float]], n: int) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([gram_hash(g) for g in table], np.uint64)
        values = np.log(np.array(list(table.values()), np.float64).reshape(-1, n))
        order = np.argsort(keys)
        return keys[order], values[order].astype(np.float32)

    def _find(self, table: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities by language, and symbols, of each word."""
        clean = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words]
        text = "".join(f"^{w}$" for w in clean)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter((len(w) + 2 for w in clean), np.int64, len(clean))
        start = np.cumsum(size) - size
        within = np.arange(len(points)) - np.repeat(start, size)
        logp = np.zeros((len(points), len(self.langs)), np.float32)
        length = np.minimum(within + 1, ORDER)
        for k in range(ORDER, 1, -1):
            at = np.flatnonzero((length == k) & (within > 0))
            if not len(at):
                continue
            hit, where = self._find(self.grams[k], _hashes(points, at, k))
            logp[at[hit]] += self.grams[k][1][where[hit]]
            miss = at[~hit]
            if len(miss):
                known, where = self._find(self.contexts[k - 1], _hashes(points, miss - 1, k - 1))
                logp[miss[known]] += self.contexts[k - 1][1][where[known]]
                length[miss] = k - 1
        at = np.flatnonzero((length == 1) & (within > 0))
        if len(at):
            hit, where = self._find(self.grams[1], _hashes(points, at, 1))
            logp[at[hit]] += self.grams[1][1][where[hit]]
            logp[at[~hit]] += self.contexts[0][1][0].astype(np.float32) + np.float32(self.base)
        sums = np.add.reduceat(logp, start, axis=0, dtype=np.float64) if len(clean) else np.zeros((0, len(self.langs)))
        symbols = np.where(size > 2, size - 1, 0)
        return sums * (symbols > 0)[:, None], symbols

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a symbol) of each text in each language, and its symbols."""
        total = np.zeros((len(texts), len(self.langs)))
        symbols = np.zeros(len(texts), np.int64)
        index: dict[str, int] = {}
        owner, lens, ids, held = [], [], [], 0

        def flush() -> None:
            nonlocal held
            if ids:
                sums, n = self.score_words(list(index))
                at = np.cumsum([0, *lens[:-1]])
                pick = np.concatenate(ids)
                np.add.at(total, owner, np.add.reduceat(sums[pick], at, axis=0))
                np.add.at(symbols, owner, np.add.reduceat(n[pick], at))
            index.clear(), owner.clear(), lens.clear(), ids.clear()
            held = 0

        for k, text in enumerate(texts):
            for piece in pieces(text or ""):
                found = words_of(piece)
                if found:
                    ids.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found)))
                    owner.append(k), lens.append(len(found))
                held += len(piece)
                if held >= PIECE:
                    flush()
        flush()
        return -total / np.maximum(symbols, 1)[:, None], symbols

    def calibrate(self, means: dict[str, tuple[float, float]]) -> None:
        """Rejection: above the mean of a language's own calibration texts by ten deviations or three quarters, whichever is more."""
        for x, lang in enumerate(self.langs):
            if lang in means:
                mean, dev = means[lang]
                self.limits[x] = mean + max(10 * dev, 0.75 * mean)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text. Short texts get a wider limit."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce, n = self.entropies(texts)
        best = ce.argmin(axis=1)
        lowest = ce[np.arange(len(best)), best]
        share = 1 / np.exp(-np.minimum(4 * (ce - lowest[:, None]), 700)).sum(axis=1) ** -1
        limit = self.limits[best] * (1 + 2 / np.sqrt(np.maximum(n, 1)))
        fit = 1 / (1 + np.exp(np.clip(4 * (lowest - limit), -50, 50)))
        rejected = (n == 0) | (lowest > limit)
        score = np.where(n == 0, 0.0, np.clip(fit / share, 0, 1))
        return [self.langs[b] if k else "und" for b, k in zip(best, n)], score, rejected


def train(docs: DataFrame, text_col: str, lang_col: str, id_col: str, usable: Column, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG) -> Model:
    """Fits on the usable rows with text and language: all, or a hash sample of about docs_per_lang documents and
    at most about bytes_per_lang bytes for each language; a tenth of the sample calibrates the rejection."""
    rows = docs.where(usable).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("language sample")).alias("h"))
    have = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.count("*"), F.sum(F.octet_length("text"))).collect()}
    chosen, aside = F.lit(False), F.lit(False)
    for lang, (n, size) in sorted(have.items()):
        share = min(docs_per_lang / n, bytes_per_lang / max(size, 1))
        if min(n, share * n) >= 10 * CALIBRATE:
            aside = aside | (F.col("lang") == lang)
        bound = math.floor((2 * share - 1) * 2**63) if share < 1 else 2**63 - 1
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= bound))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in pieces(text.as_py()):
                    words[lang].update(w for w in words_of(piece) if w.isalpha())
            out = []
            for lang, found in words.items():
                grams: Counter = Counter()
                for w, c in found.items():
                    for g in grams_of(w):
                        grams[g] += c
                out += [(lang, g, c) for g, c in grams.items()]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "gram", "n"])

    held = aside & (F.pmod(F.xxhash64("h"), F.lit(CALIBRATE)) == 0)
    sample = rows.where(chosen).select("lang", "text", held.alias("held"))
    counted = sample.where("not held").select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in zip(*counted.toArrow().to_pydict().values()):
        counts[lang][gram] = n
    model = Model(counts)
    if model.langs:
        shared = docs.sparkSession.sparkContext.broadcast(vars(model))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Model.of(shared.value)
            for batch in batches:
                ce, n = m.entropies(batch.column(1).to_pylist())
                at = {x: k for k, x in enumerate(m.langs)}
                lang = batch.column(0).to_pylist()
                keep = [k for k, x in enumerate(lang) if n[k] >= 50 and x in at]
                own_ce = [float(ce[k, at[lang[k]]]) for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array([lang[k] for k in keep], pa.string()), pa.array(own_ce, pa.float64()), batch.column(2).take(pa.array(keep, pa.int64()))], names=["lang", "ce", "held"])

        means = sample.mapInArrow(own, "lang string, ce double, held boolean").groupBy("lang", "held").agg(F.avg("ce").alias("m"), F.coalesce(F.stddev_pop("ce"), F.lit(0.0)).alias("d"))
        # held-out rows come last and take the place of the fitted ones
        model.calibrate({r.lang: (r.m, r.d) for r in sorted(means.collect(), key=lambda r: r.held)})
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with ``<prefix>pred``, ``<prefix>score`` and ``<prefix>rejected`` after its own columns;
    columns of docs that have these names already give way."""
    added = [f"{prefix}{x}" for x in ("pred", "score", "rejected")]
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(shared.value)
        for batch in batches:
            lang, score, rejected = m.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *added])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, "text", "lang", "doc_id", ~held_out())
    done = identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
