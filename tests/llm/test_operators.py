"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on the awkward rows:
nulls, blanks, very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare  # noqa: E402

from quillspark.llm import decontaminate, entries, langid, media, mixing, pii, sharding, simhash, suffix_dedup, tokens  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, node long, size long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward(spark):
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.replace(base.split()[50], "changed", 1)
    texts = [base, base, near, None, "", " \t\n", "one", "two words", base.upper(), words(rng, 20000), "x" * 50000, words(rng, 60), "Straße ÉCOLE niño", "١٢٣ !!", base + " " + words(rng, 10)]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 3}" if k % 4 else None, 0 if t is None else len(t), -1, "k", k, 3) for k, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, "no id at all here in this row", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fp(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


# ---- 1 -----------------------------------------------------------------------------------


def test_op1_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    want = np.array([fp(t) for t in docs.text], np.uint64)
    got = entries.queries()["op1_simhash_near_dedup"](spark, sf_dir).toPandas().sort_values("doc_id")
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in want.tolist()]
    near = np.argwhere(np.bitwise_count(want[:, None] ^ want[None, :]) <= 3)
    root = groups(len(want), near.tolist())
    assert got.component_id.tolist() == [docs.doc_id.iloc[r] for r in root]


def test_op1_awkward(spark):
    rows = {(r.id, r.component) for r in simhash.simhash_components(awkward(spark)).collect()}
    assert {(0, 0), (1, 0), (3, 3), (4, 3), (5, 3), (8, 0)} <= rows
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_near_duplicates_brute_force(spark):
    """A chain of edits: links are between neighbours only, and many candidates fall short."""
    rng = random.Random(8)
    base, texts = words(rng, 200).split(), []
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 9, 12])):
            w[rng.randrange(200)] = words(rng, 1)
        texts.append(" ".join(w))
    texts += [words(rng, 40) for _ in range(20)] + [texts[3], None, "", None]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    n = len(texts)
    link = [(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(n, link)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == sorted(set(root))


def test_near_duplicates_awkward(spark):
    docs = awkward(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1 and ids[0] == 1 and not {1, 2, 8, 14} & set(ids) and {9, 10, 11, 12, None} <= set(ids)
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


# ---- 2 -----------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_op2_formats_and_links(spark):
    texts = [
        "card 4111 1111 1111 1111 then 4111111111111111 and 4111-1111-1111-1112",
        "born 2024-02-29 not 2023-02-30 or 29.02.2024 or 31/12/1999 or 12/31/1999",
        "at 192.168.0.1 not 999.1.1.1; ssn 123-45-6789 not 000-12-3456",
        "DE89370400440532013000 but XX00ABCDEFGHIJKLMNOP",
        '+1 (217) 555-7713 not 123-456-7890, a.b@x.example.com and a.b@x.example.com, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" not 04dbebab91ab85687d33eeaaf9ac699e1188f962',
    ]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate([*texts, None, "", "x" * 200000])], "doc_id long, text string, n_card long")
    rows = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    a = re.findall(r"[0-9][0-9 -]{14,}[0-9]", rows[0].text)
    assert luhn(a[0]) and a[0].replace(" ", "") == a[1] and a[1] != "4111111111111111" and a[2] == "4111-1111-1111-1112" and rows[0].n_card == 2
    d = re.findall(r"[0-9/.-]{10}", rows[1].text)
    assert d[1] == "2023-02-30" and ".".join(reversed(d[0].split("-"))) == d[2] and d[3].split("/") == [d[4].split("/")[k] for k in (1, 0, 2)]
    assert re.search(r"at (\d+)\.(\d+)\.(\d+)\.(\d+) not 999\.1\.1\.1; ssn \d{3}-\d\d-\d{4} not 000-12-3456", rows[2].text) and "192.168.0.1" not in rows[2].text
    iban = re.match(r"DE\d{20}", rows[3].text)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "XX00ABCDEFGHIJKLMNOP" in rows[3].text
    m = re.match(r'(\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}) not 123-456-7890, (\S+@\S+\.com) and (\S+@\S+\.com), token = "([0-9a-f]{40})" not 04dbebab91ab85687d33eeaaf9ac699e1188f962$', rows[4].text)
    assert m and m[1] != "+1 (217) 555-7713" and m[2] == m[3] != "a.b@x.example.com" and m[4] != "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert (rows[4].n_email, rows[4].n_phone, rows[4].n_secret) == (2, 1, 1)
    twice = [r.text for r in pii.pseudonymise(df.union(df), "k").where("doc_id = 4").collect()]
    assert twice == [rows[4].text] * 2
    assert rows[5].text is None and rows[6].text == "" and rows[7].text == "x" * 200000
    again = {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}
    assert again[0] != rows[0].text and pii.pseudonymise(df.limit(0), "k").count() == 0


def test_op2_is_a_permutation(spark):
    days = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymise(days, "k").select("text").distinct().count() == 4000
    nums = spark.range(0, 3000).select("id", pii.feistel_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("x"))
    assert nums.select("x").distinct().count() == 3000


# ---- 3 -----------------------------------------------------------------------------------


def check_shards(docs, rows, shards):
    count = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and max(count.values()) - min(count[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op3_law_and_cut(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    rows = entries.queries()["op3_sharding"](spark, sf_dir).collect()
    check_shards(docs, rows, 40)
    text, by_id = dict(zip(docs.doc_id, docs.text)), {r.doc_id: r for r in rows}
    assert all(r.size == len(text[i].encode()) + 16 and r.text_crc32 == zlib.crc32(text[i].encode()) and r.law == "rows" and r.grown_shard is None for i, r in by_id.items())
    together = defaultdict(set)
    for i, t in text.items():
        together[t].add(by_id[i].shard)
    sizes = Counter(text.values())
    assert sum(len(together[t]) > 1 for t in together if 1 < sizes[t] <= 5) == 0


def test_op3_hot_group_and_awkward(spark):
    rows = [(k, "same" if k % 2 else f"t{k}") for k in range(800)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    check_shards(rows, got, 10)
    assert len({r.shard for r in got if r.id % 2}) <= 7
    docs = awkward(spark)
    got = sharding.shard(docs, shards=4).collect()
    check_shards(docs.collect(), got, 4)
    assert {(r.size, r.text_crc32) for r in got if r.id == 3} == {(16, 0)} and sharding.shard(empty(spark)).count() == 0


# ---- 4 -----------------------------------------------------------------------------------


def brute_repeats(texts, n):
    seen = Counter(b[p : p + n] for b in texts for p in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def run_op4(df):
    done = suffix_dedup.remove_repeats(df)
    return sorted((r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in done.collect())


def test_op4_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q, z = make(500), make(399), make(450)
    texts = [p + make(300), make(200) + p, make(50) + p[:420] + make(100) + p[60:], q, make(10) + q + make(10), "a" * 1000, "ab" * 400, None, "", "é" * 300 + z, z + "é" * 300, z, z, make(5000), p[:450] + "X" + p[50:]]
    texts += [make(30) + p[k : k + 430] + make(30) for k in range(0, 60, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run_op4(df) == sorted(brute_repeats([(t or "").encode() for t in texts], 400))


def test_op4_segments_and_awkward(spark, monkeypatch):
    docs = awkward(spark)
    want = sorted(brute_repeats([(r.text or "").encode() for r in docs.collect() if r.doc_id not in (9,)], 400))
    assert run_op4(docs.where("doc_id is null or doc_id <> 9")) == want
    data = bytes(random.Random(1).choices(range(256), k=9000))
    whole = suffix_dedup.anchor_runs(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 2000)
    parts = suffix_dedup.anchor_runs(data)
    assert {(a, g) for a, g in zip(whole[2].tolist(), whole[3].tolist())} == {(a, g) for a, g in zip(parts[2].tolist(), parts[3].tolist())}
    assert run_op4(empty(spark)) == []


# ---- 5, 9 --------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def test_op5_round_trip(spark, sf_dir):
    lib, at = library(), 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = entries.queries()["op5_token_wavelet"](spark, sf_dir).orderBy("doc_id").collect()
    for d, r in zip(docs, got, strict=True):
        ids = [*lib.encode(d.text, add_special_tokens=False).ids, 1]
        assert (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r.doc_id, r.start, r.n_tokens, r.ids_crc32)
        at += len(ids)


def test_encoder_equals_library():
    lib, e = library(), tokens.Encoder(tokens.vocabulary())
    odd = ["a <|endoftext|> b", "It's x. ' s 's. I'M don't.", "a.b ..! x!? $", "İ ΣΣ. é. ñ", "x\x1cy\x85z\xa0w.  q", "!.", "٣.", "½. ²!", "é.", "é.́ ", "", None, "A" * 3000, "word." * 50]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert [np.frombuffer(b, e.kind).tolist() for b in e.encode_many(odd)] == want


def test_wavelet_operations():
    g = np.random.default_rng(1).integers(0, 300, 140_000).astype("<u2")
    w = tokens.WaveletFile(tokens.write_wavelet(g, [1, None], [100_000, 40_000]))
    assert (w.decode() == g).all() and all(w.access(i) == g[i] for i in (0, 5, 65535, 65536, 139_999))
    assert w.count(7) == (g == 7).sum() and w.occurrences(7) == np.flatnonzero(g == 7).tolist() and w.rank(7, 70000) == (g[:70000] == 7).sum()
    assert w.doc_ids == [1, None] and w.count(1 << 20) == 0
    none = tokens.WaveletFile(tokens.write_wavelet(g[:0], [], []))
    assert len(none.decode()) == 0
    with pytest.raises(ValueError):
        tokens.WaveletFile(b"else")


def test_op5_awkward(spark, tmp_path):
    docs = awkward(spark)
    made = tokens.write_token_shards(docs, f"file://{tmp_path}/s", shard_bytes=40_000).persist()
    assert made.count() > 1
    rows = tokens.read_token_shards(made).collect()
    assert len(rows) == docs.count() and sum(r.n_tokens for r in rows) == made.agg(F.sum("n_tokens")).first()[0]
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4, 5)] == [1] * 4
    made.unpersist()
    shards = tokens.write_token_shards(empty(spark), f"file://{tmp_path}/e").persist()
    assert tokens.read_token_shards(shards).count() == 0


def test_op9_histogram(spark, sf_dir):
    lib = library()
    n = np.array([len(lib.encode(r.text, add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    table = entries.queries()["op9_token_counts"](spark, sf_dir)
    for r in table.collect():
        assert (r.docs, r.docs_from, r.tokens_from, r.tokens_kept) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
    for r in tokens.truncated_totals(table, spark.createDataFrame([(0,), (77,), (512,), (10**8,)], "max_tokens long")).collect():
        assert (r.tokens_kept, r.docs_cut) == (np.minimum(n, r.max_tokens).sum(), (n > r.max_tokens).sum())
    for r in tokens.quantiles(table, spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "q double")).collect():
        assert r.n_tokens == np.sort(n)[int(np.ceil(r.q * len(n))) - 1]
    assert tokens.length_table(tokens.length_histogram(empty(spark))).count() == 0
    assert tokens.length_histogram(awkward(spark)).agg(F.sum("docs")).first()[0] == awkward(spark).count()


# ---- 6 -----------------------------------------------------------------------------------


def test_op6_oracle(spark, sf_dir):
    compare(entries.queries()["op6_mixing"](spark, sf_dir), entries.oracle_sql()["op6_mixing"], sf_dir)


def test_op6_targets(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(1000, "a"), (100, "b"), (10, "c"), (500, None), (0, "zero"), (300, "b")])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target = {r.source: (r.source_size, r.target) for r in got}
    total = sum(s for s, _ in target.values())
    assert sum(t for _, t in target.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s for s, t in target.values()) and target["zero"] == (0, 0.0)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 1 for s, (_, t) in target.items())
    docs = awkward(spark)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty(spark)).count() == 0
    assert mixing.repeat_mixed(docs).columns == docs.columns and mixing.repeat_mixed(empty(spark)).count() == 0


# ---- 7 -----------------------------------------------------------------------------------


def test_op7_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    split = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", t.lower()) if x]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    want = set()
    for d in docs:
        have = grams(split(d.text))
        for i in items:
            need = grams(split(i.text))
            if not set(have) & set(need):
                continue
            for a in range(max(1, len(have) - len(need) + 1)):
                both = sum((Counter(have[a : a + len(need)]) & Counter(need)).values())
                if both >= 0.8 * (len(have[a : a + len(need)]) + len(need) - both):
                    want.add((d.doc_id, i.item_id))
                    break
    got = entries.queries()["op7_decontaminate"](spark, sf_dir).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want


def test_op7_edits_and_awkward(spark):
    rng = random.Random(4)
    item = words(rng, 40)
    w = item.split()
    edited = " ".join([*w[:20], "new", *w[21:]])
    far = " ".join([*w[:8], "a", *w[9:16], "b", *w[17:24], "c", *w[25:32], "d", *w[33:]])
    rep = " ".join(["go"] * 30)
    docs = spark.createDataFrame([(1, words(rng, 30) + "\n" + item.upper() + " " + words(rng, 30)), (2, edited), (3, far), (4, words(rng, 90)), (5, None), (6, ""), (7, rep), (8, "two words"), (8, "two words"), (9, " ".join(w[:37]))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, " "), (13, rep), (14, "two words")], "item_id long, text string")
    got = {(r.id, r.item): round(r.similarity, 3) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 10): 1.0, (7, 13): 1.0, (8, 14): 1.0, (9, 10): round(33 / 36, 3)} | ({(2, 10): round(31 / 41, 3)} if 31 / 41 >= 0.8 else {})
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.drop_contaminated(awkward(spark), bench).count() == awkward(spark).count() - 1


# ---- 8 -----------------------------------------------------------------------------------


def test_op8_finds_planted_copies(spark, sf_dir):
    got = {r.vec_id: r.component_id for r in entries.queries()["op8_media_copies"](spark, sf_dir).collect()}
    planted = [i for i in got if i % 20 == 7 and i - 1 in got]
    assert planted and sum(got[i] == got[i - 1] for i in planted) >= 0.9 * len(planted)
    assert all(c == i or (i % 20 == 7 and c == i - 1) for i, c in got.items())


def test_op8_formats_and_awkward(spark):
    import struct

    def png(px, filt):
        h, w = px.shape
        raw = b""
        for y in range(h):
            line = px[y].astype(int)
            left, up = np.concatenate([[0], line[:-1]]), px[y - 1].astype(int) if y else np.zeros(w, int)
            corner = np.concatenate([[0], up[:-1]])
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            guess = [0 * line, left, up, (left + up) // 2, paeth][filt]
            raw += bytes([filt]) + bytes(((line - guess) % 256).tolist())
        part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    a, b = media.render(np.arange(64)), media.render(np.arange(64) + 5)
    px = media.decode(a)
    assert all((media.decode(png(px.astype(np.uint8), f)) == px).all() for f in range(5))
    assert media.decode(None) is None and media.decode(b"") is None and media.decode(b"P5 junk") is None
    rows = [(1, a), (2, png(px.astype(np.uint8), 4)), (3, b), (4, None), (5, None), (6, b""), (7, b"junk"), (8, a), (8, a), (9, b"P5\n4 4\n255\n" + bytes(16))] + [(20 + k, media.render(np.arange(64), 4)) for k in range(30)]
    got = {r.id: r.component for r in media.image_copies(spark.createDataFrame(rows, "id long, media binary"), "id", "media", votes=6).collect()}
    assert got[1] == got[2] == got[8] == got[20] == 1 and [got[k] for k in (3, 4, 5, 6, 7, 9)] == [3, 4, 5, 6, 7, 9]
    assert media.image_copies(spark.createDataFrame([], "id long, media binary"), "id", "media").count() == 0


# ---- 10 ----------------------------------------------------------------------------------


def test_op10_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = entries.queries()["op10_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op10_model_sums_to_one():
    m = langid.Model({"x": {"^a": 3, "^ab": 2, "^ab$": 1, "^b": 1, "^b$": 1, "ab$": 1}, "y": {"^c": 2, "^c$": 2}})
    one = lambda g: np.exp(m.grams[1][1][np.searchsorted(m.grams[1][0], np.uint64(langid.gram_hash(g)))])
    known = sum(one(g) for g in "abc$")
    rest = np.exp(m.contexts[0][1][0] + m.base)
    assert np.allclose(known + rest, 1, atol=1e-5)


def test_op10_awkward(spark):
    en, de = "the cat sat on the mat with another hat and that was all of it ", "der hund und die katze sind auf der matte mit einem hut und das war alles "
    rows = [(k, (en if k % 2 else de) * 3, "en" if k % 2 else "de") for k in range(40)] + [(100, None, "en"), (101, "", None), (102, "12 !! ²", None), (103, "the mat and the cat " * 60000, None), (104, "zqxj vkqz xxqj zzzq jqkx " * 20, None), (None, "die katze und der hund", None)]
    df = spark.createDataFrame([(a, b, c, "own") for a, b, c in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(df, "text", "lang", "doc_id", F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.lang_rejected) for r in langid.identify(df, model).collect()}
    assert [got[k] for k in (100, 101, 102)] == [("und", True)] * 3 and got[103] == ("en", False) and got[104][1] and got[None][0] == "de"
    none = langid.train(df.limit(0), "text", "lang", "doc_id", F.lit(True))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"} and langid.identify(df.limit(0), model).count() == 0
