"""Edge cases that the test tables do not hold: Arabic script, broken files, chunks, sinks, streams."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunks, dense, fusion, gates, guards, plugins, profile, tree
from quillspark.operators import lexical as L
from quillspark.sources import files, sinks
from quillspark.sources.commits import read_committed
from quillspark.streaming import ingest


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_normalise_arabic(spark):
    assert one(spark, T.normalise(F.lit("نَماز  كيا??!!  café"), strict=True)) == "نماز کیا? caf"
    assert one(spark, T.normalise(F.lit("كِتاب‌  ي"))) == "کتاب ی"
    assert one(spark, T.western_digits(F.lit("٣۴5"))) == "345"
    assert one(spark, T.composed(F.lit("é"))) == "é"


def test_script_share(spark):
    assert one(spark, T.share_of(F.lit("نماز abcd"), T.ARABIC)) == pytest.approx(0.5)
    assert one(spark, T.share_of(F.lit("   "), T.ARABIC)) == 0.0


def test_collapse_keeps_first(spark):
    assert one(spark, T.collapse_repeats(F.lit("what?!? yes..."))) == "what? yes."


def test_windows_cover_all_words(spark):
    ws = F.split(F.lit(" ".join(map(str, range(25)))), " ")
    got = one(spark, T.sliding_windows(ws, 10, 2))
    assert got[0].split()[0] == "0" and got[-1].split()[-1] == "24" and got[1].split()[0] == "8"
    assert one(spark, T.sliding_windows(F.split(F.lit("a"), ","), 10, 2)) == ["a"]


def test_content_key_blank_stays(spark):
    from quillspark.operators.records import keep_first

    df = spark.createDataFrame([(1, "A b."), (2, "a  B"), (3, "..."), (4, "!!")], "id int, t string")
    assert sorted(r.id for r in keep_first(df, T.content_key(F.col("t")), ["id"]).collect()) == [1, 3, 4]


def test_chunks_overlap_and_order(spark):
    text = " ".join(f"w{k}" + ("." if k % 50 == 49 else "") for k in range(1000))
    got = chunks.pack(text, 384, 38)
    assert all(len(c.split()) <= 384 for c in got) and got[1].split()[:38] == got[0].split()[-38:]
    assert chunks.pack(None, 10, 2) == [] and chunks.pack("a b", 10, 2) == ["a b"]
    assert chunks.pack(" ".join(["x"] * 25), 10, 2)[-1].split() == ["x"] * 9
    df = spark.createDataFrame([(1, text), (2, "short  one"), (3, None), (4, "")], "id int, t string")
    rows = chunks.chunk(df, "id", "t").collect()
    assert {r.doc for r in rows} == {1, 2} and sum(r.doc == 1 for r in rows) == len(got)


def test_min_max_of_one_value(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 1.0), (2, 2, 3.0)], "query_id int, doc_id int, score double")
    assert {(r.query_id, r.doc_id): r.norm for r in fusion.min_max(df).collect()} == {(1, 1): 1.0, (2, 1): 0.0, (2, 2): 1.0}


def test_dense_blocks_agree(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(40)], "vec_id long, embedding array<float>")
    a = sorted(map(tuple, dense.search(v, v.where("vec_id < 9"), 3).collect()))
    monkeypatch.setattr(dense, "VECTORS", 7)
    monkeypatch.setattr(dense, "QUERIES", 4)
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 100)
    assert sorted(map(tuple, dense.search(v, v.where("vec_id < 9"), 3).collect())) == a


def test_group_detection(spark):
    q = spark.createDataFrame([(1, "Ask the deobandi view"), (2, "ahle hadith view"), (3, "nothing"), (4, "not-deobandiish")], "id int, t string")
    got = {r.query_id: r.grp for r in gates.detect_group(q, "id", F.col("t"), [("d", "deobandi"), ("a", "ahle hadith")]).collect()}
    assert got == {1: "d", 2: "a", 3: None, 4: None}


def test_markdown_headings_skip_fences(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A <!-- id: x1 -->\ntext\n```\n# no\n```\n## B\n### C\n## D\n")
    rows = tree.markdown_headings(files.markdown_lines(spark, str(tmp_path / "a.md")))
    got = [(r.title, r.level, r.parent) for r in tree.heading_tree(rows).orderBy("line").collect()]
    assert got == [("A", 1, None), ("B", 2, 0), ("C", 3, 5), ("D", 2, 0)]


def test_validate_flags(spark):
    df = spark.createDataFrame([("", "s"), ("totally unrelated words here nothing shared at all", "source text"), ("the source text says 12 of it all", "the source text says 12 of it all")], "a string, s string")
    rows = guards.validate(df, F.col("a"), F.col("s")).collect()
    assert [r.valid for r in rows] == [False, False, True] and rows[0].issues[0].code == "EMPTY"


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a cat sat"), (2, "a cat sat"), (3, "")], "id int, t string")
    rows = {r.id: r.embedding for r in plugins.embed_unique(df, "t").collect()}
    assert rows[1] == rows[2] and sum(x * x for x in rows[1]) == pytest.approx(1.0) and not any(rows[3])
    assert one(spark, plugins.overlap_mark(F.lit("red cat"), F.lit("a red dog"))) == 0.5


def test_csv_tree_with_bad_files(spark, tmp_path):
    (tmp_path / "s" / "c").mkdir(parents=True)
    (tmp_path / "s" / "c" / "good.csv").write_text("Url_Link,Query,FatwahNo,Question,Answer\nu,q,1,what?,that\n,,,,\n", encoding="utf-8")
    (tmp_path / "s" / "c" / "bom.csv").write_text("question,answer\na,b\n", encoding="utf-8-sig")
    (tmp_path / "s" / "c" / "arabic.csv").write_bytes("question,answer\nنماز,جواب\n".encode("cp1256"))
    (tmp_path / "s" / "c" / "empty.csv").write_bytes(b"")
    (tmp_path / "s" / "c" / "header.csv").write_text("question,answer\n")
    df = files.read_csv_tree(spark, str(tmp_path))
    assert df.where("Question = 'what?'").count() == 1
    one_file = files.read_csv(spark, [str(tmp_path / "s" / "c" / "arabic.csv")], "windows-1256")
    assert one_file.first()["question"] == "نماز"
    assert files.strict_columns(one_file) is None
    assert files.by_aliases(files.read_csv(spark, [str(tmp_path / "s" / "c" / "bom.csv")])).first().question == "a"
    assert {r.encoding for r in files.encodings(spark, str(tmp_path)).collect()} == {"UTF-8", "windows-1256"}
    assert {r.rows for r in files.row_estimates(spark, str(tmp_path), "good.csv").collect()} == {2}
    assert files.discover(spark, str(tmp_path)).count() == 4


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"q": 1}, {"q": 2}]}')
    (tmp_path / "b.json").write_text('[{"q": 1}]')
    (tmp_path / "c.jsonl").write_text('{"q": 1}\n{"q": 2}\n{"q": 3}\n')
    assert [files.read_json(spark, str(tmp_path / n)).count() for n in ("a.json", "b.json", "c.jsonl")] == [2, 1, 3]


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, v int")
    assert sinks.append_new(rows, str(tmp_path / "t"))["upserted"] == 2
    assert sinks.append_new(rows, str(tmp_path / "t")) == {"upserted": 0, "skipped": 3, "total": 3}
    assert read_committed(spark, str(tmp_path / "t")).count() == 2
    sinks.log_run(spark, str(tmp_path / "runs"), "load", "completed", 1.0)
    assert sinks.stage_status(spark, str(tmp_path / "runs")) == {"load": "completed"} and sinks.stage_status(spark, str(tmp_path / "none")) == {}


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red cat"), (2, "blue dog"), (3, None), (4, "")], "doc_id long, text string")
    index = L.build(docs, "doc_id", F.col("text"))
    sinks.save_index(index, str(tmp_path / "i"))
    q = spark.createDataFrame([(9, "red red dog"), (8, "")], "id long, t string")
    a, b = (sorted(map(tuple, L.scores(i, q, "id", F.col("t")).collect())) for i in (index, sinks.load_index(spark, str(tmp_path / "i"))))
    assert a == b and len(a) == 2 and sinks.load_index(spark, str(tmp_path / "no")) is None


def test_streaming_ingest_resumes(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(50).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), docs.schema)
    n = read_committed(spark, str(tmp_path / "out")).count()
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), docs.schema)
    out = read_committed(spark, str(tmp_path / "out"))
    assert n <= 50 < out.count() and out.count() == out.select("id").distinct().count()


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = ingest.windows(s).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] > 0


def test_profile_blank_columns(spark):
    cells = profile.melt(spark.createDataFrame([(1, None, "x"), (2, "", "y")], "k int, a string, b string"), "k", "t")
    got = {r.column_name: (r.null_ratio, r.samples) for r in profile.profile(cells).collect()}
    assert got["a"] == (1.0, "") and got["b"] == (0.0, "x | y")
    assert files.synthetic(spark, 30).count() == 30


def test_orchestrate_resumes_and_stops(spark, tmp_path):
    from quillspark.streaming.orchestrate import Stage, orchestrate

    log, ran = f"file://{tmp_path}/log", []

    def bad(_):
        raise ValueError("broken")

    stages = [Stage("one", lambda s: ran.append(1) or "fine"), Stage("two", bad), Stage("three", lambda s: ran.append(3) or "")]
    assert [r.status for r in orchestrate(spark, stages, log).results] == ["completed", "failed", "not_run"]
    stages[1] = Stage("two", lambda s: "mended")
    again = orchestrate(spark, stages, log)
    assert [r.status for r in again.results] == ["skipped", "completed", "completed"] and again.ok and ran == [1, 3]


def test_load_documents(spark, tmp_path):
    from quillspark.sources import files

    folder = tmp_path / "Src" / "CAT"
    folder.mkdir(parents=True)
    head = ",".join(files.EXPECTED) + "\n"
    (folder / "a_output.csv").write_text(head + "u,q,1, Quest ,Ans\nu,q,2,,\n", "utf-8-sig")
    (folder / "b_output.csv").write_bytes((head + "u,q,3,سوال,جواب\n").encode("windows-1256"))
    (folder / "c_output.csv").write_text("Query,Answer\nx,y\n")
    (folder / "d_output.csv").write_text("")
    got = {(r.FatwahNo, r.Question, r.source, r.category, r.subcategory) for r in files.load_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {("1", "Quest", "Src", "CAT", "a"), ("3", "سوال", "Src", "CAT", "b")}


def test_sinks_of_trees_chunks_and_names(spark, tmp_path):
    from quillspark.sources import sinks

    rec = spark.createDataFrame([("1", "q one", "A", "x"), ("2", "", "A", "y"), ("3", "q three", "B", "x")], "id string, question string, top string, sub string")
    sinks.write_hierarchy(rec, ["top", "sub"], f"file://{tmp_path}/tree")
    nodes = spark.read.parquet(f"file://{tmp_path}/tree/nodes")
    assert {r.path for r in sinks.subtree(nodes, "a").collect()} == {"A", "A/x", "A/y"}
    assert {(r.top, r.n, r.blank) for r in spark.read.parquet(f"file://{tmp_path}/tree/counts").collect()} == {("A", 2, 1), ("B", 1, 0)}
    sinks.export_markdown(rec, ["top", "sub"], f"file://{tmp_path}/md")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/md").collect()]
    assert "# B" in lines and "- q three <!-- id: 3 -->" in lines
    assert sinks.upsert_named(rec, f"file://{tmp_path}/named", "top") == {"upserted": 3, "skipped": 0, "total": 3}
    assert sinks.upsert_named(rec, f"file://{tmp_path}/named", "top") == {"upserted": 0, "skipped": 3, "total": 3}
    chunks_ = rec.select(F.col("id").alias("chunk_id"), F.col("question").alias("text"))
    assert sinks.upsert_chunks(chunks_, f"file://{tmp_path}/chunks")["upserted"] == 3
    assert sinks.delete_rows(f"file://{tmp_path}/chunks", spark, chunks_.limit(1), "chunk_id") == 2
    made = []
    for _ in range(2):
        sinks.cached(spark, f"file://{tmp_path}/side", {"id"}, lambda: made.append(1) or rec)
    assert len(made) == 1
