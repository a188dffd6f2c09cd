import os
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from indexloom.errors import CollectionExists, CollectionNotFound, IndexNotFound, ModelMismatch
from indexloom.operators import hierarchy
from indexloom.operators.embed import batched_model, get_model, hashing_model
from indexloom.operators.upsert import latest, upsert
from indexloom.plans import ask, build
from indexloom.schemas import FILES
from indexloom.session import written
from indexloom.sources import files as source_files
from indexloom.sources import store as store_module
from indexloom.sources.files import read_files, scan_files, walk
from indexloom.sources.store import IndexStore, write_json
from indexloom.sources.tree import OPEN_BYTES, TreeReader, planned, register
from indexloom.streaming.ingest import file_stream, ingest_chunks

SOURCES = [
    ("a.py", "class A:\n  def f(x): return 1\n\n"),
    ("b.py", "def g(): pass"),
    ("c.txt", "hello class world"),
    ("d.py", "x = 1"),
    ("e.py", ""),
]


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"))


@pytest.fixture
def files(spark):
    return spark.createDataFrame(SOURCES, "path string, content string")


def test_chunk_index(spark, store, files):
    model = get_model("hash-64")
    with pytest.raises(IndexNotFound):
        store.chunks()
    assert not store.exists()
    status = {r["path"]: r["status"] for r in build.index_chunks(store, files, model).collect()}
    assert status == {"a.py": "ok", "b.py": "ok", "d.py": "error", "e.py": "error"}
    stored = {r["id"]: r for r in store.chunks("chunks").collect()}
    assert set(stored) == {"a.py:class:A:0", "a.py:method:f:1", "b.py:function:g:0"}
    assert stored["a.py:method:f:1"]["metadata"]["parent_id"] == "a.py:class:A:0"
    assert "parent_id" not in stored["b.py:function:g:0"]["metadata"]
    question = ask.one_query(spark, "def g(): pass")
    found = ask.query_chunks(store, question, model, "chunks").orderBy("rank").collect()
    assert found[0]["id"] == "b.py:function:g:0" and found[0]["score"] == 1.0
    report = ask.chunk_report(ask.query_chunks(store, question, model, "chunks")).orderBy("rank").first()
    assert (report["percent"], report["language"], report["lines"]) == (100.0, "python", 1)
    with pytest.raises(ModelMismatch):
        ask.query_chunks(store, question, hashing_model(32), "chunks")
    with pytest.raises(CollectionNotFound, match="available: chunks"):
        store.embeddings("other")


def test_file_index_and_force(spark, store, files):
    model = get_model("hash-64")
    status = {r["path"]: r["status"] for r in build.index_files(store, files, model).collect()}
    assert status == {"a.py": "ok", "b.py": "ok", "c.txt": "ok", "d.py": "ok", "e.py": "empty"}
    with pytest.raises(CollectionExists):
        build.index_files(store, files, model)
    build.index_files(store, files.filter("path = 'b.py'"), model, "second")
    assert store.collection_names() == ["files", "second"]
    info = {r["collection"]: r for r in store.info().collect()}
    assert {name: r["entries"] for name, r in info.items()} == {"files": 4, "second": 1}
    for name, r in info.items():
        batches = [b.batch for b in store.batches(collection=name)]
        on_disk = sum(p.stat().st_size for b in batches for p in Path(store.root).glob(f"*/batch={b}/*.parquet"))
        assert r["bytes"] == on_disk > 0 and r["size"].endswith("KB")
    assert store.model_of("files") == "hash-64" and store.model_of("nope") is None
    best = ask.best_file(store, ask.one_query(spark, "hello world"), model, "files").collect()
    assert [r["id"] for r in best] == ["c.txt"]
    shown = ask.report(ask.query_files(store, ask.one_query(spark, "x = 1"), model, "files"), context=1)
    assert shown.orderBy("rank").first()["shown"] == "x = 1"
    build.index_files(store, files, model, "third", force=True)
    assert store.collection_names() == ["third"] and store.embeddings().count() == 4


def test_upsert_replaces_within_its_collection(spark, store):
    schema = "id string, vector array<float>, content string, metadata map<string,string>, seq int"
    store.create("one", "m", 1)
    store.create("two", "m", 1)
    first = spark.createDataFrame([(str(i), [1.0], "old", {}, 0) for i in range(20)], schema)
    store.upsert_embeddings("one", first)
    store.upsert_embeddings("two", first)
    batch = [("3", [2.0], "mid", {}, 1), ("3", [3.0], "new", {}, 2), ("99", [4.0], "added", {}, 1)]
    store.upsert_embeddings("one", spark.createDataFrame(batch, schema), order=["seq"])
    one = {r["id"]: r["content"] for r in store.embeddings("one").collect()}
    assert len(one) == 21 and one["3"] == "new" and one["99"] == "added" and one["4"] == "old"
    assert {r["content"] for r in store.embeddings("two").collect()} == {"old"}
    assert store.embeddings("two").count() == 20


def test_upsert_operator(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, seq int")
    assert {tuple(r) for r in upsert(old, new, ["id"], ["seq"]).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert latest(new, ["id"], ["seq"]).count() == 2


@pytest.mark.parametrize("literal_keys", [0, 100])
def test_lookup(spark, store, monkeypatch, literal_keys):
    from indexloom.sources import store as module

    monkeypatch.setattr(module, "MAX_LITERAL_KEYS", literal_keys)
    store.create("one", "m", 1)
    rows = [(f"i{i}", [1.0], f"c{i}", {}) for i in range(30)]
    store.upsert_embeddings("one", spark.createDataFrame(rows, "id string, vector array<float>, content string, metadata map<string,string>"))
    ids = spark.createDataFrame([("i3",), ("i3",), ("i29",), ("nope",)], "id string")
    assert sorted(r["content"] for r in store.lookup("embeddings", "one", ids).collect()) == ["c29", "c3"]


def test_collections_are_pruned(spark, store, files):
    model = get_model("hash-64")
    build.index_files(store, files, model)
    build.index_files(store, files, model, "other")
    own, all_ = set(store.embeddings("files").inputFiles()), set(store.embeddings().inputFiles())
    assert own < all_ and len(all_) == 2 * len(own)


VECTORS = "id string, vector array<float>, content string, metadata map<string,string>"


def vector_rows(spark, ids, content="c", **more):
    rows = spark.createDataFrame([(i, [1.0, 2.0], content, {"k": "v"}) for i in ids], VECTORS)
    return rows.withColumns({name: F.lit(value) for name, value in more.items()})


def contents(store, name):
    return {r["id"]: r["content"] for r in store.embeddings(name).collect()}


def test_an_upsert_writes_in_proportion_to_its_rows(spark, store):
    many = spark.range(60_000).select(
        F.concat(F.lit("i"), F.col("id")).alias("id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("vector"),
        F.sha2(F.col("id").cast("string"), 256).alias("content"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("metadata"),
    )
    store.build("one", "m", 2, many)
    base = store.batches("embeddings", "one")[0]
    folder = Path(store.root) / "embeddings" / f"batch={base.batch}"
    before = {p: p.stat().st_mtime_ns for p in folder.iterdir()}
    store.upsert_embeddings("one", vector_rows(spark, [f"i{7 * k}" for k in range(100)], "changed"))
    delta = store.batches("embeddings", "one")[1]
    assert (base.kind, delta.kind, delta.rows) == ("base", "delta", 100)
    assert delta.bytes < base.bytes / 100
    assert {p: p.stat().st_mtime_ns for p in folder.iterdir()} == before
    got = contents(store, "one")
    assert len(got) == 60_000 and sum(c == "changed" for c in got.values()) == 100
    assert store.info().first()["entries"] == 60_000


@pytest.mark.parametrize("broadcast", [0, 1 << 25])
def test_merge_on_read_and_compaction(spark, store, monkeypatch, broadcast):
    from indexloom.sources import store as module

    monkeypatch.setattr(module, "BROADCAST_ID_BYTES", broadcast)
    draw, expected = random.Random(3), {str(i): "0" for i in range(50)}
    store.build("one", "m", 2, vector_rows(spark, expected, "0"))
    store.build("two", "m", 2, vector_rows(spark, ["x"], "y"))
    for step in range(1, 6):
        changed = [str(draw.randrange(80)) for _ in range(15)]
        gone = [str(draw.randrange(80)) for _ in range(8)]
        store.upsert_embeddings("one", vector_rows(spark, set(changed), str(step)), gone=spark.createDataFrame([(g,) for g in gone], "id string"))
        expected = {i: c for i, c in expected.items() if i not in gone} | {i: str(step) for i in changed}
        assert contents(store, "one") == expected
    assert not store.compact("one", least_deltas=6)
    reader = store.embeddings("one")
    assert store.compact("one") and [b.kind for b in store.batches("embeddings", "one")] == ["base"]
    assert contents(store, "one") == expected == {r["id"]: r["content"] for r in reader.collect()}
    assert store.vacuum() == 6 and contents(store, "one") == expected and contents(store, "two") == {"x": "y"}
    assert not store.compact("one") and store.info().filter("collection = 'one'").first()["entries"] == len(expected)


def test_both_tables_change_together(spark, store, files, monkeypatch):
    model = get_model("hash-64")
    build.index_chunks(store, files, model)
    chunks, entries = store.chunks("chunks").count(), store.embeddings("chunks").count()
    whole = IndexStore._write

    def failing(self, df, table, fields):
        if table == "chunks":
            raise OSError("disk full")
        return whole(self, df, table, fields)

    monkeypatch.setattr(IndexStore, "_write", failing)
    with pytest.raises(OSError):
        build.add_chunks(store, spark.createDataFrame([("b.py", "def h(): pass")], "path string, content string"), model, "chunks")
    assert (store.chunks("chunks").count(), store.embeddings("chunks").count()) == (chunks, entries)
    assert {r["id"] for r in store.embeddings("chunks").collect()} == {r["id"] for r in store.chunks("chunks").collect()}


def test_global_ids_move_between_collections(spark, store):
    store.build("one", "m", 2, vector_rows(spark, ["a", "b"], "1"))
    store.build("two", "m", 2, vector_rows(spark, ["c"], "2"))
    store.upsert("two", vector_rows(spark, ["a", "d"], "3"), global_ids=True)
    assert contents(store, "one") == {"b": "1"} and contents(store, "two") == {"a": "3", "c": "2", "d": "3"}
    store.upsert("one", vector_rows(spark, ["a"], "4"))
    assert contents(store, "one") == {"a": "4", "b": "1"} and contents(store, "two")["a"] == "3"
    for name in ("one", "two"):
        before = contents(store, name)
        store.compact(name)
        assert contents(store, name) == before


def test_a_failed_count_spoils_only_its_own_line(spark, store):
    for name in ("bad", "good"):
        store.build(name, "m", 2, vector_rows(spark, ["a", "b"]))
        store.upsert_embeddings(name, vector_rows(spark, ["b", "c"]))
    for b in store.batches("embeddings", "bad"):
        for p in (Path(store.root) / "embeddings" / f"batch={b.batch}").iterdir():
            p.unlink() if p.name.startswith(".") else p.write_bytes(b"torn")
    listed = {r["collection"]: r for r in store.info().collect()}
    assert listed["good"]["entries"] == 3 and listed["good"]["error"] is None
    assert listed["bad"]["entries"] is None and listed["bad"]["error"]


def test_filters_reach_the_stored_files(spark, store):
    rows = vector_rows(spark, [f"i{k:04d}" for k in range(300)]).withColumn("type", F.concat(F.lit("t"), F.substring("id", 5, 1)))
    store.build("one", "m", 2, rows)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    typed = store.embeddings("one").filter("type = 't3'")
    plan = typed.select("id", "vector")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,t3)" in plan and "Join" not in plan and "Exchange" not in plan
    assert typed.count() == 30
    plan = store.embeddings("one").filter(F.col("id").isin("i0001", "i0002"))._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [i0001,i0002])" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # also where deltas are merged, the filter on ids reaches both scans
    store.upsert_embeddings("one", vector_rows(spark, ["i0001"], "new"))
    merged = store.lookup("embeddings", "one", spark.createDataFrame([("i0001",), ("i0002",)], "id string"))
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("id#") > 0
    assert {r["id"]: r["content"] for r in merged.collect()} == {"i0001": "new", "i0002": "c"}


def test_reports_on_a_stored_outline(spark, store):
    source = "class A:\n    def f(self):\n        pass\n\n    class B:\n        def g(self):\n            pass\n"
    files = spark.createDataFrame([("a.py", source), ("b.py", "def h():\n    pass\n")], "path string, content string")
    model = get_model("hash-64")
    build.index_chunks(store, files, model)
    assert store.outline("chunks") is None
    below = [(r["level"], r["name"]) for r in ask.chunk_descendants(store, "chunks", "a.py:class:A:0").collect()]
    assert below == [(1, "f"), (1, "B"), (2, "g")]
    stored = store.outline("chunks")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = hierarchy.descendants(stored, "a.py:class:A:0")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(first,1)" in plan and "LessThanOrEqual(first,4)" in plan and "Join" not in plan
    shown = {r["relation"]: r for r in ask.show_chunk(store, "chunks", "a.py:method:g:5").collect()}
    assert set(shown) == {"self", "ancestor"} and "def g" in shown["self"]["content"] and shown["self"]["metadata"]["name"] == "g"
    assert [(r["level"], r["name"]) for r in ask.chunk_tree(store, "chunks").collect()] == [(0, "A"), (1, "f"), (1, "B"), (2, "g"), (0, "h")]
    assert [r["name"] for r in ask.list_chunks(store, "chunks", "A.PY", "class").orderBy("name").collect()] == ["A", "B"]
    # an upsert makes the outline out of date, and the next question makes it again
    build.add_chunks(store, spark.createDataFrame([("b.py", "class C:\n    def h(self): pass\n")], "path string, content string"), model, "chunks")
    assert store.outline("chunks") is None
    assert [r["name"] for r in ask.chunk_descendants(store, "chunks", "b.py:class:C:0").collect()] == ["h"]
    stats = {(r["report"], r["key"]): r["chunks"] for r in ask.chunk_stats(store, "chunks").collect()}
    assert stats[("total", "all")] == 6 and stats[("depth", "1")] == 3 and stats[("file", "a.py")] == 4


def test_large_batches_of_chunks_are_shuffled_as_packed_columns(spark, store, monkeypatch):
    rows = [(f"i{i}", f"p{i % 7}.py", i, f"i{i // 3}" if i else None, f"text {i}", {"lines": str(i)}) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, path string, start_line int, parent_id string, content string, metadata map<string,string>")
    ones = {c: F.lit(1) for c in ("start_col", "end_line", "end_col")}
    chunks = df.withColumns({**ones, "type": F.lit("t"), "name": F.concat(F.lit("n"), "id")}).repartition(4)
    dealt, plain = [], type(df).repartitionByRange

    def spied(self, *args):
        dealt.append(set(self.columns))
        return plain(self, *args)

    monkeypatch.setattr(type(df), "repartitionByRange", spied)
    monkeypatch.setattr(store_module, "FILE_BYTES", 9000)
    store.build("nodes", "none", 1, chunks=chunks)
    below = {r["id"]: r["metadata"]["lines"] for r in ask.chunk_descendants(store, "nodes", "i1").collect()}
    assert not [names for names in dealt if "content" in names]
    expected, known = {}, {"i1"}
    for i, _, _, up, _, metadata in rows:
        if up in known and i != "i1":
            known.add(i)
            expected[i] = metadata["lines"]
    assert below == expected
    assert sorted(store.chunks("nodes").select(*df.columns).collect()) == sorted(df.collect())
    for table, keys in (("chunks", ["path", "start_line", "id"]), ("outline", ["first"])):
        (batch,) = store.batches(table)
        at = F.input_file_name().alias("file")
        stored = spark.read.parquet(store._folder(table, batch.batch)).select(at, F.struct(*keys).alias("key"))
        files = stored.groupBy("file").agg(F.min("key").alias("least"), F.max("key").alias("most")).orderBy("least").collect()
        assert len(files) > 2 and all(x["most"] < y["least"] for x, y in zip(files, files[1:], strict=False))


def test_questions_about_one_chunk_number_no_others(spark, store, monkeypatch):
    source = "class A:\n    class B:\n        def g(self):\n            pass\n"
    build.index_chunks(store, spark.createDataFrame([("a.py", source)], "path string, content string"), get_model("hash-64"))
    leaf, middle = "a.py:method:g:2", "a.py:class:B:1"
    above = [(r["id"], r["distance"]) for r in ask.chunk_ancestors(store, "chunks", leaf).collect()]
    assert above == [(middle, 1), ("a.py:class:A:0", 2)]
    shown = {(r["relation"], r["id"], r["distance"]) for r in ask.show_chunk(store, "chunks", middle).collect()}
    assert shown == {("self", middle, 0), ("ancestor", "a.py:class:A:0", 1), ("child", leaf, 1)}
    assert ask.show_chunk(store, "chunks", "nope").collect() == ask.chunk_ancestors(store, "chunks", "nope").collect() == []
    stats = {(r["report"], r["key"]): r["chunks"] for r in ask.chunk_stats(store, "chunks").collect()}
    assert stats[("depth", "0")] == stats[("depth", "1")] == stats[("depth", "2")] == 1
    assert store.outline("chunks") is None
    # too far down to climb: the outline gives the same
    monkeypatch.setattr(ask, "LINE_STEPS", 1)
    assert {(r["relation"], r["id"], r["distance"]) for r in ask.show_chunk(store, "chunks", middle).collect()} == shown
    assert store.outline("chunks") is not None


def test_what_makes_the_rows_of_a_small_batch_keeps_its_tasks(spark, store):
    rows = vector_rows(spark, [f"i{k:03d}" for k in range(100)]).repartition(4).withColumn("content", F.spark_partition_id().cast("string"))
    store.build("one", "m", 2, rows)
    assert len({r["content"] for r in store.embeddings("one").collect()}) > 1
    assert len(store.embeddings("one").inputFiles()) == 1


def test_files_are_cut_by_what_their_rows_take_to_sort(spark, store, monkeypatch):
    monkeypatch.setattr("indexloom.sources.store.FILE_BYTES", 5000)
    store.build("one", "m", 2, vector_rows(spark, [f"i{k:03d}" for k in range(200)]))
    assert len(store.embeddings("one").inputFiles()) >= 4 and store.embeddings("one").count() == 200


def test_prefiltered_search_reads_what_qualifies(spark, store, files):
    model = get_model("hash-64")
    build.index_chunks(store, files, model)
    found = ask.query_chunks(store, ask.one_query(spark, "def g(): pass"), model, "chunks", threshold=-1.0, chunk_type="class", prefilter=True)
    assert [r["id"] for r in found.collect()] == ["a.py:class:A:0"]


def test_stream_updates_an_index(spark, store, files, tmp_path):
    model = get_model("hash-64")
    build.index_chunks(store, files, model)
    incoming, checkpoint = str(tmp_path / "incoming"), str(tmp_path / "checkpoint")
    spark.createDataFrame([("b.py", 3, "def g(): return 2"), ("z.py", 3, "class Z:\n  pass")], FILES).write.parquet(incoming)
    for _ in range(2):  # the second run finds nothing new
        ingest_chunks(file_stream(spark, incoming), store, model, "chunks", checkpoint).awaitTermination()
    stored = {r["id"]: r["content"] for r in store.chunks("chunks").collect()}
    assert stored["b.py:function:g:0"] == "def g(): return 2" and "z.py:class:Z:0" in stored and len(stored) == 4


def test_a_repeated_path_is_stored_once(spark, store):
    rows = [("a.py", "def f(): return 1", 1), ("a.py", "def f(): return 3\ndef g(): pass", 3), ("a.py", "x = 2", 2)]
    versions = spark.createDataFrame(rows, "path string, content string, version int")
    model = get_model("hash-64")
    build.index_chunks(store, versions, model, order=["version"])
    build.index_files(store, versions, model, order=["version"])
    assert sorted(r["id"] for r in store.chunks("chunks").collect()) == ["a.py:function:f:0", "a.py:function:g:1"]
    assert [r["content"] for r in store.embeddings("files").collect()] == [rows[1][1]]
    best = ask.best_file(store, ask.one_query(spark, rows[1][1]), model, "files").first()
    assert best["score"] == 1.0


def test_an_edited_file_loses_its_former_chunks(spark, store, files):
    model = get_model("hash-64")
    build.index_chunks(store, files, model, "odd/name=1 +%")
    edited = [("a.py", "\n\nclass A:\n  def f(x): return 1"), ("b.py", "")]
    edited = spark.createDataFrame(edited, "path string, content string")
    for _ in range(2):
        build.add_chunks(store, edited, model, "odd/name=1 +%").collect()
        ids = {"a.py:class:A:2", "a.py:method:f:3"}
        assert {r["id"] for r in store.chunks("odd/name=1 +%").collect()} == ids
        assert {r["id"] for r in store.embeddings("odd/name=1 +%").collect()} == ids
    nothing = spark.createDataFrame([("a.py", "x = 1")], "path string, content string")
    build.add_chunks(store, nothing, model, "odd/name=1 +%")
    assert store.chunks("odd/name=1 +%").count() == 0 == store.embeddings("odd/name=1 +%").count()


def test_vectors_and_metadata_are_made_where_they_are_stored(spark, store, files, monkeypatch):
    kept = []
    monkeypatch.setattr(build, "written", lambda df, label: kept.append(df.columns) or written(df, label))
    build.index_chunks(store, files, get_model("hash-64"))
    build.index_files(store, files, get_model("hash-64"), "whole")
    assert kept and not any("vector" in columns for columns in kept)
    edited = spark.createDataFrame([("a.py", "\nclass A:\n  def f(x): return 1\n\n")], "path string, content string")
    build.add_chunks(store, edited, get_model("hash-64"), "chunks")
    assert "max_by" not in store.embeddings("chunks")._jdf.queryExecution().toString()  # one delta has an id once
    chunks = {r["id"]: r for r in store.chunks("chunks").collect()}
    entries = {r["id"]: r for r in store.embeddings("chunks").collect()}
    assert set(chunks) == set(entries) == {"a.py:class:A:1", "a.py:method:f:2", "b.py:function:g:0"}
    for id_, row in entries.items():
        assert len(row["vector"]) == 64 and row["metadata"] == chunks[id_]["metadata"] and row["metadata"]["path"] == row["path"]
        assert row["metadata"].get("parent_id") == row["parent_id"] and row["metadata"]["start_line"] == str(chunks[id_]["start_line"])
    stored = sum(os.path.getsize(p) for p in Path(store.root, "chunks").rglob("*.parquet"))
    assert abs(stored - sum(b.bytes for b in store.batches("chunks"))) < 10


def test_a_column_of_the_order_is_held_once(spark):
    rows = [("a", "x", 1, None), ("a", "y", 1, "e"), ("a", "z", 0, "e"), ("b", None, None, None), (None, "w", 2, None)]
    found = build.last_versions(spark.createDataFrame(rows, "path string, content string, version int, error string"), ["version"])
    assert "max_by" not in found._jdf.queryExecution().toString()
    assert found.columns == ["path", "content", "version", "error"]
    assert {tuple(r) for r in found.collect()} == {("a", "y", 1, "e"), ("b", None, None, None), (None, "w", 2, None)}


def test_a_failed_build_registers_nothing(spark, store, files):
    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        build.index_files(store, files, batched_model("broken", 2, broken))
    assert not store.exists()
    build.index_files(store, files, get_model("hash-64"))
    assert store.collection_names() == ["files"]


def test_scan_and_read(spark, tmp_path):
    root = tmp_path / "project"
    contents = {
        "a.py": b"x\r\ny\xff\xe2\x82z\r",
        "pkg/__init__.py": b"",
        "_p.py": b"1",
        ".gitignore": "\u00e9\ufffd".encode(),
        "node_modules/x.py": b"q",
        "pkg/.my_cache/y.py": b"s",
        "pkg/build/deep/z.py": b"t",
        "edge": b"x" * 102400,
        "over": b"x" * 102401,
        "build.txt": b"b",
    }
    for name, data in contents.items():
        path = root / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(data)
    found = scan_files(spark, str(root))
    texts = {r["path"]: r["content"] for r in read_files(found, str(root)).collect()}
    assert texts == {
        "a.py": "x\nyz\n", "pkg/__init__.py": "", "_p.py": "1", ".gitignore": "\u00e9\ufffd", "edge": "x" * 102400,
        "build.txt": "b",
    }

    def names(**kw):
        return {r["path"] for r in scan_files(spark, str(root), **kw).collect()}

    assert names(include="z.py") == set(texts) | {"pkg/build/deep/z.py"}
    assert names(exclude="*.py") == {".gitignore", "edge", "build.txt"}
    assert names(max_kb=None) == set(texts) | {"over"}
    assert names(text_check="extension") == {"a.py", "pkg/__init__.py", "_p.py", "build.txt"}
    listed = spark.createDataFrame([("a.py",), ("a.py",), ("node_modules/x.py",), ("missing",)], "path string")
    assert names(listed=listed) == {"a.py", "node_modules/x.py"}
    assert names(listed=listed, include="_*") == {"a.py", "node_modules/x.py", "_p.py", "pkg/__init__.py"}
    assert walk(spark, str(root)).filter(F.col("path").contains("node_modules")).count() == 0
    gone = spark.createDataFrame([("a.py", 1), ("gone.py", 1)], "path string, length long")
    status = {r["path"]: r["status"] for r in build.file_status(read_files(gone, str(root))).collect()}
    assert status == {"a.py": "ok", "gone.py": "error"}


def test_tree_source(spark, tmp_path):
    for name, size in {"a.py": 10, "pkg/b.py": 200, "pkg/sub/c.py": 30, "node_modules/d.py": 5, "other/e.py": 70, "_f": 0, "é.py": 3}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name[-4:].encode() * size)
    (tmp_path / "pkg" / "up").symlink_to(tmp_path)
    register(spark)
    tree = spark.read.format("file_tree").load(str(tmp_path))
    assert {r["path"]: r["length"] for r in tree.collect()} == {
        "a.py": 40, "pkg/b.py": 800, "pkg/sub/c.py": 120, "other/e.py": 280, "_f": 0, "é.py": 15,
    }
    assert all(len(r["raw"]) == r["length"] and r["error"] is None for r in tree.collect())
    found = tree.filter("path LIKE 'pkg/%' AND length > 100")
    assert sorted(r["path"] for r in found.collect()) == ["pkg/b.py", "pkg/sub/c.py"]
    assert sorted(r["path"] for r in tree.filter("path IN ('a.py', 'pkg/b.py', 'x')").collect()) == ["a.py", "pkg/b.py"]
    assert sorted(r["path"] for r in tree.filter("path > 'o' AND length IS NOT NULL").collect()) == ["other/e.py", "pkg/b.py", "pkg/sub/c.py", "é.py"]
    unpruned = spark.read.format("file_tree").option("pruned", "false").option("content", "false").load(str(tmp_path))
    assert unpruned.count() == 7 and unpruned.filter("raw IS NOT NULL").count() == 0
    assert spark.read.format("file_tree").load(str(tmp_path / "node_modules")).filter("length > 1000").count() == 0


def test_tree_partitions_and_pruning(tmp_path):
    for name in ("a/x", "a/b/y", "c/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * 1000)
    reader = TreeReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([D.StringStartsWith(("path",), "a/b"), D.GreaterThan(("path",), "a"), D.LessThan(("length",), 5000)]))
    assert left == [D.GreaterThan(("path",), "a")]
    assert reader.listing() == [("a/b/y", 1000)] and not reader._entered("c/") and reader._entered("a/")
    files = [(f"f{i}", 10**7 if i % 50 == 0 else 100) for i in range(200)]
    parts = planned(files, 8 * 10**6)
    assert [f for p in parts for f in p.files] == files
    assert all(sum(n + OPEN_BYTES for _, n in p.files[:-1]) < 8 * 10**6 for p in parts) and len(parts) > 4


def test_json_sink(spark, tmp_path):
    out = str(tmp_path / "json")
    write_json(spark.createDataFrame([("a", 0.5, None)], "id string, score double, content string"), out)
    assert [r["value"] for r in spark.read.text(out).collect()] == ['{"id":"a","score":0.5}']


def test_odd_collection_names(spark, store):
    rows = [("x", [1.0], "c", {})]
    one = spark.createDataFrame(rows, "id string, vector array<float>, content string, metadata map<string,string>")
    for name in ("007", "a/b=1 +%", "Ünï"):
        store.create(name, "m", 1)
        store.upsert_embeddings(name, one)
    assert store.collection_names() == sorted(["007", "a/b=1 +%", "Ünï"])
    assert {r["collection"] for r in store.embeddings().collect()} == {"007", "a/b=1 +%", "Ünï"}
    assert store.embeddings("007").count() == 1 and store.embeddings("a/b=1 +%").count() == 1
    assert all(r["entries"] == 1 and r["bytes"] > 0 for r in store.info().collect())


def test_walk_does_not_enter_linked_directories(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.py").write_text("a = 1\n")
    (tmp_path / "y").symlink_to(tmp_path / "x")
    (tmp_path / "x" / "up").symlink_to(tmp_path)
    assert [r["path"] for r in walk(spark, str(tmp_path)).collect()] == [f"{tmp_path}/x/a.py"]


def test_a_directory_is_listed_and_read_in_parts(tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "lost").symlink_to(tmp_path / "nothing")
    (tmp_path / "linked").symlink_to(tmp_path / "sub")
    for i in range(25):
        (tmp_path / f"{i}.txt").write_text("x" * i)
    monkeypatch.setattr(source_files, "LISTED_ROWS", 10)
    parts = list(source_files._list_directories(iter([pd.DataFrame({"path": [f"file://{tmp_path}"]})])))
    assert [len(part) for part in parts] == [10, 10, 7]
    found = {tuple(row) for part in parts for row in part.itertuples(index=False)}
    own = {(f"file://{tmp_path}/{i}.txt", i, False) for i in range(25)}
    assert found == own | {(f"file://{tmp_path}/sub", 0, True), (f"file://{tmp_path}/lost", 0, False)}
    monkeypatch.setattr(source_files, "HELD_BYTES", 100)
    listed = pd.DataFrame({"path": [f"{i}.txt" for i in range(25)], "length": range(25)})
    read = list(source_files._read_batches(f"file://{tmp_path}")(iter([listed])))
    assert all(sum(part["length"]) < 100 + 25 for part in read) and [len(x) for part in read for x in part["raw"]] == list(range(25))
