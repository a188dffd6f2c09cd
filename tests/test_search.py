import numpy as np
import pyarrow as pa
import pytest

from indexloom.operators import search as S
from indexloom.operators import embed
from indexloom.operators.embed import batched_model, get_model, hashed_vectors


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    v[50:60] = v[0]  # ties
    v[7] = 0  # no direction
    return v


def frame(spark, vectors, key="id", text=False):
    rows = [(f"v{i:03d}" if text else i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} {'string' if text else 'long'}, vector array<double>").repartition(5)


def brute(vectors, queries, k, threshold):
    out = set()
    for q, a in enumerate(queries):
        scored = []
        for i, b in enumerate(vectors):
            size = np.linalg.norm(a) * np.linalg.norm(b)
            if size and (threshold is None or round(a @ b / size, 12) >= threshold):
                scored.append((-round(a @ b / size, 12), i))
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def rows(df):
    return {(r["query_id"], r["id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k,threshold", [(1, 0.0), (7, 0.2), (1000, None), (10, 0.999)])
def test_against_brute_force(spark, vectors, k, threshold, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK_BYTES", 40 * 64)
    monkeypatch.setattr(S, "CORPUS_BUFFER_BYTES", 10 * 64)
    corpus, queries = frame(spark, vectors), frame(spark, vectors, "query_id")
    expected = brute(vectors, vectors, k, threshold)
    assert rows(S.search_batch(corpus, queries, k, threshold)) == expected
    assert rows(S.search_batch(corpus, queries, k, threshold, max_query_bytes=0)) == expected


def test_text_ids(spark, vectors, monkeypatch):
    monkeypatch.setattr(S, "CORPUS_BUFFER_BYTES", 10 * 64)
    corpus, queries = frame(spark, vectors, text=True), frame(spark, vectors[:3], "query_id", text=True)
    expected = {(f"v{q:03d}", f"v{i:03d}", r) for q, i, r in brute(vectors, vectors[:3], 5, 0.2)}
    assert rows(S.search_batch(corpus, queries, 5)) == expected
    assert rows(S.search_batch(corpus, queries, 5, max_query_bytes=0)) == expected


def test_single_query_and_filter(spark, vectors):
    corpus = frame(spark, vectors)
    found = [(r["id"], r["score"]) for r in S.search(corpus, list(vectors[0]), 4).collect()]
    assert [i for i, _ in found] == [0, 50, 51, 52]
    scored = S.with_scores(corpus, list(vectors[0])).filter("score >= 0.2")
    assert {r["id"] for r in scored.collect()} == {i for _, i, _ in brute(vectors, vectors[:1], 1000, 0.2)}


def test_best_needs_a_positive_score(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 1.0]), (2, [-1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["query_id"], r["id"]) for r in S.search_best(corpus, queries).collect()] == [(1, 1)]


def test_empty_sides(spark, vectors):
    corpus, none = frame(spark, vectors), frame(spark, vectors).filter("id < 0")
    queries = corpus.withColumnRenamed("id", "query_id")
    assert S.search_batch(none, queries).count() == 0
    assert S.search_batch(none, queries, max_query_bytes=0).count() == 0
    assert S.search_batch(corpus, none.withColumnRenamed("id", "query_id")).count() == 0


def test_dimension_mismatch(spark, vectors):
    with pytest.raises(Exception, match="dimensions"):
        S.search(frame(spark, vectors), [1.0, 2.0]).collect()


def test_over_fetch_returns_fewer(spark):
    # ten entries closer than the only one of the wanted type
    corpus = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(10)] + [(99, [1.0, 1.0])], "id long, vector array<double>")
    chunks = spark.createDataFrame(
        [(i, "a", None) for i in range(0, 10, 2)] + [(99, "b", "p")], "id long, type string, parent_id string"
    )
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")

    def ids(**kw):
        found = S.search_chunks(corpus, chunks, query, **kw)
        return [r["id"] for r in found.orderBy("rank").collect()]

    assert ids(limit=3) == [0, 2, 4]  # entries 1, 3, 5 have no chunk row
    assert ids(limit=5, chunk_type="b") == []
    assert ids(limit=5, chunk_type="b", prefilter=True) == [99]
    assert ids(limit=6, parent_id="p") == [99]
    assert ids(limit=6, threshold=0.9999) == [0]


def test_hashed_vectors(spark):
    texts = [(0, "a b a"), (1, ""), (2, " \n\t "), (3, "A  B\x0bA "), (4, "\u00c9t\u00e9")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: np.array(r["vector"]) for r in hashed_vectors(df, "text", 16).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and all(len(v) == 16 for v in got.values())
    assert not got[1].any() and not got[2].any()
    assert np.array_equal(got[0], got[3])
    assert np.isclose(np.linalg.norm(got[4]), 1)


def test_rows_of_one_key_keep_their_own_vectors(spark):
    rows = [(7, "a b", {"k": "v"}), (7, "c", None), (7, None, None)]
    found = hashed_vectors(spark.createDataFrame(rows, "id long, text string, extra map<string,string>"), "text", 16)
    alone = hashed_vectors(spark.createDataFrame([("a b",), ("c",)], "text string"), "text", 16).collect()
    assert {r["text"]: r["vector"] for r in found.collect()} == {r["text"]: r["vector"] for r in alone}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["id", "text", "extra", "vector"] and "hashpartitioning" not in plan and "Join" not in plan


def test_batched_model(spark):
    opened = batched_model("lengths", 2, lambda: lambda ts: np.array([[len(t), 1] for t in ts]), batch_size=3)
    df = spark.createDataFrame([(str(i), "x" * i) for i in range(8)], "id string, content string").repartition(2)
    got = {r["id"]: list(r["vector"]) for r in opened.embed(df, "content").collect()}
    assert got == {str(i): [float(i), 1.0] for i in range(8)}
    with pytest.raises(KeyError, match="hash-64"):
        get_model("nope")


def test_partial_top_k_before_the_shuffle(spark, vectors):
    corpus = frame(spark, vectors)
    df = S.search_batch(corpus, corpus.withColumnRenamed("id", "query_id"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_vectors_of_different_lengths_are_refused():
    with pytest.raises(ValueError):
        S._matrix(pa.array([[1.0, 2.0], [1.0], [1.0, 2.0, 3.0]]))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_not_shuffled(spark, vectors, tmp_path):
    frame(spark, vectors).write.parquet(str(tmp_path / "corpus"))
    corpus, queries = spark.read.parquet(str(tmp_path / "corpus")), frame(spark, vectors, "query_id")
    plan = plan_of(S.search_batch(corpus, queries, 3, max_query_bytes=0))
    below = plan[plan.index("MapInArrow") :]
    assert below.count("Scan parquet") == 1 and "Exchange" not in below.replace("RoundRobin", "")[below.index("Scan") :]
    # hits of one query are merged in two steps
    assert plan.count("hashpartitioning(query_id") == 2 and "hashpartitioning(query_id" in plan and "_part" in plan


def test_scores_do_not_depend_on_where_a_vector_stands():
    from indexloom.operators.search import _TopK

    draw = np.random.default_rng(3)
    vectors, queries = draw.standard_normal((30_000, 64)).astype("f4").astype("f8"), draw.standard_normal((4, 64))
    best = _TopK(queries, 30_000, None)
    for lo in range(0, 30_000, 7_001):
        best.add(np.arange(30_000)[lo : lo + 7_001], vectors[lo : lo + 7_001])

    def summed(a, b):
        total = np.zeros(len(a))
        for j in range(64):
            total += a[:, j] * b[j]
        return total

    squares = sum(vectors[:, j] * vectors[:, j] for j in range(64))
    for q, query in enumerate(queries):
        own = summed(query[None, :], query)[0]
        expected = summed(vectors, query) / np.sqrt(squares * own)
        ids, scores = best.best[q]
        assert len(ids) == 30_000
        assert np.array_equal(scores, np.copysign(np.floor(np.abs(expected) * 1e12 + 0.5), expected)[ids] / 1e12)


def test_texts_are_encoded_in_stretches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(embed, "BATCH_CHARS", 10)
    texts = pa.array(["x" * 25, "y", None, "", "z" * 9, "w", "v"]).slice(0, 7).drop_null()
    assert [part.to_pylist() for part in embed._stretches(texts, 3)] == [["x" * 25], ["y", "", "z" * 9], ["w", "v"]]
    texts = ["a b\tb\x1cc ", " \n", "\x85 d\x0be\x0cA"]
    own = embed._hashing(16)(pa.array(["q", *texts]).slice(1))
    monkeypatch.setattr(embed, "KNOWN_TOKENS", 1)
    assert np.array_equal(own, embed._hashing(16)(pa.array(texts))) and not own[1].any()
