"""The Merkle manifest, benchmark decontamination and hard-negative mining against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.llm import decontaminate, hard_negatives, merkle
from indexloom.llm.common import lowered

# columns with the names of internal ones
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, at long, tree long, node string, rank long, bin long, row long, w string, h long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "n", 3, 4, 5, "w", 6) for r in rows], CLASHING)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest


def plain_leaf(doc_id, text, lang, source, n_chars):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def plain_tree(nodes):
    """The root and, for each node, its siblings as (left, right) up to it."""
    paths, of = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for k, owners in enumerate(of[s : s + 8]):
                for leaf in owners:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            members.append([x for owners in of[s : s + 8] for x in owners])
        nodes, of = above, members
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, out = {}, []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        subs[g] = own, *plain_tree([plain_leaf(*r) for r in own])
    root, tops = plain_tree([subs[g][1] for g in order])
    for g, top in zip(order, tops, strict=True):
        own, sub, paths = subs[g]
        for r, path in zip(own, paths, strict=True):
            doc_id, text, *rest = r
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = plain_leaf(doc_id, text, *rest)
            for left, right in path + top:
                node = sha(left + node + right)
            proof = sha("".join(x + y for x, y in path + top))
            out.append((doc_id, plain_leaf(*r), sub, root, proof, node, node == root))
    return sorted(out, key=repr)


def tampered_manifest(docs, **how):
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, tamper, lowered(F.col("text")), merkle.Manifest(**how))


def manifest_rows(n):
    draw = random.Random(3)
    langs = ["en"] * 12 + ["de", None, "ä", "", "Z"]
    rows = [(i, draw.choice(["A b", "a b", "", None, "É x\n", "Ab" * 40]), draw.choice(langs), draw.choice(["s", None]), draw.choice([1, None])) for i in range(n)]
    rows += [(None, "x", "en", None, None), (5, "A again", "en", "s", 1), rows[0], rows[0], (2**53 + 1, "Long " * 50_000, "one", "s", 1)]
    return rows


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_is_brute_force(spark, depth):
    rows = manifest_rows(700)
    got = sorted((tuple(r) for r in tampered_manifest(documents(spark, rows), depth=depth).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_small_tables(spark):
    for rows in ([], [(1, "A", "en", "s", 1)], [(i, "A", f"g{i}", "s", 1) for i in range(20)], [(3, None, None, None, None)] * 9):
        got = sorted((tuple(r) for r in tampered_manifest(documents(spark, rows), depth=1).collect()), key=repr)
        assert got == (plain_manifest(rows) if rows else [])


# --- decontamination

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_report(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def leak_tables():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Äpfel", "été", "x1"]

    def prose(n):
        return draw.choice([" ", ", ", "\n"]).join(draw.choice([w, w.upper()]) for w in draw.choices(vocabulary, k=n))

    items = [(i, prose(draw.randint(8, 40))) for i in range(30)]
    items += [(30, "lone"), (31, "Two words"), (32, ""), (33, None), (None, prose(12)), (5, prose(15)), (34, items[0][1]), (35, "?!")]
    docs = []
    for i in range(200):
        parts = [prose(draw.randint(0, 60))]
        if i % 3 == 0:
            parts += [draw.choice(items)[1] or "", prose(5)]
        if i % 17 == 0:
            parts.append("a lone word, two WORDS")
        docs.append((i, " ".join(parts)))
    docs += [(None, items[1][1]), (3, docs[0][1]), docs[3], docs[3], (900, ""), (901, None), (902, "…?"), (903, " ".join([items[2][1], prose(3)] * 300))]
    return docs, items


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, gram long, says string")


@pytest.mark.parametrize("how", [{}, {"stretch": 16}, {"broadcast_bytes": 4000, "stretch": 50}])
def test_leaks_are_brute_force(spark, how):
    docs, items = leak_tables()
    frame = documents(spark, [(i, t, None, None, None) for i, t in docs])
    got = decontaminate.report(frame, benchmark(spark, items), decontaminate.Grams(**how)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_report(docs, items)


def test_leaks_of_empty_tables(spark):
    docs, items = leak_tables()
    frame = documents(spark, [(i, t, None, None, None) for i, t in docs])
    assert decontaminate.report(frame.limit(0), benchmark(spark, items)).count() == 0
    for none in ([], [(1, None), (2, "")]):
        got = decontaminate.report(frame, benchmark(spark, none)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_report(docs, none)


def test_leaks_are_removed(spark):
    docs, items = leak_tables()
    frame = documents(spark, [(i, t, None, None, None) for i, t in docs])
    dirty = {t for i, t in docs for r in plain_report([(i, t)], items) if r[-1]}
    kept = decontaminate.decontaminated(frame, benchmark(spark, items), "documents")
    assert kept.columns == frame.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(d) for d in docs if d[1] not in dirty)
    clean = decontaminate.decontaminated(frame, benchmark(spark, items), "spans", decontaminate.Grams(stretch=16))
    assert clean.columns == frame.columns
    got = clean.collect()
    assert len(got) == len(docs)
    words_left = {r[0:1] + (r[1] - r[2],) for r in plain_report(docs, items)}
    assert {(r.doc_id, len(plain_words(r.text))) for r in got} == words_left
    left = sorted(repr((r.doc_id, r.text)) for r in got)
    assert all(repr(d) in left for d in docs if d[1] not in dirty)
    one = documents(spark, [(1, "Before, Two  words; after: LONE!", None, None, None)])
    assert decontaminate.decontaminated(one, benchmark(spark, items)).first().text == "Before, ; after: !"


# --- hard negatives


def plain_negatives(rows, positives=5, negatives=3):
    use = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((i, label, tuple(int(np.floor(256 * float(x))) for x in v)))
    use = list(dict.fromkeys(use))
    out = []
    for i, label, q in use:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, other) for j, other, p in use if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(-t, k) for t, k, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, label, 1, "x", 2.0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, row long, planes string, score double"
    )


def vector_rows(n=600, dims=11, labels=4, scale=1.0):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=dims) * scale).astype("f4").tolist(), int(draw.integers(labels))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(150)]  # many equal vectors
    rows += [rows[50], rows[50], (2000, None, 1), (2050, [1.0] * dims, None), (None, [1.0] * dims, 1), (2100, [float("nan")] * dims, 1)]
    rows += [(2150, [float("inf")] + [0.0] * (dims - 1), 1), (2200, [None] + [1.0] * (dims - 1), 1), (2250, [0.0] * dims, 1), (2300, [], 2), (2350, [0.5, -0.5], 2)]
    return rows


@pytest.mark.parametrize("how", [{}, {"candidates": 64, "anchors": 5, "together": 2}])
def test_negatives_are_brute_force(spark, how):
    rows = vector_rows()
    got = hard_negatives.mine(vectors(spark, rows), F.col("id") % 50 == 0, how=hard_negatives.Mining(**how)).collect()
    expected = plain_negatives(rows)
    assert len(expected) > 50 and sorted(tuple(r) for r in got) == expected


def test_wide_scores_and_empty_tables(spark):
    rows = [(i, v, label) for i, v, label in vector_rows(200, 9, 3, 5000.0)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows)
    assert hard_negatives.mine(vectors(spark, []), F.col("id") % 50 == 0).count() == 0
    one_label = [(i, [1.0, 0.5], 1) for i in range(60)]
    assert hard_negatives.mine(vectors(spark, one_label), F.col("id") % 50 == 0).count() == 0
    with pytest.raises(OverflowError):
        hard_negatives.mine(vectors(spark, [(0, [1e30], 1)]), F.col("id") % 50 == 0)


def test_lookups_are_inner_products():
    draw = np.random.default_rng(1)
    for dims, most in ((3, 1), (64, 300), (17, 2**20)):
        q = draw.integers(-most - 1, most + 1, size=(40, -(-dims // 8) * 8))
        q[:, dims:] = 0
        q[0, 0] = -most - 1
        shape = hard_negatives.Shape(q.shape[1] // 8, most.bit_length() + 1, dims * (most + 1) ** 2 >= 1 << 30)
        planes = hard_negatives.planes_of(q, shape)
        assert (hard_negatives.numbers_of(planes, shape) == q).all()
        scores = hard_negatives.scores_of(hard_negatives.tables_of(q[:7].astype(shape.kind), shape), planes, shape, step=16)
        assert (scores == q[:7] @ q.T).all()
