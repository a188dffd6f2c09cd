"""Mixing, toxicity, sharding, near-duplicates, neighbours, quality rules and the pipeline on small and awkward tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from indexloom.llm import ann, mixing, quality, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, target double, bucket long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 1, 2.0, 3) for i, t, s in rows], SCHEMA)


def some_docs(n=300):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choices(["the", "of", "thing", "and", f"w{i}"], k=draw.randint(1, 60))), draw.choice(["a", "a", "a", "b", "ö", None])) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "b"), (None, "x y", "c"), (n + 2, " ", "d"), rows[0], rows[0]]


def test_mix(spark):
    rows = some_docs()
    out = mixing.mix_sizes(table(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= set(over)
        if not over:
            break
    target |= {s: level * weight[s] for s in open_}
    taken, largest = Counter(), Counter()
    for r in out:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken <= 3 * r["size"] and abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    again = mixing.mix_sizes(table(spark, rows).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    mixed = mixing.mix(table(spark, rows))
    assert mixed.columns == table(spark, []).columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(table(spark, [])).count() == 0


def test_inclusion_rates_follow_the_chances(spark):
    sizes = (4, 36, 144, 900)
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.choice(sizes)), "a") for i in range(16_000)] + [(-1, " ".join(["w"] * 1_200_000), "b")]
    out = [r for r in mixing.mix_sizes(table(spark, rows)).collect() if r.source == "a"]
    total, target = sum(r["size"] for r in out), out[0].target
    assert 0 < target < total  # one source holds too little, so the other is sampled
    open_, factor = set(sizes), 0.0
    words = {s: sum(r["size"] for r in out if r["size"] == s) for s in sizes}
    while True:  # chances in proportion to the root of the size, one at most
        factor = (target - sum(words[s] for s in sizes if s not in open_)) / sum(words[s] * s**0.5 for s in open_)
        sure = {s for s in open_ if factor * s**0.5 >= 1}
        if not sure:
            break
        open_ -= sure
    for s in sizes:
        own = [r.copies for r in out if r["size"] == s]
        chance = min(1.0, factor * s**0.5)
        assert abs(sum(own) / len(own) - chance) < 0.04
    assert abs(sum(r.taken for r in out) - target) <= max(sizes)


def test_sharding(spark, tmp_path):
    rows = some_docs(100)
    out = sharding.external_shuffle(table(spark, rows), sharding.text_bytes(F.col("text")), 7, bucket_bytes=2000)
    got = out.collect()
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(repr(r[:2]) for r in rows)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] != [r[0] for r in rows]
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.external_shuffle(table(spark, []), sharding.text_bytes(F.col("text"))).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    names = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3 and names[a] != names[b]:
                    names[a] = names[b] = min(names[a], names[b])
                    changed = True
    return names


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_every_link_is_in_some_shard(blocks):
    draw, masks = random.Random(8), simhash._masks(blocks, 3)
    for _ in range(300):
        flips = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(not flips & m for m in masks)


def test_tree_finds_all_links():
    draw = random.Random(9)
    for _ in range(30):
        base = [draw.getrandbits(64) for _ in range(4)]
        values = list({b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 4))) for b in base for _ in range(15)})
        tree = simhash.BKTree(3)
        for v in values:
            tree.add(v)
        own, expected = {v: tree.find(i) for i, v in enumerate(tree.values)}, plain_components(values)
        assert all((own[a] == own[b]) == (expected[a] == expected[b]) for a in values for b in values)


def test_large_shards_are_split_without_losing_links(spark):
    draw = random.Random(16)
    base = [draw.getrandbits(64) for _ in range(3)]
    values = sorted({b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 6))) for b in base for _ in range(80)})
    frame = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "fp long")
    how = simhash.Near(most=8)
    shards = simhash._shards(frame, how).groupBy("level", "set", "key").count()
    assert shards.filter("level < 3 AND count > 8").isEmpty() and shards.agg(F.max("level")).first()[0] >= 1
    names = {v: v for v in values}
    for a, b in [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, how).collect()]:
        a, b = names[a], names[b]
        names = {k: min(a, b) if n in (a, b) else n for k, n in names.items()}
    assert names == plain_components(values)


def test_near_duplicates(spark):
    draw = random.Random(10)
    long = [draw.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(draw.randint(0, 50)) for _ in range(400)]
    near = [" ".join([*long[:i], "changed", *long[i + 1 :]]) for i in (10, 200, 399)]
    rows = [(5, " ".join(long), "a"), *[(i, t, "a") for i, t in enumerate(near, 6)], (3, near[0].upper().replace("CHANGED", "other"), "a")]
    rows += [(20, None, "a"), (21, "", "a"), (22, "Two Words", "a"), (23, "two words", "a"), (None, "lonely one here", "a"), rows[0], rows[0]]
    out = simhash.classes(table(spark, rows)).collect()
    fps = {plain_fingerprint(t) for _, t, _ in rows}
    names = plain_components(sorted(fps))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            n = names[plain_fingerprint(t)]
            least[n] = min(least.get(n, i), i)
    expected = [(i, format(plain_fingerprint(t), "016x"), least.get(names[plain_fingerprint(t)])) for i, t, _ in rows]
    assert sorted(map(repr, expected)) == sorted(repr((r.id, format(r.fp % 2**64, "016x"), r.component_id)) for r in out)
    kept = simhash.deduplicated(table(spark, rows))
    assert kept.columns == table(spark, []).columns and kept.count() == len(set(names.values()))
    assert simhash.deduplicated(table(spark, [])).count() == 0


def test_neighbours(spark):
    draw = np.random.default_rng(11)
    base = draw.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)] + [(1000 + i, base[0].tolist(), "x") for i in range(200)]
    rows += [(5000, None, "x"), (5001, [0.0] * 8, "x"), (5002, [float("nan")] * 8, "x"), (5003, [1.0, None] * 4, "x"), (5004, [1.0], "x"), (None, base[1].tolist(), "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    how = ann.Search(sample=200, leaf=10, chunk=16, recall=1.0)
    out = ann.search(vectors, vectors.filter("vec_id % 100 = 0"), how).collect()
    good = [(i, np.array(v, dtype=float)) for i, v, _ in rows if i is not None and i < 5000]
    ids, matrix = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = n = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(axis=1))
        order = [int(ids[i]) for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(abs(r.score - far[ids == r.vec_id][0]) < 1e-12 for r in got)
        hit, n = hit + len(set(order) & {r.vec_id for r in got}), n + 10
    assert hit / n >= 0.9
    assert ann.search(vectors.limit(0), vectors.limit(0), how).count() == 0


def test_quality(spark):
    draw = random.Random(12)
    good = [" ".join(draw.choice(["the", "of", "and"]) if k % 3 == 0 else f"word{draw.randint(0, 5000)}" for k in range(150)) + "." for _ in range(60)]
    junk = ["|| ".join(f"w{draw.randint(0, 900)}***" for _ in range(90)) for _ in range(12)]
    texts = [*good, *junk, None, "", "a b c a b c d", "x\ny\nx\n\n \nx", good[0], good[0], "long " * 3000]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in quality.verdicts(table(spark, rows)).collect()}
    for i, t, _ in rows:
        words = WORD.findall(t or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if often[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert all(out[i].kept for i in range(60)) and not any(out[i].kept for i in range(60, 72))
    kept = quality.filtered(table(spark, rows))
    assert kept.columns == table(spark, []).columns and kept.count() == sum(r.kept for r in out.values())
    assert quality.verdicts(table(spark, [])).count() == 0


def test_toxicity(spark):
    draw = random.Random(13)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = draw.choices(plain, k=40), i % 5 == 0
        if toxic:
            words[draw.randrange(40)] = "grubbl" + draw.choice(["a", "ing", "ot", "us"])
            words[draw.randrange(40)] = draw.choice(["idiot", "scum", "grubblix"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "a"), (901, "", "a"), (None, "idiot scum trash", "a"), rows[5]]
    labels += [(None, 1, 1), (902, 1, None), (5, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(table(spark, rows), known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    asked = [r for r in out if r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in asked)
    held = [r for r in asked if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    flipped = spark.createDataFrame([(i, q, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels], known.schema)
    assert sorted(map(repr, toxicity.score(table(spark, rows), flipped).collect())) == sorted(map(repr, out))
    assert toxicity.score(table(spark, []), known.limit(0)).count() == 0


def test_queries_match_their_sql(spark):
    from indexloom.llm.queries import ORACLES, QUERIES
    from tests.conftest import SF_DIR
    from workload.check import connect, spark_rows, sql_rows

    for name, sql in ORACLES.items():
        assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(connect(SF_DIR), sql)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.conftest import SF_DIR

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    awkward = docs.limit(80).union(docs.limit(1)).union(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "src1", 0)], docs.schema))
    for table_ in (awkward, docs.limit(0)):
        current = table_
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, SF_DIR)
            assert current.columns == docs.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, current, SF_DIR).collect()
        assert sum(p.length for p in pieces if p.start == 0) <= sum(p.doc_tokens for p in pieces if p.start == 0)
        assert bool(pieces) == (table_ is awkward)


def test_deduplicated_keeps_one_of_each_component(spark):
    draw = random.Random(9)
    rows = some_docs(120)
    rows += [(1000 + i, " ".join(draw.choices([f"v{k}" for k in range(300)], k=80)), "a") for i in range(40)]
    rows += [(2000 + i, rows[draw.randrange(len(rows))][1], "b") for i in range(60)]
    for i in range(40):  # near copies: one word of a longer text changed
        base = draw.choice([r[1] for r in rows if r[1] and len(r[1].split()) > 20]).split()
        base[draw.randrange(len(base))] = "altered"
        rows.append((3000 + i, " ".join(base), "c"))
    rows = [r for r in rows if r[0] is not None]
    prints, root = [plain_fingerprint(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    kept = simhash.deduplicated(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_quality_with_the_names_of_helpers(spark):
    rows = some_docs(80)
    plain = table(spark, rows)
    names = ["__m", "__measures", "__votes", "__v_repeats", "__judged", "_votes", "kept", "posterior", "w", "d", "variety"]
    clashing = plain.withColumns({n: F.lit(f"own {n}") for n in names})
    kept = quality.filtered(clashing)
    assert kept.columns == clashing.columns
    assert all(r[n] == f"own {n}" for r in kept.collect() for n in names)
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr((r.doc_id, r.text)) for r in quality.filtered(plain).collect())
    assert quality.verdicts(clashing).count() == len(rows)


def test_poor_variety_is_seen_at_any_length(spark):
    draw = random.Random(8)
    few, many = [f"x{i}" for i in range(12)], [f"y{i}" for i in range(40_000)]
    rows = [(k, " ".join(draw.choices(few if k % 2 else many, k=n)), "a") for k, n in enumerate((60, 60, 800, 800, 2999, 2999, 3001, 3001, 30_000, 30_000))]
    m = quality.measures(F.col("text"))
    out = table(spark, rows).select("doc_id", m.alias("m")).select("doc_id", quality.votes(F.col("m"))["variety"].alias("v"))
    assert {r.doc_id: r.v for r in out.collect()} == {k: -1 if k % 2 else 0 for k in range(10)}
