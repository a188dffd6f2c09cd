import random

from pyspark.sql import functions as F

from indexloom.functions import globs, labels, text, tokens
from indexloom.functions.metadata import chunk_from_json, chunk_json


def column(spark, fn, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").repartition(2)
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_decode_drops_bad_bytes(spark):
    rng = random.Random(3)
    pieces = [b"a", b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xff", b"\xe2\x82", b"\xc0\xaf", b"\xed\xa0\x80",
              b"\xf5\x80", b"\xef\xbf\xbd", b"\x1a", b"\x1ae", b"\x1ar", b"\x80", b"\xf0\x80\x80"]
    raw = [b"".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(500)]
    raw += [bytes(rng.choices(range(256), k=rng.randint(0, 12))) for _ in range(500)]
    assert column(spark, text.decode_utf8_lossy, raw, "binary") == [b.decode("utf-8", "ignore") for b in raw]


def test_lines_and_white_space(spark):
    rng = random.Random(4)
    pieces = ["a", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2028",
              "\u2029", "\u3000", "\u200b", "\u2003", "@"]
    values = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(800)]
    assert column(spark, text.split_lines, values) == [v.splitlines() for v in values]
    assert column(spark, text.line_count, values) == [len(v.splitlines()) for v in values]
    assert column(spark, text.strip_ws, values) == [v.strip() for v in values]
    assert column(spark, text.is_blank, values) == [not v.strip() for v in values]
    assert column(spark, text.indent_width, values) == [len(v) - len(v.lstrip()) for v in values]
    assert column(spark, text.normalise_newlines, values) == [v.replace("\r\n", "\n").replace("\r", "\n") for v in values]


def test_human_size(spark):
    sizes = [0, 1, 512, 1023, 1024, 1536, 1024**2 - 1, 1024**2, 5 * 1024**3, 1024**6]
    assert column(spark, text.human_size, sizes, "long") == [
        "0 B", "1.0 B", "512.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "5.0 GB", "1.0 EB",
    ]


def test_windows_and_previews(spark):
    texts = ["\n".join(map(str, range(n))) for n in (1, 4, 5, 9)]
    got = column(spark, lambda v: text.context_window(v, 2), texts)
    assert [(r["content"], r["start_line"]) for r in got] == [
        ("0", 1), ("0\n1\n2\n3", 1), ("0\n1\n2\n3", 1), ("2\n3\n4\n5", 3),
    ]
    long = column(spark, text.snippet, ["x" * 500, "\u00e9" * 501])
    assert [(len(r["snippet"]), r["truncated"]) for r in long] == [(500, False), (500, True)]
    assert column(spark, lambda v: text.file_preview(v, 2), texts[:2]) == ["0", "0\n1\n... (2 more lines)"]


def test_paths(spark):
    paths = ["a/b.PY", "a.b/c", ".profile", "x/.hidden.txt", "..x", "a.tar.gz", "x."]
    assert column(spark, text.extension, paths) == [".py", "", "", ".txt", "", ".gz", "."]
    assert column(spark, lambda v: text.relative_path(v, "/r/s/"), ["/r/s/a", "/r/sa", "b"]) == ["a", "/r/sa", "b"]
    assert column(spark, labels.language_label, ["a.py", "b.TSX", "c", "d.zz"]) == ["python", "tsx", "text", "text"]


def test_globs(spark):
    names = ["a.py", "b.pyc", "[x]", "a-b", "a^b", "x/y.py", "\u00e9.py", "a\nb"]
    for pattern, expected in {
        "*.py": ["a.py", "x/y.py", "\u00e9.py"],
        "?.py": ["a.py", "x/y.py", "\u00e9.py"],
        "[ab].py*": ["a.py", "b.pyc"],
        "[!a].py*": ["b.pyc", "x/y.py", "\u00e9.py"],
        "[[]x]": ["[x]"],
        "a[-^]b": ["a-b", "a^b"],
        "a?b": ["a-b", "a^b", "a\nb"],
        "[x": [],
    }.items():
        hits = column(spark, lambda v, p=pattern: globs.basename_matches(v, p), names)
        assert [n for n, hit in zip(names, hits) if hit] == expected, pattern


def test_token_counts(spark):
    values = ["", "one two, three_4!", "\u00e9t\u00e9 \u2014 a"]
    assert column(spark, tokens.word_token_count, values) == [0, 5, 3]
    assert column(spark, tokens.encoder_token_count(lambda: list), values) == [0, 17, 7]


def test_chunk_json(spark):
    schema = "id string, parent_id string, metadata map<string,string>"
    df = spark.createDataFrame([("a", None, {}), ("b", "a", {"k": "v"})], schema)
    out = df.select("id", chunk_json("id", "parent_id", "metadata").alias("j")).orderBy("id")
    assert [r["j"] for r in out.collect()] == ['{"id":"a"}', '{"id":"b","parent_id":"a","metadata":{"k":"v"}}']
    back = out.select(chunk_from_json(F.col("j"), df.schema).alias("c")).select("c.*").orderBy("id")
    assert [tuple(r) for r in back.collect()] == [("a", None, {}), ("b", "a", {"k": "v"})]
