import random
import re
import time

from pyspark.sql import functions as F

from indexloom.operators.extract import (
    Language,
    _chunks,
    class_name,
    detect_language,
    extract_chunks,
    function_name,
    python_chunks,
    register_language,
)
from tests.conftest import SF_DIR
from workload.inputs import item_modules


def chunks(spark, *sources):
    files = spark.createDataFrame([(f"m{i}.py", s) for i, s in enumerate(sources)], "path string, content string")
    out = {}
    for r in extract_chunks(files).orderBy("path", "start_line", "type").collect():
        out.setdefault(int(r["path"][1:-3]), []).append(r)
    return [out.get(i, []) for i in range(len(sources))]


def brief(rows):
    return [(r["type"], r["name"], r["start_line"], r["end_line"], r["parent_id"]) for r in rows]


def test_single_lines(spark):
    sources = {
        "# class Z :": [("class", "Z")],
        "subclass Foo:": [("class", "Foo")],
        "class A[T]:": [],
        "def f(\n    x):": [],
        "class \u00c4b(x):": [("class", "\u00c4b")],
        "async def g():": [("function", "g")],
        "class A: def f(x):": [("class", "A"), ("function", "f")],
        "def f(a, b) -> dict[str, int]:": [("function", "f")],
        "class\x1fUnit:": [("class", "Unit")],
        "class A (Base , meta=b ) :": [("class", "A")],
        "class A2\u00b2:": [("class", "A2\u00b2")],
        "undef f():": [("function", "f")],
        "": [],
        "\n\n": [],
    }
    found = chunks(spark, *sources)
    assert [[(r["type"], r["name"]) for r in rows] for rows in found] == list(sources.values())


def test_parents(spark):
    after_class, plain, nested = chunks(
        spark,
        "class A:\n  pass\ndef f():\n  def g():\n    pass",
        "def f():\n  def g():\n    pass",
        "class A:\n    class B:\n        def m(self): pass\n    def n(self): pass\nclass C:\n    def o(self): pass",
    )
    assert brief(after_class) == [
        ("class", "A", 1, 2, None),
        ("function", "f", 3, 5, None),
        ("method", "g", 4, 5, "m0.py:class:A:0"),
    ]
    assert brief(plain) == [("function", "f", 1, 3, None), ("function", "g", 2, 3, None)]
    assert brief(nested) == [
        ("class", "A", 1, 4, None),
        ("class", "B", 2, 3, "m2.py:class:A:0"),
        ("method", "m", 3, 3, "m2.py:class:B:1"),
        ("method", "n", 4, 4, "m2.py:class:A:0"),
        ("class", "C", 5, 6, None),
        ("method", "o", 6, 6, "m2.py:class:C:4"),
    ]


def test_spans_and_columns(spark):
    blank, tabs, breaks = chunks(
        spark,
        "def f():\n  pass\n\nx = 1",
        "class A:\n\tdef f(self):\n\t\treturn 1\n\tx = 2\n",
        "class Q:\x0c  def z(): pass\u2028y = 1\r\n\x1cclass R:\x85",
    )
    assert blank[0]["end_line"] == 3 and blank[0]["content"] == "def f():\n  pass\n" and blank[0]["end_col"] == 0
    assert brief(tabs) == [("class", "A", 1, 4, None), ("method", "f", 2, 3, "m1.py:class:A:0")]
    assert tabs[1]["content"] == "\tdef f(self):\n\t\treturn 1" and tabs[1]["end_col"] == 10
    # \x1c breaks the line, so R starts in the first column of line 5
    assert brief(breaks) == [("class", "Q", 1, 2, None), ("method", "z", 2, 2, "m2.py:class:Q:0"), ("class", "R", 5, 5, None)]


def test_decorators(spark):
    one, gap, stacked = chunks(
        spark,
        "@d\ndef f():",
        "@d\n\ndef f():",
        "x = 1\n@a\n  @b(1) \n@c class K:\ndef f():",
    )
    assert (one[0]["id"], one[0]["start_line"], one[0]["decorators"]) == ("m0.py:function:f:1", 2, ["@d"])
    assert gap[0]["decorators"] == []
    assert [(r["name"], r["decorators"]) for r in stacked] == [
        ("K", ["@a", "@b(1)"]),
        ("f", ["@a", "@b(1)", "@c class K:"]),
    ]


def brute_force(path, lines):
    """Parents and ends by their definitions, looking at all pairs of lines."""
    indent = [len(x) - len(x.lstrip()) for x in lines]
    classes = [(i, m.group(1)) for i, x in enumerate(lines) if (m := re.search(r"class (\w+):", x))]
    functions = [(i, m.group(1)) for i, x in enumerate(lines) if (m := re.search(r"def (\w+)\(\):", x))]
    out = set()
    for kind, found in (("class", classes), ("function", functions)):
        for i, name in found:
            above = [(j, n) for j, n in classes if j < i and indent[j] < indent[i]]
            parent = f"{path}:class:{above[-1][1]}:{above[-1][0]}" if above else None
            ends = [j for j in range(i + 1, len(lines)) if lines[j].strip() and indent[j] <= indent[i]]
            end = ends[0] - 1 if ends else len(lines) - 1
            decorated = []
            for j in range(i - 1, -1, -1):
                if not lines[j].strip().startswith("@"):
                    break
                decorated.insert(0, lines[j].strip())
            label = "method" if kind == "function" and parent else kind
            out.add((f"{path}:{label}:{name}:{i}", parent, end + 1, "\n".join(lines[i : end + 1]), tuple(decorated)))
    return out


def test_random_indentation(spark):
    rng = random.Random(5)
    pieces = ["class C{}:", "def f{}():", "pass", "", "   ", "@deco", "x = {}", "class D{}: def g{}():"]
    files, expected = [], set()
    for n in range(400):
        path = f"r{n}.py"
        lines = [
            rng.choice(["", " ", "  ", "\t", "   ", "    "]) * rng.randint(0, 1) + rng.choice(pieces).replace("{}", str(i))
            for i in range(rng.randint(1, 25))
        ]
        lines.append("end")  # no final blank line, whose break would not count
        files.append((path, "\n".join(lines)))
        expected |= brute_force(path, lines)
    found = python_chunks(spark.createDataFrame(files, "path string, content string")).collect()
    rows = {(r["id"], r["parent_id"], r["end_line"], r["content"], tuple(r["decorators"])) for r in found}
    assert len(found) == len(rows)
    assert rows == expected


def test_languages(spark):
    files = spark.createDataFrame(
        [("a.py", "def f():"), ("B.PY", "def g():"), (".py", "def h():"), ("c.txt", "def i():"), ("d.toy", "one\ntwo")],
        "path string, content string",
    )
    found = {r["path"]: r["language"] for r in detect_language(files).collect()}
    assert found == {"a.py": "python", "B.PY": "python", ".py": None, "c.txt": None, "d.toy": None}
    assert {r["name"] for r in extract_chunks(files).collect()} == {"f", "g"}

    from indexloom.operators import extract

    def whole_file(rows):
        return python_chunks(rows.withColumn("content", F.concat(F.lit("def toy():\n "), F.col("content"))))

    register_language(Language("toy", (".toy",), whole_file))
    try:
        assert {r["name"] for r in extract_chunks(files).collect()} == {"f", "g", "toy"}
    finally:
        extract._LANGUAGES.pop("toy")


def test_extraction_does_not_shuffle(spark, tmp_path):
    files = spark.range(40).repartition(16).selectExpr("concat(id, '.py') AS path", "'def f(): pass' AS content")
    files.write.parquet(str(tmp_path / "files"))
    plan = python_chunks(spark.read.parquet(str(tmp_path / "files")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_one_file_of_very_many_definitions_takes_linear_time():
    def took(n):
        text = "class C:\n" + "".join(f"    @d\n    def f{i}(x): return {i}\n" for i in range(n))
        start = time.perf_counter()
        assert sum(1 for _ in _chunks("m.py", text)) == n + 1
        return time.perf_counter() - start

    took(1000)
    assert min(took(80_000) for _ in range(3)) < 10 * min(took(20_000) for _ in range(3))


def test_null_paths_and_contents(spark):
    rows = [(None, "class A:\n  def f(): pass"), ("n.py", None)]
    found = python_chunks(spark.createDataFrame(rows, "path string, content string")).collect()
    assert {(r["id"], r["parent_id"]) for r in found} == {("class:A:0", None), ("method:f:1", "class:A:0")}


# The language of definition lines, as patterns; the scanner is linear and must agree with them.
CLASS_PATTERN = re.compile(r"class\s+(\w+)(?:\s*\(\s*.*?\s*\))?\s*:")
FUNCTION_PATTERN = re.compile(r"def\s+(\w+)\s*\(.*?\)\s*(?:->.*?)?\s*:")


def test_the_scanner_agrees_with_the_patterns():
    draw, found = random.Random(1), 0
    tokens = ["class ", "def ", "class", "def", " ", "  ", "(", "(", ")", ")", ":", ":", "->", "a", "\u00e91", "\t", "-", ">", "x", "\u2003"]
    for _ in range(150_000):
        line = "".join(draw.choices(tokens, k=draw.randint(1, 14)))
        as_class, as_function = CLASS_PATTERN.search(line), FUNCTION_PATTERN.search(line)
        assert class_name(line) == (as_class and as_class[1]), repr(line)
        assert function_name(line) == (as_function and as_function[1]), repr(line)
        found += bool(as_class) + bool(as_function)
    assert found > 1000


def test_one_very_long_line_takes_linear_time():
    n = 100_000
    lines = ["class A(" + " " * n, "def f(" + ")->" * (n // 3), "class a(" * (n // 8), "def f(" * (n // 6) + ") " * n, "class " + " " * n + "(", "class A(" + ") " * (n // 2) + ":"]
    start = time.perf_counter()
    names = [(class_name(line), function_name(line)) for line in lines]
    assert time.perf_counter() - start < 2
    assert names == [(None, None)] * 5 + [("A", None)]


def test_line_items_are_dealt_out_before_they_are_sources(spark):
    found = extract_chunks(item_modules(spark, SF_DIR))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "order line" in plan[: plan.index("Exchange")]
