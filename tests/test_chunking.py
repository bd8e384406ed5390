from siltseek.operators import chunking as C
from siltseek.sources.repo import list_files, read_repo


def test_js_functions_methods_and_strings():
    src = "export function run(a = {}) {\n  return '}';\n}\nconst go = async (x) => {\n  return `${x} {`;\n};\nclass Q {\n  get(x) {\n    return x; // }\n  }\n}\nif (x) {\n}\n"
    assert C.js_spans(src) == [(0, 2, "run"), (3, 5, "go"), (6, 10, "Q"), (7, 9, "get")]


def test_js_details():
    assert C.js_spans("function f() {\n  /* { */\n  const s = \"{\n  g('\\'{');\n}\n") == [(0, 4, "f")]
    assert C.js_spans("const t = `a\n${b}\n{`;\nfunction g()\n{\n}\n") == [(3, 5, "g")]
    assert C.js_spans("const f = x => x + 1;\n\n\n\n\n\nfunction h() {\n}\n")[0][2] == "h"
    assert C.js_spans("function outer() {\n  function inner() {\n  }\n}\n") == [(0, 3, "outer")]


def test_python_spans_and_fallback():
    src = "import os\n\n@wraps\ndef f(x):\n    return x\n\nclass C:\n    async def m(self):\n        pass\n"
    assert C.chunk_source("a.py", src) == [(2, 4, "f"), (6, 8, "C"), (7, 8, "m")]
    assert C.chunk_source("a.py", "def broken(:\n") == [(0, 1, "lines 1-2")]


def test_windows_python_and_native_agree(spark):
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (1, 39, 40, 41, 69, 70, 71, 100)] + ["", "\n" * 90, "x" + "\n" * 45]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in C.line_windows(df, "id", "t").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.name))
    assert {k: sorted(v) for k, v in got.items()} == {i: [(a + 1, b + 1, n) for a, b, n in C.window_spans(t)] for i, t in enumerate(texts) if C.window_spans(t)}


def test_repo_and_stable_ids(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".git").mkdir()
    files = {"__init__.py": "def a():\r\n    pass\r\n\ndef a():\n    pass\n", "_u.JS": "function z() {\n}\n", "node_modules/x.js": "function n() {\n}\n", ".git/y.py": "", "note.txt": "x"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    assert list_files(tmp_path) == ["__init__.py", "_u.JS", "bad.py"]
    rows = C.stable_ids(C.chunk_files(read_repo(spark, tmp_path))).orderBy("seq", "ord").collect()
    assert [r.sid for r in rows] == ["__init__.py::a", "__init__.py::a#2", "_u.JS::z"]
    assert rows[0].text == "def a():\n    pass" and rows[1].id == "__init__.py:4-5"
