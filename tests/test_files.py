import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import files as ff
from corpusloom.plans import ingest as plans
from corpusloom.schema import SYMBOL
from corpusloom.settings import Settings
from corpusloom.sources.tables import json_rows, write_json
from corpusloom.sources.tree import readable, scan
from corpusloom.streaming.ingest import follow, latest

RULES = {
    "node_modules/lodash/index.js": "node_modules", ".venv/bin/python": ".venv", ".git/config": ".git", "logs/app.log": "logs", "debug.log": "*.log", "src/__pycache__/main.pyc": "__pycache__", "src/main.pyc": "*.pyc",
    "poetry.lock": "*.lock", "package-lock.json": "*lock.json", "pnpm-lock.yaml": "*lock.yaml", "coverage/lcov.info": "coverage", "htmlcov/index.html": "htmlcov", ".github/cache/data.json": ".github/cache",
    "src/main.py": None, "README.md": None, "a/build": "build", "DEBUG.LOG": "*.log", "Build/x.py": None, "rebuild/x.py": None,
}


def test_ignore_rules(spark):
    df = spark.createDataFrame(list(RULES.items()), "path string, want string")
    got = {r.path: r.got for r in df.select("path", ff.ignore_rule(F.col("path")).alias("got")).collect()}
    assert got == RULES


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("a.py", b"x = 1\n", "text"), ("a.py", b"", "empty"), ("a.dat", b"ab\x00c", "binary"), ("a.dat", b"\x01" * 31 + b"a" * 69, "binary"), ("a.dat", b"\x01" * 30 + b"a" * 70, "text"), ("a.PNG", b"x", "binary_suffix"),
        ("dist/a.js", b"x", "ignored"), ("a.txt", "é".encode() * 70 + b"\x01" * 31, "binary"), ("a.txt", b"\xff\xfeabc", "text"),
    ],
)
def test_disposition(spark, path, content, want):
    df = spark.createDataFrame([(path, bytearray(content), len(content))], "p string, c binary, n long")
    assert df.select(ff.disposition(F.col("p"), F.col("c"), F.col("n"))).first()[0] == want


def test_decode_and_language(spark):
    df = spark.createDataFrame([(bytearray(b"a\r\nb\rc"),), (bytearray(b"a\xffb"),), (None,)], "c binary")
    assert [r[0] for r in df.select(ff.decoded(F.col("c"))).collect()] == ["a\nb\nc", "ab", None]
    names = {"Dockerfile": "dockerfile", "Makefile": "makefile", "LICENSE": "text", "src/core.cpp": "cpp", "Cargo.toml": "toml", "x.ts": "typescript", "x.unknown": "text", "run": "python"}
    df = spark.createDataFrame([(n, "#!/usr/bin/env python\n" if n == "run" else None) for n in names], "p string, t string")
    assert [r[0] for r in df.select(ff.language(F.col("p"), F.col("t"))).collect()] == list(names.values())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, body in {"src/main.py": "import os\n\nclass A:\n    def f(self, x):\n        return os\n", "big.txt": "line\n" * 150, "node_modules/x.js": "x", "logo.bin": "a\x00b", "src/lib.rs": "pub struct U { id: u64 }\nimpl U {\n    pub fn new(id: u64) -> Self { U { id } }\n}\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def test_ingest_index_ask(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    plans.ingest(spark, str(tree), "demo", out)
    rows = {r.symbol_name: r for r in spark.read.parquet(f"{out}/symbols").collect()}
    assert {"A", "A.f", "U", "impl U", "impl U.new", "chunk_1", "chunk_4"} <= set(rows) and not any("node_modules" in r.file for r in rows.values())
    assert rows["A"].related_symbols == ["f"] and "takes: x" in rows["A.f"].retrieval_text
    plans.index(spark, out)
    asked = plans.ask(spark, out, spark.createDataFrame([("method A.f of demo/src/main.py inside A",)], "question string"), k=3, repo="demo").collect()
    assert len(asked) == 1 and "A.f" in asked[0].prompt and asked[0].prompt.endswith("Answer:")
    assert spark.read.parquet(f"{out}/index").count() == sum(bool(r.embedding_candidate) for r in rows.values())


def test_scan_and_follow(spark, tree, tmp_path):
    files = readable(scan(spark, str(tree), "demo"))
    assert {r.file for r in files.collect()} == {"src/main.py", "big.txt", "src/lib.rs"}
    out, mark = str(tmp_path / "stream"), str(tmp_path / "mark")
    follow(spark, str(tree), "demo", out, mark).awaitTermination()
    first = latest(spark, out).count()
    (tree / "src/more.py").write_text("def g():\n    return 1\n")
    follow(spark, str(tree), "demo", out, mark).awaitTermination()
    assert latest(spark, out).count() == first + 1


def test_scan_drops_by_path_before_reading(spark, tmp_path):
    for name in ("a b+c%20d.py", "node_modules/x.py", "out/symbols/y.py", "data/out/z.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = scan(spark, str(tmp_path), "demo", own=(str(tmp_path / "out"),))
    assert {r.file for r in found.collect()} == {"a b+c%20d.py", "data/out/z.py"}
    assert found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value() == 2
    assert scan(spark, str(tmp_path), "demo", Settings(ignored=())).count() == 4


def test_settings(tmp_path):
    file = tmp_path / "s.json"
    file.write_text('{"ignored_directories": ["b", "a", "b"], "max_file_size_mb": 2}')
    assert Settings.load(str(file)) == Settings(ignored=("b", "a"), most_bytes=2 * 2**20)
    for bad in ("{", "[]", '{"ignored_directories": "a"}', '{"max_file_size_mb": null}'):
        file.write_text(bad)
        assert Settings.load(str(file)) == Settings()
    assert Settings.load(None) == Settings.load(str(tmp_path / "missing")) == Settings()


def test_register_index_delete(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    assert plans.registered(spark, out).isEmpty()
    plans.delete(spark, out, "a/b c")
    for repo in ("a/b c", "demo"):
        plans.register(spark, out, repo, "https://h/x")
        plans.register(spark, out, repo, "https://h/x")  # not indexed yet
        plans.ingest(spark, str(tree), repo, out)
        plans.index(spark, out, repo=repo)
        plans.finish(spark, out, repo)
    rows = {r.name: r for r in plans.registered(spark, out).collect()}
    n = spark.read.parquet(f"{out}/symbols").where("repo = 'demo'").count()
    assert set(rows) == {"a/b c", "demo"} and rows["demo"].symbol_count == n and rows["demo"].file_count == 3 and rows["demo"].url == "https://h/x"
    assert sum(rows["demo"].language_breakdown.values()) == n and rows["demo"].embedding_count == spark.read.parquet(f"{out}/index").where("repo = 'demo'").count()
    with pytest.raises(ValueError):
        plans.register(spark, out, "demo")
    plans.delete(spark, out, "a/b c")
    assert [r.name for r in plans.registered(spark, out).collect()] == ["demo"] and spark.read.parquet(f"{out}/index").where("repo <> 'demo'").isEmpty()
    with pytest.raises(LookupError):
        plans.ask(spark, out, spark.createDataFrame([("x",)], "question string"), repo="a/b c")
    plans.register(spark, out, "demo", force=True)
    assert spark.read.schema("repo string").parquet(f"{out}/symbols").isEmpty()


def test_json_arrays(spark, tmp_path):
    file = tmp_path / "a.json"
    file.write_text('[{"repo": "r", "start_line": 3, "other": 1}, {"repo": null}]')
    rows = json_rows(spark, str(file), StructType([SYMBOL["repo"], SYMBOL["start_line"]]))
    assert [tuple(r) for r in rows.collect()] == [("r", 3), (None, None)]
    write_json(rows, str(tmp_path / "lines"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "lines")).count() == 2
    file.write_text("[]")
    assert json_rows(spark, str(file), SYMBOL).isEmpty()
