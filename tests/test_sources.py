from changeloom.sources import trees


def test_read_tree(spark, tmp_path):
    for path, data in {"src/a.py": b"x = 1\n", "node_modules/x.js": b"no", ".git/c": b"no", "bin.dat": b"a\0b", "big.txt": b"x" * 5000, "m/pom.xml": b"<p/>", "m/target/A.java": b"built", "n/target/B.java": b"kept"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    got = {r.path: r.text for r in trees.read_tree(spark, str(tmp_path), cap=1000).collect()}
    assert got == {"src/a.py": "x = 1\n", "m/pom.xml": "<p/>", "n/target/B.java": "kept"}


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text("Ann\x1fa@x\x1f2024-01-02\n3\t1\ta\n\x1eBob\x1fb@x\x1f2024-01-01\n-\t-\tb\n\x1e")
    got = trees.read_commit_log(spark, f"{tmp_path}/log").orderBy("name").collect()
    assert [(r.name, r.added, r.removed, r.files) for r in got] == [("Ann", 3, 1, 1), ("Bob", 0, 0, 1)]


def test_changed_files(spark):
    base = spark.createDataFrame([("a", "x\n"), ("b", "y z"), ("c", "s")], "path string, text string")
    head = spark.createDataFrame([("b", "y  z"), ("c", "s"), ("d", "n")], "path string, text string")
    got = trees.changed_files(base, head).orderBy("path").collect()
    assert [(r.path, r.status, r.only_white_space) for r in got] == [("a", "removed", False), ("b", "changed", True), ("d", "added", False)]
