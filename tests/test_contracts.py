import random

import pytest

from changeloom.operators import contracts

SCHEMA = "path string, status string, patch string"


def found(spark, rows):
    out = contracts.changed_contracts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", kind string")).collect()
    return {(r.path, r.name): (r.kind, r.change, r.before, r.after, r.moved_from) for r in out}


def hunk(*lines, head=""):
    return "\n".join([f"@@ -1,9 +1,9 @@ {head}", *lines])


def test_by_hand(spark):
    a = hunk(" import x", "-export function load(a: string): void {", "+export function load(a: string, b: number): void {", "   body()", " }", "-const LIMIT = 5", "+const LIMIT = 6")
    a += "\n" + hunk(" export interface Shape {", "   x: number", "-  y: number", "+  z: number", " }", " function keep(a) {", "-  old body", "+  new body", " }")
    b = hunk("-def parse_all(", "-    text,", "-    limit=3,", "-):", "-    return 1", "+def parse_all(text, limit=3):", "+    return 2", "-func (s *Server) Serve(addr string) error {", "-}", "-class Widget extends Base {", "+class Widget extends Base{")
    rows = [("a.ts", "modified", a), ("b.py", "modified", b), ("c.rs", "removed", hunk("-pub fn gone_one(x: u8) -> u8 {", "-}")), ("d.ts", "added", hunk("+export function fresh() {", "+}")), (None, "modified", a), ("e.ts", "modified", None), ("f.ts", None, ""), ("a.ts", "modified", a)]
    got = found(spark, rows)
    assert got == {
        ("a.ts", "load"): ("callable", "changed", "export function load(a: string): void", "export function load(a: string, b: number): void", None),
        ("a.ts", "LIMIT"): ("value", "changed", "const LIMIT = 5", "const LIMIT = 6", None),
        ("a.ts", "Shape"): ("type", "changed", "export interface Shape {\n  x: number\n  y: number\n}", "export interface Shape {\n  x: number\n  z: number\n}", None),
        ("b.py", "Serve"): ("callable", "removed", "func (s *Server) Serve(addr string) error", None, None),
        ("b.py", "parse_all"): ("callable", "changed", "def parse_all(\n    text,\n    limit=3,\n):", "def parse_all(text, limit=3):", None),
        ("c.rs", "gone_one"): ("callable", "removed", "pub fn gone_one(x: u8) -> u8", None, None),
    }


def test_moves_and_overloads(spark):
    rows = [
        ("old.ts", "modified", hunk("-export function moved(a: A) {", "-}", "-export function same(a: A) {", "-}", "-export function twice(a: A) {", "-}")),
        ("new.ts", "added", hunk("+export function moved(a: A, b: B) {", "+}", "+export function same(a: A) {", "+}", "+export function twice(b) {", "+}")),
        ("third.ts", "modified", hunk("+export function twice(c) {", "+}", " export function moved(old) {", " }")),
        ("over.ts", "modified", hunk(" function over(a: string)", "-function over(a: number, b: string)", "+function over(a: number, b: string, c: boolean)", " function over(z)")),
    ]
    got = found(spark, rows)
    assert got.pop(("over.ts", "over")) == ("callable", "changed", "function over(a: number, b: string)", "function over(a: number, b: string, c: boolean)", None)
    assert got[("new.ts", "moved")] == ("callable", "changed", "export function moved(a: A)", "export function moved(a: A, b: B)", "old.ts")
    assert {k for k in got} == {("old.ts", "moved"), ("old.ts", "same"), ("old.ts", "twice"), ("new.ts", "moved")}
    assert found(spark, []) == {}


def test_generated_patches_against_a_plain_walk(spark):
    """One declaration a hunk, over files; the walk knows what it wrote."""
    rng, rows, want = random.Random(7), [], {}
    shapes = {"callable": ("export function {n}({a}) {{", "def {n}({a}):", "pub fn {n}({a}) -> u8 {{"), "value": ("const {n} = '{a}'",)}
    for i in range(60):
        path, parts = f"f{i}.ts", []
        for j in range(rng.randrange(1, 4)):
            name, kind = f"name{i}x{j}", rng.choice(["callable", "callable", "value"])
            shape = rng.choice(shapes[kind])
            a, b = rng.choice(["x", "x, y"]), rng.choice(["x", "x, y", "x,y"])
            before, after = shape.format(n=name, a=a), shape.format(n=name, a=b)
            # A value's block takes what is indented deeper along.
            trim = lambda s: s.removesuffix(" {") + ("\n    body" if kind == "value" else "")  # noqa: B023, E731
            if rng.random() < 0.3:
                parts.append(hunk(" context", f"-{before}", "-    body", " tail"))
                want[path, name] = (kind, "removed", trim(before), None, None)
            else:
                parts.append(hunk(f"-{before}", f"+{after}", "     body"))
                # Blanks within a constant's quotes count like others, as after a comma.
                if a != b and not {a, b} == {"x, y", "x,y"}:
                    want[path, name] = (kind, "changed", trim(before), trim(after), None)
        rows.append((path, "modified", "\n".join(parts)))
    assert found(spark, rows) == want and len(want) > 40


@pytest.mark.parametrize("n", [10, 11])
def test_long_signatures_are_cut(spark, n):
    lines = ["def wide("] + [f"    a{k}," for k in range(n - 2)] + ["):"]
    got = found(spark, [("w.py", "modified", hunk(*[f"-{x}" for x in lines], "+def wide():"))])
    assert got["w.py", "wide"][2] == "\n".join(lines[:10]).rstrip()


def test_lines_that_were_left_behind(spark):
    made = spark.createDataFrame([("a.ts", "load", "changed"), ("b.ts", "load", "removed"), ("a.ts", "$x", "changed"), ("a.ts", None, "changed")], "path string, name string, change string")
    lines = spark.createDataFrame([("c.ts", 1, "load(load)"), ("c.ts", 2, "reload()"), ("a.ts", 3, "load()"), ("d.ts", 4, "load()"), ("e.ts", 5, "f($x)"), (None, 1, "load"), ("e.ts", None, "load"), ("e.ts", 6, None)], "path string, line int, content string")
    edited = spark.createDataFrame([("d.ts", 4), ("d.ts", 4)], "path string, line int")
    got = sorted(tuple(r) for r in contracts.left_behind(made, lines, edited).collect())
    assert got == [("$x", "a.ts", "changed", "e.ts", 5), ("load", "a.ts", "changed", "c.ts", 1), ("load", "b.ts", "removed", "a.ts", 3), ("load", "b.ts", "removed", "c.ts", 1)]
    assert contracts.left_behind(made.limit(0), lines, edited).count() == 0
