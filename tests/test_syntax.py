"""Syntax nodes: the scanner on strings, comments and nesting, numbering, joins on ranges against brute force, unreadable files."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import syntax as ops
from tessera.sources import facts, syntax

TS = """// class Fake {}
import { a, b as c } from './x';
import './side';
/* function hidden() {
} */
export class C1<T extends { a: number }> extends Base {
  private count = 0;
  @deco() async area(width: number): Promise<number> {
    const text = "function quoted() {}" + 'it\\'s {';
    if (width / 2 > 1) { return helper(`${width + (() => { return 1; })()} } class T {`) / 2; }
  }
  static load() { return new C1(); }
}
interface Shape {
  size(): number;
}
type Pair = { a: number } | string
export const LIMIT = {
  x: 1,
}, other = 2;
export default function helper(value: string): { n: number } {
  let re = /function f\\(\\) {[/}]/g, half = value / 2 / 3;
  function inner(x) {
    return x;
  }
  total += inner(value);
  return { n: re };
}
let chained = value
  .map(f)
  .filter(g)
let after
"""
GO = """package main
import (
	"fmt"
	q "os/exec"
)
// func Fake() {}
type Shape struct {
	Name string
}
type Reader interface { Read() int }
const (
	A = 1
	b = 2
)
var text = `func quoted() {
}`
func (s *Shape) Area(w int) int {
	r := '{'
	return helper(w) + int(r)
}
func helper(v int) (n int, err error) {
	if v > 0 { fmt.Println("}") }
	return v
}
"""
RUST = """/* outer /* inner */ fn hidden() {} */
use std::{fmt, io};
pub(crate) struct Point<'a> { x: &'a str }
impl<'a> fmt::Display for Point<'a> {
    pub async fn area(&self) -> u32 {
        let text = r#"fn quoted() { "}" "#;
        helper(text.len(), '{', '\\'')
    }
}
pub trait Shape { fn size(&self) -> u32; }
macro_rules! twice { ($x:expr) => { $x * 2 }; }
static mut N: u32 = 3;
fn helper(v: usize) -> u32 {
    fn inner(x: u32) -> u32 { x }
    inner(1)
}
mod deep { pub fn f() {} }
"""


def declared(text, language):
    return {(r[6], r[4], r[7], r[8], r[9]) for r in syntax.scanned_nodes(text, language) if r[4] in ops.SYMBOLS}


def test_typescript_declarations():
    assert declared(TS, "typescript") == {
        ("C1", "ClassDeclaration", 6, 13, True), ("area", "MethodDefinition", 8, 11, False), ("text", "ConstantDeclaration", 9, 9, False), ("load", "MethodDefinition", 12, 12, False), ("Shape", "InterfaceDeclaration", 14, 16, False), ("size", "MethodDefinition", 15, 15, False),
        ("Pair", "TypeAlias", 17, 17, False), ("LIMIT", "ConstantDeclaration", 18, 20, True), ("helper", "FunctionDeclaration", 21, 28, True), ("re", "VariableDeclaration", 22, 22, False), ("inner", "FunctionDeclaration", 23, 25, False), ("chained", "VariableDeclaration", 29, 31, False), ("after", "VariableDeclaration", 32, 32, False),
    }
    kinds = [(r[4], r[6], r[7]) for r in syntax.scanned_nodes(TS, "typescript")]
    assert {k for k in kinds if k[0] == "ImportDeclaration"} == {("ImportDeclaration", "./x", 2), ("ImportDeclaration", "./side", 3)}
    assert ("NewExpression", "C1", 12) in kinds and ("CallExpression", "helper", 10) in kinds and ("AssignmentExpression", "total", 26) in kinds
    assert not {k[1] for k in kinds} & {"Fake", "hidden", "quoted", "T2"}


def test_go_declarations():
    assert declared(GO, "go") == {
        ("main", "PackageClause", 1, 1, False), ("Shape", "StructDeclaration", 7, 9, True), ("Reader", "InterfaceDeclaration", 10, 10, True), ("Read", "MethodDefinition", 10, 10, False), ("A", "ConstantDeclaration", 12, 12, True), ("b", "ConstantDeclaration", 13, 13, False),
        ("text", "VariableDeclaration", 15, 16, False), ("Area", "MethodDefinition", 17, 20, True), ("helper", "FunctionDeclaration", 21, 24, False),
    }


def test_rust_declarations():
    assert declared(RUST, "rust") == {
        ("Point", "StructDeclaration", 3, 3, True), ("Point", "ImplDeclaration", 4, 9, False), ("area", "FunctionDeclaration", 5, 8, True), ("text", "VariableDeclaration", 6, 6, False), ("Shape", "TraitDeclaration", 10, 10, True), ("size", "FunctionDeclaration", 10, 10, False),
        ("twice", "MacroDeclaration", 11, 11, False), ("N", "StaticDeclaration", 12, 12, False), ("helper", "FunctionDeclaration", 13, 16, False), ("inner", "FunctionDeclaration", 14, 14, False), ("deep", "ModuleDeclaration", 17, 17, False), ("f", "FunctionDeclaration", 17, 17, True),
    }


@pytest.mark.parametrize("language", ["typescript", "go", "rust"])
def test_numbers_nest_whatever_the_text(language):
    r = random.Random(7)
    bits = ["{", "}", "(", ")", "[", "]", "`", "${", '"', "'", "/*", "*/", "//", "\n", " ", "class A", "function f", "func g", "fn h", "type T", "const (", "impl X for Y", "import", "export", "=", ";", "x", ".", "r#", "/", "\\", "é", "new Z", "let"]
    for text in [TS, GO, RUST, "", *("".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(1500))]:
        rows = list(syntax.scanned_nodes(text, language))
        for k, row in enumerate(rows):
            pre, last, parent, depth = row[:4]
            assert pre == k <= last < len(rows) and row[7] <= row[8]
            if k:
                above = rows[parent]
                assert above[0] < pre and last <= above[1] and depth == above[3] + 1


def test_python_nodes_and_their_names():
    text = 'import os, re as r\nfrom ..a import b\n@deco\nclass _C(B):\n    async def m(self, x: int = 1): return self.y(x)\nA: int = 2\nz = w = A\n'
    rows = list(syntax.python_nodes(text))
    got = {(r[4], r[6], r[7], r[8], r[9]) for r in rows}
    assert {("Import", "os,re", 1, 1, False), ("ImportFrom", "..a", 2, 2, False), ("ClassDef", "_C", 3, 5, False), ("AsyncFunctionDef", "m", 5, 5, False), ("Name", "A", 6, 6, True), ("Name", "z", 7, 7, True), ("Call", "y", 5, 5, False)} <= got
    for pre, last, parent, *_ in rows[1:]:
        assert rows[parent][0] < pre <= last <= rows[parent][1]


def test_ranges_meet_like_brute_force(spark):
    r = random.Random(1)
    rows = [(f"f{k}", *x) for k in range(3) for x in syntax.scanned_nodes(TS * r.randrange(1, 9), "typescript")]
    nodes = spark.createDataFrame([(x[0], x[1], x[2], x[7]) for x in rows], "file_path string, pre long, last long, name string")
    roots = nodes.where("pre % 7 = 0").select("file_path", F.col("pre").alias("root"), F.col("last").alias("root_last"))
    want = {(a[0], a[1], b[1]) for a in rows if a[1] % 7 == 0 for b in rows if a[0] == b[0] and a[1] <= b[1] <= a[2]}
    for cell in (1, 64, 5000):
        got = [(x.file_path, x.root, x.pre) for x in ops.within(roots, nodes, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_unreadable_files_are_rows_and_hold_up_no_other(spark, tmp_path):
    for name, content in {"a.py": b"def f():\n    return 1\n", "bad.py": b"def f(:\n", "latin.ts": b"// caf\xe9\nclass A {}\n", "b.rs": b"fn g() {}\n", "c.xyz": b"?", "deep.py": b"(" * 5000, "e.go": b""}.items():
        (tmp_path / name).write_bytes(content)
    nodes = syntax.nodes(facts.binary_files(spark, str(tmp_path))).cache()
    bad = {r.file_path.rsplit("/", 1)[1]: r.error.split(":")[0] for r in ops.failures(nodes).collect()}
    assert set(bad) == {"bad.py", "latin.ts", "c.xyz", "deep.py"} and bad["bad.py"] == "SyntaxError" and bad["latin.ts"] == "UnicodeDecodeError"
    assert {(r.file_path.rsplit("/", 1)[1], r.name) for r in ops.symbols(nodes).collect()} == {("a.py", "f"), ("b.rs", "g")}
    assert nodes.where("type = 'Program'").count() == 1  # an empty file gives no row
    made = spark.createDataFrame([("x.py", None), ("y.py", ""), (None, "z")], "file_path string, content string")
    got = {(r.file_path, r.type, (r.error or "").split(":")[0]) for r in syntax.nodes(made).collect()}
    assert got == {("x.py", None, "ValueError"), ("y.py", "Module", ""), (None, None, "ValueError")}


def test_relevant_code_is_cut_from_spans(spark):
    files = spark.createDataFrame([("m.ts", TS)], "file_path string, content string")
    nodes = syntax.nodes(files).cache()
    found = ops.symbols(nodes)
    code = ops.relevant_code(found.where("name in ('Shape', 'C1', 'area', 'Pair')"), files).first().code
    lines = TS.split("\n")
    assert code == "\n\n".join("\n".join(lines[a - 1 : b]) for a, b in ((6, 13), (14, 16), (17, 17)))
