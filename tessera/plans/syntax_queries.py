"""Queries over syntax nodes. The source files are made from the parts: four languages, with nesting, quoted and commented declarations, and some files that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import requests
from tessera.operators import syntax as ops
from tessera.plans.registry import query
from tessera.plans.tables import settle
from tessera.sources import facts, syntax

#: § stands for the part's number, @ for it modulo five.
PYTHON = '''"""Module §: class Fake: is prose."""
import os
from pkg@ import thing as alias

LIMIT_@ = §


class C§(Base):
    """def hidden(): pass"""

    def area(self, width):
        # def commented(): pass
        scale = LIMIT_@ * width
        return helper(scale)


def helper(value):
    text = "class Quoted: pass"

    def inner(x):
        return x + value

    return inner(text) + C§(value)
'''
TYPESCRIPT = """// class Fake {}
import { thing as alias } from './m@';

export class C§ extends Base {
  area(width: number): number {
    const scale = `${width} } class Quoted {`;
    return helper(scale);
  }
}

interface Shape@ {
  size: number;
}

export const LIMIT = {
  x: §,
};

function helper(value) {
  const inner = new C§();
  return inner;
}
"""
GO = """package main

import "fmt"

// func Fake() {}
type C§ struct {
	Size int
}

const Limit = §

func (c *C§) Area(w int) int {
	text := `func quoted() {`
	fmt.Println(text)
	return helper(w)
}

func helper(v int) int {
	return v + Limit
}
"""
RUST = """// fn fake() {}
/* outer /* inner */ fn hidden() {} */
use pkg@::Thing;

pub struct C§ {
    size: u32,
}

impl C§ {
    pub fn area(&self, w: u32) -> u32 {
        let text = r#"fn quoted() { "}" "#;
        helper(w, '{')
    }
}

const LIMIT: u32 = §;

fn helper(v: u32, c: char) -> u32 {
    println!("{}", c);
    v + LIMIT
}
"""
LANGUAGES = [(".py", PYTHON), (".ts", TYPESCRIPT), (".go", GO), (".rs", RUST)]


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content, p_partkey: a file for each part, in the language of its number modulo four; of forty, one has a syntax error and one an unknown extension."""
    k = F.col("p_partkey")
    n = k.cast("string")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in LANGUAGES]), (k % 4 + 1).cast("int"))
    text = F.replace(F.replace(pick(1), F.lit("§"), n), F.lit("@"), (k % 5).cast("string"))
    text = F.when(k % 40 == 8, F.concat(text, F.lit("def broken(:\n"))).otherwise(text)
    path = F.concat(F.lit("/lib/s"), n, F.when(k % 40 == 9, F.lit(".txt")).otherwise(pick(0)))
    return facts.table(spark, sf_dir, "part").select(path.alias("file_path"), text.alias("content"), "p_partkey")


_FILES = "s as (select p_partkey k, p_partkey % 4 l, '/lib/s' || p_partkey || case p_partkey % 4 when 0 then '.py' when 1 then '.ts' when 2 then '.go' else '.rs' end file_path from part where p_partkey % 40 not in (8, 9))"
_FILL = lambda c: f"replace(replace({c}, '§', k::varchar), '@', (k % 5)::varchar)"
# language, name, kind, first and last line, exported, parent, identifiers in order
_SYMBOLS = """y(l, name, kind, start_line, end_line, exported, parent, ids) as (values
(0, 'LIMIT_@', 'variable', 5, 5, true, null, 'LIMIT_@'), (0, 'C§', 'class', 8, 14, true, null, 'Base,scale,LIMIT_@,width,helper'), (0, 'area', 'function', 11, 14, false, 'C§', 'scale,LIMIT_@,width,helper'), (0, 'scale', 'variable', 13, 13, false, 'area', 'scale,LIMIT_@,width'), (0, 'helper', 'function', 17, 23, true, null, 'text,x,value,inner,C§'), (0, 'text', 'variable', 18, 18, false, 'helper', 'text'), (0, 'inner', 'function', 20, 21, false, 'helper', 'x,value'),
(1, 'C§', 'class', 4, 9, true, null, 'Base,width,number,helper,scale'), (1, 'area', 'method', 5, 8, false, 'C§', 'width,number,helper,scale'), (1, 'scale', 'constant', 6, 6, false, 'area', 'width'), (1, 'Shape@', 'interface', 11, 13, false, null, 'size,number'), (1, 'LIMIT', 'constant', 15, 17, true, null, 'x'), (1, 'helper', 'function', 19, 22, false, null, 'value,C§,inner'), (1, 'inner', 'constant', 20, 20, false, 'helper', 'C§'),
(2, 'main', 'package', 1, 1, false, null, ''), (2, 'C§', 'struct', 6, 8, true, null, 'Size,int'), (2, 'Limit', 'constant', 10, 10, true, null, ''), (2, 'Area', 'method', 12, 16, true, null, 'c,C§,w,int,text,fmt,Println,helper'), (2, 'helper', 'function', 18, 20, false, null, 'v,int,Limit'),
(3, 'C§', 'struct', 5, 7, true, null, 'size,u32'), (3, 'C§', 'impl', 9, 14, false, null, 'C§,w,u32,helper'), (3, 'area', 'function', 10, 13, true, 'C§', 'w,u32,helper'), (3, 'text', 'variable', 11, 11, false, 'area', ''), (3, 'LIMIT', 'constant', 16, 16, false, null, 'u32'), (3, 'helper', 'function', 18, 21, false, null, 'v,u32,c,char,println,LIMIT'))"""


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = source_files(spark, sf_dir)
    nodes = settle(syntax.nodes(f))
    return f, nodes, settle(ops.symbols(nodes))


@query(f"with {_FILES}, {_SYMBOLS} select file_path, {_FILL('name')} as name, kind, start_line::int start_line, end_line::int end_line, exported, {_FILL('parent')} parent, case when parent is null then 'global' else 'local' end as scope from s join y using (l)")
def syntax_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every file defines, with spans, parents and scopes; quoted and commented declarations are none."""
    return _parsed(spark, sf_dir)[2].select("file_path", "name", "kind", "start_line", "end_line", "exported", "parent", "scope")


@query(f"with {_FILES}, {_SYMBOLS} select file_path, {_FILL('name')} as name, start_line::int start_line, {_FILL('ids')} identifiers from s join y using (l)")
def subtree_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct identifiers below each symbol, in the order in which they come first."""
    _, nodes, found = _parsed(spark, sf_dir)
    ids = ops.dependencies(found, nodes).select("file_path", "pre", F.array_join("dependencies", ",").alias("identifiers"))
    return ops.meet(found.select("file_path", "pre", "name", "start_line"), ids, ["file_path", "pre"]).drop("pre")


@query(f"""with {_FILES}, y(l, name, type, line, end_line) as (values (0, 'helper', 'Call', 14, 14), (0, 'C§', 'ClassDef', 8, 14), (1, 'helper', 'CallExpression', 7, 7), (1, 'C§', 'ClassDeclaration', 4, 9), (2, 'helper', 'CallExpression', 15, 15), (2, 'C§', 'StructDeclaration', 6, 8), (3, 'helper', 'CallExpression', 12, 12), (3, 'C§', 'StructDeclaration', 5, 7))
select file_path, {_FILL('name')} as name, type, line::int line, end_line::int end_line from s join y using (l)""")
def first_named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first node of every file that bears its class's name, and the first that bears its helper's."""
    f, nodes, _ = _parsed(spark, sf_dir)
    names = F.explode(F.array(F.lit("helper"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")))).alias("name")
    return ops.first_named(nodes, f.select("file_path", names)).select("file_path", "name", "type", "line", "end_line")


@query(f"""with {_FILES}, y(l, symbol, kind, line, referenced_by) as (values
(0, 'LIMIT_@', 'write', 5, null), (0, 'LIMIT_@', 'read', 13, 'area'), (0, 'scale', 'write', 13, 'area'), (0, 'scale', 'read', 14, 'area'), (0, 'helper', 'call', 14, 'area'), (0, 'text', 'write', 18, 'helper'), (0, 'text', 'read', 23, 'helper'), (0, 'inner', 'call', 23, 'helper'), (0, 'C§', 'instantiation', 23, 'helper'),
(1, 'helper', 'call', 7, 'area'), (1, 'scale', 'read', 7, 'area'), (1, 'C§', 'instantiation', 20, 'helper'), (1, 'inner', 'read', 21, 'helper'), (2, 'C§', 'read', 12, 'Area'), (2, 'helper', 'call', 15, 'Area'), (2, 'Limit', 'read', 19, 'helper'), (3, 'C§', 'read', 9, 'C§'), (3, 'helper', 'call', 12, 'area'), (3, 'LIMIT', 'read', 20, 'helper'))
select file_path, {_FILL('symbol')} symbol, kind, line::int line, {_FILL('referenced_by')} referenced_by from s join y using (l)""")
def node_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each file's own symbols: calls, instances made, writes and reads, with the symbol that contains them."""
    _, nodes, found = _parsed(spark, sf_dir)
    return ops.references(nodes, found)


@query(f"""with {_FILES}, y(l, kind, target, line, n_lines) as (values (0, 'import', 'os', 'import os', 1), (0, 'import', 'pkg@', 'from pkg@ import thing as alias', 1), (1, 'import', './m@', 'import {{ thing as alias }} from ''./m@'';', 1), (1, 'export', null, 'export class C§ extends Base {{', 6), (1, 'export', null, 'export const LIMIT = {{', 3), (2, 'import', 'fmt', 'import "fmt"', 1), (3, 'import', 'pkg@::Thing', 'use pkg@::Thing;', 1))
select file_path, kind, {_FILL('target')} target, {_FILL('line')} line, n_lines::int n_lines from s join y using (l)""")
def import_export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import and export statements: what they name, their first line and how many they have."""
    f, nodes, _ = _parsed(spark, sf_dir)
    return ops.statements(nodes, f).select("file_path", "kind", "target", F.substring_index("code", "\n", 1).alias("line"), F.size(F.split("code", "\n")).alias("n_lines"))


@query(f"""with {_FILES}, y(l, kind, n, hoisted) as (values (0, 'constant', 1, 0), (0, 'variable', 2, 0), (0, 'parameter', 4, 0), (0, 'function', 3, 3), (1, 'constant', 3, 0), (1, 'function', 1, 1), (2, 'constant', 1, 0), (2, 'function', 1, 1), (3, 'variable', 1, 0), (3, 'constant', 1, 0), (3, 'function', 2, 2))
select file_path, kind, n::bigint n, hoisted::bigint hoisted from s join y using (l)""")
def scope_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scopes of every file hold, by kind."""
    _, nodes, found = _parsed(spark, sf_dir)
    return ops.variables(nodes, found).groupBy("file_path", "kind").agg(F.count("*").alias("n"), F.sum(F.col("hoisted").cast("long")).alias("hoisted"))


@query("select '/lib/s' || p_partkey || case p_partkey % 40 when 8 then '.py' else '.txt' end file_path, case p_partkey % 40 when 8 then 'SyntaxError' else 'ValueError' end reason from part where p_partkey % 40 in (8, 9)")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that cannot be read, and why; the others are not held up by them."""
    return ops.failures(syntax.nodes(source_files(spark, sf_dir))).select("file_path", F.regexp_extract("error", r"^(\w+)", 1).alias("reason"))


@query(f"""with {_FILES}, y(l, symbols) as (values (0, 'C§,LIMIT_@,helper,inner,scale,text'), (1, 'C§,helper,inner,scale'), (2, 'Limit,helper'), (3, 'LIMIT,helper')) select file_path, {_FILL('symbols')} symbols from s join y using (l)""")
def span_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every file the symbols that its helper needs, by what their spans name; their code is cut from the spans."""
    f, nodes, found = _parsed(spark, sf_dir)
    own = ops.meet(found, ops.dependencies(found, nodes), ["file_path", "pre"])
    need = F.array_except("dependencies", F.array("name"))
    s = own.select("file_path", "name", "start_line", "end_line", need.alias("dependencies"))
    ask = found.select("file_path").distinct().withColumn("targets", F.array(F.lit("helper")))
    got = requests.extract_code_context(ask, f.select("file_path", "content"), s, settle)
    return got.select("file_path", F.array_join("symbols", ",").alias("symbols"))


@query(f"""with {_FILES}, y(l, name, kind, parent, change) as (values (0, 'helper', 'function', null, 'removed'), (0, 'assist', 'function', null, 'added'), (0, 'C§', 'class', null, 'modified'), (0, 'area', 'function', 'C§', 'modified'), (0, 'text', 'variable', 'helper', 'removed'), (0, 'text', 'variable', 'assist', 'added'), (0, 'inner', 'function', 'helper', 'removed'), (0, 'inner', 'function', 'assist', 'added'),
(1, 'helper', 'function', null, 'removed'), (1, 'assist', 'function', null, 'added'), (1, 'C§', 'class', null, 'modified'), (1, 'area', 'method', 'C§', 'modified'), (1, 'inner', 'constant', 'helper', 'removed'), (1, 'inner', 'constant', 'assist', 'added'), (2, 'helper', 'function', null, 'removed'), (2, 'assist', 'function', null, 'added'), (2, 'Area', 'method', null, 'modified'), (3, 'helper', 'function', null, 'removed'), (3, 'assist', 'function', null, 'added'), (3, 'C§', 'impl', null, 'modified'), (3, 'area', 'function', 'C§', 'modified'))
select file_path, {_FILL('name')} as name, kind, {_FILL('parent')} parent, change from s join y using (l) where k % 3 = 0""")
def span_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed symbols between each file and a version in which every third file's helper has another name; a symbol's code is its whole span.

    All files are compared whole; those whose two versions are the same have no changed symbol, so they are not parsed.
    """
    f = source_files(spark, sf_dir)
    later = F.when(F.col("p_partkey") % 3 == 0, F.replace("content", F.lit("helper("), F.lit("assist("))).otherwise(F.col("content"))
    differ = f.withColumn("later", later).where(~F.col("content").eqNullSafe(F.col("later")))

    def side(version: str) -> DataFrame:
        files = differ.select("file_path", F.col(version).alias("content"))
        return ops.code_of(settle(ops.symbols(settle(syntax.nodes(files)))), files)

    return ops.changes(side("content"), side("later"))
