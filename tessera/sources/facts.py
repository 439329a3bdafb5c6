"""Fact tables from the driver tables and from files: lines, imports, symbols, relationships, versions, access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File extension -> language.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".java": "java", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".scala": "scala", ".sc": "scala", ".jl": "julia", ".ml": "ocaml", ".mli": "ocaml", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".hs": "haskell",
    ".html": "html", ".htm": "html", ".css": "css", ".ejs": "embedded_template", ".eta": "embedded_template", ".erb": "embedded_template", ".json": "json", ".ql": "ql", ".regex": "regex",
}
#: What a relative import may stand for: the path itself, with an extension, or an index file; inside the graph of known files never the path itself.
GRAPH_CANDIDATES = [f"{stem}{ext}" for stem in ("", "/index") for ext in (".ts", ".js", ".tsx", ".jsx", ".py", ".go", ".rs")]
RESOLVE = ["", ".ts", ".tsx", ".js", ".jsx", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, content, modified_at of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, content, modified_at of files as bytes, so that one that is no text can be told from the others; files that are empty or gone meanwhile give no row."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(path)
    return b.select(F.col("path").alias("file_path"), "content", F.col("modificationTime").alias("modified_at"))


def language(path: str | Column) -> Column:
    """Language of a path by its extension; null where it has none that is known (a row that cannot be parsed, not an error of the whole job)."""
    ext = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), ext)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_path = /source/lang/doc_id.txt, content."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.format_string("/%s/%s/%d.txt", "source", "lang", "doc_id").alias("file_path"), F.col("text").alias("content"))


def lines(df: DataFrame, *keys: str, text: str = "content") -> DataFrame:
    """keys, pos (from 0), line."""
    return df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src -> dst of consecutive parts of an order in a total order, with the return flag as type."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    return li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_returnflag").alias("type")).where("dst is not null").distinct()


RELATIONSHIPS_SQL = """select distinct src, dst, type from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_extendedprice) dst, l_returnflag as type from lineitem) where dst is not null"""


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, target: links of a page in order, as import statements."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "target"))


PAGE_IMPORTS_SQL = """select page_id, unnest(generate_series(0, len(t) - 1))::int pos, unnest(t) target from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) t from pages)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files that import one another: file_path, content, p_partkey.

    File p imports file p / 3 by the class that it exports; of each ten, files 3 and 4 import one another; each eleventh is
    a test. A graph over all rows whose chains are logarithmic in their number.
    """
    k = F.col("p_partkey")
    up, n = F.floor(k / 3).cast("bigint").cast("string"), k.cast("string")
    path = F.concat(F.lit("/src/m"), n, F.when(k % 11 == 0, ".test.ts").otherwise(".ts"))
    second = F.when(k % 10 == 3, F.concat(F.lit("import './m"), (k + 1).cast("string"), F.lit("';"))).when(k % 10 == 4, F.concat(F.lit("import './m"), (k - 1).cast("string"), F.lit("';"))).otherwise(F.concat(F.lit("import { x as y } from 'pkg"), (k % 5).cast("string"), F.lit("';")))
    first = F.concat(F.lit("import { C"), (F.floor(k / 3) % 4).cast("bigint").cast("string"), F.lit(" } from './m"), up, F.lit("';"))
    own = F.concat(F.lit("export class C"), (k % 4).cast("string"), F.lit(" {}\nexport const K"), (k % 3).cast("string"), F.lit(" = 1;\nfunction f"), F.col("p_size").cast("string"), F.lit("() {}"))
    return table(spark, sf_dir, "part").select(path.alias("file_path"), F.concat_ws("\n", first, second, own).alias("content"), "p_partkey")


#: The same graph from the parts alone: path and number of each file, and its resolved imports.
CODE_FILES_SQL = """cf as (select p_partkey k, '/src/m' || p_partkey || case when p_partkey % 11 = 0 then '.test.ts' else '.ts' end path, p_size from part),
ce0 as (select k, k // 3 t from cf union select k, k + 1 from cf where k % 10 = 3 union select k, k - 1 from cf where k % 10 = 4),
ce as (select distinct a.path src, b.path dst, a.k sk, b.k dk from ce0 join cf a on a.k = ce0.k join cf b on b.k = ce0.t where b.k % 11 <> 0)"""


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src depends on dst: orders on customers, customers and suppliers on nations, nations on regions. Every row of the tables, four levels deep."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return edge(t("orders"), "o", "o_orderkey", "c", "o_custkey").union(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey")).union(edge(t("supplier"), "s", "s_suppkey", "n", "s_nationkey")).union(edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey")).distinct()


OWNERSHIP_SQL = "select distinct * from (select 'o' || o_orderkey src, 'c' || o_custkey dst from orders union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: user:event_type of consecutive events of a user, where the type changes. Cycles stay inside a user."""
    e = table(spark, sf_dir, "events")
    name = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(name.alias("src"), F.lead(name).over(w).alias("dst")).where("dst is not null and src <> dst").distinct()


TRANSITIONS_SQL = "select distinct src, dst from (select user_id || ':' || event_type src, lead(user_id || ':' || event_type) over (partition by user_id order by ts, event_id) dst from events) where dst is not null and src <> dst"


def scan_imports(df: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """file_path, stmt_pos, source, raw, is_default, name, alias, namespace of the import statements of JS/TS text.

    A lexical scan: ``import ... from 'x'``, ``import 'x'`` and ``import('x')``; one row per specifier, one with null
    name for a statement without any.
    """
    pattern = r"""(?m)(import\s+(?:[\w$*{}\s,]+?\s+from\s+)?['"][^'"]+['"];?|import\(\s*['"][^'"]+['"]\s*\))"""
    s = df.select(F.col(path).alias("file_path"), F.posexplode(F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(1))).alias("stmt_pos", "raw"))
    s = s.withColumn("source", F.regexp_extract("raw", r"""['"]([^'"]+)['"]""", 1)).withColumn("clause", F.trim(F.regexp_extract("raw", r"(?s)^import\s+(.*?)\s+from\s", 1)))
    braces = F.regexp_extract("clause", r"(?s)\{([^}]*)\}", 1)
    named = F.transform(F.filter(F.transform(F.split(braces, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, r"^([\w$]+)", 1).alias("name"), F.nullif(F.regexp_extract(x, r"\sas\s+([\w$]+)$", 1), F.lit("")).alias("alias"), F.lit(False).alias("is_default"), F.lit(False).alias("is_namespace")))
    one = lambda rx, d, n: F.when(F.regexp_extract("clause", rx, 1) != "", F.array(F.struct(F.regexp_extract("clause", rx, 1).alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(d).alias("is_default"), F.lit(n).alias("is_namespace"))))
    empty = F.slice(named, 1, 0)
    every = F.concat(F.coalesce(one(r"^([\w$]+)", True, False), empty), F.coalesce(one(r"\*\s+as\s+([\w$]+)", False, True), empty), named)
    return s.select("file_path", "stmt_pos", "source", "raw", F.explode_outer(every).alias("s")).select("file_path", "stmt_pos", "source", "raw", "s.name", "s.alias", "s.is_default", "s.is_namespace")


DECLARATION = r"^\s*(export\s+(?:default\s+)?|pub(?:\([^)]*\))?\s+)?(?:abstract\s+|async\s+|unsafe\s+)*(class|interface|enum|type|function|def|func|fn|struct|trait|const|let|var)\s+(?:mut\s+)?(?:\([^)]*\)\s*)?\*?\s*([A-Za-z_$][\w$]*)"
KINDS = {"def": "function", "func": "function", "fn": "function", "let": "variable", "var": "variable", "const": "constant"}


def scan_declarations(df: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """file_path, name, kind, start_line (from 1), exported of the declarations of JS/TS, Python, Go and Rust text, line by line.

    A lexical scan for ``class, interface, enum, type, function, def, func, fn, struct, trait, const, let, var``.
    """
    pattern = DECLARATION
    ln = lines(df.withColumnRenamed(path, "file_path"), "file_path", text=content)
    kind = F.regexp_extract("line", pattern, 2)
    kinds = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    name = F.regexp_extract("line", pattern, 3)
    exported = (F.regexp_extract("line", pattern, 1) != "") | ((kind == "func") & name.rlike("^[A-Z]"))
    return ln.where(F.col("line").rlike(pattern)).select("file_path", name.alias("name"), F.coalesce(F.element_at(kinds, kind), kind).alias("kind"), (F.col("pos") + 1).alias("start_line"), exported.alias("exported"))


def folded(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts: each ``..`` takes off the part before it, stays where a relative path has none left, and goes at the root."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        up = F.when((F.size(done) == 0) | (last == ".."), F.concat(done, F.array(part))).when((F.size(done) == 1) & (last == ""), done).otherwise(F.slice(done, 1, F.size(done) - 1))
        return F.when((part == ".") | ((part == "") & (F.size(done) > 0)), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files_: DataFrame, candidates: list[str] = RESOLVE) -> DataFrame:
    """imports with target_path: the first candidate of a relative import that is a file (own path, then extensions, then index files)."""
    rel = imports.where(F.col("source").startswith(".")).select("file_path", "source").distinct()
    rel = rel.withColumn("_full", folded(F.concat(F.regexp_replace("file_path", r"[^/]*$", ""), "source")))
    cand = rel.select("file_path", "source", F.posexplode(F.transform(F.array(*map(F.lit, candidates)), lambda e: F.concat("_full", e))).alias("ordinal", "target_path")).distinct()
    hit = cand.join(files_.select(F.col("file_path").alias("target_path")).distinct(), "target_path", "left_semi").groupBy("file_path", "source").agg(F.min_by("target_path", "ordinal").alias("target_path"))
    return imports.join(hit, ["file_path", "source"], "left")


def nearest_manifest(files_: DataFrame, manifest: str = "package.json") -> DataFrame:
    """file_path and manifest_path: the manifest in the nearest folder above, by an equi-join on each folder above."""
    up = files_.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file_path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("file_path", "/"), 1, i), "/"))).alias("dir"))
    own = files_.where(F.col("file_path").endswith(f"/{manifest}")).select(F.col("file_path").alias("manifest_path"), F.regexp_replace("file_path", f"/{manifest}$", "").alias("dir"))
    return up.join(own, "dir").groupBy("file_path").agg(F.max_by("manifest_path", F.length("dir")).alias("manifest_path"))
