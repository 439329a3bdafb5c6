"""Queries over source files: declarations, imports, the file graph, requests. The files are made from the parts (``facts.code_files``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import files, graph, relational, relations, requests
from tessera.plans.registry import query
from tessera.plans.tables import settle
from tessera.sources import facts

_CF = facts.CODE_FILES_SQL
_EDGES = f"with {_CF} select src, dst, ((sk % 4 = dk % 4)::int + (sk % 3 = dk % 3)::int)::bigint n_symbols, (((sk % 4 = dk % 4)::int + (sk % 3 = dk % 3)::int) / 2.0)::double strength from ce"
_COUPLED = f"{_CF}, cc as (select path, k, (select count(*) from ce where ce.src = path) dependencies, (select count(*) from ce where ce.dst = path) dependents from cf), cy as (select distinct a.src path from ce a join ce b on a.src = b.dst and a.dst = b.src)"


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = settle(facts.code_files(spark, sf_dir))
    return f, settle(facts.scan_imports(f)), settle(facts.scan_declarations(f))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f, i, d = _parsed(spark, sf_dir)
    return settle(files.file_nodes(f, d)), settle(files.file_edges(i, f, d))


@query("""with k as (select p_partkey k, '/src/m' || p_partkey || case when p_partkey % 11 = 0 then '.test.ts' else '.ts' end file_path, p_size from part) select file_path, 'C' || k % 4 as name, 'class' kind, 3 start_line, true exported from k union all select file_path, 'K' || k % 3, 'constant', 4, true from k union all select file_path, 'f' || p_size, 'function', 5, false from k""")
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.scan_declarations(facts.code_files(spark, sf_dir)).select("file_path", "name", "kind", "start_line", "exported")


@query("""with k as (select p_partkey k, '/src/m' || p_partkey || case when p_partkey % 11 = 0 then '.test.ts' else '.ts' end file_path from part) select file_path, 0 stmt_pos, './m' || k // 3 as source, 'C' || (k // 3) % 4 as name, null::varchar as alias, true relative from k
union all select file_path, 1, case when k % 10 = 3 then './m' || (k + 1) when k % 10 = 4 then './m' || (k - 1) else 'pkg' || k % 5 end, case when k % 10 in (3, 4) then null else 'x' end, case when k % 10 in (3, 4) then null else 'y' end, k % 10 in (3, 4) from k""")
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.scan_imports(facts.code_files(spark, sf_dir)).select("file_path", "stmt_pos", "source", "name", "alias", (~S.is_package("source")).alias("relative"))


@query(_EDGES)
def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1].select("src", "dst", "n_symbols", "strength")


@query(f"with {_COUPLED} select path file_path, 3::bigint symbols, 2::bigint exports, dependencies, dependents, round(case when dependencies + dependents > 0 then dependencies / (dependencies + dependents)::double else 0 end, 6) instability from cc")
def file_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = files.file_coupling(*_graph(spark, sf_dir))
    return c.withColumn("instability", F.round("instability", 6))


@query(f"""with recursive {_COUPLED}, co as (select path, coalesce((select min(least(a.src, a.dst)) from ce a join ce b on a.src = b.dst and a.dst = b.src where a.src = path), path) c from cf), fe as (select distinct a.c src, b.c dst from ce join co a on a.path = src join co b on b.path = dst where a.c <> b.c),
p as (select c node, 0 d from co union select fe.src, d + 1 from p join fe on fe.dst = p.node) select count(*) files, sum(dependencies)::bigint dependencies, round(avg(dependencies), 6) mean_dependencies, round(avg(case when dependencies + dependents > 0 then dependencies / (dependencies + dependents)::double else 0 end), 6) mean_instability, (select max(d) from p)::int max_depth, (select count(*) from cy) files_on_cycles from cc""")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.file_metrics(*_graph(spark, sf_dir), settle)
    return m.withColumn("mean_dependencies", F.round("mean_dependencies", 6)).withColumn("mean_instability", F.round("mean_instability", 6))


_REACH = f"with recursive {_CF}, r as (select dst f, src d from ce union select r.f, ce.src from r join ce on ce.dst = r.d), o as (select f, d from r where f <> d)"


@query(f"""{_REACH}, n as (select f, count(*) total, count(*) filter (exists (select 1 from ce where ce.src = d and ce.dst = f)) direct from o group by 1), w as (select path f, path b from cf union select f, d from o), t as (select f, count(distinct src) tests from w join ce on ce.dst = b where contains(src, '.test.') group by 1)
select path file_path, coalesce(direct, 0) direct, coalesce(total - direct, 0) indirect, coalesce(tests, 0) tests, case when coalesce(total, 0) > 20 or coalesce(direct, 0) > 10 then 'critical' when coalesce(total, 0) > 10 or coalesce(direct, 0) > 5 then 'high' when coalesce(total, 0) > 5 or coalesce(direct, 0) > 2 then 'medium' else 'low' end risk,
  round(1 + 0.5 * coalesce(total, 0) + 0.06, 1)::double effort from cf left join n on n.f = path left join t on t.f = path""")
def file_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return files.change_impact(nodes, edges, nodes, settle)


@query(f"{_REACH}, w as (select path f, path b from cf union select f, d from o) select distinct f file_path, src test from w join ce on ce.dst = b where contains(src, '.test.')")
def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    back = graph.closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), settle).where("src <> dst")
    return files.affected_tests(edges, back, nodes.select(F.col("file_path").alias("src")))


@query(f"""with {_COUPLED}, i as (select path, dependencies, dependents, case when dependencies + dependents > 0 then dependencies / (dependencies + dependents)::double else 0 end inst, path in (select path from cy) cyclic from cc), j as (select *, list_filter([case when dependencies > 10 then 'High dependency count: ' || dependencies end, case when dependents > 15 then 'Too many dependents: ' || dependents end, case when inst > 0.8 then 'High instability: ' || printf('%.2f', inst) end, case when cyclic then 'Part of circular dependency' end], lambda x: x is not null) l from i)
select path file_path, array_to_string(l, '; ') issues, case when len(l) >= 3 or cyclic then 'high' when len(l) >= 2 then 'medium' else 'low' end priority, dependencies, dependents, round(inst, 6)::double instability, 0.3::double complexity from j where len(l) > 0""")
def refactoring_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.refactoring_candidates(*_graph(spark, sf_dir), settle)
    return r.select("file_path", F.array_join("issues", "; ").alias("issues"), "priority", "dependencies", "dependents", F.round("instability", 6).alias("instability"), "complexity")


@query(f"""with recursive {_CF}, st as (select k, k // 3 t, 'C' || (k // 3) % 4 as sym from cf), ok as (select k from cf where k % 11 <> 0), r as (select k root, k here, sym from st union select r.root, st.t, st.sym from r join st on st.k = r.here and st.sym = r.sym join ok on ok.k = st.t), v as (select distinct root, here from r)
select distinct cf.path file_path, './m' || ce0.t as source from v join cf on cf.k = root join ce0 on ce0.k = here join ok on ok.k = ce0.t""")
def transitive_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, i, _ = _parsed(spark, sf_dir)
    used = i.where("stmt_pos = 0").select("file_path", F.col("name").alias("symbol"))
    return files.transitive_imports(i, f, used, settle)


@query(f"""with {_CF}, x as (select path, k, k % 2 = 0 uses, 'import {{ C' || (k // 3) % 4 || ' }} from ''./m' || k // 3 || chr(39) || ';' a, case when k % 10 = 3 then 'import ''./m' || (k + 1) || chr(39) || ';' when k % 10 = 4 then 'import ''./m' || (k - 1) || chr(39) || ';' else 'import {{ x as y }} from ''pkg' || k % 5 || chr(39) || ';' end b, k % 10 in (3, 4) side from cf)
select path file_path, array_to_string(list_filter([case when uses then a end, case when side then b end], lambda s: s is not null), chr(10)) optimized, array_to_string(list_filter([case when not uses then a end, case when not side then b end], lambda s: s is not null), chr(10)) removed, (case when not uses then ceil(len(a) / 4.0) else 0 end + case when not side then ceil(len(b) / 4.0) else 0 end)::bigint token_savings from x""")
def import_optimisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second file uses the class that it imports; none uses the other import."""
    f, i, _ = _parsed(spark, sf_dir)
    used = f.where("p_partkey % 2 = 0").select("file_path").join(i.where("stmt_pos = 0").select("file_path", F.col("name").alias("symbol")), "file_path")
    o = requests.optimize_imports(i, used)
    return o.select("file_path", F.array_join("optimized", "\n").alias("optimized"), F.array_join("removed", "\n").alias("removed"), "token_savings")


@query(f"""with {_CF}, w as (select path, k, case when k % 10 = 3 then 'side effect lost: import ''./m' || (k + 1) || chr(39) || ';' when k % 10 = 4 then 'side effect lost: import ''./m' || (k - 1) || chr(39) || ';' end side from cf),
y as (select distinct a.src path, 'import cycle: ' || least(a.src, a.dst) || ' -> ' || greatest(a.src, a.dst) || ' -> ' || least(a.src, a.dst) as cycle from ce a join ce b on a.src = b.dst and a.dst = b.src where a.src <> a.dst)
select w.path file_path, case when k % 6 = 1 then 'import {{ helper }} from ''kit'';' else '' end added, coalesce(case when y.cycle is null then null else y.cycle end, '') warnings from w left join y using (path)""")
def import_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the import analysis adds and warns of: a name that is used and imported nowhere, and files that import one another."""
    f, i, _ = _parsed(spark, sf_dir)
    used = f.where("p_partkey % 6 = 1").select("file_path", F.lit("helper").alias("symbol"))
    suggested = spark.createDataFrame([("helper", "import { helper } from 'kit';"), ("other", "import 'other';")], "symbol string, statement string")
    rings = graph.cycles(_graph(spark, sf_dir)[1].where("src <> dst"), settle)
    o = requests.optimize_imports(i, used, suggested, rings)
    return o.select("file_path", F.array_join("added", "\n").alias("added"), F.array_join("warnings", "\n").alias("warnings"))


@query("""select p_partkey::varchar as key, case when p_size % 3 = 0 then 'f' || p_size when p_size % 3 = 1 then 'K' || p_partkey % 3 else '' end affected, case when p_size % 3 = 0 then '// REMOVE f' || p_size || ' at line 0' || chr(10) || 'function f' || p_size || '() {}' when p_size % 3 = 1 then '// UPDATE K' || p_partkey % 3 || ' at line 4' || chr(10) || 'export const K' || p_partkey % 3 || ' = 2;' else '' end minimal_update from part""")
def code_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file beside a version without its function, one with another constant, or the same."""
    f = facts.code_files(spark, sf_dir).join(facts.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    new = F.when(F.col("p_size") % 3 == 0, F.regexp_replace("content", r"\nfunction.*$", "")).when(F.col("p_size") % 3 == 1, F.regexp_replace("content", "= 1;", "= 2;")).otherwise(F.col("content"))
    d = requests.analyze_code_diff(f.select(F.col("p_partkey").alias("key"), F.col("content").alias("old"), new.alias("new")), "key")
    return d.select("key", F.array_join("affected", ",").alias("affected"), "minimal_update")


@query("""with s as (select distinct p_brand || '#' symbol, lower(p_brand) || '#' a from part), p as (select distinct 'x' || lower(p_brand) package from part), x as (select symbol, package, (greatest(len(a), len(package)) - levenshtein(a, package)) / greatest(len(a), len(package))::double c from s, p) select symbol, package, round(c, 6) confidence from x where c > 0.6""")
def import_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part").select("p_brand").distinct()
    found = requests.import_suggestions(p.select(F.concat("p_brand", F.lit("#")).alias("symbol")), p.select(F.concat(F.lit("x"), F.lower("p_brand")).alias("package")))
    return found.select("symbol", "package", F.round("confidence", 6).alias("confidence"))


@query("""with f as (select p_partkey k, 'C' || p_partkey % 4 c, 'K' || p_partkey % 3 kk, 'f' || p_size ff, 'C' || (p_partkey // 3) % 4 im from part) select k as key, unnest(list_sort(list_distinct(list_filter([c, kk, ff, im], lambda x: x in ('C1', 'K2', 'f7'))))) symbol from f""")
def symbols_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.code_files(spark, sf_dir).select(F.col("p_partkey").alias("key"), F.col("content").alias("code"))
    return relational.present(f, spark.createDataFrame([("C1",), ("K2",), ("f7",)], "symbol string"))


def _related(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Declarations and relations of the files, each with a class that extends its own and a function that calls its first one."""
    k = F.col("p_partkey").cast("string")
    f = facts.code_files(spark, sf_dir).join(facts.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    more = F.concat(F.lit("\nclass D"), k, F.lit(" extends C"), (F.col("p_partkey") % 4).cast("string"), F.lit(" {}\nfunction g"), k, F.lit("() {\n  if (K) f"), F.col("p_size").cast("string"), F.lit("();\n}"))
    f = settle(f.select("file_path", F.concat("content", more).alias("content")))
    return facts.scan_declarations(f), relations.extract_relations(f)


_RELATED = """k as (select p_partkey k, p_size s, '/src/m' || p_partkey || case when p_partkey % 11 = 0 then '.test.ts' else '.ts' end p from part), rel as (select p file_path, 'inherits' as type, 'D' || k as source, 'C' || k % 4 target, 0.9::double confidence, 6::int line from k union all select p, 'calls', 'g' || k, 'f' || s, 0.8, 8 from k
union all select p, 'imports', 'C' || (k // 3) % 4, './m' || k // 3, 1.0, 1 from k union all select p, 'imports', 'x', 'pkg' || k % 5, 1.0, 2 from k where k % 10 not in (3, 4)),
dec as (select p file_path, 'C' || k % 4 as name, 'class' kind, 3 line from k union all select p, 'K' || k % 3, 'constant', 4 from k union all select p, 'f' || s, 'function', 5 from k union all select p, 'D' || k, 'class', 6 from k union all select p, 'g' || k, 'function', 7 from k),
refs as (select name symbol, file_path file, line::int line, 'definition' as type, 'global' as scope from dec union all select target, file_path, line, case type when 'calls' then 'call' else 'import' end, 'unknown' from rel where type <> 'inherits')"""
_REFERENCES = "symbol, file, line, type, 'Line ' || line || ' in ' || split_part(file, '/', -1) context, scope from refs"


@query(f"with {_RELATED} select * from rel")
def symbol_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir)[1]


@query(f"with {_RELATED} select {_REFERENCES}")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.symbol_references(*_related(spark, sf_dir))


@query(f"with {_RELATED} select {_REFERENCES} where symbol in ('C1', 'f7', 'pkg2')")
def references_of_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("C1",), ("f7",), ("pkg2",)], "symbol string")
    return relations.references_of(relations.symbol_references(*_related(spark, sf_dir)), wanted)


@query(f"with {_RELATED}, e as (select distinct source, target from rel where type in ('inherits', 'calls')) select coalesce(name, source) src, target dst from (select distinct name from dec) full join e on name = source")
def symbol_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.dependency_graph(*_related(spark, sf_dir))


@query(f"with {_RELATED} select file_path, kind, count(*) n, string_agg(name, ',' order by line) as names from dec group by 1, 2")
def declarations_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.by_type(_related(spark, sf_dir)[0]).withColumn("names", F.array_join("names", ","))
