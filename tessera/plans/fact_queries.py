"""Queries over symbols, references, imports and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import features, graph, relational, requests, scopes
from tessera.plans.registry import query
from tessera.plans.tables import settle
from tessera.sources import facts

_REL = facts.RELATIONSHIPS_SQL
_IMP = facts.PAGE_IMPORTS_SQL
#: Every order is a symbol, every item of an order a use of it.
_DEFS = """select o_orderkey symbol, case o_orderkey % 5 when 0 then 'data' || o_orderkey when 1 then 'x' when 2 then 'temp_' || o_orderkey else 'order' || o_orderkey end as name, case o_orderstatus when 'F' then 'function' when 'O' then 'class' else 'variable' end kind,
  (o_custkey % 29)::int as file, o_orderkey % 4 = 0 as is_public, (o_custkey % 13)::int line_count from orders"""
_REFS = "select l_orderkey symbol, (l_suppkey % 29)::int as file, l_linenumber line from lineitem"
_CROSSED = f"""d as ({_DEFS}), r as ({_REFS}), pf as (select symbol, file, count(*) n from r group by all), bf as (select symbol, file best_file, row_number() over (partition by symbol order by n desc, file) k from pf),
x as (select d.*, coalesce((select count(*) from r where r.symbol = d.symbol), 0) usage_count, 1 + coalesce((select count(*) from pf where pf.symbol = d.symbol and pf.file <> d.file), 0) file_count, best_file from d left join bf on bf.symbol = d.symbol and k = 1)"""
#: Parts as named symbols of many kinds of names, for the features of names.
_SYM = """sym as (select p_partkey as key, case p_partkey % 8 when 0 then replace(p_name, ' ', '_') || 'Manager' when 1 then replace(p_name, ' ', '_') || '_user_update' when 2 then replace(p_name, ' ', '') || 'Factory' when 3 then 'getHttpToken' || p_size when 4 then 'API' when 5 then 'MAX_ORDER_TABLE' when 6 then 'legacyDataList' else 'handle-eventStream' end as name,
  case when p_partkey % 8 = 5 and p_size % 2 = 0 then 'constant' when p_type = 'PROMO' then 'interface' when p_type = 'LARGE' then 'class' when p_type = 'SMALL' then 'function' else 'variable' end kind,
  case p_size % 4 when 0 then '/src/core/x.ts' when 1 then '/src/test/x.ts' when 2 then '/src/util/x.ts' else '/app/main/x.ts' end file_path, p_size * 4 as line_count, (p_partkey % 23)::int as dependencies, p_type = 'PROMO' as exported, (p_partkey % 7)::int fan_in, (p_partkey % 130)::int usage_count, 0.25::double test_coverage, 0 usage_spread from part)"""
#: The features that the composites are made of, by the rules alone.
_FEATURES = _SYM + """, tok as (select *, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]', ' ', 'g')), '\\s+'), lambda t: len(t) > 0) t, greatest(1, line_count // 10) cc from sym),
term as (select *, list_filter(t, lambda w: w in ('api', 'http', 'json', 'xml', 'sql', 'database', 'cache', 'queue', 'thread', 'async', 'sync', 'promise', 'callback', 'event', 'stream', 'buffer', 'socket', 'connection', 'session', 'token', 'auth', 'oauth', 'encryption', 'hash', 'algorithm', 'data', 'model', 'view', 'controller', 'service', 'repository', 'factory', 'builder', 'adapter', 'proxy', 'decorator', 'observer', 'strategy', 'command', 'state', 'visitor')) technical,
  list_filter(t, lambda w: w in ('html', 'css', 'dom', 'browser', 'client', 'server', 'request', 'response', 'table', 'column', 'row', 'index', 'query', 'transaction', 'schema', 'authentication', 'authorization', 'permission', 'role', 'user', 'password', 'order', 'customer', 'product', 'invoice', 'payment', 'account', 'button', 'form', 'input', 'dialog', 'menu', 'layout', 'component')) as domain,
  list_filter(t, lambda w: regexp_matches(w, 'data|info|list|map|set|array|object|item')) nouns, list_filter(t, lambda w: regexp_matches(w, '^(get|set|create|delete|update|find|search|process|handle)')) verbs,
  case kind when 'function' then regexp_full_match(name, '[a-z][a-zA-Z0-9]*') when 'variable' then regexp_full_match(name, '[a-z][a-zA-Z0-9]*') when 'class' then regexp_full_match(name, '[A-Z][a-zA-Z0-9]*') when 'constant' then regexp_full_match(name, '[A-Z][A-Z0-9_]*') else true end naming, regexp_full_match(name, '[A-Z]{1,5}') acronym from tok),
feat as (select *, greatest(0, 100 - line_count * 0.5 - cc * 2) mi, case when line_count > 100 then 0.3 else 0.1 end debt, case when fan_in + dependencies > 0 then dependencies / (fan_in + dependencies)::double else 0 end instability, case when exported then 0.8 else 0.3 end doc, greatest(0, 1 - dependencies / 20.0 - line_count / 200.0) focus, case when len(verbs) > 0 then 0.8 else 0.4 end clarity,
  case when regexp_matches(lower(name), 'delete|remove|clear|reset|modify|update') then 0.7 else 0.2 end side, case when regexp_matches(lower(name), 'legacy|old|deprecated|obsolete') then 0.9 else 0.1 end dep,
  least(1, case when len(t) > 1 then 0.3 else 0 end + case when len(technical) > 0 then 0.2 else 0 end + case when len(verbs) > 0 then 0.2 else 0 end + case when naming then 0.2 else 0 end + case when not acronym then 0.1 else 0 end) text from term),
comp as (select *, 0.3 * text + 0.2 * mi / 100 + 0.2 * case when contains(file_path, 'core') and not contains(file_path, 'test') then 0.8 else 0.5 end + 0.15 * least(1, usage_count / 100.0) + 0.15 * clarity relevance, (mi / 100 + test_coverage + doc + 0.7 + focus) / 5 quality, ((1 - cc / 20.0) + (1 - instability) + 0.7 + clarity) / 4 upkeep, (debt + side + dep + instability) / 4 risk from feat)"""


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    name = F.when(k % 5 == 0, F.concat(F.lit("data"), k.cast("string"))).when(k % 5 == 1, "x").when(k % 5 == 2, F.concat(F.lit("temp_"), k.cast("string"))).otherwise(F.concat(F.lit("order"), k.cast("string")))
    kind = F.when(status == "F", "function").when(status == "O", "class").otherwise("variable")
    return facts.table(spark, sf_dir, "orders").select(k.alias("symbol"), name.alias("name"), kind.alias("kind"), (F.col("o_custkey") % 29).cast("int").alias("file"), (k % 4 == 0).alias("is_public"), (F.col("o_custkey") % 13).cast("int").alias("line_count"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = facts.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("symbol"), (F.col("l_suppkey") % 29).cast("int").alias("file"), F.col("l_linenumber").alias("line"))


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cross_references(_definitions(spark, sf_dir), _references(spark, sf_dir))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    k, size, kind, n = F.col("p_partkey"), F.col("p_size"), F.col("p_type"), F.col("p_name")
    name = F.when(k % 8 == 0, F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit("Manager"))).when(k % 8 == 1, F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit("_user_update"))).when(k % 8 == 2, F.concat(F.replace(n, F.lit(" "), F.lit("")), F.lit("Factory")))
    name = name.when(k % 8 == 3, F.concat(F.lit("getHttpToken"), size.cast("string"))).when(k % 8 == 4, "API").when(k % 8 == 5, "MAX_ORDER_TABLE").when(k % 8 == 6, "legacyDataList").otherwise("handle-eventStream")
    what = F.when((k % 8 == 5) & (size % 2 == 0), "constant").when(kind == "PROMO", "interface").when(kind == "LARGE", "class").when(kind == "SMALL", "function").otherwise("variable")
    path = F.when(size % 4 == 0, "/src/core/x.ts").when(size % 4 == 1, "/src/test/x.ts").when(size % 4 == 2, "/src/util/x.ts").otherwise("/app/main/x.ts")
    return p.select(k.alias("key"), name.alias("name"), what.alias("kind"), path.alias("file_path"), (size * 4).alias("line_count"), (k % 23).cast("int").alias("dependencies"), (kind == "PROMO").alias("exported"), (k % 7).cast("int").alias("fan_in"), (k % 130).cast("int").alias("usage_count"), F.lit(0.25).alias("test_coverage"))


@query(f"with i as ({_IMP}), used as (select distinct '/' || unnest(string_split(text, ' ')) symbol from benchmark) select page_id, pos, target from i where target in (select symbol from used)")
def minimal_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = facts.page_imports(spark, sf_dir).select("page_id", "pos", "target", F.col("target").alias("name"), F.lit(None).cast("string").alias("alias"))
    used = facts.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(F.concat(F.lit("/"), "w").alias("symbol"))
    return relational.minimal_imports(i, used).select("page_id", "pos", "target")


@query(f"with i as ({_IMP}), used as (select distinct '/' || unnest(string_split(text, ' ')) symbol from benchmark) select page_id, pos, target from i where target not in (select symbol from used)")
def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = facts.page_imports(spark, sf_dir)
    used = facts.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(F.concat(F.lit("/"), "w").alias("target"))
    return relational.set_difference(i, used, ["target"]).select("page_id", "pos", "target")


@query(f"select page_id, trim(target) target, min(pos) pos from ({_IMP}) group by all")
def distinct_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_in_order(facts.page_imports(spark, sf_dir), ["page_id"], "target", "pos")


@query("""with s as (select distinct unnest(string_split(p_name, ' ')) symbol from part), p as (select distinct lower(p_brand) package from part union select distinct lower(p_type) from part),
x as (select symbol, package, (greatest(len(symbol), len(package)) - levenshtein(symbol, package)) / greatest(len(symbol), len(package))::double confidence from s, p) select symbol, package, round(confidence, 6) confidence from x where confidence > 0.3""")
def import_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    symbols = p.select(F.explode(F.split("p_name", " ")).alias("symbol")).distinct()
    packages = p.select(F.lower("p_brand").alias("package")).union(p.select(F.lower("p_type"))).distinct()
    return relational.suggest_imports(symbols, packages, 0.3).select("symbol", "package", F.round("confidence", 6).alias("confidence"))


@query(f"""with d as ({_DEFS}), r as ({_REFS}), u as (select symbol, count(*) n, count(distinct file) f from r group by symbol) select d.symbol, coalesce(n, 0)::bigint usage_count, coalesce(f, 0)::bigint file_count, round((select avg(coalesce(n, 0)) from d left join u using (symbol)), 6) average_usage from d left join u using (symbol)""")
def usage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = relational.usage_metrics(_definitions(spark, sf_dir), _references(spark, sf_dir))
    return m.select("symbol", "usage_count", "file_count", F.round("average_usage", 6).alias("average_usage"))


@query(f"""with d as ({_DEFS}), r as ({_REFS}), u as (select d.symbol, count(r.symbol) n from d left join r using (symbol) group by 1), t as (select symbol, n, 'top' side, row_number() over (order by n desc, symbol) k from u), b as (select symbol, n, 'bottom' side, row_number() over (order by n, symbol) k from u)
select symbol, n::bigint usage_count, side, k::bigint as rank from (select * from t union all select * from b) where k <= 10""")
def usage_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = relational.usage_metrics(_definitions(spark, sf_dir), _references(spark, sf_dir))
    return relational.top_and_bottom(m).select("symbol", "usage_count", "side", F.col("rank").cast("long").alias("rank"))


@query(f"""with d as ({_DEFS}), r as ({_REFS}), u as (select d.symbol, d.kind, d.is_public, count(r.symbol) n from d left join r using (symbol) group by all)
select symbol, kind, case when n = 0 then 'unused' else 'potential' end status, case when n = 0 then 1.0 else 0.7 end::double confidence from u where n = 0 or (n = 1 and not is_public)""")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.dead_code(_definitions(spark, sf_dir), _references(spark, sf_dir))


@query(f"""with d as ({_DEFS}), c as (select symbol, file, count(*) n from ({_REFS}) group by all), b as (select symbol, file best_file, n, row_number() over (partition by symbol order by n desc, file) k from c)
select d.symbol, d.file::int file, best_file::int best_file, n::bigint n from d join b using (symbol) where k = 1 and d.file <> best_file""")
def move_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.move_candidates(_definitions(spark, sf_dir), _references(spark, sf_dir))


@query(f"""with e as (select distinct src, dst from ({_REL})), o as (select src node, count(*) ce from e group by 1), i as (select dst node, count(*) ca from e group by 1)
select node, coalesce(ca, 0)::bigint ca, coalesce(ce, 0)::bigint ce, round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0))::double, 6) instability from o full join i using (node)""")
def coupling_ca_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relational.coupling_ca_ce(facts.relationships(spark, sf_dir))
    return c.select("node", "ca", "ce", F.round("instability", 6).alias("instability"))


@query(f"""with r as ({_REL}), w as (select src a, dst b, case type when 'A' then 0.9 when 'N' then 0.6 else 0.4 end::double w from r where src <> dst union all select dst, src, 0.3 from r where src <> dst)
select a, b, round(least(sum(w), 1.0), 6) coupling from w group by a, b""")
def pair_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relational.pair_coupling(facts.relationships(spark, sf_dir), weights={"A": 0.9, "N": 0.6, "R": 0.4})
    return c.select("a", "b", F.round("coupling", 6).alias("coupling"))


@query("""with r as (select o_orderkey src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) dst, case o_orderstatus when 'P' then 'contains' when 'F' then 'uses' else 'calls' end as type from orders), n as (select l_orderkey dst, count(*) n from lineitem group by 1)
select src, dst, type, round(least(case type when 'contains' then 0.9 when 'uses' then 0.6 else 0.4 end * least(coalesce(n, 0) / 5.0, 1.5), 1.0), 6)::double strength from r left join n using (dst) where dst is not null""")
def composition_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order beside the customer's next one, by its status; every line item is a reference of its order."""
    o = facts.table(spark, sf_dir, "orders")
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "P", "contains").when(F.col("o_orderstatus") == "F", "uses").otherwise("calls")
    r = o.select(F.col("o_orderkey").alias("src"), later.alias("dst"), kind.alias("type")).where("dst is not null")
    return relational.composition_strength(r, facts.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("symbol"))).select("src", "dst", "type", F.round("strength", 6).alias("strength"))


@query(f"""with e as ({_REL}), o as (select src node, count(*) fan_out from e group by 1), i as (select dst node, count(*) fan_in from e group by 1), k as (select p_partkey node, case p_type when 'PROMO' then 'interface' when 'LARGE' then 'class' when 'SMALL' then 'function' else 'variable' end kind from part),
h as (select src node, count(*) n from ({_REL}) where type = 'A' group by 1)
select node, kind, coalesce(fan_in, 0)::bigint fan_in, coalesce(fan_out, 0)::bigint fan_out, round(case kind when 'interface' then 1.0 when 'class' then least(coalesce(n, 0) / 5.0, 1.0) when 'function' then 0.2 else 0.1 end, 6)::double abstractness,
  round(case when coalesce(fan_in, 0) + coalesce(fan_out, 0) > 0 then coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0))::double else 0.0 end, 6) instability from k left join o using (node) left join i using (node) left join h using (node)""")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = facts.relationships(spark, sf_dir)
    t = F.col("p_type")
    k = facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(t == "PROMO", "interface").when(t == "LARGE", "class").when(t == "SMALL", "function").otherwise("variable").alias("kind"))
    inherits = rel.where("type = 'A'").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    j = k.join(relational.relation_counts(rel), "node", "left").join(inherits, "node", "left").fillna(0)
    return j.select("node", "kind", F.col("ca").alias("fan_in"), F.col("ce").alias("fan_out"), F.round(S.abstractness("kind", "n"), 6).alias("abstractness"), F.round("instability", 6).alias("instability"))


@query("""with r as (select l_partkey symbol, l_suppkey % 7 as file from lineitem), d as (select p_partkey symbol, p_size % 7 as file, p_partkey, p_size from part), u as (select symbol, count(*) usage from r group by 1), f as (select d.symbol, 1 + count(distinct r.file) filter (r.file <> d.file) files from d left join r using (symbol) group by 1),
x as (select symbol, file, coalesce(usage, 0) usage, (p_partkey % 10) / 10.0 chg, least(p_size / 50.0 + (p_partkey % 5) / 10.0, 1.0) cx, files from d left join u using (symbol) join f using (symbol)), y as (select *, least(usage / 100.0, 1.0) * 0.3 + chg * 0.4 + cx * 0.3 risk from x)
select symbol, file::int file, round(risk, 6)::double risk, array_to_string(list_filter([case when cx > 0.7 then 'split it up: it is complex' end, case when chg > 0.8 then 'cover it with tests: it changes often' end, case when usage > 50 then 'review every change: it has more than 50 uses' end, case when files > 5 then 'keep its interface fixed: more than 5 files use it' end], lambda t: t is not null), '; ') advice from y where risk > 0.7""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") % 7).cast("int").alias("file"), "p_size")
    r = facts.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), (F.col("l_suppkey") % 7).cast("int").alias("file"))
    k = F.col("symbol")
    h = relational.hotspots(relational.cross_references(d, r), (k % 10) / 10, S.complexity_share("p_size", k % 5))
    return h.select("symbol", "file", F.round("risk", 6).alias("risk"), F.array_join("advice", "; ").alias("advice"))


@query(f"with {_CROSSED} select count(*) total_symbols, sum(usage_count)::bigint total_references, round(avg(usage_count), 6) mean_references, count(*) filter (usage_count = 0)::bigint unused, count(*) filter (is_public)::bigint public_api, count(*) filter (file_count > 1)::bigint cross_file from x")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relational.usage_summary(_crossed(spark, sf_dir))
    return s.withColumn("mean_references", F.round("mean_references", 6))


@query(f"""with {_CROSSED} select symbol, file, 'inline_method' as type, 'low' impact, 0.5::double effort from x where usage_count = 1 and kind = 'function' and line_count <= 5 union all select symbol, file, 'remove_unused', 'low', 0.25 from x where usage_count = 0 and not is_public
union all select symbol, file, 'move_method', 'medium', 1.5 from x where file_count > 1 and best_file <> file union all select symbol, file, 'rename_symbol', 'low', 1.0 from x where regexp_matches(name, '^[a-z]$|^temp|^data|^item|^obj|^val')""")
def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.opportunities(_crossed(spark, sf_dir)).select("symbol", "file", "type", "impact", "effort")


@query(f"""with r as (select l_orderkey symbol, l_suppkey as file, l_linenumber as line, case l_returnflag when 'A' then 'usage' when 'N' then 'call' else 'import' end as type from lineitem), s as (select s_suppkey as file, i pos, 's' || s_suppkey || '_' || i as name, i * 2 start_line, i * 2 + 3 end_line from supplier, (select unnest([1, 2, 3]) i)),
j as (select distinct r.symbol, r.file, r.line from r where type <> 'import'), k as (select j.*, name, row_number() over (partition by j.symbol, j.file, j.line order by pos) n from j join s on s.file = j.file and line between start_line and end_line) select distinct symbol, name dependent from k where n = 1""")
def symbol_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    r = facts.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("symbol"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.when(flag == "A", "usage").when(flag == "N", "call").otherwise("import").alias("type"))
    s = facts.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("pos"))
    s = s.select("file", "pos", F.concat(F.lit("s"), F.col("file").cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("name"), (F.col("pos") * 2).alias("start_line"), (F.col("pos") * 2 + 3).alias("end_line"))
    return relational.symbol_dependents(r, s)


@query(f"""with rel as (select src key, count(*) n from ({_REL}) join part on p_partkey = dst where contains(lower(p_name), 'red') group by 1), s as (select p_partkey key, p_name as name, (case when lower(p_name) = 'red' then 100 when contains(lower(p_name), 'red') then 50 else 0 end + 10 * coalesce(n, 0))::bigint score, 'red' term from part left join rel on rel.key = p_partkey),
f as (select p_partkey key, p_name as name, (case when contains(lower(p_name), 'function') then 50 else 0 end + case when p_type = 'SMALL' then 20 else 0 end)::bigint score, 'function' term from part)
select * from (select * from s where score > 0 order by score desc, key limit 20) union all select * from (select * from f where score > 0 order by score desc, key limit 20)""")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    s = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.when(F.col("p_type") == "SMALL", "function").otherwise("variable").alias("kind"))
    rel = facts.relationships(spark, sf_dir).join(p.select(F.col("p_partkey").alias("dst"), "p_name"), "dst").select(F.col("src").alias("key"), F.col("p_name").alias("dst"))
    of = lambda term, r=None: relational.symbol_search(s, term, r).select("key", "name", "score", F.lit(term).alias("term"))
    return of("red", rel).unionByName(of("function"))


@query("""with s as (select p_partkey key, round((p_partkey % 97) / 97.0, 6)::double score, p_size % 5 = 0 as same_file, p_type = 'PROMO' as recent from part) select key, score, round(least(score + case when same_file then 0.1 else 0 end + case when recent then 0.15 else 0 end, 1.0), 6)::double boosted from s where score > 0.1 order by boosted desc, key limit 20""")
def relevance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    s = p.select(F.col("p_partkey").alias("key"), F.round((F.col("p_partkey") % 97) / 97, 6).alias("score"), (F.col("p_size") % 5 == 0).alias("same_file"), (F.col("p_type") == "PROMO").alias("recent"))
    s = s.withColumn("score", F.round("score", 6))
    return relational.relevance_search(s).select("key", "score", F.round("boosted", 6).alias("boosted"))


@query("""with p as (select doc_id, quality, case when n_chars >= 1000 then 1 else 0 end pred from labels join documents using (doc_id)) select quality, pred::int pred, count(*) n from p group by all""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.confusion(_predicted(spark, sf_dir), "quality", "pred")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return facts.table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("pred", (F.col("n_chars") >= 1000).cast("int"))


@query("""with p as (select quality, case when n_chars >= 1000 then 1 else 0 end pred from labels join documents using (doc_id)), k as (select unnest([0, 1]) c), m as (select c, (select count(*) from p where pred = c and quality = c) tp, (select count(*) from p where pred = c) said, (select count(*) from p where quality = c) there from k),
t as (select sum(tp) / (select count(*) from p)::double accuracy, sum(case when said > 0 then tp / said::double else 0 end) / count(*) filter (said > 0) pr, sum(case when there > 0 then tp / there::double else 0 end) / count(*) filter (said > 0) rc from m)
select round(accuracy, 6) accuracy, round(pr, 6) as precision, round(rc, 6) recall, round(case when pr + rc > 0 then 2 * (pr * rc) / (pr + rc) else 0 end, 6) f1 from t""")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = relational.macro_scores(_predicted(spark, sf_dir), "quality", "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("""with p as (select doc_id, source, quality, n_chars from labels join documents using (doc_id)), r as (select *, row_number() over (partition by source order by n_chars desc, doc_id) r, row_number() over (partition by source order by quality desc, doc_id) i from p),
g as (select source, min(r) filter (quality > 0) first, sum(case when r <= 10 then quality / log2(r + 1) else 0 end) dcg, sum(case when i <= 10 then quality / log2(i + 1) else 0 end) best from r group by source)
select round(avg(coalesce(1.0 / first, 0)), 6)::double mrr, round(avg(case when best > 0 then dcg / best else 0 end), 6)::double ndcg from g""")
def mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = relational.ranking_scores(_predicted(spark, sf_dir), "source", "quality", "n_chars", "doc_id")
    return m.select(F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


#: Every order is a scope of its customer's file, from the day of the order on.
_SCOPES = "select o_custkey as file, o_orderkey scope_id, day0 start_line, day0 + 5 + o_orderkey % 300 as end_line from (select *, date_diff('day', date '1992-01-01', o_orderdate::date) day0 from orders)"


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return facts.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("scope_id"), d.cast("long").alias("start_line"), (d + 5 + F.col("o_orderkey") % 300).cast("long").alias("end_line"))


_TREE = f"""s as ({_SCOPES}), t as (select a.file, a.scope_id, a.start_line, a.end_line, count(b.scope_id)::int depth, max_by(b.scope_id, (b.start_line, -b.end_line, b.scope_id)) parent_id
from s a left join s b on a.file = b.file and b.end_line >= a.end_line and (b.start_line < a.start_line or b.start_line = a.start_line and (b.end_line > a.end_line or b.end_line = a.end_line and b.scope_id < a.scope_id)) group by all)"""
_VARS = "v as (select file, scope_id % 3 as name, scope_id, depth, scope_id % 4 = 0 is_parameter, (file + scope_id) % 5 < 2 is_constant from t), w as (select *, lead(scope_id) over o shadows, lead(is_constant) over o hidden from v window o as (partition by file, name order by depth desc, scope_id))"


def _variables(tree: DataFrame) -> DataFrame:
    k = F.col("scope_id")
    return tree.select("file", (k % 3).alias("name"), "scope_id", "depth", (k % 4 == 0).alias("is_parameter"), ((F.col("file") + k) % 5 < 2).alias("is_constant"))


@query(f"with {_TREE} select scope_id, coalesce(parent_id, -1) parent_id, depth from t")
def scope_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.scope_tree(_scopes(spark, sf_dir)).select("scope_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "depth")


@query(f"""with {_TREE}, p as (select o_orderkey point_id, o_custkey as file, date_diff('day', date '1992-01-01', o_orderdate::date) as line from orders), j as (select point_id, scope_id, row_number() over (partition by point_id order by depth desc, scope_id) k from p join t on p.file = t.file and line between start_line and end_line)
select p.point_id, coalesce(scope_id, -1) scope_id from p left join j on p.point_id = j.point_id and k = 1""")
def scope_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = scopes.scope_tree(_scopes(spark, sf_dir))
    p = facts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("file"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("line"))
    return scopes.innermost(p, tree).select("point_id", F.coalesce("scope_id", F.lit(-1)).alias("scope_id"))


@query(f"""with {_TREE}, {_VARS}, i as (select l_orderkey scope_id, count(*) symbols, count(*) filter (l_quantity < 5) unused from lineitem group by 1), c as (select parent_id scope_id, count(*) children from t where parent_id is not null group by 1),
x as (select depth, coalesce(symbols, 0) * 0.3 + coalesce(children, 0) * 0.4 + (end_line - start_line) * 0.001 cx, coalesce(symbols, 0) s, coalesce(unused, 0) u from t left join i using (scope_id) left join c using (scope_id))
select count(*) scopes, round(avg(depth), 6) mean_depth, max(depth)::int max_depth, round(avg(cx), 6)::double mean_complexity, round(sum(u) / sum(s)::double, 6) unused_rate, round((select count(*) from w where shadows is not null) / sum(s)::double, 6) shadowing_rate,
  array_to_string(list_filter([case when max(depth) > 6 then 'scopes nest more than 6 deep' end, case when (select count(*) from w where shadows is not null) / sum(s)::double > 0.1 then 'more than a tenth of the variables hide others' end, case when sum(u) / sum(s)::double > 0.2 then 'more than a fifth of the variables have no use' end], lambda a: a is not null), '; ') advice from x""")
def scope_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = settle(scopes.scope_tree(_scopes(spark, sf_dir)))
    v = facts.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scope_id"), (F.col("l_quantity") >= 5).cast("int").alias("n_uses"))
    m = scopes.scope_advice(scopes.scope_metrics(tree, v, scopes.shadowing(_variables(tree))))
    six = ("mean_depth", "mean_complexity", "unused_rate", "shadowing_rate")
    return m.select("scopes", "max_depth", *[F.round(c, 6).alias(c) for c in six], F.array_join("advice", "; ").alias("advice"))


@query(f"""with {_TREE}, {_VARS} select name, scope_id, depth, shadows, case when is_parameter then 'warning' when is_constant and not hidden then 'error' else 'warning' end severity,
  case when is_parameter then 'parameter ' else 'variable ' end || chr(39) || name || chr(39) || ' hides one of an outer scope; give it a name of its own' suggestion from w where shadows is not null""")
def shadowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.shadowing(_variables(scopes.scope_tree(_scopes(spark, sf_dir)))).select("name", "scope_id", "depth", "shadows", "severity", "suggestion")


_ACCESS = f"{_TREE}, up as (select scope_id, parent_id ancestor, 1 up from t where parent_id is not null union all select up.scope_id, t.parent_id, up + 1 from up join t on t.scope_id = up.ancestor where t.parent_id is not null), n as (select scope_id, case when scope_id % 6 = 5 then 'cache5' else 'v' || scope_id % 6 end as name from t), a as (select scope_id, scope_id origin, name, 0 up from n union all select up.scope_id, ancestor, name, up from up join n on n.scope_id = up.ancestor), b as (select scope_id, name, min_by(origin, up) origin, min(up) up from a group by all)"


def _accessible(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tree = settle(scopes.scope_tree(_scopes(spark, sf_dir)))
    k = F.col("scope_id")
    v = tree.select("scope_id", F.when(k % 6 == 5, "cache5").otherwise(F.concat(F.lit("v"), (k % 6).cast("string"))).alias("name"))
    return tree, scopes.accessible(tree, v, scopes.ancestors(tree, settle))


@query(f"with recursive {_ACCESS} select scope_id, name, origin, up::int up from b")
def accessible_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accessible(spark, sf_dir)[1].select("scope_id", "name", "origin", F.col("up").cast("int").alias("up"))


@query(f"""with recursive {_ACCESS}, c as (select b.scope_id, b.name, b.origin, t.depth = 0 or contains(b.name, 'cache') or contains(b.name, 'store') leak from b join t on t.scope_id = b.origin where up > 0 and b.scope_id % 2 = 0), g as (select scope_id, count(*) n, bool_or(leak) l from c group by 1)
select c.*, array_to_string(list_filter([case when n > 5 then 'it captures more than 5 names' end, case when l then 'what it captures may stay in memory' end], lambda x: x is not null), '; ') advice from c join g using (scope_id)""")
def closure_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, reachable = _accessible(spark, sf_dir)
    kinds = tree.select("scope_id", F.when(F.col("depth") == 0, "global").otherwise("block").alias("type"))
    c = scopes.captures(reachable, tree.where("scope_id % 2 = 0"), kinds)
    return c.select("scope_id", "name", "origin", "leak", F.array_join("advice", "; ").alias("advice"))


@query("""select user_id || ':' || event_type as variable, min(event_id)::bigint as first, max(event_id)::bigint as last, count(*) n, (max(event_id) - min(event_id) + 40)::bigint lifespan, max(event_id) - min(event_id) + 40 > 50 long_lived from events group by all""")
def lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("variable"), F.col("event_id").alias("line"))
    v = e.groupBy("variable").agg((F.min("line") - 40).alias("declared"))
    return scopes.lifetimes(v, e)


@query("""with u as (select user_id, count(*) n, count(*) filter (event_type <> 'view') reads from events group by 1) select c_custkey variable, case when n is null then 'never_used' else 'write_only' end reason from customer left join u on user_id = c_custkey where n is null or reads = 0""")
def unused_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("variable"))
    u = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("variable"), F.when(F.col("event_type") == "view", "write").otherwise("read").alias("access"))
    return scopes.unused_variables(v, u)


@query("""select split_part(split_part(url, '//', 2), '/', 1) host, count(*) pages, count(*) filter (split_part(split_part(url, '//', 2), '/', 1) like '%.example.org') allowed from pages group by 1""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "pages").select(F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.sum(S.path_allowed("host", ["*.example.org"], []).cast("long")).alias("allowed"))


@query(f"""with {_FEATURES} select key, name, len(t)::int n_tokens, array_to_string(technical, ',') technical, array_to_string(domain, ',') as domain, array_to_string(nouns, ',') nouns, array_to_string(verbs, ',') verbs, array_to_string(list_filter(t, lambda w: len(w) <= 4 and upper(w) = w), ',') abbreviations, naming naming_ok, acronym is_acronym, case when len(domain) > len(technical) then 0.8 else 0.3 end::double domain_specificity from feat""")
def term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.symbol_features(_symbols(spark, sf_dir))
    return f.select("key", "name", "n_tokens", *[F.array_join(c, ",").alias(c) for c in ("technical", "domain", "nouns", "verbs", "abbreviations")], "naming_ok", "is_acronym", "domain_specificity")


@query(f"""with {_FEATURES}
select key, name, case when contains(name, 'Factory') then 'factory' else '' end design, case when contains(name, 'Manager') then 'god-object' else '' end anti_pattern, case kind when 'interface' then 0.9 when 'class' then 0.6 when 'function' then 0.4 when 'variable' then 0.1 else 0.5 end::double abstraction, side::double side_effect_risk, dep::double deprecation_risk,
  case when len(list_filter(t, lambda w: w in ('order', 'customer', 'product', 'payment', 'account', 'user'))) > 0 then 0.8 else 0.2 end::double business_relevance, clarity::double purpose_clarity, round(instability, 6)::double instability, round(mi, 6)::double maintainability, doc::double documentation, case when exported then 0.8 else 0.4 end::double interface_stability, case when exported then 0.7 else 0.9 end::double api_stability,
  case p when 'core' then 'core' when 'test' then 'test' when 'util' then 'utility' else 'application' end module_type, p namespace, 'unknown' as role, array_to_string(list_filter([case when line_count > 100 then 'long-method' end, case when dependencies > 10 then 'feature-envy' end], lambda x: x is not null), ',') smells from (select *, split_part(file_path, '/', 3) p from feat)""")
def symbol_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.symbol_features(_symbols(spark, sf_dir))
    one = lambda c: F.array_join(c, ",")
    six = lambda c: F.round(c, 6).alias(c)
    return f.select("key", "name", one("design_patterns").alias("design"), one("anti_patterns").alias("anti_pattern"), "abstraction", "side_effect_risk", "deprecation_risk", "business_relevance", "purpose_clarity", six("instability"), six("maintainability"), "documentation", "interface_stability", "api_stability", "module_type", "namespace", "role", one("smells").alias("smells"))


@query(f"with {_FEATURES} select key, round(relevance, 6)::double relevance, round(quality, 6)::double quality, round(upkeep, 6)::double upkeep, round(risk, 6)::double risk from comp")
def composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.symbol_features(_symbols(spark, sf_dir))
    return f.select("key", *[F.round(f"{c}_score", 6).alias(c) for c in ("relevance", "quality", "upkeep", "risk")])


@query(f"""with {_FEATURES}, n as (select key, [least(1, len(t) / 10.0), len(technical) / 5.0, len(verbs) / 3.0, naming::int, least(1, cc / 20.0), mi / 100, instability, case when contains(name, 'Factory') then 1 / 3.0 else 0 end, least(1, usage_count / 100.0), least(1, usage_spread / 10.0), clarity, focus,
  case when len(list_filter(t, lambda w: w in ('order', 'customer', 'product', 'payment', 'account', 'user'))) > 0 then 0.8 else 0.2 end, relevance, quality, upkeep, 1 - risk]::double[] v from comp) select key, i::int i, round(v[i + 1], 6) x from (select key, v, unnest(range(0, 17)) i from n)""")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = features.normalised_features(features.symbol_features(_symbols(spark, sf_dir)))
    return v.select("key", F.posexplode("v").alias("i", "x")).select("key", "i", F.round("x", 6).alias("x"))


@query("""with s as (select p_partkey as key, (p_partkey % 97) / 97.0 sem, p_size cx, p_type = 'PROMO' pub, p_type = 'SMALL' dep, p_partkey % 130 u, p_partkey % 7 x, (p_partkey % 10) / 20.0 r, p_size % 5 = 0 sf, p_size % 7 = 0 rc from part),
t as (select key, sem, greatest(0, least(1, case when cx < 5 then 0.2 else 0 end + case when pub then 0.3 else 0 end + least(u / 100.0, 0.3) - case when dep then 0.4 else 0 end)) st, case when sf then 0.4 else 0 end + case when rc then 0.3 else 0 end ct, greatest(0, least(1, least(u / 50.0, 0.4) + least(x / 10.0, 0.3) + least(r, 0.3))) us from s)
select key, round(0.4 * sem + 0.2 * st + 0.2 * ct + 0.2 * us, 6)::double score, array_to_string(list_filter([case when sem > 0.7 then 'High semantic similarity to query' end, case when st > 0.6 then 'Good structural match (complexity, API status)' end, case when ct > 0.5 then 'Relevant to current context' end, case when us > 0.6 then 'Frequently used symbol' end], lambda x: x is not null), '; ') explanation from t""")
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = facts.table(spark, sf_dir, "part"), F.col("p_partkey")
    c = features.combined_score((k % 97) / 97, F.col("p_size"), F.col("p_type") == "PROMO", F.col("p_type") == "SMALL", k % 130, k % 7, (k % 10) / 20, F.col("p_size") % 5 == 0, F.col("p_size") % 7 == 0)
    s = p.select(k.alias("key"), c.alias("c"))
    return s.select("key", F.round("c.score", 6).alias("score"), features.explanation(F.col("c")).alias("explanation"))


_PATTERN_NAMES = """n as (select p_partkey as key, replace(p_name, ' ', '_') || case p_partkey % 6 when 0 then 'Singleton' when 1 then 'Factory' when 2 then 'Strategy' when 3 then 'Model' when 4 then 'View' else 'Handler' end || p_partkey as name, case when p_size % 2 = 0 then 'class' else 'function' end kind from part),
r as (select a.name src, b.name dst, case when type = 'A' then 'contains' else 'calls' end as type from (RELATIONS) x join n a on a.key = x.src join n b on b.key = x.dst)"""


@query(f"""with {_PATTERN_NAMES.replace('RELATIONS', _REL)}, c as (select src, count(*) k, count(distinct case when type = 'contains' then dst end) below from r group by 1), s as (select n.*, coalesce(k, 0) k, coalesce(below, 0) below, lower(name) low from n left join c on c.src = n.name)
select 'singleton' as type, name, '' part, 0.7::double confidence from s where kind = 'class' and contains(low, 'singleton') union all select 'factory', name, '', 0.6 from s where contains(low, 'factory') and k > 2 union all select 'strategy', name, '', 0.8 from s where contains(low, 'strategy') and below > 2
union all select 'mvc', name, case when contains(low, 'model') then 'model' when contains(low, 'view') then 'view' else 'controller' end, 0.8 from s where regexp_matches(low, 'model|view|handler') and (select count(distinct key % 6) from s where key % 6 >= 3) = 3""")
def architectural_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = facts.table(spark, sf_dir, "part"), F.col("p_partkey")
    end = F.when(k % 6 == 0, "Singleton").when(k % 6 == 1, "Factory").when(k % 6 == 2, "Strategy").when(k % 6 == 3, "Model").when(k % 6 == 4, "View").otherwise("Handler")
    n = p.select(k.alias("key"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), end, k.cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, "class").otherwise("function").alias("kind"))
    by = lambda a, b: n.select(F.col("key").alias(a), F.col("name").alias(b))
    rel = facts.relationships(spark, sf_dir).join(by("src", "s"), "src").join(by("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), F.when(F.col("type") == "A", "contains").otherwise("calls").alias("type"))
    below = rel.where("type = 'contains'").groupBy("src").agg(F.count_distinct("dst").alias("n"))
    return features.patterns(n.select("name", "kind"), rel, below)


@query()
def code_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, every fifth line a symbol that depends on the next one: the context of the first symbol within 60 tokens."""
    f = facts.files(spark, sf_dir).select("file_path", "content")
    n = F.size(F.split("content", "\n", -1))
    at = f.select("file_path", n.alias("n"), F.explode(F.sequence(F.lit(1), n, F.lit(5))).alias("start_line"))
    s = at.select("file_path", F.concat(F.lit("s"), "start_line").alias("name"), "start_line", F.least(F.col("start_line") + 1, F.col("n")).alias("end_line"), F.when(F.col("start_line") < 12, F.array(F.concat(F.lit("s"), F.col("start_line") + 5))).otherwise(F.array().cast("array<string>")).alias("dependencies"))
    req = f.select("file_path", F.array(F.lit("s1")).alias("targets"))
    return requests.extract_code_context(req, f, s, settle, max_tokens=60).select("file_path", "extracted_code", "token_count", "relevance_score")


@query(f"select distinct src child, dst parent from ({_REL}) where type in ('A', 'N')")
def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("type") == "A", "extends").when(F.col("type") == "N", "implements").otherwise("uses")
    return relational.parents(facts.relationships(spark, sf_dir).withColumn("type", kind))


_BASES = "select p_partkey src, p_partkey // 3 dst from part where p_partkey > 0 union select p_partkey, p_partkey // 5 from part where p_partkey % 4 = 0 and p_partkey > 0"


@query(f"with recursive e as ({_BASES}), p as (select src node, 0 d from e union select dst, 0 from e union select e.src, d + 1 from p join e on e.dst = p.node) select node, max(d)::int depth from p group by node")
def inheritance_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many classes the longest chain above each class has: part p has the base p / 3, every fourth one p / 5 besides."""
    p = facts.table(spark, sf_dir, "part").where("p_partkey > 0")
    base = lambda n: F.floor(F.col("p_partkey") / n).cast("long").alias("dst")
    rows = p.select(F.col("p_partkey").alias("src"), base(3)).union(p.where("p_partkey % 4 = 0").select("p_partkey", base(5)))
    extends = relational.parents(rows.withColumn("type", F.lit("extends")))
    return graph.longest_path(extends.where("child <> parent"), settle, src="child", dst="parent")


@query(f"select src, string_agg(type || ':' || dst || ':' || dst % 7, ',' order by type, dst) relations from ({_REL}) group by src")
def merged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's relations over all files, in order."""
    m = relational.merged_relations(facts.relationships(spark, sf_dir).withColumn("file", F.col("dst") % 7))
    one = lambda x: F.concat_ws(":", x["type"], x["dst"].cast("string"), x["file"].cast("string"))
    return m.select("src", F.array_join(F.transform("relations", one), ",").alias("relations"))


@query("with w as (select distinct l_partkey symbol, (l_suppkey % 5)::int as file from lineitem) select symbol, file, p_type kind, p_size::int n from w left join part on p_partkey = symbol and p_partkey % 5 = file")
def symbol_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols asked for by name and file, with what is known of them; null where the file has none of the name."""
    wanted = facts.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), (F.col("l_suppkey") % 5).cast("int").alias("file")).distinct()
    known = facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 5).cast("int").alias("file"), F.col("p_type").alias("kind"), F.col("p_size").alias("n"))
    return relational.symbol_info(wanted, known).select("symbol", "file", "kind", "n")


@query("""select p_partkey as key, case when p_size % 4 = 0 then p_brand when p_size % 3 = 0 then p_type when k in ('function', 'class') then k when k = 'variable' then 'any' else 'unknown' end as type, case when p_size % 4 = 0 then 1.0 when p_size % 3 = 0 then 0.9 when k in ('function', 'class') then 0.8 when k = 'variable' then 0.3 else 0.0 end::double confidence
from (select *, case p_partkey % 4 when 0 then 'function' when 1 then 'class' when 2 then 'variable' else 'enum' end k from part)""")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of every symbol by its annotation, else its return type, else its kind."""
    p, size = facts.table(spark, sf_dir, "part"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "variable", "enum"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    t = S.inferred_type(F.when(size % 4 == 0, F.col("p_brand")), F.when(size % 3 == 0, F.col("p_type")), kind)
    return p.select(F.col("p_partkey").alias("key"), t.alias("t")).select("key", "t.type", "t.confidence")
