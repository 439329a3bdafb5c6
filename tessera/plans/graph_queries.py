"""Queries over dependency graphs: what owns what (four levels), what follows what (cycles), which documents share lines (components)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import graph, relational
from tessera.plans.registry import query
from tessera.plans.tables import settle
from tessera.sources import facts

_E = facts.OWNERSHIP_SQL
_CLOSURE = f"with recursive e as ({_E}), c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src)"
_DEPTH = f"with recursive e as ({_E}), p as (select src node, 0 d from e union select dst, 0 from e union select e.src, d + 1 from p join e on e.dst = p.node)"


@query(f"{_CLOSURE} select src, dst from c")
def closure_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(facts.ownership(spark, sf_dir), settle).select("src", "dst")


@query(f"{_DEPTH} select node, max(d)::int depth from p group by node")
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_path(facts.ownership(spark, sf_dir), settle)


@query(f"{_DEPTH}, m as (select node, max(d) layer from p group by 1) select layer::int layer, count(*) n from m group by 1")
def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layers(facts.ownership(spark, sf_dir), settle).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"""{_CLOSURE}, a as (select dst node, src from c), d as (select dst node, count(*) direct from e group by 1), t as (select node, count(*) total from a group by 1)
select node, direct::bigint direct, (total - direct)::bigint indirect, case when total > 20 or direct > 10 then 'critical' when total > 10 or direct > 5 then 'high' when total > 5 or direct > 2 then 'medium' else 'low' end risk, round(1 + 0.5 * total, 1)::double effort from d join t using (node)""")
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = settle(facts.ownership(spark, sf_dir))
    i = graph.change_impact(e, e.select(F.col("dst").alias("src")).distinct(), settle)
    total = F.col("direct") + F.col("indirect")
    return i.select("node", "direct", "indirect", S.impact_risk(total, F.lit(0), F.col("direct")).alias("risk"), S.impact_effort(total, F.lit(0)).alias("effort"))


@query(f"""with recursive e as ({facts.TRANSITIONS_SQL}), p as (select src as first, dst as last, [src, dst] path from e where src < dst
union all select first, e.dst, list_append(path, e.dst) from p join e on e.src = p.last where p.last <> p.first and e.dst >= first and (e.dst = first or not list_contains(path, e.dst)))
select array_to_string(path, '->') path, (len(path) - 1)::int length from p where first = last""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every elementary cycle of the events of a user, of any length."""
    c = graph.cycles(facts.transitions(spark, sf_dir), settle)
    return c.select(F.array_join("path", "->").alias("path"), "length")


@query(f"""with recursive e as ({facts.TRANSITIONS_SQL}), c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select c.src node, min(c.dst) component from c join c d on d.src = c.dst and d.dst = c.src group by 1""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(facts.transitions(spark, sf_dir), settle)


_SHARED = "select distinct b.doc_id src, a.f dst from (select distinct doc_id, unnest(string_split(text, chr(10))) line from documents) b join (select line, min(doc_id) f from (select distinct doc_id, unnest(string_split(text, chr(10))) line from documents) where len(line) >= 20 group by 1) a on a.line = b.line where b.doc_id <> a.f"


@query(f"with recursive e as ({_SHARED}), u as (select src a, dst b from e union select dst, src from e), c as (select a, a b from u union select c.a, u.b from c join u on u.a = c.b) select a node, min(b) component from c group by a")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share lines of 20 characters or more, each beside the first that has the line."""
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "text")
    ln = facts.lines(d, "doc_id", text="text").where(F.length("line") >= 20).select("doc_id", F.xxhash64("line").alias("h")).distinct()
    first = ln.groupBy("h").agg(F.min("doc_id").alias("dst"))
    e = ln.join(first, "h").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()
    return graph.connected_components(e, settle).distinct()


@query(f"""with e as (select distinct src, dst from ({facts.RELATIONSHIPS_SQL})), m as (select p_partkey node, p_brand as cluster from part), s as (select cluster, count(*) n from m group by 1),
j as (select a.cluster ca, b.cluster cb from e join m a on a.node = src join m b on b.node = dst), t as (select ca as cluster, count(*) filter (ca = cb) i, count(*) filter (ca <> cb) o from j group by 1 union all select cb, 0, count(*) from j where ca <> cb group by 1)
select cluster, n, sum(i)::bigint inside, sum(o)::bigint outside, round(sum(i) / (n * (n - 1))::double, 9) cohesion, round(sum(o) / (sum(i) + sum(o))::double, 9) coupling from s join t using (cluster) group by cluster, n""")
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.relationships(spark, sf_dir).select("src", "dst").distinct()
    m = facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))
    return relational.cluster_quality(e, m).withColumn("cohesion", F.round("cohesion", 9)).withColumn("coupling", F.round("coupling", 9))
