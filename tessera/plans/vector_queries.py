"""Queries over vectors: searches, metrics, clusters, projections, the network."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import mlp, relevance, text, vectors
from tessera.plans.registry import query
from tessera.plans.tables import settle
from tessera.sources import facts

_V = "select vec_id key, embedding::double[] v, label from embeddings"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query(f"""with v as ({_V}), s as (select q.key query_id, v.key, list_cosine_similarity(q.v, v.v) score from v q, v where q.key % 50 = 0 and q.key <> v.key), r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, key) k from s)
select query_id, key, round(score, 6) score, k::int as rank from r where k <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    t = vectors.cosine_topk(v, v.where("key % 50 = 0"), 10)
    return t.select("query_id", "key", F.round("score", 6).alias("score"), "rank")


@query(f"""with v as ({_V}), p as (select a.key, a.v x, b.v y from v a join v b on b.key = a.key + 1)
select key, round(list_cosine_similarity(x, y), 6) cosine, round(list_distance(x, y), 6) euclidean, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 6) manhattan,
  round(coalesce(list_sum(list_transform(list_zip(x, y), lambda z: case when z[1] > 0 and z[2] > 0 then 1 else 0 end)) / nullif(list_sum(list_transform(list_zip(x, y), lambda z: case when z[1] > 0 or z[2] > 0 then 1 else 0 end)), 0)::double, 0), 6) jaccard,
  round((select corr(a, b) from (select unnest(x) a, unnest(y) b)), 6) pearson from p""")
def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    p = v.select("key", F.col("v").alias("x")).join(v.select((F.col("key") - 1).alias("key"), F.col("v").alias("y")), "key")
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.select("key", r(S.cosine("x", "y"), "cosine"), r(S.euclidean("x", "y"), "euclidean"), r(S.manhattan("x", "y"), "manhattan"), r(S.positive_jaccard("x", "y"), "jaccard"), r(S.pearson("x", "y"), "pearson"))


@query(f"select label, pos::int pos, round(avg(x), 6) as value from (select label, unnest(generate_series(0, len(v) - 1)) pos, unnest(v) x from ({_V})) group by all")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(_vectors(spark, sf_dir), "label").select("label", "pos", F.round("value", 6).alias("value"))


@query(f"""with v as ({_V}), m as (select label, pos, avg(x) c from (select label, unnest(generate_series(1, len(v))) pos, unnest(v) x from v) group by all), c as (select label, list(c order by pos) c from m group by 1),
n as (select label, count(*) n, avg(list_distance(v, c)) cohesion from v join c using (label) group by 1), f as (select a.label, avg(list_distance(a.c, b.c)) separation from c a join c b on a.label <> b.label group by 1),
d as (select a.key, a.label, b.label t, sum(list_distance(a.v, b.v)) s, count(*) n from v a, v b group by all), r as (select key, label, max(case when t = label and n > 1 then s / (n - 1) end) a, min(case when t <> label then s / n end) b from d group by all),
s as (select label, avg(case when a is not null and b is not null and greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end) silhouette from r group by 1)
select label, n, round(cohesion, 6) cohesion, round(separation, 6) separation, round(silhouette, 6) silhouette from n join f using (label) join s using (label)""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    q = vectors.cluster_quality(v, "label").join(vectors.silhouette(v, "label"), "label")
    return q.select("label", "n", *[F.round(c, 6).alias(c) for c in ("cohesion", "separation", "silhouette")])


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kmeans(_vectors(spark, sf_dir), 10).select("key", "cluster")


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.pca(_vectors(spark, sf_dir), 8)


@query(f"with v as ({_V}), m as (select pos, avg(x) m from (select unnest(generate_series(1, len(v))) pos, unnest(v) x from v) where pos <= 4 group by 1), l as (select list(m order by pos) m from m) select key, round(v[1] - m[1], 6) p1, round(v[2] - m[2], 6) p2, round(v[3] - m[3], 6) p3, round(v[4] - m[4], 6) p4 from v, l")
def centred_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors.centred_slice(_vectors(spark, sf_dir), 4)
    return p.select("key", *[F.round(F.element_at("p", i), 6).alias(f"p{i}") for i in (1, 2, 3, 4)])


@query(f"select label, count(*) n, round(avg(sqrt(list_dot_product(v, v))), 6) mean_length, (count(*) * 64 * 8)::bigint bytes from ({_V}) group by label")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(S.norm("v")), 6).alias("mean_length"), (F.count("*") * 64 * 8).alias("bytes"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, idx, idf of the first 256 words, by the first place where they stand."""
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "text")
    v = text.vocabulary_idf(d, "doc_id", "text").orderBy("first_key", "first_pos").limit(256)
    return v.withColumn("idx", F.row_number().over(Window.orderBy("first_key", "first_pos")) - 1)


_TOK = "select doc_id, unnest(generate_series(0, len(w) - 1)) pos, unnest(w) token from (select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: len(t) > 1) w from documents) where len(w) > 0"
_VOCAB = f"tok as ({_TOK}), voc as (select token, row_number() over (order by min(row(doc_id, pos))) - 1 idx, ln((select count(*) from documents) / count(distinct doc_id)::double) idf from tok group by token having count(*) >= 2 qualify idx < 256)"


@query(f"""with {_VOCAB}, x as (select doc_id, idx, sum(0.4 * case when idf = 0 then 1 else idf end) x from tok join voc using (token) group by all), n as (select doc_id, sqrt(sum(x * x)) n from x group by 1)
select d.doc_id as key, count(x.idx) filter (x.x <> 0)::bigint places, round(coalesce(max(x.x / n.n), 0), 6)::double largest, round(coalesce(sum(x.x / n.n * (idx + 1)), 0), 4)::double weighted from documents d left join x on x.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by 1""")
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a weighted tf-idf vector over the first 256 words of the vocabulary: how many places are taken, the largest value, and the sum weighted by the place."""
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "text")
    tok = d.select(F.col("doc_id").alias("key"), F.explode_outer(S.ascii_tokens("text")).alias("token"))
    e = relevance.embed({"name_tokens": tok}, _vocabulary(spark, sf_dir))
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("key", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("places"), F.round(F.array_max("v"), 6).alias("largest"), F.round(total, 4).alias("weighted"))


@query(f"""with {_VOCAB}, q as (select item_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: len(t) > 1)) token from benchmark), x as (select item_id, idx, sum(case when idf = 0 then 1 else idf end) x from q join voc using (token) group by all), n as (select item_id, sqrt(sum(x * x)) n from x group by 1)
select b.item_id as key, x.idx::int as idx, round(x.x / n.n, 6) x from benchmark b join x on x.item_id = b.item_id join n on n.item_id = b.item_id""")
def query_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = facts.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    e = relevance.embed_queries(b, _vocabulary(spark, sf_dir))
    return e.select("key", F.posexplode("v").alias("idx", "x")).where("x <> 0").select("key", "idx", F.round("x", 6).alias("x"))


_FIG = "select p_partkey as key, p_size * 2 line_count, p_size / 5.0 + p_partkey % 3 complexity, p_partkey % 3 dependencies, p_partkey % 130 usage_count, p_type = 'PROMO' is_public, p_type kind, string_split(p_name, ' ') name_tokens from part"


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = facts.table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(k.alias("key"), (F.col("p_size") * 2).alias("line_count"), S.complexity(F.col("p_size") * 2, k % 3).alias("complexity"), (k % 3).alias("dependencies"), (k % 130).alias("usage_count"), (F.col("p_type") == "PROMO").alias("is_public"), F.col("p_type").alias("kind"), F.split("p_name", " ").alias("name_tokens"), F.array("p_brand").alias("context_tokens"))


@query(f"select key from ({_FIG}) where kind in ('PROMO', 'LARGE') and key % 4 in (0, 3) and usage_count >= 20 and complexity <= 8 and is_public")
def filtered_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _figures(spark, sf_dir).withColumn("file", F.concat(F.lit("/src/m"), (F.col("key") % 4).cast("string"), F.lit(".ts")))
    return relevance.filters(f, ["PROMO", "LARGE"], ["m0", "m3"], min_usage=20, max_complexity=8, is_public=True).select("key")


@query(f"""with f as ({_FIG}), p as (select a.key, a.kind ak, b.kind bk, a.complexity ac, b.complexity bc, a.line_count al, b.line_count bl, a.is_public ap, b.is_public bp, a.usage_count au, b.usage_count bu from f a join f b on b.key = a.key + 1)
select key, round(least(1, case when ak = bk then 0.3 else 0 end + greatest(0, 0.2 - abs(ac - bc) / 10) + greatest(0, 0.2 - abs(al - bl) / 50.0) + case when ap = bp then 0.3 else 0 end), 6)::double structural, round(case when greatest(au, bu) > 0 then 1 - abs(au - bu) / greatest(au, bu)::double else 1 end, 6)::double usage,
  array_to_string(list_filter([case when ak = bk then 'Same type (' || ak || ')' end, case when abs(ac - bc) < 2 then 'Similar complexity' end, case when ap = bp then 'Same API visibility' end], lambda x: x is not null), '; ') explanation from p""")
def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _figures(spark, sf_dir)
    info = F.struct("kind", "complexity", "line_count", "is_public", "usage_count")
    j = f.select("key", info.alias("a")).join(f.select((F.col("key") - 1).alias("key"), info.alias("b")), "key")
    return j.select("key", F.round(relevance.structural_similarity("a", "b"), 6).alias("structural"), F.round(relevance.usage_similarity(F.col("a.usage_count"), F.col("b.usage_count")), 6).alias("usage"), relevance.similarity_explanation("a", "b").alias("explanation"))


_EMB = f"""f as ({_FIG}), t as (select key, unnest(name_tokens) token from f), voc as (select token, dense_rank() over (order by token) - 1 idx, ln((select count(*) from f) / count(distinct key)::double) idf from t group by token), w as (select key, idx, 0.4 * count(*) * case when any_value(idf) = 0 then 1 else any_value(idf) end x from t join voc using (token) group by all),
g as (select key, unnest([236, 237, 238, 239, 240]) idx, unnest([0.1 * line_count / 100.0, 0.1 * complexity / 10.0, 0.1 * dependencies / 20.0, 0.1 * usage_count / 50.0, 0.1 * is_public::int]::double[]) x from f), e as (select * from w union all select * from g), n as (select key, sqrt(sum(x * x)) n from e group by 1), v as (select e.key, idx, x / n.n x from e join n using (key))"""


@query(f"""with {_EMB}, s as (select q.key query_id, v.key, round(sum(q.x * v.x), 12) score from v q join v using (idx) where q.key % 50 = 0 and q.key <> v.key group by all), r as (select *, row_number() over (partition by query_id order by score desc, key) k from s where score > 0.1)
select query_id, key, k::int as rank, round(score, 6) score from r where k <= 10""")
def similar_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten symbols most like each one whose key is divisible by 50, by names and figures."""
    f = settle(_figures(spark, sf_dir).withColumns({"inheritance_depth": F.lit(0), "coupling": F.lit(0)}).withColumn("is_public", F.col("is_public").cast("int")))
    tok = f.select("key", F.explode("name_tokens").alias("token"))
    n = f.count()
    idf = tok.groupBy("token").agg(F.log(F.lit(float(n)) / F.count_distinct("key")).alias("idf")).withColumn("idx", F.dense_rank().over(Window.orderBy("token")) - 1)
    e = relevance.embed_places({"name_tokens": tok}, idf, f)
    s = relevance.similar_symbols(e, f, f.where("key % 50 = 0"))
    return s.select("query_id", "key", "rank", F.round("score", 6).alias("score"))


@query()
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the conversations with its vector."""
    t = facts.table(spark, sf_dir, "conversations").select("conv_id", "turn", S.ascii_tokens("text").alias("tokens"))
    return vectors.word_vectors(t, 16).getVectors().select("word", vector_to_array("vector").alias("v"))


@query()
def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn by the mean of its words' vectors, or by hashed counts where no model is given."""
    t = facts.table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), S.ascii_tokens("text").alias("tokens"))
    return relevance.model_cascade(t, doc_model=vectors.word_vectors(t, 16)).select("key.conv_id", "key.turn", "v")


@query()
def mlp_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of embeddings by a network trained on a bounded sample."""
    v = _vectors(spark, sf_dir)
    rows = mlp.training_sample(v, "key", 2000).toPandas()
    x, y = np.stack(rows["v"].to_numpy()), np.eye(10)[rows["label"].to_numpy() % 10]
    net = mlp.Network([x.shape[1], 32, 10], ["relu", "softmax"]).fit(x, y, epochs=15)
    return mlp.predict(v, net, "key", "v").select("key", "cls", "confidence")
