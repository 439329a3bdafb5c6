"""Queries over documents, conversations and parts as text: budgets, tokens, features, diffs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import diff, relational, text
from tessera.plans.registry import query
from tessera.plans.tables import settle, shared_dir
from tessera.sources import facts, snapshots

_LINES = "select doc_id, unnest(generate_series(0, len(l) - 1)) pos, unnest(l) line from (select doc_id, string_split(text, chr(10)) l from documents)"
_TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: len(t) > 1)"


@query(f"""with l as ({_LINES}), c as (select *, sum(ceil(len(line) / 4.0)::bigint) over (partition by doc_id order by pos) s from l)
select d.doc_id, count(c.pos)::bigint kept_lines, coalesce(max(s), 0)::bigint token_count, coalesce(string_agg(line, chr(10) order by pos), '') kept_text from documents d left join c on c.doc_id = d.doc_id and s <= 100 group by d.doc_id""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = text.token_budget(d, "text", 100)
    return out.select("doc_id", F.col("kept_lines").cast("long").alias("kept_lines"), "token_count", "kept_text")


@query(f"""with l as ({_LINES}), c as (select *, sum(len(line) + case when pos > 0 then 1 else 0 end) over (partition by doc_id order by pos) s from l)
select d.doc_id, count(c.pos)::bigint kept_lines, ceil(coalesce(max(s), 0) / 4.0)::bigint token_count, coalesce(string_agg(line, chr(10) order by pos), '') kept_text from documents d left join c on c.doc_id = d.doc_id and s <= 400 group by d.doc_id""")
def char_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.char_cap(d, "text", 100).select("doc_id", F.col("kept_lines").cast("long").alias("kept_lines"), "token_count", "kept_text")


@query("select lang, count(*) n_docs, sum(ceil(len(text) / 4.0))::bigint tokens, max(ceil(len(text) / 4.0))::bigint longest from documents group by lang")
def token_estimate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.token_estimate("text")
    return facts.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(t).alias("tokens"), F.max(t).alias("longest"))


@query(f"""with t as (select doc_id, unnest({_TOKENS.format('text')}) token from documents), p as (select token, doc_id, count(*) n from t group by all)
select token, sum(n)::bigint n, count(*) df, round(ln((select count(*) from documents) / count(*)::double), 6) idf from p group by token having sum(n) >= 2""")
def vocabulary_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.vocabulary_idf(d, "doc_id", "text").select("token", "n", "df", F.round("idf", 6).alias("idf"))


@query(f"""with t as (select conv_id, turn, {_TOKENS.format('text')} w from conversations)
select conv_id, turn, len(w)::bigint n_tokens, len(list_distinct(w))::bigint n_distinct, round(case when len(w) > 0 then list_sum(list_transform(w, lambda x: len(x))) / len(w)::double else 0.0 end, 6) mean_length,
  len(list_filter(w, lambda x: x in ('api', 'http', 'json', 'xml', 'sql', 'database', 'cache', 'queue', 'thread', 'async', 'sync', 'promise', 'callback', 'event', 'stream', 'buffer', 'socket', 'connection', 'session', 'token', 'auth', 'oauth', 'encryption', 'hash', 'algorithm', 'data', 'model', 'view', 'controller', 'service', 'repository', 'factory', 'builder', 'adapter', 'proxy', 'decorator', 'observer', 'strategy', 'command', 'state', 'visitor')))::bigint technical, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))::bigint with_digit from t""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = facts.table(spark, sf_dir, "conversations").select("conv_id", "turn", S.ascii_tokens("text").alias("w"))
    n = lambda c: F.size(c).cast("long")
    return t.select("conv_id", "turn", n("w").alias("n_tokens"), n(F.array_distinct("w")).alias("n_distinct"), F.round(S.mean_length("w"), 6).alias("mean_length"), n(S.technical_terms("w")).alias("technical"), n(F.filter("w", lambda x: x.rlike("[0-9]"))).alias("with_digit"))


@query("""with n as (select p_partkey, p_brand || upper(p_name[1]) || p_name[2:] || '_' || lower(p_type) as ident from part)
select p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(ident, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')), '\\s+'), lambda t: t <> ''), ',') ident_tokens,
  array_to_string(regexp_extract_all(ident, '[a-z]+|[A-Z][a-z]*'), ',') camel, array_to_string(list_filter(string_split(ident, '_'), lambda t: t <> ''), ',') snake, regexp_matches(ident, '[0-9]') has_digit, regexp_matches(ident, '[^a-zA-Z0-9]') has_special from n""")
def ident_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    ident = F.concat("p_brand", F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit("_"), F.lower("p_type"))
    p = p.select("p_partkey", ident.alias("i"))
    joined = lambda a: F.array_join(a, ",")
    return p.select("p_partkey", joined(S.identifier_tokens("i")).alias("ident_tokens"), joined(S.camel_tokens("i")).alias("camel"), joined(S.snake_tokens("i")).alias("snake"), F.col("i").rlike("[0-9]").alias("has_digit"), F.col("i").rlike("[^a-zA-Z0-9]").alias("has_special"))


@query("""with f as (select p_partkey, p_size * 4 as lines, (p_partkey % 23)::int as deps from part)
select p_partkey, greatest(1, lines // 10)::bigint cyclomatic, round(greatest(0, 100 - lines * 0.5 - greatest(1, lines // 10) * 2), 6)::double maintainability, case when lines > 100 then 0.3 else 0.1 end::double debt, round(least(1, deps / 10.0), 6)::double coupling, round(greatest(0, 1 - deps / 20.0 - lines / 200.0), 6)::double focus,
  (case when lines > 100 then 1 else 0 end + case when deps > 10 then 1 else 0 end)::bigint smells, round(least(lines / 50.0 + deps / 10.0, 1), 6)::double complexity from f""")
def quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 4).alias("lines"), (F.col("p_partkey") % 23).cast("int").alias("deps"))
    g = f.withColumn("cc", S.cyclomatic("lines"))
    r = lambda x, name: F.round(x, 6).alias(name)
    return g.select(
        "p_partkey", F.col("cc").alias("cyclomatic"), r(S.maintainability("lines", "cc"), "maintainability"), S.technical_debt("lines").alias("debt"), r(S.coupling_degree("deps"), "coupling"), r(S.focus("deps", "lines"), "focus"),
        F.size(S.code_smells("lines", "deps")).cast("long").alias("smells"), r(S.complexity_share("lines", "deps"), "complexity"),
    )


@query("""with l as (select conv_id, turn, unnest(generate_series(0, len(x) - 1)) pos, unnest(x) line from (select conv_id, turn, string_split(text, chr(10)) x from conversations)),
o as (select conv_id, turn + 1 as turn, pos, nullif(line, '') old_code from l where turn + 1 in (select turn from conversations c where c.conv_id = l.conv_id)), n as (select conv_id, turn, pos, nullif(line, '') new_code from l where turn > 0)
select conv_id, turn, pos::bigint pos, case when old_code is null then 'added' when new_code is null then 'removed' else 'modified' end change, old_code, new_code from o full join n using (conv_id, turn, pos) where old_code is distinct from new_code""")
def symbol_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.table(spark, sf_dir, "conversations")
    ln = facts.lines(c, "conv_id", "turn", text="text").withColumn("pos", F.col("pos").cast("long"))
    there = c.select("conv_id", "turn")
    old = ln.withColumn("turn", F.col("turn") + 1).join(there, ["conv_id", "turn"], "left_semi")
    return relational.symbol_diff(old.withColumnRenamed("line", "code"), ln.where("turn > 0").withColumnRenamed("line", "code"), ["conv_id", "turn", "pos"])


@query("""with l as (select conv_id, turn, unnest(generate_series(0, len(x) - 1)) pos, unnest(x) line from (select conv_id, turn, string_split(text, chr(10)) x from conversations)),
o as (select conv_id, turn + 1 as turn, pos, nullif(line, '') old_code from l), n as (select conv_id, turn, pos, nullif(line, '') new_code from l where turn > 0), d as (select conv_id, count(*) filter (old_code is null) a, count(*) filter (new_code is null) r, count(*) filter (old_code <> new_code) m from o full join n using (conv_id, turn, pos) where old_code is distinct from new_code group by 1)
select conv_id, a::bigint added, r::bigint removed, m::bigint modified, case when a + r + m = 0 then 'No changes detected' else array_to_string(list_filter([case when a = 1 then '1 addition' when a > 1 then a || ' additions' end, case when r = 1 then '1 deletion' when r > 1 then r || ' deletions' end, case when m = 1 then '1 modification' when m > 1 then m || ' modifications' end], lambda x: x is not null), ', ') end summary from d""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that change from turn to turn of a conversation, place by place, in words."""
    ln = facts.lines(facts.table(spark, sf_dir, "conversations"), "conv_id", "turn", text="text").withColumnRenamed("line", "code")
    c = relational.symbol_diff(ln.withColumn("turn", F.col("turn") + 1), ln.where("turn > 0"), ["conv_id", "turn", "pos"])
    n = lambda k: F.sum((F.col("change") == k).cast("long")).alias(k)
    return c.groupBy("conv_id").agg(n("added"), n("removed"), n("modified")).withColumn("summary", diff.summary(F.col("added"), F.col("removed"), F.col("modified")))


TOUCHED = ["the", "des", "http"]


def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, old, new: each document b beside the first document a < b (by doc_id) that has one of its lines of at least 20 characters, for each such line, where the texts differ."""
    d = facts.table(spark, sf_dir, "documents").select("doc_id", "text")
    ln = facts.lines(d, "doc_id", text="text").where(F.length("line") >= 20).select("doc_id", F.xxhash64("line").alias("h")).distinct()
    first = ln.groupBy("h").agg(F.min("doc_id").alias("a"))
    pairs = ln.join(first, "h").where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    t = lambda k, c: d.select(F.col("doc_id").alias(k), F.col("text").alias(c))
    both = pairs.join(t("a", "old"), "a").join(t("b", "new"), "b").where("old <> new")
    return both.select(F.concat_ws("-", "a", "b").alias("key"), "old", "new")


@query()
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.line_diff(version_pairs(spark, sf_dir), "key")


@query()
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hunks(diff.line_diff(version_pairs(spark, sf_dir), "key"), "key")


@query()
def contextual_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = settle(version_pairs(spark, sf_dir))
    new = p.select("key", F.posexplode(F.split("new", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)
    return diff.contextual(diff.hunks(diff.line_diff(p, "key"), "key"), new, "key", 2)


@query()
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = diff.diff_stats(diff.hunks(diff.line_diff(version_pairs(spark, sf_dir), "key"), "key"), "key")
    return s.withColumn("summary", diff.summary(F.col("added"), F.col("removed"), F.col("modified")))


@query()
def touching_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks between versions whose text holds one of three words."""
    h = settle(diff.hunks(diff.line_diff(version_pairs(spark, sf_dir), "key"), "key"))
    return diff.touching(h, TOUCHED).select("key", "hunk", "type", "content")


@query()
def hunks_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every older version with its hunks applied: whether that gives the newer version back."""
    p = settle(version_pairs(spark, sf_dir))
    made = diff.apply_all(p, diff.hunks(diff.line_diff(p, "key"), "key"), "key")
    return p.select("key", "new").join(made, "key").select("key", (F.col("text") == F.col("new")).alias("same"))


@query("""select p_partkey, cardinality(list_filter(['red', 'blue', 'small', 'widget'], lambda t: list_contains(string_split(p_name, ' '), t))) / 4.0::double relevance, 'Line ' || p_size || ' in x' || p_partkey % 9 || '.ts' context, regexp_matches(p_name, '^[a-z]$|^temp|^data|^item|^obj|^val') confusing from part""")
def symbol_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    path = F.concat(F.lit("/src/x"), (F.col("p_partkey") % 9).cast("string"), F.lit(".ts"))
    return p.select("p_partkey", S.relevance(F.split("p_name", " "), F.array(*map(F.lit, ("red", "blue", "small", "widget")))).alias("relevance"), S.reference_context("p_size", path).alias("context"), S.confusing("p_name").alias("confusing"))


@query("""with t as (select p_partkey, string_split(p_name, ' ') a, string_split(lower(p_brand || ' ' || p_type || ' widget red'), ' ') b from part) select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b))::double, 6) jaccard from t""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    other = F.split(F.lower(F.concat_ws(" ", "p_brand", "p_type", F.lit("widget red"))), " ")
    return p.select("p_partkey", F.round(S.token_jaccard(F.split("p_name", " "), other), 6).alias("jaccard"))


@query("""select sha, count(*) n, min(doc_id) first_id from (select doc_id, md5(text) sha from documents) group by sha having count(*) > 1""")
def repeated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text another one has: unchanged against its snapshot."""
    d = facts.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha"))
    return d.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("select doc_id, '/' || source || '/' || lang || '/' || doc_id || '.txt:all:no-imports' as cache_key, (len(text) + 2)::bigint entry_size from documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.files(spark, sf_dir)
    none = F.array().cast("array<string>")
    return f.select("doc_id", S.cache_key("file_path", none, F.lit(False)).alias("cache_key"), (F.length("content") + F.length(F.to_json(none))).cast("long").alias("entry_size"))


@query("""select p_partkey, round(case when greatest(len(p_name), len(p_brand)) = 0 then 1.0 else (greatest(len(p_name), len(p_brand)) - levenshtein(p_name, p_brand)) / greatest(len(p_name), len(p_brand))::double end, 6) similarity, levenshtein(p_name, p_brand)::bigint distance from part""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(S.name_similarity("p_name", "p_brand"), 6).alias("similarity"), F.levenshtein("p_name", "p_brand").cast("long").alias("distance"))


@query("""select source, lang, count(*) n, sum(n_chars)::bigint chars, round(avg(n_chars), 4) mean_chars, rank() over (partition by lang order by sum(n_chars) desc, source)::bigint place from documents group by source, lang""")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    return d.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("chars"), "source")).cast("long"))


def _store(spark: SparkSession, sf_dir: str) -> snapshots.Snapshots:
    """Snapshots of documents in three versions: most of them; every third with another line; without those that were cleared."""
    d = facts.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))
    store = snapshots.Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    store.create(d.where("doc_id % 5 <> 4"), 1)
    for _ in range(2):  # a rerun adds nothing
        store.create(d.where("doc_id % 3 = 0 or doc_id % 7 = 0").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("\n!"))).otherwise(F.col("content"))), 2)
    store.clear(3, d.where("doc_id % 10 = 2"))
    return store


_SNAP = """d as (select doc_id k, '/' || doc_id || '.txt' file_path, text from documents), v as (select 1 as version, k, file_path, text from d where k % 5 <> 4 union all select 2, k, file_path, case when k % 3 = 0 then text || chr(10) || '!' else text end from d where k % 3 = 0 or (k % 7 = 0 and k % 5 = 4)),
n as (select *, row_number() over (partition by w, k order by version desc) r from v, (values (1), (2), (3)) x(w) where version <= w), s as (select w, k, file_path, version, text from n where r = 1 and not (w = 3 and k % 10 = 2))"""


@query(f"with {_SNAP} select w::int as as_of, version::int as version, count(*) n, sum(len(text))::bigint chars from s group by all")
def snapshots_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds as of each of its versions, by the version in which it was taken."""
    store = _store(spark, sf_dir)
    at = lambda v: store.get(v).groupBy("version").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")).select(F.lit(v).alias("as_of"), "version", "n", "chars")
    return at(1).union(at(2)).union(at(3))


@query(f"""with {_SNAP}, c as (select k, file_path, case when k % 3 = 0 then text || chr(10) || '!' else text end || case when k % 4 = 0 then '?' else '' end text from d where k % 11 <> 0)
select coalesce(c.file_path, o.file_path) file_path, case when c.k is null then 'deleted' when o.k is null then 'new' when c.text is not distinct from o.text then 'unchanged' else 'changed' end status from c full join (select * from s where w = 3) o using (k)""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, some changed and some gone, against the last version of the store."""
    d = facts.table(spark, sf_dir, "documents").where("doc_id % 11 <> 0").select("doc_id", F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))
    third = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("\n!"))).otherwise(F.col("content"))
    now = d.withColumn("content", F.concat(third, F.when(F.col("doc_id") % 4 == 0, F.lit("?")).otherwise(F.lit(""))))
    return _store(spark, sf_dir).compare(now)
