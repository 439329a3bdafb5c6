"""Feature columns of symbols, combined relevance scores and pattern detectors, all as expressions over symbol tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S

# What parts of a name stand for, first match wins in the ladders.
ROLES = [("controller", ("controller",)), ("service", ("service",)), ("repository", ("repository", "dao")), ("model", ("model", "entity")), ("view", ("view", "component")), ("utility", ("util", "helper"))]
MODULE_TYPES = [("test", ("test",)), ("config", ("config",)), ("utility", ("util",)), ("core", ("core",)), ("library", ("lib",))]
DESIGN_PATTERNS = [("factory", ("Factory",)), ("builder", ("Builder",)), ("observer", ("Observer",)), ("strategy", ("Strategy",))]
ANTI_PATTERNS = [("god-object", ("God", "Manager")), ("utility-class", ("Util", "Helper"))]
BUSINESS = ["order", "customer", "product", "payment", "account", "user"]
SIDE_EFFECTS = ["delete", "remove", "clear", "reset", "modify", "update"]
DEPRECATION = ["legacy", "old", "deprecated", "obsolete"]
# Weights of the named features.
WEIGHTS = {
    "text.tokenCount": 0.05, "text.technicalTerms": 0.15, "text.verbPhrases": 0.10, "text.followsNamingConvention": 0.08, "code.cyclomaticComplexity": 0.12, "code.maintainabilityIndex": 0.15, "code.instability": 0.10,
    "code.designPatterns": 0.08, "context.moduleType": 0.07, "context.architecturalRole": 0.10, "usage.totalUsageCount": 0.12, "usage.usageSpread": 0.08, "semantic.purposeClarity": 0.15, "semantic.responsibilityFocus": 0.12, "semantic.businessRelevance": 0.10,
}
#: What no table tells: cohesion of a symbol, and the figures that default to 0 unless the input has a column of the name.
COHESION, UNKNOWN = 0.7, ("fan_in", "usage_count", "usage_spread", "test_coverage")


def has_part(name: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])


def ladder(name: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The label of the first rule one of whose parts the name holds."""
    out = None
    for label, parts in rules:
        hit = has_part(name, parts)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def labels(name: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """All labels whose rule holds."""
    return F.array_compact(F.array(*[F.when(has_part(name, parts), F.lit(label)) for label, parts in rules]))


def symbol_features(symbols: DataFrame) -> DataFrame:
    """Wide features of (key, name, kind, file_path, line_count, dependencies: how many, exported): text, code, context, semantic and composites.

    fan_in, usage_count, usage_spread and test_coverage are taken where the input has them, else 0.
    """
    name, low, c = F.col("name"), F.lower("name"), F.col
    deps, lines, out = c("dependencies"), c("line_count"), c("exported")
    yes = lambda cond, a, b: F.when(cond, a).otherwise(b)
    d = symbols.withColumns({n: F.lit(0) for n in UNKNOWN if n not in symbols.columns})
    d = d.withColumn("tokens", S.identifier_tokens("name")).withColumn("complexity", S.cyclomatic("line_count"))
    d = d.withColumns({"technical": S.technical_terms("tokens"), "domain": S.domain_terms("tokens"), "nouns": S.noun_tokens("tokens"), "verbs": S.verb_tokens("tokens"), "abbreviations": S.abbreviations("tokens"), "naming_ok": S.naming_ok("name", "kind"), "is_acronym": S.is_acronym("name")})
    total = c("fan_in") + deps
    d = d.select(
        *d.columns,
        F.size("tokens").alias("n_tokens"), S.mean_length("tokens").alias("mean_token_length"), name.rlike("[0-9]").alias("has_digit"), yes(total > 0, deps / total, 0.0).alias("instability"),
        S.maintainability("line_count", "complexity").alias("maintainability"), S.technical_debt("line_count").alias("debt"), S.code_smells("line_count", "dependencies").alias("smells"), labels(name, DESIGN_PATTERNS).alias("design_patterns"), labels(name, ANTI_PATTERNS).alias("anti_patterns"),
        ladder(low, ROLES, "unknown").alias("role"), ladder(F.lower("file_path"), MODULE_TYPES, "application").alias("module_type"), F.coalesce(F.nullif(F.element_at(F.split("file_path", "/"), -2), F.lit("")), F.lit("global")).alias("namespace"),
        yes(c("kind").isin("interface", "abstract"), 0.9, F.when(c("kind") == "class", 0.6).when(c("kind") == "function", 0.4).when(c("kind") == "variable", 0.1).otherwise(0.5)).alias("abstraction"),
        yes(F.size("domain") > F.size("technical"), 0.8, 0.3).alias("domain_specificity"), yes(F.exists("tokens", lambda t: t.isin(BUSINESS)), 0.8, 0.2).alias("business_relevance"), S.coupling_degree(deps).alias("coupling"),
        yes(F.size("verbs") > 0, 0.8, 0.4).alias("purpose_clarity"), S.focus(deps, lines).alias("focus"), yes(has_part(low, SIDE_EFFECTS), 0.7, 0.2).alias("side_effect_risk"), yes(has_part(low, DEPRECATION), 0.9, 0.1).alias("deprecation_risk"),
        yes(out, 0.8, 0.3).alias("documentation"), yes(out, 0.8, 0.4).alias("interface_stability"), yes(out, 0.7, 0.9).alias("api_stability"),
    )
    text = S.text_relevance(c("n_tokens"), F.size("technical"), F.size("verbs"), c("naming_ok"), c("is_acronym"))
    relevance = [(text, 0.3), (c("maintainability") / 100, 0.2), (yes(c("module_type") == "core", 0.8, 0.5), 0.2), (F.least(c("usage_count") / 100, F.lit(1.0)), 0.15), (c("purpose_clarity"), 0.15)]
    quality = [(x, 0.2) for x in (c("maintainability") / 100, c("test_coverage"), c("documentation"), F.lit(COHESION), c("focus"))]
    upkeep = [(x, 0.25) for x in (1 - c("complexity") / 20, 1 - c("instability"), F.lit(COHESION), c("purpose_clarity"))]
    risk = [(x, 0.25) for x in (c("debt"), c("side_effect_risk"), c("deprecation_risk"), c("instability"))]
    return d.select("*", S.weighted(relevance).alias("relevance_score"), S.weighted(quality).alias("quality_score"), S.weighted(upkeep).alias("upkeep_score"), S.weighted(risk).alias("risk_score"))


def normalised_features(f: DataFrame) -> DataFrame:
    """key and v: the 17 features of ``symbol_features`` that a model learns from, scaled towards 0..1."""
    c, one = F.col, F.lit(1.0)
    parts = [
        F.least(one, c("n_tokens") / 10), F.size("technical") / 5, F.size("verbs") / 3, c("naming_ok").cast("int"), F.least(one, c("complexity") / 20), c("maintainability") / 100, c("instability"), F.size("design_patterns") / 3,
        F.least(one, c("usage_count") / 100), F.least(one, c("usage_spread") / 10), c("purpose_clarity"), c("focus"), c("business_relevance"), c("relevance_score"), c("quality_score"), c("upkeep_score"), 1 - c("risk_score"),
    ]
    return f.select("key", F.array(*[x.cast("double") for x in parts]).alias("v"))


def feature_vector(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with v: the named columns scaled to 0..1 by their smallest and largest values (one aggregation)."""
    bounds = df.agg(*[F.min(n).alias(f"_lo_{n}") for n in names], *[F.max(n).alias(f"_hi_{n}") for n in names])
    j = df.join(F.broadcast(bounds))
    one = lambda n: F.when(F.col(f"_hi_{n}") > F.col(f"_lo_{n}"), (F.col(n) - F.col(f"_lo_{n}")) / (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).otherwise(0.0)
    return j.select(*df.columns, F.array(*[one(n).cast("double") for n in names]).alias("v"))


def combined_score(semantic: Column, complexity: Column, public: Column, deprecated: Column, usage: Column, cross_file: Column, recent_use: Column, same_file: Column, recent: Column, weights: Sequence[float] = (0.4, 0.2, 0.2, 0.2)) -> Column:
    """struct(score, semantic, structural, contextual, usage) of a candidate for a query."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    points = lambda c, p: F.when(c, p).otherwise(0.0)
    structural = clamp(points(complexity < 5, 0.2) + points(public, 0.3) + F.least(usage / 100, F.lit(0.3)) - points(deprecated, 0.4))
    contextual = points(same_file, 0.4) + points(recent, 0.3)
    used = clamp(F.least(usage / 50, F.lit(0.4)) + F.least(cross_file / 10, F.lit(0.3)) + F.least(recent_use, F.lit(0.3)))
    score = S.weighted(list(zip((semantic, structural, contextual, used), weights, strict=True)))
    return F.struct(score.alias("score"), semantic.alias("semantic"), structural.alias("structural"), contextual.alias("contextual"), used.alias("usage"))


def explanation(parts: Column) -> Column:
    """What speaks for a candidate, joined by ``; ``."""
    rules = [("semantic", 0.7, "High semantic similarity to query"), ("structural", 0.6, "Good structural match (complexity, API status)"), ("contextual", 0.5, "Relevant to current context"), ("usage", 0.6, "Frequently used symbol")]
    return F.concat_ws("; ", *[F.when(parts[n] > t, F.lit(text)) for n, t, text in rules])


def patterns(symbols: DataFrame, relations: DataFrame, descendants: DataFrame, least: float = 0.6) -> DataFrame:
    """type, name, part and confidence of the symbols of each architectural pattern with a confidence of at least ``least``: one row per symbol.

    symbols (name, kind), relations (src, dst, type), descendants (src, n). Singleton 0.7, factory 0.6, observer 0.7,
    strategy 0.8, model-view-controller 0.8 (only where all three parts are there). Names stay rows, so no task gathers a
    pattern.
    """
    low = F.lower("name")
    rel = relations.select(F.col("src").alias("name"), F.lower("dst").alias("dst"), "type")
    per = rel.groupBy("name").agg(F.count("*").alias("n_rel"), F.max((F.col("type") == "contains") & F.contains("dst", F.lit("instance"))).alias("holds_instance"), F.max((F.col("type") == "calls") & F.contains("dst", F.lit("new"))).alias("makes"), F.max(has_part(F.col("dst"), ("notify", "update", "observer"))).alias("notifies"))
    s = symbols.join(per, "name", "left").join(descendants.select(F.col("src").alias("name"), F.col("n").alias("n_below")), "name", "left").fillna(0, ["n_rel", "n_below"]).fillna(False, ["holds_instance", "makes", "notifies"])
    part = ladder(low, [("model", ("model",)), ("view", ("view", "ui")), ("controller", ("controller", "handler"))], "")
    one = lambda df, t, conf, p="": df.select(F.lit(t).alias("type"), "name", (F.lit(p) if isinstance(p, str) else p).alias("part"), F.lit(conf).alias("confidence"))
    found = one(s.where((F.col("kind") == "class") & (F.contains(low, F.lit("singleton")) | F.col("holds_instance"))), "singleton", 0.7)
    found = found.union(one(s.where(F.col("kind").isin("class", "function") & has_part(low, ("factory", "create", "builder")) & (F.col("makes") | (F.col("n_rel") > 2))), "factory", 0.6))
    found = found.union(one(s.where((F.col("n_below") > 2) & has_part(low, ("strategy", "algorithm", "policy"))), "strategy", 0.8))
    found = found.union(one(s.where("notifies"), "observer", 0.7))
    layered = one(s, "mvc", 0.8, part).where("part <> ''")
    whole = layered.agg(F.count_distinct("part").alias("n")).where("n = 3").select(F.lit("mvc").alias("type"))
    return found.union(layered.join(F.broadcast(whole), "type", "left_semi")).where(F.col("confidence") >= least)
