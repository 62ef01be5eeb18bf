"""Leak flags, local paths, forbidden files, scope, commands, redaction and leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import patterns as P
from tracelight.operators.aliases import alias_of, numbered
from tracelight.sources.files import stored


def leak_flags(df: DataFrame, text_col: str = "text") -> DataFrame:
    found = P.flags(F.col(text_col))
    return df.withColumns({**found, "any_leak": P.any_of(found)})


def local_path_leaks(df: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, label, match), each once. One pass over the text for all four patterns."""
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_extract_all(F.col(text_col), F.lit(p), 0).alias("matches")) for label, p in P.HOME_PATTERNS.items()])
    hits = df.filter(F.col(text_col).rlike(r"/home/|/(?i:users)/|\\Users\\")).select(F.col(path_col).alias("path"), F.explode(each).alias("hit"))
    return hits.select("path", "hit.label", F.explode("hit.matches").alias("match")).distinct()


def forbidden_paths(df: DataFrame, path_col: str = "path", exact: dict[str, str] | None = None, globs: dict[str, str] | None = None) -> DataFrame:
    """(path, reason) of files by exact path, and of files at the root by glob."""
    path = F.col(path_col)
    rules = [F.when(path == p, reason) for p, reason in (exact or P.FORBIDDEN_PATHS).items()]
    rules += [F.when(~path.contains("/") & path.rlike(P.glob_regex(g)), reason) for g, reason in (globs or P.FORBIDDEN_GLOBS).items()]
    return df.select(path.alias("path"), F.explode(F.array_compact(F.array(*rules))).alias("reason")).distinct()


def hygiene_violations(df: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Both kinds of violation as one set of (path, label, match)."""
    files = forbidden_paths(df, path_col).select("path", F.lit("forbidden path").alias("label"), F.col("reason").alias("match"))
    return files.unionByName(local_path_leaks(df, path_col, text_col)).distinct()


def hygiene_verdict(violations: DataFrame) -> DataFrame:
    """(label, violations, paths, verdict): one row for each label and one for all."""
    return violations.distinct().rollup("label").agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("path").alias("paths")).select(
        F.coalesce("label", F.lit("ALL")).alias("label"), "violations", "paths", F.when(F.col("violations") > 0, "fail").otherwise("pass").alias("verdict"))


def scope_label(path: Column, boundaries: list[tuple[str, str]]) -> Column:
    """Kind of the longest root that holds the path, or approval_needed."""
    out = F
    for kind, root in sorted(boundaries, key=lambda b: -len(b[1])):
        out = out.when((path == root) | path.startswith(root.rstrip("/") + "/"), kind)
    return out.otherwise("approval_needed") if out is not F else F.lit("approval_needed")


def scope_violations(df: DataFrame, boundaries: list[tuple[str, str]], path_col: str = "path") -> DataFrame:
    """The rows whose path lies under no root: each needs approval."""
    return scope_check(df, boundaries, path_col).filter(F.col("scope") == "approval_needed")


def scope_check(df: DataFrame, boundaries: list[tuple[str, str]], path_col: str = "path") -> DataFrame:
    """Add scope. The roots are a handful of literals, so no join is needed."""
    return df.withColumn("scope", scope_label(F.col(path_col), boundaries))


def unsafe_command_flags(df: DataFrame, command_col: str = "command") -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.contains(F.col(command_col), F.lit(t)), t) for t in P.UNSAFE_TOKENS]))
    return df.withColumn("unsafe", found)


def command_policy(df: DataFrame, rules: list[tuple[str, str]], command_col: str = "command") -> DataFrame:
    """Add action and pattern: a matching deny wins, then the longest pattern; else ask."""
    ordered = sorted(rules, key=lambda r: (r[1] != "deny", -len(r[0]), r[0]))
    action, pattern = F, F
    for glob, act in ordered:
        hit = F.col(command_col).rlike(P.glob_regex(glob))
        action, pattern = action.when(hit, act), pattern.when(hit, glob)
    if not ordered:
        return df.withColumns({"action": F.lit("ask"), "pattern": F.lit("*")})
    return df.withColumns({"action": action.otherwise("ask"), "pattern": pattern.otherwise("*")})


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace identifiers by placeholders and count them: n_<class> and n_placeholder (those
    that the text already had). One step for each class; texts without a word that its matches
    hold are passed over. No match holds a placeholder, so the new ones are the class's count."""
    zero, text = F.lit(0).cast("long"), F.col(text_col)
    had = F.when(P.holds_any(text, P.PLACEHOLDER_HINTS), F.regexp_count(text, F.lit(P.PLACEHOLDERS)).cast("long")).otherwise(zero)
    out = df.withColumns({"n_placeholder": had, "redacted": text})
    for name, hints, any_case, pattern, mark in P.REDACTIONS:
        hit = P.holds_any(F.lower("redacted") if any_case else F.col("redacted"), hints)
        out = out.withColumn("__new", F.when(hit, F.regexp_replace("redacted", pattern, mark)).otherwise(F.col("redacted")))
        count = F.when(F.col("__new") != F.col("redacted"), P.occurrences(F.col("__new"), mark) - P.occurrences(F.col("redacted"), mark)).otherwise(zero)
        out = out.withColumns({f"n_{name}": count, "redacted": F.col("__new")}).drop("__new")
    return out


def release_decision(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """ready, ready with noted placeholders or blocked, for each document and, under a null key,
    for the corpus. Rows without a key count for the corpus only. Names of a table (n_names), where
    they were looked for, are identifiers too."""
    classes = [name for name, *_ in P.REDACTIONS] + [c for c in ("names",) if "n_names" in redacted.columns]
    real = sum((F.col(f"n_{name}") for name in classes), F.lit(0))
    per = redacted.rollup(key).agg(F.sum(real).alias("identifiers"), F.sum("n_placeholder").alias("placeholders"), F.grouping(key).alias("__all"))
    per = per.filter(F.col(key).isNotNull() | (F.col("__all") == 1)).drop("__all")
    return per.withColumn("decision", F.when(F.col("identifiers") > 0, "blocked").when(F.col("placeholders") > 0, "ready with noted placeholders").otherwise("ready"))


#: Counters of each class, and how many of the fullest are looked into first for each value asked for.
COUNTERS, LOOKED = 65_536, 4


def feature_values(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, class, value): each feature of each text. A pattern is tried where a text holds what all
    its matches hold."""
    text = F.col(text_col)
    found = lambda c: F.when(P.holds_any(text, P.FEATURE_HINTS[c]), F.regexp_extract_all(text, F.lit(P.FEATURES[c]), F.lit(0)))
    each = F.array(*[F.struct(F.lit(c).alias("class"), found(c).alias("values")) for c in P.FEATURES])
    return df.select(F.col(id_col).alias("id"), F.explode(each).alias("f")).select("id", "f.class", F.explode("f.values").alias("value"))


def feature_histogram(df: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """(class, value, documents, hits, rank): the k commonest values of each class.

    Values are first counted by hash in a fixed number of counters for each class, which add up
    before and between tasks. No value is commoner than its counter is full, so the fullest
    counters name candidates, which are counted one by one. Where their k-th count is above all
    other counters, it is proven that none else belongs there; elsewhere all counters as full as
    the k-th count are looked into, at worst all of them."""
    values = stored(df.sparkSession, feature_values(df, text_col, id_col).withColumn("counter", F.pmod(F.xxhash64("value"), F.lit(counters))))
    full = stored(df.sparkSession, values.groupBy("class", "counter").agg(F.count(F.lit(1)).alias("held")))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("held"), "counter"))
    looked = full.withColumn("place", place)
    first = looked.filter(F.col("place") <= LOOKED * k)

    def counted(chosen: DataFrame) -> DataFrame:
        """The first k of each class among the values of the chosen counters."""
        counts = values.join(chosen.select("class", "counter"), ["class", "counter"]).groupBy("class", "value").agg(F.count(F.lit(1)).alias("hits"))
        order = Window.partitionBy("class").orderBy(F.desc("hits"), "value")
        return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    best = stored(df.sparkSession, counted(F.broadcast(first)))  # LOOKED * k counters of each class
    least = best.groupBy("class").agg(F.when(F.count(F.lit(1)) >= k, F.min("hits")).otherwise(0).alias("least"))
    # counters not looked into that may hold a value of the first k; equal counts may, by order of value
    open_ = looked.filter(F.col("place") > LOOKED * k).join(F.broadcast(least), "class").filter(F.col("held") >= F.col("least"))
    again = open_.select("class").distinct()
    if not again.isEmpty():
        more = full.join(F.broadcast(least), "class").filter(F.col("held") >= F.col("least"))
        best = best.join(again, "class", "left_anti").unionByName(counted(more.join(again, "class", "left_semi")))
        best = stored(df.sparkSession, best)
    # k rows of each class
    documents = values.join(F.broadcast(best), ["class", "value"]).groupBy("class", "value", "hits", "rank", "id").agg(F.lit(1).alias("one"))
    return documents.groupBy("class", "value", "hits", "rank").agg(F.count(F.lit(1)).alias("documents")).select("class", "value", "documents", "hits", F.col("rank").cast("long").alias("rank"))


def secret_leads(df: DataFrame, text_col: str = "text", source_col: str = "source", salt: str = "", in_scope: Column | None = None, forms: tuple[tuple[str, str, str], ...] = P.SECRETS + P.MORE_SECRETS) -> DataFrame:
    """Leads by fingerprint, each with its next action: the value itself is hashed, with the salt,
    where it is found. forms are the patterns looked for, all by default."""
    each = F.array(*[
        F.struct(F.lit(kind).alias("secret_type"), F.lit(service).alias("service"), F.transform(F.regexp_extract_all(F.col(text_col), F.lit(p), 1), lambda v: F.sha2(F.concat(F.lit(salt), v), 256)).alias("prints"))
        for kind, service, p in forms])
    found = df.select(F.col(source_col).alias("source"), F.explode(each).alias("s")).select("source", "s.secret_type", "s.service", F.explode("s.prints").alias("fingerprint"))
    leads = found.groupBy("fingerprint", "secret_type", "service").agg(F.count(F.lit(1)).alias("sightings"), F.count_distinct("source").alias("sources"), F.min("source").alias("source_artifact"))
    use = F.when(F.col("service") == "cloud", "remote").otherwise("local")
    leads = leads.withColumn("use", use).withColumn("confidence", F.when(F.col("sightings") > 1, "moderate").otherwise("low"))
    return lead_next_action(leads, in_scope)


def lead_next_action(leads: DataFrame, in_scope: Column | None = None) -> DataFrame:
    """Add next_action: proceed in scope for local leads in scope, else approval needed."""
    scope = F.lit(True) if in_scope is None else in_scope
    return leads.withColumn("next_action", F.when((F.col("use") == "local") & scope, "proceed in scope").otherwise("approval needed"))


def alias_ids(df: DataFrame, column: str, prefix: str, digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(df with <column>_alias in place of column, the map). Aliases number the distinct ids in
    order of their text; aliases.stable_aliases() keeps them for the next time."""
    table = numbered(df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("id")).distinct()).select("id", alias_of(F.col("n"), prefix, digits).alias("alias"))
    out = df.withColumn("__id", F.col(column).cast("string")).join(table.withColumnRenamed("id", "__id"), "__id", "left").drop("__id", column).withColumnRenamed("alias", f"{column}_alias")
    return out, table
