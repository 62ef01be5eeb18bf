"""Roots, permission rules and detection rules that are tables: found by equi joins on what a path
or text must hold, however many they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.operators.aliases import sieve_of, sieved
from tracelight.sources.files import stored

#: Texts of at most so many characters are cut into runs from their start each time, longer ones from a list of letters.
SHORT = 512

#: Lengths of the literal runs by which globs are found; a glob takes the greatest that it holds.
RUNS = (8, 4, 2, 1)

#: So many runs at most are looked for one by one, more by all runs of a text.
FEW = 64


def scope_by_roots(df: DataFrame, roots: DataFrame, path_col: str = "path") -> DataFrame:
    """Add scope: the kind of the longest of roots (kind, root) that holds the path, else
    approval_needed. Each path once meets the roots by its ancestors and itself; of equal roots
    the least kind counts. A closing slash of a root is no matter; null paths need approval."""
    table = roots.filter(F.col("root").isNotNull()).groupBy(F.rtrim(F.col("root"), F.lit("/")).alias("root")).agg(F.min("kind").alias("kind"))
    path = F.col(path_col)
    parts = F.split("__path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    paths = df.filter(path.isNotNull()).select(path.alias("__path")).distinct().select("__path", F.explode(ancestors).alias("root"))
    found = paths.join(table, "root").groupBy("__path").agg(F.max_by("kind", F.length("root")).alias("__kind"))
    return df.join(found, path == F.col("__path"), "left").withColumn("scope", F.coalesce("__kind", F.lit("approval_needed"))).drop("__path", "__kind")


# --- globs ------------------------------------------------------------------------------------


def glob_pattern(glob: Column) -> Column:
    """The pattern of a glob column: * is any text, ? one character, all else itself."""
    plain = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def _runs(text: Column, size: int) -> Column:
    """All runs of `size` characters of a text."""
    letters = F.split(text, "")
    n = F.length(text) - size + 1
    starts = F.sequence(F.lit(1), n)
    cut = F.when(F.length(text) <= SHORT, F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(n > 0, cut.otherwise(F.transform(starts, lambda i: F.array_join(F.slice(letters, i, F.lit(size)), "")))).otherwise(F.array().cast("array<string>"))


def glob_keys(glob: Column) -> Column:
    """The runs that a text must hold for a glob to fit it, of the greatest length in RUNS that the
    glob has; one empty run for a glob of * and ? alone."""
    parts = F.split(glob, r"[*?]+")
    longest = F.array_max(F.transform(parts, F.length))
    out = F
    for size in RUNS:
        out = out.when(longest >= size, F.array_distinct(F.flatten(F.transform(parts, lambda p: _runs(p, size)))))
    return out.otherwise(F.array(F.lit("")))


def text_keys(text: Column, sizes: list[int]) -> Column:
    """What a text holds of runs of these sizes; 0 is the empty run that each holds."""
    return F.array_distinct(F.concat(*[F.array(F.lit("")) if size == 0 else _runs(text, size) for size in sizes])) if sizes else F.array().cast("array<string>")


def rarest(keyed: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """keyed (rule, keys ..) with one row for each rule: the key that fewest rules hold."""
    common = keyed.groupBy(*keys).agg(F.count_distinct(rule).alias("__rules"))
    order = Window.partitionBy(rule).orderBy("__rules", *[F.desc(F.length(k)) for k in keys], *keys)
    return keyed.join(common.hint("merge"), keys).withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at", "__rules")


def sizes_of(index: DataFrame, key: str) -> list[int]:
    """The lengths of the keys in use: five values at most."""
    return sorted(r[0] for r in index.select(F.length(key)).distinct().collect())


def policy_by_rules(df: DataFrame, rules: DataFrame, command_col: str = "command") -> DataFrame:
    """Add action and pattern by rules (pattern, action): of the globs that fit, a deny wins, then
    the longest, then the least; else ask and *. Each command once meets the rules by the runs of
    characters that it holds; a rule is met by the one of its runs that fewest other rules hold, and
    only what meets is matched. Runs that no rule asks for stay behind a sieve of bits. Globs without a character of their own, such as ??*, meet every
    command; of those alike in least length and end only the first by rank is kept. Rules with a
    null are none; a null command asks."""
    rank = F.struct((F.col("action") != "deny").alias("mild"), (-F.length("pattern")).alias("short"), "pattern", "action")
    table = rules.filter(F.col("pattern").isNotNull() & F.col("action").isNotNull()).distinct().withColumn("rank", rank)
    bare = F.regexp_replace("pattern", r"[*?]", "") == ""
    shape = [F.length(F.replace("pattern", F.lit("*"), F.lit(""))).alias("least"), F.contains("pattern", F.lit("*")).alias("open")]
    fits = glob_pattern(F.col("rank.pattern")).alias("fits")
    # two rules for each length of such a glob at most
    open_rules = table.filter(bare).groupBy(*shape).agg(F.min("rank").alias("rank")).select(F.regexp_replace("rank.pattern", r"[*?]", "").alias("key"), "rank", fits)
    table = stored(df.sparkSession, table.filter(~bare).select("rank", "pattern"))
    index = stored(df.sparkSession, rarest(table.select("pattern", F.explode(glob_keys(F.col("pattern"))).alias("key")).distinct(), "pattern", ["key"]))
    # rules and commands are as many as there are: neither is drawn together on the driver
    held = index.join(table.hint("merge"), "pattern").select("key", "rank", fits)
    sieve = stored(df.sparkSession, sieve_of(index.select("key")))
    command = F.col(command_col)
    asked = df.filter(command.isNotNull()).select(command.alias("__command")).distinct()
    runs = sieved(asked.select("__command", F.explode(text_keys(F.col("__command"), sizes_of(index, "key"))).alias("key")), sieve, "key")
    met = runs.join(held.hint("merge"), "key").unionByName(asked.select("__command", F.explode(text_keys(F.col("__command"), [0])).alias("key")).join(F.broadcast(open_rules), "key"))
    best = met.filter(F.rlike("__command", F.col("fits"))).groupBy("__command").agg(F.min("rank").alias("__rank"))
    out = df.join(best.hint("merge"), command == F.col("__command"), "left")
    return out.withColumns({"action": F.coalesce("__rank.action", F.lit("ask")), "pattern": F.coalesce("__rank.pattern", F.lit("*"))}).drop("__command", "__rank")


# --- detection --------------------------------------------------------------------------------


def _holds(word: Column, values: Column) -> Column:
    value = F.element_at(values, word["field"])
    # patterns of a column are made anew for each row: only where all pieces are there
    fits = F.forall(word["pieces"], lambda p: F.contains(value, p)) & F.rlike(value, word["fits"])
    return F.coalesce(F.when(word["op"] == "eq", value == word["value"]).otherwise(fits), F.lit(False))


def _number(field: str) -> str:
    return f"__number_{field}"


def _bodies(rules: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(rule, part, body, words, bounds): what the rules that can hold ask for. words are their eq and
    glob conditions, which part names; bounds are those of at_least; body names both together."""
    bound = F.col("value").try_cast("double")
    can = F.col("field").isin(*fields) & F.col("value").isNotNull() & (F.col("op").isin("eq", "glob") | (F.col("op") == "at_least") & bound.isNotNull())
    # by number, so that rules are not drawn together into a few tasks
    dealt = rules.filter(F.col("rule").isNotNull()).repartition(int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rule")
    table = dealt.groupBy("rule").agg(
        F.min(F.coalesce(can, F.lit(False))).alias("can"),
        F.array_sort(F.collect_set(F.when(F.col("op") != "at_least", F.struct("field", "op", "value")))).alias("words"),
        F.array_sort(F.collect_set(F.when(F.col("op") == "at_least", F.struct("field", bound.alias("bound"))))).alias("bounds"))
    named = lambda *c: F.unhex(F.sha2(F.to_json(F.struct(*c)), 256))
    return stored(rules.sparkSession, table.filter("can").select("rule", named("words").alias("part"), named("words", "bounds").alias("body"), "words", "bounds"))


def _part_hits(events: DataFrame, bodies: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """(keep .., part, numbers ..) for each event that fits a part's words, with the event's numbers in the
    fields that the part's bodies have bounds for. A part is met by one of the values, or runs of
    characters, that it asks for, the one that fewest parts ask for; what events hold of them passes a
    sieve of bits first. A part of no words, or of globs of * and ? alone, is looked at for every event."""
    spark = events.sparkSession
    measured = F.array_distinct(F.flatten(F.collect_set(F.transform("bounds", lambda b: b["field"]))))
    pieces = lambda w: F.filter(F.split(w["value"], r"[*?]+"), lambda p: p != "")
    fits = F.transform("words", lambda w: F.struct(w["field"].alias("field"), w["op"].alias("op"), w["value"].alias("value"), pieces(w).alias("pieces"), F.when(w["op"] == "glob", glob_pattern(w["value"])).alias("fits")))
    parts = bodies.groupBy("part").agg(F.first("words").alias("words"), measured.alias("measured")).withColumn("words", fits)
    parts = stored(spark, parts)
    # of a word, its field, and the length of a run in a glob, 0 where it is a whole value
    word = parts.select("part", F.explode("words").alias("w")).select("part", "w.*")
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("field")).cast("string")
    asked = word.filter("op = 'eq'").select("part", "field", F.lit(0).alias("size"), F.concat(place, F.lit("="), "value").alias("key"))
    runs = word.filter("op = 'glob'").select("part", "field", F.explode(glob_keys(F.col("value"))).alias("run")).filter("run != ''")
    asked = asked.unionByName(runs.select("part", "field", F.length("run").alias("size"), F.concat(place, F.lit("~"), "run").alias("key"))).distinct()
    index = stored(spark, rarest(asked, "part", ["key"]).join(parts, "part"))
    # five lengths for each field at most, and runs where they are few
    sizes: dict[str, set[int]] = {}
    for r in index.select("field", "size").distinct().collect():
        sizes.setdefault(r["field"], set()).add(r["size"])
    runs = [r["key"] for r in index.filter("size > 0").select("key").distinct().limit(FEW + 1).collect()]
    text = {f: F.col(f).cast("string") for f in fields}
    values = F.create_map(*[x for f in fields for x in (F.lit(f), text[f])])
    numbers = [text[f].try_cast("double").alias(_number(f)) for f in fields]
    held = []
    for f, lengths in sorted(sizes.items()):
        sign = str(fields.index(f) + 1)
        own = [F.array(F.concat(F.lit(sign + "="), text[f]))] if 0 in lengths else []
        if lengths - {0} and len(runs) <= FEW:
            own.append(F.array_compact(F.array(*[F.when(F.contains(text[f], F.lit(k[len(sign) + 1 :])), F.lit(k)) for k in runs if k.startswith(sign + "~")])))
        elif lengths - {0}:
            own.append(F.transform(text_keys(text[f], sorted(lengths - {0})), lambda k: F.concat(F.lit(sign + "~"), k)))  # noqa: B023
        held.append(F.when(text[f].isNotNull(), F.concat(*own)).otherwise(F.array().cast("array<string>")))
    told = [*keep, "__values", *map(_number, fields)]
    met = []
    if held:
        places = events.select(*keep, values.alias("__values"), *numbers, F.explode(F.concat(*held)).alias("key"))
        met.append(sieved(places, stored(spark, sieve_of(index.select("key"))), "key").join(index.select("key", "part", "words", "measured"), "key"))
    weak = stored(spark, parts.join(index.select("part"), "part", "left_anti").withColumn("key", F.lit("")))
    if not held or not weak.isEmpty():
        # as many as there are sets of such globs
        every = events.select(*keep, values.alias("__values"), *numbers, F.explode(text_keys(F.lit(""), [0])).alias("key"))
        met.append(every.join(F.broadcast(weak), "key"))
    met = [m.filter(F.forall("words", lambda w: _holds(w, F.col("__values")))).select(*told, "part", "measured") for m in met]
    hits = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    return hits.select(*keep, "part", *[F.when(F.array_contains("measured", f), F.col(_number(f))).alias(_number(f)) for f in fields])


def _within(hits: DataFrame, bodies: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """hits of parts, once for each body of the part whose bounds their numbers reach."""
    numbers = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(_number(f)))])
    met = hits.join(bodies.select("part", "body", "bounds").distinct(), "part")
    return met.filter(F.forall("bounds", lambda b: F.coalesce(F.element_at(numbers, b["field"]) >= b["bound"], F.lit(False)))).drop("part", "bounds", *map(_number, fields))


def rule_hits(events: DataFrame, rules: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """(keep .., rule) for each event that meets all conditions of a rule. rules (rule, field, op,
    value): op is eq, glob or at_least (as numbers). Rules that ask for the same are looked at once,
    and those that differ in their bounds alone are first met by their other conditions, together.
    Conditions on other fields, of other kinds or with nulls never hold."""
    bodies = _bodies(rules, fields)
    return _within(_part_hits(events, bodies, fields, keep), bodies, fields).join(bodies.select("rule", "body"), "body").select(*keep, "rule")


def match_rule_table(events: DataFrame, rules: DataFrame, minutes: int, least: int, fields: tuple[str, ...] = ("actor", "host", "source", "path")) -> DataFrame:
    """(rule, actor, window_start, hits) of an actor's windows in which a rule has the least hits.
    Hits are counted for what rules ask for, and by the numbers that bounds look at, before rules
    are told: no row is made for an event and a rule."""
    timed = events.withColumn("__ts", F.col("ts").cast("timestamp"))
    bodies = _bodies(rules, fields)
    # actor may be a field as well
    hits = _part_hits(timed.withColumn("__actor", F.col("actor")), bodies, fields, ("__actor", "__ts"))
    counted = hits.groupBy("part", "__actor", F.window("__ts", f"{minutes} minutes").alias("w"), *map(_number, fields)).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("part", "__actor", F.col("w.start").alias("window_start"), "n", *map(_number, fields))
    found = _within(counted, bodies, fields).groupBy("body", "__actor", "window_start").agg(F.sum("n").alias("hits")).filter(F.col("hits") >= least)
    return found.join(bodies.select("rule", "body"), "body").select("rule", F.col("__actor").alias("actor"), "window_start", "hits")
