"""Inventories, manifests, routes, findings and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify_hashes(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """inventory (item_id, sha256) against manifest (item_id, expected): item_id, status."""
    both = inventory.select("item_id", "sha256", F.lit(True).alias("here")).join(manifest.select("item_id", "expected", F.lit(True).alias("listed")), "item_id", "full")
    status = F.when(F.col("here").isNull(), "missing").when(F.col("listed").isNull(), "unexpected").when(F.lower("sha256").eqNullSafe(F.lower("expected")), "match").otherwise("mismatch")
    return both.select("item_id", status.alias("status"))


def hash_summary(verified: DataFrame) -> DataFrame:
    """(status, items) for each of the four states, also for those that no item is in, and for all."""
    count = lambda s: F.struct(F.lit(s).alias("status"), F.count_if(F.col("status") == s).alias("items"))
    each = [count(s) for s in ("match", "mismatch", "missing", "unexpected")] + [F.struct(F.lit("all").alias("status"), F.count(F.lit(1)).alias("items"))]
    return verified.agg(F.array(*each).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def derived_provenance(derived: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("source_image", "source_hash", "artifact_path", "tool", "version", "command")) -> DataFrame:
    """artifact_id, missing (names of absent fields), source_known."""
    known = sources.select(F.col("sha256").alias("source_hash")).distinct().withColumn("known", F.lit(True))
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f) == ""), f) for f in fields]))
    return derived.withColumn("missing", missing).join(known, "source_hash", "left").select("artifact_id", "missing", F.coalesce("known", F.lit(False)).alias("source_known"))


def required_fields_check(df: DataFrame, required: tuple[str, ...], key: str) -> DataFrame:
    """Rows that lack required fields: key, missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), c) for c in required]))
    return df.select(key, missing.alias("missing")).filter(F.size("missing") > 0)


#: Name patterns that vote, of each name the first that fits: for an operating system, for the
#: mode of the evidence, for the role of its host.
PLATFORM_RULES = (("windows", r"(?i)\.evtx$|\.lnk$|bitlocker|\.xlsx$"), ("macos", r"(?i)\.plist$|\.sqlite$"), ("linux", r"(?i)\.journal$|\.zip$"))
MODE_RULES = (("dead-box image", r"(?i)\.e01$|\.vmdk$"), ("live host", r"(?i)/live/|\.pslist$"), ("mounted filesystem", r"^/mnt/"), ("logical export", r"(?i)/export/"))
ROLE_RULES = (("domain controller", r"(?i)ntds\.dit$|/sysvol/"), ("server", r"(?i)/var/www/|/inetpub/"), ("container host", r"(?i)/docker/|/containerd/"), ("developer workstation", r"(?i)/\.git/"))


def vote_of(path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = F
    for name, pattern in rules:
        out = out.when(path.rlike(pattern), name)
    return out


def platform_profile(artifacts: DataFrame) -> DataFrame:
    """evidence_id, os, mode, role, discovery_needed. The most votes of artifact names win the
    operating system and the role; a tie, or no vote, is unknown. A name that speaks for a mode (an
    E01 file: a dead-box image) decides it, unless another contradicts. One grouping: each rule is
    a count."""
    kinds = {"os": PLATFORM_RULES, "mode": MODE_RULES, "role": ROLE_RULES}
    votes = artifacts.select("evidence_id", *[vote_of(F.col("path"), rules).alias(k) for k, rules in kinds.items()])
    tally = lambda k: F.array(*[F.struct(F.count_if(F.col(k) == name).alias("n"), F.lit(name).alias("name")) for name, _ in kinds[k]])
    per = votes.groupBy("evidence_id").agg(*[tally(k).alias(f"{k}_votes") for k in kinds])

    def winner(k: str, most: bool) -> Column:
        best = F.array_max(F.transform(f"{k}_votes", lambda v: v["n"]))
        lead = F.filter(f"{k}_votes", lambda v: (v["n"] > 0) & ((v["n"] == best) | F.lit(not most)))
        return F.when(F.size(lead) == 1, lead[0]["name"]).otherwise("unknown")

    os = winner("os", True)
    return per.select("evidence_id", os.alias("os"), winner("mode", False).alias("mode"), winner("role", True).alias("role"), (os == "unknown").alias("discovery_needed"))


def route_artifacts(artifacts: DataFrame, profiles: DataFrame, lanes: list[tuple[str, str, str, bool]], triage: bool) -> DataFrame:
    """artifact_id, lane. lanes (name, platform, path pattern, priority) are a short list of
    literals; a lane takes artifacts of its own platform only, triage keeps priority lanes. What no
    lane takes is deferred, and so is an artifact whose evidence is unknown or has no profile."""
    kept = [lane for lane in lanes if lane[3] or not triage]
    hits = F.array_compact(F.array(*[F.when((F.col("os") == platform) & F.col("path").rlike(pattern), name) for name, platform, pattern, _ in kept]))
    return artifacts.join(profiles.select("evidence_id", "os"), "evidence_id", "left").select("artifact_id", F.explode_outer(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("deferred")))).alias("lane"))


def lane_report(artifacts: DataFrame, profiles: DataFrame, lanes: list[tuple[str, str, str, bool]], triage: bool) -> DataFrame:
    """(evidence_id, lane, artifacts, status): each lane of an evidence's platform. routed, deferred
    by depth (it has artifacts, but triage keeps priority lanes only), nothing to route; evidence of
    an unknown platform, or without a profile, has every lane blocked. Artifacts of no evidence
    are left out. One grouping: each lane is a count."""
    fits = [F.count_if(F.col("path").rlike(pattern)).alias(f"l{i}") for i, (_, _, pattern, _) in enumerate(lanes)]
    per = artifacts.filter(F.col("evidence_id").isNotNull()).groupBy("evidence_id").agg(*fits).join(profiles.select("evidence_id", "os"), "evidence_id", "left")
    known = F.coalesce(F.col("os"), F.lit("unknown")) != "unknown"

    def row(i: int) -> Column:
        name, platform, _, priority = lanes[i]
        status = F.when(~known, "blocked").when(F.col(f"l{i}") == 0, "nothing to route").otherwise("routed" if priority or not triage else "deferred by depth")
        return F.when(~known | (F.col("os") == platform), F.struct(F.lit(name).alias("lane"), F.when(known, F.col(f"l{i}")).otherwise(0).alias("artifacts"), status.alias("status")))

    return per.select("evidence_id", F.explode(F.array_compact(F.array(*[row(i) for i in range(len(lanes))]))).alias("r")).select("evidence_id", "r.*")


def finding_support(findings: DataFrame, citations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """finding_id, artifacts, sources, status: supported by two sources or more, challenged with
    one, missing corroboration with none that exists."""
    cited = citations.join(artifacts.select("artifact_id", "source"), "artifact_id")
    per = cited.groupBy("finding_id").agg(F.count_distinct("artifact_id").alias("artifacts"), F.count_distinct("source").alias("sources"))
    sources = F.coalesce("sources", F.lit(0)).cast("long")
    status = F.when(sources >= 2, "supported").when(sources == 1, "challenged").otherwise("missing corroboration")
    return findings.select("finding_id").join(per, "finding_id", "left").select("finding_id", F.coalesce("artifacts", F.lit(0)).cast("long").alias("artifacts"), sources.alias("sources"), status.alias("status"))


def coverage_matrix(evidence: DataFrame, layers: list[tuple[str, str]], attempts: DataFrame) -> DataFrame:
    """evidence (evidence_id, os) by layer: done, attempted-unsuccessful, not attempted or not
    possible. layers (name, platform or any) are a short list of literals."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(p).alias("platform")) for n, p in layers]))
    grid = evidence.select("evidence_id", "os", each.alias("l")).select("evidence_id", "os", "l.layer", "l.platform")
    tried = attempts.groupBy("evidence_id", "layer").agg(F.max("success").alias("success"))
    state = F.when(~F.col("platform").isin("any") & (F.col("platform") != F.col("os")), "not possible").when(F.col("success").isNull(), "not attempted").when(F.col("success"), "done").otherwise("attempted-unsuccessful")
    return grid.join(tried, ["evidence_id", "layer"], "left").select("evidence_id", "layer", state.alias("state"))
