"""Queries over inherited policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import policy as p
from deltaloom.sources import model

from .registry import query

_H = """
, h AS (SELECT w.workload, w.quota, w.project, p.org, p.project * 400 AS p_quota, p.org * 3000 AS o_quota,
  CASE WHEN p.org % 2 = 0 THEN ['HIPAA', 'EU'] ELSE ['EU'] END AS o_tags, CASE WHEN p.project % 3 = 0 THEN ['GxP', 'EU'] ELSE ['PCI'] END AS p_tags, CASE WHEN w.workload % 4 = 0 THEN ['EU', 'lab'] ELSE ['lab'] END AS w_tags,
  CASE WHEN p.project % 3 = 0 THEN ['organic', 'pinned'] WHEN p.project % 3 = 1 THEN ['pinned'] ELSE []::VARCHAR[] END AS modes
  FROM workload w JOIN project p ON w.project = p.project)
"""


def _h(spark, d):
    """The hierarchy with tags, quotas and modes; projects and orgs are the small sides, by size."""
    rows = model.workloads(spark, d).join(model.projects(spark, d), "project")
    a = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    return rows.select(
        "workload", "quota", "project", "org", (F.col("project") * 400).alias("p_quota"), (F.col("org") * 3000).alias("o_quota"),
        F.when(F.col("org") % 2 == 0, a("HIPAA", "EU")).otherwise(a("EU")).alias("o_tags"), F.when(F.col("project") % 3 == 0, a("GxP", "EU")).otherwise(a("PCI")).alias("p_tags"),
        F.when(F.col("workload") % 4 == 0, a("EU", "lab")).otherwise(a("lab")).alias("w_tags"),
        F.when(F.col("project") % 3 == 0, a("organic", "pinned")).when(F.col("project") % 3 == 1, a("pinned")).otherwise(none).alias("modes"),
    )


def _tags():
    return F.col("o_tags"), F.col("p_tags"), F.col("w_tags")


@query(_H + ", c AS (SELECT workload, list_concat(list_concat(o_tags, p_tags), w_tags) AS t FROM h) SELECT workload, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS tags FROM c")
def effective_tags(spark, d):
    return _h(spark, d).select("workload", F.array_join(p.effective_tags(*_tags()), ",").alias("tags"))


@query(_H + "SELECT workload, array_to_string(list_filter(w_tags, lambda x: list_contains(p_tags, x) AND list_contains(o_tags, x)), ',') AS profiles FROM h")
def effective_profiles(spark, d):
    return _h(spark, d).select("workload", F.array_join(p.effective_profiles(*_tags()), ",").alias("profiles"))


@query(_H + "SELECT workload, array_to_string(list_filter(w_tags, lambda x: NOT list_contains(p_tags, x)), ',') AS excess, len(list_filter(w_tags, lambda x: NOT list_contains(p_tags, x))) > 0 AS rejected FROM h")
def profile_violations(spark, d):
    more = p.excess(F.col("w_tags"), F.col("p_tags"))
    return _h(spark, d).select("workload", F.array_join(more, ",").alias("excess"), (F.size(more) > 0).alias("rejected"))


@query(_H + "SELECT workload, NOT list_contains(modes, 'pinned') AS rejected FROM h")
def cache_mode_violations(spark, d):
    return _h(spark, d).select("workload", (F.size(p.excess(F.array(F.lit("pinned")), F.col("modes"))) > 0).alias("rejected"))


@query(_H + "SELECT workload, CASE WHEN quota > p_quota THEN 'project' WHEN quota > o_quota THEN 'org' END AS violation FROM h")
def quota_violations(spark, d):
    return _h(spark, d).select("workload", p.first_violation({"project": (F.col("quota"), F.col("p_quota")), "org": (F.col("quota"), F.col("o_quota"))}).alias("violation"))


@query(_H + "SELECT workload, CASE WHEN quota % 10 > project % 10 THEN 'hints_per_sec' WHEN quota % 7 > org THEN 'workflows' WHEN workload % 11 > 9 THEN 'phases' END AS violation FROM h")
def budget_violations(spark, d):
    q = F.col("quota")
    fields = {"hints_per_sec": (q % 10, F.col("project") % 10), "workflows": (q % 7, F.col("org")), "phases": (F.col("workload") % 11, F.lit(9))}
    return _h(spark, d).select("workload", p.first_violation(fields).alias("violation"))


@query(_H + "SELECT workload, CASE WHEN quota // 100 > p_quota // 80 THEN 'bytes' WHEN quota % 100 > 90 THEN 'ops' END AS violation FROM h")
def ceiling_violations(spark, d):
    q = F.col("quota")
    fields = {"bytes": (F.expr("quota div 100"), F.expr("p_quota div 80")), "ops": (q % 100, F.lit(90))}
    return _h(spark, d).select("workload", p.first_violation(fields).alias("violation"))


@query(_H + "SELECT workload, greatest(quota, CASE WHEN list_contains(o_tags, 'HIPAA') THEN 2000 ELSE 0 END)::BIGINT AS staleness_ms FROM h")
def effective_staleness(spark, d):
    return _h(spark, d).select("workload", p.effective_staleness(F.col("quota"), F.col("o_tags")).alias("staleness_ms"))


@query(_H + "SELECT workload, NOT list_contains(o_tags, 'HIPAA') AS allowed FROM h")
def compression_allowed(spark, d):
    return _h(spark, d).select("workload", p.compression_allowed(F.col("o_tags")).alias("allowed"))


_CLAMP = "CASE WHEN list_contains(modes, {r}) THEN {r} WHEN list_contains(modes, 'organic') THEN 'organic' WHEN len(modes) > 0 THEN modes[1] ELSE 'bypass' END"


@query(_H + ", r AS (SELECT *, CASE WHEN workload % 2 = 0 THEN 'pinned' ELSE 'organic' END AS req FROM h) SELECT workload, " + _CLAMP.format(r="req") + " AS mode FROM r")
def clamp_cache_mode(spark, d):
    requested = F.when(F.col("workload") % 2 == 0, "pinned").otherwise("organic")
    return _h(spark, d).select("workload", p.clamp_mode(requested, F.col("modes")).alias("mode"))


@query(_H + ", r AS (SELECT *, coalesce(CASE WHEN workload % 3 = 0 THEN 'pinned' END, CASE WHEN workload % 5 = 0 THEN 'bypass' END, 'organic') AS req FROM h) SELECT workload, " + _CLAMP.format(r="req") + " AS mode FROM r")
def resolve_mode(spark, d):
    client, default = F.when(F.col("workload") % 3 == 0, "pinned"), F.when(F.col("workload") % 5 == 0, "bypass")
    return _h(spark, d).select("workload", p.resolve_mode(client, default, F.col("modes")).alias("mode"))


@query(_H + "SELECT workload, least(quota, p_quota) AS granted, quota > p_quota AS was_capped FROM h")
def prefetch_cap(spark, d):
    q, top = F.col("quota"), F.col("p_quota")
    return _h(spark, d).select("workload", F.least(q, top).alias("granted"), (q > top).alias("was_capped"))


@query(_H + "SELECT workload, workload % 4 <= org % 4 AS allowed FROM h")
def priority_cap(spark, d):
    names = F.array(*map(F.lit, p.PRIORITIES))
    at = lambda k: F.element_at(names, (k % 4 + 1).cast("int"))
    return _h(spark, d).select("workload", p.priority_cap(at(F.col("workload")), at(F.col("org"))).alias("allowed"))


@query(_H + ", s AS (SELECT workload, ['enabled', 'draining', 'disabled'][1 + workload % 3] AS a, ['enabled', 'draining', 'disabled'][1 + (workload // 3) % 3] AS b, workload % 2 = 0 AS adm FROM h) SELECT workload, CASE a || '>' || b WHEN 'enabled>draining' THEN true WHEN 'draining>disabled' THEN true WHEN 'enabled>disabled' THEN adm ELSE false END AS allowed FROM s")
def opt_out_transition(spark, d):
    states = F.array(*map(F.lit, ("enabled", "draining", "disabled")))
    before, after = (F.element_at(states, (k % 3 + 1).cast("int")) for k in (F.col("workload"), F.expr("workload div 3")))
    return _h(spark, d).select("workload", p.opt_out_transition(before, after, F.col("workload") % 2 == 0).alias("allowed"))
