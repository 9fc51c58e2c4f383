"""Inherited policy over a three-level hierarchy: union, intersection, difference, minimum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIPAA_STALENESS_MS = 2_000


def effective_tags(*levels: Column) -> Column:
    """Union, outermost level first, in order of first sight."""
    return F.array_distinct(F.concat(*levels))


def effective_profiles(org: Column, project: Column, workload: Column) -> Column:
    """Intersection in the workload's order."""
    return F.array_intersect(F.array_intersect(workload, project), org)


def excess(child: Column, parent: Column) -> Column:
    """What a child allows that its parent does not; anything means rejection."""
    return F.array_except(child, parent)


def first_violation(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Name of the first field whose child value is over the parent's."""
    out = F.lit(None).cast("string")
    for name, (child, parent) in reversed(fields.items()):
        out = F.when(child > parent, name).otherwise(out)
    return out


def effective_staleness(preference_ms: Column, tags: Column) -> Column:
    return F.greatest(preference_ms, F.when(F.array_contains(tags, "HIPAA"), F.lit(HIPAA_STALENESS_MS)).otherwise(F.lit(0))).cast("long")


def compression_allowed(tags: Column) -> Column:
    return ~F.array_contains(tags, "HIPAA")


def clamp_mode(requested: Column, allowed: Column) -> Column:
    """The requested mode if allowed, else organic, else the first allowed, else bypass."""
    return F.when(F.array_contains(allowed, requested), requested).when(F.array_contains(allowed, "organic"), "organic").when(F.size(allowed) > 0, F.try_element_at(allowed, F.lit(1))).otherwise("bypass")


def resolve_mode(client: Column, workload: Column, allowed: Column) -> Column:
    """The client's wish, else the workload's default, clamped."""
    return clamp_mode(F.coalesce(client, workload, F.lit("organic")), allowed)


PRIORITIES = ("batch", "bulk", "normal", "interactive")


def priority_cap(asked: Column, top: Column) -> Column:
    """Whether a priority is not above the highest allowed."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, PRIORITIES)), c)
    return rank(asked) <= rank(top)


def opt_out_transition(before: Column, after: Column, admin: Column) -> Column:
    """A tenant's participation drains, then ends; an administrator may end it at once.  Nothing else is allowed, no change neither."""
    ends = (after == "disabled") & ((before == "draining") | (before == "enabled") & admin)
    return (before == "enabled") & (after == "draining") | ends
