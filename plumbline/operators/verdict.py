"""The verdict on a measurement as Columns: reasons in order, interval, status.

Unknown is never fine: a missing sigma is infinite, missing evidence counts
against.  Every refusal names its reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_SAMPLES, MIN_SEPARATION, MIN_VIEWS = 20, 2.0, 3
Z = {50: 0.6745, 68: 1.0, 80: 1.2816, 90: 1.6449, 95: 1.96, 99: 2.5758}
PRIORITY = (
    "endpoint_not_observed",
    "outside_established_coverage",
    "uncertainty_undefined",
    "touches_inferred_geometry",
    "scale_not_established",
    "alignment_degenerate",
    "scale_uncertainty_dominates",
    "degenerate_view_geometry",
    "insufficient_views",
    "view_geometry_unverified",
    "dynamic_contamination",
    "interval_exceeds_tolerance",
    "calibration_regime_mismatch",
    "calibration_sample_too_small",
    "interval_not_calibrated",
)
NOT_BLOCKING = ("dynamic_contamination", "interval_exceeds_tolerance")
ADVICE = {
    "endpoint_not_observed": "move the endpoint to observed surface",
    "outside_established_coverage": "another observation is needed",
    "uncertainty_undefined": "use endpoints with a covariance",
    "touches_inferred_geometry": "measure on observed geometry only",
    "scale_not_established": "give a metric scale source",
    "alignment_degenerate": "fly with varied height or cross-strips",
    "scale_uncertainty_dominates": "a better scale source is needed",
    "degenerate_view_geometry": "add frames from a wider baseline",
    "insufficient_views": "add unused frames that see the place",
    "view_geometry_unverified": "keep the lineage of every point",
    "dynamic_contamination": "use frames without movement",
    "interval_exceeds_tolerance": "refine, or relax the tolerance",
    "calibration_regime_mismatch": "fit a profile for this regime",
    "calibration_sample_too_small": "collect more missions",
    "interval_not_calibrated": "evaluate on held-out missions",
}


def z_factor(level: Column) -> Column:
    """The normal factor of a supported level; any other level is refused."""
    table = F.create_map(*[F.lit(x) for kv in Z.items() for x in kv])
    return F.coalesce(F.try_element_at(table, level.cast("int")), F.raise_error(F.concat(F.lit("no factor for level "), level.cast("string"))))


def dominant(reasons: Column) -> Column:
    """The first reason of the fixed priority that is present."""
    return F.get(F.filter(F.array(*map(F.lit, PRIORITY)), lambda p: F.array_contains(reasons, p)), F.lit(0))


def advice(reasons: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return F.transform(reasons, lambda x: F.element_at(table, x))


def threshold(value: Column, half: Column, limit: Column, direction: Column) -> Column:
    """above / below / indeterminate, where the direction decides how a tie counts."""
    lo, hi = value - half, value + half
    least = F.when(lo >= limit, "above").when(hi < limit, "below")
    most = F.when(hi <= limit, "below").when(lo > limit, "above")
    return F.when(limit.isNull(), None).otherwise(F.coalesce(F.when(direction == "at_least", least).otherwise(most), F.lit("indeterminate")))


def evaluate(value: Column, sigma: Column, tolerance: Column, level: Column, e: dict[str, Column], profile: dict[str, Column]) -> dict[str, Column]:
    """e: observed, covered, inferred, dynamic, separation, views, basis, scale, scale_sigma, degenerate.  profile: state, n, regime_ok, factor (null: none at that level)."""
    infinite = F.lit(float("inf"))
    s = F.coalesce(sigma, infinite)
    yes = lambda x, default: F.coalesce(x, F.lit(default))
    hard = [
        F.when(~yes(e["observed"], False), "endpoint_not_observed"),
        F.when(~yes(e["covered"], False), "outside_established_coverage"),
        F.when(yes(e["inferred"], True), "touches_inferred_geometry"),
        F.when(F.isnan(s) | (s == infinite), "uncertainty_undefined"),
    ]
    no_profile = profile["state"].isNull()
    usable = (profile["state"] == "released") & (profile["n"] >= MIN_SAMPLES)
    calibrated = yes(usable & profile["regime_ok"], False)
    calibration = (
        F.when(no_profile, "interval_not_calibrated")
        .when(profile["n"] < MIN_SAMPLES, "calibration_sample_too_small")
        .when(~usable, "interval_not_calibrated")
        .when(~yes(profile["regime_ok"], False), "calibration_regime_mismatch")
    )
    z = z_factor(level)
    half = F.when(calibrated, F.coalesce(profile["factor"] * s, infinite)).otherwise(z * s)
    soft = [
        F.when(yes(e["dynamic"], False), "dynamic_contamination"),
        F.when(yes(e["separation"], 0.0) < MIN_SEPARATION, "degenerate_view_geometry"),
        F.when(yes(e["views"], 0) < MIN_VIEWS, "insufficient_views"),
        F.when(yes(e["basis"], "none") != "triangulated", "view_geometry_unverified"),
        F.when(yes(e["scale"], "none").isin("none", ""), "scale_not_established"),
        F.when(yes(e["degenerate"], True), "alignment_degenerate"),
        calibration,
        F.when(yes(e["scale_sigma"], 0.0) * F.abs(value) * z > tolerance, "scale_uncertainty_dominates"),
    ]
    stop, found = F.array_compact(F.array(*hard)), F.array_compact(F.array(*soft))
    refused = value.isNull() | (F.size(stop) > 0)
    wide = half > tolerance
    blocked = F.exists(found, lambda x: ~x.isin(*NOT_BLOCKING))
    reasons = F.when(value.isNull(), F.array(F.lit("endpoint_not_observed"))).when(F.size(stop) > 0, stop).otherwise(F.when(yes(wide, False), F.concat(found, F.array(F.lit("interval_exceeds_tolerance")))).otherwise(found))
    status = F.when(refused, "not_observable").when(tolerance.isNull(), "estimated_only").when(wide, "needs_refinement").when(calibrated & ~blocked, "meets_requirement").otherwise("estimated_only")
    return {"status": status, "reasons": reasons, "half_width": F.when(refused, infinite).otherwise(half)}
