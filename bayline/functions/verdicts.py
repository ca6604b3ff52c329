"""Three-state verdicts and weighted log-odds fusion of evidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from bayline.functions.numbers import logit, sigmoid

OCCUPIED, VACANT, UNCERTAIN = "occupied", "vacant", "uncertain"
#: The fusion that follows the classifier alone, and the fitted one.
DEFAULT_WEIGHTS = {
    "intercept": 0.0, "occupancy_logit": 1.0, "vehicle_present": 0.0, "vehicle_absent": 0.0,
    "slot_coverage": 0.0, "vehicle_coverage": 0.0, "geometry_confidence": 0.0, "prior_logit": 0.0,
}
FITTED_WEIGHTS = DEFAULT_WEIGHTS | {
    "intercept": 0.39, "occupancy_logit": 1.04, "vehicle_present": -1.16, "vehicle_absent": -0.34,
    "slot_coverage": 0.17, "vehicle_coverage": 1.46,
}


def closed_band(p: Column, low: float, high: float, threshold: float) -> Column:
    """Uncertain in [low, high], edges included; else occupied from threshold on."""
    return F.when(p.isNull(), None).when((p >= low) & (p <= high), UNCERTAIN).when(p >= threshold, OCCUPIED).otherwise(VACANT)


def open_band(p: Column, low: float, high: float) -> Column:
    """Occupied from high on, vacant up to low, uncertain between them."""
    return F.when(p.isNull(), None).when(p >= high, OCCUPIED).when(p <= low, VACANT).otherwise(UNCERTAIN)


def smoothed_verdict(p: Column, state: Column, low: float, high: float) -> Column:
    """Uncertain in the band, else what the hysteresis state says."""
    return F.when((p >= low) & (p <= high), UNCERTAIN).when(state, OCCUPIED).otherwise(VACANT)


def contributions(
    probability: Column,
    weights: Mapping[str, float] = DEFAULT_WEIGHTS,
    geometry: Column | None = None,
    available: Column | None = None,
    detected: Column | None = None,
    confidence: Column | None = None,
    slot_share: Column | None = None,
    vehicle_share: Column | None = None,
    prior: Column | None = None,
) -> Column:
    """What each kind of evidence adds to the log-odds, as a map.

    That no detector ran (available is false) is not that no vehicle was found: without a detector
    the map has no vehicle entry at all.
    """
    zero, no = F.lit(0.0), F.lit(False)
    available, detected = available if available is not None else no, detected if detected is not None else no
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))
    value = lambda c: c if c is not None else zero
    vehicle = F.when(detected, F.lit(weights["vehicle_present"]) * value(confidence)).otherwise(F.lit(weights["vehicle_absent"]))
    cover = F.lit(weights["slot_coverage"]) * value(slot_share) + F.lit(weights["vehicle_coverage"]) * value(vehicle_share)
    entries = [
        entry("classifier", F.lit(weights["occupancy_logit"]) * logit(probability)),
        F.when(available, entry("vehicle", vehicle)),
        F.when(available & detected, entry("coverage", cover)),
        entry("geometry", F.lit(weights["geometry_confidence"]) * ((geometry if geometry is not None else F.lit(1.0)) - 1)),
    ]
    if prior is not None:
        entries.append(F.when(prior.isNotNull(), entry("prior", F.lit(weights["prior_logit"]) * logit(prior))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def fuse(evidence: Column, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> Column:
    """The probability that contributions() amount to."""
    total = F.aggregate(F.map_values(evidence), F.lit(0.0), lambda a, v: a + v)
    return sigmoid(F.lit(weights["intercept"]) + total)


def product_state(state: Column, names: Mapping[str, str], default: str) -> Column:
    """A state's name in the product; default for unknown ones."""
    pairs = [F.lit(v) for pair in names.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), state), F.lit(default))


def layout_state(agreement: Column, recalled: Column, detected: Column, confidence: Column, verified: Column, detector: Column, agree_at: float = 0.35, plausible: int = 4, automatic: float = 0.55) -> Column:
    """Where a layout comes from: verified, a corroborated recall, the detector, or nowhere.

    recalled and detected count slots; verified and detector are booleans.
    """
    return (
        F.when(verified, "reused_verified")
        .when((recalled > 0) & ~detector, "verification_required")
        .when((recalled > 0) & (agreement >= agree_at), "auto_detected")
        .when((detected >= plausible) & (confidence >= automatic), "auto_detected")
        .when(detected > 0, "automatic_layout_unresolved")
        .otherwise("insufficient_visual_evidence")
    )
