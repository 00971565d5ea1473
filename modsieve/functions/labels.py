"""Closed-set mappings between decisions, threats, bands, actions, labels and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modsieve import constants as K


def _lookup(value: Column, mapping: dict[str, object], default: object) -> Column:
    out = None
    for key, target in mapping.items():
        hit = value == key
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return out.otherwise(F.lit(default))


def action_of(decision: Column) -> Column:
    return _lookup(decision, {"BLOCK": "BLOCK", "ESCALATE": "FLAG_MEDIUM"}, "PASS")


def accepted_of(decision: Column) -> Column:
    return decision == "ACCEPT"


def band_of(threat: Column) -> Column:
    return _lookup(threat, {"high": "DANGER", "medium": "WARNING"}, "SAFE")


def status_of(band: Column) -> Column:
    return _lookup(band, K.BAND_STATUS, "Unknown")


def model_of(stage: Column) -> Column:
    return _lookup(stage, K.STAGE_DISPLAY, "Unknown")


def is_escalated(threat: Column, confidence: Column, stage: Column, action: Column) -> Column:
    return (
        threat.isin("medium", "high")
        | (confidence < 0.7)
        | stage.isin(*K.ESCALATED_STAGES)
        | action.isin(*K.ESCALATED_ACTIONS)
    )


def needs_explanation(action: Column) -> Column:
    return F.upper(action).isin(*K.EXPLAINED_ACTIONS)


def class_code(label: Column) -> Column:
    """PASS, FLAG, BLOCK -> 0, 1, 2; anything else is null."""
    return _lookup(label, {name: code for code, name in enumerate(K.CLASS_LABELS)}, None).cast("int")


def class_label(code: Column) -> Column:
    return _lookup(code, dict(enumerate(K.CLASS_LABELS)), None).cast("string")


def review_label(accepted: Column, action: Column) -> Column:
    return (
        F.when(accepted, "Accepted").when(F.lower(action).contains("flag"), "Flagged").otherwise("Rejected")
    )


def confidence_bucket(confidence: Column) -> Column:
    """0..4, cut at .2, .4, .6 and .8; each bucket starts at its cut point."""
    return (
        F.when(confidence < 0.2, 0)
        .when(confidence < 0.4, 1)
        .when(confidence < 0.6, 2)
        .when(confidence < 0.8, 3)
        .otherwise(4)
    )


def percent_half_up(share: Column) -> Column:
    return F.floor(share * 100 + 0.5)


def expect_rejected(category: Column) -> Column:
    return category.isin(*K.REJECTED_CATEGORIES)


def expectation_match(expected: Column, actual: Column) -> Column:
    return F.when(expected.isNotNull(), expected == actual)


def expectation_kind(expected: Column) -> Column:
    return F.when(expected.isNull(), "NO_EXPECTED_OUTPUT").otherwise("EXPECTED_OUTPUT")
