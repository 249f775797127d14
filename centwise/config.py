"""Tunable constants, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReconcileConfig:
    tip_tolerance_cents: int = 1500
    merchant_cutoff: float = 0.72
    receipt_window_days: int = 3
    order_window_days: int = 7
    auto_link_threshold: float = 0.70
    recurring_tolerance_cents: int = 200
    recurring_cadence_days: int = 30
    recurring_cadence_slack_days: int = 3
    insight_months: int = 3

    def __post_init__(self) -> None:
        if not 0 < self.merchant_cutoff <= 1:
            raise ValueError("merchant_cutoff must lie in (0, 1]")


@dataclass(frozen=True)
class ReceiptConfig:
    review_threshold: float = 0.80
    arithmetic_tolerance_cents: int = 2
    grading_ratio: float = 0.85
    pass_percent: int = 80
    bootstrap_category_confidence: float = 0.5
    max_image_bytes: int | None = None


ASK_WINDOW_DAYS = 60
DIGITAL_SOURCE = "costco_digital"

RECONCILE = ReconcileConfig()
RECEIPT = ReceiptConfig()
