"""One settings object for every threshold the library uses.

Defaults are the values of the pipeline configuration this library re-creates
(one source of truth instead of code defaults that disagree with the YAML).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # fixed values (pipeline configuration)
    shuffle_partitions: int = 200
    broadcast_threshold_bytes: int = 10 * 1024 * 1024
    max_records_per_file: int = 1_000_000
    min_record_count: int = 100
    max_null_percentage: float = 0.05
    duplicate_threshold: float = 0.01
    date_range_start: str = "2023-01-01"
    date_range_end: str = "2026-12-31"
    high_value_clv: float = 10_000.0
    churn_days: int = 180
    low_stock_threshold: int = 50
    reorder_multiplier: float = 1.5
    fiscal_year_start_month: int = 1
    max_discount: float = 0.5
    # cleaning rules of the silver layer
    max_amount: float = 100_000.0
    max_quantity: int = 1000
    # RFM
    rfm_probabilities: tuple = (0.2, 0.4, 0.6, 0.8)
    rfm_approx_accuracy: int = 100  # relative error 0.01, as approxQuantile(..., 0.01)
    # distinct counts: "exact" (countDistinct, an extra shuffle on the counted
    # column) or "approx" (HyperLogLog++ sketch merged map-side, relative
    # standard deviation approx_distinct_rsd) for very large inputs
    distinct_mode: str = "exact"
    # whole-row duplicate detection in the quality report: "exact" groups on
    # every column (a full-width shuffle); "hash" groups on a 96-bit row
    # fingerprint and compares in full only the rows whose fingerprint occurs
    # again (the same result; the wide rows are filtered before their shuffle)
    duplicate_mode: str = "exact"
    approx_distinct_rsd: float = 0.01
    extra: dict = field(default_factory=dict)


DEFAULT = Settings()
