"""Scenarios and rules (S7, S8): defaults, deep-merged with overrides; YAML where it is installed."""

from __future__ import annotations

import copy

from ..operators import decision as D

#: The defaults, then what each scenario changes.
DEFAULTS = {
    "name": "moderate", "seed": 20260830, "days": 90, "start_date": "2026-03-01", "institution_prefix": "inst", "target_fraud_rate_min": 0.001, "target_fraud_rate_max": 0.010,
    "population": {
        "n_customers": 4000, "n_merchants": 220, "n_institutions": 6, "devices_min": 1, "devices_max": 3, "amount_mu": 3.4, "amount_sigma": 1.0, "daily_rate_mean": 0.75, "daily_rate_sigma": 0.5,
        "p_device_change": 0.12, "p_travel": 0.10, "p_move": 0.05, "base_decline_rate": 0.055,
    },
    "ring": {
        "name": "moderate", "n_rings": 4, "ring_size_min": 20, "ring_size_max": 50, "device_reuse_rate": 0.55, "subnet_concentration": 0.60, "pii_recombination_rate": 0.35, "doc_template_reuse": 0.60, "face_reuse_rate": 0.50,
        "face_jitter": 0.06, "artifact_strength": 0.80, "dormancy_days_min": 7, "dormancy_days_max": 21, "burst_intensity": 45.0, "burst_hours": 3.0, "n_bursts_per_account": 1, "merchant_spread": 3, "inter_arrival_jitter": 0.25,
        "dormant_share": 0.65, "onboard_window_fraction": 0.70,
    },
    "lookalikes": {"n_small_business": 45, "n_travellers": 40, "n_new_device": 40, "small_business_daily_rate": 18.0, "small_business_amount_mu": 2.1},
    "labels": {"chargeback_delay_min_days": 20, "chargeback_delay_max_days": 60, "chargeback_coverage": 0.72, "analyst_review_share": 0.10, "analyst_delay_days": 3, "false_chargeback_rate": 0.0008},
    "drift": {"enabled": False, "at_fraction": 0.55, "burst_intensity_mult": 0.35, "merchant_spread_mult": 2.5, "device_reuse_mult": 0.4, "inter_arrival_jitter_mult": 2.5},
}
SCENARIOS = {
    "tiny": {
        "name": "tiny", "seed": 7, "days": 30, "population": {"n_customers": 120, "n_merchants": 40, "n_institutions": 3, "daily_rate_mean": 0.55},
        "ring": {"n_rings": 2, "ring_size_min": 8, "ring_size_max": 12, "dormant_share": 0.45}, "lookalikes": {"n_small_business": 5, "n_travellers": 5, "n_new_device": 5},
    },
    "sloppy": {
        "name": "sloppy",
        "ring": {
            "name": "sloppy", "ring_size_min": 25, "ring_size_max": 55, "device_reuse_rate": 0.85, "subnet_concentration": 0.90, "pii_recombination_rate": 0.60, "doc_template_reuse": 0.90, "face_reuse_rate": 0.80, "face_jitter": 0.04,
            "artifact_strength": 1.60, "dormancy_days_min": 2, "dormancy_days_max": 7, "burst_hours": 2.0, "merchant_spread": 2, "inter_arrival_jitter": 0.10, "dormant_share": 0.60,
        },
    },
    "moderate": {"name": "moderate", "ring": {"n_rings": 5, "ring_size_max": 45, "face_jitter": 0.07, "dormancy_days_min": 10, "dormancy_days_max": 25, "burst_intensity": 30.0, "merchant_spread": 5, "inter_arrival_jitter": 0.35}},
    "sophisticated": {
        "name": "sophisticated", "days": 120,
        "ring": {
            "name": "sophisticated", "n_rings": 6, "ring_size_min": 18, "ring_size_max": 40, "device_reuse_rate": 0.18, "subnet_concentration": 0.22, "pii_recombination_rate": 0.12, "doc_template_reuse": 0.28, "face_reuse_rate": 0.25,
            "face_jitter": 0.11, "artifact_strength": 0.25, "dormancy_days_min": 30, "dormancy_days_max": 60, "burst_intensity": 9.0, "burst_hours": 8.0, "merchant_spread": 14, "inter_arrival_jitter": 0.85, "dormant_share": 0.62,
        },
    },
    "drift": {
        "name": "drift", "days": 120,
        "ring": {
            "name": "drift", "n_rings": 5, "ring_size_max": 45, "device_reuse_rate": 0.60, "subnet_concentration": 0.65, "doc_template_reuse": 0.65, "face_reuse_rate": 0.55, "face_jitter": 0.07, "dormancy_days_min": 10, "dormancy_days_max": 25,
            "burst_intensity": 38.0, "merchant_spread": 4, "inter_arrival_jitter": 0.30,
        },
        "drift": {"enabled": True, "burst_intensity_mult": 0.30, "merchant_spread_mult": 3.0, "device_reuse_mult": 0.35, "inter_arrival_jitter_mult": 3.0},
    },
}


def merged(base: dict, over: dict) -> dict:
    """Deep merge; an unknown key is an error."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if k not in out:
            raise KeyError(f"unknown setting {k!r}; there are {', '.join(sorted(out))}")
        out[k] = merged(out[k], v) if isinstance(out[k], dict) else v
    return out


def load_scenario(name_or_path: str) -> dict:
    """S7"""
    if name_or_path in SCENARIOS:
        return merged(DEFAULTS, SCENARIOS[name_or_path])
    if not name_or_path.endswith((".yaml", ".yml")):
        raise ValueError(f"no scenario {name_or_path!r}; there are {', '.join(sorted(SCENARIOS))}")
    import yaml

    with open(name_or_path, encoding="utf-8") as f:
        return merged(DEFAULTS, yaml.safe_load(f) or {})


def load_rules(path: str | None = None) -> dict:
    """Thresholds, triggers and tightening; the defaults where no file is named."""
    rules = {"thresholds": dict(D.BANDS), "triggers": dict(D.TRIGGERS), "tightening": D.TIGHTENING}
    if path is None:
        return rules
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    if "thresholds" in found:
        rules["thresholds"] = {k: float(found["thresholds"].get(k, v)) for k, v in D.BANDS.items()}
    if "triggers" in found:
        way = lambda spec: ("above", float(spec["above"])) if "above" in spec else ("below", float(spec["below"]))
        rules["triggers"] = {code: (spec["feature"], *way(spec)) for code, spec in found["triggers"].items() if code in D.REASONS and "feature" in spec}
    rules["tightening"] = float(found.get("onboarding_tightening", D.TIGHTENING))
    return rules
