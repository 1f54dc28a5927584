"""Schemas, allowed values and guards of the five event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, I, B, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TAG = _struct(dim=I, indices=T.ArrayType(I), seed_id=S)
SIGNALS = _struct(template_match_score=D, exif_consistency=D, liveness_score=D, spectral_peak_ratio=D, residual_kurtosis=D, color_corr_anomaly=D, saturation_clip_ratio=D)
_BASE = {"event_id": S, "ts": TS, "institution_id": S}

STREAMS: dict[str, T.StructType] = {
    "onboarding_events": _struct(
        **_BASE, application_id=S, identity_id=S, account_id=S, name_token=S, dob_token=S, address_token=S, email_token=S, phone_token=S, email_handle_shape=S,
        device_id=S, ip_id=S, asn=I, declared_age=I, credit_file_age_months=I, address_shared_count=I, face_tag=TAG, doc_template_tag=TAG, identity_hypervector=TAG, signals=SIGNALS,
    ),
    "auth_events": _struct(
        **_BASE, merchant_id=S, merchant_category=S, account_id=S, identity_id=S, card_token=S, pan_suffix6=S, amount=D, currency=S, is_zero_auth=B,
        response_code=S, avs_result=S, cvv_result=S, device_id=S, ip_id=S, asn=I, session_id=S,
    ),
    "session_telemetry": _struct(
        **_BASE, session_id=S, account_id=S, device_id=S, ip_id=S, user_agent_hash=S, screen_res=S, asn=I, tz_offset_min=I,
        typing_cadence_cv=D, mouse_entropy=D, page_dwell_ms=D, automation_score=D,
    ),
    "labels": _struct(**_BASE, subject_type=S, subject_id=S, is_fraud=B, source=S, event_ts=TS, label_available_at=TS),
    "ground_truth": _struct(identity_id=S, account_id=S, is_synthetic=B, ring_id=S, ring_preset=S, is_lookalike=B, first_fraud_ts=TS, onboarded_ts=TS),
}

#: Allowed sets.
ALLOWED = {
    "response_code": ["approved", "declined_insufficient_funds", "declined_invalid_card", "declined_expired", "declined_cvv", "declined_do_not_honor", "declined_risk"],
    "avs_result": ["match", "partial", "no_match", "unavailable"],
    "cvv_result": ["match", "no_match", "not_provided"],
    "source": ["chargeback", "analyst", "confirmed_fraud"],
    "subject_type": ["auth_event", "identity"],
}
VIEWS = ("merchant", "issuer", "network")
#: Columns that only evaluation may see.
EVALUATION_ONLY = ("is_synthetic", "ring_id", "ring_preset", "is_lookalike", "first_fraud_ts")
#: Raw personal data never has a column.
RAW_PERSONAL = ("name", "date_of_birth", "dob", "address", "email", "phone", "pan", "ssn")


class LeakageError(ValueError):
    """A column or label that would not have been known at the time."""


def refuse_evaluation_columns(df: DataFrame) -> DataFrame:
    """Evaluation-only columns must not reach features."""
    if found := [c for c in df.columns if c in EVALUATION_ONLY]:
        raise LeakageError(f"evaluation-only columns among features: {found}")
    return df


def refuse_raw_personal(df: DataFrame) -> DataFrame:
    """No detokenised data anywhere; there is no function that would resolve a token."""
    if found := [c for c in df.columns if c in RAW_PERSONAL]:
        raise ValueError(f"raw personal data: {found}")
    return df


def violations(df: DataFrame, stream: str) -> Column:
    """Count of broken constraints of a row (ranges, allowed sets, fixed widths, label order)."""
    broken = []
    for name in df.columns:
        if name in ALLOWED:
            broken.append(~F.col(name).isin(ALLOWED[name]))
    more = {
        "onboarding_events": ["declared_age NOT BETWEEN 18 AND 100", "credit_file_age_months < 0", "address_shared_count < 0", "signals.liveness_score NOT BETWEEN 0 AND 1"],
        "auth_events": ["amount < 0", "length(pan_suffix6) <> 6"],
        "session_telemetry": ["automation_score NOT BETWEEN 0 AND 1", "typing_cadence_cv < 0", "mouse_entropy < 0", "page_dwell_ms < 0"],
        "labels": ["label_available_at < event_ts", "ts <> label_available_at"],
    }.get(stream, [])
    broken += [F.expr(c) for c in more]
    return sum([F.coalesce(c, F.lit(False)).cast("int") for c in broken], F.lit(0))
