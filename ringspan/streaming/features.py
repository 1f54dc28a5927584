"""Online features and sessions over event streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.scalars import SPANS

WEEK_US = 604_800_000_000
STATE = "us array<bigint>, declined array<double>, card array<int>, merchant array<string>, amount array<double>"
FEATURES = ", ".join([f"acct_n_{w} bigint, acct_decline_ratio_{w} double, acct_distinct_pans_{w} bigint, acct_distinct_merchants_{w} bigint, acct_mean_amount_{w} double" for w in SPANS])
OUT = f"account bigint, seq bigint, us bigint, {FEATURES}"


def _distinct(codes: list, low: list[int]) -> list[int]:
    """For each i, how many distinct codes lie in [low[i], i): both ends only move on."""
    held, n, at, out = {}, 0, 0, []
    for i, code in enumerate(codes):
        while at < low[i]:
            gone = codes[at]
            held[gone] -= 1
            n -= held[gone] == 0
            at += 1
        out.append(n)
        n += not held.get(code)
        held[code] = held.get(code, 0) + 1
    return out


def _update(key, pdfs, state):
    """Each event is scored on what was seen before it, then added; entries older than a week leave the state.
    Ratios and means come from running totals, distincts from counts that are kept up as the window moves on."""
    parts = list(pdfs)
    new = parts[0] if len(parts) == 1 else pd.concat(parts)
    order = np.lexsort((new["seq"].to_numpy(), new["us"].to_numpy()))
    new = {c: new[c].to_numpy()[order] for c in ("seq", "us", "declined", "card", "merchant", "amount")}
    held = state.get if state.exists else ([], [], [], [], [])
    us, bad, amounts = (np.concatenate([np.array(h, kind), new[c].astype(kind)]) for h, c, kind in ((held[0], "us", np.int64), (held[1], "declined", float), (held[4], "amount", float)))
    cards, shops = [*held[2], *new["card"].tolist()], [*held[3], *new["merchant"].tolist()]
    # the latest time seen so far: an event that comes late counts as of that time
    clock, first, n = np.maximum.accumulate(us), len(held[0]), np.arange(len(us))
    sums = {c: np.concatenate([[0.0], np.cumsum(v)]) for c, v in (("bad", bad), ("amount", amounts))}
    out = {"account": np.full(len(us) - first, key[0]), "seq": new["seq"], "us": us[first:]}
    for name, seconds in SPANS.items():
        # what came before in order of processing, and lies within the span
        low = np.minimum(np.searchsorted(clock, clock - seconds * 1_000_000, "left"), n)
        seen = n - low
        mean = lambda c: (np.where(seen > 0, (sums[c][n] - sums[c][low]) / np.maximum(seen, 1), 0.0))[first:]  # noqa: B023, E731
        out |= {f"acct_n_{name}": seen[first:], f"acct_decline_ratio_{name}": mean("bad")}
        out |= {f"acct_distinct_{c}_{name}": np.array(_distinct(v, low.tolist())[first:], np.int64) for c, v in (("pans", cards), ("merchants", shops))}
        out[f"acct_mean_amount_{name}"] = mean("amount")
    keep = int(np.searchsorted(clock, clock[-1] - WEEK_US, "left")) if len(us) else 0
    state.update((us[keep:].tolist(), bad[keep:].tolist(), cards[keep:], shops[keep:], amounts[keep:].tolist()))
    yield pd.DataFrame(out, copy=False)


def online_features(stream: DataFrame) -> DataFrame:
    """stream: account, seq, us, declined (double), card, merchant, amount; ordered within an account (T4: no watermark)."""
    return stream.groupBy("account").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, ts: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """T5: counts and declines a window, with a watermark to bound the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.sum("declined").alias("declined"))


def sessions(events: DataFrame, days: float = 0.05) -> DataFrame:
    """A session ends when an event lies more than ``days`` after its start, not after the last event. Only times are
    sent to Python."""
    width = round(days * 86_400_000_000)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "seq"])
        start, number, found = None, 0, []
        for us in pdf.us:
            if start is None or us - start > width:
                start, number = us, number + 1
            found.append((start, number))
        return pd.DataFrame({"account": pdf.account, "seq": pdf.seq, "session_start": [s for s, _ in found], "session": [n for _, n in found]})

    return events.select("account", "seq", "us").groupBy("account").applyInPandas(run, "account bigint, seq bigint, session_start bigint, session bigint")


def first_of_session(rows: DataFrame) -> DataFrame:
    """The event that opens its session emits telemetry."""
    return rows.groupBy("account", "session").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("events"))


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything stored, then stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
