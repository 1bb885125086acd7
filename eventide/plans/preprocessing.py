"""Raw channels to processed session tables, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.core.series import Series, index_rows
from eventide.operators import events as ev
from eventide.operators import matching as mt
from eventide.operators import preprocess as pp
from eventide.operators.perievent import interpolate


def preprocess_sessions(
    samples: DataFrame,
    locomotion: DataFrame,
    s: Series,
    *,
    edge: int = 3,
    tuning: float = 1.4,
    threshold: float = 1.5,
    cue_gap: float = 0.5,
    loco_width: tuple[int, int] = (4, 6),
    invert: bool = True,
    bout_gap: float = 1.0,
    bout_min: int = 3,
    post_cue: float = 2.0,
) -> dict[str, DataFrame]:
    """``samples``: session_id, channel, i, t, v; ``locomotion``: session_id, i, v.

    Channels: photoreceiver_1/2, ttl_465, ttl_405, sync (locomotion pulses),
    licking, visual_cue, ensure.  Returns photometry, locomotion, cues, licks,
    bouts and deliveries.  ``s`` is keyed by session_id.
    """
    key = list(s.keys)

    def channel(name: str) -> DataFrame:
        return samples.filter(F.col("channel") == name).select(*key, "i", s.t, "v")

    def found(name: str, **kw) -> DataFrame:
        return cut(ev.pulses(channel(name), s, threshold=threshold, include_boundary=False, **kw))

    led = {c: found(c) for c in ("ttl_465", "ttl_405")}
    parts = None
    for number in (1, 2):
        raw = channel(f"photoreceiver_{number}")
        signal = {c: pp.demultiplex(raw, p, s, edge=edge) for c, p in led.items()}
        experimental = cut(signal["ttl_465"].select(*key, s.t, F.col("v").alias("y")))
        both = interpolate(
            experimental, signal["ttl_405"].select(*key, s.t, "v"), s, value="v", out="x", clamp=True
        )
        both = cut(both)
        fits = pp.robust_fit(both, key, tuning=tuning)
        dff = pp.delta_f_over_f(both, fits, key).withColumn("channel", F.lit(number))
        parts = dff if parts is None else parts.unionByName(dff)
    loco = pp.pulse_clock(
        locomotion,
        found("sync", width_in="samples", min_width=loco_width[0], max_width=loco_width[1])
        .select(*key, F.col("onset_t").alias(s.t)),
        s,
        invert=invert,
    )
    cues = cut(ev.merge_pulses(found("visual_cue"), s, max_gap=cue_gap))
    licks = cut(found("licking").select(*key, F.col("onset_t").alias(s.t)))
    return {
        "photometry": parts,
        "locomotion": loco,
        "cues": mt.classify_cues(cues.select(*key, "onset_t", "offset_t"), licks, s, post_window=post_cue),
        "licks": licks,
        "bouts": ev.bouts(licks, s, max_gap=bout_gap, min_count=bout_min),
        "deliveries": found("ensure").select(
            *key, "onset_t", "offset_t", (F.col("offset_t") - F.col("onset_t")).alias("duration")
        ),
    }


def indexed(events: DataFrame, s: Series) -> DataFrame:
    """Event trains with the position column the trial operators expect."""
    return index_rows(events, s, "event_i")
