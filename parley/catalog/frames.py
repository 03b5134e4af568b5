"""Registered queries over samples, frames and error rates, with their SQL."""

from pyspark.sql import functions as F

from parley.catalog.common import FRAMES, INTERVALS, PAIRS, SEGMENTS, strip, words
from parley.functions import text as tx
from parley.operators import features, frames as fr, metrics
from parley.plans.slabs import Run, running, slab_of
from parley.sources import adapters as src

C = F.col
HOP = dict(frame_ms=100, window_ms=2000, hop_ms=1500, min_rms=0.5)


def w1(spark, d):
    return fr.hopping_windows(src.speech_frames(spark, d), ["meeting_id"], **HOP).withColumn("rms", F.round("rms", 6))


def w2(spark, d):
    return fr.tail_window(src.speech_frames(spark, d), ["meeting_id"], **HOP).withColumn("rms", F.round("rms", 6))


def w9(spark, d):
    return fr.smooth_labels(src.speech_frames(spark, d), ["meeting_id"], "stream_id").select(
        "event_id", "stream_id", "smoothed")


def w11(spark, d):
    """The end of the last usable utterance before each one, as the next window's prompt."""
    s = src.segments(spark, d).withColumn("_slab", slab_of(C("turn"), 10_000)).withColumn("_t", tx.strip(C("text")))
    usable = F.when(tx.is_meaningful(C("text")) & (C("speaker_id") != "SPEAKER_02"), C("_t"))
    p = running(s, ["meeting_id"], "_slab", ["turn"], [Run("last_text", "last", usable)])
    return p.select("conv_id", "turn", F.when(F.length("last_text") >= 8, F.right("last_text", F.lit(240))).otherwise("").alias("prompt"))


def w12(spark, d):
    s = src.overlap_segments(spark, d)
    who = F.when(F.size("overlap_speakers") > 0, C("overlap_speakers")).otherwise(F.array("speaker_id"))
    return s.select("segment_id", F.concat_ws("|", F.array_join(F.array_sort(who), ","),
                                              F.floor(C("start_ms") / 1500).cast("string")).alias("group_key"))


def w13(spark, d):
    return fr.stream_slabs(src.stream_frames(spark, d), ["meeting_id", "stream_id"], 100, 160, slab_s=1, min_rms=0.5).withColumn(
        "rms", F.round("rms", 6))


def g9(spark, d):
    f = src.speech_frames(spark, d)
    return f.groupBy("meeting_id", F.floor(C("frame_idx") / 10).alias("bucket")).agg(
        F.round(fr.rms(C("x")), 6).alias("rms")).withColumn("loud", C("rms") >= 0.5)


def g10(spark, d):
    return fr.mix_down(src.stream_frames(spark, d)).withColumn("x", F.round("x", 6))


def g11(spark, d):
    return fr.stream_duration(src.stream_frames(spark, d), 16000, F.floor(C("value") * 100))


def g12(spark, d):
    """Features of single samples, standardised per meeting."""
    f = src.speech_frames(spark, d).select(
        "meeting_id", "event_id", F.log1p(F.abs("x") * 100).alias("loudness"), (C("value") / 1000).alias("centroid"))
    return fr.zscore(f, ["meeting_id"], ["loudness", "centroid"]).select(
        "event_id", F.round("loudness", 5).alias("loudness"), F.round("centroid", 5).alias("centroid"))


def g12_fft(spark, d):
    f = src.speech_frames(spark, d).select("meeting_id", "frame_idx", "x")
    return features.frame_features(f, ["meeting_id"], sample_rate=1000, threshold=0.01)


def f24(spark, d):
    return fr.sparse_energy(src.stream_frames(spark, d), ["meeting_id", "stream_id"], floor=0.3).withColumn(
        "energy", F.round("energy", 6))


def g7(spark, d):
    return metrics.with_word_errors(src.text_pairs(spark, d), "a", "b").select(
        "conv_id", "turn", "kind", "n_words", "n_edits", F.round("wer", 6).alias("wer"))


def g7_corpus(spark, d):
    return g7(spark, d).groupBy("kind").agg(
        F.sum("n_words").alias("n_words"), F.sum("n_edits").alias("n_edits"),
        F.round(F.sum("n_edits") / F.sum("n_words"), 6).alias("wer"))


def g8(spark, d):
    return metrics.speaker_error_rate(src.intervals(spark, d), src.hypothesis_intervals(spark, d), ["meeting_id"]).withColumn(
        "der", F.round("der", 6))


QUERIES = {
    "w1_hopping_windows": w1, "w2_tail_window": w2, "w9_label_smoothing": w9, "w11_context_carry": w11,
    "w12_group_key": w12, "w13_stream_slabs": w13, "g7_word_errors": g7, "g7_corpus_word_errors": g7_corpus,
    "g8_speaker_errors": g8, "g9_window_energy": g9, "g10_mix_down": g10, "g11_stream_duration": g11,
    "g12_feature_zscore": g12, "g12_frame_features": g12_fft, "f24_silence_gate": f24,
}

STREAMS = FRAMES + """,
streams AS (SELECT meeting_id, stream_id, row_number() OVER (PARTITION BY meeting_id, stream_id ORDER BY frame_idx) - 1 AS frame_idx,
            x, value, event_id FROM frames)"""

# Edit distance row by row: the next row is a running minimum over the one before.
WER = f"""WITH RECURSIVE {PAIRS},
    tk AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, kind) AS pid FROM (
      SELECT conv_id, turn, kind, {words('lower(a)')} AS r, {words('lower(b)')} AS h FROM pairs)),
    rt AS (SELECT pid, unnest(r) AS tok, generate_subscripts(r, 1) AS i FROM tk),
    ht AS (SELECT pid, unnest(h) AS tok, generate_subscripts(h, 1) AS j FROM tk UNION ALL SELECT pid, NULL, 0 FROM tk),
    voc AS (SELECT tok, row_number() OVER () AS id FROM (SELECT DISTINCT tok FROM (SELECT tok FROM rt UNION ALL SELECT tok FROM ht) WHERE tok IS NOT NULL)),
    ri AS (SELECT pid, i, id FROM rt JOIN voc USING (tok)),
    hi AS (SELECT pid, j, coalesce(id, -1) AS id FROM ht LEFT JOIN voc USING (tok)),
    cells AS (
      SELECT pid, CAST(0 AS BIGINT) AS i, CAST(j AS BIGINT) AS j, id, CAST(j AS BIGINT) AS v FROM hi
      UNION ALL
      SELECT pid, i, j, id, j + min(t - j) OVER (PARTITION BY pid ORDER BY j) AS v FROM (
        SELECT c.pid, r.i, c.j, c.id, least(c.v + 1, coalesce(lag(c.v) OVER (PARTITION BY c.pid ORDER BY c.j)
                 + CASE WHEN r.id = c.id THEN 0 ELSE 1 END, c.v + 1)) AS t
        FROM cells c JOIN ri r ON r.pid = c.pid AND r.i = c.i + 1)),
    ends AS (SELECT pid, v FROM cells JOIN tk USING (pid) WHERE i = len(r) AND j = len(h)),
    wer AS (SELECT conv_id, turn, kind, len(r) AS n_words, v AS n_edits, len(h) AS nh FROM ends JOIN tk USING (pid))"""

SQL = {
    "w1_hopping_windows": f"""WITH {FRAMES}, n AS (SELECT meeting_id, max(frame_idx) + 1 AS nf FROM frames GROUP BY 1),
        w AS (SELECT meeting_id, unnest(range(0, CASE WHEN nf >= 20 THEN (nf - 20) // 15 + 1 ELSE 0 END)) AS k FROM n)
        SELECT w.meeting_id, k AS window_no, k * 1500 AS start_ms, k * 1500 + 2000 AS end_ms, round(sqrt(avg(x * x)), 6) AS rms
        FROM w JOIN frames f ON f.meeting_id = w.meeting_id AND frame_idx >= k * 15 AND frame_idx < k * 15 + 20
        GROUP BY ALL HAVING sqrt(avg(x * x)) >= 0.5e0""",
    "w2_tail_window": f"""WITH {FRAMES}, n AS (SELECT meeting_id, max(frame_idx) + 1 AS nf FROM frames GROUP BY 1),
        w AS (SELECT meeting_id, nf, CASE WHEN nf >= 20 THEN (nf - 20) // 15 + 1 ELSE 0 END AS k FROM n)
        SELECT w.meeting_id, k AS window_no, k * 1500 AS start_ms, nf * 100 AS end_ms, round(sqrt(avg(x * x)), 6) AS rms
        FROM w JOIN frames f ON f.meeting_id = w.meeting_id AND frame_idx >= k * 15 WHERE (nf - k * 15) * 100 >= 400
        GROUP BY ALL HAVING sqrt(avg(x * x)) >= 0.5e0""",
    "w9_label_smoothing": f"""WITH {FRAMES}, k AS (SELECT meeting_id, count(*) AS len FROM frames GROUP BY 1),
        c AS (SELECT a.event_id, a.stream_id, CASE WHEN len < 3 THEN a.stream_id ELSE b.stream_id END AS lab, count(*) AS n FROM frames a JOIN k USING (meeting_id)
          JOIN frames b ON a.meeting_id = b.meeting_id AND b.frame_idx BETWEEN a.frame_idx - 2 AND a.frame_idx + 2 GROUP BY ALL)
        SELECT event_id, stream_id, lab AS smoothed FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, lab) = 1""",
    "w11_context_carry": f"""WITH {SEGMENTS}, u AS (SELECT conv_id, turn, CASE WHEN length({strip('text')}) >= 2 AND regexp_matches(text, '\\p{{L}}')
          AND speaker_id <> 'SPEAKER_02' THEN {strip('text')} END AS t FROM segments),
        l AS (SELECT conv_id, turn, last_value(t IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM u)
        SELECT conv_id, turn, CASE WHEN length(p) >= 8 THEN right(p, 240) ELSE '' END AS prompt FROM l""",
    "w13_stream_slabs": f"""WITH {STREAMS}, n AS (SELECT meeting_id, stream_id, max(frame_idx) + 1 AS nf FROM streams GROUP BY ALL)
        SELECT meeting_id, stream_id, frame_idx // 10 AS slab_no, min(frame_idx // 10) * 1000 AS start_ms,
          least(min(frame_idx // 10) * 1000 + 1000, any_value(nf) * 100) AS end_ms, round(sqrt(avg(x * x)), 6) AS rms
        FROM streams JOIN n USING (meeting_id, stream_id) WHERE nf * 160 >= 1600
        GROUP BY meeting_id, stream_id, frame_idx // 10 HAVING sqrt(avg(x * x)) >= 0.5e0""",
    "g7_word_errors": f"""{WER} SELECT conv_id, turn, kind, n_words, n_edits,
        round(CASE WHEN n_words > 0 THEN n_edits / n_words WHEN nh > 0 THEN 1e0 ELSE 0e0 END, 6) AS wer FROM wer""",
    "g7_corpus_word_errors": f"""{WER} SELECT kind, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_edits) AS BIGINT) AS n_edits,
        round(sum(n_edits) / sum(n_words), 6) AS wer FROM wer GROUP BY kind""",
    "g8_speaker_errors": f"""WITH {INTERVALS},
        hyp AS (SELECT meeting_id, CASE WHEN interval_id % 7 = 0 AND speaker_id = 'SPEAKER_error' THEN 'SPEAKER_view' ELSE speaker_id END AS speaker_id,
                CASE WHEN interval_id % 7 = 0 THEN least(start_ms + 250, end_ms) ELSE start_ms END AS start_ms, end_ms FROM intervals),
        fr AS (SELECT DISTINCT meeting_id, speaker_id, unnest(range((start_ms + 99) // 100, (end_ms + 99) // 100)) AS f FROM intervals),
        fh AS (SELECT DISTINCT meeting_id, speaker_id, unnest(range((start_ms + 99) // 100, (end_ms + 99) // 100)) AS f FROM hyp),
        j AS (SELECT coalesce(a.meeting_id, b.meeting_id) AS meeting_id, coalesce(a.f, b.f) AS f,
              max(CASE WHEN a.f IS NULL OR b.f IS NULL THEN 1 ELSE 0 END) AS err
              FROM fr a FULL JOIN fh b ON a.meeting_id = b.meeting_id AND a.speaker_id = b.speaker_id AND a.f = b.f GROUP BY ALL)
        SELECT meeting_id, count(*) AS scored, CAST(sum(err) AS BIGINT) AS errors, round(sum(err) / count(*), 6) AS der FROM j GROUP BY 1""",
    "g9_window_energy": f"""WITH {FRAMES} SELECT meeting_id, frame_idx // 10 AS bucket, round(sqrt(avg(x * x)), 6) AS rms,
        round(sqrt(avg(x * x)), 6) >= 0.5e0 AS loud FROM frames GROUP BY ALL""",
    "g10_mix_down": f"""WITH {STREAMS}, m AS (SELECT meeting_id, frame_idx, sum(x) AS x FROM streams GROUP BY ALL)
        SELECT meeting_id, frame_idx, round(x / greatest(1e0, max(abs(x)) OVER (PARTITION BY meeting_id)), 6) AS x FROM m""",
    "g11_stream_duration": f"""WITH {STREAMS}, s AS (SELECT meeting_id, stream_id, CAST(sum(floor(value * 100)) AS BIGINT) AS samples FROM streams GROUP BY ALL)
        SELECT *, (samples * 1000) // 16000 AS stream_ms, max((samples * 1000) // 16000) OVER (PARTITION BY meeting_id) AS meeting_ms FROM s""",
    "g12_feature_zscore": f"""WITH {FRAMES}, f AS (SELECT meeting_id, event_id, ln(1 + abs(x) * 100) AS l, value / 1000 AS c FROM frames)
        SELECT event_id, round((l - avg(l) OVER w) / (stddev_pop(l) OVER w + 1e-6), 5) AS loudness,
               round((c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-6), 5) AS centroid FROM f WINDOW w AS (PARTITION BY meeting_id)""",
    "f24_silence_gate": f"""WITH {STREAMS}, e AS (SELECT meeting_id, stream_id, coalesce(sum(x * x) FILTER (WHERE frame_idx % 8 = 0), 0) / greatest(1e0, count(*) / 8e0) AS e FROM streams GROUP BY ALL)
        SELECT meeting_id, stream_id, round(e, 6) AS energy, e >= 0.3e0 AS send FROM e""",
}
from parley.catalog.common import OVERLAP_SEGMENTS  # noqa: E402

SQL["w12_group_key"] = f"""WITH {OVERLAP_SEGMENTS} SELECT segment_id, array_to_string(list_sort(CASE WHEN len(overlap_speakers) > 0
    THEN overlap_speakers ELSE [speaker_id] END), ',') || '|' || (start_ms // 1500) AS group_key FROM overlap_segments"""
