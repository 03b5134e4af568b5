"""Registered queries over streams, model hooks and speaker names, with their SQL."""

from pyspark.sql import functions as F

from parley.catalog.common import INTERVALS, SEGMENTS, norm_tokens, strip
from parley.functions import hooks, text as tx
from parley.catalog.transcripts import pack
from parley.operators import intervals as iv, packing, relabel as rl
from parley.sources import adapters as src, capture
from parley.plans.slabs import Run, running, slab_of
from parley.streaming import live, stateful

C = F.col
CONV = ["meeting_id", "conv_id"]


def read_stream(spark, d, name):
    """A table as a stream, be it one file or a folder of files; a pattern is the one form of path that may name either."""
    schema = src.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def samples(e):
    at = C("ts").cast("timestamp")
    return e.select(F.date_format(at, "yyyy-MM-dd").alias("meeting_id"), at.alias("at"), (F.unix_millis(at) % src.DAY_MS).alias("at_ms"),
                    ((C("value") - 245) / 245).alias("x"), "event_id")


def x1(spark, d):
    w = live.live_windows(samples(read_stream(spark, d, "events")), 600_000, 510_000, 0.75)
    return live.run_available(w).drop("batch").withColumn("rms", F.round("rms", 6))


def windows_stream(spark, d):
    """Recognised windows as they arrive; their times come from the conversation's own clock."""
    c = read_stream(spark, d, "conversations")
    return c.select(C("conv_id").cast("string").alias("meeting_id"), "conv_id", (C("turn") * 8000).alias("start_ms"),
                    (C("turn") * 8000 + 10_000 + (C("turn") % 3) * 9000).alias("end_ms"), "text",
                    F.array().cast("array<struct<word:string,start_ms:bigint,end_ms:bigint>>").alias("words"), C("turn").alias("window_id"))


def live_rows(spark, d):
    """The newest form of each row; windows of a conversation come in time order."""
    return live.latest_batch(live.run_available(stateful.refined_rows(windows_stream(spark, d), CONV), "update"), [*CONV, "row_id"])


def x2(spark, d):
    rows = live_rows(spark, d).withColumn("_slab", slab_of(C("start_ms")))
    numbered = running(rows, CONV, "_slab", ["start_ms", "row_id"], [Run("row_no", "sum", F.lit(1), inclusive=False)])
    return numbered.select(*CONV, C("row_no").cast("long").alias("row_no"), "start_ms", "end_ms", "text")


def x3(spark, d):
    """Segments of what each batch has changed, until a later batch changes it again."""
    i = src.intervals(spark, d)
    rows = live_rows(spark, d).withColumnRenamed("row_id", "row_no").drop("closed")
    out = live.republish(i, CONV)(rows, 0)
    return out.withColumn("overlap_speakers", F.array_join("overlap_speakers", ","))


def control_events(e):
    """A log of commands: an error is the last client leaving, a purchase the stop; all else is activity."""
    at = C("ts").cast("timestamp")
    command = F.when(C("event_type") == "error", "left").when(C("event_type") == "purchase", "stop").otherwise("active")
    return e.select(C("user_id").cast("string").alias("meeting_id"), at.alias("at"), F.unix_millis(at).alias("at_ms"), "event_id", command.alias("command"))


def x7_stream(spark, d):
    """Sessions end by a stop, or six hours after the last client left and nobody came back."""
    return live.run_available(stateful.ended_sessions(control_events(read_stream(spark, d, "events")), 6 * 3_600_000, event_time=True)).drop("batch")


def x4(spark, d):
    e = src.table(spark, d, "events").select(C("user_id").alias("meeting_id"), C("event_type").alias("stream_id"), C("ts").cast("timestamp").alias("at"))
    s = live.activity_sessions(e, ["meeting_id", "stream_id"], "at", "12 hours")
    return s.select("meeting_id", "stream_id", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), "n_frames")


def x4_samples(spark, d):
    """By the stream's own sample count the activity always abuts: one span from 0 per stream."""
    return src.stream_frames(spark, d).groupBy("meeting_id", "stream_id").agg(
        F.lit(0).cast("long").alias("start_ms"), (F.count(F.lit(1)) * 100).alias("end_ms"))


def x5(spark, d):
    e = read_stream(spark, d, "events").select(C("user_id").cast("string").alias("meeting_id"), "event_id")
    turns = lambda f: iv.label_runs(f, ["meeting_id"], "frame_idx", "stream_id", 1, 50_000)
    out = live.run_available(e, each=live.relabel_changed(src.speech_frames(spark, d), turns))
    return live.latest_batch(out, ["meeting_id"])


def s15(spark, d):
    c = read_stream(spark, d, "conversations")
    kind = F.when(C("role") == "system", "warning").otherwise("transcript")
    ev = live.update_events(c.withColumn("meeting_id", C("conv_id").cast("string")), kind, ["turn", "role"])
    return live.run_available(ev).drop("batch").withColumn("turn", F.get_json_object("payload", "$.turn").cast("long")).drop("payload")


def h1(spark, d):
    """A stand-in recogniser that fails on batches without rows to hear, run with retries."""
    s = src.segments(spark, d).select("segment_id", "text")

    def model(pdf):
        if (pdf["text"].str.len() % 50 == 0).any():
            raise ValueError("no answer")
        return pdf["text"].str.len().astype(str)

    return hooks.with_model(s, model, "answer", retries=0).select("segment_id", "answer", F.coalesce("error", F.lit("")).alias("error"))


def h2(spark, d):
    """A stand-in reviewer over packed batches: some answers are whole, some partial, some broken, and some calls fail."""
    import json

    import pandas as pd

    t = src.documents(spark, d).select("lang", "doc_id", "text")
    batched = packing.batch_items(t, "lang", "doc_id", "text")

    def reviewer(pdf):
        def answer(number, prompt):
            asked = json.loads(prompt)
            if number % 5 == 4:
                raise TimeoutError("no answer")
            if number % 5 == 3:
                return '{"items": [{"id": 1, "act'
            wanted = [x for x in asked if number % 5 != 1 or x["id"] % 2 == 0]
            items = [{"id": x["id"], "action": ["KEEP", "fix", "drop", "other"][x["id"] % 4], "text": str(len(x["text"]))} for x in wanted]
            text = json.dumps({"items": [*items, *items[:1], {"id": -5, "action": "drop", "text": ""}]})
            return f"Here it is:\n```json\n{text}\n```" if number % 5 == 2 else text

        return pd.Series([answer(int(n), p) for n, p in zip(pdf["batch"], pdf["prompt"])])

    found = hooks.ask_batches(batched, "lang", "batch", "doc_id", "text", reviewer, retries=1, backoff=(0.0,))
    return found.select("lang", "batch", "doc_id", "action", "edited")


def parity_diarizer(pdf):
    """A stand-in diarizer: frames of odd and even values are two speakers, named in the order in which this call hears them."""
    import pandas as pd

    odd = (pdf["value"] // 1 % 2 == 1).to_numpy()
    change = [0, *[k for k in range(1, len(odd)) if odd[k] != odd[k - 1]], len(odd)]
    at = pdf["frame_idx"].to_numpy()
    rows = [(f"voice {int(odd[a] != odd[0])}", int(at[a]) * 100, int(at[b - 1]) * 100 + 100) for a, b in zip(change, change[1:])]
    return pd.DataFrame(rows, columns=["speaker_id", "start_ms", "end_ms"])


def captured(spark, d, available=None):
    """The events as frames of two samples, captured by user and event type."""
    import struct

    class Events(capture.TableCapture):
        path, stream_column, columns = f"{d}/events.parquet", "event_type", ["event_id", "user_id", "event_type"]

        def frame(self, number, row):
            n = row["event_id"]
            return (str(row["user_id"]), f"SPEAKER_{row['event_type']}", row["event_type"].title(), 2 * number, struct.pack("<hh", n % 32768, -(n % 100)))

    Events.available = available
    spark.dataSource.register(capture.capture_source(Events, "captured_events"))
    return spark.readStream.format("captured_events").load()


def h4(spark, d):
    rows = live.run_available(captured(spark, d))
    return rows.select("meeting_id", "speaker_id", "name", "first_sample", F.lower(F.hex("pcm")).alias("pcm"))


def h3(spark, d):
    return hooks.diarize(src.speech_frames(spark, d).select("meeting_id", "frame_idx", "value"), parity_diarizer, slab_frames=32, halo_frames=20)


def j6(spark, d):
    old = src.intervals(spark, d)
    new = src.hypothesis_intervals(spark, d).withColumn("speaker_id", F.concat(F.lit("N"), F.crc32(C("speaker_id").cast("binary")).cast("string")))
    return rl.relabel_by_time(new, old).select("interval_id", "speaker_id", "start_ms", "end_ms")


def vectors(spark, d):
    e = src.table(spark, d, "embeddings")
    return e.select((C("label") % 3).alias("meeting_id"), "label", C("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def halves(spark, d):
    """Known voices from every second vector, new clusters from all of them."""
    v = vectors(spark, d)
    known = rl.centroids(v.where("pos % 2 = 0"), ["meeting_id", "label"], "v", 64).select(
        "meeting_id", F.concat(F.lit("SPEAKER_0"), C("label").cast("string")).alias("speaker_id"), "centroid")
    return rl.centroids(v, ["meeting_id", "label"], "v", 64), known


def j7(spark, d):
    return rl.voice_similarity(*halves(spark, d)).select("meeting_id", "label", "known_id", F.round("similarity", 6).alias("similarity"))


def j7_names(spark, d):
    """Voices are known of half the labels; the pass before had turns of two more, and of one nothing is known."""
    fresh, known = halves(spark, d)
    spans = vectors(spark, d).select("meeting_id", "label", (C("pos") * 100).alias("start_ms"), (C("pos") * 100 + 100).alias("end_ms"), C("pos").alias("interval_id"))
    before = spans.where("label < 9 and interval_id % 3 > 0").select(
        "meeting_id", F.concat(F.lit("SPEAKER_0"), C("label").cast("string")).alias("speaker_id"), "start_ms", "end_ms", "interval_id")
    return rl.relabel_by_voice(fresh, known.where("speaker_id < 'SPEAKER_05'"), spans, before).select("meeting_id", "label", "speaker_id")


def g13(spark, d):
    return rl.count_speakers(vectors(spark, d), 64).select(
        "meeting_id", "n", "n1", F.round("gap", 6).alias("gap"), F.round("spread", 6).alias("spread"), "n_speakers")


QUERIES = {
    "x1_live_windows": x1, "x2_refine_buffer": x2, "x3_live_republish": x3, "x4_activity_sessions": x4, "x7_session_ends": x7_stream, "x4_sample_activity": x4_samples,
    "x5_periodic_relabel": x5, "s15_update_feed": s15, "h1_model_hook": h1, "h2_reviewer_hook": h2, "h4_capture_source": h4, "h3_diarizer_hook": h3,
    "j6_relabel_by_time": j6, "j7_voice_similarity": j7, "j7_relabel_by_voice": j7_names, "g13_count_speakers": g13,
}

JOINED = lambda t: f"array_to_string({norm_tokens(t)}, ' ')"
COMMON = lambda a, b: f"len(list_distinct(list_intersect({norm_tokens(a)}, {norm_tokens(b)})))"
DISTINCT = lambda t: f"len(list_distinct({norm_tokens(t)}))"
#: A window of text b may replace a row's text a: the rule of the same utterance, or a containment of 0.4.
RELATED = lambda a, b: f"""((contains({JOINED(a)}, {JOINED(b)}) OR contains({JOINED(b)}, {JOINED(a)})) AND {JOINED(a)} <> '' AND {JOINED(b)} <> ''
    OR {COMMON(a, b)} >= 0.4e0 * len(list_distinct(list_concat({norm_tokens(a)}, {norm_tokens(b)}))) AND {DISTINCT(a)} > 0 AND {DISTINCT(b)} > 0
    OR {COMMON(a, b)} >= 0.4e0 * least({DISTINCT(a)}, {DISTINCT(b)}) AND {DISTINCT(a)} > 0 AND {DISTINCT(b)} > 0)"""  # noqa: E731
WORDS_IN = lambda t: f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda z: z <> ''))"

SQL = {
    "x2_refine_buffer": f"""WITH RECURSIVE w AS (SELECT CAST(conv_id AS VARCHAR) AS meeting_id, conv_id, CAST(turn * 8000 AS BIGINT) AS s, CAST(turn * 8000 + 10000 + (turn % 3) * 9000 AS BIGINT) AS e,
          {strip('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE {strip('text')} <> ''),
        b AS (SELECT meeting_id, conv_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s BIGINT, e BIGINT, t VARCHAR)[]) AS kept FROM (SELECT DISTINCT meeting_id, conv_id FROM w)
          UNION ALL
          SELECT meeting_id, conv_id, rn, list_sort(CASE WHEN share IS NULL OR share < 0.5e0 THEN list_append(kept, struct_pack(s := s, e := e, t := t))
             ELSE list_transform(kept, lambda x, i: CASE WHEN i <> best THEN x ELSE struct_pack(s := least(x.s, s), e := greatest(x.e, e),
                t := CASE WHEN related AND {WORDS_IN('t')} >= {WORDS_IN('old')} THEN t ELSE x.t END) END) END) AS kept
          FROM (SELECT *, {RELATED('old', 't')} AS related FROM (SELECT *, coalesce(kept[best].t, '') AS old FROM (SELECT *, list_position(shares, list_max(shares)) AS best, list_max(shares) AS share FROM (
             SELECT b.meeting_id, b.conv_id, w.rn, b.kept, w.s, w.e, w.t,
                list_transform(b.kept, lambda x: greatest(0, least(x.e, w.e) - greatest(x.s, w.s)) / greatest(1, least(x.e - x.s, w.e - w.s))) AS shares
             FROM b JOIN w ON w.conv_id = b.conv_id AND w.rn = b.rn + 1))))),
        last AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1)
        SELECT meeting_id, conv_id, CAST(i - 1 AS BIGINT) AS row_no, kept[i].s AS start_ms, kept[i].e AS end_ms, kept[i].t AS text FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM last)""",
    "x7_session_ends": """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, epoch_us(ts) // 1000 AS t, event_id, CASE event_type WHEN 'error' THEN 'left' WHEN 'purchase' THEN 'stop' ELSE 'active' END AS command FROM events),
        n AS (SELECT *, lead(t) OVER w AS next_t, max(t) OVER () AS last_t FROM c WINDOW w AS (PARTITION BY meeting_id ORDER BY t, event_id)),
        k AS (SELECT *, command = 'stop' OR command = 'left' AND coalesce(next_t, last_t + 1) > t + 21600000 AND (next_t IS NOT NULL OR last_t >= t + 21600000) AS cuts FROM n),
        g AS (SELECT *, coalesce(sum(CAST(cuts AS INT)) OVER (PARTITION BY meeting_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM k),
        a AS (SELECT *, min(CASE WHEN command = 'active' THEN (t, event_id) END) OVER (PARTITION BY meeting_id, part) AS first FROM g)
        SELECT meeting_id, min(t) AS started_ms, max(t) + CASE WHEN arg_max(command, (t, event_id)) = 'stop' THEN 0 ELSE 21600000 END AS ended_ms,
          CASE WHEN arg_max(command, (t, event_id)) = 'stop' THEN 'stop' ELSE 'left' END AS reason, count(*) AS n_events
        FROM a WHERE first IS NOT NULL AND (t, event_id) >= first GROUP BY meeting_id, part HAVING bool_or(cuts)""",
    "x1_live_windows": """WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS meeting_id, (epoch_us(ts) // 1000) % 86400000 AS t, (value - 245) / 245 AS x FROM events),
        w AS (SELECT meeting_id, t, x, unnest(range(greatest(0, CAST(floor((t - 600000) / 510000) AS BIGINT) + 1), t // 510000 + 1)) AS window_no FROM s)
        SELECT meeting_id, window_no, window_no * 510000 AS start_ms, window_no * 510000 + 600000 AS end_ms, round(sqrt(avg(x * x)), 6) AS rms, count(*) AS n_samples
        FROM w WHERE t < window_no * 510000 + 600000 GROUP BY meeting_id, window_no HAVING sqrt(avg(x * x)) >= 0.75e0""",
    "x4_activity_sessions": """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
        k AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS s FROM g)
        SELECT user_id AS meeting_id, event_type AS stream_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS end_us, count(*) AS n_frames FROM k GROUP BY user_id, event_type, s""",
    "x4_sample_activity": "SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_type AS stream_id, CAST(0 AS BIGINT) AS start_ms, count(*) * 100 AS end_ms FROM events GROUP BY ALL",
    "x5_periodic_relabel": """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_type AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
        h AS (SELECT *, lag(stream_id) OVER (PARTITION BY meeting_id ORDER BY pos) AS prev, max(pos) OVER (PARTITION BY meeting_id) + 1 AS last_end FROM f)
        SELECT meeting_id, stream_id, pos AS run_start, coalesce(lead(pos) OVER (PARTITION BY meeting_id ORDER BY pos), last_end) AS run_end FROM h WHERE prev IS NULL OR prev <> stream_id""",
    "s15_update_feed": "SELECT CAST(conv_id AS VARCHAR) AS meeting_id, CASE WHEN role = 'system' THEN 'warning' ELSE 'transcript' END AS event_type, turn FROM conversations",
    "h1_model_hook": f"""WITH {SEGMENTS} SELECT segment_id, CASE WHEN length(text) % 50 <> 0 THEN CAST(length(text) AS VARCHAR) END AS answer,
        CASE WHEN length(text) % 50 = 0 THEN 'ValueError: no answer' ELSE '' END AS error FROM segments""",
    "h2_reviewer_hook": f"""WITH RECURSIVE {pack('documents', 'lang', 'doc_id', 'length(text)', 10000, 48, False)},
        a AS (SELECT c.lang, chunk AS batch, doc_id, length(text) AS size, chunk % 5 IN (0, 2) OR chunk % 5 = 1 AND doc_id % 2 = 0 AS said FROM chunks c JOIN documents USING (doc_id))
        SELECT lang, batch, doc_id, CASE WHEN said AND doc_id % 4 = 1 THEN 'fix' WHEN said AND doc_id % 4 = 2 THEN 'drop' ELSE 'keep' END AS action, CASE WHEN said THEN CAST(size AS VARCHAR) ELSE '' END AS edited FROM a""",
    "h4_capture_source": """WITH e AS (SELECT *, row_number() OVER () - 1 AS n FROM events),
        s AS (SELECT *, CAST(event_id % 32768 AS BIGINT) AS a, CAST((65536 - event_id % 100) % 65536 AS BIGINT) AS b FROM e)
        SELECT CAST(user_id AS VARCHAR) AS meeting_id, 'SPEAKER_' || event_type AS speaker_id, upper(event_type[1]) || event_type[2:] AS name, n * 2 AS first_sample,
          lower(printf('%02x%02x%02x%02x', a % 256, a // 256, b % 256, b // 256)) AS pcm FROM s""",
    "h3_diarizer_hook": """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value) % 2 = 1 AS odd FROM events),
        h AS (SELECT *, lag(odd) OVER w AS was, first_value(odd) OVER w AS start FROM f WINDOW w AS (PARTITION BY meeting_id ORDER BY i)),
        r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> odd THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY i) AS run FROM h)
        SELECT meeting_id, CASE WHEN any_value(odd = start) THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker_id, min(i) * 100 AS start_ms, max(i) * 100 + 100 AS end_ms FROM r GROUP BY meeting_id, run""",
    "j7_voice_similarity": """WITH e AS (SELECT label % 3 AS meeting_id, label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        f AS (SELECT meeting_id, label, i, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY ALL), k AS (SELECT meeting_id, label, i, avg(CAST(x AS DOUBLE)) AS c FROM e WHERE vec_id % 2 = 0 GROUP BY ALL)
        SELECT f.meeting_id, f.label, 'SPEAKER_0' || k.label AS known_id, round(sum(f.c * k.c) / (sqrt(sum(f.c * f.c)) * sqrt(sum(k.c * k.c))), 6) AS similarity
        FROM f JOIN k ON f.meeting_id = k.meeting_id AND f.i = k.i GROUP BY f.meeting_id, f.label, k.label""",
}
