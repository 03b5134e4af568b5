"""Meeting tables: scans, upserts, replacement, deletes, owner views, roster and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.functions.names import default_label
from parley.functions.text import strip
from parley.plans.slabs import Run, running, side_by_side, slab_of

ACTIVE = ["recording", "processing"]
PAGE, ADMIN_PAGE, MAX_SAMPLE_MS = 50, 200, 4000


def transcript(segments: DataFrame, slab_ms: int = 600_000) -> DataFrame:
    """Rows of every meeting with their place in it."""
    s = segments.withColumn("_slab", slab_of(F.col("start_ms"), slab_ms))
    return running(s, ["meeting_id"], "_slab", ["start_ms", "segment_id"], [Run("position", "sum", F.lit(1))]).drop("_slab")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], seq: str, keep_first: list[str]) -> DataFrame:
    """Insert or replace by key, the highest `seq` last; `keep_first` columns stay as first inserted.

    One aggregation with map-side combining; existing rows count as `seq` null, before all changes.
    """
    cols = [c for c in existing.columns if c not in keys]
    both = existing.withColumn(seq, F.lit(None).cast("long")).unionByName(changes.withColumn(seq, F.col(seq).cast("long")))
    order = F.struct(F.coalesce(F.col(seq), F.lit(-1)).alias("seq"))
    row = F.struct(*cols)
    return (
        both.groupBy(*keys)
        .agg(F.max_by(row, order).alias("new"), F.min_by(row, order).alias("old"))
        .select(*keys, *[F.col(f"old.{c}" if c in keep_first else f"new.{c}").alias(c) for c in cols])
    )


def replace_by_key(existing: DataFrame, replaced: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Delete every row of the replaced keys, then add the new rows; a key without rows is wiped."""
    kept = existing.join(replaced.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rows.join(replaced.select(key).distinct(), key, "left_semi"))


def replace_unless_empty(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace by key, but a key whose new result has no rows keeps what it had."""
    return side_by_side(existing, rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    gone = deleted.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def final_or_all(segments: DataFrame) -> DataFrame:
    """Final rows of a meeting; if it has none, all its rows."""
    has = segments.groupBy("meeting_id").agg(F.max(~F.col("provisional")).alias("_final"))
    return segments.join(has, "meeting_id").where(~F.col("provisional") | ~F.col("_final")).drop("_final")


def edit_texts(segments: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (meeting_id, segment_id, new_text): returns the edited table and the refused edits.

    Rows that show the same overlap (equal span and text) take the edit together.
    """
    e = edits.withColumn("new_text", strip(F.col("new_text")))
    hit = e.join(
        segments.select("meeting_id", "segment_id", "provisional", "is_overlap", "start_ms", "end_ms", "text"),
        ["meeting_id", "segment_id"], "left",
    )
    error = (
        F.when(F.col("new_text") == "", "text must not be empty")
        .when(F.col("provisional").isNull(), "segment not found")
        .when(F.col("provisional"), "provisional segments cannot be edited")
    )
    hit = hit.withColumn("error", error)
    ok = hit.where(F.col("error").isNull())
    span = ["meeting_id", "start_ms", "end_ms", "text"]
    # Several edits of one card: the one of the last segment id wins.
    shared = ok.where("is_overlap").groupBy(*span).agg(F.max_by("new_text", "segment_id").alias("_peer_text"))
    own = ok.where(~F.col("is_overlap")).select("meeting_id", "segment_id", F.col("new_text").alias("_own_text"))
    peers = shared.withColumn("_open", F.lit(True))
    joined = (
        segments.withColumn("_open", F.col("is_overlap") & ~F.col("provisional"))
        .join(peers, [*span, "_open"], "left")
        .join(own, ["meeting_id", "segment_id"], "left")
    )
    edited = joined.withColumn("text", F.coalesce("_own_text", "_peer_text", "text")).select(*segments.columns)
    return edited, hit.where(F.col("error").isNotNull()).select("meeting_id", "segment_id", "error")


def overlap_cards(segments: DataFrame) -> DataFrame:
    """Overlap rows with one span and text become one card with all their speakers."""
    shared = segments.where("is_overlap")
    cards = shared.groupBy("meeting_id", "start_ms", "end_ms", "text").agg(
        F.min_by("overlap_speakers", "speaker_id").alias("named"),
        F.array_sort(F.collect_set("speaker_id")).alias("peers"),
    )
    cards = cards.select(
        "meeting_id", "start_ms", "end_ms", "text", F.lit("overlap").alias("kind"),
        F.array_distinct(F.concat("named", "peers")).alias("speakers"),
    )
    singles = segments.where(~F.col("is_overlap")).select(
        "meeting_id", "start_ms", "end_ms", "text", F.lit("single").alias("kind"), F.array("speaker_id").alias("speakers")
    )
    return cards.unionByName(singles)


def public_users(users: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.substring_index("email", "@", 1))
    return users.select("user_id", F.col("email").alias("owner_email"), name.alias("owner_name"))


def with_owner(meetings: DataFrame, users: DataFrame) -> DataFrame:
    return meetings.join(public_users(users), "user_id", "left")


def with_recording(meetings: DataFrame, listing: DataFrame) -> DataFrame:
    """Flag meetings for which a non-empty recording file exists."""
    size = listing.groupBy("meeting_id").agg(F.max("length").alias("_size"))
    return meetings.join(size, "meeting_id", "left").withColumn(
        "has_recording", F.coalesce(F.col("_size") > 0, F.lit(False))
    ).drop("_size")


def monitor(meetings: DataFrame, users: DataFrame, minutes: DataFrame, insights: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per meeting with its owner and what exists for it.

    The segments stay a table of their own (join on meeting_id); here they are only counted,
    since the transcript of a meeting has no bound.
    """
    counts = segments.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max("end_ms").alias("last_ms"))
    return (
        with_owner(meetings, users)
        .join(minutes, "meeting_id", "left")
        .join(insights, "meeting_id", "left")
        .join(counts, "meeting_id", "left")
        .fillna({"n_segments": 0, "last_ms": 0})
    )


def page(df: DataFrame, by: list[str], newest: str, tie: str, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """The same page of every group, newest first; Spark keeps only the top rows before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.col(newest).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= offset + limit).where(F.col("rank") > offset)


def newest_page(df: DataFrame, newest: str, tie: str, limit: int = ADMIN_PAGE, offset: int = 0) -> DataFrame:
    return df.orderBy(F.col(newest).desc(), F.col(tie)).offset(offset).limit(limit)


def session_stats(calls: DataFrame, meetings: DataFrame) -> DataFrame:
    """Call counters per meeting; zeros for meetings without calls.

    `calls` has meeting_id, ok, ms, cache_hit, timed, speaker_id.
    """
    per_speaker = calls.groupBy("meeting_id", "speaker_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.sum(F.col("ms").cast("decimal(18,6)")).alias("ms"),
        F.count_if("cache_hit").alias("hits"), F.count_if("timed").alias("timed"),
    )
    per_meeting = per_speaker.groupBy("meeting_id").agg(
        F.sum("n").alias("calls"), F.sum("bad").alias("dropped"), F.sum("ms").alias("ms"),
        F.sum("hits").alias("cache_hits"), F.sum("timed").alias("with_timings"),
        F.array_sort(F.collect_list("speaker_id")).alias("speaker_ids"),
    )
    out = meetings.select("meeting_id").join(per_meeting, "meeting_id", "left")
    out = out.fillna({"calls": 0, "dropped": 0, "cache_hits": 0, "with_timings": 0})
    return out.select(
        "meeting_id", "calls", "dropped", F.coalesce(F.round("ms", 1).cast("double"), F.lit(0.0)).alias("total_ms"), "cache_hits",
        (F.col("calls") - F.col("cache_hits")).alias("cache_misses"),
        F.round(F.when(F.col("calls") > 0, F.col("cache_hits") / F.col("calls")), 3).alias("cache_hit_rate"),
        "with_timings",
        F.coalesce("speaker_ids", F.array().cast("array<string>")).alias("speaker_ids"),
    )


def sample_spans(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """A span to play for every speaker: the longest turn alone, else the longest segment alone."""

    def longest(df: DataFrame, prefix: str) -> DataFrame:
        alone = df.where(~F.col("is_overlap") & (F.col("end_ms") > F.col("start_ms")))
        best = F.min(F.struct((F.col("start_ms") - F.col("end_ms")).alias("neg"), "start_ms", "end_ms"))
        return alone.groupBy("meeting_id", "speaker_id").agg(best.alias(prefix))

    both = longest(intervals, "_i").join(longest(segments, "_s"), ["meeting_id", "speaker_id"], "full")
    start = F.coalesce("_i.start_ms", "_s.start_ms").cast("long")
    end = F.coalesce("_i.end_ms", "_s.end_ms").cast("long")
    return both.select(
        "meeting_id", "speaker_id", start.alias("sample_start_ms"), F.least(end, start + MAX_SAMPLE_MS).alias("sample_end_ms")
    )


def speaker_roster(meetings: DataFrame, intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """Speakers with something to play: `meetings` has has_recording and speaker_map."""
    final = segments.where(~F.col("provisional"))
    heard = (
        final.select("meeting_id", "speaker_id")
        .unionByName(final.select("meeting_id", F.explode("overlap_speakers").alias("speaker_id")))
        .unionByName(intervals.select("meeting_id", "speaker_id"))
        .where(F.col("speaker_id") != "")
        .distinct()
    )
    custom = F.element_at("speaker_map", F.col("speaker_id"))
    return (
        heard.join(sample_spans(intervals, final), ["meeting_id", "speaker_id"])
        .join(meetings.where("has_recording").select("meeting_id", "speaker_map"), "meeting_id")
        .select(
            "meeting_id", "speaker_id", F.coalesce(F.nullif(custom, F.lit("")), default_label(F.col("speaker_id"))).alias("label"),
            "sample_start_ms", "sample_end_ms",
        )
    )


def attendees(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """Names in order of first appearance, then the remaining mapped names; else the participants.

    `meetings` has speaker_map and participants.  Only one row per (meeting, speaker) is gathered.
    """
    empty = F.array().cast("array<string>")
    ids = segments.select(
        "meeting_id", "start_ms", "segment_id",
        F.posexplode(F.concat(F.array("speaker_id"), F.coalesce("overlap_speakers", empty))).alias("place", "sid"),
    )
    first = ids.where(strip(F.col("sid")) != "").groupBy("meeting_id", strip(F.col("sid")).alias("sid")).agg(
        F.min(F.struct("start_ms", "segment_id", "place")).alias("seen")
    )
    order = first.groupBy("meeting_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "sid"))), lambda x: x["sid"]).alias("ids")
    )
    m = meetings.join(order, "meeting_id", "left").withColumn("ids", F.coalesce("ids", empty))
    names = F.concat(
        F.transform("ids", lambda s: F.element_at(F.col("speaker_map"), s)), F.map_values("speaker_map")
    )
    tidy = lambda arr: F.array_distinct(
        F.filter(F.transform(arr, strip), lambda n: n != "")
    )
    m = m.withColumn("_named", tidy(names))
    return m.select(
        "meeting_id",
        F.when(F.size("_named") > 0, F.col("_named")).otherwise(tidy(F.coalesce("participants", empty))).alias("attendees"),
    )


def with_cached(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Add request_hash, hit and the stored result (null on a miss); `cache` has one row per hash."""
    content = F.md5(F.concat(*[F.col(k).cast("binary") for k in key]))
    known = cache.withColumn("hit", F.lit(True))
    return requests.withColumn("request_hash", content).join(known, "request_hash", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def to_do(answered: DataFrame) -> DataFrame:
    """One request per content that the cache did not know."""
    return answered.where(~F.col("hit")).dropDuplicates(["request_hash"])


def progress(windows: DataFrame) -> DataFrame:
    return windows.groupBy("meeting_id").agg(F.count_if("done").alias("done"), F.count(F.lit(1)).alias("total"))


def heal_orphans(meetings: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """Stop meetings that are recording or processing in no live session; nothing else changes."""
    m = meetings.join(live.select("meeting_id").distinct().withColumn("_live", F.lit(True)), "meeting_id", "left")
    orphan = F.col("status").isin(ACTIVE) & F.col("_live").isNull()
    return (
        m.withColumn("stopped_at", F.when(orphan, F.coalesce("stopped_at", now)).otherwise(F.col("stopped_at")))
        .withColumn("status", F.when(orphan, "stopped").otherwise(F.col("status")))
        .drop("_live")
    )


def lifecycle(log: DataFrame) -> DataFrame:
    """Status of every meeting after its commands (meeting_id, at, command), `at` unique per meeting.

    start -> recording; stop: recording -> processing; done: processing -> stopped;
    cancel: recording or processing -> created, with the data wiped, otherwise nothing;
    minutes -> stopped.  Only the last start or minutes matters, then the first stop or cancel
    after it, then the first done or cancel after that: plain aggregates, no ordered scan.
    """
    at, cmd = F.col("at"), F.col("command")
    reset = log.groupBy("meeting_id").agg(
        F.max_by(cmd, F.when(cmd.isin("start", "minutes"), at)).alias("last"),
        F.max(F.when(cmd.isin("start", "minutes"), at)).alias("since"),
    )
    later = log.join(reset.where(F.col("last") == "start"), "meeting_id").where(at > F.col("since"))
    stop = later.groupBy("meeting_id").agg(
        F.min(F.when(cmd == "stop", at)).alias("stopped"), F.min(F.when(cmd == "cancel", at)).alias("cancelled")
    )
    halted = stop.where(F.col("stopped").isNotNull() & (F.col("cancelled").isNull() | (F.col("stopped") < F.col("cancelled"))))
    end = (
        log.where(cmd.isin("done", "cancel"))
        .join(halted.select("meeting_id", "stopped"), "meeting_id")
        .where(at > F.col("stopped"))
        .groupBy("meeting_id")
        .agg(F.min_by(cmd, at).alias("ended"))
    )
    m = reset.join(stop, "meeting_id", "left").join(end, "meeting_id", "left")
    was_stopped = F.col("stopped").isNotNull() & (F.col("cancelled").isNull() | (F.col("stopped") < F.col("cancelled")))
    status = (
        F.when(F.col("last").isNull(), "created")
        .when(F.col("last") == "minutes", "stopped")
        .when(was_stopped & (F.col("ended") == "done"), "stopped")
        .when(was_stopped & (F.col("ended") == "cancel"), "created")
        .when(was_stopped, "processing")
        .when(F.col("cancelled").isNotNull(), "created")
        .otherwise("recording")
    )
    return m.select("meeting_id", status.alias("status"), (F.col("last").isNotNull() & (status == "created")).alias("wiped"))


def drop_late_provisional(windows: DataFrame, stops: DataFrame) -> DataFrame:
    """Flag rows to use: late windows are welcome in any order, provisional ones only before the stop."""
    stop = stops.groupBy("meeting_id").agg(F.max("stopped_at").alias("_stop"))
    return windows.join(stop, "meeting_id", "left").withColumn(
        "used", ~F.col("provisional") | F.col("_stop").isNull() | (F.col("at") <= F.col("_stop"))
    ).drop("_stop")
