"""From a transcript to model prompts and from partial extracts to one set of minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import documents as doc, text as tx
from parley.operators.packing import fold_overflow, split_lines
from parley.plans.slabs import Run, running, slab_of

# Budgets of one extraction call.
MAX_CHARS, MAX_PARTS = 40_000, 4
SYSTEM_TOKENS, WRAPPER_TOKENS, COMPLETION_TOKENS = 650, 120, 1536


def clock(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    two = lambda n: F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 60)), two(s % 60))


def transcript_lines(segments: DataFrame, meetings: DataFrame) -> DataFrame:
    """`[mm:ss-mm:ss] label: text` for every utterance, overlaps once with all their speakers.

    One row per line of text with its place; a whole transcript is never built in one row.
    `meetings` has speaker_map.
    """
    s = segments.join(meetings.select("meeting_id", "speaker_map"), "meeting_id", "left")
    label = lambda sid: F.coalesce(F.element_at(F.col("speaker_map"), sid), sid)
    names = F.when(F.size("overlap_speakers") > 0, F.col("overlap_speakers")).otherwise(F.array("speaker_id"))
    who = F.when(
        F.col("is_overlap"), F.concat(F.array_join(F.transform(names, label), " + "), F.lit(" [OVERLAP]"))
    ).otherwise(label(F.col("speaker_id")))
    s = s.withColumn(
        "line", F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("-"), clock(F.col("end_ms")), F.lit("] "), who, F.lit(": "), "text")
    )
    order = F.struct("start_ms", "segment_id")
    shared = s.where("is_overlap").groupBy("meeting_id", "start_ms", "end_ms", "text").agg(
        F.min("segment_id").alias("segment_id"), F.min_by("line", order).alias("line")
    )
    one = s.where(~F.col("is_overlap")).select("meeting_id", "start_ms", "segment_id", "line").unionByName(
        shared.select("meeting_id", "start_ms", "segment_id", "line")
    )
    split = one.select("meeting_id", "start_ms", "segment_id", F.posexplode(F.split("line", "\n")).alias("sub", "line"))
    placed = running(
        split.withColumn("_slab", slab_of(F.col("start_ms"))), ["meeting_id"], "_slab", ["start_ms", "segment_id", "sub"],
        [Run("line_no", "sum", F.lit(1))],
    )
    return placed.select("meeting_id", F.col("line_no").cast("long").alias("line_no"), "line")


def speech_status(segments: DataFrame) -> DataFrame:
    """Whether a meeting holds speech, only noise, or nothing: decides if a model is asked at all."""
    s = segments.select("meeting_id", "text", tx.speech_text(F.col("text")).alias("_speech"))
    chars = F.sum(F.length("_speech")) + F.count_if(F.col("_speech") != "") - 1
    return s.groupBy("meeting_id").agg(
        F.when(~F.max(tx.strip(F.col("text")) != ""), "empty").when(chars >= 2, "speech").otherwise("noise").alias("status")
    )


def chunk_chars(max_chars: int = MAX_CHARS) -> int:
    fit = tx.CONTEXT_TOKENS - SYSTEM_TOKENS - WRAPPER_TOKENS - COMPLETION_TOKENS - tx.RESERVE_TOKENS
    return min(max_chars, int(max(256, fit) * tx.CHARS_PER_TOKEN))


def prompt_parts(
    lines: DataFrame, attendees: DataFrame, limit: int | None = None, max_parts: int = MAX_PARTS
) -> DataFrame:
    """Chunks ready for an extraction model: (meeting_id, part, chunk) with text, attendees and token cap.

    A chunk is bounded by `limit`.  Where a meeting has more chunks than `max_parts`, the last
    part consists of several chunks, to be joined by newlines; nothing is lost or gathered.
    """
    chunks = fold_overflow(split_lines(lines, "meeting_id", "line_no", "line", limit or chunk_chars()), max_parts)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "piece", "text")))
    text = chunks.groupBy("meeting_id", "part", "chunk").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("chunk_text")
    )
    total = text.groupBy("meeting_id").agg(F.max("part").alias("total"))
    p = text.join(total, "meeting_id").join(attendees, "meeting_id", "left")
    names = F.coalesce(F.nullif(F.array_join("attendees", ", "), F.lit("")), F.lit("(unknown)"))
    used = F.lit(SYSTEM_TOKENS + WRAPPER_TOKENS) + tx.message_tokens(F.concat(names, "chunk_text"))
    return p.select(
        "meeting_id", "part", "chunk", "total", names.alias("attendees"), "chunk_text",
        tx.completion_cap(used, COMPLETION_TOKENS).alias("completion_cap"),
    )


def merge_heads(partials: DataFrame, slab: int = 10_000) -> DataFrame:
    """First non-blank subject, date and place by part, and the joined summaries, cut at the limit.

    The cut summary is for reports; `merge_summaries` has all of them.
    """

    def first(value: Column) -> Column:
        v = tx.strip(value)
        return F.coalesce(F.min_by(v, F.when(v != "", F.col("part"))), F.lit(""))

    hint = F.coalesce(F.nullif(F.col("subject_hint"), F.lit("")), F.col("subject"))
    head = partials.groupBy("meeting_id").agg(
        first(hint).alias("subject"), first(F.col("meeting_date")).alias("meeting_date"), first(F.col("location")).alias("location")
    )
    # Only summaries that start within the limit, or right behind it, decide the result: gather no others.
    said = partials.select("meeting_id", "part", tx.strip(F.col("summary")).alias("s")).where("s <> ''")
    placed = running(
        said.withColumn("_slab", slab_of(F.col("part"), slab)), ["meeting_id"], "_slab", ["part"],
        [Run("_upto", "sum", F.length("s") + 1)],
    ).where(F.col("_upto") - F.length("s") - 1 <= doc.SUMMARY_LIMIT + 1)
    joined = placed.groupBy("meeting_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]), " ").alias("summary")
    )
    cut = F.concat(F.regexp_replace(F.left("summary", F.lit(doc.SUMMARY_LIMIT - 3)), r"[\s\p{Z}]+$", ""), F.lit("…"))
    return head.join(joined, "meeting_id", "left").withColumn(
        "summary", F.coalesce(F.when(F.length("summary") > doc.SUMMARY_LIMIT, cut).otherwise(F.col("summary")), F.lit(""))
    )


def merge_summaries(partials: DataFrame) -> DataFrame:
    """The whole summary of every part that has one, one row each: (meeting_id, part, summary), read by part."""
    return partials.select("meeting_id", "part", tx.strip(F.col("summary")).alias("summary")).where("summary <> ''")


def merge_decisions(partials: DataFrame, attendees: DataFrame) -> DataFrame:
    """Decisions of all parts, the first of equal descriptions kept, in order of appearance.

    Case is folded by lower(upper()), so that letters with several capital forms are equal too.
    """
    p = partials.join(attendees, "meeting_id", "left").withColumn(
        "attendees", F.coalesce("attendees", F.array().cast("array<string>"))
    )
    items = p.select(
        "meeting_id", "part", F.posexplode(doc.normal_decisions(F.col("decisions"), F.col("attendees"))).alias("pos", "d")
    )
    return items.groupBy("meeting_id", F.lower(F.upper("d.description")).alias("_key")).agg(
        F.min(F.struct("part", "pos")).alias("seen"), F.min_by("d", F.struct("part", "pos")).alias("d")
    ).select("meeting_id", "seen.part", "seen.pos", "d.description", "d.executor", "d.due_date", "d.status")


def minutes(
    partials: DataFrame, attendees: DataFrame, status: DataFrame
) -> DataFrame:
    """One head row per meeting; decisions and whole summaries stay tables (see merge_decisions, merge_summaries)."""
    heads = merge_heads(partials)
    n = merge_decisions(partials, attendees).groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_decisions"))
    m = status.join(heads, "meeting_id", "left").join(n, "meeting_id", "left").join(attendees, "meeting_id", "left")
    count = F.coalesce("n_decisions", F.lit(0))
    summary = (
        F.when(F.col("status") == "empty", doc.EMPTY_SUMMARY)
        .when(F.col("status") == "noise", doc.NOISE_SUMMARY)
        .when((F.coalesce("summary", F.lit("")) == "") & (count == 0), doc.MINUTES_FALLBACK)
        .otherwise(F.coalesce("summary", F.lit("")))
    )
    speech = F.col("status") == "speech"
    blank = lambda c: F.when(speech, F.coalesce(c, F.lit(""))).otherwise("")
    return m.select(
        "meeting_id", blank("subject").alias("subject"), blank("meeting_date").alias("meeting_date"),
        blank("location").alias("location"), "attendees", summary.alias("summary"),
        F.when(speech, count).otherwise(0).alias("n_decisions"),
    )
