"""Driver tables seen as conversation tables (meetings, turns, windows, frames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.functions import text as tx
from parley.plans.carry import dealt
from parley.plans.slabs import Run, running, slab_of

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, if fewer files than cores hold them.

    Splits don't tell: a file may be one row group, which one of its splits reads whole while the others read nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(2 * cores, 2 * df.rdd.getNumPartitions()))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: one meeting per day of events, one speaker per event type."""
    ts = F.col("ts").cast("timestamp")
    start = (F.unix_millis(ts) % DAY_MS).cast("int")
    return table(spark, sf_dir, "events").select(
        F.date_format(ts, "yyyy-MM-dd").alias("meeting_id"),
        F.concat(F.lit("SPEAKER_"), "event_type").alias("speaker_id"),
        start.alias("start_ms"),
        (start + F.round(F.col("value") * 1000).cast("int")).alias("end_ms"),
        F.lit(False).alias("is_overlap"),
        F.col("event_id").alias("interval_id"),
    )


def role_speaker(role: Column) -> Column:
    return (
        F.when(role == "user", "SPEAKER_00")
        .when(role == "assistant", "SPEAKER_01")
        .otherwise("SPEAKER_02")
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of a conversation laid out in time, 60 ms a character."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        F.col("conv_id").cast("string").alias("meeting_id"),
        "conv_id",
        "turn",
        role_speaker(F.col("role")).alias("speaker_id"),
        "text",
        (F.length("text") * 60).cast("long").alias("dur"),
        slab_of(F.col("turn"), 10_000).alias("_slab"),
    )
    timed = running(rows, ["meeting_id"], "_slab", ["turn"], [Run("_end", "sum", F.col("dur"))])
    return timed.select(
        "meeting_id",
        F.concat_ws("-", "conv_id", "turn").alias("segment_id"),
        "conv_id",
        "turn",
        "speaker_id",
        (F.col("_end") - F.col("dur")).alias("start_ms"),
        F.col("_end").alias("end_ms"),
        "text",
        F.lit(False).alias("is_overlap"),
        (F.col("turn") % 5 == 4).alias("provisional"),
        F.array().cast("array<string>").alias("overlap_speakers"),
    )


def overlap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utterances, every third one spoken by two people at once (one row each)."""
    s = segments(spark, sf_dir)
    other = F.when(F.col("speaker_id") == "SPEAKER_00", "SPEAKER_01").otherwise("SPEAKER_00")
    both = F.array("speaker_id", other)
    shared = F.col("turn") % 3 == 1
    return s.withColumn("both", F.when(shared, both).otherwise(F.array("speaker_id"))).select(
        "meeting_id", "segment_id", "conv_id", "turn", "start_ms", "end_ms", "text", "provisional",
        shared.alias("is_overlap"),
        F.when(shared, F.col("both")).otherwise(F.array().cast("array<string>")).alias("overlap_speakers"),
        F.posexplode("both").alias("copy", "speaker_id"),
    ).withColumn("segment_id", F.concat_ws("-", "segment_id", "copy"))


def stt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances placed on the day meetings of `intervals`."""
    s = segments(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int"))
    shift = (F.floor(F.col("conv_id") / 30) * 400_000) % 80_000_000
    return s.select(
        F.date_format(day, "yyyy-MM-dd").alias("meeting_id"),
        "conv_id",
        "turn",
        (F.col("start_ms") + shift).alias("start_ms"),
        (F.col("end_ms") + shift).alias("end_ms"),
        "text",
    )


def speech_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio-like samples: a user's events in order, one value per 100 ms."""
    e = table(spark, sf_dir, "events")
    ordered = e.select(
        F.col("user_id").cast("string").alias("meeting_id"),
        "ts",
        "event_id",
        "event_type",
        ((F.col("value") - 245) / 245).alias("x"),
        F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / DAY_MS).alias("_slab"),
        "value",
    )
    ranked = running(ordered, ["meeting_id"], "_slab", ["ts", "event_id"], [Run("_n", "sum", F.lit(1))])
    return ranked.select(
        "meeting_id",
        F.col("event_type").alias("stream_id"),
        (F.col("_n") - 1).cast("long").alias("frame_idx"),
        "x",
        "value",
        "event_id",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts from the utterances: hop variants, neighbours, light edits and cuts."""
    s = segments(spark, sf_dir).select("conv_id", "turn", "meeting_id", "text")
    s = running(
        s.withColumn("_slab", slab_of(F.col("turn"), 10_000)), ["meeting_id"], "_slab", ["turn"],
        [Run("after", "next", F.col("text"))],
    )
    # Comparing two texts takes far longer than moving them.
    s = dealt(s).withColumn("w", tx.words(F.col("text"))).withColumn("n", F.size("w"))

    def part(first: Column, count: Column) -> Column:
        return F.array_join(F.slice("w", first + 1, count), " ")

    def tenth(k: int) -> Column:
        return F.floor(F.col("n") * k / 10).cast("int")

    edited = F.array_join(F.filter("w", lambda x, i: i % 7 != 6), " ")
    pairs = F.array(
        F.struct(F.lit("hop").alias("kind"), part(F.lit(0), tenth(6)).alias("a"), part(tenth(3), tenth(6)).alias("b")),
        F.struct(F.lit("next").alias("kind"), F.col("text").alias("a"), F.coalesce("after", F.lit("")).alias("b")),
        F.struct(F.lit("edit").alias("kind"), F.col("text").alias("a"), edited.alias("b")),
        F.struct(F.lit("cut").alias("kind"), F.col("text").alias("a"), part(F.lit(0), tenth(3)).alias("b")),
    )
    return s.select("conv_id", "turn", F.inline(pairs))


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in several spoiled forms, as a recogniser would spoil them."""
    d = documents(spark, sf_dir).withColumn("w", tx.words(F.col("text")))
    first = F.coalesce(F.get("w", F.lit(0)), F.lit("x"))
    tag = F.element_at(F.array(*[F.lit(x) for x in TAGS]), (F.col("doc_id") % len(TAGS) + 1).cast("int"))
    forms = F.array(
        F.struct(F.lit("plain").alias("form"), F.col("text").alias("text"), F.lit("en").alias("language")),
        F.struct(F.lit("tag").alias("form"), tag.alias("text"), F.lit("en").alias("language")),
        F.struct(
            F.lit("tagged").alias("form"), F.concat_ws(" ", tag, "text").alias("text"), F.lit("fa").alias("language")
        ),
        F.struct(
            F.lit("loop").alias("form"),
            F.repeat(F.concat(first, F.lit(" ")), (F.col("doc_id") % 12 + 1).cast("int")).alias("text"),
            F.lit("en").alias("language"),
        ),
        F.struct(
            F.lit("script").alias("form"),
            F.translate("text", "aeiounrst", "ایهوینرست").alias("text"),
            F.lit("fa").alias("language"),
        ),
        F.struct(
            F.lit("script2").alias("form"),
            F.translate("text", "aeiou", "ایهوی").alias("text"),
            F.lit("fa").alias("language"),
        ),
    )
    return d.select("doc_id", F.inline(forms))


TAGS = ["(Coughs)", "[ blank_audio ]", "Music", "♪ music ♪", "(Clearing  throat)", "...", "?", "", "(door slams)",
        "[Background_Music] Thanks for watching", "Subscribe", "12 34", "music _ _ _ _", "music ، ، ، ،"]


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of `speech_frames`, numbered on their own in every stream of a meeting."""
    f = speech_frames(spark, sf_dir).withColumn("_slab", slab_of(F.col("frame_idx"), 50_000))
    ranked = running(f, ["meeting_id", "stream_id"], "_slab", ["frame_idx"], [Run("_n", "sum", F.lit(1))])
    return ranked.select("meeting_id", "stream_id", (F.col("_n") - 1).cast("long").alias("frame_idx"), "x", "value", "event_id")


def hypothesis_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second opinion on `intervals`: every seventh turn late, and partly under another name."""
    moved = F.col("interval_id") % 7 == 0
    return intervals(spark, sf_dir).withColumn(
        "start_ms", F.when(moved, F.least(F.col("start_ms") + 250, F.col("end_ms"))).otherwise(F.col("start_ms"))
    ).withColumn(
        "speaker_id",
        F.when(moved & (F.col("speaker_id") == "SPEAKER_error"), "SPEAKER_view").otherwise(F.col("speaker_id")),
    )


def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance as three overlapping recognition windows with timed words."""
    s = stt_windows(spark, sf_dir).withColumn("w", tx.words(F.col("text")))
    n, length = F.size("w"), F.col("end_ms") - F.col("start_ms")
    tenth = lambda x, k: F.floor(x * k / 10)
    s = s.withColumn("n", n).withColumn("len", length)

    def hop(no: int, a: int, b: int) -> Column:
        first, last = tenth(F.col("n"), a), tenth(F.col("n"), b)
        part = F.slice("w", (first + 1).cast("int"), (last - first).cast("int"))
        timed = F.transform(
            part,
            lambda t, i: F.struct(
                t.alias("word"),
                (F.col("start_ms") + F.floor((first + i) * F.col("len") / F.col("n"))).alias("start_ms"),
                (F.col("start_ms") + F.floor((first + i + 1) * F.col("len") / F.col("n"))).alias("end_ms"),
            ),
        )
        return F.struct(
            F.lit(no).alias("hop"),
            (F.col("start_ms") + tenth(F.col("len"), a)).alias("hop_start"),
            (F.col("start_ms") + tenth(F.col("len"), b)).alias("hop_end"),
            F.array_join(part, " ").alias("hop_text"),
            timed.alias("words"),
        )

    hops = F.array(hop(0, 0, 6), hop(1, 3, 9), hop(2, 6, 10))
    return s.select("meeting_id", "conv_id", "turn", F.inline(hops)).select(
        "meeting_id", "conv_id", F.col("hop_start").alias("start_ms"), F.col("hop_end").alias("end_ms"),
        F.col("hop_text").alias("text"), "words", (F.col("turn") * 10 + F.col("hop")).alias("window_id"),
    )


def day_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utterances on the day meetings, with the same hop variants as separate segments."""
    h = hop_windows(spark, sf_dir)
    return h.select(
        "meeting_id", "conv_id", "start_ms", "end_ms", "text",
        F.concat(F.lit("SPEAKER_0"), (F.floor(F.col("window_id") / 10) % 2).cast("string")).alias("speaker_id"),
        F.lit(False).alias("is_overlap"), (F.col("window_id") % 10 == 0).alias("provisional"),
        F.array().cast("array<string>").alias("overlap_speakers"),
    )


def partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's partial extracts: one part per utterance, its sentences as decisions."""
    decision = lambda s: F.struct(
        s.alias("description"), F.concat(F.lit(" "), "role").alias("executor"), F.lit(" soon ").alias("due_date"),
        F.lit(" ").alias("status"),
    )
    late = F.col("turn") >= 2
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("meeting_id"),
        F.col("turn").alias("part"),
        F.when(F.col("turn") % 2 == 1, F.array_join(F.slice(tx.words(F.col("text")), 1, 3), " ")).otherwise("  ").alias("subject_hint"),
        F.concat(F.lit("S"), F.col("turn").cast("string")).alias("subject"),
        F.when(late, F.concat(F.lit(" day "), F.col("turn").cast("string"))).otherwise("").alias("meeting_date"),
        F.lit("").alias("location"),
        "text",
        F.when(F.col("role") == "system", " ").otherwise(F.col("text")).alias("summary"),
        F.transform(F.split("text", r"\."), decision).alias("decisions"),
    )
