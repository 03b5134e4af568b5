"""Speaker ids, display labels and participant names, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.text import strip
from parley.plans.slabs import Run, in_ranges, running

# ---- fixed values: name patterns that define the results ----------------------
YOU_TAG = r"(?i)\s*\(you\)\s*"
PRESENTATION = r"(?i)'s presentation.*$"
PARTICIPANT_PREFIX = r"(?i)^Participant:\s*"
NOT_A_NAME = [
    r"[/\\]",
    r"(?i)^(spaces|devices|meetings|users)\b",
    r"^[0-9]+$",
    r"(?i)^participant\s*[0-9]*$",
    r"(?i)^(you|yourself|me)$",
    r"(?i)^(this call|meeting details|call feature|more activities|notifications|anyone|google meet|turn on|turn off"
    r"|mute|unmute|camera|microphone|mic|chat|people|captions|present|share|leave|hand|host|options|settings"
    r"|activities|open to|joining|invite|copy|link|info|details|action|button|menu|panel|tab|dialog"
    r"|your presentation|presentation)",
]
NAME_WORDS, NAME_MIN, NAME_MAX = 6, 2, 64
# ---- end of fixed values --------------------------------------------------------


def participant_id(raw: Column) -> Column:
    """A speaker id from an outside participant id; null when there is none."""
    value = strip(raw)
    safe = F.concat(F.lit("SPEAKER_"), F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_"))
    return F.when(value == "", F.lit(None)).when(value.startswith("SPEAKER_"), value).otherwise(safe)


def model_speaker(label: Column) -> Column:
    """A speaker id from a model's label: its number, else a number hashed from the label.

    The hash is md5 based, so that it is the same in every run.
    """
    digits = F.regexp_replace(label, r"[^0-9]", "")
    hashed = F.conv(F.substring(F.md5(label.cast("binary")), 1, 8), 16, 10).cast("long") % 100
    number = F.when(digits != "", digits.cast("decimal(38,0)")).otherwise(hashed.cast("decimal(38,0)"))
    text = number.cast("string")
    return F.when(label.startswith("SPEAKER_"), label).otherwise(
        F.concat(F.lit("SPEAKER_"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))
    )


def default_label(speaker: Column) -> Column:
    digits = F.regexp_replace(speaker, r"[^0-9]", "")
    return F.when(digits == "", "Speaker").otherwise(
        F.concat(F.lit("Speaker "), (F.when(digits != "", digits).cast("decimal(38,0)") + 1).cast("string"))
    )


def display_label(speaker: Column, names: Column) -> Column:
    """The given name, else "Speaker n+1" from a trailing number, else the id itself."""
    tail = F.regexp_extract(speaker, r"([0-9]+)\s*$", 1)
    numbered = F.concat(F.lit("Speaker "), (F.when(tail != "", tail).cast("decimal(38,0)") + 1).cast("string"))
    return F.coalesce(
        F.nullif(F.element_at(names, speaker), F.lit("")),
        numbered,
        F.when(speaker == "", "Speaker").otherwise(speaker),
    )


def clean_name(raw: Column) -> Column:
    """A participant name without interface dressing; null when it is not a name."""
    t = strip(raw)
    t = F.regexp_replace(t, YOU_TAG, " ")
    t = F.regexp_replace(t, PRESENTATION, "")
    t = F.regexp_replace(t, PARTICIPANT_PREFIX, "")
    t = strip(F.regexp_replace(strip(F.substring_index(t, ",", 1)), r"[\s\p{Z}]+", " "))
    bad = (F.length(t) < NAME_MIN) | (F.length(t) > NAME_MAX) | (F.size(F.split(t, " ")) > NAME_WORDS)
    for pattern in NOT_A_NAME:
        bad = bad | t.rlike(pattern)
    return F.when(~bad, t)


def prefer_longer_names(names: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Drop names that begin a longer one of the same meeting, whatever their case.

    In sorted order everything a name begins follows it directly, so looking at the
    next name is enough and no pairs are formed.  Slabs are ranges of names of about equal
    numbers, found by a sample, whatever letters the names begin with.
    """
    low = F.lower(F.col(name))
    one = names.where(F.col(name) != "").groupBy(key, low.alias("_low")).agg(F.min_by(name, order).alias(name))
    nxt = running(in_ranges(one, [key, "_low"]), [key], "_slab", ["_low"], [Run("_next", "next", F.col("_low"))])
    kept = nxt.where(F.col("_next").isNull() | ~F.startswith("_next", F.col("_low")))
    return kept.select(key, name)
