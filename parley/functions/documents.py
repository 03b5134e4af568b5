"""Minutes, insights, speaker maps and model answers as columns over JSON, maps and arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parley.functions.names import participant_id
from parley.functions.text import strip

# ---- fixed values: texts that stand in for a missing summary --------------------
EMPTY_SUMMARY = "There is no transcribed text to analyse."
NOISE_SUMMARY = (
    "There is no meaningful text to analyse (only non-speech markers or ambient sound were captured)."
)
MINUTES_FALLBACK = (
    "Not enough content was extracted to draft the minutes. You can fill the fields in by hand."
)
INSIGHTS_FALLBACK = (
    "No content analysis could be extracted from the transcript. "
    "If the text is too sparse, record or upload the meeting again."
)
SUMMARY_LIMIT = 1200
# ---- end of fixed values ----------------------------------------------------------


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def known_or(value: Column, known: list[str], default: str) -> Column:
    return F.when(value.isin(known), value).otherwise(default)


def text_list(value: Column) -> Column:
    """A variant as a list of texts: null is empty, a text is a list of one, list items are trimmed."""
    kind = F.schema_of_variant(value)
    items = F.transform(F.try_variant_get(value, "$", "array<string>"), strip)
    one = F.try_variant_get(value, "$", "string")
    empty = F.array().cast("array<string>")
    return (
        F.when(value.isNull() | F.is_variant_null(value), empty)
        .when(kind == "STRING", F.when(strip(one) != "", F.array(one)).otherwise(empty))
        .when(kind.startswith("ARRAY"), F.filter(items, lambda s: s.isNotNull() & (s != "")))
        .otherwise(F.array(one))
    )


def model_answer(raw: Column) -> Column:
    """A model's answer as a variant: fenced or embedded JSON is found, plain text becomes the summary."""
    t = strip(raw)
    fence = F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1)
    body = F.when(t.rlike(r"```(?:json)?\s*[\s\S]*?```"), strip(fence)).otherwise(t)
    embedded = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    plain = F.parse_json(F.to_json(F.struct(body.alias("summary"))))
    return F.when(t == "", F.parse_json(F.lit("{}"))).otherwise(
        F.coalesce(F.try_parse_json(body), F.try_parse_json(F.when(embedded != "", embedded)), plain)
    )


def normal_decisions(decisions: Column, attendees: Column) -> Column:
    """Trim, drop blank descriptions, blank out executors that did not attend, default status pending."""

    def clean(d: Column) -> Column:
        who, status = strip(d["executor"]), strip(d["status"])
        return F.struct(
            strip(d["description"]).alias("description"),
            F.when(F.array_contains(attendees, who), who).otherwise("").alias("executor"),
            strip(d["due_date"]).alias("due_date"),
            F.when(status == "", "pending").otherwise(status).alias("status"),
        )

    return F.filter(F.transform(decisions, clean), lambda d: d["description"] != "")


def normal_secretary(secretary: Column, attendees: Column) -> Column:
    s = strip(secretary)
    return F.when(F.array_contains(attendees, s), s).otherwise("")


def minutes_summary(summary: Column, decisions: Column) -> Column:
    s = strip(summary)
    return F.when((s == "") & (F.size(decisions) == 0), MINUTES_FALLBACK).otherwise(s)


def patch_map(old: Column, new: Column) -> Column:
    """New non-blank names over the old ones."""
    pairs = F.filter(
        F.transform(F.map_entries(new), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value"))),
        lambda e: (e["key"] != "") & (e["value"] != ""),
    )
    fresh = last_wins(pairs)
    keep = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(keep, fresh)


def last_wins(entries: Column) -> Column:
    """A map from (key, value) entries; a repeated key keeps its place and takes its last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(
                k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")
            ),
        )
    )


def stream_map(streams: Column, stream_names: Column) -> Column:
    """Speaker id to name from a list of {speaker_id or id, name or label} and an id-to-name map."""
    listed = F.transform(
        streams,
        lambda s: F.struct(
            strip(F.coalesce(F.nullif(s["speaker_id"], F.lit("")), s["id"])).alias("key"),
            strip(F.coalesce(F.nullif(s["name"], F.lit("")), s["label"])).alias("value"),
        ),
    )
    mapped = F.transform(
        F.map_entries(stream_names),
        lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value")),
    )
    given = F.filter(F.concat(listed, mapped), lambda e: (e["key"] != "") & (e["value"] != ""))
    by_id = F.map_entries(last_wins(given))
    return last_wins(
        F.transform(by_id, lambda e: F.struct(participant_id(e["key"]).alias("key"), e["value"].alias("value")))
    )
