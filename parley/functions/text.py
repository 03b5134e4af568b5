"""Column functions on transcript text.  All run inside the JVM.

Arguments that are used inside lambdas should be plain columns (select them
first), so that Spark evaluates them once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values -----------------------------------------------------------
# Patterns, word lists and label maps that define the results.
WORD = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"
NO_WORD = r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]"
SPACE = r"[\s\p{Z}]"
ONLY_PUNCT = r"^[\s\p{Z}.,!?;:\-—…\x{06D4}\x{061F}]+$"
ONLY_PUNCT_OR_QUOTES = r"^[\s\p{Z}.,!?;:\-—…\x{06D4}\x{061F}«»\"'()]+$"
BRACKETED = r"[(\[][^)\]]*[)\]]"
SOUND_CAPTION = r"(?i)\b(sound of a [\p{L}\p{N}_]+|background noise|music playing)\b"
LABEL_TAG = r"[(\[]\s*([a-zA-Z][a-zA-Z\s_]*)\s*[)\]]"
EVENT_TAG = r"[(\[【][^)\]】]*[)\]】]"
KEY_NOISE = r"[()\[\]【】♪♫.،,\s\p{Z}_\-]+"
PERSIAN_LETTERS = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیئآأإؤةىيۀك‌"
PERSIAN_LANGUAGES = ["fa", "fas", "per", "persian", "farsi"]
EVENT_LABELS = {
    "coughs": "cough",
    "coughing": "cough",
    "sighs": "sigh",
    "sighing": "sigh",
    "laughs": "laughter",
    "laughing": "laughter",
    "laugh": "laughter",
    "chuckle": "laughter",
    "giggle": "laughter",
    "sneezing": "sneeze",
    "sniffle": "sniff",
    "clearing throat": "clears throat",
    "breathing": "breath",
    "humming": "hum",
    "whistling": "whistle",
    "crying": "cry",
    "sobbing": "cry",
    "yawning": "yawn",
    "unintelligible": "inaudible",
    "blank_audio": "blank audio",
    "music playing": "music",
    "background music": "music",
}
BOILERPLATE = [
    "music",
    "music playing",
    "background music",
    "silence",
    "pause",
    "applause",
    "clapping",
    "subtitles",
    "subtitle",
    "thanks for watching",
    "thank you for watching",
    "subscribe",
    "like and subscribe",
    "inaudible",
    "unintelligible",
    "blank audio",
    "noise",
    "static",
]
SAME_JACCARD, SAME_CONTAINMENT = 0.40, 0.55
CHARS_PER_TOKEN, MESSAGE_TOKENS = 1.8, 4
CONTEXT_TOKENS, RESERVE_TOKENS, MIN_COMPLETION = 8192, 320, 256
# ---- end of fixed values ----------------------------------------------------

ALL_BOILERPLATE = sorted({*BOILERPLATE, *EVENT_LABELS.values()})


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Whitespace separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def _unify(text: Column) -> Column:
    """Drop joiners and use the Persian forms of yeh and kaf."""
    return F.translate(F.coalesce(text, F.lit("")), "يك‌‍", "یک")


def norm_tokens(text: Column) -> Column:
    return F.regexp_extract_all(_unify(text), F.lit(f"({WORD})"), F.lit(1))


def norm_token(token: Column) -> Column:
    return F.lower(F.regexp_replace(_unify(token), r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]+", ""))


def is_meaningful(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) >= 2) & ~t.rlike(ONLY_PUNCT) & t.rlike(r"\p{L}")


def speech_text(text: Column) -> Column:
    """Spoken words only: no bracketed tags, no sound captions, no punctuation."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), BRACKETED, " ")
    bare = F.regexp_replace(bare, SOUND_CAPTION, " ")
    return F.array_join(F.regexp_extract_all(bare, F.lit(f"({WORD})"), F.lit(1)), " ")


# ---- similarity of two texts, on their normalised tokens ---------------------


def jaccard(ta: Column, tb: Column, a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(ta, tb))
    same = (strip(a) == strip(b)) & (strip(a) != "")
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), same.cast("double")).otherwise(
        both / F.size(F.array_union(ta, tb))
    )


def containment(ta: Column, tb: Column, a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(ta, tb))
    smaller = F.least(F.size(F.array_distinct(ta)), F.size(F.array_distinct(tb)))
    return F.when(
        (F.size(ta) == 0) | (F.size(tb) == 0), (strip(a) == strip(b)).cast("double")
    ).otherwise(both / smaller)


def same_utterance(ta: Column, tb: Column, a: Column, b: Column) -> Column:
    na, nb = F.array_join(ta, " "), F.array_join(tb, " ")
    inside = (na != "") & (nb != "") & (F.contains(na, nb) | F.contains(nb, na))
    near = (jaccard(ta, tb, a, b) >= SAME_JACCARD) | (containment(ta, tb, a, b) >= SAME_CONTAINMENT)
    return (strip(a) != "") & (strip(b) != "") & (inside | near)


def tokens_close(a: Column, b: Column) -> Column:
    """Equal, nested with a small length gap, or at most two differing positions."""
    gap = F.abs(F.length(a) - F.length(b))
    nested = F.contains(a, b) | F.contains(b, a)
    differing = F.size(
        F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), lambda d: d)
    )
    return (
        F.when(a == b, True)
        .when((a == "") | (b == ""), False)
        .when(nested, gap <= F.greatest(F.lit(2), F.floor(F.length(a) / 3)))
        .otherwise((gap <= 2) & (differing <= 2))
    )


def edge_overlap(na: Column, nb: Column, limit: int = 16) -> Column:
    """Longest k with the last k tokens of `na` about equal to the first k of `nb`, else 0."""
    top = F.least(F.size(na), F.size(nb), F.lit(limit))

    def fits(k: Column) -> Column:
        hits = F.zip_with(F.slice(na, F.size(na) - k + 1, k), F.slice(nb, 1, k), tokens_close)
        share = F.size(F.filter(hits, lambda h: h)) / k
        return (share >= 0.6) & ((k >= 2) | (share >= 0.99))

    ks = F.when(top >= 1, F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(ks, fits)), F.lit(0))


def restated_prefix(na: Column, nb: Column, limit: int = 14) -> Column:
    """How many leading tokens of `nb` repeat what `na` (mostly its end) already says."""
    top = F.least(F.size(nb), F.lit(limit))
    tail = F.slice(na, F.greatest(F.size(na) - limit + 1, F.lit(1)), limit)

    def repeats(j: Column) -> Column:
        head = F.array_distinct(F.slice(nb, 1, j))
        n = F.size(head)
        return (F.size(F.array_intersect(head, tail)) / n >= 0.5) | (
            F.size(F.array_intersect(head, na)) / n >= 0.65
        )

    js = F.when((top >= 1) & (F.size(na) >= 1), F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.coalesce(F.array_max(F.filter(js, repeats)), F.lit(0))


# ---- repetition ---------------------------------------------------------------


def longest_run(toks: Column) -> Column:
    """Length of the longest run of one repeated token."""
    start = F.struct(
        F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(acc: Column, tok: Column) -> Column:
        run = F.when(tok == acc["prev"], acc["run"] + 1).otherwise(1)
        return F.struct(
            tok.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best")
        )

    return F.aggregate(toks, start, step, lambda acc: acc["best"])


def unique_ratio(toks: Column) -> Column:
    return F.when(F.size(toks) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(toks)) / F.size(toks))


def collapse_runs(toks: Column) -> Column:
    """Keep one token of every run."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))))
    pairs = F.arrays_zip(toks.alias("t"), before.alias("b"))
    return F.transform(
        F.filter(pairs, lambda p: ~p["t"].eqNullSafe(p["b"])), lambda p: p["t"]
    )


def loop_score(compact: Column) -> Column:
    """How much of a text without spaces is its first 2, 3 or 4 characters said over and over."""
    c = compact
    score = F.lit(0.0)
    for n in (4, 3, 2):
        reps = F.floor(F.length(F.regexp_extract(c, f"(?s)^(.{{{n}}})\\1*+", 0)) / n)
        loops = (F.length(c) >= 4 * n) & (reps >= 5) & (reps * n >= F.length(c) * 0.7)
        score = F.when(loops, F.least(F.lit(1.0), reps / 8.0)).otherwise(score)
    return F.when(F.length(c) < 8, F.lit(0.0)).otherwise(score)


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def may_loop(text: Column) -> Column:
    """False only for texts with a loop score of 0: their first characters are not said five times in a row."""
    begins = compact(F.substring(text, 1, 64))
    return (F.length(begins) < 20) | begins.rlike(r"(?s)^(?:(.{4})\1{4}|(.{3})\2{4}|(.{2})\3{4})")


# ---- event tags and boilerplate -------------------------------------------------


def canonical_events(text: Column) -> Column:
    """Write the known event tags one way: "(Coughs)" and "[coughing]" become "(cough)"."""
    out = F.coalesce(text, F.lit(""))
    for target in dict.fromkeys(EVENT_LABELS.values()):
        labels = [k for k, v in EVENT_LABELS.items() if v == target]
        spelled = "|".join(r"[\s_]+".join(k.replace("_", " ").split()) for k in labels)
        out = F.regexp_replace(out, rf"(?i)[(\[]\s*(?:{spelled})[\s_]*[)\]]", f"({target})")
    return F.when(F.coalesce(text, F.lit("")).rlike(LABEL_TAG), out).otherwise(F.coalesce(text, F.lit("")))


def boilerplate_key(text: Column) -> Column:
    bare = F.translate(F.lower(strip(text)), "‌‍", "")
    return strip(F.regexp_replace(bare, KEY_NOISE, " "))


def with_boilerplate(df: DataFrame, text: str, toks: str, name: str) -> DataFrame:
    """Add a flag: the text is only event tags or stock phrases.  `toks` are its tokens.

    Only texts with brackets can lose tokens to tags; the others keep their tokens.
    """
    t = F.col(text)
    bare = F.regexp_replace(F.regexp_replace(t, LABEL_TAG, " "), EVENT_TAG, " ")
    # Four tokens tell as much as all.
    begin = F.regexp_extract(F.lower(bare), rf"^(?:{NO_WORD}*+{WORD}+){{0,4}}", 0)
    tagged = F.contains(t, F.lit("(")) | F.contains(t, F.lit("[")) | F.contains(t, F.lit("【"))
    df = df.withColumn("_bare", F.when(tagged, F.regexp_extract_all(begin, F.lit(f"({WORD})"), F.lit(1))).otherwise(F.col(toks)))
    known = F.forall(F.slice("_bare", 1, 4), lambda k: boilerplate_key(k).isin(ALL_BOILERPLATE))
    # A text that begins with more letters than any stock phrase has is none; most texts need no more than this look.
    begins = F.regexp_replace(F.substring(t, 1, 256), rf"{KEY_NOISE}|[\u200c\u200d]", "")
    short = F.length(begins) <= max(map(len, ALL_BOILERPLATE))
    flag = (
        F.when(t == "", False)
        .when(F.size("_bare") == 0, True)
        .when(short & boilerplate_key(t).isin(ALL_BOILERPLATE), True)
        .otherwise((F.size("_bare") <= 3) & known)
    )
    return df.withColumn(name, flag).drop("_bare")


def with_script_counts(df: DataFrame, text: str) -> DataFrame:
    """Add `persian`, `latin` and `other`: letters by script."""
    t = F.coalesce(F.col(text), F.lit(""))
    latin = "".join(chr(c) for c in range(ord("a"), ord("z") + 1))
    latin += latin.upper() + "\u212a"
    df = df.withColumn("_p", F.translate(t, PERSIAN_LETTERS, ""))
    df = df.withColumn("_l", F.translate("_p", latin, ""))
    return (
        df.withColumn("persian", F.length(t) - F.length("_p"))
        .withColumn("latin", F.length("_p") - F.length("_l"))
        .withColumn("other", F.length("_l") - F.length(F.regexp_replace("_l", r"\p{L}+", "")))
        .drop("_p", "_l")
    )


# ---- token budgets ---------------------------------------------------------------


def estimate_tokens(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(CHARS_PER_TOKEN)))).cast("long")


def message_tokens(*contents: Column) -> Column:
    total = F.lit(0)
    for c in contents:
        total = total + estimate_tokens(c) + MESSAGE_TOKENS
    return total


def completion_cap(
    input_tokens: Column, requested: int, context: int = CONTEXT_TOKENS, reserve: int = RESERVE_TOKENS
) -> Column:
    return F.greatest(F.lit(MIN_COMPLETION), F.least(F.lit(requested), F.lit(context - reserve) - input_tokens))


def chars_that_fit(used_tokens: Column, context: int = CONTEXT_TOKENS, reserve: int = RESERVE_TOKENS) -> Column:
    left = F.greatest(F.lit(256), F.lit(context - reserve) - used_tokens)
    return F.floor(left * F.lit(CHARS_PER_TOKEN))


def polish_cap(chars: Column, items: Column, limit: int = 768) -> Column:
    return F.greatest(F.lit(256), F.least(F.lit(limit), F.floor(chars / 2) + 48 * items + 64))
