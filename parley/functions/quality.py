"""Quality score, gate and edit checks for machine-made transcripts, as columns.

`with_*` functions add their working columns step by step, so that every token
array is built once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import text as tx

# ---- fixed values: thresholds and penalties of the score ----------------------
MIN_SCORE = 0.35
POLISH_BELOW = 0.92
POLISH_MARKERS = [
    "word_run",
    "latin",
    "char_loop",
    "low_unique",
    "wrong_script",
    "collapsed",
    "tiny_vocab",
    "no_persian",
    "whisper_boilerplate",
]
KEEP_CLEAN_ABOVE = 0.6
# What is lost for a longest run of at least so many tokens, for a loop score of at least so much, and for a share of
# distinct tokens below so much in a text of at least so many; the first that holds counts.
RUN_LOSSES = [(8, 0.85), (5, 0.55), (3, 0.2)]
LOOP_LOSSES = [(0.5, 0.7), (0.25, 0.35)]
UNIQUE_LOSSES = [(6, 0.25, 0.55), (4, 0.35, 0.3)]
TINY_TOKENS, TINY_DISTINCT, TINY_LOSS = 12, 3, 0.4
# ---- end of fixed values --------------------------------------------------------


def _two(x: Column) -> Column:
    return F.format_number(x, 2)


def _first(cases: list[tuple[Column, float]]) -> Column:
    """The value of the first case that holds, else 0."""
    out = F
    for holds, value in cases:
        out = out.when(holds, value)
    return out.otherwise(0.0)


def with_script_penalty(df: DataFrame, text: str, language: Column) -> DataFrame:
    """Add script_penalty and script_reason for text that should be Persian but is not."""
    df = df.withColumn("_bare", F.when(F.lower(tx.strip(language)).isin(tx.PERSIAN_LANGUAGES),
                                       F.regexp_replace(F.col(text), tx.LABEL_TAG, " ")))
    df = tx.with_script_counts(df, "_bare")
    letters = F.col("persian") + F.col("latin") + F.col("other")
    df = df.withColumn("_ratio", F.when(letters > 0, F.col("latin") / letters))
    ratio, none = F.col("_ratio"), F.col("persian") == 0
    cases = [
        (ratio.isNull(), 0.0, F.lit(None).cast("string")),
        (none & (F.col("latin") > 0), 1.0, F.lit("wrong_script")),
        (none & (F.col("other") > 0), 0.9, F.lit("no_persian")),
        (ratio >= 0.45, 0.7, F.concat(F.lit("latin_heavy:"), _two(ratio))),
        (ratio >= 0.3, 0.35, F.concat(F.lit("latin_ratio:"), _two(ratio))),
    ]
    penalty = reason = F
    for cond, p, r in cases:
        penalty, reason = penalty.when(cond, p), reason.when(cond, r)
    return (
        df.withColumn("script_penalty", penalty.otherwise(0.0))
        .withColumn("script_reason", reason)
        .drop("_bare", "_ratio", "persian", "latin", "other")
    )


def with_score(
    df: DataFrame, text: str, language: Column | str = "en", score: str = "score", reasons: str = "reasons", batches: bool = False
) -> DataFrame:
    """Add `score` in [0, 1] (higher is better) and the list of `reasons` against the text.

    With `batches` the runs of tokens are found in Arrow batches: faster for tables of whole texts that are scored once.
    """
    return _with_parts(df, text, language, score, reasons, batches).drop("_t", "_tok", "_run")


def _with_parts(df: DataFrame, text: str, language: Column | str, score: str, reasons: str, batches: bool) -> DataFrame:
    """As with_score; also adds what the score is made of: the stripped text `_t`, its tokens `_tok` and their longest run `_run`."""
    from parley.functions.hops import longest_run_column

    lang = F.lit(language) if isinstance(language, str) else language
    df = df.withColumn("_t", tx.strip(F.col(text)))
    df = df.withColumn("_tok", tx.tokens(F.col("_t")))
    t, tok = F.col("_t"), F.col("_tok")
    df = df.withColumn("_n", F.size(tok))
    if batches:
        df = longest_run_column(df, "_tok", "_run").withColumn("_c", F.when(tx.may_loop(t), tx.compact(t)).otherwise(""))
    else:
        df = df.withColumn("_run", tx.longest_run(tok)).withColumn("_c", tx.compact(t))
    df = df.withColumn("_distinct", F.size(F.array_distinct(tok))).withColumn("_loop", tx.loop_score(F.col("_c")))
    df = with_script_penalty(df, "_t", lang)
    df = tx.with_boilerplate(df, "_t", "_tok", "_boiler")
    n, run, uniq, loop = F.col("_n"), F.col("_run"), F.col("_distinct") / F.col("_n"), F.col("_loop")

    unusable = (
        F.when(t == "", "empty")
        .when(F.length(t) < 2, "too_short")
        .when(t.rlike(tx.ONLY_PUNCT_OR_QUOTES), "punct_only")
        .when(F.col("_boiler"), "whisper_boilerplate")
        .when(~t.rlike(r"\p{L}"), "no_letters")
        .when(n == 0, "no_tokens")
    )
    df = df.withColumn("_unusable", unusable)
    run_loss = _first([(run >= least, loss) for least, loss in RUN_LOSSES])
    uniq_loss = _first([((n >= least) & (uniq < share), loss) for least, share, loss in UNIQUE_LOSSES])
    loop_loss = _first([(loop >= least, loss) for least, loss in LOOP_LOSSES])
    tiny = (n >= TINY_TOKENS) & (F.col("_distinct") <= TINY_DISTINCT)
    left = 1.0 - run_loss - uniq_loss - loop_loss - _first([(tiny, TINY_LOSS)]) - F.col("script_penalty")
    against = F.filter(
        F.array(
            F.when(run_loss > 0, F.concat(F.lit("word_run:"), run.cast("string"))),
            F.when(uniq_loss > 0, F.concat(F.lit("low_unique:"), _two(uniq))),
            F.when(loop_loss > 0, F.concat(F.lit("char_loop:"), _two(loop))),
            F.when(tiny, F.lit("tiny_vocab")),
            F.col("script_reason"),
        ),
        lambda r: r.isNotNull(),
    )
    bad = F.col("_unusable")
    return (
        df.withColumn(
            score,
            F.when(bad == "no_tokens", 0.05)
            .when(bad.isNotNull(), 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))),
        )
        .withColumn(reasons, F.when(bad.isNotNull(), F.array(bad)).otherwise(against))
        .drop("_n", "_distinct", "_loop", "_c", "_boiler", "script_penalty", "script_reason", "_unusable")
    )


def with_gate(
    df: DataFrame, text: str, language: Column | str = "en", min_score: float = MIN_SCORE
) -> DataFrame:
    """Add action (keep, fix or drop), gated_text, score and reasons.

    Low scores are dropped; long runs of one token are collapsed; otherwise event
    tags are made canonical and repeated phrases removed.
    """
    from parley.functions.hops import collapse_repeats_column

    df = _with_parts(df, text, language, "score", "reasons", True).withColumnRenamed("_t", "_raw")
    runs, dropped = F.col("_run") >= 3, F.col("score") < min_score
    df = df.withColumn(
        "_cand",
        F.when(dropped, F.lit(None).cast("string"))
        .when(runs, F.array_join(tx.collapse_runs(F.col("_tok")), " "))
        .otherwise(tx.canonical_events(F.col("_raw"))),
    )
    df = collapse_repeats_column(df, "_cand", "_clean")
    # Collapsed runs carry no brackets any more, so tags only need care in the other branch.
    fixed = runs | (F.col("_clean") != F.col("_raw"))
    return (
        df.withColumn("action", F.when(dropped, "drop").when(fixed, "fix").otherwise("keep"))
        .withColumn("gated_text", F.when(dropped, "").otherwise(F.col("_clean")))
        .withColumn(
            "reasons",
            F.when(dropped, F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("low_score"))))
            .when(runs, F.concat("reasons", F.array(F.lit("collapsed_runs"))))
            .when(fixed, F.concat("reasons", F.array(F.lit("collapsed_phrases"))))
            .otherwise(F.col("reasons")),
        )
        .drop("_raw", "_tok", "_run", "_cand", "_clean")
    )


def needs_polish(score: Column, reasons: Column) -> Column:
    marked = F.exists(reasons, lambda r: r.rlike("|".join(POLISH_MARKERS)))
    return (score < POLISH_BELOW) | F.coalesce(marked, F.lit(False))


def with_faithful(df: DataFrame, original: str, edited: str, name: str = "faithful") -> DataFrame:
    """Add a flag: the edit keeps the utterance and does not summarise or replace it."""
    df = with_score(with_score(df, original, score="_qo", reasons="_ro"), edited, score="_qe", reasons="_re")
    df = df.withColumn("_ot", tx.tokens(tx.strip(F.col(original)))).withColumn("_et", tx.tokens(tx.strip(F.col(edited))))
    o, e = tx.strip(F.col(original)), tx.strip(F.col(edited))
    ot, et = F.col("_ot"), F.col("_et")
    long_enough = (F.size(et) >= F.greatest(F.lit(3), F.floor(F.size(ot) * F.lit(0.65)))) & (
        F.length(e) >= F.greatest(F.lit(8), F.floor(F.length(o) * F.lit(0.55)))
    )
    # Every copy of a lost token counts; only the (few) distinct lost ones are searched.
    df = df.withColumn("_lost", F.array_except(ot, et))
    copies = F.size(F.filter(ot, lambda t: F.array_contains(F.col("_lost"), t)))
    # Naming the column twice also keeps Spark from computing it anew for every token.
    lost = F.when(F.size("_lost") == 0, 0).otherwise(copies)
    retained = (F.size(ot) - lost) / F.size(ot) >= 0.65
    worse = (F.col("_qo") >= 0.7) & (F.col("_qe") + 0.2 < F.col("_qo"))
    flag = (
        F.when(e == "", False).when(e == o, True).when(F.size(ot) == 0, True).otherwise(long_enough & retained & ~worse)
    )
    return df.withColumn(name, flag).drop("_qo", "_qe", "_ro", "_re", "_ot", "_et", "_lost")


def with_verdict(
    df: DataFrame, original: str, action: str, edited: str, score: str
) -> DataFrame:
    """Apply a reviewer's keep/fix/drop: adds final_text (empty = drop) and final_action.

    A drop of text the score finds clean is refused; an edit must be faithful.
    """
    asked = F.lower(F.coalesce(F.col(action), F.lit("keep")))
    known = F.when(asked.isin("keep", "fix", "drop"), asked).otherwise("keep")
    refuse = (known == "drop") & (F.col(score) >= KEEP_CLEAN_ABOVE)
    df = df.withColumn("_act", F.when(refuse, "keep").otherwise(known))
    given = tx.strip(F.col(edited))
    fallback = F.when((F.col("_act") != "fix") & (F.coalesce(F.col(edited), F.lit("")) == ""), tx.strip(F.col(original)))
    df = df.withColumn("_cand", F.coalesce(fallback, given))
    df = with_faithful(df, original, "_cand", "_ok")
    use = (F.col("_cand") != "") & F.col("_ok")
    return (
        df.withColumn(
            "final_text",
            F.when(F.col("_act") == "drop", "")
            .when(use, tx.canonical_events(F.col("_cand")))
            .otherwise(tx.canonical_events(F.col(original))),
        )
        .withColumn(
            "final_action",
            F.when(F.col("_act") == "drop", "drop").when((F.col("_act") == "fix") & use, "fix").otherwise("keep"),
        )
        .drop("_act", "_cand", "_ok")
    )
