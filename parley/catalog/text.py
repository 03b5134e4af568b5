"""Registered queries over transcript text, with their SQL."""

from pyspark.sql import functions as F

from parley.catalog.common import NOISY, PAIRS, SP, WORD, norm_tokens, squeeze, strip, tokens, words
from parley.functions import hops, quality, stitching, text as tx
from parley.sources import adapters as src

C = F.col
PAIR = ["conv_id", "turn", "kind"]


def docs(spark, d):
    return src.documents(spark, d)


def pairs(spark, d):
    p = src.text_pairs(spark, d)
    return p.withColumn("na", tx.norm_tokens(C("a"))).withColumn("nb", tx.norm_tokens(C("b")))


def noisy(spark, d):
    return src.noisy_texts(spark, d)


def f1(spark, d):
    return docs(spark, d).withColumn("t", tx.tokens(C("text"))).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def f2(spark, d):
    """Arabic letters and joiners are put in first, so that there is something to unify."""
    return docs(spark, d).select(
        "doc_id", F.array_join(tx.norm_tokens(F.translate("text", "yk-", "يك‌")), " ").alias("normalised"))


def p2(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", tx.is_meaningful(C("line")).alias("meaningful"))


def p3(spark, d):
    t = noisy(spark, d)
    said = F.concat(F.lit("sound of a bell "), C("text"), F.lit(" (end) Background Noise [x"))
    return t.select("doc_id", "form", tx.speech_text(said).alias("speech"))


def p4(spark, d):
    """One meeting per form and first letter of the language; status from what was really said."""
    t = noisy(spark, d).withColumn("speech", tx.speech_text(C("text")))
    said = F.sum(F.length("speech")) + F.sum((C("speech") != "").cast("int")) - 1
    return t.groupBy("doc_id", "form").agg(
        F.when(F.max(tx.strip(C("text")) != "") == F.lit(False), "empty")
        .when(said >= 2, "speech").otherwise("noise").alias("status"))


def f3(spark, d):
    return pairs(spark, d).select(*PAIR, F.round(tx.jaccard(C("na"), C("nb"), C("a"), C("b")), 6).alias("similarity"))


def f4(spark, d):
    return pairs(spark, d).select(*PAIR, F.round(tx.containment(C("na"), C("nb"), C("a"), C("b")), 6).alias("containment"))


def f5(spark, d):
    return pairs(spark, d).select(*PAIR, tx.same_utterance(C("na"), C("nb"), C("a"), C("b")).alias("same"))


def f6(spark, d):
    t = noisy(spark, d).withColumn("t", tx.tokens(C("text")))
    return t.select("doc_id", "form", tx.longest_run(C("t")).alias("longest_run"),
                    F.round(tx.unique_ratio(C("t")), 6).alias("unique_ratio"),
                    F.size(F.array_distinct("t")).alias("n_distinct"))


def f7(spark, d):
    t = noisy(spark, d).withColumn("c", tx.compact(C("text")))
    return t.select("doc_id", "form", tx.loop_score(C("c")).alias("loop_score"))


def f8(spark, d):
    t = quality.with_script_penalty(noisy(spark, d).withColumn("t", tx.strip(C("text"))), "t", C("language"))
    return tx.with_script_counts(t, "text").select(
        "doc_id", "form", "persian", "latin", "other", C("script_penalty").alias("penalty"),
        F.coalesce("script_reason", F.lit("")).alias("reason"))


def f9(spark, d):
    t = noisy(spark, d).withColumn("t", tx.strip(C("text"))).withColumn("k", tx.tokens(C("t")))
    return tx.with_boilerplate(t, "t", "k", "boilerplate").select("doc_id", "form", "boilerplate")


def f10(spark, d):
    return noisy(spark, d).select("doc_id", "form", tx.canonical_events(C("text")).alias("text"))


def f11(spark, d):
    return quality.with_score(noisy(spark, d), "text", C("language"), batches=True).select(
        "doc_id", "form", F.round("score", 6).alias("score"), F.array_join("reasons", ";").alias("reasons"))


def f12(spark, d):
    return quality.with_gate(noisy(spark, d), "text", C("language")).select(
        "doc_id", "form", "action", "gated_text", F.round("score", 6).alias("score"),
        F.array_join("reasons", ";").alias("reasons"))


def f12_decision(spark, d):
    """Which texts pass, and whether their runs are collapsed."""
    return f12(spark, d).select("doc_id", "form", (C("action") == "drop").alias("dropped"),
                                C("reasons").contains("collapsed_runs").alias("collapsed"), "score")


def f13(spark, d):
    t = noisy(spark, d).withColumn("t", tx.tokens(C("text")))
    return t.select("doc_id", "form", F.array_join(tx.collapse_runs(C("t")), " ").alias("text"))


def f14(spark, d):
    return hops.collapse_repeats_column(noisy(spark, d), "text", "clean").select("doc_id", "form", "clean")


def f15(spark, d):
    """Close neighbouring tokens inside every utterance."""
    p = src.table(spark, d, "conversations").withColumn("t", tx.tokens(C("text")))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    z = F.arrays_zip(F.slice("t", 1, n).alias("a"), F.slice("t", 2, n).alias("b"))
    return p.select("conv_id", "turn", F.size(F.filter(z, lambda q: tx.tokens_close(q["a"], q["b"]))).alias("n_close"))


def edges(spark, d):
    p = src.text_pairs(spark, d)
    bare = lambda c: F.transform(tx.words(C(c)), tx.norm_token)
    return p.withColumn("wa", bare("a")).withColumn("wb", bare("b")).withColumn(
        "tail", F.slice("wa", F.greatest(F.size("wa") - 15, F.lit(1)), 16)).withColumn("head", F.slice("wb", 1, 16))


def f16(spark, d):
    return edges(spark, d).select(*PAIR, tx.edge_overlap(C("tail"), C("head")).alias("overlap"),
                                  tx.restated_prefix(C("wa"), C("head")).alias("skip"))


def f17(spark, d):
    return stitching.with_stitched(src.text_pairs(spark, d), "a", "b", "stitched").select(*PAIR, "stitched")


def f18(spark, d):
    return quality.with_faithful(src.text_pairs(spark, d), "a", "b").select(*PAIR, "faithful")


def f19(spark, d):
    """Every pair as a reviewer's answer; the asked action follows the turn number."""
    asked = F.element_at(F.array(*[F.lit(x) for x in ("keep", "fix", "drop", "other")]), (C("turn") % 4 + 1).cast("int"))
    p = quality.with_score(src.text_pairs(spark, d), "a").withColumn("asked", asked)
    return quality.with_verdict(p, "a", "asked", "b", "score").select(*PAIR, "final_text", "final_action")


def f20(spark, d):
    t = docs(spark, d)
    used = tx.message_tokens(C("lang"), C("text"))
    return t.select("doc_id", tx.estimate_tokens(C("text")).alias("est_tokens"), used.alias("message_tokens"),
                    tx.completion_cap(used, 1536).alias("completion_cap"),
                    tx.chars_that_fit(used).alias("chars_left"),
                    tx.polish_cap(F.length("text"), F.lit(1)).alias("polish_cap"))


def k4(spark, d):
    t = quality.with_score(noisy(spark, d), "text", C("language"), batches=True)
    return t.select("doc_id", "form", quality.needs_polish(C("score"), C("reasons")).alias("needs_polish"))


QUERIES = {
    "f1_tokenize": f1, "f2_norm_tokens": f2, "p2_meaningful_text": p2, "p3_speech_text": p3,
    "p4_meeting_speech_status": p4, "f3_jaccard": f3, "f4_containment": f4, "f5_same_utterance": f5,
    "f6_token_runs": f6, "f7_loop_score": f7, "f8_script_penalty": f8, "f9_boilerplate": f9,
    "f10_event_tags": f10, "f11_quality_score": f11, "f12_gate": f12, "f12_gate_decision": f12_decision,
    "f13_collapse_runs": f13, "f14_collapse_repeats": f14, "f15_token_closeness": f15,
    "f16_edge_overlap": f16, "f17_hop_stitch": f17, "f18_faithful_edit": f18, "f19_apply_verdict": f19,
    "f20_token_budget": f20, "k4_needs_polish": k4,
}

# ---- SQL ---------------------------------------------------------------------------

LABEL_TAG = r"[(\[]\s*([a-zA-Z][a-zA-Z\s_]*)\s*[)\]]"
EVENT_TAG = r"[(\[【][^)\]】]*[)\]】]"
KEY_NOISE = r"[()\[\]【】♪♫.،,\s\p{Z}_\-]+"
BOILER = "(" + ", ".join(f"'{b}'" for b in tx.ALL_BOILERPLATE) + ")"
LABEL_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.EVENT_LABELS.items()) + "}"


def key(x):
    return strip(f"regexp_replace(translate(lower({strip(x)}), '‌‍', ''), '{KEY_NOISE}', ' ', 'g')")


def boiler(x):
    bare = f"regexp_replace(regexp_replace({strip(x)}, '{LABEL_TAG}', ' ', 'g'), '{EVENT_TAG}', ' ', 'g')"
    return f"""({strip(x)} <> '' AND ({key(x)} IN {BOILER} OR len({tokens(bare)}) = 0
        OR (len({tokens(bare)}) <= 3 AND len(list_filter({tokens(bare)}, lambda k: {key('k')} NOT IN {BOILER})) = 0)))"""


def loop(c):
    def reps(n):
        return f"((length({c}) - length(regexp_replace({c}, '^(?:' || regexp_escape(left({c}, {n})) || ')+', ''))) // {n})"
    cases = " ".join(
        f"WHEN length({c}) >= {4 * n} AND {reps(n)} >= 5 AND {reps(n)} * {n} >= length({c}) * 0.7e0 THEN least(1e0, {reps(n)} / 8e0)"
        for n in (2, 3, 4))
    return f"CASE WHEN length({c}) < 8 THEN 0e0 {cases} ELSE 0e0 END"


def events(rel, ids, text="text"):
    """Canonical event tags: the text is cut at its tags, tags are looked up, and all is joined again."""
    return f"""
    ev_tag AS (SELECT {ids}, {text} AS txt, regexp_extract_all({text}, '{LABEL_TAG}', 0) AS tags,
                 regexp_split_to_array({text}, '{LABEL_TAG}') AS rest FROM {rel}),
    ev_new AS (SELECT *, list_transform(tags, lambda g: coalesce('(' || coalesce(
          {LABEL_MAP}[{squeeze("regexp_replace(lower(g[2:-2]), '[\\s_]+', ' ', 'g')")}],
          {LABEL_MAP}[replace({squeeze("regexp_replace(lower(g[2:-2]), '[\\s_]+', ' ', 'g')")}, ' ', '_')]) || ')', g)) AS put FROM ev_tag),
    canonical AS (SELECT {ids}, txt, CASE WHEN len(tags) = 0 THEN txt ELSE array_to_string(
          list_transform(rest, lambda r, i: r || coalesce(put[i], '')), '') END AS fixed FROM ev_new)"""


def score(rel, ids, text="text", lang="'en'", out="scored"):
    """CTEs ending in `out`(ids, t, toks, run, score, reasons)."""
    on = ids
    p = out
    return f"""
    {p}_0 AS (SELECT {ids}, {strip(text)} AS t, {lang} AS lg FROM {rel}),
    {p}_1 AS (SELECT *, {tokens('t')} AS toks, regexp_replace(t, '{SP}+', '', 'g') AS c,
                 regexp_replace(t, '{LABEL_TAG}', ' ', 'g') AS bare FROM {p}_0),
    {p}_2 AS (SELECT {ids}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM {p}_1),
    {p}_3 AS (SELECT {ids}, tok, pos - row_number() OVER (PARTITION BY {ids}, tok ORDER BY pos) AS g FROM {p}_2),
    {p}_4 AS (SELECT {ids}, tok, count(*) AS c FROM {p}_3 GROUP BY {ids}, tok, g),
    {p}_5 AS (SELECT {ids}, max(c) AS run, count(DISTINCT tok) AS dist FROM {p}_4 GROUP BY {ids}),
    {p}_6 AS (SELECT a.*, coalesce(run, 0) AS run, coalesce(dist, 0) AS dist, len(toks) AS n, {loop('c')} AS lp,
          length(bare) - length(regexp_replace(bare, '[{tx.PERSIAN_LETTERS}]', '', 'g')) AS pe,
          length(bare) - length(regexp_replace(bare, '[A-Za-z]', '', 'g')) AS la,
          length(regexp_replace(bare, '[{tx.PERSIAN_LETTERS}A-Za-z]', '', 'g'))
            - length(regexp_replace(bare, '[{tx.PERSIAN_LETTERS}A-Za-z]|\\p{{L}}', '', 'g')) AS ot
       FROM {p}_1 a LEFT JOIN {p}_5 b USING ({on})),
    {p}_7 AS (SELECT *, dist / n AS uq, la / (pe + la + ot) AS lr,
          lower(lg) IN ('fa', 'fas', 'per', 'persian', 'farsi') AND pe + la + ot > 0 AS fa,
          CASE WHEN t = '' THEN 'empty' WHEN length(t) < 2 THEN 'too_short'
               WHEN regexp_full_match(t, '[\\s\\p{{Z}}.,!?;:\\-—…\\x{{06D4}}\\x{{061F}}«»"''()]+') THEN 'punct_only'
               WHEN {boiler('t')} THEN 'whisper_boilerplate'
               WHEN NOT regexp_matches(t, '\\p{{L}}') THEN 'no_letters' WHEN n = 0 THEN 'no_tokens' END AS bad FROM {p}_6),
    {p}_8 AS (SELECT *, CASE WHEN NOT fa THEN 0e0 WHEN pe = 0 AND la > 0 THEN 1e0 WHEN pe = 0 AND ot > 0 THEN 0.9e0
            WHEN lr >= 0.45e0 THEN 0.7e0 WHEN lr >= 0.3e0 THEN 0.35e0 ELSE 0e0 END AS pen,
          CASE WHEN NOT fa THEN NULL WHEN pe = 0 AND la > 0 THEN 'wrong_script' WHEN pe = 0 AND ot > 0 THEN 'no_persian'
            WHEN lr >= 0.45e0 THEN 'latin_heavy:' || printf('%.2f', lr) WHEN lr >= 0.3e0 THEN 'latin_ratio:' || printf('%.2f', lr) END AS sc,
          CASE WHEN run >= 8 THEN 0.85e0 WHEN run >= 5 THEN 0.55e0 WHEN run >= 3 THEN 0.2e0 ELSE 0e0 END AS rl,
          CASE WHEN n >= 6 AND uq < 0.25e0 THEN 0.55e0 WHEN n >= 4 AND uq < 0.35e0 THEN 0.3e0 ELSE 0e0 END AS ul,
          CASE WHEN lp >= 0.5e0 THEN 0.7e0 WHEN lp >= 0.25e0 THEN 0.35e0 ELSE 0e0 END AS ll,
          n >= 12 AND dist <= 3 AS tiny FROM {p}_7),
    {out} AS (SELECT {ids}, t, toks, run, round(CASE WHEN bad = 'no_tokens' THEN 0.05e0 WHEN bad IS NOT NULL THEN 0e0
            ELSE greatest(0e0, least(1e0, 1e0 - rl - ul - ll - CASE WHEN tiny THEN 0.4e0 ELSE 0e0 END - pen)) END, 6) AS score,
          coalesce(bad, concat_ws(';', CASE WHEN rl > 0 THEN 'word_run:' || run END,
            CASE WHEN ul > 0 THEN 'low_unique:' || printf('%.2f', uq) END,
            CASE WHEN ll > 0 THEN 'char_loop:' || printf('%.2f', lp) END, CASE WHEN tiny THEN 'tiny_vocab' END, sc)) AS reasons,
          pen, coalesce(sc, '') AS sc FROM {p}_8)"""


DF = "doc_id, form"
ABN = f"""{PAIRS}, q AS (SELECT *, {norm_tokens('a')} AS na, {norm_tokens('b')} AS nb, {strip('a')} AS sa, {strip('b')} AS sb FROM pairs)"""
JAC = """CASE WHEN len(na) = 0 OR len(nb) = 0 THEN CASE WHEN sa = sb AND sa <> '' THEN 1e0 ELSE 0e0 END
      ELSE len(list_distinct(list_intersect(na, nb))) / len(list_distinct(list_concat(na, nb))) END"""
CON = """CASE WHEN len(na) = 0 OR len(nb) = 0 THEN CASE WHEN sa = sb THEN 1e0 ELSE 0e0 END
      ELSE len(list_distinct(list_intersect(na, nb))) / least(len(list_distinct(na)), len(list_distinct(nb))) END"""


def faithful(rel="pairs", a="a", b="b"):
    """CTE `fe`(conv_id, turn, kind, faithful)."""
    ids = "conv_id, turn, kind"
    return f"""{score(rel, ids, a, out='so')}, {score(rel, ids, b, out='se')},
    fo AS (SELECT o.{ids.replace(', ', ', o.')}, o.t AS ot, e.t AS et, o.toks AS otk, e.toks AS etk, o.score AS qo, e.score AS qe
       FROM so o JOIN se e USING ({ids})),
    fk AS (SELECT {ids}, count(*) AS kept FROM (SELECT {ids}, unnest(otk) AS tok FROM fo) x
       SEMI JOIN (SELECT DISTINCT {ids}, unnest(etk) AS tok FROM fo) y USING ({ids}, tok) GROUP BY ALL),
    fe AS (SELECT {ids}, CASE WHEN et = '' THEN false WHEN et = ot THEN true WHEN len(otk) = 0 THEN true
       ELSE len(etk) >= greatest(3, floor(len(otk) * 0.65e0)) AND length(et) >= greatest(8, floor(length(ot) * 0.55e0))
        AND coalesce(kept, 0) / len(otk) >= 0.65e0 AND NOT (qo >= 0.7e0 AND qe + 0.2e0 < qo) END AS faithful
       FROM fo LEFT JOIN fk USING ({ids}))"""


def close(a, b):
    return f"""CASE WHEN {a} = {b} THEN true WHEN {a} = '' OR {b} = '' THEN false
      WHEN contains({a}, {b}) OR contains({b}, {a}) THEN abs(length({a}) - length({b})) <= greatest(2, length({a}) // 3)
      ELSE abs(length({a}) - length({b})) <= 2 AND len(list_filter(range(1, least(length({a}), length({b})) + 1),
         lambda i: {a}[i] <> {b}[i])) + abs(length({a}) - length({b})) <= 2 END"""


EDGE = f"""{PAIRS}, ew AS (SELECT conv_id, turn, kind,
    list_transform({words('a')}, lambda w: lower(regexp_replace(translate(w, 'يك‌‍', 'یک'), '[^\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06FF}}]+', '', 'g'))) AS wa,
    list_transform({words('b')}, lambda w: lower(regexp_replace(translate(w, 'يك‌‍', 'یک'), '[^\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06FF}}]+', '', 'g'))) AS wb
    FROM pairs)"""

SQL = {
    "f1_tokenize": f"SELECT doc_id, len({tokens('text')}) AS n_tokens, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
    "f2_norm_tokens": f"SELECT doc_id, array_to_string({norm_tokens(chr(116) + 'ranslate(text, ' + repr('yk-') + ', ' + repr('يك') [:-1] + chr(0x200c) + chr(39) + ')')}, ' ') AS normalised FROM documents",
    "p2_meaningful_text": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
        SELECT doc_id, line_no, length({strip('line')}) >= 2 AND regexp_matches(line, '\\p{{L}}') AS meaningful FROM l""",
    "p3_speech_text": f"""WITH {NOISY} SELECT doc_id, form, array_to_string(regexp_extract_all(
          regexp_replace(regexp_replace('sound of a bell ' || text || ' (end) Background Noise [x', '[(\\[][^)\\]]*[)\\]]', ' ', 'g'),
            '(?i)\\b(sound of a [\\p{{L}}\\p{{N}}_]+|background noise|music playing)\\b', ' ', 'g'), '({WORD})', 1), ' ') AS speech FROM noisy""",
    "p4_meeting_speech_status": f"""WITH {NOISY}, s AS (SELECT doc_id, form, text, array_to_string(regexp_extract_all(
          regexp_replace(regexp_replace(text, '[(\\[][^)\\]]*[)\\]]', ' ', 'g'),
            '(?i)\\b(sound of a [\\p{{L}}\\p{{N}}_]+|background noise|music playing)\\b', ' ', 'g'), '({WORD})', 1), ' ') AS speech FROM noisy)
        SELECT doc_id, form, CASE WHEN NOT bool_or({strip('text')} <> '') THEN 'empty'
          WHEN length(string_agg(CASE WHEN speech <> '' THEN speech END, ' ')) >= 2 THEN 'speech' ELSE 'noise' END AS status FROM s GROUP BY ALL""",
    "f3_jaccard": f"WITH {ABN} SELECT conv_id, turn, kind, round({JAC}, 6) AS similarity FROM q",
    "f4_containment": f"WITH {ABN} SELECT conv_id, turn, kind, round({CON}, 6) AS containment FROM q",
    "f5_same_utterance": f"""WITH {ABN}, m AS (SELECT *, array_to_string(na, ' ') AS ja, array_to_string(nb, ' ') AS jb FROM q)
        SELECT conv_id, turn, kind, sa <> '' AND sb <> '' AND ((ja <> '' AND jb <> '' AND (contains(ja, jb) OR contains(jb, ja)))
          OR {JAC} >= 0.40e0 OR {CON} >= 0.55e0) AS same FROM m""",
    "f6_token_runs": f"""WITH {NOISY}, {score('noisy', DF)} SELECT doc_id, form, CAST(run AS BIGINT) AS longest_run,
        round(CASE WHEN len(toks) = 0 THEN 0e0 ELSE len(list_distinct(toks)) / len(toks) END, 6) AS unique_ratio, len(list_distinct(toks)) AS n_distinct FROM scored""",
    "f7_loop_score": f"WITH {NOISY}, m AS (SELECT doc_id, form, regexp_replace(text, '{SP}+', '', 'g') AS c FROM noisy) SELECT doc_id, form, {loop('c')} AS loop_score FROM m",
    "f8_script_penalty": f"""WITH {NOISY}, {score('noisy', DF, lang='language')} SELECT s.doc_id, s.form,
        length(n.text) - length(regexp_replace(n.text, '[{tx.PERSIAN_LETTERS}]', '', 'g')) AS persian,
        length(n.text) - length(regexp_replace(n.text, '[A-Za-z]', '', 'g')) AS latin,
        length(regexp_replace(n.text, '[{tx.PERSIAN_LETTERS}A-Za-z]', '', 'g')) - length(regexp_replace(n.text, '[{tx.PERSIAN_LETTERS}A-Za-z]|\\p{{L}}', '', 'g')) AS other,
        pen AS penalty, sc AS reason FROM scored s JOIN noisy n USING (doc_id, form)""",
    "f9_boilerplate": f"WITH {NOISY} SELECT doc_id, form, {boiler('text')} AS boilerplate FROM noisy",
    "f10_event_tags": f"WITH {NOISY}, {events('noisy', DF)} SELECT doc_id, form, fixed AS text FROM canonical",
    "f11_quality_score": f"WITH {NOISY}, {score('noisy', DF, lang='language')} SELECT doc_id, form, score, reasons FROM scored",
    "f12_gate_decision": f"""WITH {NOISY}, {score('noisy', DF, lang='language')} SELECT doc_id, form, score < 0.35e0 AS dropped,
        score >= 0.35e0 AND run >= 3 AS collapsed, score FROM scored""",
    "f13_collapse_runs": f"""WITH {NOISY}, k AS (SELECT doc_id, form, {tokens('text')} AS toks FROM noisy),
        u AS (SELECT doc_id, form, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM k),
        h AS (SELECT *, lag(tok) OVER (PARTITION BY doc_id, form ORDER BY pos) AS prev FROM u),
        j AS (SELECT doc_id, form, string_agg(tok, ' ' ORDER BY pos) AS text FROM h WHERE prev IS NULL OR prev <> tok GROUP BY ALL)
        SELECT doc_id, form, coalesce(j.text, '') AS text FROM k LEFT JOIN j USING (doc_id, form)""",
    "f15_token_closeness": f"""WITH k AS (SELECT conv_id, turn, {tokens('text')} AS t FROM conversations),
        u AS (SELECT conv_id, turn, unnest(t) AS a, generate_subscripts(t, 1) AS pos FROM k),
        p AS (SELECT *, lead(a) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS b FROM u)
        SELECT conv_id, turn, count(*) FILTER (WHERE b IS NOT NULL AND {close('a', 'b')}) AS n_close FROM p GROUP BY ALL""",
    # Every two different words are compared once, and only where their lengths let them be close.
    "f16_edge_overlap": f"""WITH {EDGE}, edge AS (SELECT conv_id, turn, kind, wa, wb, list_slice(wa, greatest(len(wa) - 15, 1), len(wa)) AS ta, list_slice(wb, 1, 16) AS hb FROM ew),
        ks AS (SELECT *, unnest(range(1, 17)) AS k FROM edge),
        pos AS (SELECT conv_id, turn, kind, k, ta[len(ta) - k + i] AS x, hb[i] AS y
          FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM ks WHERE k <= len(ta) AND k <= len(hb))),
        unlike AS (SELECT DISTINCT x, y FROM pos WHERE x <> y AND x <> '' AND y <> '' AND (abs(length(x) - length(y)) <= 2 OR contains(x, y) OR contains(y, x))),
        alike AS (SELECT x, y FROM unlike WHERE {close('x', 'y')}),
        ov AS (SELECT conv_id, turn, kind, k, count(*) FILTER (x = y OR alike.x IS NOT NULL) / k AS share FROM pos LEFT JOIN alike USING (x, y) GROUP BY conv_id, turn, kind, k),
        best AS (SELECT conv_id, turn, kind, max(k) AS overlap FROM ov WHERE share >= 0.6e0 AND (k >= 2 OR share >= 0.99e0) GROUP BY ALL),
        js AS (SELECT conv_id, turn, kind, k, list_distinct(wb[1:k]) AS h, wa, list_distinct(wa[greatest(len(wa) - 13, 1):]) AS tl
          FROM ks WHERE k <= 14 AND k <= len(wb) AND len(wa) > 0),
        sk AS (SELECT conv_id, turn, kind, max(k) AS skip FROM js
          WHERE len(list_intersect(h, tl)) / len(h) >= 0.5e0 OR len(list_intersect(h, list_distinct(wa))) / len(h) >= 0.65e0 GROUP BY ALL)
        SELECT conv_id, turn, kind, coalesce(overlap, 0) AS overlap, coalesce(skip, 0) AS skip
        FROM ew LEFT JOIN best USING (conv_id, turn, kind) LEFT JOIN sk USING (conv_id, turn, kind)""",
    "f18_faithful_edit": f"WITH {PAIRS}, {faithful()} SELECT conv_id, turn, kind, faithful FROM fe",
    "f19_apply_verdict": f"""WITH {PAIRS}, {score('pairs', 'conv_id, turn, kind', 'a', out='sc')},
        v AS (SELECT p.*, CASE turn % 4 WHEN 1 THEN 'fix' WHEN 2 THEN CASE WHEN s.score >= 0.6e0 THEN 'keep' ELSE 'drop' END ELSE 'keep' END AS act
          FROM pairs p JOIN sc s USING (conv_id, turn, kind)),
        c AS (SELECT *, CASE WHEN act <> 'fix' AND b = '' THEN {strip('a')} ELSE {strip('b')} END AS cand FROM v),
        {faithful('c', 'a', 'cand')},
        pick AS (SELECT conv_id, turn, kind, act, CASE WHEN act = 'drop' THEN '' WHEN cand <> '' AND faithful THEN cand ELSE a END AS txt0,
          act = 'fix' AND cand <> '' AND faithful AS fixed_it FROM c JOIN fe USING (conv_id, turn, kind)),
        {events('pick', 'conv_id, turn, kind, act, fixed_it', 'txt0')}
        SELECT conv_id, turn, kind, fixed AS final_text, CASE WHEN act = 'drop' THEN 'drop' WHEN fixed_it THEN 'fix' ELSE 'keep' END AS final_action
        FROM canonical""",
    "f20_token_budget": """WITH e AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 1.8e0) AS BIGINT)) END AS est,
          CASE WHEN length(lang) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(lang) / 1.8e0) AS BIGINT)) END AS el FROM documents)
        SELECT doc_id, est AS est_tokens, est + el + 8 AS message_tokens, greatest(256, least(1536, 8192 - 320 - (est + el + 8))) AS completion_cap,
          CAST(floor(greatest(256, 8192 - 320 - (est + el + 8)) * 1.8e0) AS BIGINT) AS chars_left,
          greatest(256, least(768, n // 2 + 48 + 64)) AS polish_cap FROM e""",
    "k4_needs_polish": f"""WITH {NOISY}, {score('noisy', DF, lang='language')} SELECT doc_id, form, score < 0.92e0 OR
        regexp_matches(reasons, 'word_run|latin|char_loop|low_unique|wrong_script|collapsed|tiny_vocab|no_persian|whisper_boilerplate') AS needs_polish FROM scored""",
}
