"""One text from two overlapping windows' versions, as columns.

The texts are compared once; what follows from the comparison is named in `_rule`, and only where something is appended
is a new text made, freed of repeats and scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.functions import quality as ql, text as tx
from parley.functions.hops import collapse_repeats_column

# When a version is better, clearer or spoiled, and when two are versions of one utterance.
BETTER, CLEARER, SPOILED, SOUND = 0.08, 0.12, 0.12, 0.6
RELATED_JACCARD, RELATED_CONTAINMENT, MOSTLY = 0.38, 0.55, 0.7
UNLIKE_JACCARD, UNLIKE_CONTAINMENT = 0.25, 0.35
GOOD, BAD, VERY_GOOD, FAR_WORSE = 0.65, 0.5, 0.7, 0.25
EDGE = 16


def with_stitched(df: DataFrame, old: str, new: str, out: str) -> DataFrame:
    """Add the text that both versions give together; good text is never replaced by worse. Nulls are empty."""
    df = df.withColumn("_a", tx.strip(F.col(old))).withColumn("_b", tx.strip(F.col(new)))
    a, b = F.col("_a"), F.col("_b")
    for side in "ab":
        df = ql.with_score(df, f"_{side}", "en", f"_q{side}", "_why").drop("_why")
        df = df.withColumn(f"_t{side}", tx.words(F.col(f"_{side}"))).withColumn(f"_n{side}", tx.norm_tokens(F.col(f"_{side}")))
        df = df.withColumn(f"_bare{side}", F.transform(f"_t{side}", tx.norm_token))
    qa, qb, size_a, size_b = F.col("_qa"), F.col("_qb"), F.size("_ta"), F.size("_tb")
    tail = F.slice("_barea", F.greatest(F.size("_barea") - EDGE + 1, F.lit(1)), EDGE)
    head = F.slice("_bareb", 1, EDGE)
    df = df.withColumn("_edge", tx.edge_overlap(tail, head)).withColumn("_skip", tx.restated_prefix(F.col("_barea"), head))
    na, nb = F.col("_na"), F.col("_nb")
    df = df.withColumn("_jac", tx.jaccard(na, nb, a, b)).withColumn("_con", tx.containment(na, nb, a, b))
    related = (F.col("_jac") >= RELATED_JACCARD) | (F.col("_con") >= RELATED_CONTAINMENT) | tx.same_utterance(na, nb, a, b)
    df = df.withColumn("_related", related)
    kin, jac, con, edge, skip = (F.col(c) for c in ("_related", "_jac", "_con", "_edge", "_skip"))
    good, bad = F.greatest(qa, qb), F.least(qa, qb)
    one_is_noise = ((good >= GOOD) & (bad < BAD)) | ((good >= VERY_GOOD) & (bad + FAR_WORSE < good))
    rule = (
        F.when((a == "") | (b == "") | F.contains(a, b), "old")
        .when(F.contains(b, a), "wraps")
        .when((edge >= 2) | ((edge == 1) & (size_a <= 4)), "edge")
        .when(kin & (F.abs(qa - qb) >= CLEARER), "clearer")
        .when(kin & (con >= MOSTLY), "longer")
        .when(~kin & (jac < UNLIKE_JACCARD) & (con < UNLIKE_CONTAINMENT) & one_is_noise, "clearer")
        .when((skip > 0) & (skip < size_b), "restated")
        .when(kin, "better")
        .when((skip >= size_b) | ((qa >= GOOD) & (qb < BAD)), "old")
        .otherwise("both")
    )
    df = df.withColumn("_rule", rule)
    which = F.col("_rule")
    known = F.when(which == "edge", edge).when(which == "restated", skip).when(which == "both", F.lit(0))
    rest = F.slice("_tb", known + 1, F.greatest(size_b - known, F.lit(0)))
    df = df.withColumn("_joined", F.when(known.isNotNull(), F.array_join(F.concat("_ta", rest), " ")))
    df = collapse_repeats_column(df, "_joined", "_text")
    df = ql.with_score(df, "_text", "en", "_qt", "_why").drop("_why")
    floor = F.when(which == "edge", qa).when(which == "restated", good)
    spoiled = F.coalesce((floor >= SOUND) & (F.col("_qt") + SPOILED < floor), F.lit(False))
    better = F.when(qb > qa + BETTER, b).otherwise(a)
    much_longer = size_b > size_a + F.greatest(F.lit(4), F.floor(size_a / 2))
    result = (
        F.when(which == "old", F.when(a == "", b).otherwise(a))
        .when(which == "wraps", F.when(much_longer | (qb + BETTER < qa), better).otherwise(b))
        .when(which == "clearer", F.when(qa > qb, a).otherwise(b))
        .when(which == "longer", F.when(size_a >= size_b, a).otherwise(b))
        .when((which == "better") | spoiled, better)
        .otherwise(F.col("_text"))
    )
    mine = ["_a", "_b", "_qa", "_qb", "_ta", "_tb", "_na", "_nb", "_barea", "_bareb", "_edge", "_skip", "_jac", "_con", "_related", "_rule", "_joined", "_text", "_qt"]
    return df.withColumn(out, result).drop(*mine)
