"""Merkle manifest of a data set: a root over all rows, and a proof for each row, from levels of which only some are kept.

A row's leaf is the SHA-256 of its columns; every `FAN` consecutive nodes of a level become one node above, until one
is left. Rows of a source form a tree in the order of doc_id, and the trees' roots, in the order of sources, form the
tree above them.

Checkpoint and recompute: of each forest only the leaves and every `STEP`th level above them are written (level 0, 2,
4, ...). A proof needs the levels between as well: a task takes an aligned subtree, that is the kept nodes below one
kept node, works out the missing nodes between from them, gives each kept node its siblings on the way up, and drops
what it worked out. Suffixes of proofs are handed down from the top, kept level by kept level, so that what many rows
share is worked out once, and at last the rows of each subtree get their own.

Nothing is collected: a group holds at most FAN ** STEP nodes, of however large a source. Positions in a tree come from
one range partitioning by (source, doc_id); only the counts of (partition, source) are summed up afterwards. Texts don't
leave the tasks that read them. All of it is DataFrame functions.

Defined cases: null columns count as `-`; a null source is a source of its own and comes first; equal doc_ids of a
source follow each other in the order of their leaves, null doc_ids first; repeated rows are leaves of their own; a lone
leaf is its tree's root, a lone tree's root the root; no rows give none; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import keep, table

BITS = 4
FAN = 1 << BITS
STEP = 2  #: every so many levels one is kept
ROWS_A_PART = 1 << 20
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of texts behind each other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, digest and changed (the leaf of the tampered row, else null). `tree` tells a null source from others."""
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), own["source"].cast("string")), F.lit("-"))  # "-" sorts before "="
    tampered = (F.crc32(own["doc_id"].cast("string").cast("binary")) % 5 == 0) & (lower_ascii(own["text"]) != own["text"])
    changed = h(*[field(lower_ascii(v) if c == "text" else v) for c, v in own.items()])
    return docs.select(own["doc_id"].cast("long").alias("doc_id"), tree.alias("tree"), h(*[field(v) for v in own.values()]).alias("digest"), F.when(tampered, changed).alias("changed"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `at`, the place of each row in its tree in this order (from 0), and `size`, the tree's rows.

    Rows are range-partitioned by (tree, order); each partition counts its rows as they come, and a tree that began in
    earlier partitions adds their counts. Rows alike in all of this are dealt out by any number."""
    df = keep(df, "unnumbered")  # ranges are sampled first: what rows are made from is not read again for it
    parts = max(1 + df.count() // ROWS_A_PART, df.sparkSession.sparkContext.defaultParallelism)
    by = ["tree", *order, "_spread"]
    dealt = df.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(int(parts), *by).sortWithinPartitions(*by).drop("_spread")
    kept = keep(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    counts = kept.groupBy("_part", "tree").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", "tree", (before - F.col("_first")).alias("_shift"), F.sum("n").over(by_tree).alias("size"))
    return kept.join(offsets, ["_part", "tree"]).withColumn("at", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def height(size: Column | str) -> Column:
    """Levels above the leaves of a tree of so many."""
    size = F.col(size) if isinstance(size, str) else size
    return reduce(Column.__add__, [(size > FAN**k).cast("int") for k in range(15)])


def parents(nodes: str) -> Column:
    """The level above a column of nodes, of which the first begins a run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "").cast("binary"), 256))


def subtrees(kept: DataFrame, level: int, upto: int, *others: str) -> DataFrame:
    """An aligned subtree a row: tree, above (its place among the kept nodes above), size, `nodes` (the kept ones, with
    the others), and l0 to l<upto>, the levels from them up, worked out each from the one below and null beyond a root."""
    node = F.struct("at", "digest", *others)
    found = kept.groupBy("tree", F.shiftright("at", BITS * STEP).alias("above")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(node)).alias("nodes"))
    found = found.withColumn("l0", F.col("nodes.digest"))
    for k in range(1, upto + 1):
        found = found.withColumn(f"l{k}", F.when(height("size") >= level + k, parents(f"l{k - 1}")))
    return found


def checkpoints(kept: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The kept levels of a forest of leaves (tree, at, size, digest), from the leaves up, and its roots (tree, root)."""
    kept, levels, roots = kept.select("tree", "at", "size", "digest"), [], []
    while True:
        level = STEP * len(levels)
        levels.append(kept)
        roots.append(kept.filter(height("size") == level).select("tree", F.col("digest").alias("root")))
        # a tree that ends below the next kept level has its root in between
        top = F.coalesce(*[F.element_at(f"l{k}", 1) for k in reversed(range(1, STEP + 1))])
        above = subtrees(kept.filter(height("size") > level), level, STEP)
        above = keep(above.select("tree", F.col("above").alias("at"), "size", top.alias("digest"), (height("size") < level + STEP).alias("ended")), "level")
        roots.append(above.filter("ended").select("tree", F.col("digest").alias("root")))
        kept = above.filter(~F.col("ended")).drop("ended")
        if kept.isEmpty():
            return levels, reduce(DataFrame.unionByName, roots)


def siblings(nodes: str, at: Column) -> Column:
    """The other nodes of the run that the node at this place is in, behind each other."""
    first = at - F.pmod(at, F.lit(FAN))
    return F.array_join(F.concat(F.slice(nodes, first + 1, at - first), F.slice(nodes, at + 2, first + (FAN - 1) - at)), "")


PATH = "array<struct<siblings:string,left:int>>"


def steps_of(rows: DataFrame, above: DataFrame, level: int, others: list[str], carried: list[str]) -> DataFrame:
    """tree, at, digest, the others, `path` and what is carried for each node of a kept level: the path is (siblings,
    nodes to the left) of every level up to the root. `above` has it for the kept level above, where at is `above`."""
    grouped = subtrees(rows.select("tree", "at", "size", "digest", *others), level, STEP - 1, *others)
    higher = above.select("tree", F.col("at").alias("above"), F.col("path").alias("rest"), *carried)

    def step(k: int, i: Column) -> Column:
        at = F.shiftright(i, BITS * k)
        own = F.struct(siblings(f"l{k}", at).alias("siblings"), F.pmod(at, F.lit(FAN)).alias("left"))
        return F.when(height("size") > level + k, F.array(own)).otherwise(F.array().cast(PATH))

    below = F.transform("nodes", lambda x, i: F.struct(x.alias("x"), F.concat(*[step(k, i) for k in range(STEP)]).alias("below")))
    each = grouped.join(higher, ["tree", "above"]).select("tree", "rest", *carried, F.explode(below).alias("n"))
    return each.select("tree", *[F.col(f"n.x.{c}").alias(c) for c in ("at", "digest", *others)], F.concat("n.below", "rest").alias("path"), *carried)


def paths(levels: list[DataFrame], trees: DataFrame, others: list[str], carried: list[str]) -> DataFrame:
    """steps_of all leaves. `trees` (tree, path, carried) has what follows above each tree's root."""
    above = None
    for k in reversed(range(len(levels))):
        # trees of which this is the highest kept level go on with what follows above their root
        tops = levels[k].filter((F.col("at") == 0) & (height("size") < STEP * (k + 1))).select("tree")
        tops = tops.join(trees, "tree").select("tree", F.lit(0).cast("long").alias("at"), "path", *carried)
        above = tops if above is None else above.select(tops.columns).unionByName(tops)
        above = steps_of(levels[k], above, STEP * k, others if k == 0 else [], carried)
        above = keep(above, "paths") if k else above
    return above


def folded(leaf: Column, path: str) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: h(F.substr(s["siblings"], F.lit(1), s["left"] * 64), node, F.substr(s["siblings"], s["left"] * 64 + 1)))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    rows = keep(numbered(leaves(docs), ["doc_id", "digest"]), "leaves")
    levels, subroots = checkpoints(rows)
    # the trees' roots are the leaves of one tree more
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"])
    tops = keep(tops, "tops")
    upper, roots = checkpoints(tops)
    ends = roots.select("tree", F.array().cast(PATH).alias("path"), "root")
    follow = paths([tops, *upper[1:]], ends, ["name"], ["root"])
    follow = keep(follow.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "follow")
    found = paths([rows, *levels[1:]], follow, ["doc_id", "changed"], ["subroot", "root"])
    proof = F.sha2(F.array_join("path.siblings", "").cast("binary"), 256)
    done = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("changed", "digest"), "path").alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_checkpointed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _sql(deepest: int = 6) -> str:
    """The same with every level written out, for trees of up to FAN ** deepest rows."""
    text = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join([*map(text, FIELDS[:-1]), text(t)]) + ")"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(unicode(d) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    ht = " + ".join(f"CAST(size > {FAN ** k} AS INT)" for k in range(deepest))

    def forest(name: str, source: str) -> list[str]:
        out = [f"{name}0 AS (SELECT *, {ht} AS ht FROM {source})"]
        for k in range(deepest):
            out.append(f"{name}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, ht, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{k} WHERE ht > {k} GROUP BY tree, pos // {FAN}, ht)")
        for k in range(deepest):
            side = lambda c: f"coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos {c} n.pos), '')"
            out.append(f"{name}run{k} AS (SELECT n.tree, n.pos, {side('<')} AS l, {side('>')} AS r FROM {name}{k} n JOIN {name}{k} o ON o.tree = n.tree AND o.pos // {FAN} = n.pos // {FAN} WHERE n.ht > {k} GROUP BY n.tree, n.pos)")
        return [*out, f"{name}root AS (" + " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE ht = {k}" for k in range(deepest + 1)) + ")"]

    def climb(name: str, source: str) -> list[str]:
        """Proof and folded node of each row of source (tree, pos, proof, node), level by level."""
        out, last = [], source
        for k in range(deepest):
            out.append(f"{name}up{k} AS (SELECT s.* EXCLUDE (proof, node), s.proof || coalesce(l || r, '') AS proof, coalesce(sha256(l || s.node || r), s.node) AS node FROM {last} s LEFT JOIN {name}run{k} u ON u.tree = s.tree AND u.pos = s.pos // {FAN ** k})")
            last = f"{name}up{k}"
        return out

    parts = [
        f"d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS changed FROM documents)",
        "leaves AS (SELECT coalesce('=' || source, '-') AS tree, doc_id, leaf, leaf AS digest, coalesce(changed, leaf) AS changed, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf))",
        *forest("t", "leaves"),
        "tops AS (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM troot)",
        *forest("s", "tops"),
        "low AS (SELECT doc_id, leaf, tree, pos, '' AS proof, changed AS node FROM leaves)", *climb("t", "low"),
        f"high AS (SELECT u.doc_id, u.leaf, p.digest AS subroot, p.tree, p.pos, u.proof, u.node FROM tup{deepest - 1} u JOIN tops p ON p.name = u.tree)", *climb("s", "high"),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.digest AS verified FROM sup{deepest - 1} JOIN sroot r ON true"""


QUERIES = {"op11_checkpointed_manifest": op11_checkpointed_manifest}
SQL = {"op11_checkpointed_manifest": _sql()}
