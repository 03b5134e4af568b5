"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Base candidates are assignments to a secret-like name, access key ids and long hexadecimal runs. Long tokens with
letters and digits are wider candidates. Each candidate's value is hashed, and over the whole corpus the distinct
repositories (documents) and owners (sources) that hold the value are counted. A value that several owners hold, or
more repositories than `COPIED`, is a widely copied example; one that a single owner holds in few repositories looks
live. Base spans always stay; the wider ones are added where they look live and overlap no base span (kind `token`).

Places come from what stands between the matches: the text is split at them, and running sums of the lengths of parts
and matches give code point offsets. This runs on a row per match, so a text with many matches is no long expression.

Counting is spread over (value, owner, repository) first, so that a value that a third of the corpus holds is summed up
map-side; matches and counts then meet in an equi-join, which Spark splits where a value is hot.

Defined cases: null texts are empty and have no spans; a missing source is an owner of its own; rows that repeat
doc_id and text are one repository and get the same result each; a null doc_id is a repository like others; a column
named like one of the results is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import keep, table

#: kind: pattern, group of the value, fewest characters of the value
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: A value in more repositories than this is an example, whoever owns them.
COPIED = 20


def matches(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, key, owner, kind, order, start, end, value): every candidate of every text once."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col(f"`{owner}`").cast("string").alias("owner"), text.alias("t"))
    # what a match must contain, looked for first
    may = {"assign": F.contains("t", F.lit(":")) | F.contains("t", F.lit("=")), "access": F.contains("t", F.lit("AKIA"))}
    kinds = []
    for order, (kind, (pattern, group, _)) in enumerate(KINDS.items()):
        whole = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        if kind in may:
            whole = F.when(may[kind], whole).otherwise(F.array().cast("array<string>"))
        kinds.append(F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.lit(pattern).alias("pattern"), F.lit(group).alias("group"), whole.alias("whole")))
    found = rows.select("doc_id", "key", "owner", "t", F.explode(F.array(*kinds)).alias("k")).filter(F.size("k.whole") > 0)
    parts = []
    for kind, (pattern, group, _) in KINDS.items():  # patterns have to be literals
        own = found.filter(F.col("k.kind") == kind)
        values = F.regexp_extract_all("t", F.lit(pattern), F.lit(group)) if group else F.col("k.whole")
        gaps = F.transform(F.split("t", pattern, -1), F.length)
        parts.append(own.select("doc_id", "key", "owner", "k.kind", "k.order", F.transform("k.whole", F.length).alias("sizes"), gaps.alias("gaps"), values.alias("values")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def placed(every: DataFrame) -> DataFrame:
    """A row for each match, with its place; repeated texts count once."""
    once = every.dropDuplicates(["doc_id", "key", "kind"])
    rows = once.select("doc_id", "key", "owner", "kind", "order", F.posexplode(F.arrays_zip("sizes", F.slice("gaps", F.lit(1), F.size("sizes")).alias("gap"), "values")).alias("i", "m"))
    rows = rows.select("doc_id", "key", "owner", "kind", "order", "i", F.col("m.sizes").cast("long").alias("size"), F.col("m.gap").cast("long").alias("gap"), F.col("m.values").alias("value"))
    before = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.create_map(*[F.lit(x) for k, (_, _, n) in KINDS.items() for x in (k, n)]), F.col("kind"))
    good = (F.length("value") >= least) & ((F.col("kind") != "token") | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    return rows.filter(good).select("doc_id", "key", "owner", "kind", "order", "start", "end", F.sha2("value", 256).alias("hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over the corpus."""
    one = spans.groupBy("hash", "owner", "doc_id", "key").agg(F.lit(1).alias("x")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return one.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scanned(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of each row."""
    spans = keep(placed(matches(docs, owner)), "spans")
    live = (F.col("owners") == 1) & (F.col("repositories") <= COPIED)
    judged = spans.join(ownership(spans), "hash").withColumn("live", live).drop("owners", "repositories", "hash")
    base = F.col("kind") != "token"
    order = Window.partitionBy("doc_id", "key").orderBy("start", "order")
    ends = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    judged = judged.withColumn("met", F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False)))
    kept = judged.filter(base | (F.col("live") & ~F.col("met")))
    span = F.struct("start", "order", F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x["s"]))
    per = kept.groupBy("doc_id", "key").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.collect_list(F.when(base, span))), 256).alias("base_sha256"), joined(F.collect_list(span)).alias("spans"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example"))
    own = docs.select("doc_id", F.xxhash64("text").alias("key")).alias("d").join(per.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.key = p.key"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.select("d.doc_id", *[zero(f"n_{k}") for k in BASE], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))


def op7_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    found = " UNION ALL ".join(
        f"""SELECT doc_id, owner, '{kind}' AS kind, {order} AS ord, {least} AS least, regexp_extract_all(t, '{pattern.replace("'", "''")}') AS ms,
        regexp_extract_all(t, '{pattern.replace("'", "''")}', {group}) AS vs, string_split_regex(t, '{pattern.replace("'", "''")}') AS gs FROM d"""
        for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()))
    return f"""
WITH d AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
m AS ({found}),
p AS (SELECT doc_id, owner, kind, ord, least, vs[i] AS value,
             list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
c AS (SELECT doc_id, owner, kind, ord, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e, value FROM p
      WHERE length(value) >= least AND (kind <> 'token' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')))),
o AS (SELECT value, count(DISTINCT coalesce(owner, '-')) AS owners, count(DISTINCT doc_id) AS repos FROM c GROUP BY value),
j AS (SELECT c.*, (owners = 1 AND repos <= {COPIED}) AS live FROM c JOIN o ON c.value = o.value),
kept AS (SELECT * FROM j WHERE kind <> 'token' OR (live AND NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = j.doc_id AND b.kind <> 'token' AND b.s < j.e AND b.e > j.s))),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind <> 'token'), '')) AS base_sha256,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
      FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op7_ownership_secrets": op7_ownership_secrets}
SQL = {"op7_ownership_secrets": _sql()}
