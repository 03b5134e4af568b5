"""Spelling variants: words near each other, found by walking a trie of all words as a relation, level by level.

Words are counted in the tasks that read the texts. Their trie is a distributed table of edges (node, child, label): a
node is a prefix that some word ends at, that goes on in several ways, or at which a walk begins; a label is what stands
between two nodes. A state is (word, position, node, edits): how far the word has been matched, where, and with no edit
or one. Each round takes the states of one depth of the trie and joins them with that depth's edges. A state without an
edit follows the edge that its word spells, and also those that differ from it by one replaced letter or that lack one
of its letters; a state with an edit only follows what its word spells. Where a word has been used up at a node that
ends a word, with one edit, the two are neighbours.

Three things keep the frontier small, and none loses a neighbour. A pair is found from one side: the longer word drops
a letter, or the word smaller in the differing letter is replaced. Walks begin half-way: edits in the second half of a
word are found in the trie of words, those in the first half in that of the reversed words, so that the first half is
matched whole and no walk fans out near the root. An edge has a Bloom filter of what words spell beyond it, and a state
with an edit must spell one of these. Every pair found is compared as text at last, so equal hashes do no harm.

A node has at most as many edges as there are letters. The words at a node that many share are dealt out in salts, and
its edges are repeated for each; the number of salts comes from the words counted below it.

Defined cases: null texts have no words; a null doc_id counts as an empty text in what is hashed; rows that repeat
count as often as they stand there; words of any length are taken whole; of near words with equal numbers the smallest
in code-point order is the form; no words give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, shared_folder, table
from .words import byte_runs, mix, pieces, prefix_sums, text_bytes

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A document's word loses a letter where its hash is a multiple of this.
SLIP = 31
#: A form stands so many times as often as the word.
FORM_RATIO = 10
#: Words counted in a task before they are handed on, and words at a node that one salt takes.
HELD_WORDS = 1 << 18
SALT_WORDS = 1 << 12
#: The depth that neighbours are written under.
FOUND = -1
#: Longs of an edge's filter.
TAIL_LONGS = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- words -----------------------------------------------------------------------------------------------------------


def letter_runs(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts; start, end and row of the runs of enough letters; their letters."""
    raw, offsets = text_bytes(column)
    low = _LOWER[raw]
    lead = raw == 0xC3  # U+00C0 to U+00FF are this byte and one that continues it
    letter = ((low >= 97) & (low <= 122)) | lead
    letter[1:] |= lead[:-1]
    starts, ends = byte_runs(letter, offsets)
    before = np.concatenate([[0], np.cumsum(lead)])
    letters = ends - starts - (before[ends] - before[starts])
    at = np.flatnonzero(letters >= LEAST_LETTERS)
    return low.tobytes(), starts[at], ends[at], np.searchsorted(offsets, starts[at], "right") - 1, letters[at]


def slipped(word: bytes, number: int) -> bytes:
    text = word.decode()
    at = number % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all documents, before any threshold on n."""

    def given(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                low, starts, ends, rows, letters = letter_runs(piece.column(1))
                begun = [zlib.crc32(f"{d}:".encode()) for d in piece.column(0).to_pylist()]
                for start, end, row, size in zip(starts.tolist(), ends.tolist(), rows.tolist(), letters.tolist(), strict=True):
                    word = low[start:end]
                    number = zlib.crc32(word, begun[row])
                    if number % SLIP == 0:
                        if size == LEAST_LETTERS:
                            continue
                        word = slipped(word, number)
                    held[word] = held.get(word, 0) + 1
                if len(held) > HELD_WORDS:
                    yield given(held)
                    held = {}
        if held:
            yield given(held)

    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- the trie --------------------------------------------------------------------------------------------------------


def prefix_rows(words: list[str]) -> dict[str, np.ndarray]:
    """Each prefix from half a word on, of the words and of the reversed words: index of the word, whether it is
    `back`, depth, hash, the code point that follows (0 at the end), and whether a walk begins there (`entry`)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("word", "back", "depth", "node", "follow", "entry")}
    size = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    for back in (False, True):
        text = "".join(w[::-1] for w in words) if back else "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        hashed = prefix_sums(mix(points.astype(np.uint64) + np.uint64(1)))
        half = (size + 1) // 2 if back else size // 2
        number = size - half + 1
        word = np.repeat(np.arange(len(words)), number)
        depth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + half[word]
        follow = np.zeros(len(word), np.int32)
        inner = depth < size[word]
        follow[inner] = points[(starts[word] + depth)[inner]]
        node = hashed(starts[word], starts[word] + depth) ^ np.uint64(0x5851F42D4C957F2D if back else 0)
        for k, v in zip(out, (word, np.full(len(word), back), depth, node.view(np.int64), follow, depth == half[word]), strict=True):
            out[k].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "word", 1 << 17):
            rows = prefix_rows(piece.column(0).to_pylist())
            at = pa.array(rows.pop("word"))
            first, second = (piece.column(i).take(at) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([first, second, *map(pa.array, rows.values())], ["id1", "id2", *rows])


def trie(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (depth, node, words, child, label, below, lengths, end) and the states that walks begin with.

    `words` are counted at the node, `below` at the child; `tails` has a bit for the hash of what each word that goes
    through spells beyond the child; `end` is (word, n) if one ends at the child."""
    words = keep(vocabulary.select("word", "n", F.xxhash64("word").alias("id1"), F.xxhash64(F.reverse("word"), F.lit(1)).alias("id2")), "words")
    rows = keep(words.select("word", "id1", "id2").mapInArrow(_prefixes, "id1 long, id2 long, back boolean, depth long, node long, follow int, entry boolean"), "prefixes")
    # an entry that only shorter words pass through is one of theirs as well: nodes depend on the prefix alone
    seen = rows.groupBy("node").agg(F.count("*").alias("words"), F.min("follow").alias("least"), F.max("follow").alias("most"), F.max("entry").alias("entry"))
    nodes = seen.filter(F.col("entry") | (F.col("least") == 0) | (F.col("least") != F.col("most"))).select("node", "words")
    path = rows.select("id1", "id2", "back", "depth", "node").join(nodes, "node").groupBy("id1", "id2", "back")
    path = path.agg(F.array_sort(F.collect_list(F.struct("depth", "node", "words"))).alias("path"))
    spelt = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    walks = keep(path.join(words, ["id1", "id2"]).select("word", "n", F.char_length("word").alias("size"), spelt.alias("spelt"), "path"), "walks")
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("up"), F.element_at("path", i + 1).alias("down"))))
    steps = walks.select("word", "n", "size", "spelt", step.alias("s"))
    label = F.substr("spelt", (F.col("s.up.depth") + 1).cast("int"), (F.col("s.down.depth") - F.col("s.up.depth")).cast("int"))
    end = F.when(F.col("s.down.depth") == F.col("size"), F.struct("word", "n"))
    edges = steps.select(F.col("s.up.depth").cast("int").alias("depth"), "s.up.node", "s.up.words", F.col("s.down.node").alias("child"), label.alias("label"), F.col("s.down.words").alias("below"),
                         tail_bit(F.substr("spelt", (F.col("s.down.depth") + 1).cast("int"))).alias("bit"), end.alias("end"))
    bits = [F.bit_or(F.when(F.shiftright("bit", 6) == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0))).alias(f"tails{k}") for k in range(TAIL_LONGS)]
    edges = edges.groupBy("depth", "node", "child").agg(F.min("words").alias("words"), F.min("label").alias("label"), F.min("below").alias("below"), *bits, F.max("end").alias("end"))
    first = F.element_at("path", 1)
    begin = walks.select("word", "n", F.substr("spelt", (first["depth"] + 1).cast("int")).alias("rest"), first["node"].alias("node"), first["words"].alias("words"), F.lit(0).alias("edits"),
                         first["depth"].cast("int").alias("depth"))
    return edges, begin


# -- the frontier ----------------------------------------------------------------------------------------------------


def tail_bit(rest: Column) -> Column:
    return F.pmod(F.xxhash64(rest), F.lit(64 * TAIL_LONGS)).cast("int")


def has_bit(bit: Column) -> Column:
    own = F.coalesce(*[F.when(F.shiftright(bit, 6) == k, F.col(f"tails{k}")) for k in range(TAIL_LONGS)])
    return F.getbit(own, F.pmod(bit, F.lit(64))) == 1


def spells(rest: Column) -> Column:
    """Whether words may spell this beyond an edge."""
    return has_bit(tail_bit(rest))


def salts(words: str) -> Column:
    return F.ceil(F.col(words) / SALT_WORDS).cast("int")


def moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States after one edge: word, n, rest, node, words, edits, depth, and `found` where a word is used up (of no depth).

    Of the edges of a node, one begins with the letter that the word goes on with; any other can only be reached by an
    edit of that letter, and what must follow then is looked at before the row of state and edge is made.
    """
    first, others = (lambda c: F.substr(c, F.lit(1), F.lit(1))), (lambda c: F.substr(c, F.lit(2)))
    left = states.withColumn("salt", F.pmod(F.xxhash64("word"), salts("words"))).drop("words", "depth")
    left = left.withColumn("rest_first", first("rest")).withColumn("rest_others", others("rest")).withColumn("others_bit", tail_bit(others("rest")))
    right = edges.withColumn("size", F.char_length("label")).withColumn("label_first", first("label")).withColumn("label_others", others("label"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), salts("words") - 1))).drop("words")
    replaced = (F.col("label_first") > F.col("rest_first")) & F.startswith("rest_others", "label_others") & ((F.col("size") > 1) | has_bit(F.col("others_bit")))
    dropped = F.startswith("rest_others", "label")
    may = (F.col("label_first") == F.col("rest_first")) | ((F.col("edits") == 0) & (replaced | dropped))
    met = left.alias("l").join(right.alias("r"), (F.col("l.node") == F.col("r.node")) & (F.col("l.salt") == F.col("r.salt")) & may)
    met = met.select("word", "n", "rest", "edits", "label", "size", "child", "below", "end", (F.col("depth") + F.col("size")).alias("depth"), *[f"tails{k}" for k in range(TAIL_LONGS)],
                     F.startswith("rest", "label").alias("spelt"), F.substr("rest", F.col("size") + 1).alias("after"), F.substr("rest", F.col("size") + 2).alias("beyond"), F.char_length("rest").alias("left"))

    spelt, fresh, size, left_ = F.col("spelt"), F.col("edits") == 0, F.col("size"), F.col("left")
    same, longer = F.substr("rest", F.lit(1), size), F.substr("rest", F.lit(1), size + 1)
    off_by_one = lambda part: F.levenshtein("label", part, 1) == 1

    def move(when: Column, edits: int, rest: Column) -> Column:
        used = F.when((rest == "") & F.lit(edits == 1), F.col("end"))
        return F.when(when, F.struct(F.lit(edits).alias("edits"), rest.alias("rest"), used.alias("found")))

    moves = F.array(
        move(spelt & fresh, 0, F.col("after")),
        move(spelt & fresh & (left_ == size + 1), 1, F.lit("")),  # its last letter dropped
        move(spelt & ~fresh & spells(F.col("after")), 1, F.col("after")),
        move(fresh & ~spelt & (left_ >= size) & (F.col("label") > same) & spells(F.col("after")) & off_by_one(same), 1, F.col("after")),
        move(fresh & ~spelt & (left_ > size) & spells(F.col("beyond")) & off_by_one(longer), 1, F.col("beyond")),
    )
    each = met.select("word", "n", F.col("child").alias("node"), F.col("below").alias("words"), "depth", F.explode(F.filter(moves, lambda m: m.isNotNull())).alias("m"))
    each = each.select("word", "n", "m.rest", "node", "words", "m.edits", "m.found", F.when(F.col("m.found").isNotNull(), FOUND).otherwise(F.col("depth")).alias("depth"))
    return each.filter((F.col("rest") != "") | F.col("found").isNotNull())


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of near words once, of any order."""
    spark = vocabulary.sparkSession
    edges, begin = trie(vocabulary)
    folder, edge_folder = shared_folder(spark, "frontier"), shared_folder(spark, "edges")
    edges.write.partitionBy("depth").parquet(edge_folder)
    found = F.lit(None).cast("struct<word:string,n:bigint>").alias("found")
    begin = begin.select("word", "n", "rest", "node", "words", "edits", found, "depth")
    begin.write.partitionBy("depth").parquet(folder)
    depth = FOUND
    while True:
        # folders are named by depth: a round reads its own only, and the names of those that wait
        states = spark.read.schema(begin.schema).parquet(folder)
        depth = states.filter(F.col("depth") > depth).agg(F.min("depth")).first()[0]
        if depth is None:
            break
        own = spark.read.schema(edges.schema).parquet(edge_folder).filter(F.col("depth") == depth)
        moved(states.filter(F.col("depth") == depth).drop("found"), own).write.partitionBy("depth").mode("append").parquet(folder)
    pairs = states.filter(F.col("depth") == FOUND).select("word", "n", F.col("found.word").alias("other"), F.col("found.n").alias("other_n")).distinct()
    return pairs.filter(F.levenshtein("word", "other", 1) == 1)


# -- forms -----------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root for (word, form): forms are followed to the last, each round twice as far. Forms stand more often
    than their words, so there are no rings."""
    links = keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("went")), "roots")
    while not links.filter("went").isEmpty():
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = keep(links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went")), "roots")
    return links.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    vocabulary = keep(word_counts(docs).filter((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LETTERS)), "vocabulary")
    pairs = keep(neighbours(vocabulary), "pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = vocabulary.join(near, "word", "left").withColumn("is_form", -F.col("best.n") >= FORM_RATIO * F.col("n"))
    form = lambda c: F.when(F.col("is_form"), c)
    known = keep(known.select("word", form(F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(-F.col("best.n")).alias("form_n")), "known")
    last = roots(known.filter(F.col("form").isNotNull()))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_relational_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


_BITS = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
_BYTES = "list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR) || ':' || w)), '..'), lambda h: CAST('0x' || h AS BIGINT))"
_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= {LEAST_LETTERS} GROUP BY doc_id, w),
hashed AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: {_BITS}), 4294967295) AS h FROM counted),
slips AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slips WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
one_way AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word < b.word UNION SELECT a.word AS x, b.word AS y FROM cut a JOIN words b ON a.less = b.word),
near AS (SELECT x AS word, y AS other FROM one_way UNION SELECT y AS word, x AS other FROM one_way),
best AS (SELECT e.word, count(*) AS n_near, first(e.other ORDER BY o.n DESC, e.other) AS other, max(o.n) AS other_n FROM near e JOIN words o ON o.word = e.other GROUP BY e.word),
known AS (SELECT w.word, CASE WHEN other_n >= {FORM_RATIO} * n THEN other END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= {FORM_RATIO} * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM known UNION ALL SELECT k.word, k.next AS root, f.form AS next FROM walk k JOIN known f ON f.word = k.next WHERE k.next IS NOT NULL)
SELECT k.word, k.form, r.root, k.n, k.n_near, k.form_n FROM known k JOIN walk r ON r.word = k.word AND r.next IS NULL"""


QUERIES = {"op13_relational_trie": op13_relational_trie}
SQL = {"op13_relational_trie": _SQL}
