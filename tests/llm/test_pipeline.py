"""The pipeline's stages on a small table, each against a plain version, and on tables without rows."""

import corpus_pipeline as cp
from parley.llm import decontaminate, lines, near_copies
from test_lines import plain as plain_lines
from test_packing import check_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    filler = " ".join(f"filler{i}" for i in range(400))
    story = [f"story{i % 50} went{i} home" for i in range(60)]
    rows = [(1, "\n".join(story)), (2, "\n".join([*story[:30], "another line here", *story[31:]])), (3, None), (4, "123 456"), (5, "start " + item.upper() + " end"),
            (6, filler + " " + item), (7, "a single clean line of text"), (8, "a single clean line of text"), (9, "a fresh one\nlast line of its own here")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert docs.columns == before.columns
            docs = spark.createDataFrame([tuple(r) for r in docs.collect()], docs.schema)
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["language"]) == {1, 2, 5, 6, 7, 8, 9}
    gone = plain_lines([(i, t) for i, t in rows if i in seen["language"]])
    for i, t in rows:
        if i in seen["language"]:
            left = [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
            assert seen["line_dedup"].get(i) == ("\n".join(left) if left else None)
    assert set(seen["near_dedup"]) == set(seen["line_dedup"])
    assert set(seen["decontaminate"]) == set(seen["near_dedup"]) - {5} and "thirteen" not in seen["decontaminate"][6] and "filler399" in seen["decontaminate"][6]
    check_pieces(docs.collect(), list(seen["decontaminate"].items()), 4096)


def test_near_copies_leave_one(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:50], "new", *words[51:]]), "else entirely", " ".join(words)]
    df = spark.createDataFrame([(10 + i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == [10, 12]


def test_run_equals_its_stages(spark):
    """The same documents, whole, as from the stages called one after the other on collected rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = docs.count()
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame([tuple(r) for r in docs.collect()], docs.schema)

    def by_document(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            tokens, at = out.get(r.doc_id, (r.doc_tokens, 0))
            assert (tokens, at) == (r.doc_tokens, r.start)
            out[r.doc_id] = (tokens, at + r.length)
        assert all(tokens == at for tokens, at in out.values())
        return out

    got = by_document(cp.run(spark, sf).collect())
    assert got == by_document(docs.collect()) and every > len(got) > 0.5 * every


def test_tables_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
    assert lines.without_lines(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() == []
    assert decontaminate.decontaminate(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect() == []


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["_text", "_lang", "_removed", "_key", "_clean", "_c0", "node", "key", "_hit", "lines"]
    row = (1, "one line here\nand another one there", "en", "s", 0, *names)
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    docs = spark.createDataFrame([row, (2, *row[1:])], schema)
    spark.createDataFrame([(1, "benchmark words of no document")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and tuple(min(out.collect())) == row, name
