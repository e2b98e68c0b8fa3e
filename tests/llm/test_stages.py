"""Stages of the pipeline on rows with nulls."""

from collections import Counter

from leafgrid.llm import stages
from leafgrid.llm.common import materialise, scratch_dir
from leafgrid.llm.queries import QUERIES
from leafgrid.llm.stages import near_copies


def test_one_near_copy_stays_with_null_ids_among_them(spark):
    text = lambda name, edit="": " ".join(f"{name}{i}" for i in range(60)) + edit
    rows = [(None, text("a", " x")), (5, text("a")), (2, text("a", " y")), (None, text("b", " x")), (None, text("b", " z")), (9, text("b")), (7, text("b")), (None, text("c")), (None, text("c", " x")), (None, None), (None, None), (11, None), (4, text("d"))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "")[:1]) for r in near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(2, "a"), (7, "b"), (None, "c"), (None, ""), (11, ""), (4, "d")], key=str)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], COLUMNS)


def test_texts_of_a_shared_id_are_told_apart(spark):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a"), "x"), (1, text("b"), "x"), (1, text("b"), "x"), (1, text("a") + " a", "y"), (2, text("b") + " b", "y"), (3, text("c"), None), (3, text("c"), "z")]
    for docs in (_docs(spark, rows), _docs(spark, rows[::-1]).repartition(5)):
        got = sorted((r.doc_id, r.text[0], r.source) for r in near_copies(spark, docs, "").collect())
        assert [g[:2] for g in got] in ([(1, "a"), (1, "b"), (3, "c")], [(1, "a"), (2, "b"), (3, "c")]) and got[-1][2] is None


def test_stages_take_effect(spark, tmp_path):
    sf = str(tmp_path)
    word = lambda i, j: f"w{i * 7919 % 1000}x{j}"
    rows = [(i, "Common line\n" + " ".join(word(i, j) for j in range(60)), "s") for i in range(12)] + [(50, "common LINE", "s"), (51, None, None), (None, "alone here", "t"), (None, "alone here", "t")]
    docs = _docs(spark, rows)
    spark.createDataFrame([(7, " ".join(word(3, j) for j in range(20, 35)))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in stages.line_dedup(spark, docs, sf).collect() if r.doc_id is not None}
    assert 50 not in got and all(got[i].text == rows[i][1].split("\n")[1] and got[i].n_chars == len(got[i].text) for i in range(12)) and got[51].text == ""
    clean = {r.doc_id: r for r in stages.decontaminate(spark, docs, sf).collect()}
    assert [w for w in clean[3].text.split()[2:]] == [word(3, j) for j in range(60) if not 20 <= j < 35] and clean[4].text == rows[4][1] and clean[3].n_chars == len(clean[3].text)
    taken = stages.mix(spark, docs, sf).collect()
    assert len(taken) == len(rows) and sum(r.taken for r in taken) > 0
    for stage in (stages.line_dedup, stages.near_copies, stages.decontaminate):
        assert stage(spark, docs, sf).columns == stages.COLUMNS and stage(spark, docs.where("false"), sf).count() == 0
    assert stages.mix(spark, docs.where("false"), sf).count() == 0


def test_quality_stage_of_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    good, bad = (lambda i: f"The {i} farmers measured leaves, and the records were kept. " * 8), (lambda i: f"|| CLICK {i} $$$ ### @@ %% " * 8)
    rows = [(i, good(i) if i % 2 else bad(i), "s") for i in range(200)] + [(1, good(1), "s")] * 2 + [(None, good(7), None), (None, None, "s"), (500, "", None), (500, None, None), (501, good(3) * 3000, "t"), (502, bad(3), None)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0), (900, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = _docs(spark, rows).selectExpr("*", "'clash' AS score", "1 AS _turn")
    got = stages.quality(spark, docs, sf)
    assert got.columns == stages.COLUMNS
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    want = Counter((i, t) for i, t, _ in rows if t and t.startswith("The"))
    assert {k: n for k, n in kept.items() if k[1]} == want and kept[1, good(1)] == 3  # repeats stay, and so do texts without a doc_id
    assert stages.quality(spark, docs.where("false"), sf).count() == 0


def test_repeated_rows_go_before_the_join(spark):
    docs = _docs(spark, [(None, None, "s")] * 300 + [(None, "a b c d e f g", "s")] * 300 + [(4, "a b c d e f g", "s")] * 3 + [(6, "other words", "s")]).repartition(6)
    out = near_copies(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (4, "a b c d e f g"), (6, "other words")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Window")  # the join stands above the window


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf))
        counts.append(docs.count())
        if name != "mixing sources":
            assert docs.columns == stages.COLUMNS and docs.select("doc_id").distinct().count() == counts[-1]
            every = docs
    assert counts[0] < 200 and counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 20
    scores = {r.doc_id: r.score for r in QUERIES["op1_quality"](spark, sf).collect()}
    assert counts[0] == sum(s >= stages.LEAST_SCORE for s in scores.values())
    assert QUERIES["op7_ngram_join"](spark, _written(spark, every)).where("doc_id != component_id").count() == 0
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(corpus_pipeline.run(spark, sf)) == rows(docs)


def _written(spark, docs):
    path = scratch_dir(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    return path
