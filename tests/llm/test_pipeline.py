import corpus_pipeline
from test_queries import prose


def test_stages(spark, tmp_path):
    item = prose(5, 12)
    line = "This line of boilerplate is on every page"
    rows = [(i, f"{prose(i, 120)}\n{line}", "en", "s", 0) for i in range(8)]
    rows += [(20, f"{prose(30, 40)} {item} {prose(31, 40)}", "en", "s", 0), (21, f"{prose(1, 120)} more", "en", "s", 0), (22, "12 34", None, "s", 0), (23, None, "en", "s", 0)]
    rows += [(24, prose(40, 60), "en", "s", 0)] * 2 + [(24, prose(41, 60), "en", "s", 0), (25, prose(40, 60), "en", "s", 0), (None, prose(42, 30), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept, counts = [], []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        counts.append(docs.count())
        kept.append({r.doc_id: r for r in docs.collect()})
        assert n == 4 or docs.columns == columns
    assert set(kept[0]) == {*range(8), 20, 21, 24, 25, None}
    assert line in kept[1][0].text and all(line not in kept[1][i].text for i in range(1, 8))
    assert set(kept[2]) == {*range(8), 20, 24, None} and counts[1:3] == [15, 12]  # of the rows of id 24, the repeated one goes
    assert item not in kept[3][20].text and kept[3][20].text.startswith(prose(30, 40))
    assert set(kept[4]) == set(kept[3])
