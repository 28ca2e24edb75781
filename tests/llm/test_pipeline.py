"""Each stage of the pipeline against a plain version, on the small tables."""

import brute
from pyspark.sql import functions as F
from test_documents import lower
from test_packing import check

import corpus_pipeline as pipeline


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cols = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "suffix-array dedup", "packing"]
    stages = [f for _, f in pipeline.STAGES]

    from tidewright.llm import quality

    one = stages[0](spark, docs, folder)
    assert one.columns == cols
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in one.collect()} == kept

    two = stages[1](spark, one, folder)
    first = {}
    for r in sorted(one.collect()):
        first.setdefault(lower(r.text), r.doc_id)
    assert two.columns == cols and sorted(r.doc_id for r in two.collect()) == sorted(first.values())

    three = stages[2](spark, two, folder)
    rows = {r.doc_id: r.text for r in two.collect()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, w in ((d, lower(t).split()) for d, t in rows.items())}
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    stay = {d for d in ids if find(d) == d}
    got = {r.doc_id for r in three.collect()}
    assert three.columns == cols and got == stay

    four = stages[3](spark, three, folder)
    left = brute.repeats([(r.doc_id, r.text) for r in three.collect()], lambda t: t.encode())
    assert four.columns == cols
    for r in four.collect():
        n, gone, raw = left[r.doc_id]
        assert r.n_chars == len(r.text)
        exact = bytes(b for b, g in zip(raw, gone) if not g)
        if sum(gone) == 0 or raw.isascii():
            assert r.text.encode() == exact
        else:
            assert 0 <= len(r.text.encode()) - len(exact) <= 6 * sum(1 for i in range(1, n) if gone[i] != gone[i - 1]) + 6

    check(stages[4](spark, four, folder).collect(), {r.doc_id: r.text for r in four.collect()})


def test_run_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null texts, repeated rows and columns whose names the operators use themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, 5).otherwise(F.col("doc_id")))
    odd = odd.union(odd.limit(10)).withColumn("text", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("text")))
    for name in ("id", "part", "chunk", "d", "t", "kept", "row", "rest"):
        odd = odd.withColumn(name, F.lit(name))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns and 0 < left.count() <= docs.count()
    assert left.filter("kept <> 'kept' OR row <> 'row' OR id <> 'id'").count() == 0
    pieces = pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    by = {}
    for p in pieces:
        by[p.doc_id] = by.get(p.doc_id, 0) + p.length
    ends = {r.doc_id: r.n for r in left.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(by) == set(ends) and all(by[d] >= n for d, n in ends.items())
