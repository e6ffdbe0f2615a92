from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import queries as Q
from faultline.llm.decontamination import leaks
from faultline.llm.near_dedup import near_duplicates
from faultline.llm.quality_rules import quality_verdicts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    """Each stage on all that the one before it kept, held against its operator's own verdicts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id for r in docs.collect()})
        if i < 4:
            assert docs.columns == COLUMNS
        if i == 0:
            assert kept[0] == {r.doc_id for r in quality_verdicts(before, labels).filter("kept").collect()}
        if i == 1:
            assert kept[1] == kept[0] and docs.filter("n_chars <> length(text)").count() == 0
        if i == 2:
            assert kept[2] == {r.doc_id for r in near_duplicates(before).filter("kept").collect()}
        if i == 3:
            assert kept[3] == kept[2] - {r.doc_id for r in leaks(before, bench).collect()}
    assert kept[4] == kept[3] and docs.count() == len(kept[4])
    assert {r.doc_id for r in Q.queries()["pipeline"](spark, sf).collect()} == kept[4]


def test_stages_on_odd_tables(spark, sf, odd, nothing):
    """Nulls, repeated rows, an empty table and columns whose names clash or need quoting."""
    names = [*odd.columns, "a.b c"]
    some, none = (df.withColumn("other", F.lit("x")).toDF(*names) for df in (odd, nothing))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, some, sf)
        assert out.columns == names, name
        kept = sorted((r.doc_id for r in out.select("doc_id").collect()), key=repr)
        # The only text of enough words is one word over and over, which the quality rules reject; 5 and 6 are equal.
        assert kept == {"quality rules": [], "near dedup": [1, 2, 3, 4, 5, 7, 8, 9, None, None]}.get(name, sorted((r.doc_id for r in odd.collect()), key=repr)), name
        assert stage(spark, none, sf).count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, some, sf).count() == odd.count() and corpus_pipeline.STAGES[4][1](spark, none, sf).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert set(Q.oracle_sql()) <= set(Q.queries())
