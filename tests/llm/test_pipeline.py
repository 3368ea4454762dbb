"""The pipeline: each stage on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import mixing, packing, pii, simhash

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, []
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        kept.append(docs)
    good, single, clean, mixed = kept
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum(labels[i] == 0 for i in ids if i in labels) <= 3
    assert sum(labels[i] == 1 and i not in ids for i in labels) <= 3
    groups = simhash.near_groups(good).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    assert clean.count() == single.count()
    assert pii.spans_of(clean).filter("size(base) > 0").count() == 0
    want = {r.doc_id: r.n_copies for r in mixing.mix(clean).collect()}
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert packed.agg({"length": "sum"}).first()[0] == packing.pack(mixed).agg({"length": "sum"}).first()[0]


def test_run_equals_stages(spark, tmp_path):
    """The same pieces as by one stage after the other, and sequences without gap or overlap."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = corpus_pipeline.run(spark, sf).collect()
    pieces = lambda found: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert rows and pieces(rows) == pieces(docs.collect())
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


def test_stages_leave_values_of_clashing_columns(spark):
    """Every name that a stage uses for itself, as a column of the user's."""
    names = "_score _key _place _copy _row _hash _source size target source_size n_copies taken copies cut spans base _text".split()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    docs = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)
