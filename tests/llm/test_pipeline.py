"""The pipeline against its stages' rules, written out plainly on a small table."""

import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcweave.llm import byte_bpe, decontaminate, quality, queries
from tests.llm.test_operators import jaccard_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "byte-level bpe"]
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    # 1: the model's own scores decide
    model = quality.train(docs, queries.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    rows = [r for r in rows if model.score(quality.features(r["text"])[None])[0] >= 0.7]
    assert len(rows) > 100
    # 2: later occurrences of three lines go
    seen = {}
    for r in rows:
        lines, gone = r["text"].split("\n"), set()
        for k in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[k : k + 3]), (r["doc_id"], k)) != (r["doc_id"], k):
                gone |= {k, k + 1, k + 2}
        r["text"] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    # 3: the smallest id of each group of near copies stays
    group = jaccard_groups([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.SHINGLE)
    least = {}
    for r, g in zip(rows, group):
        least.setdefault(g, r)
    rows = list(least.values())
    # 4: documents that hold an item go
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    finder = decontaminate.Finder(tuple((k, i.text) for k, i in enumerate(items)), decontaminate.EDIT_SHARE, decontaminate.TARGET_RECALL)
    exact = [r for r in rows if not any(decontaminate.normal(i.text) in decontaminate.normal(r["text"]) for i in items)]
    rows = [r for r in exact if not finder.find([decontaminate.normal(r["text"])])[0]]
    # 5: ids
    enc = byte_bpe.encoding(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: enc.encode_ordinary(r["text"]) for r in rows}


def test_stages_keep_columns_and_take_anything(spark, docs):
    odd = docs.limit(40).withColumns({"id": F.lit(1), "fp": F.lit("x"), "row": F.lit(2.5)})
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == odd.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()


def test_near_copies_go_by_fingerprint(spark):
    """Texts whose fingerprints differ in three bits or less are one group, also where their sets are less similar."""
    from arcweave.llm import near_copies, simhash

    # repeats weigh in a fingerprint, not in a set: a text of one shingle over and over has the set's fingerprint bits of it
    said = " ".join(["a b c d e"] * 200)
    more = said + " " + " ".join(f"y{j}" for j in range(60))
    h = [near_copies.shingle_set(t, corpus_pipeline.SHINGLE) for t in (said, more)]
    apart = (simhash.majority(simhash.shingle_hashes(said, corpus_pipeline.SHINGLE)) ^ simhash.majority(simhash.shingle_hashes(more, corpus_pipeline.SHINGLE))).bit_count()
    assert apart <= simhash.MAX_BITS and near_copies.similarity(*h) < near_copies.SIMILAR
    docs = spark.createDataFrame([(1, said), (2, more), (3, "one two three four five six seven")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).orderBy("doc_id").collect()] == [1, 3]


def test_batches_of_python_workers_are_small(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
        corpus_pipeline.to_tokens(spark, docs, "")
        assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS
        spark.conf.set(name, 10)
        corpus_pipeline.to_tokens(spark, docs, "")
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, before)
