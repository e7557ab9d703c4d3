"""The stages one after another, each against what it must let through."""

import collections
import os

import pytest
from llm.cases import awkward, awkward_rows, none
from llm.test_exact import plain_classes, wide
from llm.test_packing import check
from pyspark.sql import functions as F

import corpus_pipeline
from runloom.llm.queries import QUERIES

STAGES = dict(corpus_pipeline.STAGES)


def test_names_and_order():
    assert list(STAGES) == ["toxicity", "language", "near_copies", "packing"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_take_awkward_documents(spark, sf_dir, name):
    kept = STAGES[name](spark, awkward(spark), sf_dir)
    assert kept.columns == awkward(spark).columns
    assert not collections.Counter(tuple(r) for r in kept.collect()) - collections.Counter(map(tuple, awkward_rows()))
    assert STAGES[name](spark, none(spark), sf_dir).count() == 0


def test_run_over_all_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [d for d, m in marks.items() if m["toxic"] == 0 and m["quality"] == 1]
    assert sum(d in kept["toxicity"] for d in clean) >= 0.97 * len(clean)
    assert len(kept["language"]) >= 0.99 * len(kept["toxicity"])
    before = kept["language"]
    prints = {d: wide(corpus_pipeline.simhash.fingerprint(t, 3, 3)) for d, t in before.items()}
    root = plain_classes(set(prints.values()), 32)
    least = {root[prints[d]]: d for d in sorted(before, reverse=True)}
    # Classes are those of all pairs; a few pairs far apart may meet in no segment.
    assert set(kept["near_copies"]) >= set(least.values())
    assert len(kept["near_copies"]) <= len(least) + 0.05 * (len(before) - len(least))
    pieces = corpus_pipeline.run(spark, sf).toArrow().to_pylist()
    check(pieces, list(kept["near_copies"].items()), 1024)


def test_documents_that_are_predicted_toxic_go(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    kept = {r["doc_id"] for r in STAGES["toxicity"](spark, docs, sf).select("doc_id").collect()}
    assert len(toxic - kept) >= 0.7 * len(toxic)
    marked = docs.limit(50).withColumn("score", F.col("doc_id") % 10 / 10)
    monkeypatch.setattr(corpus_pipeline.toxicity, "detect", lambda *a, keep, **b: marked.select(*keep, "score"))
    left = STAGES["toxicity"](spark, marked.drop("score"), sf).collect()
    assert left and all(r["doc_id"] % 10 < 3 for r in left)


def test_entry_offers_all_operators():
    import __spark_entry__ as contract

    found = contract.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in found} and "pipeline" in found
    assert set(QUERIES) <= set(found)
    assert os.path.exists(contract.corpus_pipeline.__file__)


def test_nothing_goes_where_nothing_can_be_learned(spark, tmp_path):
    docs = awkward(spark)
    docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert STAGES["toxicity"](spark, docs, str(tmp_path)).count() == docs.count()
    unnamed = docs.withColumn("lang", F.lit(None).cast("string"))
    assert STAGES["language"](spark, unnamed, str(tmp_path)).count() == docs.count()


def test_documents_of_three_languages_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 1500")
    first = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.min("text").alias("t")).collect()}
    mixed = "\n".join(first[k][:1200] for k in sorted(first)[:3])
    rows = spark.createDataFrame([(10**9, mixed, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = STAGES["language"](spark, docs.select(*rows.columns).unionByName(rows), sf_dir)
    assert 10**9 in {r["doc_id"] for r in kept.collect()}
