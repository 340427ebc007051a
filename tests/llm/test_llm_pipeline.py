"""The pipeline's stages next to brute force, and the registered queries' shapes."""

import inspect

import corpus_pipeline
import pytest

from cloakstone.llm import decontaminate, queries
from cloakstone.llm.quality_model import keep_good
from test_llm_rules import plain_lines
from test_llm_text import least_edits, plain_components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns on the small tables, with columns whose names operators use too."""
    from cloakstone.sources.session import keep

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.selectExpr("*", "doc_id % 7 AS key", "'x' AS row", "cast(null AS string) AS copy")
    docs = docs.unionByName(docs.filter("doc_id < 5").selectExpr("cast(null AS bigint) AS doc_id", "* EXCEPT (doc_id)"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], SMALL), name.replace(" ", "_")))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])
    assert stages[5].columns == [*stages[0].columns, "copy_"]


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    marked = stages[0].join(labels, "doc_id").select("doc_id", "quality").collect()
    kept = {d for d, _ in texts(stages[1])}
    wrong = sum((r["doc_id"] in kept) != bool(r["quality"]) for r in marked)
    assert wrong <= 0.1 * len(marked)
    assert sorted(map(repr, texts(keep_good(stages[0], labels)))) == sorted(map(repr, texts(stages[1])))


def test_line_stage(stages):
    want = sorted((d, t) for d, _, _, t in plain_lines(texts(stages[1])) if d is not None)
    got = stages[2].collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_dedup_stage(stages):
    component = plain_components(texts(stages[2]), 5, 80)
    want = [d for d, _ in texts(stages[2]) if d is None or component[d] == d]
    assert sorted(str(d) for d, _ in texts(stages[3])) == sorted(map(str, want))


def test_decontamination_stage(spark, stages):
    items = [decontaminate.normal(r["text"].encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def dirty(text):
        body = decontaminate.normal(text.encode())
        for item in items:
            k, step = len(item) // 16, len(item) // (len(item) // 16 + 1)
            if any(item[j * len(item) // (k + 1) :][:step] in body for j in range(k + 1)) and least_edits(item, body) <= k:
                return True
        return False

    want = [d for d, t in texts(stages[3]) if d is None or not dirty(t)]
    assert sorted(str(d) for d, _ in texts(stages[4])) == sorted(map(str, want)) and len(want) < stages[3].count()


def test_mixing_stage(spark, stages):
    plan = corpus_pipeline.mixing.mix_plan(stages[4]).filter("copies > 0").agg({"copies": "sum"}).first()[0]
    assert stages[5].count() == plan and stages[5].groupBy("doc_id", "copy_").count().filter("count > 1 AND doc_id IS NOT NULL").count() == 0


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_queries_are_registered():
    numbers = [name.split("_")[0] for name in queries.QUERIES]
    assert numbers == [f"op{n}" for n in range(1, 11)] + ["pipeline"] and set(queries.SQL) < set(queries.QUERIES)
    assert all(len(inspect.signature(f).parameters) == 2 for f in queries.QUERIES.values()) and corpus_pipeline.ORACLE_SQL is None
