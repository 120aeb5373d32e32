"""The stages one after another, each against its operator's plain meaning."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import quality_model
from tests.llm.test_documents import PRODUCTION, plain_components, plain_rules
from tests.llm.test_models import plain_quality
from tests.llm.test_tokens import best_fit_decreasing, check_places

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{where}/{n}")
        docs = spark.read.parquet(f"{where}/{n}")
        found.append(docs)
    return found


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [s.columns for s in stages[:-1]] == [columns] * 3


def test_classifier(spark, stages):
    """Against the plain score of each text; the training is compared with loops in test_models.py."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = {d for d, t in rows(docs, "doc_id", "text") if plain_quality(model, t) >= 0.3}
    assert {d for (d,) in rows(stages[0], "doc_id")} == expected
    labels = dict(rows(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "quality"))
    assert {d for d, q in labels.items() if q == 1} <= expected | (set(labels) - {d for (d,) in rows(docs, "doc_id")})


@pytest.mark.parametrize("n", range(4))
def test_cases(spark, docs, no_docs, messy, n):
    """Nulls in any column, empty and long texts, ties, repeated rows, an empty table, columns with clashing names."""
    stage = corpus_pipeline.STAGES[n][1]
    clashing = docs.withColumns({"_rejected": F.lit(1), "_gone": F.lit("g"), "sequence_id": F.lit(2), "length": F.lit(None).cast("long"), "features": F.lit(3), "host": F.lit("h")})
    got = stage(spark, clashing, SF)
    if n < 3:
        assert got.dtypes == clashing.dtypes
        assert {tuple(r)[-6:] for r in got.collect()} <= {(1, "g", 2, None, 3, "h")}
    found = Counter(d for (d,) in rows(got, "doc_id"))
    texts = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    if n == 0:
        model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        assert found == Counter(d for d, t, _ in texts if plain_quality(model, t) >= 0.3)
    elif n == 1:
        assert found == Counter(x[0] for x in plain_rules(texts, *PRODUCTION) if x[-1])
    elif n == 2:
        expected = Counter({d: 1 for d, _, c in plain_components(messy, 5, 80) if d is not None and d == c})
        assert found == expected + Counter({None: sum(d is None for d, _ in messy)})
    else:
        assert set(found) == {d for d, _ in messy}
        check_places(got.collect(), 2048)
    assert stage(spark, no_docs, SF).count() == 0


def test_rules(stages):
    judged = plain_rules(rows(stages[0], "doc_id", "text", "source"), *PRODUCTION)
    assert Counter(d for (d,) in rows(stages[1], "doc_id")) == Counter(x[0] for x in judged if x[-1])


def test_near_dedup(stages):
    found = plain_components(rows(stages[1], "doc_id", "text"), 5, 80)
    assert sorted(d for (d,) in rows(stages[2], "doc_id")) == sorted(d for d, _, c in found if d == c)


def test_packing(stages):
    placed = stages[3].collect()
    assert {r["doc_id"] for r in placed} == {d for (d,) in rows(stages[2], "doc_id")}
    assert check_places(placed, 2048) == best_fit_decreasing([r["length"] for r in placed], 2048)


def test_run(spark, stages):
    assert Counter(rows(corpus_pipeline.run(spark, SF), "doc_id", "piece", "length")) == Counter(rows(stages[3], "doc_id", "piece", "length"))
