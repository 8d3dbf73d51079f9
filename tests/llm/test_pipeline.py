"""The pipeline's stages in order, each against what its operator decides, and the opN queries against SQL."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, decontaminate, queries, secret_scan, similar, toxicity

from ..compare import SMALL, duck, same


def test_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, now, SMALL), "test-stage")
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (now, out))
        if name == "toxicity":
            model = toxicity.train(now, common.table(spark, SMALL, "labels"))
            assert after == {r["doc_id"] for r in toxicity.with_score(now, model).where("score < 0.5").collect()}
        if name == "near_duplicates":
            groups = similar.assign(now).toPandas()
            assert after == set(groups.component_id) and out.count() == len(after)
        if name == "decontamination":
            assert before - after == {r["doc_id"] for r in decontaminate.contaminated(now, common.table(spark, SMALL, "benchmark")).collect()}
        if name == "secrets":
            assert after == before
            model = secret_scan.train(secret_scan.labelled_samples(spark))
            assert secret_scan.with_spans(out.withColumn("text", F.replace("text", F.lit("<SECRET>"), F.lit(" "))), model).where("size(base_spans) > 0").count() == 0
        if name == "packing":
            assert after == before
        else:
            assert out.columns == docs.columns
        now = out
    assert corpus_pipeline.run(spark, SMALL).count() == now.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SMALL).toPandas(), duck().execute(queries.ORACLE_SQL[name]).df()) == ""
