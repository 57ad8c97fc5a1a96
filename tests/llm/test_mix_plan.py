"""The mix stays a small plan: what it reads several times is written once."""

from marketlens.llm import mixing
from marketlens.llm.tables import documents


def test_plan_of_the_mix_is_small(spark, sf):
    plan = mixing.mix_documents(documents(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 10 and plan.count("FileScan") <= 10
