"""Health of a set of queries."""

from pyspark.sql import functions as F

from quayside import session
from quayside.operators.evaluation import query_health
from quayside.plans import load_all


def test_queries_run_one_after_another(spark):
    """No plan holds the broadcast tables of several queries."""
    few = spark.range(3)
    held = few.join(F.broadcast(spark.range(2)), "id")
    found = query_health({"held": held, "none": held.where("id > 5"), "no_groups": few.where("id > 5").groupBy("id").count(), "total": few.where("id > 5").agg(F.sum("id"))})
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["query"]: r["has_rows"] for r in found.collect()} == {"held": True, "none": False, "no_groups": False, "total": True}
    assert [(f.name, f.dataType.simpleString()) for f in found.schema.fields] == [("query", "string"), ("has_rows", "boolean")]


class Planned:
    """A query that notes the plan it is run with."""

    def __init__(self, df):
        self.df, self.sparkSession, self.plan = df, df.sparkSession, None

    def select(self, *columns):
        return self

    def isEmpty(self):
        self.plan = self.df._jdf.queryExecution().executedPlan().toString()
        return self.df.isEmpty()


def test_health_broadcasts_small_tables_only(spark, tmp_path):
    """A side of 3 MB is broadcast by the session's bound, and exchanged where the driver runs query after query."""
    spark.range(400_000).select(F.xxhash64("id").alias("k"), "id").write.parquet(f"{tmp_path}/side")
    side = spark.read.parquet(f"{tmp_path}/side")
    joined = [side.withColumnRenamed("id", "a").join(side.where("id >= 0"), "k") for _ in range(2)]
    health = Planned(joined[0])
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    assert [tuple(r) for r in query_health({"joined": health}).collect()] == [("joined", True)]
    assert "Broadcast" not in health.plan and "Broadcast" in joined[1]._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(k, None) for k in keys] == before


def test_labels_are_looked_up_once_with_small_broadcasts(spark, tables, monkeypatch):
    from quayside.plans import answers

    seen, labels = [], answers.a.entity_labels

    def noted(*args):
        seen.append(int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")))
        return labels(*args)

    monkeypatch.setattr(answers.a, "entity_labels", noted)
    found = load_all()["a06_two_step_lookup"].build(tables)
    assert seen == [session.SMALL_BROADCAST] and "lineitem" not in found._jdf.queryExecution().executedPlan().toString()
    texts = {r["query_id"]: r["resolved"] for r in found.collect()}
    named = labels(answers.top_names(tables), [F.desc("units"), F.col("name")]).first()["labels"]
    assert texts and named and all(x.endswith((named[-20:], named[-10:] + ")", "and", "return policy")) for x in texts.values())
