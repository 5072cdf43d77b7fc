"""Queries of a stream that brings its own models and evaluators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyphon.operators import naive_bayes as nb
from polyphon.operators import replacement as rp
from polyphon.plans import sqltext as q
from polyphon.plans.common import events, events_spec
from polyphon.plans.registry import query
from polyphon.sources.workspace import materialize

# Some rows are replacements; their payloads were gathered on the run of STEP events they lie in.
STEP = 1000
KIND = """CASE WHEN label = 'error' AND x_k = 0 THEN 'model' WHEN label = 'error' AND x_k = 1 THEN 'evaluator'
  WHEN label = 'error' AND x_k = 2 THEN 'picture' ELSE 'instance' END"""
# The evaluators come from one who has always said this.
CONSTANT = "click"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"kind": F.expr(KIND), "run": F.expr(f"seq div {STEP}")})
    models = rp.payloads(nb.nb_train(rows, events_spec(spark, sf_dir), weight="weight", keys=("run",)), ["run"], rp.MODEL_CELL)
    said = rows.groupBy("run", F.col("label").alias("truth"), F.lit(CONSTANT).alias("pred")).agg(F.sum("weight").alias("w"))
    brought = models.withColumn("kind", F.lit("model")).unionByName(rp.payloads(said, ["run"], rp.JUDGE_CELL).withColumn("kind", F.lit("evaluator")))
    return rows.join(brought, ["run", "kind"], "left")


REPLACED = (
    q.INST,
    f"ep AS MATERIALIZED (SELECT *, sum(CASE WHEN kind = 'model' THEN 1 ELSE 0 END) OVER w AS me, sum(CASE WHEN kind = 'evaluator' THEN 1 ELSE 0 END) OVER w AS je"
    f" FROM (SELECT *, {KIND} AS kind FROM inst) WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    f"runs AS (SELECT *, seq // {STEP} AS member FROM inst)",
    q.nb_stats("runs", "held", w="weight"),
    f"brought AS MATERIALIZED (SELECT e.me AS member, h.* EXCLUDE (member) FROM ep e JOIN held h ON h.member = e.seq // {STEP} WHERE e.kind = 'model')",
    "ins AS MATERIALIZED (SELECT *, me AS member FROM ep WHERE kind = 'instance')",
    q.nb_stats("ins", "own", w="weight"),
    """models AS (SELECT member, label, attr, value, sum(w) AS w, sum(wx) AS wx, sum(wxx) AS wxx
      FROM (SELECT * FROM brought UNION ALL BY NAME SELECT * FROM own) GROUP BY ALL)""",
    q.nb_votes("ins", "brought", carry=", r.me, r.je, r.label AS truth, r.weight"),
    "mine AS MATERIALIZED (SELECT * FROM votes WHERE member = me)",
    q.argmax("mine", "best", by="instance_id", carry=", je, truth, weight"),
    f"""cells AS (SELECT je, truth, pred, weight AS w FROM best UNION ALL
      SELECT e.je, i.label, '{CONSTANT}', i.weight FROM ep e JOIN inst i ON i.seq // {STEP} = e.seq // {STEP} WHERE e.kind = 'evaluator')""",
)


@query(
    "model_replace_content",
    q.with_(*REPLACED) + """SELECT 'model' AS part, CAST(member AS BIGINT) AS epoch, label, attr, value, w, round(wx, 6) AS wx, round(wxx, 6) AS wxx FROM models
    UNION ALL SELECT 'counter', CAST(me AS BIGINT), NULL, NULL, NULL, CAST(count(*) FILTER (WHERE kind = 'instance') AS DOUBLE), NULL, NULL FROM ep WHERE kind <> 'picture' GROUP BY me
    UNION ALL SELECT 'evaluator', CAST(je AS BIGINT), truth, '#pred', pred, sum(w), NULL, NULL FROM cells GROUP BY je, truth, pred
    UNION ALL SELECT 'rejected', NULL, kind, NULL, NULL, CAST(count(*) AS DOUBLE), NULL, NULL FROM ep WHERE kind = 'picture' GROUP BY kind""",
)
def model_replace_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models, counters and evaluators the stream has had, and how many rows of each unknown kind it met."""
    spec = events_spec(spark, sf_dir)
    stream = materialize(_stream(spark, sf_dir), "kinds")
    epoched = materialize(rp.with_epochs(stream), "epochs")
    scored = rp.predictions(epoched, spec, epoched.where("kind = 'model'").count())
    none = "cast(NULL AS DOUBLE)"
    models = rp.epoch_models(epoched, spec).selectExpr(
        "'model' AS part", "model_epoch AS epoch", "label", "attr", "value", "w", "round(wx, 6) AS wx", "round(wxx, 6) AS wxx"
    )
    text = "cast(NULL AS STRING)"
    counters = rp.epoch_counters(epoched).selectExpr(
        "'counter' AS part", "model_epoch AS epoch", f"{text} AS label", f"{text} AS attr", f"{text} AS value", "double(trained_n) AS w", f"{none} AS wx", f"{none} AS wxx"
    )
    judges = rp.epoch_evaluators(epoched, scored).selectExpr(
        "'evaluator' AS part", "judge_epoch AS epoch", "truth AS label", "'#pred' AS attr", "pred AS value", "w", f"{none} AS wx", f"{none} AS wxx"
    )
    others = rp.rejected(stream).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "'rejected' AS part", "cast(NULL AS BIGINT) AS epoch", "kind AS label", f"{text} AS attr", f"{text} AS value", "double(n) AS w", f"{none} AS wx", f"{none} AS wxx"
    )
    return models.unionByName(counters).unionByName(judges).unionByName(others)
