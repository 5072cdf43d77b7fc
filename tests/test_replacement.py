"""Models and evaluators that the stream brings, against a plain fold over its rows."""

import pytest
from pyspark.sql import functions as F

from polyphon.functions.payload import encode_payload
from polyphon.operators import naive_bayes as nb
from polyphon.operators import replacement as rp
from polyphon.sources.instances import FeatureSpec

SPEC = FeatureSpec(numeric=("x",), nominal={"n": ("p", "q")}, classes=("a", "b"))
SCHEMA = "instance_id long, seq long, kind string, payload string, weight double, x double, n string, label string"


def rows_of(spark, kinds, payload):
    data = [
        (i, i, k, payload.get((k, i)), 1.0 + i % 2, float(i * 5 % 7), "pq"[i % 2], "ab"[i % 3 == 0])
        if k == "instance" else (i, i, k, payload.get((k, i)), None, None, None, None)
        for i, k in enumerate(kinds)
    ]
    return spark.createDataFrame(data, SCHEMA)


def packed(spark, cells, schema):
    return spark.createDataFrame([(cells,)], f"cells {schema}").select(encode_payload("cells").alias("p")).first().p


MODEL_CELLS = [("a", "#class", None, 4.0, None, None), ("a", "x", None, 4.0, 4.0, 6.0), ("a", "n", "p", 4.0, None, None),
               ("b", "#class", None, 2.0, None, None), ("b", "x", None, 2.0, 11.0, 61.0), ("b", "n", "q", 2.0, None, None)]


@pytest.fixture(scope="module")
def stream(spark):
    kinds = ["instance"] * 40
    kinds[7] = kinds[20] = kinds[21] = kinds[39] = "model"
    kinds[12] = kinds[30] = "evaluator"
    kinds[15] = "picture"
    kinds[16] = None
    model = packed(spark, MODEL_CELLS, rp.MODEL["cells"].dataType.simpleString())
    empty = packed(spark, [], rp.MODEL["cells"].dataType.simpleString())
    judge = packed(spark, [("a", "a", 5.0), ("b", "a", 1.0)], rp.EVALUATOR["cells"].dataType.simpleString())
    payload = {("model", 7): model, ("model", 20): model, ("model", 21): model, ("model", 39): empty, ("evaluator", 12): judge, ("evaluator", 30): judge}
    return rows_of(spark, kinds, payload)


def folded(rows):
    """The state of every epoch, row by row."""
    models, counters, epoch = {0: {}}, {0: 0}, 0
    for r in rows:
        if r.kind == "model":
            epoch += 1
            # The last one brings nothing.
            cells = MODEL_CELLS if r.seq != 39 else []
            models[epoch], counters[epoch] = {(l, a, v): [w, wx or 0, wxx or 0] for l, a, v, w, wx, wxx in cells}, 0
        elif r.kind == "instance":
            counters[epoch] += 1
            for key, x in (((r.label, "#class", None), 0), ((r.label, "x", None), r.x), ((r.label, "n", r.n), 0)):
                cell = models[epoch].setdefault(key, [0, 0, 0])
                for i in range(3):
                    cell[i] += r.weight * x**i if i == 0 or x else 0
    return models, counters


def test_models_and_counters_per_epoch(stream):
    models, counters = folded(stream.orderBy("seq").collect())
    epoched = rp.with_epochs(stream)
    got = {(r.model_epoch, r.label, r.attr, r.value): (r.w, r.wx or 0, r.wxx or 0) for r in rp.epoch_models(epoched, SPEC).collect()}
    assert got == {(e, *k): tuple(c) for e, m in models.items() for k, c in m.items()}
    assert {r.model_epoch: r.trained_n for r in rp.epoch_counters(epoched).collect()} == counters


def test_evaluators_go_on_from_what_they_bring(spark, stream):
    epoched = rp.with_epochs(stream)
    scored = rp.predictions(epoched, SPEC, epochs=4)
    # Every model with content is the same one, so one learner gives all predictions.
    one = spark.createDataFrame([(0, *c) for c in MODEL_CELLS], "member int, label string, attr string, value string, w double, wx double, wxx double")
    judged = stream.where("kind = 'instance' AND seq > 7").withColumn("member", F.lit(0))
    votes = nb.member_votes(judged, nb.nb_model(one, SPEC), SPEC, 1).collect()
    want = {}
    for e, cells in ((1, True), (2, True)):
        want |= {(e, "a", "a"): 5.0, (e, "b", "a"): 1.0}
    for r in votes:
        key = ((r.seq > 12) + (r.seq > 30), r.label, "a" if r.v_0 >= r.v_1 else "b")
        want[key] = want.get(key, 0) + r.weight
    assert {(r.judge_epoch, r.truth, r.pred): r.w for r in rp.epoch_evaluators(epoched, scored).collect()} == want


def test_unknown_kinds_are_set_aside(stream):
    assert sorted(r.seq for r in rp.rejected(stream).collect()) == [15, 16]
    assert rp.with_epochs(stream).where("seq IN (15, 16)").count() == 0


def test_a_broken_payload_stops_the_job(spark):
    broken = rows_of(spark, ["instance", "model"], {("model", 1): "!"})
    with pytest.raises(Exception, match="cannot be read"):
        rp.epoch_models(rp.with_epochs(broken), SPEC).collect()


def test_an_empty_stream_has_no_epochs(spark, stream):
    epoched = rp.with_epochs(stream.limit(0))
    assert rp.epoch_models(epoched, SPEC).count() == 0
    assert rp.epoch_evaluators(epoched, rp.predictions(epoched, SPEC, 0)).count() == 0
