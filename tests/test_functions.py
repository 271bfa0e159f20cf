"""Hand-checked values of Column functions."""

import json

import pytest
from pyspark.sql import functions as F

from sloframe.functions import contract, jsonops, score, stats, text
from sloframe.operators import attempts, gates, ranking, slo, stability


def one(spark, column, **values):
    """Evaluate a Column built from literals over a non-constant row."""
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in values.items()})
    return df.select(column.alias("x")).collect()[0]["x"]


def js(value):
    return jsonops.parse_strict(F.lit(json.dumps(value)))


@pytest.mark.parametrize(
    "given, want",
    [("The  quick, brown fox!", "quick brown fox"), ("A an the", ""), ("Theater of a man", "theater of man"), ("éa the à", "éa à"), ("x y\tz", "x y z")],
)
def test_qa_normalize(spark, given, want):
    assert one(spark, text.qa_normalize(F.col("t")), t=given) == want


def test_numbers(spark):
    assert one(spark, text.last_number(F.col("t")), t="I have 1,234 or -5.5") == -5.5
    assert one(spark, text.last_number(F.col("t")), t="1,234") == 1234.0
    assert one(spark, text.last_number(F.col("t")), t="none") is None
    assert one(spark, text.marked_answer(F.col("t")), t="work #### 42 ") == "42"
    assert one(spark, text.boxed_answer(F.col("t")), t=r"so \boxed{7} then \boxed{8}") == "8"


def test_set_scores(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, text.set_f1(arr("a", "b"), arr("b", "c"))) == 0.5
    assert one(spark, text.set_f1(arr(), arr())) == 1.0
    assert one(spark, text.set_f1(arr(), arr(), 0.0)) == 0.0
    assert one(spark, text.set_f1(arr("a"), arr())) == 0.0
    assert one(spark, text.set_jaccard(arr("a", "b"), arr("b", "c"))) == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    "given, want",
    [('{"b":2,"a":1}', '{"a":1,"b":2}'), ("{}", ""), ("", ""), ("{} x", ""), ('{"a":{"d":1,"c":[2, 1]}}', '{"a":{"c":[2,1],"d":1}}')],
)
def test_canonical(spark, given, want):
    assert one(spark, jsonops.canonical(F.col("t")), t=given) == want


@pytest.mark.parametrize("given, ok", [("1", True), ("-0.5", True), ('"s"', True), ("null", True), ("true", True), ("[1]", True), ("{}{}", False), ("1 2", False), ("x", False), ("", False), ("{},{}", False)])
def test_strict_json(spark, given, ok):
    assert one(spark, jsonops.is_json(F.col("t")), t=given) is ok


@pytest.mark.parametrize(
    "given, want",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        ('x ```\n\n``` {"a": {"b": 2}} tail', '{"a": {"b": 2}}'),
        ("think {no} then {\"a\": 3}", '{"a": 3}'),
        ("nothing", "{}"),
    ],
)
def test_extract_object(spark, given, want):
    assert one(spark, jsonops.extract_object(F.col("t")), t=given) == want


def test_extract_from_very_long_text(spark):
    body = "x " * 200_000 + '{"items": ' + "[" + ",".join('{"i": %d}' % i for i in range(20_000)) + "]" + "}" + " tail"
    got = one(spark, jsonops.extract_object(F.col("t")), t=body)
    assert len(json.loads(got)["items"]) == 20_000


CONTACT = {
    "type": "object",
    "properties": {"name": {"type": "string"}, "email": {"type": "string", "pattern": r"^[^@\s]+@[^@\s]+$"},
                   "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1}, "n": {"type": "integer"}, "inner": {"type": "object", "required": ["x"]}},
    "required": ["name"],
}


@pytest.mark.parametrize(
    "value, error",
    [
        ({"name": "a"}, None),
        ({}, "<root>: 'name' is a required property"),
        ({"name": 3}, "name: 3 is not of type 'string'"),
        ({"name": "a", "tags": ["x", 1]}, "tags.1: 1 is not of type 'string'"),
        ({"name": "a", "tags": []}, "tags: [] is too short"),
        ({"name": "a", "email": "nope"}, "email: 'nope' does not match '^[^@\\\\s]+@[^@\\\\s]+$'"),
        ({"name": "a", "n": 1.0}, None),
        ({"name": "a", "n": True}, "n: true is not of type 'integer'"),
        ({"name": "a", "inner": {}}, "inner: 'x' is a required property"),
        ([], "<root>: [] is not of type 'object'"),
    ],
)
def test_contract(spark, value, error):
    got = one(spark, contract.compile_contract(CONTACT)(js(value)))
    assert (got["valid"], got["error"]) == (error is None, error)


def test_contract_empty_schema_and_one_of(spark):
    assert one(spark, contract.compile_contract({})(js({"any": [1]})))["valid"]
    schema = {"oneOf": [{"type": "integer"}, {"type": "number"}]}
    assert "more than one" in one(spark, contract.compile_contract(schema)(js(3)))["error"]
    assert one(spark, contract.compile_contract(schema)(js(3.5)))["valid"]


def reward(spark, ok=1, success=1, latency=0.0, tok=0.0, lam=0.0, mu=0.0, **kw):
    parts = score.reward_parts(F.lit(ok), F.lit(success), F.lit(latency), F.lit(tok), lam, mu, **kw)
    return one(spark, parts["reward"])


def test_reward_values(spark):
    assert reward(spark) == 2.0
    assert reward(spark, ok=0) == 1.0
    assert reward(spark, latency=2000.0, lam=0.1) == pytest.approx(1.8)
    assert reward(spark, tok=500.0, mu=1.0) == pytest.approx(1.5)
    assert reward(spark, disagreement=F.lit(0.5), gamma=1.0) == pytest.approx(1.5)
    assert reward(spark, faithfulness=F.lit(1.0), kappa=1.0) == pytest.approx(2.5)
    assert reward(spark, faithfulness=F.lit(0.0), kappa=1.0) == pytest.approx(1.5)


@pytest.mark.parametrize(
    "kw, want",
    [
        ({}, "none"),
        ({"parse": "bad"}, "parse_error"),
        ({"schema": "a: wrong"}, "schema_violation"),
        ({"latency": 3000.0, "parse": "bad"}, "timeout"),
        ({"pred": {"a": 2}}, "semantic_error"),
        ({"pred": {}}, "none"),
    ],
)
def test_error_class(spark, kw, want):
    got = one(
        spark,
        score.error_class(F.lit(kw.get("latency", 100.0)), 2000.0, F.lit(kw.get("parse")).cast("string"), F.lit(kw.get("schema")).cast("string"),
                          js(kw.get("pred", {"a": 1})), js({"a": 1})),
    )
    assert got["category"] == want
    assert got["mismatched"] == (["a"] if want == "semantic_error" else [])


def test_field_breakdown(spark):
    fields = ["a", "b", "c"]
    got = one(spark, score.breakdown_accuracy(score.field_breakdown(js({"a": "X ", "b": 2, "c": 0}), js({"a": "x", "b": 2, "c": 3}), fields)))
    assert got == pytest.approx(2 / 3)
    missing = score.field_breakdown(jsonops.parse_strict(F.lit(None).cast("string")), js({"a": "x", "b": 2, "c": 3}), fields)
    assert one(spark, score.breakdown_accuracy(missing)) == 0.0
    assert one(spark, score.breakdown_exact(score.field_breakdown(js({"a": "x"}), js({"a": "X"}), ["a"])))


@pytest.mark.parametrize(
    "g, p, match, sim",
    [
        (None, None, True, 1.0), ("a b", "A  b", True, 1.0), ("a b", "a c", False, 0.5), (["a", "b"], ["b", "c"], False, 1 / 3), ([1], [], False, 0.0),
        ({"x": 1, "y": 2}, {"x": 1, "z": 2}, False, 0.5), (1, "1", False, 0.0), ("a", None, False, 0.0),
    ],
)
def test_compare_values(spark, g, p, match, sim):
    both = js({"g": g, "p": p})
    got = one(spark, score.compare_values(jsonops.field(both, "g"), jsonops.field(both, "p")))
    assert (got["match"], got["similarity"]) == (match, pytest.approx(sim))


def test_gold_function_name_and_live_rule(spark):
    assert one(spark, score.gold_function_name(F.lit('{"math.factorial": {"number": [5]}, "a": 1}'))) == "math.factorial"
    ok = lambda t, p, g: one(spark, score.correct_live(F.lit(t), F.lit(True), js(p), js(g)))
    assert ok("T4", {"name": "f"}, {"f": {"n": [5]}})
    assert not ok("T4", {"name": "g"}, {"f": {"n": [5]}})
    assert ok("T1", {"intent": "x"}, {"intent": "x"})
    assert not ok("T1", {"intent": "x"}, {})
    assert ok("T2", {"answer": " yes "}, {"answer": "yes"})
    assert ok("T9", {"a": 1, "b": "z"}, {"a": 1, "l": [1]})


def test_judge(spark):
    r = one(spark, score.judge_rollup(F.lit('{"statements":[{"support_score_0_to_3":9,"contradiction":false},{"support_score_0_to_3":0,"contradiction":true}]}')))
    assert (r["mean_support"], r["contradiction_rate"], r["faithfulness"]) == (0.5, 0.5, 0.0)
    assert one(spark, score.judge_rollup(F.lit("nope")))["contradiction_rate"] == 1.0
    assert one(spark, score.judge_rollup(F.lit("{}")))["faithfulness"] == 1.0


def test_erfc(spark):
    import math

    for x in (0.0, 0.3, 1.0, 2.5):
        assert one(spark, stats.erfc(F.lit(x))) == pytest.approx(math.erfc(x), abs=2e-7)


@pytest.mark.parametrize("values, want", [((90, 70, 80), [1, 3, 2]), ((80, 80, 90), [2.5, 2.5, 1]), ((50, 50, 50), [2, 2, 2])])
def test_average_rank(spark, values, want):
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(values)], "t string, i int, v double")
    got = df.withColumn("r", ranking.average_rank("v", ["t"])).orderBy("i").collect()
    assert [r["r"] for r in got] == want


@pytest.mark.parametrize(
    "a, b, want",
    [((1, 2, 3, 4, 5), (1, 2, 3, 4, 5), 1.0), ((1, 2, 3, 4, 5), (5, 4, 3, 2, 1), -1.0), ((1, 2), (1, 2), 0.0), ((0, 0, 9, 9), (0, 9, 0, 9), 0.0)],
)
def test_spearman(spark, a, b, want):
    df = spark.createDataFrame([("t", float(x), float(y)) for x, y in zip(a, b)], "t string, a double, b double")
    assert ranking.spearman(df, ["t"], "a", "b").collect()[0]["rho"] == pytest.approx(want)


def test_tier_counts(spark):
    df = spark.createDataFrame([("m", 3000.0, True, True), ("m", 100.0, True, False)], "model string, latency_ms double, task_correct boolean, json_valid boolean")
    got = {r["tier"]: r for r in slo.tier_counts(df, ["model"]).collect()}
    assert [got[t]["on_time"] for t in ("interactive", "standard", "batch")] == [1, 2, 2]
    assert [got[t]["success_at_slo"] for t in ("interactive", "standard", "batch")] == [0, 1, 1]
    assert got["batch"]["correct"] == 2
    assert slo.tier_counts(df.where("false"), ["model"]).collect() == []


def test_stability_means(spark):
    data = [("p", "x")] * 3 + [("q", "x"), ("q", "x"), ("q", "y")] + [("r", "x"), ("r", "y")] + [("s", "x")]
    df = spark.createDataFrame([("all", *r) for r in data], "k string, prompt string, out string")
    per = {r["prompt"]: r["agreement"] for r in stability.prompt_agreement(df, ["prompt"], F.col("out")).collect()}
    assert per == {"p": 1.0, "q": pytest.approx(2 / 3), "r": 0.5}
    single = stability.disagreement(df.where("prompt = 's'"), ["k"], ["prompt"], F.col("out"), 2).collect()[0]
    assert single["agreement_rate"] is None and single["num_groups"] == 1


def test_vote_ties_and_fallback(spark):
    data = [("p", 0, "b", True), ("p", 1, "a", True), ("p", 2, "a", False), ("q", 0, "x", False), ("q", 1, "y", False)]
    df = spark.createDataFrame(data, "prompt string, i int, out string, ok boolean")
    got = {r["prompt"]: (r["output"], r["attempt"]) for r in stability.majority_vote(df, ["prompt"], F.col("out"), F.col("ok"), F.col("i")).collect()}
    assert got == {"p": ("b", 0), "q": ("y", 1)}


def test_gates_treat_missing_as_failed(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 100.0), ("b", 1.0, None, 100.0)], "m string, json_valid_rate double, schema_valid_rate double, p95_latency_ms double")
    got = {r["m"]: (r["tier_bronze"], r["tier_silver"], r["highest_tier"]) for r in gates.tier_gates(df).collect()}
    assert got == {"a": (True, False, "bronze"), "b": (False, False, "none")}


def test_attempt_helpers(spark):
    assert one(spark, attempts.validation_ms(F.create_map(F.lit("validation_start"), F.lit(1.0)))) == 0.0
    assert one(spark, attempts.mean_logprob(F.array().cast("array<double>"))) is None


def test_groups_with_one_arm_give_null(spark):
    from sloframe.operators import compare

    df = spark.createDataFrame([("a", "x", 1.0, True), ("a", "y", 2.0, False), ("b", "x", 1.0, True), ("c", "y", 3.0, True)], "g string, arm string, v double, ok boolean")
    tests = {r.g: r for r in compare.proportion_test(df, ["g"], "arm", "x", F.col("ok")).collect()}
    assert tests["a"].z is not None and tests["b"].z is None and tests["c"].p1 is None and tests["c"].p1_lower is None
    assert {r.g: r.ks for r in compare.ks_distance(df, ["g"], "v", "arm", "x").collect()} == {"a": 1.0, "b": None, "c": None}


def test_missing_predictions_latencies_and_levels(spark):
    from sloframe.operators import classify, filters, slo

    df = spark.createDataFrame([("a", "a", 1.0, "weird"), ("b", None, None, None), ("b", "b", 9.0, "debug")], "y string, p string, latency_ms double, level string")
    assert classify.macro_f1(df, [], "y", "p").first().macro_f1 == 1.0
    assert classify.macro_f1(df, [], "y", "p", missing="none").first().n_labels == 3
    assert classify.unscored(df, [], "y", "p").first().n_unscored == 1
    limits = spark.createDataFrame([(0.5,), (1.0,), (100.0,)], "threshold_ms double")
    table = {r.threshold_ms: r.on_time for r in slo.success_curve_table(df, [], limits).collect()}
    assert table == {r.threshold_ms: r.on_time for r in slo.success_curve(df, [], [0.5, 1.0, 100.0]).collect()} == {0.5: 0, 1.0: 1, 100.0: 2}
    assert filters.at_least_level(df, "level", "INFO").count() == 2


def test_blocked_terms_are_stripped_and_blank_ones_skipped(spark):
    from sloframe.functions.text import blocklist_hit

    df = spark.createDataFrame([("Good day",), ("bad day",)], "t string")
    assert [r[0] for r in df.select(blocklist_hit([F.col("t")], ["", "  ", " BAD "])).collect()] == [False, True]


def test_fingerprints_tell_cells_apart(spark):
    from sloframe.sources.fingerprint import table_fingerprint

    one = spark.createDataFrame([("a\x1f=b", "c")], "x string, y string")
    two = spark.createDataFrame([("a", "b\x1f=c")], "x string, y string")
    assert table_fingerprint(one).first().fingerprint != table_fingerprint(two).first().fingerprint


def test_first_violation_stops_at_the_first(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "enum": [1, "x", None]}, "l": {"items": {"type": "string", "pattern": "^t"}}}}
    texts = ['{"a": 1, "l": ["t", "t1"]}', '{"a": null}', '{"a": 2, "l": ["q"]}', '{"a": "x"}', '{"a": 1, "l": ["t", "q", 3]}', '{"l": [1]}', "[]", "null", None, "{"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(jsonops.parse_strict(F.col("t")).alias("v"))
    first = df.select(contract.first_violation(F.col("v"), schema).alias("e"))
    # No list of all messages is built.
    assert "flatten" not in first._jdf.queryExecution().analyzed().toString()
    every = df.select(F.when(F.col("v").isNull(), "<root>: not valid JSON").otherwise(F.try_element_at(contract.violations(F.col("v"), schema), F.lit(1))).alias("e"))
    assert [r.e for r in first.collect()] == [r.e for r in every.collect()]


def test_gold_scores_makes_each_struct_once(spark, tmp_path):
    from __spark_entry__ import queries

    events = spark.range(9).selectExpr("id event_id", "timestamp'2024-01-01' ts", "id user_id", "'view' event_type", "1.5D value", "'{\"k\": ' || id || '}' props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    scored = queries()["gold_scores"](spark, str(tmp_path))
    # Pred and gold of three structs.
    assert 0 < scored._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 6
    assert {r.event_id: (r.em, r.cite_acc, r.plain_matches) for r in scored.where("event_id in (0, 4, 7)").collect()} == {0: (0.0, 0.5, 0), 4: (1.0, 1.0, 0), 7: (0.0, 1.0, 0)}
