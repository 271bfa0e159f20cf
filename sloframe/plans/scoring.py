"""Queries: contracts, task scores, error classes, rewards, gates."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sloframe.functions import contract, jsonops, score
from sloframe.operators import contracts, slo
from sloframe.plans.registry import query, rounded
from sloframe.plans.views import EPISODES_SQL, dealt, episodes, table, wide


def _json(**parts):
    """JSON object text from Columns that already hold JSON values."""
    body = []
    for i, (k, v) in enumerate(parts.items()):
        body += [F.lit(("{" if i == 0 else ", ") + f'"{k}": '), v.cast("string")]
    return F.concat(*body, F.lit("}"))


def _str(c):
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


RANGE_CONTRACT = {
    "type": "object",
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 95}},
    "required": ["k"],
    "additionalProperties": False,
}


def _outputs(spark, d):
    e = episodes(spark, d, heavy=True)
    case, k = F.col("event_id") % 8, F.col("k").cast("string")
    raw = (
        F.when(case <= 2, F.col("output_json"))
        .when(case == 3, F.concat(F.lit('{"k": "'), k, F.lit('"}')))
        .when(case == 4, F.concat(F.lit('{"k": 12, "x": '), k, F.lit("}")))
        .when(case == 5, F.lit("{}"))
        .when(case == 6, F.concat(F.lit('{"k": '), k, F.lit(".5}")))
        .otherwise(F.concat("output_json", F.lit("}")))
    )
    return e.withColumn("raw", raw)


@query(
    "contract_validation",
    f"WITH {EPISODES_SQL}, r AS (SELECT event_id, CASE WHEN event_id % 8 <= 2 AND k < 10 THEN 'k: ' || k || ' is less than the minimum of 10'" + """
    WHEN event_id % 8 <= 2 AND k > 95 THEN 'k: ' || k || ' is greater than the maximum of 95' WHEN event_id % 8 <= 2 THEN NULL
    WHEN event_id % 8 = 3 THEN 'k: ''' || k || ''' is not of type ''integer''' WHEN event_id % 8 = 4 THEN '<root>: Additional properties are not allowed (''x'' was unexpected)'
    WHEN event_id % 8 = 5 THEN '<root>: ''k'' is a required property' WHEN event_id % 8 = 6 THEN 'k: ' || k || '.5 is not of type ''integer''' ELSE '<root>: not valid JSON' END AS error FROM episodes)
  SELECT event_id, error IS NULL AS valid, error FROM r""",
)
def contract_validation(spark, d):
    check = contract.compile_contract(RANGE_CONTRACT)
    return _outputs(spark, d).select("event_id", check(jsonops.parse_strict(F.col("raw"))).alias("c")).select("event_id", "c.valid", "c.error")


# Schemas as rows: a closed range, several types with a list of values, and a choice.
SCHEMAS = {
    "p0": RANGE_CONTRACT,
    "p1": {"type": "object", "properties": {"k": {"type": ["integer", "string"], "maximum": 50}, "x": {"enum": [20, 30, "40"]}}},
    "p2": {"type": "object", "oneOf": [
        {"properties": {"k": {"type": "integer", "minimum": 40}}, "required": ["k"]},
        {"properties": {"k": {"type": "number", "maximum": 60}}, "required": ["k"]},
    ]},
}


@query(
    "contract_by_schema",
    f"WITH {EPISODES_SQL}, c AS (SELECT event_id, user_id % 4 AS p, event_id % 8 AS c, k FROM episodes), r AS (SELECT event_id, 'p' || p AS schema_path, CASE" + """
    WHEN p = 3 THEN '<root>: no schema for path ''p3''' WHEN c = 7 THEN '<root>: not valid JSON'
    WHEN p = 0 AND c <= 2 AND k < 10 THEN 'k: ' || k || ' is less than the minimum of 10' WHEN p = 0 AND c <= 2 AND k > 95 THEN 'k: ' || k || ' is greater than the maximum of 95'
    WHEN p = 0 AND c = 3 THEN 'k: ''' || k || ''' is not of type ''integer''' WHEN p = 0 AND c = 4 THEN '<root>: Additional properties are not allowed (''x'' was unexpected)'
    WHEN p = 0 AND c = 5 THEN '<root>: ''k'' is a required property' WHEN p = 0 AND c = 6 THEN 'k: ' || k || '.5 is not of type ''integer'''
    WHEN p = 1 AND c <= 2 AND k > 50 THEN 'k: ' || k || ' is greater than the maximum of 50' WHEN p = 1 AND c = 4 AND k NOT IN (20, 30) THEN 'x: ' || k || ' is not one of [20, 30, ''40'']'
    WHEN p = 1 AND c = 6 THEN 'k: ' || k || '.5 is not of type ''integer'', ''string'''
    WHEN p = 2 AND c <= 2 AND k BETWEEN 40 AND 60 THEN '<root>: {"k":' || k || '} is valid under more than one of the given schemas'
    WHEN p = 2 AND c = 3 THEN '<root>: {"k":"' || k || '"} is not valid under any of the given schemas' WHEN p = 2 AND c = 5 THEN '<root>: {} is not valid under any of the given schemas'
    WHEN p = 2 AND c = 6 AND k >= 60 THEN '<root>: {"k":' || k || '.5} is not valid under any of the given schemas' END AS error FROM c)
  SELECT event_id, schema_path, error IS NULL AS valid, error FROM r""",
)
def contract_by_schema(spark, d):
    schemas = spark.createDataFrame([(p, json.dumps(s)) for p, s in SCHEMAS.items()], "schema_path string, schema_json string")
    records = _outputs(spark, d).select("event_id", F.concat(F.lit("p"), F.col("user_id") % 4).alias("schema_path"), "raw")
    return contracts.validate(records, schemas, ["event_id"])


TOOL_CONTRACT = {
    "type": "object",
    "properties": {
        "tool": {"type": "string", "enum": ["A", "N", "R"]},
        "tags": {"type": "array", "items": {"type": "string", "pattern": "^t[0-9]+$"}, "minItems": 1, "maxItems": 3},
        "arguments": {
            "type": "object",
            "oneOf": [
                {"properties": {"status": {"type": "string", "enum": ["F", "O"]}, "line": {"type": "integer"}}, "required": ["status", "line"], "additionalProperties": False},
                {"properties": {"id": {"type": "string"}}, "required": ["id"], "additionalProperties": False},
            ],
        },
    },
    "required": ["tool", "arguments"],
    "additionalProperties": False,
}


@query(
    "contract_tool_calls",
    """WITH r AS (SELECT l_returnflag, l_orderkey % 9 AS c FROM lineitem)
  SELECT l_returnflag, CASE WHEN c IN (0, 1, 8) THEN NULL WHEN c IN (2, 3) THEN 'arguments' WHEN c = 4 THEN 'tool' WHEN c = 5 THEN 'tags' WHEN c = 6 THEN 'tags.1' ELSE '<root>' END AS at,
    count(*) AS n, count(*) FILTER (WHERE c IN (0, 1, 8)) AS n_valid FROM r GROUP BY 1, 2""",
)
def contract_tool_calls(spark, d):
    li = wide(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    li = dealt(li, "l_orderkey", "l_linenumber")
    case = F.col("l_orderkey") % 9
    status, line = _str(F.col("l_linestatus")), F.col("l_linenumber")
    both = _json(status=status, line=line)
    args = (
        F.when(case == 1, F.lit('{"id": "x"}'))
        .when(case == 2, _json(status=status))
        .when(case == 3, _json(status=status, line=line, id=F.lit('"x"')))
        .otherwise(both)
    )
    tool = F.when(case == 4, F.lit('"Z"')).otherwise(_str(F.col("l_returnflag")))
    tags = F.when(case == 5, F.lit("[]")).when(case == 6, F.lit('["t1", "u2"]')).otherwise(F.lit('["t1", "t22"]'))
    raw = F.when(case == 7, _json(arguments=args)).when(case == 8, _json(tool=tool, arguments=args)).otherwise(_json(tool=tool, tags=tags, arguments=args))
    check = contract.compile_contract(TOOL_CONTRACT)
    out = li.select("l_returnflag", check(jsonops.parse_strict(raw)).alias("c"))
    return out.groupBy("l_returnflag", F.split("c.error", ":")[0].alias("at")).agg(F.count(F.lit(1)).alias("n"), F.count_if("c.valid").alias("n_valid"))


SCORED_SQL = """scored AS (SELECT event_id, event_type, k, 't' || (event_id % 6 + 1) AS tt, event_id % 97 <> 0 AS jv FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def scored_records(spark, d):
    """One record of each task type in turn, with gold and output as JSON text."""
    e = episodes(spark, d, heavy=True)
    k, name = F.col("k"), F.col("task")
    odd, third = k % 2 == 1, k % 3 == 0
    lit = F.lit
    pairs = {
        "t1": (
            _json(category=_str(name), severity=_str(k % 3), source=lit('"x"'), time_window=lit('"w"'), tags=lit('["a", "b"]')),
            _json(category=_str(F.upper(name)), severity=_str(F.when(odd, k % 3).otherwise(9)), source=lit('" X "'), time_window=lit('"w"'),
                  tags=F.when(k % 5 == 0, lit('["a", "c"]')).otherwise(lit('["B", "A "]'))),
        ),
        "t2": (
            _json(short_summary=lit('"alpha beta gamma"'), key_points=lit('["one two", "three"]'), primary_risk=lit('"R"'), recommended_action=lit('"go"')),
            _json(short_summary=F.when(odd, lit('"Alpha  beta"')).otherwise(lit('"delta"')), key_points=lit('["one", "two three"]'), primary_risk=lit('"r"'), recommended_action=lit('"stop"')),
        ),
        "t3": (
            _json(tool=_str(name), arguments=_json(k=k)),
            _json(tool=_str(F.upper(name)), arguments=_json(k=F.when(third, k + 1).otherwise(k), extra=lit("true"))),
        ),
        "t4": (
            F.concat(lit('{"'), name, lit('": {"k": ['), k.cast("string"), lit(', "any"], "u": ["x"]}}')),
            _json(name=_str(F.when(k % 4 == 0, lit("nope")).otherwise(name)), arguments=_json(k=k, u=F.when(third, lit('"y"')).otherwise(lit('"X"')))),
        ),
        "t5": (
            lit('{"patch": "diff --git a b"}'),
            F.when(odd, lit('{"patch": "short"}')).otherwise(lit('{"patch": "diff --git a c"}')),
        ),
        "t6": (
            _json(answer=k),
            F.when(~odd, F.concat(lit('{"answer": "the answer is '), k.cast("string"), lit('.0"}'))).when(third, _json(answer=k)).otherwise(lit('{"answer": "none"}')),
        ),
    }
    tt = F.concat(lit("t"), F.col("event_id") % 6 + 1)
    gold = pred = None
    for t, (g, p) in pairs.items():
        gold = F.when(tt == t, g) if gold is None else gold.when(tt == t, g)
        pred = F.when(tt == t, p) if pred is None else pred.when(tt == t, p)
    return e.select("event_id", "model", "k", "latency_ms", "json_valid", tt.alias("task_type"), gold.alias("gold_text"), pred.alias("pred_text")).select(
        "*", jsonops.parse_strict(F.col("gold_text")).alias("gold"), jsonops.parse_strict(F.col("pred_text")).alias("pred")
    )


_FORMULAS = {
    "t1": {"t1_field_acc": "CASE WHEN k % 2 = 1 THEN 1 ELSE 0.75::DOUBLE END", "t1_tag_f1": "CASE WHEN k % 5 = 0 THEN 0.5::DOUBLE ELSE 1 END",
           "t1_exact_match": "CAST(k % 2 = 1 AND k % 5 <> 0 AS INT)"},
    "t2": {"t2_summary_f1": "CASE WHEN k % 2 = 1 THEN 0.8::DOUBLE ELSE 0 END", "t2_key_point_f1": "1", "t2_primary_risk_match": "1", "t2_action_match": "0"},
    "t3": {"t3_tool_match": "1", "t3_args_match": "CAST(k % 3 <> 0 AS INT)", "t3_success": "CAST(k % 3 <> 0 AS INT)"},
    "t4": {"t4_func_match": "CAST(k % 4 <> 0 AS INT)", "t4_args_acc": "CASE WHEN k % 4 = 0 THEN 0 WHEN k % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END",
           "t4_success": "CAST(k % 4 <> 0 AND k % 3 <> 0 AS INT)"},
    "t5": {"t5_has_patch": "CAST(k % 2 = 0 AS INT)", "t5_valid_diff": "CAST(k % 2 = 0 AS INT)", "t5_patch_f1": "CASE WHEN k % 2 = 0 THEN 0.75::DOUBLE ELSE 0 END"},
    "t6": {"t6_exact_match": "CAST(k % 2 = 1 AND k % 3 = 0 AS INT)", "t6_numeric_match": "CAST(k % 2 = 0 OR k % 3 = 0 AS INT)", "t6_success": "CAST(k % 2 = 0 OR k % 3 = 0 AS INT)"},
}


@query(
    "task_scores",
    f"WITH {SCORED_SQL}, m AS (SELECT tt, 'json_valid' AS metric, CAST(jv AS INT)::DOUBLE AS v FROM scored"
    + "".join(f" UNION ALL SELECT tt, '{m}', {f} FROM scored WHERE tt = '{t}'" for t, fs in _FORMULAS.items() for m, f in fs.items())
    + ") SELECT tt AS task_type, metric, round(avg(v), 6) AS mean, count(*) AS n FROM m GROUP BY 1, 2",
)
def task_scores(spark, d):
    r = scored_records(spark, d)
    m = r.select("task_type", score.score_record(F.col("task_type"), F.col("pred"), F.col("gold"), F.col("json_valid")).alias("metrics"))
    return rounded(slo.metric_means(m, ["task_type"]))


@query(
    "tool_call_match",
    """SELECT l_returnflag, l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_orderkey % 11 <> 0) AS tool_match, count(*) FILTER (WHERE l_orderkey % 11 <> 0 AND l_orderkey % 7 <> 0) AS success
  FROM lineitem GROUP BY 1, 2""",
)
def tool_call_match(spark, d):
    li = wide(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    li = dealt(li, "l_orderkey", "l_linenumber")
    gold = _json(tool=_str(F.col("l_returnflag")), arguments=_json(status=_str(F.col("l_linestatus")), line=F.col("l_linenumber")))
    shifted = F.col("l_linenumber") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)
    tool = F.when(F.col("l_orderkey") % 11 == 0, F.lit("X")).otherwise(F.lower("l_returnflag"))
    pred = _json(tool=_str(tool), arguments=_json(line=shifted, status=_str(F.col("l_linestatus")), note=F.lit("null")))
    parsed = li.select("l_returnflag", "l_suppkey", jsonops.parse_strict(pred).alias("pred"), jsonops.parse_strict(gold).alias("gold"))
    s = score.tool_scores(F.col("pred"), F.col("gold"))
    out = parsed.select("l_returnflag", "l_suppkey", s["t3_tool_match"].alias("m"), s["t3_success"].alias("s"))
    return out.groupBy("l_returnflag", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("m").cast("bigint").alias("tool_match"), F.sum("s").cast("bigint").alias("success")
    )


@query(
    "function_call_match",
    """SELECT event_id, CAST(k % 4 <> 0 AS INT)::DOUBLE AS func_match, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END AS args_acc, CAST(k % 4 <> 0 AND k % 3 <> 0 AS INT)::DOUBLE AS success
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 6 = 3""",
)
def function_call_match(spark, d):
    r = scored_records(spark, d).where("task_type = 't4'")
    s = score.function_scores(F.col("pred"), F.col("gold"))
    return r.select("event_id", s["t4_func_match"].alias("func_match"), s["t4_args_acc"].alias("args_acc"), s["t4_success"].alias("success"))


@query(
    "intent_and_answer_scores",
    """WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  SELECT event_type, round(avg((1 + CAST(k % 2 = 0 AS INT) + CAST(k % 3 = 0 AS INT)) / 3.0::DOUBLE), 6) AS intent_field_acc, round(avg(CAST(k % 5 = 0 AS INT)), 6) AS answer_match,
    round(avg(CASE WHEN k % 5 = 0 THEN 1 ELSE 0.8::DOUBLE END), 6) AS answer_f1, round(avg(greatest(k / 100.0::DOUBLE, 0.5::DOUBLE)), 6) AS faithfulness FROM e GROUP BY event_type""",
)
def intent_and_answer_scores(spark, d):
    e = episodes(spark, d, heavy=True)
    k = F.col("k")
    gold = _json(intent=_str(F.col("task")), domain=_str(k % 7), is_oos=F.lit("true"), answer=F.lit('"one two"'))
    pred = _json(
        intent=_str(F.upper("task")), domain=_str(F.when(k % 2 == 0, k % 7).otherwise(8)), is_oos=F.when(k % 3 == 0, F.lit("true")).otherwise(F.lit("false")),
        answer=F.when(k % 5 == 0, F.lit('"Two  one"')).otherwise(F.lit('"two three one"')),
    )
    both = e.select("task", "faithfulness", jsonops.parse_strict(pred).alias("pred"), jsonops.parse_strict(gold).alias("gold"))
    answer = score.answer_scores(F.col("pred"), F.col("gold"))
    out = both.select(
        F.col("task").alias("event_type"), score.field_accuracy(F.col("pred"), F.col("gold"), score.INTENT_FIELDS).alias("a"),
        (answer["t2_answer_f1"] == 1).cast("double").alias("m"), answer["t2_answer_f1"].alias("f"), score.blended_faithfulness(F.col("faithfulness"), F.lit(0.5)).alias("b"),
    )
    return rounded(
        out.groupBy("event_type").agg(F.avg("a").alias("intent_field_acc"), F.avg("m").alias("answer_match"), F.avg("f").alias("answer_f1"), F.avg("b").alias("faithfulness"))
    )


FIELDS = ["name", "tags", "cfg", "n", "gone", "note"]


@query(
    "field_breakdown",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
  f AS (SELECT event_id, 'name' AS field, k % 2 = 0 AS match, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 * 0.5::DOUBLE * 1 / 1.5 END AS similarity FROM e
    UNION ALL SELECT event_id, 'tags', k % 3 = 0, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 1 / 3.0::DOUBLE ELSE 0 END FROM e
    UNION ALL SELECT event_id, 'cfg', k % 5 = 0, CASE WHEN k % 5 = 0 THEN 1 ELSE 0.5::DOUBLE END FROM e
    UNION ALL SELECT event_id, 'n', k % 7 <> 0, CAST(k % 7 <> 0 AS INT) FROM e
    UNION ALL SELECT event_id, 'gone', true, 1 FROM e
    UNION ALL SELECT event_id, 'note', false, 0 FROM e)
  SELECT field, count(*) AS n, count(*) FILTER (WHERE match) AS n_match, round(avg(similarity), 6) AS similarity,
    (SELECT round(avg((1 + CAST(k % 2 = 0 AS INT) + CAST(k % 3 = 0 AS INT) + CAST(k % 5 = 0 AS INT) + CAST(k % 7 <> 0 AS INT)) / 6.0::DOUBLE), 6) FROM e) AS overall FROM f GROUP BY field""",
)
def field_breakdown(spark, d):
    e = episodes(spark, d, heavy=True)
    k = F.col("k")
    gold = _json(name=_str(F.col("task")), tags=F.lit('["a", "b"]'), cfg=F.lit('{"x": 1, "y": [1]}'), n=k, gone=F.lit("null"), note=F.lit('"here"'))
    pred = _json(
        name=_str(F.when(k % 2 == 0, F.concat(F.lit("  "), F.upper("task"))).otherwise(F.concat("task", F.lit(" more")))),
        tags=F.when(k % 3 == 0, F.lit('["a", "b"]')).when(k % 3 == 1, F.lit('["b", "c"]')).otherwise(F.lit("[]")),
        cfg=F.when(k % 5 == 0, F.lit('{"y": [1], "x": 1}')).otherwise(F.lit('{"x": 1, "y": [2], "z": 0}')),
        n=F.when(k % 7 == 0, k + 1).otherwise(k),
    )
    b = score.field_breakdown(jsonops.parse_strict(pred), jsonops.parse_strict(gold), FIELDS)
    rows = e.select(b.alias("b")).select(score.breakdown_accuracy(F.col("b")).alias("overall"), F.explode_outer("b").alias("f"))
    out = rows.groupBy("f.field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("f.match").alias("n_match"), F.avg("f.similarity").alias("similarity"), F.avg("overall").alias("overall")
    )
    return rounded(out)


@query(
    "gold_scores",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  SELECT event_id, CAST(k % 2 = 0 AND k % 3 <> 0 AS INT)::DOUBLE AS em, CASE WHEN k % 3 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS f1, CASE WHEN k % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS cite_acc,
    CASE WHEN k % 3 = 0 THEN round(6.0::DOUBLE / 7, 6) ELSE 1 END AS faithfulness, CASE WHEN k % 3 = 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS faithfulness_sem,
    CAST(k % 7 <> 0 AS INT)::DOUBLE AS tool_match, 1.0::DOUBLE AS toolseq_match, CAST(k % 2 = 0 AS INT)::DOUBLE AS safety_match, 0 AS plain_matches FROM e""",
)
def gold_scores(spark, d):
    e = episodes(spark, d, heavy=True)
    k = F.col("k")
    third = k % 3 == 0
    gold = _json(bullets=F.lit('["one two three"]'), risk_score=k, steps=F.lit('["classify_intent"]'), tool=F.lit('"T"'), inputs=_json(a=k), decision=_str(F.col("task")))
    pred = _json(
        bullets=F.when(third, F.lit('["One two", "three four"]')).otherwise(F.lit('["one two three"]')),
        risk_score=F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat((k + 1).cast("string"))),
        steps=F.when(k % 11 == 0, F.lit("[]")).otherwise(F.lit('["Classify_Intent"]')),
        tool=F.lit('"t"'),
        inputs=_json(a=F.when(k % 7 == 0, k + 5).otherwise(k)),
        decision=_str(F.col("task")),
    )
    cites_gold = F.lit('{"citations": ["[1]", "[2]"]}')
    cites_pred = F.when(k % 5 == 0, F.lit('{"citations": ["1"]}')).otherwise(F.lit('{"citations": ["2", "1", "9"]}'))
    plain_gold = _json(risk_score=k, names=F.lit('["a", "b"]'))
    plain_pred = _json(risk_score=F.when(k % 2 == 0, k.cast("string")).otherwise((k + 1).cast("string")), names=F.when(third, F.lit('["a", "b", "c"]')).otherwise(F.lit('["b", "a"]')))
    P = jsonops.parse_strict
    main = score.gold_scores(P(pred), P(gold), F.concat(F.lit("Task: "), F.lit("classify_intent")))
    cite = score.gold_scores(P(cites_pred), P(cites_gold))
    plain = score.gold_scores(P(plain_pred), P(plain_gold))
    # Each struct is made once per row; its fields are read from it in a step of their own.
    made = e.select("event_id", main.alias("m"), cite.alias("cite"), plain.alias("plain"))
    # A record without tool, steps or decision has no match score.
    known = F.size(F.filter(F.array(*[F.col(x)[c] for x in ("plain", "cite") for c in ("tool_match", "toolseq_match", "safety_match")]), lambda v: v.isNotNull()))
    return rounded(
        made.select(
            "event_id", "plain.em", "plain.f1", "cite.cite_acc", "m.faithfulness", "m.faithfulness_sem", "m.tool_match", "m.toolseq_match", "m.safety_match",
            known.alias("plain_matches"),
        )
    )


@query(
    "error_taxonomy",
    f"WITH {EPISODES_SQL} SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'provider_error' WHEN latency_ms > 6000 THEN 'timeout' WHEN event_id % 8 = 7 THEN 'parse_error'" + """
    WHEN event_id % 8 IN (3, 4, 5, 6) OR k < 10 OR k > 95 THEN 'schema_violation' WHEN k % 3 = 0 THEN 'semantic_error' ELSE 'none' END AS category,
    CASE WHEN event_id % 101 <> 0 AND latency_ms <= 6000 AND event_id % 8 <= 2 AND k BETWEEN 10 AND 95 AND k % 3 = 0 THEN 0.9::DOUBLE ELSE 1 END AS confidence,
    CASE WHEN event_id % 101 <> 0 AND latency_ms <= 6000 AND event_id % 8 <= 2 AND k BETWEEN 10 AND 95 AND k % 3 = 0 THEN 'k' ELSE '' END AS mismatched FROM episodes""",
)
def error_taxonomy(spark, d):
    return _errors(spark, d).select("event_id", "e.category", "e.confidence", F.array_join("e.mismatched", ",").alias("mismatched"))


def _errors(spark, d):
    o = _outputs(spark, d).withColumn("pred", jsonops.parse_strict(F.col("raw")))
    o = o.withColumn("schema_error", F.when(F.col("pred").isNotNull(), contract.first_violation(F.col("pred"), RANGE_CONTRACT)))
    gold = jsonops.parse_strict(_json(k=F.when(F.col("k") % 3 == 0, F.col("k") + 1).otherwise(F.col("k"))))
    parse_error = F.when(F.col("pred").isNull(), F.lit("not valid JSON"))
    provider = F.when(F.col("event_id") % 101 == 0, F.lit("connection reset"))
    return o.withColumn("e", score.error_class(F.col("latency_ms"), F.lit(6000.0), parse_error, F.col("schema_error"), F.col("pred"), gold, provider))


@query(
    "error_distribution",
    f"WITH {EPISODES_SQL}, x AS (SELECT model, CASE WHEN event_id % 101 = 0 THEN 'provider_error' WHEN latency_ms > 6000 THEN 'timeout' WHEN event_id % 8 = 7 THEN 'parse_error'" + """
    WHEN event_id % 8 IN (3, 4, 5, 6) OR k < 10 OR k > 95 THEN 'schema_violation' WHEN k % 3 = 0 THEN 'semantic_error' ELSE 'none' END AS category FROM episodes)
  SELECT model, category, count(*) AS n FROM x GROUP BY 1, 2""",
)
def error_distribution(spark, d):
    return _errors(spark, d).groupBy("model", "e.category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "correctness_rules",
    f"WITH {SCORED_SQL}" + """, r AS (SELECT *, CASE tt WHEN 't1' THEN k % 2 = 1 OR true WHEN 't2' THEN k % 2 = 1 WHEN 't3' THEN k % 3 <> 0 WHEN 't4' THEN k % 4 <> 0 WHEN 't5' THEN k % 2 = 0 ELSE true END AS mark FROM scored)
  SELECT tt AS task_type, count(*) AS n, count(*) FILTER (WHERE mark) AS by_mark,
    count(*) FILTER (WHERE jv AND CASE tt WHEN 't4' THEN k % 4 <> 0 ELSE k % 5 <> 0 END) AS any_field,
    count(*) FILTER (WHERE jv AND CASE tt WHEN 't3' THEN false WHEN 't4' THEN k % 4 <> 0 WHEN 't6' THEN k % 2 = 1 AND k % 3 = 0 WHEN 't5' THEN false WHEN 't2' THEN false ELSE false END) AS live
  FROM r GROUP BY tt""",
)
def correctness_rules(spark, d):
    r = scored_records(spark, d)
    jv = F.col("json_valid")
    metrics = score.score_record(F.col("task_type"), F.col("pred"), F.col("gold"), jv)
    accuracy = (F.col("k") % 5) / 5.0
    live_task = F.when(F.col("task_type") == "t4", F.lit("T4")).otherwise(F.lit("other"))
    out = r.select(
        "task_type",
        score.correct_by_pass_mark(F.col("task_type"), metrics).alias("mark"),
        score.correct_any_field(jv, accuracy, F.col("task_type") == "t4", F.col("pred"), F.col("gold_text")).alias("any"),
        score.correct_live(live_task, jv, F.col("pred"), F.col("gold")).alias("live"),
    )
    return out.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("mark").alias("by_mark"), F.count_if("any").alias("any_field"), F.count_if("live").alias("live")
    )


@query(
    "first_present_correct",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CASE event_id % 4 WHEN 0 THEN k % 2 = 0 WHEN 1 THEN k % 3 = 0 WHEN 2 THEN k % 5 = 0 ELSE false END) AS correct FROM e GROUP BY 1""",
)
def first_present_correct(spark, d):
    e = episodes(spark, d)
    case, k = F.col("event_id") % 4, F.col("k")
    metrics = F.map_filter(
        F.create_map(
            F.lit("t3_success"), F.when(case == 0, (k % 2 == 0).cast("double")),
            F.lit("t5_success"), F.when(case <= 1, F.when(case == 1, (k % 3 == 0).cast("double")).otherwise(1.0)),
        ),
        lambda _, v: v.isNotNull(),
    )
    first = F.when(case == 2, k % 5 == 0)
    out = e.select(F.col("task").alias("event_type"), score.first_success(metrics, first).alias("c"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("correct"))


@query(
    "composite_reward",
    f"WITH {EPISODES_SQL}, r AS (SELECT event_id, CAST(schema_valid AS INT)::DOUBLE AS r_schema, CAST(task_correct AS INT)::DOUBLE AS r_success, -0.1::DOUBLE * latency_ms / 1000 AS r_latency,"
    " -0.05::DOUBLE * tokens_out / 1000 AS r_cost, -0.2::DOUBLE * (k % 10) / 10 AS r_stability, 0.5::DOUBLE * (faithfulness - 0.5::DOUBLE) AS r_faithfulness FROM episodes)"
    " SELECT event_id, round(r_schema + r_success + r_latency + r_cost + r_stability + r_faithfulness, 6) AS reward, round(r_latency, 6) AS r_latency, round(r_cost, 6) AS r_cost,"
    " round(r_stability, 6) AS r_stability, round(r_faithfulness, 6) AS r_faithfulness, r_schema, r_success FROM r",
)
def composite_reward(spark, d):
    e = episodes(spark, d)
    parts = score.reward_parts(
        F.col("schema_valid"), F.col("task_correct"), F.col("latency_ms"), F.col("tokens_out"), 0.1, 0.05,
        (F.col("k") % 10) / 10.0, 0.2, F.col("faithfulness"), 0.5,
    )
    return rounded(e.select("event_id", *[c.alias(n) for n, c in parts.items()]))


@query(
    "judge_rollup",
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
  s AS (SELECT *, (least(3, k % 5) + k // 10 % 4 + 3) / 9.0::DOUBLE AS m, CAST(k % 11 = 0 AS INT) / 3.0::DOUBLE AS c FROM e)
  SELECT event_id, round(CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE greatest(0, least(1, m - c)) END, 6) AS faithfulness, round(CASE event_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE c END, 6) AS contradiction_rate,
    round(CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE m END, 6) AS mean_support, event_id % 10 <> 0 AS parsed FROM s""",
)
def judge_rollup(spark, d):
    e = episodes(spark, d)
    k = F.col("k")
    st = lambda s, c: _json(support_score_0_to_3=s, contradiction=c)
    listed = F.concat(
        F.lit('{"statements": ['), st(k % 5, F.when(k % 11 == 0, F.lit("true")).otherwise(F.lit("false"))), F.lit(","),
        st(F.floor(k / 10) % 4, F.lit("false")), F.lit(","), st(F.lit(7), F.lit("false")), F.lit("]}"),
    )
    case = F.col("event_id") % 10
    raw = F.when(case == 0, F.lit('{"statements": [')).when(case == 1, F.lit('{"statements": []}')).otherwise(listed)
    return rounded(e.select("event_id", score.judge_rollup(raw).alias("j")).select("event_id", "j.*"))


@query(
    "attempt_rollup",
    """SELECT event_id, CAST(1 + event_id % 3 AS INT) AS attempts, round((1 + event_id % 3) * value * 10, 4) AS total_latency_ms, CAST((1 + event_id % 3) * k AS BIGINT) AS total_tokens,
    CAST(event_id % 3 AS INT) AS retries, CAST(CASE WHEN event_id % 3 >= 1 THEN 1 ELSE 0 END AS INT) AS repairs, round(value / 2, 6) AS validation_ms,
    CASE WHEN event_id % 2 = 0 THEN -(k + 1) / 2.0::DOUBLE END AS mean_logprob
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def attempt_rollup(spark, d):
    from sloframe.operators import attempts

    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = F.transform(
        F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")),
        lambda i: F.struct((F.col("value") * 10).alias("latency_ms"), k.alias("tokens_out"), (i == 1).alias("repaired"), i.alias("index")),
    )
    timings = F.create_map(F.lit("validation_start"), F.col("value"), F.lit("validation_end"), F.col("value") * 1.5)
    logprobs = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(-1.0), (-k).cast("double")))
    out = e.select("event_id", attempts.rollup(made).alias("r"), attempts.validation_ms(timings).alias("validation_ms"), attempts.mean_logprob(logprobs).alias("mean_logprob"))
    out = out.select("event_id", "r.*", "validation_ms", "mean_logprob")
    return rounded(out.withColumn("total_latency_ms", F.round("total_latency_ms", 4)))


@query(
    "flatten_episodes",
    f"WITH {EPISODES_SQL} SELECT event_id, model, sha256(prompt_id) AS prompt_hash, round(latency_ms, 4) AS latency_ms, CAST(json_valid AS INT)::DOUBLE AS json_valid, faithfulness, "
    "CASE WHEN k % 2 = 0 THEN success_at_slo END AS success_at_slo, repeat(output_json, CAST(k + 1 AS INT)) AS raw_output, left(repeat(output_json, CAST(k + 1 AS INT)), 200) AS raw_preview, k AS k FROM episodes",
)
def flatten_episodes(spark, d):
    from sloframe.operators import attempts

    e = episodes(spark, d)
    nested = e.select(
        "event_id",
        "model",
        F.sha2("prompt_id", 256).alias("prompt_hash"),
        F.round("latency_ms", 4).alias("latency_ms"),
        F.map_filter(
            F.create_map(
                F.lit("json_valid"), F.col("json_valid").cast("double"), F.lit("faithfulness"), F.col("faithfulness"),
                F.lit("success_at_slo"), F.when(F.col("k") % 2 == 0, F.col("success_at_slo")),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metrics"),
        F.repeat("output_json", (F.col("k") + 1).cast("int")).alias("raw_output"),
        jsonops.parse_strict(F.col("output_json")).alias("parsed_output"),
    )
    return attempts.flatten_episode(
        nested, ["event_id", "model", "prompt_hash", "latency_ms"], ["json_valid", "faithfulness", "success_at_slo"], {"k": ("$.k", "bigint")}, 200
    )
