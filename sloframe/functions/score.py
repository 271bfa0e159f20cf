"""Scores of one output against its gold record, as Columns over VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sloframe.functions.binding import let, let_all
from sloframe.functions.jsonops import as_array, as_map, field, is_array, is_number, is_object, kind, parse_strict, text_of
from sloframe.functions.text import last_number, lower_trim, set_f1, set_jaccard, squeeze, token_set, tokens

# Fields and pass marks per task type.
INCIDENT_FIELDS = ("category", "severity", "source", "time_window")
INTENT_FIELDS = ("intent", "domain", "is_oos")
PASS_MARKS = {"t1": ("t1_field_acc", 0.75), "t2": ("t2_summary_f1", 0.3), "t3": ("t3_success", 1.0),
              "t4": ("t4_func_match", 1.0), "t5": ("t5_has_patch", 1.0)}
SUCCESS_KEYS = ("t3_success", "t4_success", "t5_success", "t2_success")
SUPPORT_MAX = 3
TOOL_SEQUENCES = {
    "summarize_report": ["search_contracts", "summarize_report"],
    "classify_intent": ["classify_intent"],
    "file_ticket": ["run_sql_query", "file_ticket"],
}
TASK_MARK = r"Task:\s*([\w_-]+)"


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def _norm(value: Column, missing: str = "") -> Column:
    """Squeezed text of a VARIANT scalar; a missing one counts as ``missing``."""
    return squeeze(F.coalesce(text_of(value), F.lit(missing)))


def _texts(value: Column) -> Column:
    """Squeezed texts of an array's items."""
    return F.transform(as_array(value), lambda x: squeeze(F.coalesce(text_of(x), F.lit("none"))))


def field_accuracy(pred: Column, gold: Column, fields: Sequence[str]) -> Column:
    hits = sum((_flag(_norm(field(pred, f)) == _norm(field(gold, f))) for f in fields), F.lit(0.0))
    return hits / len(fields)


def incident_scores(pred: Column, gold: Column, fields: Sequence[str] = INCIDENT_FIELDS) -> dict[str, Column]:
    acc = field_accuracy(pred, gold, fields)
    tags = set_f1(F.array_distinct(_texts(field(pred, "tags"))), F.array_distinct(_texts(field(gold, "tags"))))
    return {"t1_field_acc": acc, "t1_tag_f1": tags, "t1_exact_match": F.when(acc == 1.0, _flag(tags == 1.0)).otherwise(F.lit(0.0))}


def summary_scores(pred: Column, gold: Column) -> dict[str, Column]:
    words = lambda v: F.array_distinct(tokens(F.array_join(_texts(v), " ")))
    return {
        "t2_summary_f1": set_f1(token_set(text_of(field(pred, "short_summary"))), token_set(text_of(field(gold, "short_summary")))),
        "t2_key_point_f1": set_f1(words(field(pred, "key_points")), words(field(gold, "key_points"))),
        "t2_primary_risk_match": _flag(_norm(field(pred, "primary_risk")) == _norm(field(gold, "primary_risk"))),
        "t2_action_match": _flag(_norm(field(pred, "recommended_action")) == _norm(field(gold, "recommended_action"))),
    }


def answer_scores(pred: Column, gold: Column) -> dict[str, Column]:
    """Question answering: squeezed exact match and token-set F1 of ``answer``."""
    p, g = (F.coalesce(text_of(field(v, "answer")), F.lit("")) for v in (pred, gold))
    return {"t2_answer_match": _flag(squeeze(p) == squeeze(g)), "t2_answer_f1": set_f1(token_set(p), token_set(g))}


def args_match(pred_args: Column, gold_args: Column) -> Column:
    """Every gold argument has the same text in the prediction; extra predicted
    arguments do not matter."""
    return let(
        as_map(pred_args),
        lambda have: F.forall(
            F.map_entries(as_map(gold_args)),
            lambda e: _norm(F.try_element_at(have, e["key"]), "none") == _norm(e["value"], "none"),
        ),
    )


def tool_scores(pred: Column, gold: Column) -> dict[str, Column]:
    tool = _flag(_norm(field(pred, "tool"), "none") == _norm(field(gold, "tool"), "none"))
    args = tool * _flag(args_match(field(pred, "arguments"), field(gold, "arguments")))
    return {"t3_tool_match": tool, "t3_args_match": args, "t3_success": args}


def function_scores(pred: Column, gold: Column) -> dict[str, Column]:
    """Gold is ``{function: {argument: [allowed values]}}``."""
    name = F.coalesce(text_of(field(pred, "name")), F.lit(""))
    known = F.map_contains_key(as_map(gold), name)
    wanted = F.map_entries(as_map(F.try_element_at(as_map(gold), name)))

    def allowed(have: Column, e: Column) -> Column:
        got = _norm(F.try_element_at(have, e["key"]), "none")
        inside = let(got, lambda g: F.exists(as_array(e["value"]), lambda v: _norm(v, "none") == g))
        return F.when(is_array(e["value"]), inside).otherwise(_norm(e["value"], "none") == got)

    share = let_all(
        {"w": wanted, "have": as_map(field(pred, "arguments"))},
        lambda s: F.when(F.size(s["w"]) > 0, F.size(F.filter(s["w"], lambda e: allowed(s["have"], e))) / F.size(s["w"])).otherwise(F.lit(1.0)),
    )
    acc = F.when(known, share).otherwise(F.lit(0.0))
    return {"t4_func_match": _flag(known), "t4_args_acc": acc, "t4_success": _flag(acc >= 0.99)}


def patch_scores(pred: Column, gold: Column) -> dict[str, Column]:
    patch = F.coalesce(text_of(field(pred, "patch")), F.lit(""))
    target = F.coalesce(text_of(field(gold, "patch")), F.lit(""))
    diff = F.contains(F.lower(patch), F.lit("diff")) | F.contains(patch, F.lit("@@")) | patch.startswith("---")
    return {
        "t5_has_patch": _flag(F.length(F.trim(patch)) > 10),
        "t5_valid_diff": _flag(diff),
        "t5_patch_f1": F.when(target != "", set_f1(token_set(patch), token_set(target))).otherwise(F.lit(0.0)),
    }


def number_scores(pred: Column, gold: Column, tolerance: float = 1e-6) -> dict[str, Column]:
    p, g = (F.coalesce(text_of(field(v, "answer")), F.lit("")) for v in (pred, gold))
    exact = _flag(squeeze(p) == squeeze(g))
    near = _flag(F.abs(last_number(p) - last_number(g)) < tolerance)
    return {"t6_exact_match": exact, "t6_numeric_match": near, "t6_success": F.greatest(exact, near)}


TASK_SCORES = {"t1": incident_scores, "t2": summary_scores, "t3": tool_scores,
               "t4": function_scores, "t5": patch_scores, "t6": number_scores}


def score_record(task_type: Column, pred: Column, gold: Column, json_valid: Column) -> Column:
    """MAP<STRING,DOUBLE> with the metrics of the record's task type. A record
    without gold has only ``json_valid``."""
    empty = F.expr("cast(map() as map<string,double>)")
    scored = None
    for name, scorer in TASK_SCORES.items():
        metrics = F.create_map(*[x for metric, value in scorer(pred, gold).items() for x in (F.lit(metric), value)])
        scored = F.when(task_type == name, metrics) if scored is None else scored.when(task_type == name, metrics)
    own = F.when(F.size(as_map(gold)) > 0, scored.otherwise(empty)).otherwise(empty)
    return F.map_concat(F.create_map(F.lit("json_valid"), _flag(json_valid)), own)


def _present(value: Column) -> Column:
    """NULL for JSON null as well as for a missing field."""
    return F.when(kind(value) != "VOID", value)


def compare_values(gold: Column, pred: Column) -> Column:
    """Struct(match, similarity): equal values (also two missing ones) match;
    strings match after squeezing, else by token-set F1; arrays by Jaccard;
    objects by the share of gold keys with equal values."""
    raw = {"g": _present(gold), "p": _present(pred)}

    def facts(s: Column) -> Column:
        return let_all(
            {"g": s["g"], "p": s["p"], "kg": kind(s["g"]), "kp": kind(s["p"]), "gj": F.to_json(s["g"]), "pj": F.to_json(s["p"])}, verdict
        )

    def verdict(s: Column) -> Column:
        none, full = _verdict(False, F.lit(0.0)), _verdict(True, F.lit(1.0))
        both = lambda name: s["kg"].startswith(name) & s["kp"].startswith(name)
        return (
            F.when(s["g"].isNull() & s["p"].isNull(), full)
            .when(s["g"].isNull() | s["p"].isNull(), none)
            .when(s["gj"] == s["pj"], full)
            .when((s["kg"] == "STRING") & (s["kp"] == "STRING"), _compare_texts(s["g"], s["p"]))
            .when(both("ARRAY"), _compare_lists(s["g"], s["p"]))
            .when(both("OBJECT"), _compare_objects(s["g"], s["p"]))
            .otherwise(none)
        )

    return let_all(raw, facts)


def _verdict(match: bool, similarity: Column) -> Column:
    return F.struct(F.lit(match).alias("match"), similarity.alias("similarity"))


def _compare_texts(g: Column, p: Column) -> Column:
    words = lambda t: F.array_distinct(tokens(t))
    return let_all(
        {"g": squeeze(text_of(g)), "p": squeeze(text_of(p))},
        lambda s: F.when(s["g"] == s["p"], _verdict(True, F.lit(1.0))).otherwise(_verdict(False, set_f1(words(s["p"]), words(s["g"]), 0.0))),
    )


def _compare_lists(g: Column, p: Column) -> Column:
    items = lambda v: F.array_distinct(F.transform(as_array(v), lambda x: F.coalesce(text_of(x), F.lit("None"))))
    return let_all(
        {"g": items(g), "p": items(p)},
        lambda s: _verdict(False, F.when((F.size(s["g"]) > 0) & (F.size(s["p"]) > 0), set_jaccard(s["g"], s["p"])).otherwise(F.lit(0.0))),
    )


def _compare_objects(g: Column, p: Column) -> Column:
    same = lambda s, k: F.coalesce(F.to_json(F.try_element_at(s["g"], k)) == F.to_json(F.try_element_at(s["p"], k)), F.lit(False))
    return let_all(
        {"g": as_map(g), "p": as_map(p)},
        lambda s: _verdict(
            False,
            F.when(F.size(s["g"]) > 0, F.size(F.filter(F.map_keys(s["g"]), lambda k: same(s, k))) / F.size(s["g"])).otherwise(F.lit(0.0)),
        ),
    )


def field_breakdown(pred: Column, gold: Column, fields: Sequence[str]) -> Column:
    """Array of struct(field, match, similarity) over the contract's fields."""
    names = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
    verdict = lambda name, c: F.struct(name.alias("field"), c["match"].alias("match"), c["similarity"].alias("similarity"))
    at = F.try_element_at

    def each(s: Column) -> Column:
        # One comparison expression runs over the field names.
        return F.transform(names, lambda name: let(compare_values(at(s["g"], name), at(s["p"], name)), lambda c: verdict(name, c)))

    return let_all({"g": as_map(gold), "p": as_map(pred)}, each)


def breakdown_accuracy(breakdown: Column) -> Column:
    n = F.size(breakdown)
    return F.when(n > 0, F.size(F.filter(breakdown, lambda f: f["match"])) / n).otherwise(F.lit(0.0))


def breakdown_exact(breakdown: Column) -> Column:
    return (F.size(breakdown) > 0) & F.forall(breakdown, lambda f: f["match"])


def mismatched_fields(pred: Column, gold: Column) -> Column:
    shown = lambda m, k: F.nullif(F.to_json(F.try_element_at(m, k)), F.lit("null"))
    return let_all(
        {"g": as_map(gold), "p": as_map(pred)},
        lambda s: F.filter(F.map_keys(s["g"]), lambda k: ~shown(s["g"], k).eqNullSafe(shown(s["p"], k))),
    )


def error_class(
    latency: Column, budget: Column | float, parse_error: Column, schema_error: Column,
    pred: Column, gold: Column, provider_error: Column | None = None,
) -> Column:
    """Struct(category, confidence, mismatched). First of: provider, timeout,
    parse, schema, semantic; a semantic check needs a non-empty output and gold."""
    wrong = F.when(F.size(as_map(pred)) > 0, mismatched_fields(pred, gold))
    none = F.array().cast("array<string>")

    def out(name: str, confidence: float = 1.0, fields: Column = none) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(confidence).alias("confidence"), fields.alias("mismatched"))

    said = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    semantic = let(wrong, lambda w: F.when(F.size(w) > 0, out("semantic_error", 0.9, w)).otherwise(out("none")))
    first = [(said(provider_error), out("provider_error"))] if provider_error is not None else []
    chain = None
    for cond, result in [*first, (latency > budget, out("timeout")), (said(parse_error), out("parse_error")), (said(schema_error), out("schema_violation"))]:
        chain = F.when(cond, result) if chain is None else chain.when(cond, result)
    return chain.otherwise(semantic)


def gold_function_name(gold_text: Column) -> Column:
    """First key of the gold text (VARIANT sorts keys, so the raw text is read)."""
    return F.try_element_at(F.json_object_keys(gold_text), F.lit(1))


def correct_any_field(json_valid: Column, accuracy: Column, is_routing: Column, pred: Column, gold_text: Column) -> Column:
    """Valid and any field right; routing tasks compare the function name."""
    name = F.coalesce(text_of(field(pred, "name")), text_of(field(pred, "function_name")))
    right = F.when(is_routing, name == gold_function_name(gold_text)).otherwise(accuracy > 0)
    return F.coalesce(json_valid & right, F.lit(False))


def correct_by_pass_mark(task_type: Column, metrics: Column, marks: dict[str, tuple[str, float]] | None = None) -> Column:
    """The task type's key metric reaches its mark; other types pass."""
    out = None
    for name, (metric, mark) in (marks or PASS_MARKS).items():
        ok = F.coalesce(F.try_element_at(metrics, F.lit(metric)), F.lit(0.0)) >= mark
        out = F.when(task_type == name, ok) if out is None else out.when(task_type == name, ok)
    return out.otherwise(F.lit(True))


def correct_live(task: Column, json_valid: Column, pred: Column, gold: Column) -> Column:
    """Rules by task; without a comparable gold value the answer is wrong."""
    g = as_map(gold)
    t = lambda v, f: text_of(field(v, f))
    gold_name = F.coalesce(t(gold, "function_name"), t(gold, "name"), F.when(F.size(g) == 1, F.try_element_at(F.map_keys(g), F.lit(1))))
    pred_name = F.coalesce(t(pred, "function_name"), t(pred, "name"), t(pred, "tool"))
    scalar = F.filter(F.map_entries(g), lambda e: ~(is_object(e["value"]) | is_array(e["value"]) | (kind(e["value"]) == "VOID")))
    p = as_map(pred)
    all_equal = (F.size(scalar) > 0) & F.forall(
        scalar, lambda e: text_of(e["value"]) == F.coalesce(text_of(F.try_element_at(p, e["key"])), F.lit(""))
    )
    right = (
        F.when(task == "T1", t(pred, "intent") == t(gold, "intent"))
        .when(task.isin("T3", "T4"), pred_name == gold_name)
        .when((task == "T2") & t(gold, "answer").isNotNull(), F.trim(t(pred, "answer")) == F.trim(t(gold, "answer")))
        .otherwise(all_equal)
    )
    return F.coalesce(json_valid & is_object(pred) & (F.size(g) > 0) & right, F.lit(False))


def first_success(metrics: Column, first_match: Column, keys: Sequence[str] = SUCCESS_KEYS) -> Column:
    """Correctness from the first success metric present, else the first field."""
    known = F.coalesce(*[F.try_element_at(metrics, F.lit(k)) for k in keys])
    return F.coalesce(known > 0, first_match, F.lit(False))


def number_close(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    gap = F.abs(a - b)
    return (gap <= tolerance) | ((F.abs(a) > 0) & (gap / F.abs(a) < tolerance))


def _items(value: Column) -> Column:
    return F.array_distinct(F.transform(as_array(value), lambda x: F.coalesce(text_of(x), F.lit("None"))))


def _entry_matches(mine: Column, e: Column) -> Column:
    """One gold entry against the predicted value: numbers within tolerance, lists
    as sets, anything else as trimmed lower-case text."""
    plain = lambda v, missing: lower_trim(F.coalesce(text_of(v), F.lit(missing)))
    number = lambda v: F.try_variant_get(v, "$", "double")
    same_set = let_all(
        {"g": _items(e["value"]), "p": _items(mine)},
        lambda s: (F.size(F.array_except(s["g"], s["p"])) == 0) & (F.size(F.array_except(s["p"], s["g"])) == 0),
    )
    return (
        F.when(is_number(e["value"]) & is_number(mine), number_close(number(e["value"]), number(mine)))
        .when(is_array(e["value"]) & is_array(mine), same_set)
        .otherwise(plain(e["value"], "none") == plain(mine, ""))
    )


def _match_and_f1(pred: Column, gold: Column) -> Column:
    """Struct(em, f1): f1 is the best list F1, else the share of matching entries."""

    def rows(s: Column) -> Column:
        def one(e: Column) -> Column:
            return let(
                F.try_element_at(s["p"], e["key"]),
                lambda mine: F.struct(
                    F.coalesce(_entry_matches(mine, e), F.lit(False)).alias("hit"),
                    F.when(is_array(e["value"]) & is_array(mine), set_f1(_items(mine), _items(e["value"]))).alias("f1"),
                ),
            )

        return F.transform(F.map_entries(s["g"]), one)

    def verdict(r: Column) -> Column:
        n, hits = F.size(r), F.size(F.filter(r, lambda x: x["hit"]))
        best = F.coalesce(F.array_max(F.transform(r, lambda x: x["f1"])), F.lit(0.0))
        f1 = F.when(best > 0, best).when(n > 0, hits / n).otherwise(F.lit(0.0))
        return F.struct(_flag((n > 0) & (hits == n)).alias("em"), f1.alias("f1"))

    return let(let_all({"g": as_map(gold), "p": as_map(pred)}, rows), verdict)


def gold_scores(pred: Column, gold: Column, prompt: Column | None = None) -> Column:
    """Struct of generic scores: em, f1, cite_acc, faithfulness (token F1 of
    bullets), faithfulness_sem (token Jaccard), tool_match, toolseq_match, safety_match.
    The last three are NULL when gold has no tool, steps or decision to match."""
    bare = lambda x: F.regexp_replace(lower_trim(text_of(x)), r"^[\[\]]+|[\[\]]+$", "")
    cites = lambda v: F.array_distinct(F.transform(as_array(field(v, "citations")), bare))
    line = lambda x: F.coalesce(text_of(x), F.lit("none"))
    words = lambda v: F.array_distinct(tokens(squeeze(F.array_join(F.transform(as_array(field(v, "bullets")), line), " "))))
    low = lambda v: F.lower(F.coalesce(text_of(v), F.lit("none")))
    steps = lambda v: F.transform(as_array(field(v, "steps")), low)

    def all_scores(s: Column) -> Column:
        g, p = s["g"], s["p"]
        cite = let_all(
            {"g": cites(g), "p": cites(p)},
            lambda c: F.when(F.size(c["g"]) > 0, F.size(F.array_intersect(c["g"], c["p"])) / F.size(c["g"])).otherwise(F.lit(0.0)),
        )
        bullets = is_array(field(g, "bullets")) & is_array(field(p, "bullets"))
        faith = let_all(
            {"g": words(g), "p": words(p)},
            lambda w: F.struct(set_f1(w["p"], w["g"]).alias("f1"), set_jaccard(w["g"], w["p"], 0.0).alias("sem")),
        )
        inputs_ok = let(
            as_map(field(p, "inputs")),
            lambda have: F.forall(
                F.map_entries(as_map(field(g, "inputs"))),
                lambda e: F.lower(F.coalesce(text_of(F.try_element_at(have, e["key"])), F.lit(""))) == low(e["value"]),
            ),
        )
        mine = steps(p)
        if prompt is not None:
            canon = F.create_map(*[x for k, v in TOOL_SEQUENCES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
            named = F.try_element_at(canon, F.regexp_extract(prompt, TASK_MARK, 1))
            mine = let(mine, lambda m: F.when(F.size(m) == 0, F.coalesce(named, m)).otherwise(m))
        has = lambda f: field(g, f).isNotNull()
        same = lambda f: text_of(field(p, f)).eqNullSafe(text_of(field(g, f)))
        return let_all(
            {"m": _match_and_f1(p, g), "f": F.when(bullets, faith)},
            lambda t: F.struct(
                t["m"]["em"].alias("em"),
                t["m"]["f1"].alias("f1"),
                F.when(is_array(field(p, "citations")), cite).otherwise(F.lit(0.0)).alias("cite_acc"),
                F.coalesce(t["f"]["f1"], F.lit(0.0)).alias("faithfulness"),
                F.coalesce(t["f"]["sem"], F.lit(0.0)).alias("faithfulness_sem"),
                F.when(has("tool"), _flag((low(field(g, "tool")) == low(field(p, "tool"))) & inputs_ok)).alias("tool_match"),
                F.when(is_array(field(g, "steps")), _flag(steps(g) == mine)).alias("toolseq_match"),
                F.when(has("decision"), _flag(same("decision") & same("risk_score"))).alias("safety_match"),
            ),
        )

    return let_all({"g": gold, "p": pred}, all_scores)


def judge_rollup(response: Column) -> Column:
    """Struct(faithfulness, contradiction_rate, mean_support, parsed) of a stored
    judge response with ``statements``; unparsed text scores 0 / 1, no statements 1 / 0."""
    zero, one = F.lit(0.0), F.lit(1.0)
    result = lambda f, c, m, ok: F.struct(
        f.alias("faithfulness"), c.alias("contradiction_rate"), m.alias("mean_support"), F.lit(ok).alias("parsed")
    )
    given = lambda s: F.coalesce(F.try_variant_get(field(s, "support_score_0_to_3"), "$", "int"), F.lit(0))
    clamped = lambda s: F.greatest(F.lit(0), F.least(F.lit(SUPPORT_MAX), given(s)))
    against = lambda s: F.coalesce(F.try_variant_get(field(s, "contradiction"), "$", "boolean"), F.lit(False))

    def shares(st: Column) -> Column:
        n = F.size(st)
        support = F.aggregate(st, F.lit(0), lambda acc, s: acc + clamped(s)) / (float(SUPPORT_MAX) * n)
        return let_all(
            {"m": support, "c": F.size(F.filter(st, against)) / n},
            lambda x: result(F.greatest(zero, F.least(one, x["m"] - x["c"])), x["c"], x["m"], True),
        )

    def doc_scores(doc: Column) -> Column:
        listed = let(as_array(field(doc, "statements")), lambda st: F.when(F.size(st) == 0, result(one, zero, one, True)).otherwise(shares(st)))
        return F.when(doc.isNull(), result(zero, one, zero, False)).otherwise(listed)

    return let(parse_strict(response), doc_scores)


def blended_faithfulness(judged: Column, overlap: Column) -> Column:
    """The better of a judge's score and the token overlap; a missing one is ignored."""
    return F.greatest(judged, overlap)


def reward_parts(
    schema_ok: Column, success: Column, latency_ms: Column, tokens_out: Column,
    lam_latency: float, mu_cost: float, disagreement: Column | None = None, gamma: float = 0.0,
    faithfulness: Column | None = None, kappa: float = 0.0,
) -> dict[str, Column]:
    """Reward components and their sum ``reward``."""
    parts = {
        "r_schema": schema_ok.cast("double"),
        "r_success": success.cast("double"),
        "r_latency": -lam_latency * (latency_ms / 1000.0),
        "r_cost": -mu_cost * (tokens_out / 1000.0),
        "r_stability": -gamma * (disagreement if disagreement is not None else F.lit(0.0)),
        "r_faithfulness": kappa * ((faithfulness if faithfulness is not None else F.lit(1.0)) - 0.5),
    }
    return {**parts, "reward": sum(parts.values(), F.lit(0.0))}
