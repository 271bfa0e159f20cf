"""Queries: text and JSON projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sloframe.functions import jsonops, text
from sloframe.operators.bags import qa_scores
from sloframe.operators.joins import lookup
from sloframe.operators.ordered import attach
from sloframe.plans.registry import query, rounded
from sloframe.plans.views import EPISODES_SQL, MODEL_DIM_SQL, dealt, episodes, model_dim, table, wide

SPACE_SQL = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"
_ART = r"(^|[^\p{L}\p{N}_])(?:a|an|the)([^\p{L}\p{N}_]|$)"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{SPACE_SQL}', ' ', 'g'))"


def qa_sql(x: str) -> str:
    once = f"regexp_replace(lower({x}), '{_ART}', '\\1 \\2', 'g')"
    twice = f"regexp_replace({once}, '{_ART}', '\\1 \\2', 'g')"
    bare = f"regexp_replace({twice}, '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"trim(regexp_replace({bare}, '{SPACE_SQL}', ' ', 'g'))"


def words_sql(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda t: t <> '')"


PAIRS_SQL = (
    "pairs AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN translate(b.text, 'abcdefghij', 'ABCDEFGHIJ') || ' .' ELSE d.text END AS pred, b.text AS gold "
    "FROM documents d, (SELECT max(item_id) + 1 AS m FROM benchmark), benchmark b WHERE d.doc_id % m = b.item_id)"
)


def pairs(spark, d):
    """Every document with an item; every fourth answer is the item's text, partly in capitals."""
    count = table(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("m"))
    docs = attach(dealt(wide(spark, d, "documents", "doc_id", "text"), "doc_id"), count, []).select("doc_id", "text", (F.col("doc_id") % F.col("m")).alias("item_id"))
    gold = table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"))
    pred = F.when(F.col("doc_id") % 4 == 0, F.concat(F.translate("gold", "abcdefghij", "ABCDEFGHIJ"), F.lit(" ."))).otherwise(F.col("text"))
    return docs.join(gold, "item_id").select("doc_id", pred.alias("pred"), "gold")


@query("prompt_hash", "SELECT conv_id, turn, sha256(text) AS prompt_hash FROM conversations")
def prompt_hash(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("prompt_hash"))


@query(
    "canonical_json",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":{"x":[1,2],"y":"' || event_type || '"},"k":' || k || '}' WHEN 1 THEN '{"k":' || k || '}' ELSE '' END AS canon
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def canonical_json(spark, d):
    e = episodes(spark, d)
    nested = F.concat(F.lit('{ "k" : '), "k", F.lit(', "a": {"y": "'), "task", F.lit('", "x": [1,  2]}}'))
    raw = (
        F.when(F.col("event_id") % 4 == 0, nested)
        .when(F.col("event_id") % 4 == 1, F.col("output_json"))
        .when(F.col("event_id") % 4 == 2, F.lit("{}"))
        .otherwise(F.concat("output_json", F.lit(" trailing")))
    )
    return e.select("event_id", jsonops.canonical(raw).alias("canon"))


@query("qa_normalize", f"SELECT doc_id, md5({qa_sql('text')}) AS normalized, md5({squeeze_sql('text')}) AS squeezed FROM documents")
def qa_normalize(spark, d):
    t = wide(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.md5(text.qa_normalize(F.col("text"))).alias("normalized"), F.md5(text.squeeze(F.col("text"))).alias("squeezed"))


@query(
    "qa_exact_f1",
    f"WITH {PAIRS_SQL}, n AS (SELECT doc_id, {qa_sql('pred')} AS p, {qa_sql('gold')} AS g FROM pairs)," + f"""
  w AS (SELECT doc_id, unnest({words_sql('p')}) AS w, 1 AS np, 0 AS ng FROM n UNION ALL SELECT doc_id, unnest({words_sql('g')}), 0, 1 FROM n),
  c AS (SELECT doc_id, w, sum(np) AS np, sum(ng) AS ng FROM w GROUP BY doc_id, w),
  s AS (SELECT doc_id, sum(least(np, ng)) AS s, sum(np) AS np, sum(ng) AS ng FROM c GROUP BY doc_id)
  SELECT n.doc_id, CAST(p = g AS INT) AS exact_match, round(CASE WHEN s.doc_id IS NULL THEN 1 WHEN s = 0 THEN 0 ELSE 2.0::DOUBLE * (s / np) * (s / ng) / (s / np + s / ng) END, 6) AS f1
  FROM n LEFT JOIN s USING (doc_id)""",
)
def qa_exact_f1(spark, d):
    return rounded(qa_scores(pairs(spark, d), ["doc_id"], F.col("pred"), F.col("gold")))


def _f1_sql(p: str, g: str) -> str:
    i = f"len(list_intersect({p}, {g}))"
    return (
        f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1 WHEN len({g}) = 0 OR {i} = 0 THEN 0 ELSE "
        f"2.0::DOUBLE * {i} / (len({p}) + len({g})) END"
    )


@query(
    "set_f1",
    f"WITH {PAIRS_SQL}, t AS (SELECT doc_id, list_distinct({words_sql(squeeze_sql('pred'))}) AS p, list_distinct({words_sql(squeeze_sql('gold'))}) AS g FROM pairs) "
    f"SELECT doc_id, round({_f1_sql('p', 'g')}, 6) AS token_f1, "
    "round(len(list_intersect(p, g))::DOUBLE / len(list_distinct(list_concat(p, g))), 6) AS jaccard, CAST(len(list_distinct(list_concat(p, g))) AS INT) AS union_size FROM t",
)
def set_f1(spark, d):
    t = pairs(spark, d).select("doc_id", text.token_set(F.col("pred")).alias("p"), text.token_set(F.col("gold")).alias("g"))
    return rounded(
        t.select(
            "doc_id",
            text.set_f1(F.col("p"), F.col("g")).alias("token_f1"),
            text.set_jaccard(F.col("p"), F.col("g")).alias("jaccard"),
            F.size(F.array_union("p", "g")).alias("union_size"),
        )
    )


@query(
    "extract_json",
    """SELECT event_id, CASE event_id % 6 WHEN 4 THEN '{}' WHEN 5 THEN '{"a": {"b": ' || json_extract_string(props, '$.k') || '}}' ELSE props END AS found FROM events""",
)
def extract_json(spark, d):
    e = dealt(wide(spark, d, "events"), "event_id")
    p = F.col("props")
    nested = F.concat(F.lit('{"a": {"b": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    case = F.col("event_id") % 6
    raw = (
        F.when(case == 0, p)
        .when(case == 1, F.concat(F.lit("Sure, here it is:\n```json\n"), p, F.lit("\n```\nDone {x}.")))
        .when(case == 2, F.concat(F.lit("I think {maybe} the answer is "), p, F.lit(" as asked")))
        .when(case == 3, F.concat(p, F.lit(" trailing text")))
        .when(case == 4, F.lit("no object {here at all"))
        .otherwise(F.concat(F.lit("nested: "), nested, F.lit(" end")))
    )
    return e.select("event_id", jsonops.extract_object(raw).alias("found"))


@query(
    "answer_numbers",
    """SELECT event_id, CAST(CASE event_id % 3 WHEN 2 THEN NULL ELSE value END AS DOUBLE) AS last_number, CASE WHEN event_id % 3 = 0 THEN 'v' || k END AS marked,
    CASE WHEN event_id % 3 = 1 THEN CAST(k AS VARCHAR) END AS boxed FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
)
def answer_numbers(spark, d):
    e = table(spark, d, "events")
    k, v = F.get_json_object("props", "$.k"), F.col("value").cast("string")
    case = F.col("event_id") % 3
    raw = (
        F.when(case == 0, F.concat(F.lit("Step 1: 1,200 items. Total "), v, F.lit(" #### v"), k))
        .when(case == 1, F.concat(F.lit("so \\boxed{"), k, F.lit("} and finally $"), v))
        .otherwise(F.lit("no digits here"))
    )
    num = F.when(case == 0, text.last_number(F.substring_index(raw, "####", 1))).otherwise(text.last_number(raw))
    return e.select("event_id", num.alias("last_number"), text.marked_answer(raw).alias("marked"), text.boxed_answer(raw).alias("boxed"))


@query(
    "question_context",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE trim(role || ' asks?') END AS question,
    CASE WHEN turn % 3 = 2 THEN text ELSE trim(text) END AS context FROM conversations""",
)
def question_context(spark, d):
    c = table(spark, d, "conversations")
    full = F.concat(F.lit("Read this.\nContext: "), "text", F.lit("  Question: "), "role", F.lit(" asks?"))
    bare = F.concat("text", F.lit(" Question:"), "role", F.lit(" asks? "))
    prompt = F.when(F.col("turn") % 3 == 0, full).when(F.col("turn") % 3 == 1, bare).otherwise(F.col("text"))
    q = text.question_and_context(prompt)
    return c.select("conv_id", "turn", q["question"].alias("question"), q["context"].alias("context"))


BLOCKED = ["password", " Email", "@", "les pour ", "credit", "", "  "]


@query(
    "blocklist",
    "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{t.strip().lower()}')" for t in BLOCKED if t.strip()) + " AS blocked, "
    "CASE WHEN " + " OR ".join(f"contains(lower(text), '{t.strip().lower()}')" for t in BLOCKED if t.strip()) + " THEN 0.0 ELSE length(text)::DOUBLE END AS reward FROM conversations",
)
def blocklist(spark, d):
    c = table(spark, d, "conversations")
    hit = text.blocklist_hit([F.col("role"), F.col("text")], BLOCKED)
    return c.select("conv_id", "turn", hit.alias("blocked"), F.when(hit, 0.0).otherwise(F.length("text").cast("double")).alias("reward"))


@query(
    "prompt_guard",
    "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) > 2000) AS too_long, CAST(sum(least(length(text), 2000)) AS BIGINT) AS kept_chars FROM documents GROUP BY source",
)
def prompt_guard(spark, d):
    g = text.guard_length(F.col("text"), 2000)
    t = table(spark, d, "documents").select("source", g.alias("g"))
    return t.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("g.too_long").alias("too_long"), F.sum(F.length("g.prompt")).alias("kept_chars")
    )


@query(
    "first_user_message",
    "SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id",
)
def first_user_message(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))


_SENT = "list_filter(list_transform(string_split(text, '. '), lambda s: trim(s)), lambda s: s <> '')"


@query(
    "indexed_context",
    f"""SELECT doc_id, md5(array_to_string(list_transform({_SENT}, lambda s, i: '[' || (i - 1) || '] ' || s), chr(10))) AS context,
    array_to_string(list_sort(list_distinct([doc_id % 7, doc_id % 3, doc_id % 7])), ',') AS evidence, 'T' || (doc_id % 7) || ':' || (doc_id % 7) || '; T' || (doc_id % 3) || ':' || (doc_id % 3) AS reasoning FROM documents""",
)
def indexed_context(spark, d):
    t = table(spark, d, "documents")
    ids = F.array(F.col("doc_id") % 7, F.col("doc_id") % 3)
    titles = F.transform(ids, lambda i: F.concat(F.lit("T"), i))
    facts = F.transform(F.arrays_zip(titles.alias("t"), ids.alias("i")), lambda z: F.concat(z["t"], F.lit(":"), z["i"]))
    return t.select(
        "doc_id",
        F.md5(text.numbered_lines(text.sentences(F.col("text")))).alias("context"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(ids, ids))), ",").alias("evidence"),
        F.array_join(facts, "; ").alias("reasoning"),
    )


RULES = [(("les", "der"), "continental"), (("the",), "english"), (("el", "la"), "iberian")]


@query(
    "lead_points",
    f"""SELECT doc_id, md5(array_to_string(list_transform(list_slice({_SENT}, 1, 3), lambda s: CASE WHEN length(s) > 60 THEN substr(s, 1, 57) || '...' ELSE s END), '|')) AS points,
    CASE WHEN contains(lower(text), 'les') OR contains(lower(text), 'der') THEN 'continental' WHEN contains(lower(text), 'the') THEN 'english'
      WHEN contains(lower(text), 'el') OR contains(lower(text), 'la') THEN 'iberian' ELSE 'other' END AS kind FROM documents""",
)
def lead_points(spark, d):
    t = table(spark, d, "documents")
    return t.select(
        "doc_id", F.md5(F.array_join(text.lead_points(F.col("text"), 3), "|")).alias("points"), text.keyword_class(F.col("text"), RULES, "other").alias("kind")
    )


@query(
    "label_prompt_rewrite",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Classify.' || chr(10) || 'Allowed: a, b' || chr(10) || 'Utterance: ' || text ELSE rtrim(text) || chr(10) || 'Allowed: a, b' END AS prompt FROM conversations""",
)
def label_prompt_rewrite(spark, d):
    c = table(spark, d, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Classify.  Utterance: "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.insert_before(raw, "Utterance:", F.lit("Allowed: a, b")).alias("prompt"))


@query(
    "model_spec",
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS provider, CASE WHEN doc_id % 5 <> 0 THEN source || '/x:' || lang END AS model,
    CASE WHEN doc_id % 5 <> 0 THEN lang || '_' || source || '_x_' || lang END AS slug FROM documents""",
)
def model_spec(spark, d):
    t = table(spark, d, "documents")
    spec = F.when(F.col("doc_id") % 5 != 0, F.concat("lang", F.lit(":"), "source", F.lit("/x:"), "lang")).otherwise(F.col("lang"))
    return t.select("doc_id", text.model_slug(spec).alias("s")).select("doc_id", "s.*")


@query(
    "dimension_lookup",
    f"WITH {EPISODES_SQL}, {MODEL_DIM_SQL}" + """ SELECT coalesce(vendor, 'unknown') AS vendor, coalesce(family, 'unknown') AS family,
    CASE WHEN size_b <= 3 THEN 'small' WHEN size_b <= 7 THEN 'medium' WHEN size_b > 7 THEN 'large' ELSE 'unknown' END AS size_range, count(*) AS n,
    round(avg(CAST(task_correct AS INT)), 6) AS accuracy FROM episodes LEFT JOIN model_dim USING (model) GROUP BY ALL""",
)
def dimension_lookup(spark, d):
    e = lookup(episodes(spark, d), model_dim(spark), "model", ["size_b", "vendor", "family"])
    size = F.when(F.col("size_b").isNull(), F.lit("unknown")).otherwise(text.size_bucket(F.col("size_b")))
    return rounded(
        e.groupBy("vendor", "family", size.alias("size_range")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("task_correct").cast("double")).alias("accuracy"))
    )


@query(
    "function_docs",
    """SELECT p_partkey, '### ' || p_type || chr(10) || 'Sells ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE chr(10) || 'Parameters:' || chr(10) || '  - size: integer (required)' || chr(10) || '  - brand: ' || p_brand END
    || chr(10) || chr(10) || '### noop' || chr(10) || 'Nothing' AS doc FROM part""",
)
def function_docs(spark, d):
    p = table(spark, d, "part")
    empty = F.expr("cast(map() as map<string,string>)")
    params = F.when(F.col("p_partkey") % 3 == 0, empty).otherwise(F.create_map(F.lit("size"), F.lit("integer"), F.lit("brand"), F.col("p_brand")))
    fn = lambda name, desc, prm, req: F.struct(name.alias("name"), desc.alias("description"), prm.alias("params"), req.alias("required"))
    docs = F.array(
        fn(F.col("p_type"), F.concat(F.lit("Sells "), "p_brand"), params, F.array(F.lit("size"))),
        fn(F.lit("noop"), F.lit("Nothing"), empty, F.array(F.lit("size"))),
    )
    return p.select("p_partkey", text.function_docs(docs).alias("doc"))
