"""Queries: stability, votes, label metrics, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sloframe.functions import jsonops
from sloframe.operators import classify, joins, stability
from sloframe.operators.ordered import attach
from sloframe.plans.registry import query, rounded
from sloframe.plans.views import episodes, table

REPLICATES_SQL = """replicates AS (SELECT user_id || '|' || event_type AS prompt_id, 'm' || (user_id % 13) AS model, event_id,
  '{"k":' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) || '}' AS canon, event_id % 97 <> 0 AND event_id % 3 <> 1 AS valid FROM events)"""


def replicates(spark, d):
    e = episodes(spark, d)
    raw = F.concat(F.lit('{ "k" : '), (F.col("k") % 4).cast("string"), F.lit("}"))
    return e.select(
        "prompt_id", "model", "event_id", jsonops.canonical(raw).alias("canon"), (F.col("json_valid") & (F.col("event_id") % 3 != 1)).alias("valid")
    )


_PER = "c AS (SELECT model, prompt_id, canon, count(*) AS c FROM replicates GROUP BY ALL), p AS (SELECT model, prompt_id, sum(c) AS n, count(*) AS u, max(c) AS m FROM c GROUP BY model, prompt_id)"


@query(
    "disagreement_at_k",
    f"WITH {REPLICATES_SQL}, {_PER}" + """ SELECT model, count(*) AS num_groups, count(*) FILTER (WHERE n >= 5) AS num_groups_used,
    round(avg(m / n) FILTER (WHERE n >= 5), 6) AS agreement_rate, round(avg(1 - m / n) FILTER (WHERE n >= 5), 6) AS disagreement_at_k FROM p GROUP BY model""",
)
def disagreement_at_k(spark, d):
    return rounded(stability.disagreement(replicates(spark, d), ["model"], ["prompt_id"], F.col("canon"), 5))


@query(
    "agreement_per_prompt",
    f"WITH {REPLICATES_SQL}, {_PER}" + """ SELECT prompt_id, CAST(n AS BIGINT) AS runs, u AS distinct_outputs, m AS mode_count, round(m / n, 6) AS agreement, round(1 - m / n, 6) AS disagreement FROM p WHERE n >= 2""",
)
def agreement_per_prompt(spark, d):
    return rounded(stability.prompt_agreement(replicates(spark, d), ["prompt_id"], F.col("canon")))


@query(
    "disagreement_distinct",
    f"WITH {REPLICATES_SQL}, {_PER}" + """ SELECT model, count(*) AS num_groups, round(avg(1 - greatest(1, n - u + 1) / n), 6) AS disagreement FROM p WHERE n >= 2 GROUP BY model""",
)
def disagreement_distinct(spark, d):
    return rounded(stability.distinct_disagreement(replicates(spark, d), ["model"], ["prompt_id"], F.col("canon")))


@query(
    "majority_vote",
    f"WITH {REPLICATES_SQL}" + """, c AS (SELECT prompt_id, canon, count(*) AS v, min(event_id) AS f FROM replicates WHERE valid GROUP BY prompt_id, canon),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY v DESC, f) AS r FROM c) WHERE r = 1),
  t AS (SELECT prompt_id, sum(CAST(valid AS INT)) AS va, max(event_id) AS le, arg_max(canon, event_id) AS lc FROM replicates GROUP BY prompt_id)
  SELECT t.prompt_id, coalesce(canon, lc) AS output, coalesce(f, le) AS attempt, coalesce(v, 0) AS votes, CAST(va AS BIGINT) AS valid_attempts FROM t LEFT JOIN best USING (prompt_id)""",
)
def majority_vote(spark, d):
    return stability.majority_vote(replicates(spark, d), ["prompt_id"], F.col("canon"), F.col("valid"), F.col("event_id"))


@query(
    "first_valid_vote",
    f"WITH {REPLICATES_SQL}" + """, t AS (SELECT prompt_id, sum(CAST(valid AS INT)) AS va, coalesce(min(event_id) FILTER (WHERE valid), max(event_id)) AS a FROM replicates GROUP BY prompt_id)
  SELECT t.prompt_id, canon AS output, a AS attempt, CAST(va AS BIGINT) AS valid_attempts FROM t JOIN replicates r ON r.event_id = a""",
)
def first_valid_vote(spark, d):
    return stability.majority_vote(replicates(spark, d), ["prompt_id"], F.col("canon"), F.col("valid"), F.col("event_id"), "first_valid").drop("votes")


PREDICTED_SQL = """predicted AS (SELECT 'm' || (user_id % 13) AS model, event_id, event_type AS y, CASE WHEN event_id % 29 = 0 THEN NULL WHEN k % 4 = 0 THEN 'view' WHEN k % 7 = 0 THEN 'other' ELSE event_type END AS yp
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def predicted(spark, d):
    k = F.col("k")
    return episodes(spark, d).select(
        "model", "event_id", F.col("task").alias("y"), F.when(F.col("event_id") % 29 == 0, None).when(k % 4 == 0, "view").when(k % 7 == 0, "other").otherwise(F.col("task")).alias("yp")
    )


_LABELS = """lab AS (SELECT DISTINCT model, y AS label FROM predicted WHERE yp IS NOT NULL UNION SELECT DISTINCT model, yp FROM predicted WHERE yp IS NOT NULL),
  s AS (SELECT l.model, l.label, count(*) FILTER (WHERE y = label AND yp = label) AS tp, count(*) FILTER (WHERE y <> label AND yp = label) AS fp,
    count(*) FILTER (WHERE y = label AND yp <> label) AS fn FROM lab l JOIN predicted p ON p.model = l.model GROUP BY l.model, l.label),
  pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s),
  f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query("macro_f1", f"WITH {PREDICTED_SQL}, {_LABELS} SELECT model, count(*) AS n_labels, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY model")
def macro_f1(spark, d):
    return rounded(classify.macro_f1(predicted(spark, d), ["model"], "y", "yp"))


@query(
    "label_scores",
    f"WITH {PREDICTED_SQL}, {_LABELS} SELECT model, label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
)
def label_scores(spark, d):
    return rounded(classify.label_scores(predicted(spark, d), ["model"], "y", "yp"))


@query("unscored_rows", f"WITH {PREDICTED_SQL} SELECT model, count(*) AS n, count(*) FILTER (WHERE yp IS NULL) AS n_unscored FROM predicted GROUP BY model")
def unscored_rows(spark, d):
    return classify.unscored(predicted(spark, d), ["model"], "y", "yp")


@query(
    "out_of_scope",
    f"WITH all_{PREDICTED_SQL}, o AS (SELECT model, count(*) AS n_oos, round(avg(CAST(yp = y AS INT)), 6) AS oos_accuracy FROM all_predicted WHERE y = 'error' AND yp IS NOT NULL GROUP BY model), predicted AS (SELECT * FROM all_predicted WHERE y <> 'error'), "
    f"{_LABELS} SELECT model, count(*) AS n_labels, round(avg(f1), 6) AS macro_f1, any_value(n_oos) AS n_oos, any_value(oos_accuracy) AS oos_accuracy FROM f JOIN o USING (model) GROUP BY model",
)
def out_of_scope(spark, d):
    return rounded(classify.out_of_scope(predicted(spark, d), ["model"], "y", "yp", "error"))


@query(
    "macro_f1_smoothed",
    """WITH p AS (SELECT quality AS y, CAST(n_chars > 800 AS INT) AS yp FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT l, count(*) FILTER (WHERE y = l AND yp = l) AS tp, count(*) FILTER (WHERE y <> l AND yp = l) AS fp, count(*) FILTER (WHERE y = l AND yp <> l) AS fn FROM p, (VALUES (0), (1)) t(l) GROUP BY l),
  r AS (SELECT tp / (tp + fp + 1e-9::DOUBLE) AS a, tp / (tp + fn + 1e-9::DOUBLE) AS b FROM s)
  SELECT count(*) AS n_labels, round(avg(2 * a * b / (a + b + 1e-9::DOUBLE)), 6) AS macro_f1 FROM r""",
)
def macro_f1_smoothed(spark, d):
    return rounded(classify.macro_f1(label_pred(spark, d), [], "y", "yp", eps=1e-9))


def label_pred(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") > 800).cast("int").alias("yp"))
    return table(spark, d, "labels").join(docs, "doc_id").withColumnRenamed("quality", "y")


@query(
    "accuracy_by_source",
    "SELECT source, count(*) AS n, round(avg(CAST(quality = CAST(n_chars > 800 AS INT) AS INT)), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY source",
)
def accuracy_by_source(spark, d):
    return rounded(classify.accuracy(label_pred(spark, d), ["source"], "y", "yp"))


@query(
    "cohen_kappa",
    """WITH a AS (SELECT CASE WHEN doc_id % 23 = 0 THEN '' ELSE CAST(quality AS VARCHAR) END AS a, CAST(1 - toxic AS VARCHAR) AS b FROM labels), p AS (SELECT * FROM a WHERE a <> '' AND b <> ''),
  t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = b) AS g FROM p),
  e AS (SELECT sum(ca * cb)::DOUBLE AS x FROM (SELECT a, count(*) AS ca FROM p GROUP BY a) JOIN (SELECT b, count(*) AS cb FROM p GROUP BY b) ON a = b)
  SELECT CAST(n AS BIGINT) AS n, round(g / n, 6) AS observed, round(x / (n * n), 6) AS expected, round((g / n - x / (n * n)) / (1 - x / (n * n)), 6) AS kappa FROM t, e""",
)
def cohen_kappa(spark, d):
    a = F.when(F.col("doc_id") % 23 == 0, F.lit("")).otherwise(F.col("quality").cast("string"))
    t = table(spark, d, "labels").select(a.alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))
    return rounded(classify.cohen_kappa(t, [], "a", "b"))


@query(
    "label_domain_check",
    """WITH dom AS (SELECT DISTINCT event_type AS l FROM events WHERE event_type <> 'signup') SELECT 'm' || (user_id % 13) AS model, count(*) AS n, count(l) AS matched,
    round(count(l) / count(*), 6) AS match_rate, count(l) = count(*) AS accepted FROM events LEFT JOIN dom ON event_type = l GROUP BY 1""",
)
def label_domain_check(spark, d):
    e = episodes(spark, d)
    return rounded(classify.label_domain(e, ["model"], "task", e.where("task <> 'signup'"), "task"))


@query(
    "pred_gold_join",
    """WITH p AS (SELECT event_id // 3 AS doc_id, arg_max(event_type, event_id) AS pred FROM events WHERE (event_id // 3) % 4 <> 0 GROUP BY 1)
  SELECT lang, count(*) AS n, count(*) FILTER (WHERE pred IS NULL) AS missing, count(*) FILTER (WHERE pred = CASE doc_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'error' END) AS correct
  FROM documents LEFT JOIN p USING (doc_id) GROUP BY lang""",
)
def pred_gold_join(spark, d):
    p = table(spark, d, "events").select(F.expr("event_id div 3").alias("doc_id"), F.col("event_type").alias("pred"), "event_id").where("doc_id % 4 <> 0")
    g = table(spark, d, "documents").select("doc_id", "lang", F.expr("case doc_id % 3 when 0 then 'view' when 1 then 'click' else 'error' end").alias("gold"))
    j = joins.pred_gold(p, g, "doc_id", F.col("event_id"))
    return j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("missing"), F.count_if(F.col("pred") == F.col("gold")).alias("correct")
    )


@query(
    "positional_join",
    """SELECT c.conv_id, c.turn, c.role, CAST(length(c.text) AS INT) AS left_len, CAST(length(d.text) AS INT) AS right_len FROM conversations c, documents d, (SELECT max(conv_id) + 1 AS m FROM conversations) WHERE d.doc_id % m = c.conv_id AND d.doc_id // m = c.turn""",
)
def positional_join(spark, d):
    left, right = _two_logs(spark, d)
    return joins.positional(left, right, ["conv_id"], "turn")


def _two_logs(spark, d):
    left = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("left_len"))
    count = table(spark, d, "conversations").agg((F.max("conv_id") + 1).alias("m"))
    right = attach(table(spark, d, "documents"), count, []).select(
        (F.col("doc_id") % F.col("m")).alias("conv_id"), F.expr("doc_id div m").alias("turn"), F.length("text").alias("right_len")
    )
    return left, right


@query(
    "length_mismatch",
    """WITH a AS (SELECT conv_id, count(*) AS l FROM conversations GROUP BY 1), b AS (SELECT doc_id % m AS conv_id, count(*) AS r FROM documents, (SELECT max(conv_id) + 1 AS m FROM conversations) GROUP BY 1)
  SELECT conv_id, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows FROM a FULL JOIN b USING (conv_id) WHERE coalesce(l, 0) <> coalesce(r, 0)""",
)
def length_mismatch(spark, d):
    left, right = _two_logs(spark, d)
    return joins.lengths_differ(left, right, ["conv_id"])


@query(
    "text_lookup_first_wins",
    """WITH t AS (SELECT lower(trim(text)) AS t, arg_min(lang, doc_id) AS l FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1),
  q AS (SELECT doc_id, '  ' || text || ' ' AS text, doc_id % 5 - 1 AS id FROM documents)
  SELECT doc_id, coalesce(l, CASE id WHEN 0 THEN 'l0' WHEN 1 THEN 'l1' WHEN 2 THEN 'l2' END) AS label, coalesce(l, CASE id WHEN 0 THEN 'l0' WHEN 1 THEN 'l1' WHEN 2 THEN 'l2' END) IS NULL AS label_error
  FROM q LEFT JOIN t ON lower(trim(q.text)) = t.t""",
)
def text_lookup_first_wins(spark, d):
    docs = table(spark, d, "documents")
    names = joins.text_labels(docs.where("doc_id % 3 <> 0"), "text", "lang", F.col("doc_id"))
    asked = docs.select("doc_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), (F.col("doc_id") % 5 - 1).alias("id"))
    return joins.relabel_by_text(asked, "text", "id", ["l0", "l1", "l2"], names).select("doc_id", "label", "label_error")


@query(
    "unknown_and_done_keys",
    """WITH done AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT o_orderpriority, count(*) FILTER (WHERE d.o_custkey IS NULL) AS pending, count(*) FILTER (WHERE d.o_custkey IS NOT NULL) AS known
  FROM orders o LEFT JOIN done d USING (o_custkey) GROUP BY 1""",
)
def unknown_and_done_keys(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    done = o.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    pending = joins.unmatched(o, done, ["o_custkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("pending"))
    known = joins.matched(o, done, ["o_custkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("known"))
    return known.join(pending, "o_orderpriority", "full").na.fill(0)


@query(
    "dedupe_keep_first_last",
    """SELECT md5(text) AS key, min(doc_id) AS first_id, max(doc_id) AS last_id, arg_min(source, doc_id) AS first_source, arg_max(source, doc_id) AS last_source FROM documents GROUP BY text""",
)
def dedupe_keep_first_last(spark, d):
    t = table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    first = joins.keep_first(t, ["key"], F.col("doc_id")).toDF("key", "first_id", "first_source")
    last = joins.keep_last(t, ["key"], F.col("doc_id")).toDF("key", "last_id", "last_source")
    return first.join(last, "key")


@query(
    "key_remap",
    """SELECT coalesce(CASE WHEN user_id % 13 <= 9 THEN 'Model-' || (user_id % 13) END, '?') AS model, count(*) AS n FROM events GROUP BY 1""",
)
def key_remap(spark, d):
    names = spark.createDataFrame([(f"m{i}", f"Model-{i}") for i in range(10)], "old string, new string")
    return joins.rename_keys(episodes(spark, d).select("model"), "model", names, "old", "new").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_logs",
    """WITH u AS (SELECT 'req' AS kind, value * 100 AS latency_ms, NULL::DOUBLE AS reward FROM events UNION ALL SELECT 'step', NULL, o_totalprice / 100000 FROM orders)
  SELECT kind, count(*) AS n, count(latency_ms) AS n_latency, count(reward) AS n_reward, round(sum(reward), 4) AS reward FROM u GROUP BY kind""",
)
def union_logs(spark, d):
    req = table(spark, d, "events").select(F.lit("req").alias("kind"), (F.col("value") * 100).alias("latency_ms"))
    step = table(spark, d, "orders").select(F.lit("step").alias("kind"), (F.col("o_totalprice") / 100000).alias("reward"))
    return rounded(
        joins.union_by_name([req, step]).groupBy("kind").agg(
            F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("n_latency"), F.count("reward").alias("n_reward"), F.sum("reward").alias("reward")
        ),
        4,
    )
