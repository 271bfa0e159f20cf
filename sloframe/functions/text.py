"""Text helpers, all Column -> Column and JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sloframe.functions.binding import let_all

# Patterns that decide which text counts as equal.
SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"
ARTICLE = r"(?=[at])(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
ANSWER_MARK = "####"
BOXED = r"\\boxed\{([^{}]*)\}"


def squeeze(text: Column) -> Column:
    """Lower case, one space between words, no outer space."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def lower_trim(text: Column) -> Column:
    return F.lower(F.trim(text))


def qa_normalize(text: Column) -> Column:
    """Lower case, articles and ASCII punctuation removed, spaces squeezed."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), ARTICLE, " "), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def tokens(normalized: Column) -> Column:
    """Words of already normalised text; empty text has none."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(squeeze(F.coalesce(text, F.lit("")))))


def harmonic(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).otherwise(F.lit(0.0))


def _overlap(a: Column, b: Column, body: Callable[[Column], Column]) -> Column:
    """Bind the sizes of two sets and of their intersection."""
    return let_all(
        {"a": a, "b": b},
        lambda s: let_all({"n": F.size(F.array_intersect(s["a"], s["b"])), "a": F.size(s["a"]), "b": F.size(s["b"])}, body),
    )


def set_f1(pred: Column, gold: Column, both_empty: float = 1.0) -> Column:
    """F1 of two arrays of distinct items; an empty gold side scores 0."""
    return _overlap(
        pred,
        gold,
        lambda s: F.when((s["a"] == 0) & (s["b"] == 0), F.lit(both_empty))
        .when((s["b"] == 0) | (s["n"] == 0), F.lit(0.0))
        .otherwise(2.0 * s["n"] / (s["a"] + s["b"])),
    )


def set_jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    return _overlap(
        a, b, lambda s: F.when(s["a"] + s["b"] > 0, s["n"] / (s["a"] + s["b"] - s["n"])).otherwise(F.lit(both_empty))
    )


def set_precision_recall(pred: Column, gold: Column) -> Column:
    """Struct(precision, recall) of two arrays taken as sets; an empty side is NULL."""
    share = lambda n, of: F.when(of > 0, n / of)
    return _overlap(
        F.array_distinct(pred),
        F.array_distinct(gold),
        lambda s: F.struct(share(s["n"], s["a"]).alias("precision"), share(s["n"], s["b"]).alias("recall")),
    )


def bag_f1_from_counts(shared: Column, n_pred: Column, n_gold: Column) -> Column:
    """Bag-of-words F1 from the multiset overlap and the two lengths."""
    return (
        F.when((n_pred == 0) & (n_gold == 0), F.lit(1.0))
        .when((n_pred == 0) | (n_gold == 0) | (shared == 0), F.lit(0.0))
        .otherwise(harmonic(shared / n_pred, shared / n_gold))
    )


def last_number(text: Column) -> Column:
    """Last number in the text, thousands commas removed first."""
    found = F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(NUMBER), 0)
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def marked_answer(text: Column) -> Column:
    """Text after the last answer mark; NULL without a mark."""
    return F.when(F.contains(text, F.lit(ANSWER_MARK)), F.trim(F.substring_index(text, ANSWER_MARK, -1)))


def boxed_answer(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(BOXED), 1)
    return F.try_element_at(found, F.lit(-1))


def question_and_context(prompt: Column, question_mark: str = "Question:", context_mark: str = "Context:") -> Column:
    """Struct(question, context) of a prompt with markers; without a question
    marker the question is empty and the whole prompt is context."""
    at = F.instr(prompt, question_mark)
    head = F.substring(prompt, F.lit(1), at - 1)
    question = F.trim(F.substring(prompt, at + len(question_mark), F.length(prompt)))
    mark = F.instr(head, context_mark)
    inner = F.when(mark > 0, F.substring(head, mark + len(context_mark), F.length(head))).otherwise(head)
    return F.struct(
        F.when(at > 0, question).otherwise(F.lit("")).alias("question"),
        F.when(at > 0, F.trim(inner)).otherwise(prompt).alias("context"),
    )


def blocklist_hit(texts: Sequence[Column], terms: Sequence[str]) -> Column:
    """True when any term occurs, ignoring case, in any of the texts. Terms are stripped
    and blank ones are skipped."""
    hay = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    hit = F.lit(False)
    for term in [t.strip().lower() for t in terms if t.strip()]:
        for h in hay:
            hit = hit | F.contains(h, F.lit(term))
    return hit


def guard_length(prompt: Column, max_chars: int) -> Column:
    """Struct(prompt cut to max_chars, whether it was longer)."""
    return F.struct(
        F.substring(prompt, 1, max_chars).alias("prompt"),
        (F.length(prompt) > max_chars).alias("too_long"),
    )


def numbered_lines(sentences: Column) -> Column:
    """``[0] first\\n[1] second`` from an array of sentences."""
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("["), i, F.lit("] "), s)), "\n")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\. "), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def lead_points(text: Column, k: int, width: int = 60) -> Column:
    """First ``k`` sentences; long ones cut so that cut + dots fit in ``width``."""
    cut = lambda s: F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 3), F.lit("..."))).otherwise(s)
    return F.transform(F.slice(sentences(text), 1, k), cut)


def keyword_class(text: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Label of the first rule with any keyword in the text (case ignored)."""
    low = F.lower(text)
    out = None
    for words, label in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def insert_before(prompt: Column, marker: str, block: Column) -> Column:
    """Put ``block`` on its own line before the first marker, or at the end."""
    at = F.instr(prompt, marker)
    head = F.rtrim(F.substring(prompt, F.lit(1), at - 1))
    tail = F.substring(prompt, at, F.length(prompt))
    return F.when(at > 0, F.concat(head, F.lit("\n"), block, F.lit("\n"), tail)).otherwise(
        F.concat(F.rtrim(prompt), F.lit("\n"), block)
    )


def model_slug(spec: Column) -> Column:
    """Struct(provider, model, slug) of ``provider:model``."""
    parts = F.split(spec, ":", 2)
    model = F.try_element_at(parts, F.lit(2))
    return F.struct(
        F.when(model.isNotNull(), parts[0]).alias("provider"),
        model.alias("model"),
        F.when(model.isNotNull(), F.concat_ws("_", parts[0], F.regexp_replace(model, r"[/:\s]", "_"))).alias("slug"),
    )


def size_bucket(size_b: Column, small: float = 3.0, medium: float = 7.0) -> Column:
    return F.when(size_b <= small, F.lit("small")).when(size_b <= medium, F.lit("medium")).otherwise(F.lit("large"))


def first_user_text(turns: Column) -> Column:
    """Content of the first user message of an array of struct(role, content); for
    messages nested per turn pass ``F.flatten(turns)``. Empty text without one."""
    said = F.filter(turns, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(said, F.lit(1))["content"], F.lit(""))


def function_docs(functions: Column) -> Column:
    """Prompt text from an array of struct(name, description, params map, required)."""

    def one(fn: Column) -> Column:
        lines = F.transform(
            F.map_entries(fn["params"]),
            lambda e: F.concat(
                F.lit("  - "), e["key"], F.lit(": "), e["value"],
                F.when(F.array_contains(fn["required"], e["key"]), F.lit(" (required)")).otherwise(F.lit("")),
            ),
        )
        return F.concat(
            F.lit("### "), fn["name"], F.lit("\n"), fn["description"],
            F.when(F.size(lines) > 0, F.concat(F.lit("\nParameters:\n"), F.array_join(lines, "\n"))).otherwise(F.lit("")),
        )

    return F.array_join(F.transform(functions, one), "\n\n")
