"""Fingerprints, whitening and importance resampling against brute-force versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sloframe.llm import importance, sketch, whitening
from sloframe.llm.textbatch import slices, text_column

DOCS = "doc_id long, text string, key string, block int, place int, next_text string, score int, part int"


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "日本", "😀", "X9", "-", "a_b"]
    make = lambda n: " ".join(r.choice(vocabulary, n))
    rows = [make(int(n)) for n in r.integers(1, 200, 60)]
    long = "\n".join(make(9) for _ in range(900))
    rows += [long, long, long.replace("w7 ", "changed ", 1), long + "\n" + make(20), rows[0], "same line\n" * 400]
    return rows + [None, "", " \n\t", "one", "q" * 5000, "日" * 700, "A" * 40 + " " + "B" * 40]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(3 * i, t, "x", 1, 2, "y", 4, 5) for i, t in enumerate(texts)], DOCS).repartition(4)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Repeated and null ids, and no other columns filled."""
    rows = [(i % 40 if i % 9 else None, t, *[None] * 6) for i, t in enumerate([*texts, texts[0], texts[0]])]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# ---- fingerprints ----


def paragraphs(text):
    """Digest set by plain loops over the words of each line."""
    part = next(slices(batch_of([text]), "text"))
    data, out = part.data.tobytes(), Counter()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    hashed = lambda a, b: int(part.hashes(np.array([a]), np.array([b]))[0])
    begin = None
    for i, (a, b) in enumerate(words):
        begin = a if begin is None else begin
        if i + 1 == len(words) or b"\n" in data[b: words[i + 1][0]] or hashed(a, b) % sketch.EVERY == 0:
            out[hashed(begin, b)] += 1
            begin = None
    return {(d, i) for d, n in out.items() for i in range(n)}


def plain_next(rows):
    """Rows with their text and that of the next one."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    return [(k, a or "", order[(i + 1) % len(order)][1] or "") for i, (k, a) in enumerate(order)]


def test_edits_against_sets(docs, texts):
    got = {r.doc_id: r for r in sketch.fingerprint_edits(docs).collect()}
    assert len(got) == len(texts)
    cells = set()
    for k, a, b in plain_next([(3 * i, t) for i, t in enumerate(texts)]):
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(new.encode()).hexdigest())
        for other, near, removed, added in ((new, r.near_edited, r.edited_removed, r.edited_added), (b, r.near_next, r.next_removed, r.next_added)):
            x, y = paragraphs(a), paragraphs(other)
            assert near == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
            assert (len(removed), len(added)) == (len(x - y), len(y - x))
            # First occurrences keep the plain digest.
            assert {d for d, i in x - y if not i} <= {v % 2**64 for v in removed}
        cells |= {r.edited_cells, r.next_cells}
    assert len(cells) > 4  # some differences needed larger sketches
    prints = {}
    for i, t in enumerate(texts):
        prints.setdefault(t or "", set()).add(got[3 * i].fingerprint)
        assert len(base64.b64decode(got[3 * i].fingerprint)) == 24 * 20
    assert all(len(p) == 1 for p in prints.values()) and got[3 * 60].near_edited < 1 <= got[3 * 61].near_next


def test_blocks_give_the_same_order(docs, odd, texts, monkeypatch):
    whole = sorted(sketch.with_next(docs).collect(), key=str)
    assert sorted((r.doc_id, r.text, r.next_text) for r in whole) == sorted(plain_next([(3 * i, t) for i, t in enumerate(texts)]))
    monkeypatch.setattr(sketch, "BLOCK_BYTES", 1500)
    assert sorted(sketch.with_next(docs).collect(), key=str) == whole
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.text, r.next_text) for r in sketch.with_next(odd).collect())
    assert got == Counter(plain_next(rows))


def test_few_rows(spark):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sketch.fingerprint_edits(make()).collect() == []
    one = sketch.fingerprint_edits(make((7, "a b c d e f"))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].n_chars == 11
    none = sketch.fingerprint_edits(make((None, None), (None, None))).collect()
    assert [(r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in none] == [(None, 0, 1.0, 1.0)] * 2


def test_versions_of_columns(spark):
    rows = spark.createDataFrame([(1, "a b c\nd e", "a b c\nd e"), (2, None, "x"), (3, "x", None)], "n int, old string, new string")
    got = {r.n: r for r in sketch.compare_versions(rows, "old", ["new"], ["n"]).collect()}
    assert got[1].new_likeness == 1.0 and got[1].new_removed == [] and got[1].fingerprint == got[1].new_fingerprint
    assert got[2].new_added == got[3].new_removed != [] and got[2].new_likeness == 0.0


def test_small_sketch_fails_and_larger_one_recovers():
    r = np.random.default_rng(2)
    keys = r.integers(0, 2**63, 900, dtype=np.uint64)
    old = sketch.Digests(keys[:700], np.array([0, 700]))
    new = sketch.Digests(keys[400:], np.array([0, 500]))
    cells = sketch.sketches(old, np.array([0]), 0) - sketch.sketches(new, np.array([0]), 0)
    assert not sketch.peeled(cells, 1, 0)[3][0]
    diff = sketch.differences(old, new)
    assert set(diff.keys[diff.sign == 1]) == set(keys[:400]) and set(diff.keys[diff.sign == -1]) == set(keys[700:])
    assert diff.cells[0] > 600 and diff.likeness[0] == 300 / 900


# ---- whitening ----


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, row int, component string")


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    r = np.random.default_rng(8)
    base = (r.normal(size=(120, 20)) @ r.normal(size=(20, 20))).astype(np.float32)
    rows = [(i, v.tolist(), 1, 2, "c") for i, v in enumerate(base)]
    rows += [(200 + i, base[0].tolist(), 1, 2, "c") for i in range(80)]  # a hot vector
    rows += [(None, base[1].tolist(), 1, 2, "c"), (5, base[2].tolist(), 1, 2, "c")]
    bad = [None, [], [None] * 20, [float("nan")] + [0.0] * 19, [float("inf")] * 20, [3e38] * 20, [1.0, 2.0]]
    got = whitening.whiten(vectors(spark, rows + [(900 + i, v, 1, 2, "c") for i, v in enumerate(bad)]).repartition(5)).collect()
    x = np.floor(64 * base.astype(np.float64)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(0)
    level = distinct - total / n
    values, columns = np.linalg.eigh(level.T @ level / n)
    values, columns = values[::-1], columns[:, ::-1]
    assert Counter(g.vec_id for g in got) == Counter({**{i: 16 for i in (*range(120), *range(200, 280), None)}, 5: 32})
    signs = {}
    for g in got:
        if g.vec_id is None or g.vec_id == 5:
            continue
        at = g.vec_id if g.vec_id < 120 else 0
        c = g.component - 1
        want = float((x[at] - total / n) @ columns[:, c] / math.sqrt(values[c]))
        sign = signs.setdefault(c, 1.0 if abs(g.whitened - want) <= abs(g.whitened + want) else -1.0) if abs(want) > 1e-3 else signs.get(c)
        if sign:
            assert g.whitened == pytest.approx(sign * want, abs=1e-8)
        assert (g.n, g.deviation) == (n, int(((n * x[at] - total) ** 2).sum()))
        assert g.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert {g.identity_error for g in got} and max(g.identity_error for g in got) < 1e-9


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None, 1, 2, "c"), (2, [], 1, 2, "c")])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0], 1, 2, "c") for i in range(4)])).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [0.0, 1.0], 1, 2, "c"), (2, [2.0, 1.0], 1, 2, "c")])).collect()
    assert [(g.component, abs(g.whitened), g.explained, g.deviation) for g in got] == [(1, 1.0, 1.0, 128**2)] * 2


# ---- importance resampling ----


def features(text, longest=1):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i: i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_draw(rows, target, longest, percent, buckets=10_000):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(code(f) for _, t in rows for f in features(t, longest)[1])
    t = Counter(code(f) for x in target for f in features(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    out = []
    for k, text in rows:
        words, fs = features(text, longest)
        weight = sum(gain(code(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (1, 100), (3, 35)])
def test_draw_against_plain(spark, docs, odd, longest, percent):
    target = ["w1 w2 w3 naïve", None, "", "Straße w9 w1 w2 w3 " * 9]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for df in (docs, odd):
        got = Counter(tuple(r) for r in importance.resample(df, aim, longest=longest, percent=percent).collect())
        assert got == plain_draw([(r.doc_id, r.text) for r in df.collect()], target, longest, percent)


def test_draw_of_nothing(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).collect() == []
    got = importance.resample(docs, empty).collect()
    assert Counter(tuple(r) for r in got) == plain_draw([(r.doc_id, r.text) for r in docs.collect()], [], 1, 10)


def test_hashes_and_table(texts):
    part = next(slices(batch_of(texts), "text"))
    spans, owners, words = importance.grams(part, 2)
    assert len(text_column(batch_of(texts), "text")) == len(words)
    got = list(spans.read(np.arange(len(owners))))
    want = [f.encode() for n in (1, 2) for t in texts for f in features(t, 2)[1] if f.count(" ") == n - 1]
    assert sorted(got) == sorted(want)
    hashes = spans.hashes()
    assert [int(h) for h in hashes] == [xxhash.xxh64_intdigest(g) for g in got]
    # Equal hashes everywhere: only the bytes tell n-grams apart.
    few = importance.Spans(spans._data, spans.starts[:400], spans.starts[:400] + spans.lengths[:400])
    for h in (None, np.zeros(400, np.uint64)):
        table = importance.interned(few, 50, h)
        slots = {}
        for g, s in zip(got, table.slot.tolist(), strict=False):
            slots.setdefault(g, set()).add(s)
        assert all(len(s) == 1 for s in slots.values()) and len({min(s) for s in slots.values()}) == len(slots)
        assert all(table.bucket[min(s)] == zlib.crc32(g) % 50 for g, s in slots.items())
        assert {g: int(table.count[min(s)]) for g, s in slots.items()} == Counter(got[:400])
