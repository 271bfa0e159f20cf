"""Repeated ids, rare cells of a mix, and pages that were not made by the fitted generator."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from sloframe.llm import html, lines, minhash, mixing

DOCS = "doc_id long, text string, lang string, source string, value string, weight double, tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", 0.5, 3) for r in rows], DOCS).repartition(4)


def test_a_document_given_ten_times_keeps_its_lines(spark):
    rows = [(1, "only mine\nshared", "en", "s")] * 10 + [(i, f"own {i}\nshared", "en", "s") for i in range(2, 12)]
    rows += [(None, "no id\nshared", "en", "s")] * 10 + [(20, "a\na", None, None), (20, "b\nshared", None, None)]
    got = {}
    for r in lines.dedup_lines(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, Counter())[r.kept_text, r.n_dropped] += 1
    assert got[1] == {("only mine", 1): 10} and got[2] == {("own 2", 1): 1}
    # Rows without an id are documents of their own.
    assert got[None] == {("", 2): 10} and got[20] == {("a\na", 0): 1, ("b", 1): 1}
    plain = {r.n_docs for r in lines.frequent_lines(frame(spark, rows), id="doc_id").collect()}
    assert plain == {22, 10}


def test_a_repeated_id_links_by_each_of_its_texts(spark):
    r = np.random.default_rng(1)
    make = lambda: [f"w{x}" for x in r.integers(0, 5000, 80)]
    a, b, c = make(), make(), make()
    near_b = [*b[:79], "other"]
    text = " ".join
    rows = [(5, text(a), "en", "s"), (5, text(b), "en", "s"), (3, text(a), "en", "s"), (9, text(near_b), "en", "s"), (7, text(c), "en", "s"), (7, text(c), "en", "s")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 7}
    kept = Counter(r.doc_id for r in minhash.keep_representatives(frame(spark, rows)).collect())
    assert kept == {3: 1, 7: 2}


@pytest.fixture(scope="module")
def mix_rows():
    r = np.random.default_rng(12)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, " ".join(r.choice([f"word{k}" for k in range(60)], int(r.integers(1, 60)))), ["en", "de", None][i % 5 % 3], source))
    return [*rows, (1000, None, "en", "hot"), (1001, "", "en", "hot"), (None, "some words here", "en", "hot")]


def plain_mix(rows, keep=0.9, exponent=0.7, cycles=8):
    """Probability of each cell by plain loops."""
    cells = Counter()
    for _, text, lang, source in rows:
        words = (text or "").lower().encode().split()
        cells[source or "", lang or "", f"t{mixing.topic_of(words)}"] += len(words)
    cells = {k: n for k, n in cells.items() if n}
    budget = keep * sum(cells.values())
    goals = []
    for d in range(3):
        have = Counter()
        for k, n in cells.items():
            have[k[d]] += n
        target = {v: n**exponent for v, n in have.items()}
        target = {v: t / sum(target.values()) for v, t in target.items()}
        scale = budget
        for _ in range(6):
            short = [v for v in have if have[v] <= target[v] * scale]
            left = sum(target[v] for v in have if v not in short)
            scale = (budget - sum(have[v] for v in short)) / left if left else scale
        goals.append({v: min(have[v], target[v] * scale) for v in have})
    w = {k: n * budget / sum(cells.values()) for k, n in cells.items()}
    for _ in range(cycles):
        for d in range(3):
            margin = Counter()
            for k, x in w.items():
                margin[k[d]] += x
            w = {k: min(cells[k], x * goals[d][k[d]] / margin[k[d]]) for k, x in w.items()}
    return {k: w[k] / cells[k] for k in cells}, budget


def test_mixing_against_plain(spark, mix_rows):
    want, budget = plain_mix(mix_rows)
    expected = 0
    for r in mixing.calibrated(frame(spark, mix_rows)).collect():
        p = want.get((r.source, r.lang, r.topic), 0) if r.tokens else 0
        assert r.probability == pytest.approx(p)
        u = int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.kept == (u < r.probability)
        expected += r.tokens * r.probability
    assert expected == pytest.approx(budget, rel=0.02) and max(want.values()) == 1


def test_one_rare_document_changes_little(spark, mix_rows):
    share = lambda rows: sum(r.tokens * r.probability for r in rows) / sum(r.tokens for r in rows)
    before = share(mixing.calibrated(frame(spark, mix_rows)).collect())
    after = share(mixing.calibrated(frame(spark, [*mix_rows, (5000, "new " * 60, "xx", "rare")])).collect())
    assert before > 0.89 and abs(before - after) < 0.01


def test_mixing_of_targets_that_the_corpus_cannot_meet(spark, mix_rows):
    targets = {"source": [("hot", 0.01), ("s1", 0.99)], "lang": [("en", 0.5), ("de", 0.5)], "topic": [(f"t{i}", 0.125) for i in range(8)]}
    tables = {d: spark.createDataFrame(t, "value string, target double") for d, t in targets.items()}
    got = mixing.calibrated(frame(spark, mix_rows), tables, keep=0.5).collect()
    assert all(0 <= r.probability <= 1 for r in got) and any(r.kept for r in got)
    assert all(r.probability == 0 for r in got if r.source not in ("hot", "s1") or r.lang == "")
    assert mixing.calibrated(frame(spark, [])).collect() == []


# ---- pages ----


def test_deep_and_wide_pages():
    import time

    began = time.process_time()
    assert len(html.Dom("<div>" * 100_000 + "x").nodes) == 100_001
    assert len(html.Dom("<p>a<table><tr><td>" + "<div>" * 30_000 + "x").nodes) > 30_000
    assert time.process_time() - began < 20  # once over the tags: 10,000 took as long before
    wide = html.features(html.Dom("<body>" + "<div>a</div>" * 60 + "<p>b</p>" * 40))
    assert [n.tag for n in html.Dom("<body><div>").nodes] == ["html", "body", "div"]
    assert wide[-1][-1] == pytest.approx(0.4) and wide[2][-1] == pytest.approx(0.6)


@pytest.mark.parametrize(
    ("page", "tags"),
    [
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["ul", "li", "ul", "li", "li", "li"]),
        ("<p>a<p>b<div>c<p>d</div>e", ["p", "p", "div", "p"]),
        ("<table><tr><td>a<td>b<tr><td>c</table><p>d", ["table", "tr", "td", "td", "tr", "td", "p"]),
        ("<p>a<table><tr><td><p>b</table></p>", ["p", "table", "tr", "td", "p"]),
        ("</div></p><h1>a<h2>b</h2>c", ["h1", "h2"]),
    ],
)
def test_open_tags_close_as_before(page, tags):
    dom = html.Dom(page)
    assert [n.tag for n in dom.nodes[1:]] == tags
    for i, n in enumerate(dom.nodes[1:], 1):
        assert dom.nodes[n.parent].children[n.place] == i
    text = [t for _, t, _ in dom.runs]
    assert text == sorted(text)


# ---- class model ----


def test_scores_follow_from_the_classes(spark):
    """Scores by plain loops over the texts, given the classes that the operator found."""
    import math
    import re

    from sloframe.llm import brown
    from sloframe.llm.textbatch import slices

    r = np.random.default_rng(21)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(r.choice(words, int(r.integers(0, 40)), p=None)) for _ in range(150)] + ["only once here", "Unseen éé words", "", None, "w1 " * 300]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    share = 0.006
    got = {x.doc_id: x for x in brown.score_documents(docs, share=share).collect()}

    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""] for t in texts]
    train = [i for i in range(len(texts)) if not brown.held_out(i)]
    count = Counter(w for i in train for w in tokens[i])
    import pyarrow as pa

    names = sorted(set(count) | {w for t in tokens for w in t} - {""})
    names = [n for n in names if n]
    part = next(slices(pa.RecordBatch.from_arrays([pa.array([" ".join(names)])], ["text"]), "text"))
    starts, ends, _ = part.words()
    term = dict(zip(names, part.hashes(starts, ends, lower=True).view(np.int64).tolist(), strict=True))

    # The operator's own classes.
    blocks = brown.read_blocks(docs)
    parts = brown._parts_for(blocks)
    known = brown._word_counts(blocks, parts)
    assert {x.term: x.c for x in known.collect()} == {**{term[w]: n for w, n in count.items() if w}, brown.END_TERM: count[""]}
    often = sorted((np.uint64(term[w] % 2**64), n) for w, n in count.items() if w and n >= share * count.total())
    frequent, n = np.array([t for t, _ in often], np.uint64), np.array([c for _, c in often])
    model = brown.Model(count.total(), len(count), frequent, brown.cluster(brown._frequent_bigrams(blocks, frequent), n), np.zeros((brown.ALL, brown.ALL), np.int64), parts)
    of = {x.term: x["class"] for x in brown.cluster_rest(blocks, model).collect()}
    of.update(zip(frequent.view(np.int64).tolist(), model.classes.tolist(), strict=True))
    assert len(frequent) > 10 and len(of) > len(frequent) + 10

    def class_of(w):
        return brown.END if not w else brown.UNSEEN if not count[w] else of.get(term[w], brown.ONCE)

    moves = np.zeros((brown.ALL, brown.ALL))
    for i in train:
        before = brown.END
        for w in tokens[i]:
            moves[before, class_of(w)] += 1
            before = class_of(w)
    size = moves.sum(axis=0)
    assert all(sum(c for w, c in count.items() if class_of(w) == k) == size[k] for k in range(brown.ALL) if k != brown.UNSEEN)
    moves[:, brown.UNSEEN] = moves[:, brown.ONCE]
    chance = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)
    assert np.allclose(chance.sum(axis=1), 1)
    for i, t in enumerate(tokens):
        before, total = brown.END, 0.0
        for w in t:
            k = class_of(w)
            emitted = 1 / (len(count) + 1) if k == brown.UNSEEN else count[w] / size[k]
            total += math.log10(chance[before, k] * emitted)
            before = k
        assert got[i].score == pytest.approx(total), i


def test_copies_that_tie_end_at_k_in_a_shard(spark):
    import numpy as np
    import pyarrow as pa

    from sloframe.llm import search

    docs = spark.createDataFrame([(None if i == 5 else 100 - i, "one two three") for i in range(90)], "doc_id long, text string").coalesce(1)
    index = search.build_index(docs)
    row = index.shards.first()
    shard = search.Shard(row.terms, row.starts, row.docs, row.counts, row.lengths, 3.0, pa.array(row.ids, pa.int64()))
    at, score = shard.top(shard.terms, np.ones(len(shard.terms)), 4, 0.0)
    assert sorted(row.ids[i] for i in at) == [11, 12, 13, 14] and len(set(score)) == 1
    found = search.search(index, docs.where("doc_id = 50"), k=4).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in found] == [(1, 11), (2, 12), (3, 13), (4, 14)]


def test_shards_are_small_and_keep_large_numbers(spark):
    """A posting takes a few bytes, also where a word's count and the documents need more than one."""
    import numpy as np

    from sloframe.llm import search

    r = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(300, size=100))) for i in range(600)] + [(600, "often " * 70_000), (601, None)]
    index = search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shard_bytes=1 << 30)
    row = index.shards.first()
    postings, words = sum(len(set((t or "").split())) for _, t in rows), len({w for _, t in rows for w in (t or "").split()})
    assert sum(len(row[c]) for c in ("terms", "starts", "docs", "counts", "lengths")) < 3 * postings + 10 * words + 8192
    shard = search.Shard(row.terms, row.starts, row.docs, row.counts, row.lengths, 100.0)
    assert (len(shard.terms), len(shard.docs), shard.size) == (words, postings, 602)
    length = 1.2 * (0.25 + 0.75 * 70_000 / 100)
    assert shard.factor[shard.docs == 600].tolist() == [70_000 * 2.2 / (70_000 + length)]


def test_search_releases_the_terms_of_each_block(spark, monkeypatch):
    from sloframe.llm import search

    docs = spark.createDataFrame([(i, f"all {i} w{i % 7} w{i % 5}") for i in range(40)], "doc_id long, text string")
    made, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(plain(self, value)) or made[-1])
    found = search.search(search.build_index(docs, shard_bytes=100), docs, k=3, block_terms=50)
    assert len(made) > 2 and not any(b._jbroadcast.isValid() for b in made)
    assert found.count() == 120


@pytest.mark.parametrize("words", [1 << 21, 2])
def test_only_terms_that_queries_may_have_are_counted(spark, monkeypatch, words):
    """A filter without room lets more terms pass; the rows are the same."""
    from sloframe.llm import search

    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(50)) + f" all b{i % 50}") for i in range(200)] + [(300, None)], "doc_id long, text string").coalesce(2)
    counted, plain = [], search._document_counts
    monkeypatch.setattr(search, "FILTER_WORDS", words, raising=False)
    monkeypatch.setattr(search, "_document_counts", lambda *args: counted.extend(plain(*args).collect()) or plain(*args))
    found = search.search(search.build_index(docs, shard_bytes=5000), docs.where("doc_id % 100 = 0"), k=5).collect()
    assert sorted(r.df for r in counted)[-2:] == [4, 200] and (words == 2 or len(counted) < 500)
    assert {(r.query_id, r["rank"]): r.doc_id for r in found} == {(0, 1): 0, (0, 2): 50, (0, 3): 100, (0, 4): 150, (0, 5): 1, (100, 1): 100, (100, 2): 0, (100, 3): 50, (100, 4): 150, (100, 5): 1}


def test_queries_of_a_shard_are_scored_together(spark):
    """Terms are looked up once for all queries, and each query gets what a plain sum gives it."""
    import numpy as np

    from sloframe.llm import search

    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 60) % 3000)) for i in range(700)]
    row = search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shard_bytes=1 << 30).shards.first()
    shard, k = search.Shard(row.terms, row.starts, row.docs, row.counts, row.lengths, 60.0), 5
    table = np.zeros((len(shard.terms), shard.size))
    table[np.repeat(np.arange(len(shard.terms)), np.diff(shard.starts)), shard.docs] = shard.factor
    assert (shard.dense_row >= 0).sum() > 10
    chosen = [np.sort(r.choice(len(shard.terms), min(n, len(shard.terms)), replace=False)) for n in r.integers(0, 400, 150)]
    first, weights = np.append(0, np.cumsum([len(c) for c in chosen])), r.random(sum(map(len, chosen))) * 5
    unknown = np.append(shard.terms, np.uint64(3) if np.uint64(3) not in shard.terms else np.uint64(5))
    terms, used = np.unique(unknown, return_inverse=True)
    plain = [np.rint(weights[a:b, None] * table[c] * search.UNITS).sum(axis=0) for c, a, b in zip(chosen, first, first[1:], strict=False)]
    floors = np.array([np.sort(p)[-k] if i % 3 else 0.0 for i, p in enumerate(plain)])
    found = list(shard.tops(terms, used[np.concatenate(chosen)], first, weights, k, floors))
    assert len(found) == 150
    for p, (at, score) in zip(plain, found, strict=True):
        want = [i for i in np.lexsort((np.arange(len(p)), -p))[:k] if p[i] > 0]
        assert sorted(at) == sorted(want) and score.tolist() == p[at].tolist()
