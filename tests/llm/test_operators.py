"""Operators against brute-force versions, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sloframe.llm import bpe, brown, html, lines, minhash, mixing, quality, search, suffix, warc
from sloframe.llm.components import components
from sloframe.llm.runindex import RunIndex

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, anchor int, lost int, query_id int"
SHARED = "This is a passage of well over one hundred bytes that several documents hold word for word, and more words follow it."


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Straße", "été", "naïve", "日本", "😀"]
    make = lambda n: " ".join(r.choice(vocabulary, n))
    base = make(120)
    rows = [make(int(n)) for n in r.integers(1, 160, 30)]
    rows += [base, base, base.replace(base.split()[60], "changed", 1), base.upper(), base + " tail"]
    rows += [SHARED, make(40) + "\n" + SHARED + "\n" + make(20), SHARED + SHARED, make(10) + SHARED]
    rows += [None, "", " \t\n", "\n\n", "one", "one two three", "one two three", "a" * 450, "ab" * 300]
    rows += [f"Common line\n  common LINE \n{make(30)}\n\n{make(5)}" for _ in range(12)]
    rows += [make(20_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{min(i % 7, 3)}", len(t or ""), "x", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """The same with repeated and null ids."""
    rows = [(i, t, "en", "s", 0, None, 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(30, texts[30], None, None, None, None, None, None, None), (None, texts[30], "en", "s", 0, None, 1, 2, 3), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_line_dedup(docs, texts):
    keys = [[x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for t in texts]
    keys = [["".join(c.lower() if "A" <= c <= "Z" else c for c in k) for k in ks] for ks in keys]
    frequent = {k for k, n in Counter(k for ks in keys for k in set(ks)).items() if n >= 10 and k}
    got = table(lines.dedup_lines(docs))
    assert "common line" in frequent and len(got) == len(texts)
    for i, t in enumerate(texts):
        parts = (t or "").split("\n")
        kept = [x for x, k in zip(parts, keys[i], strict=True) if k not in frequent]
        assert (got[i].kept_text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(parts), len(parts) - len(kept))
    dropped = table(lines.drop_lines(docs))
    assert dropped[39].text is None and dropped[40].text == "" and dropped[50].text == got[50].kept_text
    assert dropped[50].lost == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5), (20, 4), (None, 3), (30, 29), (29, 28), (28, 27), (27, 26)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 10: 10, 11: 10, 26: 26, 27: 26, 28: 26, 29: 26, 30: 26}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_near(texts):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_minhash(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_near(dict(enumerate(texts)))
    assert got[33][1] == 30  # upper case is the same set
    assert sorted(r.doc_id for r in minhash.keep_representatives(docs).collect()) == sorted(i for i, v in got.items() if v[2])


def test_minhash_finds_links_beyond_the_first_of_a_bucket(spark):
    """A chain whose ends are far apart, and many loose variants of one text."""
    r = np.random.default_rng(5)
    base = [f"b{i}" for i in range(100)]
    texts = {}
    for i in range(60):
        w = list(base)
        for k in r.choice(100, int(r.integers(0, 9)), replace=False):
            w[k] = f"x{i}_{k}"
        texts[i] = " ".join(w)
    chain = [f"c{i}" for i in range(200)]
    for i in range(8):
        texts[100 + i] = " ".join(chain[i * 10: i * 10 + 120])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df).collect()}
    assert got == plain_near(texts)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_are_removed_as_by_comparing_all_strings(docs, texts, hot):
    out = suffix.kept_digest(suffix.remove_repeats(docs, hot=hot, shard_bytes=2000))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert got == suffix.remove_plainly({i: (t or "").encode() for i, t in enumerate(texts)})
    assert got[36][1] >= 100 and got[35][1] == 0


def test_repeats_across_parts_of_a_long_text(monkeypatch, spark):
    monkeypatch.setattr(suffix, "PART", 300)
    r = np.random.default_rng(9)
    text = "".join(r.choice(list("abcd \0é"), 700)) + SHARED
    data = {1: text + text[:400], 2: SHARED + text[100:600]}
    from sloframe.llm.textbatch import slices

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([data[1]])], ["text"])
    (s,) = slices(batch, "text")
    parts = suffix.Anchors(s)
    monkeypatch.setattr(suffix, "PART", 1 << 22)
    whole = suffix.Anchors(s)
    cover = lambda a: sorted(p for x, y in zip(a.first, a.last, strict=True) for p in range(x, y + 1))
    assert cover(parts) == cover(whole) == list(range(len(s.data) - 99))
    out = suffix.kept_digest(suffix.remove_repeats(spark.createDataFrame(list(data.items()), "doc_id long, text string")))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out.collect()}
    assert got == suffix.remove_plainly({k: v.encode() for k, v in data.items()})


def test_run_index_streams_matching_statistics():
    r = np.random.default_rng(1)
    for _ in range(20):
        base = r.integers(1, 5, r.integers(5, 150)).astype(np.uint8)
        text = np.concatenate([base, base[: len(base) // 2], r.integers(1, 5, 30).astype(np.uint8), base])
        patterns = np.stack([np.tile(text, 3)[a: a + 40] for a in r.integers(0, len(text), 6)])
        patterns[r.random(patterns.shape) < 0.1] = 3
        got, raw = RunIndex(text, 12).matching_statistics(patterns), text.tobytes()
        for a, p in enumerate(patterns):
            for i in range(40):
                longest = max(n for n in range(13) if n == 0 or i + n <= 40 and p[i: i + n].tobytes() in raw)
                assert got[a, i] == longest


def test_quality_counts_and_score(docs, texts):
    trusted = [i for i in range(0, 30, 2)]
    model = quality.ratio_model(docs, trusted)
    got = table(quality.judge_documents(docs, model))
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        grams = Counter(data[k: k + n] for n in quality.ORDERS for k in range(len(data) - n + 1))
        raw.update(grams)
        if i in trusted:
            target.update(grams)
    bucket = lambda g: ((int.from_bytes(g, "big") + len(g)) * 0x9E3779B1 % 2**32) >> 16
    shares = []
    for counts in (target, raw):
        total = np.ones(quality.BUCKETS)
        for g, n in counts.items():
            total[bucket(g)] += n
        shares.append(np.log(total / total.sum()))
    ratio = shares[0] - shares[1]
    for i, t in enumerate(texts):
        t, row = t or "", got[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k: k + 3])] > 1 for d in range(3)}
        solid = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(solid) - len(set(solid)), len(covered))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected, i
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        data = t.encode()
        grams = [ratio[bucket(data[k: k + n])] for n in quality.ORDERS for k in range(len(data) - n + 1)]
        score = sum(grams) / max(len(grams), 1)
        assert row.base_failed == failed and math.isclose(row.score, score, abs_tol=1e-5)
        assert row.kept == (not failed and row.score >= quality.THRESHOLD)
    kept = [r.doc_id for r in quality.keep_documents(docs, model).collect()]
    assert sorted(kept) == sorted(i for i, r in got.items() if r.kept)
    assert not quality.ratio_model(docs, []).ratios.any()


def test_bpe_agrees_with_the_library(docs, texts):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, digests = table(bpe.encode_documents(docs)), table(bpe.encode_documents(docs, digests=True))
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == (t or "")
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coder = bpe.Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, most=50)
    r = np.random.default_rng(2)
    odd_chars = [*"aAzZ09 '\t\n\r\x1c\x85\xa0 　éß日😀٣²́", "'s", "'ll", "the", "  ", "\n\n"]
    for _ in range(1500):
        t = "".join(r.choice(odd_chars, r.integers(0, 25)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode_ordinary(t), repr(t)


def test_transducer_forgets_and_refuses():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"aa": 259, b"aaaa": 260}
    machine = bpe.Transducer(ranks, max_states=2, max_pairs=2)
    for piece in (b"abcab", b"aaaaaaa", b"aabc", b"bcbcaab"):
        assert [machine.tokens[t] for t in machine.encode(piece)] == bpe.merged(piece, ranks)
    with pytest.raises(ValueError, match="cannot be encoded"):
        bpe.Transducer({b"a": 0}).encode(b"xy")


def test_utf8_decoder_streams():
    data = "aé日😀z".encode() + b"\xff\xe0\x80\xf4\x90x\xc3"
    for size in range(1, 6):
        decoder = bpe.Utf8Decoder()
        got = "".join(decoder.feed(data[i: i + size]) for i in range(0, len(data), size)) + decoder.close()
        assert got == data.decode("utf-8", "replace"), size


def test_brown_base_and_model(docs, texts):
    got = table(brown.score_documents(docs, share=0.002))
    tokens = {i: [*words_of(t), None] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        row = got[i]
        assert row.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(row.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert row.score < 0 and math.isfinite(row.score)


def test_brown_model_learns_word_order(spark):
    """Words of two kinds that alternate: the classes predict what a unigram cannot."""
    r = np.random.default_rng(4)
    rows = [(i, " ".join(x for _ in range(40) for x in (f"a{r.integers(20)}", f"b{r.integers(20)}"))) for i in range(200)]
    out = brown.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), share=0.001).filter("held_out").collect()
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_brown_classes_of_rare_words(spark):
    """Words far below the share have classes by their neighbours, not by their counts."""
    r = np.random.default_rng(6)
    rows = [(i, " ".join(w for _ in range(20) for w in ("x", f"a{r.integers(400)}", "y", f"b{r.integers(400)}"))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = brown.score_documents(df, share=0.01).filter("held_out").collect()
    # A count band of all 800 words gives -1.6 a token, a class of 400 at most -1.3.
    assert out and sum(r.score for r in out) > -1.45 * sum(r.n_tokens for r in out)
    blocks = brown.read_blocks(df, block_bytes=4000)
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    none = np.zeros(0, np.uint64)
    words = brown.cluster_rest(blocks, brown.Model(0, 0, none, np.zeros(0, np.int64), None)).collect()
    assert len({w.term for w in words}) == len(words) == sum(n > 1 for n in counts.values())


def test_search_is_exact(docs, texts):
    got = search.search(search.build_index(docs, shard_bytes=3000), docs.filter("doc_id % 7 = 0"), k=6, block_terms=3000).collect()
    words = {i: words_of(t) for i, t in enumerate(texts)}
    mean, df = sum(map(len, words.values())) / len(words), Counter(w for ws in words.values() for w in set(ws))
    expected = []
    for q in range(0, len(texts), 7):
        scores = []
        for d, ws in words.items():
            tf, units = Counter(ws), 0
            for w in set(words[q]) & set(ws):
                idf = math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
                units += round(idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) * 1e9)
            if units:
                scores.append((-units, d))
        expected += [(q, rank + 1, d, round(-u / 1e9, 6)) for rank, (u, d) in enumerate(sorted(scores)[:6])]
    assert [r[:3] for r in expected] == [tuple(r)[:3] for r in sorted(got, key=lambda r: (r.query_id, r.rank))]
    for e, g in zip(expected, sorted(got, key=lambda r: (r.query_id, r.rank)), strict=True):
        assert math.isclose(e[3], g.score, abs_tol=2e-6)


def test_mixing_meets_its_targets(docs, texts):
    """A budget that no cell has too few tokens for meets all targets; the usual one takes some
    cells whole."""
    rows = table(mixing.calibrated(docs, cycles=30, keep=0.05))
    assert set(rows) == set(range(len(texts)))
    for i, t in enumerate(texts):
        w = words_of(t)
        assert rows[i].tokens == len(w)
        if not w:
            assert rows[i].probability == 0 and not rows[i].kept
    total = sum(r.tokens for r in rows.values())
    expected = sum(r.tokens * r.probability for r in rows.values())
    assert math.isclose(expected, 0.05 * total, rel_tol=1e-6) and max(r.probability for r in rows.values()) < 1
    for d in mixing.DIMENSIONS:
        values = {r[d] for r in rows.values() if r.tokens}
        share = {v: (sum(r.tokens for r in rows.values() if r[d] == v) / total) ** 0.7 for v in values}
        for v in values:
            got = sum(r.tokens * r.probability for r in rows.values() if r[d] == v) / expected
            assert math.isclose(got, share[v] / sum(share.values()), abs_tol=1e-4), (d, v)
    usual = table(mixing.calibrated(docs, cycles=30))
    assert math.isclose(max(r.probability for r in usual.values()), 1)
    kept = sorted(r.doc_id for r in mixing.keep_mixed(docs, cycles=30).collect())
    assert kept == sorted(i for i, r in usual.items() if r.kept)


PAGES = "page_id long, url string, html string, digest string, first int"


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 60 + "</p>"
    rows = [(3, "http://a/\r\nx", long), (1, None, long), (2, "http://b", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "x" * 99), (7, "u", "x" * 99), (8, "v", "y" * 100), (9, "v", "y" * 100), (9, "v", "y" * 100), (None, "n", long)]
    archive = warc.write_archive(spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES), file_bytes=600)
    got = warc.read_records(archive, payload=True).collect()
    assert len(got) == len(rows) and archive.index.select("file").distinct().count() > 1
    for r in got:
        body = next((x[2] or "") for x in rows if x[0] == r.page_id)
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == hashlib.sha256(body.encode()).hexdigest()
        first = {1: None, 3: 1, 8: None, 9: 8, None: 1}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if first is None else ("revisit", first))
        assert r.payload == (body.encode() if first is None else None)
    some = warc.read_records(archive, archive.index.filter("id = '3' OR id = '8'"))
    assert sorted(r.page_id for r in some.collect()) == [3, 8]
    assert warc.read_records(archive, archive.index.filter("id = 'none'")).collect() == []


def test_ranges_are_coalesced():
    ranges = [("a", 0, 10), ("a", 12, 5), ("a", 40, 5), ("a", 45, 100), ("b", 0, 3)]
    assert list(warc.coalesced(ranges, 5, 50)) == [("a", 0, 17, [(0, 10), (12, 5)]), ("a", 40, 45, [(40, 5)]), ("a", 45, 145, [(45, 100)]), ("b", 0, 3, [(0, 3)])]


@pytest.fixture(scope="module")
def extractor(spark):
    r = np.random.default_rng(8)
    vocabulary = [f"{'abcdefgh'[i % 8]}ord{i}" for i in range(300)]
    pages = [(i, f"http://h/{i}", html.PageMaker(vocabulary, int(r.integers(10**6))).page(), 1) for i in range(60)]
    return html.fit_extractor(spark.createDataFrame(pages, "page_id long, url string, html string, text int"), made=500)


def test_html_extraction_on_new_layouts(spark, extractor):
    missed = extra = total = 0
    for k in range(150):
        dom = html.Dom(html.PageMaker([f"term{i}" for i in range(200)], 7_000_000 + k).page())
        kept = html.decode(dom, extractor.logit(html.features(dom)))
        for i, n in enumerate(dom.nodes[1:], 1):
            assert kept[n.parent] or not kept[i]  # nothing is kept below what is dropped
        for node, text, _ in dom.runs:
            truth = dom.nodes[node].label == 1
            total, missed, extra = total + len(text), missed + len(text) * (truth and not kept[node]), extra + len(text) * (kept[node] and not truth)
    assert missed / total < 0.03 and extra / total < 0.03


def test_html_extraction_of_a_page(spark, extractor):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
        "<!-- ad --><div class='ad'>Buy this now, it is cheap.</div><article><h1>A &amp; B</h1><p><b>First  paragraph of\n the story, which says something.<br>"
        "<p>Second &eacute; paragraph. It has two sentences, at least.</p></article><section class='comments'><div class='comment'><p>Nice story!</p></div></section>"
        "<footer>&copy; Someone &middot; All rights.</footer>"
    )
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "<nav><a href='/x'>Menu</a></nav>", 0), (5, "u", "<" * 50 + "&#x110000;<p", 0)]
    got = table(html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"), extractor), "page_id")
    assert got[1].text == "A & B\nFirst paragraph of the story, which says something.\nSecond é paragraph. It has two sentences, at least."
    assert got[1].n_chars == len(got[1].text) and got[1].url == "u" and got[2].url is None
    assert got[2].text == got[3].text == got[4].text == ""


def test_html_without_optional_tags(spark, extractor):
    """No text is lost to a head, or another hidden element, that is not closed."""
    runs = lambda page: [text for _, text, _ in html.Dom(page, labels=False).runs]
    assert runs("<html><head><title>T</title><meta charset=utf-8><article><h1>A</h1><p>Body text.</article></html>") == ["A", "Body text."]
    assert runs("<head><title>T</title>\n<script>var t='<p>';</script>\nText <p>B") == ["Text", "B"]
    assert runs("<head><noscript><img></noscript><style>p {}</style></head><body><p>B") == ["B"]
    for tag in ("button", "select", "object", "svg", "noscript"):
        assert runs(f"<article><div><{tag}>x</div><p>B</p></article><p>C") == ["B", "C"], tag
        assert runs(f"<body><{tag}>x<article><p>B</p></article></body>") == ["B"], tag
        assert runs(f"<div><{tag}>x<p>y</p><div>z</div></{tag}><p>B</p></div>") == ["B"], tag
        assert runs(f"<div><{tag}>x<{tag}>y</{tag}>z</{tag}><p>B</p></div>") == ["B"], tag
    page = "<html><head><title>T</title><article class=article><h1>A</h1><p data-label=Price>Body text, which is a sentence.<p>And there is another one.</article></html>"
    frame = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html.extract_main_text(frame, extractor).first().text == "A\nBody text, which is a sentence.\nAnd there is another one."
    assert html.fit_extractor(frame, made=20)


def test_repeated_and_null_ids(odd, texts):
    n = len(texts) + 3
    assert lines.dedup_lines(odd).count() == n
    near = minhash.near_duplicates(odd).collect()
    assert len(near) == n and all(r.component_id is None and r.kept for r in near if r.doc_id is None)
    assert {r.component_id for r in near if r.doc_id == 30} == {30}
    cut = suffix.remove_repeats(odd).collect()
    assert len(cut) == n and all(r.n_removed == 0 for r in cut if r.doc_id in (None, 30))
    assert bpe.encode_documents(odd).count() == brown.score_documents(odd).count() == n
    assert quality.judge_documents(odd, quality.ratio_model(odd, [1, 2, None])).count() == n
    mixed = mixing.calibrated(odd).collect()
    assert len(mixed) == n and len({r.kept for r in mixed if r.doc_id == 30}) == 1
    found = search.search(search.build_index(odd), odd.filter("doc_id = 30"), k=5).collect()
    assert [r.doc_id for r in found][:4].count(30) == 2


def test_empty_tables(docs, spark, extractor):
    none = docs.limit(0)
    assert lines.dedup_lines(none).collect() == lines.drop_lines(none).collect() == []
    assert minhash.near_duplicates(none).collect() == suffix.remove_repeats(none).collect() == []
    assert quality.judge_documents(none, quality.ratio_model(none, [])).collect() == []
    assert brown.score_documents(none).collect() == bpe.encode_documents(none).collect() == mixing.calibrated(none).collect() == []
    assert search.search(search.build_index(none), none).collect() == []
    pages = spark.createDataFrame([], PAGES)
    assert warc.read_records(warc.write_archive(pages)).collect() == []
    assert html.extract_main_text(pages, html.fit_extractor(pages, made=20)).collect() == []


def test_null_texts_only(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.n_lines, r.kept_text) for r in lines.dedup_lines(df, min_docs=1).collect()} == {(1, "")}
    assert all(r.kept for r in minhash.near_duplicates(df).collect())
    assert {r.n_bytes for r in suffix.remove_repeats(df).collect()} == {0}
    assert {r.n_tokens for r in brown.score_documents(df).collect()} == {1}
    frame = df.selectExpr("*", "CAST(NULL AS STRING) AS source", "CAST(NULL AS STRING) AS lang")
    assert {(r.source, r.probability) for r in mixing.calibrated(frame).collect()} == {("", 0.0)}
    assert search.search(search.build_index(df), df).collect() == []


def test_bpe_short_pieces_need_no_states_and_white_space_any_runs():
    import random

    import public_tokenizers as public

    coder = bpe.Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(" \n\t\r\x0b\x1c\x1f\x85 　 ab'séß1.,  \n\n") for _ in range(draw.randrange(14)))
        pieces = [p.encode() for p in coder.split(text)]
        want = [coder.ranks[t] for p in pieces for t in ([p] if p in coder.ranks else bpe.merged(p, coder.ranks))]
        raw = coder.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == want
        assert list(coder.decode_all([raw, b"", raw])) == [text.encode(), b"", text.encode()]
    assert len(coder.transducer.keys) == 1
    long = "ab" * 50 + "é" * 40
    assert bpe.merged_ids(long.encode(), coder.ranks) == coder.transducer.encode(long.encode())


def test_brown_releases_shuffle_files_between_steps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(brown, "release", lambda spark: seen.append(spark))
    rows = [(i, f"a b c{i % 3} d{i % 5} a b") for i in range(40)]
    assert brown.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40
    assert len(seen) >= 8  # after counts, bigrams, each sweep's matrix and words, and the classes


def test_bpe_pieces_go_through_the_transducer_and_the_incremental_decoder(monkeypatch):
    import random

    import public_tokenizers as public

    coder, fed = bpe.Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN), []
    text = "Queanan ofanéninor, nnieosta!? " * 3 + "日本😀" * 30
    pieces = [p.encode() for p in coder.split(text)]
    want = [coder.ranks[t] for p in pieces for t in ([p] if p in coder.ranks else bpe.merged(p, coder.ranks))]
    monkeypatch.setattr(bpe, "merged_ids", lambda *_: pytest.fail("merged past the transducer"))
    feed = bpe.Utf8Decoder.feed
    monkeypatch.setattr(bpe.Utf8Decoder, "feed", lambda self, data: fed.append(len(data)) or feed(self, data))
    raw = coder.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == want and len(coder.transducer.short) > 1
    assert list(coder.decode_all([raw, raw])) == list(coder.decode_all([raw, raw], most=8)) == [text.encode()] * 2
    assert sum(fed) == 4 * len(text.encode())

    ranks = {t: i for i, t in enumerate([b"a", b"b", b"c", b"d", b"ab", b"abc", b"bc", b"aa", b"aaaa", b"cd", b"da", b"bcd", b"abcda"])}
    draw = random.Random(4)
    for machine in (bpe.Transducer(ranks), bpe.Transducer(ranks, max_states=2, max_pairs=2)):
        for _ in range(3000):
            piece = bytes(draw.choice(b"aabcd") for _ in range(draw.randrange(1, 20)))
            assert machine.encode_short(piece) == [ranks[t] for t in bpe.merged(piece, ranks)]
        with pytest.raises(ValueError, match="cannot be encoded"):
            machine.encode_short(b"abx")
