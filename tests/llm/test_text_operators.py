"""Operators on single texts: token counts, extraction, packing, quality, language model."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from concord.llm import html, language_model, packing, pages, quality, tokens

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  a", "a  b", "a \n b", "<|endoftext|>x <|endoftext|>", "<|startoftext|>", "don't 'LL it's 's", "x" * 300, "日本語テキスト🙂 🙂", "a\n \nfoo", "tab\t\tx ", "　 a　", "123 456,789 !!!???", "-" * 500, "ÀÉî ß", "a\x1cb", "é ́x É", "ΣΑΣ İ", "１２３ 123", "end. "]
DOCS = "doc_id long, text string, junk array<int>, n_tokens string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, [1], "clash") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def test_token_counts(spark, corpus):
    t, every = Tokenizer.from_file(BYTES), ODD + corpus + [None]
    got = {r.doc_id: r for r in tokens.token_counts(docs(spark, every), BYTES).collect()}
    for i, x in enumerate(every):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 1024), repr(x)[:50]


def test_every_prefix(corpus):
    t, c, rng = Tokenizer.from_file(BYTES), tokens.PrefixCounter(BYTES), random.Random(1)
    for x in ODD + corpus[:30]:
        table = c.table(x)
        for k in {rng.randint(0, len(x)) for _ in range(25)}:
            assert c.prefix_count(x, k, table) == len(t.encode(x[:k], add_special_tokens=False).ids), repr(x[:k][-20:])


def test_prefixes_of_a_piece():
    t, c = Tokenizer.from_file(BYTES), tokens.PrefixCounter(BYTES)
    for word in (" unbelievably", "antidisestablishmentarianism", " aaaaaaaaaaaaaaa"):
        assert c.piece(word.encode()) == [len(t.encode(word[: i + 1], add_special_tokens=False).ids) for i in range(len(word))]


def test_long_pieces_keep_nothing():
    t, c, rng = Tokenizer.from_file(BYTES), tokens.PrefixCounter(BYTES), random.Random(3)
    mixed = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé語") for _ in range(4000))
    for word in ("a" * 4000, "-" * 4000, mixed):
        assert c.count(word) == len(t.encode(word, add_special_tokens=False).ids)
    assert sum(map(len, c.states)) < 100_000  # was about half the square of each length
    assert c.piece(mixed[:300].encode())[-1] == len(t.encode(mixed[:300], add_special_tokens=False).ids)


def test_long_words_are_read_in_whole():
    s = quality.Settings()
    middle = "a" * 30 + "".join(map(chr, range(0x4E00, 0x4E00 + 200))) + "b" * 30
    assert len(quality.word_buckets(middle, s)) == len(middle) + 2  # n-grams of <word>, and two more
    scorer = quality.Scorer({"score": np.arange(s.buckets, dtype=np.float32), "bias": np.zeros(1)}, s)
    b = quality.word_buckets(middle, s)
    buckets, weights = quality.document_features(middle, s)
    assert set(b) == set(buckets.tolist()) and weights.sum() == pytest.approx(1 / 3 / 2)
    assert scorer.batch([middle])[0] == pytest.approx(1 / (1 + math.exp(-min(40, np.mean(b) / 3 / 2))))


def test_a_change_anywhere_changes_the_features():
    """100,000 signs without a blank, and Chinese text: another middle gives other features."""
    s = quality.Settings()
    rng = random.Random(6)
    for long in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for i in range(100_000)), "".join(chr(0x4E00 + rng.randrange(9000)) for i in range(5000))):
        other = long[:50_000] + "XYZ" + long[50_003:] if len(long) > 50_000 else long[:2500] + "XYZ" + long[2503:]
        one, two = (dict(zip(*(x.tolist() for x in quality.document_features(t, s)))) for t in (long, other))
        assert one != two and len(one) > 500


def test_scores_are_those_of_the_features(corpus):
    s, rng = quality.Settings(), np.random.default_rng(4)
    model = {"score": rng.normal(size=s.buckets), "bias": np.array([0.3])}
    texts = [*corpus[:60], "", "a a a b", "x" * 5000, "one"]
    want = []
    for t in texts:
        b, w = quality.document_features(t, s)
        want.append(1 / (1 + math.exp(-(0.3 + float((model["score"][b] * w).sum())))))
    assert np.allclose(quality.Scorer(model, s).batch(texts), want, atol=1e-6)


def test_long_runs_count_in_little_memory():
    """A megabyte of one sign is one piece: counted like the library does, within 200 MB."""
    import resource

    t, c = Tokenizer.from_file(BYTES), tokens.PrefixCounter(BYTES)
    for sign in ("a", " ", "-"):
        n = len(t.encode(sign * 1_000_000, add_special_tokens=False).ids)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        assert c.count(sign * 1_000_000) == n
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_where_a_text_fits(spark, corpus):
    t = Tokenizer.from_file(BYTES)
    size = lambda x: len(t.encode(x.decode(), add_special_tokens=False).ids)
    every = ODD + corpus[:60]
    for r in tokens.token_counts(docs(spark, every), BYTES, limit=20).collect():
        data = every[r.doc_id].encode()
        assert r.fit_bytes == len(data) if r.n_tokens <= 20 else size(data[: r.fit_bytes]) <= 20
        if r.n_tokens > 20 and "  " not in every[r.doc_id] and len(data) > 1000:
            nxt = data.index(b" ", r.fit_bytes + 1) if b" " in data[r.fit_bytes + 1 :] else len(data)
            assert size(data[:nxt]) > 20


def test_token_counts_of_nothing(spark):
    d = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokens.token_counts(d, BYTES).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert tokens.token_counts(d.limit(0), BYTES).count() == 0


def check_plan(counts, capacity):
    seqs, seen = collections.defaultdict(list), set()
    for size, first, n, each, seq, off in packing.plan(counts, capacity):
        for r in range(first, first + n):
            seqs[seq + (r - first) // each].append((off + (r - first) % each * size, size))
            seen.add((size, r))
    assert len(seen) == sum(counts.values())
    for items in seqs.values():
        at = 0
        for off, size in sorted(items):
            assert off == at
            at += size
        assert at <= capacity
    return len(seqs)


def fewest(sizes, capacity):
    """Brute force for a few items."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(sizes):
            return
        if i == len(sizes):
            best = min(best, len(bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_plans():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100, 4096])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        check_plan(dict(collections.Counter(sizes)), capacity)
    for _ in range(60):
        large = [rng.randint(11, 30) for _ in range(rng.randint(1, 8))]  # over a third of 30: the matching is optimal
        assert check_plan(dict(collections.Counter(large)), 30) == fewest(sorted(large, reverse=True), 30)
        mixed = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        assert check_plan(dict(collections.Counter(mixed)), 30) <= fewest(sorted(mixed, reverse=True), 30) + 1


def test_packing(spark, corpus):
    t = Tokenizer.from_file(WORDS)
    every = ODD + corpus + [None, "long " * 9000, corpus[0], corpus[0]]
    rows = packing.pack(docs(spark, every), WORDS).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in enumerate(every):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = np.array(ids[r.start : r.start + 4096], "<u4")
            assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(part), zlib.crc32(part.tobytes()))
    for items in by_seq.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= 4096
    assert len(by_seq) <= math.ceil(sum(r.length for r in rows) / 4096) * 1.03 + 1
    assert packing.pack(docs(spark, []), WORDS).count() == 0


def test_word_ids_of_every_character():
    """Every assigned character below U+30000, alone and with marks that combine with it in other orders."""
    import unicodedata

    t, own = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    signs = [c for c in map(chr, range(1, 0x30000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    rare = [c for c in signs if unicodedata.category(c) not in ("Lo", "So")]
    texts = [f"a{c}b" for c in signs] + [f"a{c}{m}b" for c in rare for m in "\u0301\u0327\u0331\u0345"]
    texts += ["a\u0124\u0331b", "a\u0130\u0327b", "a\u0386\u0345b", "a\u03aa\u0301b"]
    want = t.encode_batch(texts, add_special_tokens=False)
    assert [x for x, w, g in zip(texts, want, own.batch(texts)) if w.ids != g.tolist()] == []


def test_extraction_of_labelled_pages():
    model = html.train(pages.labelled_pages(300), rounds=8)
    model = html.Model(model.unary, model.pair.tolist())
    wrong = n = 0
    for nodes, y in pages.labelled_pages(120, seed=77):
        content, _ = html.marginals(nodes, [sum(model.unary.get(x, 0) for x in f) for f in html.features(nodes)], model.pair)
        own = [i for i, x in enumerate(nodes) if x.chars]
        n += len(own)
        wrong += sum((content[i] >= 0.5) != y[i] for i in own)
    assert wrong / n < 0.03


def test_marginals_are_exact():
    rng = random.Random(3)
    nodes = [html.Node("html", -1), html.Node("body", 0), html.Node("div", 1), html.Node("p", 2), html.Node("p", 2), html.Node("nav", 1)]
    score = [rng.uniform(-2, 2) for _ in nodes]
    pair = np.random.default_rng(1).normal(size=(html.OTHER + 1, html.OTHER + 1, 4)).tolist()
    total, on = 0.0, [0.0] * len(nodes)
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        e = sum(s for s, v in zip(score, y) if v)
        for i in range(1, len(nodes)):
            a, b = html.edge_kind(nodes, i)
            e += pair[a][b][2 * y[nodes[i].parent] + y[i]]
        total += math.exp(e)
        for i, v in enumerate(y):
            on[i] += v * math.exp(e)
    got, _ = html.marginals(nodes, score, pair)
    assert np.allclose(got, np.array(on) / total)


def test_main_text(spark, sf):
    import html as std

    real = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    story = lambda h: re.search(r"<article>(.*?)</article>", h, re.S)[1]
    plain = lambda h: " ".join(std.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", story(h)))).split())
    odd = ["", None, "only text", "<p>One<p>Two &amp; 3&nbsp;4", "<div id='cookie-banner'>We use</div><main><h1>T</h1><p>He<b>ll</b>o</p><form><p>Sign</p></form></main><footer>x</footer>", "<div><p>unclosed " + "word " * 20_000]
    rows = [(r.page_id, r.url, r.html, 1) for r in real] + [(-1 - i, None, h, 1) for i, h in enumerate(odd)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for r in real:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert [got[-1 - i].text for i in range(5)] == ["", "", "only text", "One Two & 3 4", "T Hello"]
    assert got[-6].text.count("word") == 20_000


def test_quality(spark, sf):
    d, y = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_scores(d, y).collect()}
    assert len(got) == d.count()
    known = {r.doc_id: r.quality for r in y.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert np.mean([got[i].predicted == q for i, q in known.items()]) > 0.95
    assert all(got[i].held_out for i in known)
    extra = spark.createDataFrame([(None, None), (1, ""), (2, "w" * 100_000)], "doc_id long, text string")
    rows = quality.quality_scores(extra, y.limit(0)).collect()
    assert [r.score for r in rows] == [0.5] * 3 and quality.quality_scores(extra.limit(0), y.limit(0)).count() == 0


def test_language_model(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame([(None, None), (10**7, "A  \x0b b c"), (10**7, "A  \x0b b c")], "doc_id long, text string"))
    every = [(r.doc_id, r.text) for r in d.collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = collections.Counter(w for i, t in every if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    rows = language_model.language_scores(d, language_model.Settings(frequent=300)).collect()
    assert len(rows) == len(every)
    want = collections.Counter((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 5)) for i, t in every)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert language_model.language_scores(d.limit(0)).count() == 0


def test_model_probabilities_add_up():
    s = language_model.Settings()
    rng = np.random.default_rng(0)
    w = rng.normal(0, 1, s.features * s.classes + (1 + s.units) * s.classes * s.inside).astype(np.float32)
    first = rng.integers(0, s.units, 2)
    hashes = rng.integers(0, 2**63, 3).astype(np.uint64)
    total = sum(10 ** language_model.log_probability(np.array([*first, u]), hashes, np.array([3]), w, s)[2] for u in range(s.units))
    assert abs(total - 1) < 1e-4
