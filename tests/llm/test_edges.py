"""Repeated rows, null ids, contradictory labels: what the docstrings say of them."""

import collections

import public_tokenizers

from concord.llm import html, packing, quality, tokens

DOCS = "doc_id long, text string, length string, row string, salt long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in rows], DOCS)


def test_packing_of_equal_rows(spark, monkeypatch):
    """Rows that no hash tells apart are dealt to many groups and are all placed."""
    same = [(None, None)] * 400 + [(5, "one and the same text")] * 300 + [(i, "w " * 900) for i in range(40)]
    got = packing.pack(rows_of(spark, same), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 400, 5: 301, **{i: 1 for i in range(40) if i != 5}}
    by_seq = collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for items in by_seq.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= 4096


def test_labels_that_contradict_each_other_teach_nothing(spark):
    good, bad = "a calm and useful text about rivers ", "BUY!!! now $$$ win "
    d = rows_of(spark, [(i, (good if i % 2 else bad) * 5) for i in range(60)] + [(3, good * 5), (None, good), (None, None)])
    labels = [(i, i % 2) for i in range(60)]
    clean = spark.createDataFrame(labels, "doc_id long, quality int")
    mixed = spark.createDataFrame([*labels, *[(i, 1 - q) for i, q in labels]], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(d, mixed).collect()} == {0.5}
    got = quality.quality_scores(d, clean).collect()
    assert len(got) == 63 and sum(r.doc_id is None for r in got) == 2
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)


def test_pages_repeated_and_missing(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><p>A text of some length about the sea, and more of it.</p></article></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "u", "", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html.main_text(d).collect())
    assert got[1, "A text of some length about the sea, and more of it.", 52] == 2 and got[None, "", 0] == 1 and got[2, "", 0] == 1
    assert html.main_text(d.limit(0)).count() == 0


def test_counts_of_repeated_rows(spark):
    d = rows_of(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in tokens.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert got == [(0, 0), (0, 2), (1, 2), (1, 2)]
