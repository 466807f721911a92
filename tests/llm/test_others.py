"""Archives, pieces, vectors, pages and dialogues against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyarrow.fs import LocalFileSystem

from eventloom.llm import chat, main_text, neighbours, sentencepieces, token_counts, unigram, warc


@pytest.mark.parametrize("size", [7, 300, 5000, 10**7])
def test_every_record_belongs_to_one_range(tmp_path, size):
    rng = random.Random(size)
    data, starts = b"", []
    for i in range(60):
        page = rng.randbytes(rng.randint(0, 900)).hex() + warc.MAGIC.decode("latin1")
        starts.append(len(data))
        digest = hashlib.sha1(page.encode()).hexdigest()
        data += warc.record(i, "http://a/\n", page.encode(), digest, i - 1 if i % 5 == 0 else None)
    (tmp_path / "a.warc.gz").write_bytes(data + b"\x1f\x8b\x08 cut off")
    with LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")) as file:
        found = [
            at for s in range(0, len(data) + 20, size) for at, _ in warc.members(file, s, s + size)
        ]
    assert found == starts


def test_archives_of_odd_pages(spark, tmp_path):
    rows = [(1, "u", "x" * 2000), (2, None, "x" * 2000), (2, None, "x" * 2000), (3, "u", None),
            (None, "é\r\nA: b", "x" * 2000), (4, "u", "small"), (5, "u", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path / "out"))
    found = warc.read_archives(files, 100).select("record_type", "stated_bytes").collect()
    assert sorted(map(tuple, found)) == sorted(
        [("revisit", 2000)] * 2 + [("response", 2000)] * 2 + [("response", 0)]
        + [("response", 5)] * 2
    )
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "no"))).count() == 0


def brute_best(vocabulary, text):
    """Best score over all segmentations of a short text, and how many pieces it takes."""
    pieces = {p: s for p, _, s in vocabulary.usable()}
    best = {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        options = []
        for start in range(end):
            score, count = best[start]
            part = text[start:end]
            if part in pieces:
                options.append((score + pieces[part], -start, count + 1))
            elif len(part) == 1:
                unknown = vocabulary.unknown_score
                options.append((score + unknown, -start, count + len(part.encode())))
        top = max(options)
        best[end] = (top[0], top[2])
    return best[len(text)]


def test_pieces_are_the_best_path_and_go_back():
    vocabulary = unigram.read_vocabulary()
    codec, counter = sentencepieces._codecs(vocabulary)(), token_counts.Counter(vocabulary)
    rng = random.Random(4)
    texts = ["", " ", "  a  b ", "\n", "x€ 中文𒀀", "a\tb", " lead", "trail ", "the of the"]
    texts += ["".join(rng.choices("the anioé \n中", k=rng.randint(1, 25))) for _ in range(300)]
    for text in texts:
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        assert counter.count(text) == len(ids)
        if text:
            whole = (" " + text).replace(" ", unigram.MARKER)
            score, _ = brute_best(vocabulary, whole)
            own = sum(vocabulary.scores[i] for i in ids)
            bare = sum(vocabulary.unknown_score for c in whole if c not in vocabulary.pieces)
            assert own + bare == pytest.approx(score)
    assert codec.encode(None) == [] and counter.count(None) == 0


def test_words_solved_together_have_the_paths_of_single_ones():
    codec = sentencepieces._codecs(unigram.read_vocabulary())()
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choices("theanio.,é€中𒀀\n", k=rng.randint(0, 60))) for _ in range(3000)]
    assert list(codec.solve_all(words)) == [codec.solve(word) for word in words]


def test_answers_outlive_the_exchange_of_known_words(monkeypatch):
    monkeypatch.setattr(unigram, "KNOWN_WORDS", 3)
    monkeypatch.setattr(unigram, "SLICE_WORDS", 2)
    vocabulary = unigram.read_vocabulary()
    texts = ["the of and", None, "of the", "", "in a\nhouse of", "the of and"]
    counter = token_counts.Counter(vocabulary)
    assert list(counter.count_all(texts)) == [token_counts.Counter(vocabulary).count(t) for t in texts]


def test_pieces_in_spark(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b " * 50_000, 1), (3, "a b " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = sentencepieces.encode_documents(df).collect()
    assert [r.decoded for r in found] == [t or "" for _, t, _ in rows]
    counts = [r.n_tokens for r in token_counts.count_tokens(df).collect()]
    assert counts == [len(r.ids) for r in found]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    vectors = centres[rng.integers(0, 12, 3000)] + 0.1 * rng.normal(size=(3000, 8))
    vectors[:900] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(None, [1.0] * 8), (9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8),
           (9300, [1.0]), (9400, [None] * 8), (1, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = neighbours.search(df, lambda i: i % 100 == 0, parts=8, probes=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, queries = np.arange(3000), np.arange(0, 3000, 100)
    hits = 0
    for q, near, _ in neighbours.nearest(vectors, ids, vectors[queries], queries, 10):
        hits += len({i for i, _ in got[q]} & set(near.tolist()))
    assert set(got) == set(queries.tolist()) and hits >= 0.9 * 10 * len(queries)
    assert [i for i, _ in got[0]] == list(range(1, 11))
    assert neighbours.search(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_repeated_vectors_take_one_place(spark):
    rows = [(i % 50, [float((i % 50) ** 2), 1.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = neighbours.search(df, lambda i: i == 0, parts=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, float(i * i)) for i in range(1, 11)]


@pytest.mark.parametrize("part_chars, answer_bytes", [(1, 1), (5, 40), (60, 1 << 20)])
def test_long_texts_in_parts_have_the_same_pieces(monkeypatch, part_chars, answer_bytes):
    codec = sentencepieces._codecs(unigram.read_vocabulary())()
    counter = token_counts.Counter(unigram.read_vocabulary())
    rng = random.Random(part_chars)
    texts = ["", "   ", " a", "a ", None] + [
        "".join(rng.choices("the  anioé \n中" + unigram.MARKER, k=rng.randint(1, 300))) for _ in range(80)
    ]
    want = [codec.encode(t) for t in texts]
    monkeypatch.setattr(unigram, "PART_CHARS", part_chars)
    monkeypatch.setattr(unigram, "SLICE_WORDS", 7)
    monkeypatch.setattr(sentencepieces, "ANSWER_BYTES", answer_bytes)
    batch = pa.array(texts, pa.string())
    slices = list(sentencepieces._slices(batch))
    found = [sentencepieces._lists(*sentencepieces._encoded(codec, part)) for part in slices]
    assert pa.concat_arrays(found).to_pylist() == want
    ids = pa.array(want, pa.list_(pa.int32()))
    decoded = [
        sentencepieces._decoded(codec, p.offsets.to_numpy(), p.values.to_numpy())
        for p in sentencepieces._slices(ids)
    ]
    assert pa.concat_arrays(decoded).to_pylist() == [codec.decode(i) for i in want]
    assert list(counter.count_all(texts)) == [len(i) for i in want]


def test_lines_of_a_page():
    page = """<html><head><title>T</title><script>var a="</p><article>";</script></head><body>
    <nav><ul><li>Home</ul></nav><div class="cookie-notice"><div>We use</div></div>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>\n three<p class=ad>Buy
    <p>Four&nbsp;five<br>six<!-- <p>no --><div id="comments"><article>Reply</article></div>
    <form><input value="a>b">x</form>last</article><footer>&copy;</footer>"""
    assert main_text.page_blocks(page) == (
        ["Head & line", "One two three", "Four five six", "last"],
        True,
    )
    assert main_text.page_blocks("") == ([], False)


def test_common_lines_are_longest():
    rng = random.Random(8)
    for _ in range(300):
        a, b = (rng.choices(range(5), k=rng.randint(0, 12)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(table[i][j] + (x == y), table[i][j + 1], table[i + 1][j])
        found = main_text.common_lines(a, b)
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def test_unmarked_pages_lose_what_they_share(spark):
    story = lambda i: f"<div>Menu</div><p>Story {i} is told</p><p>in lines {i * i}</p>Imprint"
    rows = [(i, f"http://h/{i}", story(i)) for i in range(5)]
    rows += [(10, None, None), (11, "::", story(11)), (12, "http://one/", "<p>Alone")]
    rows += [(13, "http://c/1", story(13)), (14, "http://c/2", story(13))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_text(df).collect()}
    assert got[3] == "Story 3 is told\nin lines 9"
    assert (got[10], got[12]) == ("", "Alone")
    assert got[13] == got[14] == "Menu\nStory 13 is told\nin lines 169\nImprint"


def test_views_of_a_dialogue(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None),
            (1, 2, "bob", None), (1, 300, None, "late"), (None, 1, "ann", "lost"),
            (2, None, "ann", ""), (3, 1, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part, r.participant): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, 1, "unknown"), (None, None, "ann"),
                        (2, None, "ann")}
    ann = got[1, 0, "ann"]
    assert ann.n_turns == 3
    assert [ann.text[m.start : m.start + m.length] for m in ann.masks] == [
        "Hi < |im_end|><|im_end|>"
    ]
    assert "<|im_start|>user name=bob\n<|im_end|>" in ann.text
    assert chat.perspectives(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, lines", [
    ("<body><nav><a>Home</a><article><p>story</p></article></body></html>", ["story"]),
    ("<body><div class=ad>Buy<article><p>story</p></article></body>", ["story"]),
    ("<head><title>T</title><body><p>text</p></body>", ["text"]),
    ("<head><title>T</title><p>text", ["text"]),
    ("<article><p>one<ul><li>two<li class=share>Share</ul><p>three</article>",
     ["one", "two", "three"]),
    ("<article>one<table><tr><td class=ad>Buy</table>two</article>", ["one", "two"]),
])
def test_missing_end_tags_lose_no_text(page, lines):
    assert main_text.page_blocks(page)[0] == lines


def test_only_the_names_of_an_element_make_it_suspected():
    kinds = lambda page: dict(zip(*main_text.page_lines(page)))
    quoted = """<article><div style="overflow: hidden">one</div><p title="The hidden cost">two
        <p data-x='a class="ad"'>three</article>"""
    assert set(kinds(quoted).values()) == {main_text.ARTICLE}
    wrapped = '<form><div class="layout has-sidebar"><p class=ad>Buy<article>story</article></div></form>'
    assert kinds(wrapped) == {"Buy": main_text.SUSPECT, "story": main_text.ARTICLE}
    own = '<article><header class="entry-header"><h1>Head</h1></header>story</article>'
    assert kinds(own) == {"Head": main_text.SUSPECT_INSIDE, "story": main_text.ARTICLE}
    replies = "<main><article>story</article><div id=comments><article>reply</article></div></main>"
    assert main_text.page_blocks(replies) == (["story"], True)


def test_marked_pages_are_differenced_too(spark):
    story = lambda i: f"""<div>Menu</div><header class="entry-header">Head {i}</header>
        <article><p class="share-bar">Share it<p>Quoted<p class="reply">Own answer {i}</article>
        <footer>Imprint {i}</footer>"""  # noqa: E731
    cards = lambda i: f"""<div>Menu</div><div class=body>Story {i} in full</div>
        <article>Card {i}</article>"""  # noqa: E731
    rows = [(i, f"http://h/{i}", story(i)) for i in range(4)]
    rows += [(10 + i, f"http://k/{i}", cards(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_text(df).collect()}
    assert got[2] == "Quoted\nOwn answer 2"
    assert got[12] == "Story 2 in full\nCard 2"


def test_copies_and_short_articles_lose_menus(spark):
    menu = "<div>" + "</div><div>".join(f"Menu entry {i} of many" for i in range(30)) + "</div>"
    page = lambda text: f"{menu}<p>{text}<p>Imprint"
    rows = [(i, f"http://short/{i}", page(f"Short {i}")) for i in range(4)]
    rows += [(10 + i, f"http://copies/{i}", page("Copied story")) for i in range(3)]
    rows += [(20, "http://copies/x", page("Other story"))]
    rows += [(30 + i, f"http://near/a{i}", page("A near copy. " * 300 + f"<p>Date {i}")) for i in range(2)]
    rows += [(40, "http://near/z", page("Far"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_text(df).collect()}
    assert [got[i] for i in range(4)] == [f"Short {i}" for i in range(4)]
    assert [got[10 + i] for i in range(3)] == ["Copied story"] * 3
    assert got[20] == "Other story"
    for i in (30, 31):
        assert got[i].startswith("A near copy.") and "Menu" not in got[i]


def test_whole_dialogues_for_every_participant(spark):
    said = [(0, "system", "Be kind"), (5, "eve", "I only greet")]
    said += [(10**9 + 1000 * i, ("ann", "bob")[i % 2], f"turn {i} <|") for i in range(600)]
    said += [(2 * 10**9, "bob", "again"), (2 * 10**9, "bob", "again")]
    rows = [(1, *row) for row in said] + [(None, 3, "ann", "lost")] * 2 + [(2, 1, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.whole_views(df).collect()
    assert sorted((r.participant, r.part) for r in found if r.conv_id == 1) == [
        (who, part) for who in ("ann", "bob", "eve") for part in range(3)
    ]
    assert [r.text for r in found if r.conv_id != 1] == ["<|im_start|>assistant\nlost<|im_end|>\n"] * 2
    for who in ("ann", "bob", "eve"):
        parts = sorted((r for r in found if (r.conv_id, r.participant) == (1, who)), key=lambda r: r.part)
        text, own = "", []
        for _, role, what in said:
            name = "system" if role == "system" else "assistant" if role == who else f"user name={role}"
            text += f"<|im_start|>{name}\n"
            body = what.replace("<|", "< |") + "<|im_end|>"
            own += [(len(text), len(body))] * (role == who)
            text += body + "\n"
        assert "".join(r.text for r in parts) == text
        assert [tuple(m) for r in parts for m in r.masks] == own
        assert all(text[r.first_char :].startswith(r.text) for r in parts)
