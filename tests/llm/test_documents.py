"""The document operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from eventloom.llm import line_dedup, mixing, ngram_join, quality

SCHEMA = "doc_id long, text string, source string, row string, doc int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """With two extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)


ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, "one two", "a"),
    (3, "one two", "a"),
    (None, "no id here but seven words long", None),
    (None, None, None),
    (4, " ".join(f"w{i}" for i in range(30_000)), "b"),
]


def brute_repeats(words):
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)})


def test_repeated_words_match_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 60))) for _ in range(200)]
    df = table(spark, [(i, t, "s") for i, t in enumerate(texts)] + ODD)
    for r in quality.text_statistics(df).select("text", "n_words", "n_repeat_words").collect():
        words = WORD.findall(r.text or "")
        assert (r.n_words, r.n_repeat_words) == (len(words), brute_repeats(words))


def test_rule_order_changes_no_verdict(spark):
    df = table(spark, [(i, ("word " * 3 + f"n{i} ## ") * (i % 40), "s") for i in range(80)] + ODD)
    kept = [
        sorted(r.doc_id or 0 for r in quality.keep_good(df, rules).select("doc_id").collect())
        for rules in (quality.RULES, quality.RULES[::-1])
    ]
    assert kept[0] == kept[1]
    assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(df.limit(0)).count() == 0


def brute_lines(docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = defaultdict(set)
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    return {
        doc: "\n".join(
            line
            for line in (text or "").split("\n")
            if len(holders[key(line)]) < 2 or min(holders[key(line)]) == doc
        )
        for doc, text in docs.items()
    }


def kept_lines(index, df):
    return {r[0]: r[1] for r in index.deduplicate(df).select("row.doc_id", "kept").collect()}


def test_line_index_is_reversible(spark):
    rng = random.Random(2)
    some = [f"Shared line number {i}" for i in range(30)] + ["short", "", "  SHARED LINE NUMBER 3 "]
    docs = {i: "\n".join(rng.choices(some, k=rng.randint(0, 12))) for i in range(40)}
    docs[50] = None
    frame = lambda d: table(spark, [(i, t, "s") for i, t in d.items()])
    first = {i: t for i, t in docs.items() if i < 20}
    later = {i: t for i, t in docs.items() if i >= 20}
    index = line_dedup.LineIndex.empty(spark, shards=3).insert(frame(first)).insert(frame(later))
    assert kept_lines(index, frame(docs)) == brute_lines(docs)
    gone = index.delete(frame(first).select("doc_id"))
    assert kept_lines(gone, frame(later)) == brute_lines(later)
    assert kept_lines(gone.insert(frame(first)), frame(docs)) == brute_lines(docs)
    assert line_dedup.deduplicate_lines(table(spark, ODD)).count() == len(ODD)


def test_cuckoo_filter_forgets_what_is_deleted():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(40_000)]
    filter_ = line_dedup.CuckooFilter(buckets=1 << 10)
    filter_.insert(keys)
    filter_ = line_dedup.CuckooFilter(filter_.data(), buckets=1 << 10)

    def held(some):
        prints, first, second = filter_.places(some)
        tables = filter_.tables()
        return [
            any(p in t[a] or p in t[b] for t in tables) for p, a, b in zip(prints, first, second)
        ]

    assert len(filter_.blocks) > 1 and all(held(keys[:500]))
    filter_.delete(keys)
    assert not any(held(keys[:500]))


def brute_groups(docs):
    def shingles(text):
        words = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a] | sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("short", [2, 32])
def test_similar_groups_match_brute_force(spark, monkeypatch, short):
    """Small limits send the same data through the search among long lists."""
    rng = random.Random(short)
    passage = " ".join(f"p{i}" for i in range(50))
    docs, doc = {}, 0
    for _ in range(4):
        base = [f"v{rng.randint(0, 900)}" for _ in range(60)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(60)] = f"x{rng.randint(0, 9000)}"
            docs[doc] = " ".join(words)
            doc += 1
    for _ in range(15):
        docs[doc] = passage + "".join(f" y{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 9)))
        doc += 1
    docs |= {100: None, 101: "", 102: "a B", 103: "A b", 104: docs[0].upper(), 105: " \t"}
    monkeypatch.setattr(ngram_join, "SHORT", short)
    postings = ngram_join._shares
    monkeypatch.setattr(ngram_join, "_shares", _with_limit(postings, short))
    found = ngram_join.similar_groups(table(spark, [(i, t, "s") for i, t in docs.items()]))
    assert {r.doc: (r.n, r.component) for r in found.collect()} == brute_groups(docs)


def brute_groups_of_rows(rows):
    """Of rows (id, text), of which those with one id belong together."""
    found = brute_groups({k: text for k, (_, text) in enumerate(rows)})
    smallest, before = [doc for doc, _ in rows], None
    while smallest != before:
        before, least = smallest, {}
        names = [(("id", doc), ("part", found[k][1])) for k, (doc, _) in enumerate(rows)]
        for k, both in enumerate(names):
            for name in both:
                least[name] = min(least.get(name, before[k]), before[k])
        smallest = [min(least[name] for name in both) for both in names]
    return Counter((doc, found[k][0], smallest[k]) for k, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("short", [2, 32])
def test_texts_that_share_an_id_keep_their_links(spark, monkeypatch, short):
    rng = random.Random(40 + short)
    words = lambda n: [f"v{rng.randint(0, 90_000)}" for _ in range(n)]

    def near(text):
        changed = text.split(" ")
        changed[rng.randrange(len(changed))] = "other"
        return " ".join(changed)

    few = [" ".join(words(60)) for _ in range(12)]
    many = [" ".join(words(1000)) for _ in range(6)]
    # An id with a short and a long text, other ids with a near copy of either.
    rows = [(10 * i, few[i]) for i in range(6)] + [(10 * i, many[i]) for i in range(6)]
    rows += [(10 * i + 1, near(few[i])) for i in range(6)] + [(10 * i + 2, near(many[i])) for i in range(3)]
    # A chain of ids by shared texts, an empty text beside another, repeated rows.
    rows += [(90, few[6]), (90, few[7]), (80, few[7]), (80, few[8]), (95, near(few[8])), (95, None)]
    rows += [(70, few[9]), (70, ""), (70, few[9]), (60, "one two"), (61, "One Two"), (61, near(few[10]))]
    rows += [(200 + i, near(few[10])) for i in range(8)] + [(300, few[11]), (300, few[11])]
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "_shares", _with_limit(ngram_join._shares, short))
    found = ngram_join.similar_groups(table(spark, [(i, t, "s") for i, t in rows])).collect()
    assert Counter((r.doc, r.n, r.component) for r in found) == brute_groups_of_rows(rows)


def _with_limit(function, short):
    """The tasks run in processes of their own; the limit goes along."""

    def run(batches):
        ngram_join.SHORT = short
        yield from function(batches)

    return run


def test_one_of_each_keeps_rows_without_id(spark):
    left = ngram_join.one_of_each(table(spark, ODD))
    assert left.columns == table(spark, ODD).columns
    assert Counter(r.doc_id for r in left.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, None: 2}
    assert ngram_join.one_of_each(table(spark, ODD).limit(0)).count() == 0


def test_mixing_reaches_targets(spark):
    rows = [(i, "w " * (i % 17 + 1), "abcdé"[i % 5] if i % 7 else None) for i in range(3000)]
    rows += [(i + 5000, "w " * 3, "big") for i in range(3000)]
    plan = mixing.plan_copies(table(spark, rows)).collect()
    size, target, taken = Counter(), {}, Counter()
    for r in plan:
        size[r.row.source] += r.size
        target[r.row.source] = r.target
        taken[r.row.source] += r.size * r.copies
        assert 0 <= r.copies <= 3
    weights = dict(zip(sorted(s for s in size if s is not None) + [None], [1, 2, 3] * 3))
    share, open_ = {}, set(size)
    while open_:
        rest = sum(size.values()) - sum(share.values())
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * rest / weight > 3 * size[s]}
        if not full:
            share |= {s: weights[s] * rest / weight for s in open_}
            break
        share |= {s: 3 * size[s] for s in full}
        open_ -= full
    for s in size:
        assert target[s] == pytest.approx(share[s])
        assert taken[s] == pytest.approx(target[s], rel=0.1)
    again = mixing.mix(table(spark, rows))
    assert again.count() == sum(r.copies for r in plan)
    assert mixing.plan_copies(table(spark, ODD)).count() == len(ODD)
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0


def test_one_of_each_loses_no_text_to_a_shared_id(spark):
    long_text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long_text), (2, long_text + " x"), (2, "quite another text of seven words"),
            (2, "quite another text of seven words"), (2, None), (3, "one more text that nobody else has")]
    left = ngram_join.one_of_each(table(spark, [(*r, "s") for r in rows]))
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [
        (1, long_text), (2, ""), (2, "quite another text of seven words"),
        (3, "one more text that nobody else has"),
    ]
