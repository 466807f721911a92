"""The corpus pipeline as a whole against brute force, on a small folder of documents."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from eventloom.llm import line_dedup, ngram_join, quality, sentencepieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(900)]

    def prose(lines):
        return "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(lines))

    shared = "This line stands in several documents of the table."
    rows = [(i, prose(9), "abc"[i % 3]) for i in range(40)]
    rows += [(50 + i, prose(5) + "\n" + shared + "\n" + prose(4), "a") for i in range(6)]
    rows += [(60, rows[3][1], "b"), (61, rows[3][1].replace("\n", " ", 1), "b"), (62, rows[4][1] + " end.", "c")]
    rows += [(70, None, "a"), (71, "", None), (72, "too short", "a"), (73, prose(9), None)]
    return rows + [(7, rows[7][1], "b"), (8, prose(9), "c")]


def without_shared_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for doc, text, _ in rows:
        for line in text.split("\n"):
            held[key(line)].add(doc)
    keeps = lambda doc, line: len(key(line)) < 10 or doc == min(held[key(line)])
    return [(d, "\n".join(x for x in t.split("\n") if keeps(d, x)), s) for d, t, s in rows]


def one_of_each(rows):
    def shingles(text):
        w = WORD.findall(text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    distinct = sorted(set(rows))
    sets = [shingles(t) for _, t, _ in distinct]
    group = list(range(len(distinct)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [row for i, row in enumerate(distinct) if group[i] == i]


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(
        [(*row, "en", len(row[1] or "")) for row in fixture()],
        "doc_id long, text string, source string, lang string, n_chars long",
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = [(r.doc_id, r.text, r.source) for r in quality.keep_good(docs).collect()]
    assert {d for d, _, _ in good} >= set(range(40)) and not {70, 71, 72} & {d for d, _, _ in good}
    # What the first stage keeps goes through the others.
    kept = one_of_each(without_shared_lines(good))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {d: {t for e, t, _ in kept if e == d} for d, _, _ in kept}
    copies = Counter((r.doc_id, r.decoded) for r in found)
    assert all(text in texts.get(doc, ()) for doc, text in copies)
    assert all(n <= 3 for n in copies.values())
    assert all(r.n_pieces == len(r.ids) for r in found)
    # Whole shares stay near their targets: weights 1, 2, 3 and 1 for no source.
    size = lambda text: len(WORD.findall(text))
    own, taken = Counter(), Counter()
    for _, text, source in kept:
        own[source] += size(text)
    for r in found:
        taken[r.source] += size(r.decoded)
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    capped, left = {}, float(sum(own.values()))
    while True:
        free = [s for s in own if s not in capped]
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 3 * own[s]]
        if not over:
            break
        capped |= {s: 3.0 * own[s] for s in over}
        left = sum(own.values()) - sum(capped.values())
    target = capped | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
    longest = max(size(t) for _, t, _ in kept)
    for source, want in target.items():
        number = sum(1 for _, _, s in kept if s == source)
        assert abs(taken[source] - want) <= 3 * longest * max(1, number) ** 0.5
    assert [s for s, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece",
    ]


def test_an_empty_table_goes_through(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ngram_join_sends_texts_in_batches_of_bounded_bytes(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, write = spark.conf.get(key, None), [], ngram_join.stored

    def told(df, purpose):
        seen.append(df.sparkSession.conf.get(key))
        return write(df, purpose)

    monkeypatch.setattr(ngram_join, "stored", told)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    groups = ngram_join.similar_groups(docs).collect()
    assert sorted((r.doc, r.component) for r in groups) == [(1, 1), (2, 1)]
    assert seen and set(seen) == {ngram_join.BATCH_BYTES}
    assert spark.conf.get(key, None) == before


def test_pieces_are_made_in_batches_of_bounded_bytes(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, write = spark.conf.get(key, None), [], corpus_pipeline.stored

    def told(df, purpose):
        seen.append(df.sparkSession.conf.get(key))
        return write(df, purpose)

    monkeypatch.setattr(corpus_pipeline, "stored", told)
    docs = spark.createDataFrame([(1, "s", "a b"), (2, "s", None)], "doc_id long, source string, text string")
    found = corpus_pipeline.encoded(spark, docs, "").collect()
    assert sorted((r.doc_id, r.decoded) for r in found) == [(1, "a b"), (2, "")]
    assert seen == [ngram_join.BATCH_BYTES] and spark.conf.get(key, None) == before


def test_an_empty_line_index_needs_no_python(spark):
    index = line_dedup.LineIndex.empty(spark)
    for table in (index.refs, index.counts, index.filters):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("LocalRelation <empty>") and "RDD" not in plan
    assert index.counts.dtypes == [("key", "binary"), ("n_docs", "bigint"), ("owner", "bigint")]


def test_a_worker_keeps_no_words_between_tasks():
    vocabulary = sentencepieces.read_vocabulary()
    make = sentencepieces._codecs(vocabulary)
    encode = sentencepieces.round_trip(vocabulary).func
    found = next(parts := encode(iter([pa.array(["some words to keep", None])])))
    codec = make()
    assert codec.segments.known and found.field("decoded").to_pylist() == ["some words to keep", ""]
    assert not list(parts) and not codec.segments.known and not codec.segments.older
    assert make() is codec
