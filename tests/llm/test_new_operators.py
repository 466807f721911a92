"""Fingerprints, prefix tries and hard negatives against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import fingerprints, hard_negatives, prefix_trie
from eventloom.llm.registry import ORACLE_SQL, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fingerprints", "op12_prefix_trie", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE_SQL[name]) is None


# ------------------------------------------------------------------- fingerprints


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    codes = [zlib.crc32(w.encode()) >> 4 for w in words]
    if not codes:
        return []
    k, w, p, b = 5, 4, 2**31 - 1, 1_000_003
    grams = [codes[i : i + k] for i in range(max(1, len(codes) - k + 1))]
    hashes = []
    for gram in grams:
        total = 0
        for code in gram:
            total = (total * b + code) % p
        hashes.append(total)
    chosen = set()
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        chosen.add(i + max(j for j, h in enumerate(window) if h == min(window)))
    return [(hashes[i], i) for i in sorted(chosen)]


ODD_TEXTS = [
    None, "", " \n\t ", "one", "a b c d", "a b c d e", "same " * 40, "x" * 15, "x" * 16, "x" * 33,
    "a 😀 é \x0b b\x00c   d", "\n".join("l" * (i % 40) for i in range(300)),
    " ".join(f"w{i % 977}" for i in range(30_000)), "y" * 200_000 + " z " + "u" * 70_001, "same " * 40,
]


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(4)
    texts = ODD_TEXTS + [" ".join(rng.choices("abcd", k=rng.randint(0, 90))) for _ in range(150)]
    docs = spark.createDataFrame(
        [(i, t, "x", 7) for i, t in enumerate(texts)], "id long, body string, row string, codes int"
    )
    found = {
        r.row.id: [(e.hash, e["at"]) for e in r.fingerprint]
        for r in fingerprints.fingerprints(docs, "body").collect()
    }
    assert found == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert fingerprints.fingerprints(docs.limit(0), "body").count() == 0


def test_shared_passages_leave_a_common_fingerprint():
    rng = random.Random(2)
    passage = [str(rng.randrange(10**9)) for _ in range(fingerprints.GUARANTEED_WORDS)]
    for _ in range(50):
        sides = [[str(rng.randrange(10**9)) for _ in range(rng.randint(0, 30))] for _ in range(4)]
        a, b = (" ".join(x + passage + y) for x, y in (sides[:2], sides[2:]))
        marks = [{h: i for h, i in brute_fingerprint(t)} for t in (a, b)]
        common = marks[0].keys() & marks[1].keys()
        assert any(marks[0][h] - len(sides[0]) == marks[1][h] - len(sides[2]) for h in common)


@pytest.mark.parametrize("ids", [list(range(60)), [5], [3, 3, 3, None, None, -7, 0], []])
def test_next_documents(spark, ids):
    rng = random.Random(8)
    rows = [(d, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for d in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = fingerprints.followed(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in found) == sorted(
        (d is None, d or 0, t) for d, t in rows
    )
    for r in found:
        assert set(r.hashes) == {h for h, _ in brute_fingerprint(r.text)}
        assert set(r.next_hashes) == {h for h, _ in brute_fingerprint(r.next_text)}
    if len(set(ids)) == len(ids) > 0:
        order = sorted(rows, reverse=True)
        after = {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)}
        assert {r.doc_id: r.next_text for r in found} == after
    else:  # every text follows one row
        assert sorted(r.next_text for r in found) == sorted(t for _, t in rows)


# -------------------------------------------------------------------- prefix trie


def brute_trie(sequences):
    """{(row of turns): ...} for {conv_id: [(role, text), ...]}."""
    members = defaultdict(set)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in held if len(sequences[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not kids[n] for n in below)
        out.append(
            (min(held), len(node), parent, len(held), len(kids[node]), leaves, saved, sha)
        )
    return sorted(out, key=str)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed, run_turns", [(1, 1), (2, 7), (3, 60), (4, 1 << 17)])
def test_trie_matches_brute_force(spark, seed, run_turns, monkeypatch):
    rng = random.Random(seed)
    numbers = {
        c: [rng.choice([-5, 0, 3, 1 << 40]) for _ in range(rng.choice([0, 1, 2, 3, 4, 9]))]
        for c in range(-20, 180)
    }
    numbers |= {c: [3, 3, 3] for c in range(200, 320)}
    size = {-5: 2, 0: 0, 3: 5, 1 << 40: 1}
    turns = {c: [(n, "x" * size[n]) for n in row] for c, row in numbers.items()}
    df = spark.createDataFrame(
        [(c, row, [size[n] for n in row]) for c, row in numbers.items()]
        + [(0, numbers[0], [size[n] for n in numbers[0]])],
        "conv_id long, numbers array<long>, sizes array<long>",
    )
    # Runs of a turn or so, so that nearly all nodes lie at a border.
    monkeypatch.setattr(prefix_trie, "RUN_TURNS", run_turns)
    monkeypatch.setattr(prefix_trie, "IDS_TOGETHER", 5)
    prefix_trie_here = prefix_trie.prefix_trie(df)
    assert rows_of(prefix_trie_here) == brute_trie(turns)


@pytest.mark.parametrize("run_turns", [0, 3, 20, 10**6])
def test_runs_add_up(run_turns):
    """Borders between runs without Spark: parts of equal keys merge into the whole."""
    rng = random.Random(run_turns)
    rows = sorted({tuple(rng.choices([1, 2, 3], k=rng.choice([0, 1, 3, 5, 8]))) for _ in range(120)})
    table = [(list(r), [4] * len(r), 1, i, f"{i:x}") for i, r in enumerate(rows)]
    runs, held = [], []
    for row in table:
        if held and sum(len(r[0]) + 1 for r in held) + len(row[0]) > run_turns:
            runs.append(held)
            held = []
        held.append(row)
    runs.append(held)
    merged = {}
    for k, run in enumerate(runs):
        before = runs[k - 1][-1][0] if k else None
        after = runs[k + 1][0][0] if k + 1 < len(runs) else None
        for node in prefix_trie.run_nodes(k, run, before, after):
            name = node[1] or (k, len(merged))
            old = merged.setdefault(name, [node[3], node[4], 0, 0, 0, 0, None])
            old[1] = min(old[1], node[4])
            for at in range(4):
                old[2 + at] += node[6 + at]
            old[6] = old[6] or node[10]
    sequences = {i: [(n, "xxxx") for n in r] for i, r in enumerate(rows)}
    want = [(r[0], r[1], r[3], r[4], r[5], r[6]) for r in brute_trie(sequences)]
    assert sorted((m[1], m[0], *m[2:6]) for m in merged.values()) == sorted(want)


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [
        (1, None, "user", None), (1, 0, None, "a"), (1, 0, "b", "a"), (1, 0, "b", "a"),
        (2, None, "user", ""), (2, 5, "", "a"), (None, 1, "user", "no id"), (3, 2, "user", "é"),
        (4, 1, "us", "erx"), (5, 1, "user", "x"), (6, 1, "user", "long " * 50_000),
    ]
    schema = "c long, t long, role string, text string, numbers int, key string"
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], schema)
    turns = {
        1: [("user", ""), ("", "a"), ("b", "a"), ("b", "a")],
        2: [("user", ""), ("", "a")],
        3: [("user", "é")], 4: [("us", "erx")], 5: [("user", "x")], 6: [("user", "long " * 50_000)],
    }
    assert rows_of(prefix_trie.conversation_trie(df, "c", "t", "role", "text")) == brute_trie(turns)
    assert prefix_trie.conversation_trie(df.limit(0), "c", "t").count() == 0


def test_medians_keep_the_tree_shallow():
    tree = prefix_trie.TernaryTree()
    for at in prefix_trie.medians(1023):
        tree.insert([at], [1])
    level = {tree.equal[0]: 1}
    for node in range(1, 1024):
        for child in (tree.lower[node], tree.higher[node]):
            if child:
                level[child] = level[node] + 1
    assert max(level.values()) == 10


# ----------------------------------------------------------------- hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    """Rows (id, vector, label) that take part, each id once."""
    out = []
    whole = {i: [int((256.0 * x) // 1) for x in v] for i, v, _ in rows}
    label = {i: lab for i, _, lab in rows}
    for anchor in sorted(i for i in whole if i % 100 == 0):
        order = sorted(
            (-sum(a * b for a, b in zip(whole[anchor], whole[i])), i) for i in whole if i != anchor
        )
        for score, positive in [o for o in order if label[o[1]] == label[anchor]][:positives]:
            fits = [
                o for o in order
                if label[o[1]] != label[anchor] and 30 * -score <= 100 * -o[0] <= 90 * -score
            ][:negatives]
            for rank, (low, negative) in enumerate(fits, 1):
                out.append((anchor, positive, rank, negative, -score, -low))
    return sorted(out)


def vectors(seed, count, dims=3, step=1 / 16):
    rng = random.Random(seed)
    return [
        (i, [rng.randint(-20, 20) * step for _ in range(dims)], rng.choice("aab"))
        for i in range(-200, count)
    ]


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_negatives_match_brute_force(spark, block_bytes):
    rows = vectors(1, 700) + vectors(2, 0, step=1 / 256)
    # Small whole numbers: many ties and zero scores. Two rows share each id below 0.
    seen = {}
    for i, v, lab in rows:
        seen[i] = min(seen.get(i, (lab, v)), (lab, v))
    odd = [
        (None, [1.0] * 3, "a"), (801, None, "a"), (802, [1.0, None, 1.0], "a"), (803, [1.0] * 3, None),
        (804, [float("nan"), 1.0, 1.0], "a"), (805, [float("inf"), 1.0, 1.0], "b"), (806, [1.0] * 4, "a"),
        (807, [], "b"), (900, None, "a"),
    ]
    schema = "vec_id long, embedding array<double>, label string, part int, score int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows * 2 + odd], schema)
    found = hard_negatives.mine(df, lambda i: i % 100 == 0, block_bytes=block_bytes)
    want = brute_negatives([(i, v, lab) for i, (lab, v) in seen.items()])
    assert sorted(map(tuple, found.collect())) == want
    assert hard_negatives.mine(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert hard_negatives.mine(df.filter("vec_id = 100"), lambda i: i % 100 == 0).count() == 0


def test_scores_stay_exact():
    import numpy as np

    for scale in (1.0, 1e7, 1e12, 1e300):
        a = hard_negatives.quantised(np.array([[scale, -scale / 3], [1.0, 2.0]]), 256)
        most = (1 << 63) - 1
        want = [
            [max(-most, min(most, sum(int(x) * int(y) for x, y in zip(r, q)))) for q in a] for r in a
        ]
        assert hard_negatives.scores(a, a).tolist() == want


def test_keys_sort_as_meant():
    rng = random.Random(6)
    rows = [
        (rng.randint(-3, 3), rng.choice([-(2**63) + 1, -1, 0, 5, 2**63 - 1]), rng.randint(-9, 9), k)
        for k in (0, 1) for _ in range(200)
    ]
    packed = sorted(hard_negatives.pack(*r) for r in rows)
    assert [hard_negatives.unpack(k) for k in packed] == sorted(
        rows, key=lambda r: (r[0], -r[1], r[3], r[2])
    )
