"""Near duplicates and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from burrow.llm import jaccard, simhash
from burrow.llm.jaccard import parity, prefix, similar_groups
from burrow.llm.line_dedup import dedup_lines


def plain_fingerprint(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, near):
    group = list(range(len(values)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


TEXTS = [
    None, "", " \n\t", "one", "One", "a b c d", "A b  c d", "a b c d e f g h i j", "É ß 日本 x y z é", "x " * 30_000 + "end", "tie tie",
    *(f"some words that go on and on number {i % 5} until the end of the line" for i in range(20)),
]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, fp int")
    found = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_groups(spark, monkeypatch, shard_rows):
    draw = random.Random(shard_rows)
    values = []
    for _ in range(40):  # clusters and chains of fingerprints
        value = draw.getrandbits(64)
        for _ in range(draw.randint(1, 8)):
            values.append(value)
            for b in draw.sample(range(64), draw.randint(0, 6)):
                value ^= 1 << b
    values += [0, 1, 15, (1 << 64) - 1]
    prints = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v, 0) for i, v in enumerate(values)], "doc_id long, fp long, fp2 long")
    named = simhash.groups(prints, lambda n: simhash.block_keys(n, 4, fill=2), 4, shard_rows)
    found = {r.doc_id: r.component_id for r in prints.join(named, ["fp", "fp2"]).collect()}
    assert found == dict(enumerate(plain_groups(values, lambda a, b: (a ^ b).bit_count() <= 4)))


def test_bk_search_finds_all():
    draw = np.random.default_rng(1)
    fp = np.unique(draw.integers(0, 1 << 12, 300).astype(np.uint64))[:, None]
    shard = np.sort(draw.integers(0, 4, len(fp)))
    forest = simhash.BKForest(fp, shard)
    q, node = forest.within(fp, shard, 2)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if shard[i] == shard[j] and int(fp[i, 0] ^ fp[j, 0]).bit_count() <= 2}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want


def test_similarity_mode_keeps_one_of_each_group(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, of = [], {}
    for group in range(30):
        text = [word() for _ in range(400)]
        for copy in range(3):
            changed = list(text)
            for at in draw.sample(range(400), 4 * copy):
                changed[at] = word()
            of[len(rows)] = group
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame([(*r, 5) for r in [*rows, (None, None), (200, ""), (201, None)]], "doc_id long, text string, __row int")
    assert simhash.keep_one(docs).columns == docs.columns
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    # All originals stay; copies go but for those that are less similar than 0.8.
    assert {i for i in of if i % 3 == 0} <= set(kept) and kept.count(None) == 1
    assert sum(i % 3 > 0 for i in kept if i is not None) <= 6 and 200 not in kept and 201 not in kept
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_proposals_connect_near_fingerprints(spark):
    values = [5, 5, 4, 1 << 40, (1 << 40) + 7, 0x0F0F0F0F0F0F0F0F, (1 << 64) - 1]
    prints = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "row long, fp long")
    found = simhash.proposals(prints, 4, 4096).collect()
    label = list(range(len(values)))
    for _ in values:
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert label == plain_groups(values, lambda a, b: (a ^ b).bit_count() <= 4)
    texts = ["a b c d e f", "x y", "one two three four five six seven"]
    assert [jaccard.vote(jaccard.shingle_set(t, 5)) & (1 << 64) - 1 for t in texts] == [plain_fingerprint(t, 5) for t in texts]


def plain_line_dedup(rows, least):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    count = lambda line: len(re.findall(r"[^\x20\x09-\x0D]+", line))
    seen, gone = {}, {k: set() for k in order}
    for k in order:
        lines = [(n, x) for n, x in enumerate((rows[k][1] or "").split("\n")) if count(x)]
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += count(lines[j][1])
                run = tuple(x for _, x in lines[i : j + 1])
                if total >= least and seen.setdefault(run, (k, i)) != (k, i):
                    gone[k].update(n for n, _ in lines[i : j + 1])
    cut = lambda k: "\n".join(x for n, x in enumerate(rows[k][1].split("\n")) if n not in gone[k])
    return {k: (None if rows[k][1] is None else cut(k), len(gone[k])) for k in order}


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 4), (3, 7)])
def test_line_dedup(spark, seed, least):
    draw = random.Random(seed)
    lines = ["a", "b b", "c c c", "", " ", "d", "e e"]
    rows = [(draw.choice([None, 1, 2, 3, 4]), "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 12)))) for _ in range(50)]
    rows += [(9, None), (9, ""), (9, "\n\n"), (5, "x y " * 20_000), (6, "x y " * 20_000)]
    docs = spark.createDataFrame([(*r, i, -i, "c0", "clash") for i, r in enumerate(rows)], "doc_id long, text string, k int, __row int, c0 string, lines_removed string").coalesce(1)
    found = dedup_lines(docs, min_words=least)
    assert found.columns == docs.columns
    assert {r.k: (r.text, r.lines_removed) for r in found.collect()} == plain_line_dedup(rows, least)


def test_line_dedup_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(docs).count() == 0


def plain_similar(texts, least, n=5):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for t in texts]
    return plain_groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))


def test_similarity_is_exact_on_both_sides(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts = [None, "", "one two", "One  two", "a b c d e", "a b c d e f g h i j"]
    for _ in range(25):
        text = [word() for _ in range(draw.choice([30, 120, 400]))]
        texts.append(" ".join(text))
        for share in (0.01, 0.02, 0.022, 0.024, 0.03):  # similarities from 0.7 to 0.95
            changed = list(text)
            for at in draw.sample(range(len(text)), max(1, round(share * len(text)))):
                changed[at] = word()
            texts.append(" ".join(changed))
    hot = [word() for _ in range(300)]
    for i in range(80):  # many near copies of one text, and texts that share a passage only
        changed = list(hot)
        for at in draw.sample(range(300), 5 + i % 3):
            changed[at] = word()
        texts.append(" ".join(changed))
        texts.append(" ".join([word() for _ in range(60)] + hot[:100]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_similar(texts, 0.8)
    assert [r.doc_id for r in simhash.keep_one(docs).orderBy("doc_id").collect()] == sorted(set(want))


def test_prefixes_meet_whatever_is_common():
    draw = np.random.default_rng(3)
    for _ in range(500):
        n = int(draw.integers(1, 60))
        a = np.unique(draw.integers(0, 1 << 40, n))
        b = np.unique(np.concatenate((a[draw.random(len(a)) < 0.9], draw.integers(0, 1 << 40, int(draw.integers(0, 1 + n // 8))))))
        if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
            continue
        common = np.unique(draw.choice(np.union1d(a, b), 20))
        counts = draw.integers(3, 9, len(common))
        assert len(np.intersect1d(prefix(a, 0.8, common, counts), prefix(b, 0.8, common, counts)))


def test_links_do_not_depend_on_the_corpus(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    text = [word() for _ in range(200)]
    changed = [word() if i in (20, 60, 100, 140) else w for i, w in enumerate(text)]
    pair = [" ".join(text), " ".join(changed)]
    others = [" ".join(word() for _ in range(30)) for _ in range(300)]
    for corpus in (pair, [*pair, *others], [*pair, *(f"{o} {' '.join(text[:60])}" for o in others)]):
        docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
        assert {r.row: r.component_id for r in similar_groups(docs).collect()} == {0: 0, 1: 0} | {i: i for i in range(2, len(corpus))}
    assert not hasattr(simhash, "sampled_keys")


def test_possible_pairs_hold_all_similar_ones(spark):
    draw = np.random.default_rng(7)
    sets = []
    for n in [1, 2, 5, 14, 15, 16, 17, 30, 31, 32, 33, 60, 63, 64, 65, 127, 128, 129, 500, 511, 512, 513, 1000] * 2:
        base = np.unique(draw.integers(-(1 << 62), 1 << 62, n))
        for share in (0.0, 0.08, 0.1, 0.11, 0.12, 0.3):
            kept = base[draw.random(len(base)) >= share]
            sets.append(np.union1d(kept, draw.integers(-(1 << 62), 1 << 62, draw.integers(0, 1 + n // 9))))
    sets = [s for s in sets if len(s)]
    nodes = spark.createDataFrame([(i, len(s), jaccard.spread(s).tolist()) for i, s in enumerate(sets)], "row long, n long, spread array<short>")
    near = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i + 1, min(len(sets), i + 6))}
    pairs = spark.createDataFrame(list(near), "a long, b long")
    found = {(r.a, r.b) for r in jaccard._possible(pairs, nodes, 0.8).collect()}
    assert {p for p, x in near.items() if x >= 0.8} <= found and not any(near[p] < 0.5 for p in found)


def test_parity_never_exceeds_the_difference():
    draw = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(draw.integers(-(1 << 62), 1 << 62, 300)[: draw.integers(0, 300)]) for _ in range(2))
        b = np.union1d(a[draw.random(len(a)) < 0.8], b[:40])
        assert np.bitwise_count((parity(a) ^ parity(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
