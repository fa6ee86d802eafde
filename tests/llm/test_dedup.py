import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veritally.llm import near_dedup, substring_dedup
from veritally.llm.common import Words
from veritally.llm.components import components
from veritally.llm.fm_index import Index

from .data import SCHEMA, empty, odd, rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (34, 35, 36, 60, 120)]
    texts = []
    for k in range(60):
        parts = [sentence(rng, rng.randrange(0, 50)) for _ in range(3)]
        parts.insert(rng.randrange(3), shared[k % 5] if k % 2 else sentence(rng, 40))
        texts.append(rng.choice(["\n", " ", "\t \r\n"]).join(parts))
    texts += [texts[3], "ha " * 200, "ha " * 90, "ho hi " * 70, shared[4] + " " + shared[4]]
    base = sentence(rng, 90).split()
    for _ in range(40):
        near = base[:]
        near[rng.randrange(90)] = sentence(rng, 1, "z")
        texts.append(" ".join(near))
    return texts


@pytest.mark.parametrize("hot", [2000, 100, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", 500)
    texts = passages(hot)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("doc_id").collect()
    assert [tuple(r)[1:4] for r in got] == brute_substrings(texts)
    for r, text in zip(got, texts, strict=True):
        if r.kept is not None:
            words = WORD.findall(text)
            assert hashlib.sha256(" ".join(w for s in r.kept for w in words[s["start"] : s["end"]]).encode()).hexdigest() == r.kept_sha256


def test_substrings_of_odd_tables(spark):
    df = odd(spark)
    got = substring_dedup.substring_dedup(df).collect()
    assert len(got) == df.count()
    texts = [r.text for r in df.collect()]
    assert sorted(tuple(r)[1:4] for r in got) == sorted(brute_substrings(texts))
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_repeated_rows_that_share_a_passage_stay_as_many(spark):
    rng = random.Random(6)
    passage = sentence(rng, 60)
    again, other = sentence(rng, 20) + " " + passage, passage + " " + sentence(rng, 20)
    data = [(1, again)] * 3 + [(2, other)] + [(None, other + " end")] * 2
    got = substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:4] for r in got) == sorted(brute_substrings([t for _, t in data]))


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 4, n).astype(np.uint64) for n in (3, 50, 1, 120, 9, 9)]
    words, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
    for depth in (1, 2, 3, 5, 8):
        index = Index(words, ends, depth)
        start = index.place[ends - [len(p) for p in pieces]]
        got = index.matches(start, start + [len(p) for p in pieces])
        every = Counter(tuple(p[i : i + depth]) for p in pieces for i in range(len(p) - depth + 1))
        for s, p in zip(start, pieces, strict=True):
            assert [got[s + i] for i in range(len(p) - depth + 1)] == [every[tuple(p[i : i + depth])] for i in range(len(p) - depth + 1)]


def test_words_are_split_as_the_pattern_says():
    texts = ["a  b\tc\x0bd\x0ce\rf\ng", "", " x ", "é ü   z", "\x1f\x00 q"]
    words = Words(pa.array(texts))
    raw = words.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(words.start, words.end, strict=True)]
    assert got == [w for t in texts for w in WORD.findall(t)]
    assert words.count.tolist() == [len(WORD.findall(t)) for t in texts]
    assert len(set(words.hash.tolist())) == len(set(got))


# ---------------------------------------------------------------- near copies


def jaccards(a, b):
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    if max(a.values()) == max(b.values()) == 1:
        return plain  # both are the same
    every = set(a) | set(b)
    return max(plain, sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a.keys() & b.keys()))


def brute_classes(ids, texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append(Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and sets[a].keys() & sets[b].keys() and jaccards(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(15):
        base = sentence(rng, rng.randrange(60, 200)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            near = base[:]
            for _ in range(rng.randrange(4)):
                near[rng.randrange(len(near))] = sentence(rng, 1, "z")
            texts.append(" ".join(near))
    texts += ["ha ha ha ho " * 30, "ha ha ha ho " * 50, "a b", "a b", "a b c", texts[0], texts[0]]
    ids = random.Random(9).sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, *r[1:]) for i, r in zip(ids, rows(texts), strict=True)], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    want = brute_classes(ids, texts)
    assert got == want
    kept = {r.doc_id for r in near_dedup.deduplicated(df).collect()}
    assert kept == set(want.values())


def test_near_copies_in_one_bucket_join_even_if_not_with_their_leader(spark):
    """A chain of texts whose ends are not similar."""
    rng = random.Random(8)
    words = sentence(rng, 100).split()
    texts = []
    for k in range(12):
        words[8 * k : 8 * k + 2] = sentence(rng, 2, "z").split()
        texts.append(" ".join(words))
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert {r.class_id for r in near_dedup.classes(df).collect()} == {0}


def test_near_copies_by_shingle_sets_whose_counts_differ(spark):
    """Plain Jaccard 0.97, probability Jaccard 0.25."""
    rng = random.Random(11)
    texts = []
    for _ in range(8):
        body, line = sentence(rng, 204), sentence(rng, 6, "z")
        texts += [body, body + (" " + line) * 100]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == brute_classes(range(len(texts)), texts) == {k: k - k % 2 for k in range(16)}


def test_near_copies_by_counts_beside_a_larger_component(spark):
    """Two texts share most by a repeated line only; their buckets' leaders are in groups that are just not like them."""
    rng = random.Random(13)
    line = (" " + sentence(rng, 6, "z")) * 100
    texts = []
    for _ in range(8):
        own = sentence(rng, 100).split()
        for k in range(6):
            own[k * 9] = sentence(rng, 1, "y")
            texts.append(" ".join(own) + line)
    texts += [sentence(rng, 60) + line for _ in range(2)]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    want = brute_classes(range(len(texts)), texts)
    assert want[48] == want[49] == 48
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == want


def test_links_just_above_the_limit_are_found(spark):
    """Pairs at 0.80 to 0.85, a third of them with a repeated line, among texts that share half of their words with all others:
    every link of the brute force is there."""
    rng = random.Random(15)
    common, texts = sentence(rng, 60).split(), []
    for k in range(40):
        base = sentence(rng, 120).split()
        if k % 3 == 0:
            base += sentence(rng, 6, "r").split() * 12
        near = base[:]
        for place in rng.sample(range(10, 110, 12), 2 if k % 3 else 3):
            near[place] = sentence(rng, 1, "z")
        texts += [" ".join(base), " ".join(near)]
    for k in range(40):
        texts.append(" ".join(common + sentence(rng, 60, "u").split()))
    sets = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(WORD.findall, texts)]
    close = [jaccards(sets[2 * k], sets[2 * k + 1]) for k in range(40)]
    assert sum(0.8 <= s <= 0.87 for s in close) >= 25
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    linked = [k for k in range(40) if close[k] >= 0.8]
    assert sum(got[2 * k] == got[2 * k + 1] for k in linked) == len(linked)
    assert got == brute_classes(range(len(texts)), texts)


def test_many_texts_just_below_the_limit_make_few_pairs(spark, monkeypatch):
    """All share 85 % of their shingles with all others, none is linked: sizes alone keep them apart in the second pass."""
    rng = random.Random(16)
    common = sentence(rng, 170)
    texts = [common + " " + sentence(rng, 30, f"u{k}") for k in range(150)]
    pairs = []
    monkeypatch.setattr(near_dedup, "verified", lambda p, s, least, real=near_dedup.verified: (pairs.append(p.count()), real(p, s, least))[1])
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == brute_classes(range(len(texts)), texts) == {k: k for k in range(150)}
    assert sum(pairs) < 150 * near_dedup.BANDS * 2


@pytest.mark.parametrize("repeated", [0, 200])
def test_texts_that_differ_from_their_leader_in_other_ways_make_few_pairs(spark, monkeypatch, repeated):
    """Edits of one text, or own texts beside a line that weighs most: nearly all at 0.65 to 0.78 to all others, a few linked. The
    differences from the leader keep the others apart in the second pass, and every link of the brute force is there."""
    rng = random.Random(17)
    base, line, texts = sentence(rng, 300).split(), sentence(rng, 1, "z") + " ", []
    for k in range(70):
        own = base[:]
        if repeated:
            own = sentence(rng, 44).split()
        for place in rng.sample(range(8, 290), 0 if repeated else 5):
            own[place] = sentence(rng, 1, f"u{k}")
        texts.append(line * repeated + " ".join(own))
    for k in range(3):
        texts.append(f"{texts[20 + 10 * k]} end")
    pairs = []
    monkeypatch.setattr(near_dedup, "verified", lambda p, s, least, real=near_dedup.verified: (pairs.append(p.count()), real(p, s, least))[1])
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == brute_classes(range(len(texts)), texts)
    assert len(set(got.values())) >= 50
    assert len(pairs) == 2 and pairs[1] < 100


def test_one_row_of_a_class_stays_whatever_its_key(spark):
    rng = random.Random(14)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    data = [(1, a), (2, a + " end"), (2, b), (2, c), (None, a), (None, d), (None, d), (None, d + " end"), (3, ""), (3, ""), (4, None), (5, c), (5, b + " end")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = near_dedup.deduplicated(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got if r.text != d and r.text != d + " end") == sorted([(1, a), (2, b), (2, c), (3, ""), (3, ""), (4, "")])
    assert len([r for r in got if r.doc_id is None]) == 1


def test_near_copies_of_odd_tables(spark):
    df = odd(spark)
    got = near_dedup.classes(df).collect()
    assert len(got) == df.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.class_id)
    assert by_id[4] == by_id[5] == {4} and by_id[0] == {0} and by_id[1] == {1} and by_id[None] == {None, 4}
    assert near_dedup.classes(empty(spark)).count() == 0 and near_dedup.deduplicated(empty(spark)).count() == 0


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    b = np.concatenate([a[:200], np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64))])
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    x, y = Counter(dict(zip(a.tolist(), wa.tolist(), strict=True))), Counter(dict(zip(b.tolist(), wb.tolist(), strict=True)))
    every = set(x) | set(y)
    truth = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x.keys() & y.keys())
    hits = total = 0
    for salt in range(30):
        key = np.uint64(salt * 2 + 1)
        signs = near_dedup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]) * key, np.concatenate([wa, wb]).astype(float), 2)
        hits, total = hits + (signs[0] == signs[1]).sum(), total + near_dedup.M
    assert abs(hits / total - truth) < 0.03


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
