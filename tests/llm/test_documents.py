"""Operators over documents against brute force on the awkward table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import arrays as A, decontaminate as D, jaccard as J, quality as Q, substrings as S, tokens as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall(text or "")


# ---- words

def test_words_and_hashes(docs_rows):
    import pyarrow as pa
    texts = [r[1] for r in docs_rows]
    for limit in (1, 500, 1 << 21):
        at = 0
        seen = {}
        for i, j, t in A.slices(A.text_of(pa.array(texts)), limit):
            assert i == at
            at = j
            w = A.words(t)
            for d in range(j - i):
                a, b = w.offsets[d], w.offsets[d + 1]
                got = [bytes(t.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
                assert got == words_of(texts[i + d])
                for x, h in zip(got, w.names[a:b].tolist()):
                    assert seen.setdefault(x, h) == h
        assert at == len(texts) and len(set(seen.values())) == len(seen)


# ---- substring dedup

def brute_repeats(rows, size):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - size + 1):
            s = tuple(w[k:k + size])
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t, *_ in rows:
        if i is None:
            continue
        w = words_of(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out)


@pytest.mark.parametrize("size,rounds", [(13, None), (3, None), (30, 2)])
def test_remove_repeats(docs, docs_rows, size, rounds):
    got = sorted(tuple(r) for r in S.remove_repeats(docs, size, rounds).collect())
    assert got == brute_repeats(docs_rows, size)


def test_remove_repeats_empty(no_docs):
    assert S.remove_repeats(no_docs).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    for rounds in (1, 2, 3):
        names = A.mix(rng.integers(0, 6, 4000).astype(np.uint64))  # few words: many runs and repeats
        offsets = np.array([0, 700, 701, 1500, 4000])
        starts, _ = A.window_starts(offsets, 13)
        found = S.anchors(names, offsets, starts, 13, rounds)
        by = defaultdict(set)
        for s, a in zip(starts.tolist(), found.tolist()):
            by[tuple(names[s:s + 13].tolist())].add(a)
        assert all(len(x) == 1 for x in by.values())


# ---- n-gram Jaccard join

def brute_components(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = words_of((t or "").translate(FOLD))
            sets.setdefault(i, []).append(frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    items = [(i, s) for i, ss in sets.items() for s in ss]
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(items):
        for b in range(a):
            t = items[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(items):
        low[root(a)] = min(low.get(root(a), i), i)
    return sorted((i, len(s), low[root(a)]) for a, (i, s) in enumerate(items))


@pytest.mark.parametrize("n,percent,block", [(4, 85, 4096), (5, 80, 4096), (2, 50, 3)])
def test_ngram_jaccard(docs, docs_rows, n, percent, block):
    got = J.ngram_jaccard(docs, n, percent, max_region=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs_rows, n, percent)
    assert all((r.n_same == 0) == (r.n_shingles == 0) for r in got)


def test_ngram_jaccard_empty(no_docs):
    assert J.ngram_jaccard(no_docs).collect() == []


def test_region_join_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 120).astype(np.uint64)
    sets = []
    for _ in range(220):
        keep = base[rng.random(120) > rng.choice([0.02, 0.06, 0.15])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 40, rng.integers(0, 12)).astype(np.uint64)])))
    r = J.Region(sets, 85)
    r.split(np.arange(len(sets)))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ss = [set(s.tolist()) for s in sets]
    for a in range(len(ss)):
        for b in range(a):
            if 100 * len(ss[a] & ss[b]) >= 85 * len(ss[a] | ss[b]):
                parent[root(a)] = root(b)
    got = r.roots()
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a in range(len(ss)) for b in range(a))


def test_region_join_links_largest_components_of_one_size():
    # revisions: sets of 100 shingles of which each step replaces 8, so only neighbours link
    for seed in range(40):
        rng = np.random.default_rng(seed)
        chains, length = 4 + seed % 5, 8
        sets, chain = [], []
        for c in range(chains):
            own = np.arange(60 + 8 * length) + 1000 * (c + 1)
            sets += [np.concatenate([np.arange(40), own[8 * k:8 * k + 60]]).astype(np.uint64) for k in range(length)]
            chain += [c] * length
        order = rng.permutation(len(sets))
        r = J.Region([sets[i] for i in order], 85)
        r.split(np.arange(len(sets)))
        got = r.roots()
        assert len(sets) > J.LEAF and len(set(zip(got.tolist(), [chain[i] for i in order]))) == len(set(got.tolist())) == chains
    # components {0, 2} and {1, 3} of one size, joined by (2, 3) alone
    a = [np.arange(8 * k, 8 * k + 100).astype(np.uint64) for k in range(4)]
    r = J.Region([a[0], a[3], a[1], a[2]], 85)
    r.compare(0, np.arange(4))
    r.compare(1, np.arange(4))
    r.brute(np.arange(4), np.zeros((0, 4)))
    assert len(set(r.roots().tolist())) == 1


def test_keep_one_leaves_one_of_each_group(docs, docs_rows):
    out = J.keep_one(docs, 5, 80)
    assert out.columns == docs.columns
    comp = {i: c for i, _, c in brute_components(docs_rows, 5, 80)}
    expect = Counter(r[0] for r in docs_rows if r[0] is None or comp[r[0]] == r[0])
    assert Counter(r.doc_id for r in out.collect()) == expect


# ---- decontamination

def brute_tiles(item, doc, least):
    """Greedy string tiling by the book: all maximal matches of unmarked tokens, longest first."""
    own, other = [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not own[i + n] and not other[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(own)
        own[i:i + n] = [True] * n
        other[j:j + n] = [True] * n


def test_tiling_matches_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(60):
        item = rng.integers(0, 4, rng.integers(5, 25)).tolist()
        doc = rng.integers(0, 4, rng.integers(5, 60)).tolist()
        i, j = np.array([(a, b) for a in range(len(item) - 2) for b in range(len(doc) - 2) if item[a:a + 3] == doc[b:b + 3]] or np.zeros((0, 2), int)).reshape(-1, 2).T
        if len(i):
            assert D.tile(i, j, 3, len(item), len(doc)) == brute_tiles(item, doc, 3)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "The quick brown fox jumps, over the lazy dog near a river bank; while seven owls watched silently tonight."), (2, None), (3, "too short"), (None, "a b c d e f g h"),
            (4, "Élan vital à propos de rien du tout, voilà une phrase assez longue pour compter ici."), (4, "Élan vital à propos de rien du tout, voilà une phrase assez longue pour compter ici.")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_short_items_are_found_whole(spark):
    items = [(1, "Quartz vexes nymphs."), (2, "zyzzyva"), (3, "one two three four"), (4, "..."), (5, None), (6, "one two three four five six"), (3, "one two three four")]
    texts = ["He said: quartz, VEXES -- nymphs!", "quartz nymphs vexes", "a zyzzyva", "zyzzyvas", "one two three four", "one two three five four", "zero one two three four five", "", None, "nymphs quartz vexes nymphs quartz"]
    expect = [[1], [], [2], [], [3, 3], [], [3, 3, 6], [], [], [1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in D.leaks(frame, spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == {i: (bool(e), e) for i, e in enumerate(expect)}


@pytest.mark.parametrize("chars", [8_000_000, 60])
def test_leaks(spark, benchmark, docs, chars):
    q = "the QUICK brown fox jumps over the lazy dog near a river bank while seven owls watched silently tonight"
    rows = [(1, f"foo bar {q} baz"), (2, "while seven owls watched silently tonight foo near the quick brown fox jumps over the lazy dog and near a river bank"), (3, "the quick brown fox is red"),
            (4, None), (5, ""), (6, "foo ÉLAN*** VITAL!!! À PROPOS DE RIEN DU TOUT VOILÀ UNE PHRASE ASSEZ LONGUE POUR COMPTER ICI"), (None, q)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in D.leaks(frame, benchmark, block_chars=chars).collect()}
    assert got == {1: (True, [1]), 2: (True, [1]), 3: (False, []), 4: (False, []), 5: (False, []), 6: (True, [4, 4]), None: (True, [1])}
    assert sorted(r.doc_id for r in D.drop_leaks(frame, benchmark).collect()) == [3, 4, 5]
    kept = D.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert D.leaks(frame, benchmark.limit(0)).where("contaminated").count() == 0


# ---- tokens

def test_codes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        r = (rng.integers(0, 1 << 32, n) >> rng.choice([0, 8, 16, 24, 31], n)).astype(np.uint32)
        control, data = T.encode_codes(r)
        assert len(control) == -(-n // 4) and (T.decode_codes(control, data, n) == r).all()


def test_shards_match_the_tokenizer(docs, docs_rows, no_docs):
    from tokenizers import Tokenizer
    path = T.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in T.new_shards(docs, path).collect()))
    at, expect = 0, []
    rows = sorted((r[:2] for r in docs_rows if r[0] is not None), key=lambda r: r[0])
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        expect.append((i, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert got == sorted(expect)
    assert T.new_shards(no_docs, path).collect() == []


def encoded(pieces, texts, limit):
    """Ids of each text, in slices of about ``limit`` bytes."""
    import pyarrow as pa
    out = []
    for _, _, t in A.slices(A.text_of(pa.array(texts, pa.string())), limit):
        ids, n = pieces.encode(t, 7)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_pieces_are_exact():
    import random
    pieces = T.Pieces(T.tokenizer_path("byte_bpe_50k.json"))
    texts = ["a b", " a", "a ", "a  b", "a \n b", "don't, it's. U.S., 3.5, x1, -- a", "été naïve, ñandú.", "a b c", "<|endoftext|> x <|endoftext|>", "x<|endoftext|>",
             "日本 語, a", "a.\nb, c.", "a\n\nb c", "\na", "a'\n's b's' dogs' \"x\"", "the%%% a*** b### !!! ?? a!b! 1%% é%%", "a\r\nb c", "a\tb c, d", "x\x85y z", "a\u0301, b\u0301, c"]
    rng, alphabet = random.Random(1), list("ab'st .,\n!%é1 日")
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for limit in (40, 1 << 21):
        pieces.forget()
        for t, got in zip(texts, encoded(pieces, texts, limit)):
            assert got == [*pieces.ids(t), 7], repr(t)


def test_memo_is_bounded(monkeypatch):
    """A full memo starts anew; a slice with more pieces than it holds is still exact."""
    monkeypatch.setattr(T, "MEMO", 6)
    pieces = T.Pieces(T.tokenizer_path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{(i + k) % 7} word{'x' * (i % 5)}, y." for i in range(2 + k % 3)) for k in range(60)]
    for limit in (1, 200, 1 << 21):
        assert encoded(pieces, texts, limit) == [[*pieces.ids(t), 7] for t in texts]
        if limit == 1:
            assert len(pieces.names) <= 9  # the pieces of the last text
    assert encoded(pieces, [None, "", "a"], 10) == [[7], [7], [*pieces.ids("a"), 7]]


# ---- quality

def test_training_rows_are_bounded_when_ids_repeat(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(Q, "fit", lambda x, y: sizes.append((len(x), int(y.sum()))))
    docs = spark.createDataFrame([(1, "good words here")] * 500 + [(2, "bad ### words")] * 3 + [(i, "plain words") for i in range(3, 13)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(3, 1), (4, None), (40, 1)], "doc_id int, quality int")
    for most in (1000, 100, 12, 5, 0):
        Q.train(docs, labels, most)
    assert [n for n, _ in sizes[:2]] == [514, 14] and all(n <= most for (n, _), most in zip(sizes, (1000, 100, 12, 5, 0))) and sizes[2][0] >= 8


def test_quality_statistics_and_scores(spark, docs, no_docs):
    import random
    from tests.llm.conftest import prose
    rng = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " | ".join(prose(rng, 40).upper().split()) if bad else ". ".join(prose(rng, 10) for _ in range(5)), 0 if bad else 1))
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (5, 7), (10 ** 9, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.quality_scores(frame, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert Q.quality_scores(docs, labels).count() == docs.count()
    assert Q.keep_good(docs, labels, 0.0).columns == docs.columns
    assert Q.quality_scores(no_docs, labels).collect() == []
    assert {r.score for r in Q.quality_scores(frame, labels.limit(0)).collect()} == {0.5}


def test_flat_trees_agree_with_walking_them():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = Q.fit(x, y, trees=30)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    for row, s in zip(x[:20], m.score(x[:20])):
        total = m.bias
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert math.isclose(1 / (1 + math.exp(-total)), s)
