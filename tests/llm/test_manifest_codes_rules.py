"""Merkle manifest, vector codes and quality rules against brute force on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barspark.llm import arrays as A, lloyd as L, manifest as M, rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- Merkle manifest

def brute_tree(h, fanout):
    paths, at = [[] for _ in h], list(range(len(h)))
    while len(h) > 1:
        for k in range(len(paths)):
            a = at[k] // fanout * fanout
            paths[k].append(("".join(h[a:at[k]]), "".join(h[at[k] + 1:a + fanout])))
            at[k] //= fanout
        h = [sha("".join(h[a:a + fanout])) for a in range(0, len(h), fanout)]
    return h[0], paths


def brute_manifest(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for i, s, lang, n, text in rows:
        leaf = sha("".join(map(field, (i, s, lang, n, text))))
        low = None
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            low = sha("".join(map(field, (i, s, lang, n, text and text.translate(FOLD)))))
        by.setdefault(s, []).append(((i is not None, i or 0, leaf), i, leaf, low))
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    if not keys:
        return []
    trees = {s: brute_tree([x[2] for x in sorted(by[s])], fanout) for s in keys}
    root, upper = brute_tree([trees[s][0] for s in keys], fanout)
    out = []
    for s, up in zip(keys, upper):
        for (_, i, leaf, low), path in zip(sorted(by[s]), trees[s][1]):
            h = low or leaf
            for a, b in path + up:
                h = sha(a + h + b)
            out.append((i, leaf, trees[s][0], root, sha("".join(a + b for a, b in path + up)), h, h == root))
    return out


def as_key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_manifest_on_awkward_rows(docs, docs_rows):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in docs_rows]
    assert as_key(M.manifest_report(docs).collect()) == as_key(brute_manifest(rows))


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_of_many_shapes(spark, fanout):
    """A hot source, sources of 1 to 20 rows on both sides of powers of the fanout, wide characters in keys, equal rows."""
    rng = random.Random(5)
    rows = [(i, "hot", "en", i % 7, "Abc" * (i % 3)) for i in range(150)]
    for n in range(1, 21):
        rows += [(rng.randrange(10 ** 6), ["é", "z", "Z", "\U0001F600", ""][n % 5] + str(n), None, None, "X") for _ in range(n)]
    rows += [(None, None, None, None, None), (4, None, "a", 1, ""), (7, "hot", "en", 0, "Abc"), (7, "hot", "en", 0, "Abc"), (-3, "hot", "en", 0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    leaves = M.document_proofs(df, fanout=fanout).withColumn("proof", M.proof_digest(F.col("path")))
    got = leaves.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    assert as_key(got) == as_key(brute_manifest(rows, fanout)) and {r.verified for r in got} == {True, False}


def test_manifest_small_and_empty(spark, no_docs):
    assert M.manifest_report(no_docs).collect() == []
    one = M.manifest_report(spark.createDataFrame([(1, "s", "en", 1, "a")], "doc_id long, source string, lang string, n_chars long, text string")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified


# ---- vector codes

def brute_codes(rows, parts=4, size=256, rounds=4, scale=1024):
    """rows: (id, vector, label) of one length; plain integers throughout."""
    kept = [(i, [math.floor(scale * c) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    w = width // parts
    books = [[v[p * w:p * w + w] for _, v, _ in kept[:size]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (dist(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                x = v[p * w:p * w + w]
                own.setdefault(nearest(x, books[p]), []).append(x)
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = []
    for i, v, lab in kept:
        at = [nearest(v[p * w:p * w + w], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{a:02x}" for a in at), sum(dist(v[p * w:p * w + w], books[p][a]) for p, a in enumerate(at)), lab))
    total = Counter()
    for _, _, e, lab in found:
        total[lab] += e
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return [(i, c, e, total[lab], digest) for i, c, e, lab in found]


def vectors():
    """Clusters, a third of all rows one vector, a hot label, ties, repeats, and vectors that cannot be used."""
    rng = random.Random(11)
    rows, centres = [], [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(9)]
    for i in range(420):
        c = centres[i % 9]
        rows.append((i, [x + rng.gauss(0, 0.02) for x in c], [None, 1, 1, i % 50][i % 4]))
    rows += [(1000 + i, centres[0], 1) for i in range(210)]
    rows += [(2000 + i, [i / 1024, 0.0, -i / 1024, 0.5, -0.5, 1 / 2048, -1 / 2048, 0.0], 2) for i in range(40)]
    rows += [(5, rows[5][1], 1), (5, centres[3], None), (3000, None, 1), (3001, [0.1, None] + [0.0] * 6, 1), (3002, [float("nan")] * 8, 1), (3003, [float("inf")] * 8, 1)]
    rng.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, code string, id int"


@pytest.mark.parametrize("size,rounds,block", [(256, 4, 2048), (16, 3, 50)])
def test_codes_against_brute_force(spark, size, rounds, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    codes, books = L.vector_codes(df, size=size, rounds=rounds, block=block)
    got = sorted((r.vec_id, r.code, r.error) for r in codes.collect())
    exp = brute_codes(rows, size=size, rounds=rounds)
    assert got == sorted(e[:3] for e in exp) and L.codebooks_digest(books) == exp[0][4]


def test_codes_report(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in L.codes_report(df).collect()) == sorted(brute_codes(rows))


def test_codes_odd_lengths_and_empty(spark):
    rows = [(1, [0.5, 0.25, 1.0], 1), (2, [], 1), (3, [0.125] * 5, None), (4, [1.0], 2), (None, [0.5], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert as_key(L.codes_report(df).collect()) == as_key(brute_codes(rows))
    assert L.codes_report(df.limit(0)).collect() == []
    only_empty = spark.createDataFrame([(1, [], 1, "x", 1)], SCHEMA)
    assert [(r.vec_id, r.code, r.error) for r in L.codes_report(only_empty).collect()] == [(1, "00000000", 0)]
    assert L.codes_report(spark.createDataFrame([(1, None, 1, "x", 1)], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="must not exceed"):
        L.vector_codes(spark.createDataFrame([(1, [1e9], 1, "x", 1)], SCHEMA))[0].collect()


def test_cover_tree_holds_its_bounds():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-40, 40, (300, 3)), np.repeat([[7, 7, 7]], 200, 0), rng.integers(-4000, 4000, (60, 3))])
    nodes, order = L.cover_tree(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    assert (nodes[0]["start"], nodes[0]["end"]) == (0, len(x))
    inner = 0
    for n in nodes:
        own = x[order[n["start"]:n["end"]]]
        assert np.sqrt(((own - x[n["centre"]]) ** 2).sum(1)).max() <= n["radius"]
        kids = nodes[n["child"]:n["child"] + n["children"]]
        if len(kids):
            inner += 1
            assert kids["start"][0] == n["start"] and kids["end"][-1] == n["end"] and (kids["start"][1:] == kids["end"][:-1]).all()
            c = x[kids["centre"]].astype(float)
            apart = np.sqrt(((c[:, None] - c) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert apart.min() >= n["radius"] / 2 * (1 - 1e-6) and (kids["radius"] <= n["radius"]).all()
    assert inner > 10


def test_whole_subtrees_are_assigned():
    """Most points are settled by their subtree, and settle as the exact comparison would."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (20, 4))
    x = centres[rng.integers(0, 20, 2000)] + rng.integers(-3, 4, (2000, 4))
    nodes, order = L.cover_tree(x)
    subtree, entry, single = L.assign(x, nodes, order, centres)
    settled = (nodes["end"][subtree] - nodes["start"][subtree])
    assert settled.sum() + (single >= 0).sum() == len(x) and settled.sum() > 0.9 * len(x) and len(subtree) < 200
    assert (L.entries(x, nodes, order, centres) == L.squared(x, centres).argmin(1)).all()
    # equal entries: the lower one takes all, and nothing is settled by a bound that is only touched
    twice = np.concatenate([centres, centres])
    assert L.entries(x, nodes, order, twice).max() < 20


def test_exact_distances_of_large_components():
    x = np.array([[L.LARGEST, -L.LARGEST, 1, 0]] * 2) * [[1], [-1]]
    assert L.squared(x, x).tolist() == [[0, 4 * (2 * L.LARGEST ** 2 + 1)], [4 * (2 * L.LARGEST ** 2 + 1), 0]]


# ---- quality rules

def brute_counts(text):
    w = WORD.findall(text or "")
    seen, late = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            late += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), late, len(covered)


AWKWARD = ["a b c d e a b c d e", "one two\none two\n one two\n\n \t\n\none two", "é# ü|ü <>  x\r\ny\r\ny", "x " * 4000, "\n\n", "# * $ % & | < >", "日本語 テキスト", "A1 B2. c,d", None, ""]


def test_counts_against_brute_force(spark, docs, docs_rows):
    for texts in ([r[1] for r in docs_rows], AWKWARD):
        counts, shares = R.statistics(A.text_of(pa.array(texts, pa.string())))
        assert [tuple(c) for c in counts.tolist()] == [brute_counts(t) for t in texts]
        assert np.isfinite(shares).all()
        for t, s in zip(texts, shares):
            w = WORD.findall(t or "")
            n = max(1, len(w))
            lines = [x for x in (t or "").split("\n") if WORD.search(x)]
            got = dict(zip(R.SHARES, s))
            assert math.isclose(got["mean_word_chars"], sum(map(len, w)) / n) and math.isclose(got["distinct_share"], len(set(w)) / n)
            assert math.isclose(got["words_a_line"], len(w) / max(1, len(lines))) and got["longest_word"] == max(map(len, w), default=0)
            assert math.isclose(got["stutter_share"], sum(a == b for a, b in zip(w, w[1:])) / n)
            assert math.isclose(got["upper_share"], sum("A" <= c <= "Z" for c in t or "") / max(1, len(t or "")))
            bare = sum(not any("A" <= c <= "Z" or "a" <= c <= "z" or ord(c) > 127 for c in x) for x in w)
            assert math.isclose(got["bare_word_share"], bare / n) and math.isclose(got["stops_a_word"], len(re.findall("[.,;:?!]", t or "")) / n)


def test_report_on_awkward_rows(docs, docs_rows, no_docs, spark):
    rules = [(R.Condition("symbols_a_word", True, 0.5),), (R.Condition("distinct_share", False, 0.5), R.Condition("mean_word_chars", True, 1.5))]
    got = R.judged(docs, rules)
    assert got.columns == ["doc_id", *R.COUNTS, "base_failed", "rule", "kept"]
    exp = []
    for i, t, *_ in docs_rows:
        c = brute_counts(t)
        _, s = R.statistics(A.text_of(pa.array([t], pa.string())))
        s = dict(zip(R.SHARES, s[0]))
        rule = 1 if s["symbols_a_word"] > 0.5 else 2 if s["distinct_share"] <= 0.5 and s["mean_word_chars"] > 1.5 else 0
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        exp.append((i, *c, failed, rule, not failed and rule == 0))
    assert as_key(got.collect()) == as_key(exp)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert R.rules_report(no_docs, labels).collect() == []
    assert R.rules_report(docs, labels).where("kept").count() == sum(not e[6] for e in exp)


def test_learns_planted_conjunctions():
    """Bad rows fill two boxes of which each side alone is common among good ones; noise of a percent."""
    rng = np.random.default_rng(9)
    names = ["a", "b", "c", "d"]
    x = rng.random((6000, 4))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | ((x[:, 2] > 0.8) & (x[:, 0] <= 0.3))
    noisy = bad ^ (rng.random(len(x)) < 0.01)
    rules = R.learn(x, noisy, names)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= R.covers(r, x, names)
    assert (hit == bad).mean() > 0.96 and 2 <= len(rules) <= 8
    assert R.learn(x, noisy, names) == rules
    assert R.learn(x, np.zeros(len(x), bool), names) == [] and R.learn(x[:0], bad[:0], names) == []
    assert "else keep" in R.described(rules)[-1]


def test_pruning_drops_chance_conditions():
    """Labels by chance give no rule; a single true condition is not lengthened."""
    rng = np.random.default_rng(3)
    x = rng.random((3000, 5))
    assert R.learn(x, rng.random(3000) < 0.2, list("abcde")) == []
    rules = R.learn(x, (x[:, 3] > 0.8) ^ (rng.random(3000) < 0.03), list("abcde"))
    assert len(rules[0]) == 1 and rules[0][0].statistic == "d" and abs(rules[0][0].cut - 0.8) < 0.03


def test_expression_agrees_with_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.random((500, 3)).round(2)
    names = ["a", "b", "c"]
    rules = [(R.Condition("a", True, 0.9),), (R.Condition("b", False, 0.25), R.Condition("c", True, 0.5)), (R.Condition("c", False, 0.1),)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k long, p_a double, p_b double, p_c double")
    got = [r.rule for r in df.withColumn("rule", R.expression(rules, "p_")).orderBy("k").collect()]
    exp = np.zeros(len(x), int)
    for k, r in reversed(list(enumerate(rules))):
        exp[R.covers(r, x, names)] = k + 1
    assert got == exp.tolist()


def test_held_out_verdicts(spark):
    """Learned on the other rows, the list keeps the good held-out documents and drops the bad."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = R.rules_report(docs, labels).join(labels, "doc_id").where(~R.for_learning("doc_id")).where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n.get((0, True), 0) <= 0.05 * (n.get((0, False), 0) + n.get((0, True), 0)) and n.get((1, False), 0) <= 0.005 * n[(1, True)]


def test_rows_for_learning_are_bounded(spark):
    """An id that many documents share brings no more rows than the bound."""
    docs = spark.createDataFrame([(i % 3, f"w{i} " * 4 + " ".join(f"v{i}x{k}" for k in range(12))) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (None, 0), (1, None)], "doc_id long, quality int")
    seen = []
    real = R.learn
    try:
        R.learn = lambda x, *a: seen.append(len(x)) or real(x, *a)
        R.learned(docs, labels, max_rows=20)
    finally:
        R.learn = real
    assert seen == [20]
