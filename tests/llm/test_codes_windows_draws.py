"""Vector codes, repeated windows and importance resampling against plain loops, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from gridtrack.llm import resample, substrings, vector_codes

r = random.Random(11)
WORDS = ["".join(r.choice("abcdeéÉXYZ") for _ in range(r.randint(1, 6))) for _ in range(300)]
some = lambda n: [r.choice(WORDS) for _ in range(n)]
DOCS = "doc_id long, text string, h long, doc string, part int, run int, spans string, rank int, span_id int, sha string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y", 4, 5, "z") for i, t in rows], DOCS).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_windows(rows, k):
    """(doc_id, n_words, n_removed, sha of kept words, longest) of each row, by comparing all windows."""
    at = collections.defaultdict(set)
    split = [(i, words(t)) for i, t in rows]
    sizes = [k * 2**j for j in range(12)]
    for i, w in split:
        if i is not None:
            for n in sizes:
                for p in range(len(w) - n + 1):
                    at[tuple(w[p : p + n])].add(i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        longest = 0
        if i is not None:
            for p in range(len(w) - k + 1):
                if min(at[tuple(w[p : p + k])]) < i:
                    gone[p : p + k] = [True] * k
            longest = max([n for n in sizes for p in range(len(w) - n + 1) if len(at[tuple(w[p : p + n])]) > 1], default=0)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), longest))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [50, 8, 7])
def test_repeated_windows(spark, k):
    shared, other = some(130), some(60)
    rows = [(1, " ".join(some(30) + shared + some(20))), (2, " \n".join(shared[3:100])), (3, " ".join(some(10) + shared[40:95] + other)), (4, " ".join(other + some(5) + other))]
    rows += [(10 + i, " ".join(some(i) + shared[10 : 60 + i % 3] + some(3))) for i in range(20)]
    whole = " ".join(some(400))
    rows += [(50, whole), (51, whole), (52, whole.upper()), (40, whole), (53, whole.replace(" ", "\t\t")), (40, " ".join(shared)), (40, whole)]
    rows += [(60, None), (61, ""), (62, " \n"), (63, "a " * 300), (64, "a " * 120), (None, whole), (None, None), (65, " ".join(some(5000))), (0, "short one")]
    rows += [(66, "é b " * 200)]
    docs = table(spark, rows)
    got = substrings.repeats(docs, substrings.SubstringParams(words=k, block_chars=500))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256", "longest").collect()), key=str) == plain_windows(rows, k)


def test_windows_taken_out(spark):
    shared = some(80)
    rows = [(1, " ".join(some(5) + shared)), (2, " ".join(some(5) + shared + some(7))), (3, "as  it\nwas"), (None, " ".join(shared)), (4, None)]
    docs = table(spark, rows)
    found = substrings.repeats(docs)
    out = substrings.remove(docs, found)
    assert out.columns == docs.columns
    texts = {x.doc_id: x.text for x in out.collect()}
    two = words(rows[1][1])
    assert texts == {1: rows[0][1], 2: " ".join(two[:5] + two[85:]), 3: "as  it\nwas", None: rows[3][1], 4: None}


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert substrings.repeats(none).count() == 0
    assert substrings.remove(none, substrings.repeats(none)).count() == 0
    assert resample.resample(none, none).count() == 0


def plain_codes(rows, parts, entries, rounds):
    dims = next(len(v) for _, v, _ in sorted((x for x in rows if good(x[1])), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if good(v) and len(v) == dims]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    w = dims // parts
    books = [[v[p * w : p * w + w] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [[min(range(len(books[p])), key=lambda e: (far(v[p * w : p * w + w], books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * w : p * w + w] for (_, v, _), c in zip(kept, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = nearest()
    errors = [sum(far(v[p * w : p * w + w], books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes)]
    by = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        by[label] += e
    return sorted(((i, bytes(c).hex(), e, by[label]) for (i, _, label), c, e in zip(kept, codes, errors)), key=str), books


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize(("leaf", "chunk", "few"), [(12, 4096, False), (2, 100, False), (4, 50, True)])
def test_vector_codes(spark, leaf, chunk, few):
    g = random.Random(5)
    rows = [(i, [g.choice([g.gauss(0, 0.3), round(g.gauss(0, 2)) / 64]) for _ in range(8)], g.choice([0, 1, None])) for i in range(20 if few else 600)]
    rows += [(1000 + i, [0.25] * 8, 7) for i in range(50)] + [(3, [0.5] * 8, 7), (3, [0.5] * 8, 7)]  # a vector of many rows, ties, repeated ids
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 8, 1), (2003, [float("nan")] + [0.0] * 7, 1), (2004, [float("inf")] * 8, 1), (2005, [0.1] * 4, 1), (None, [0.1] * 8, 1)]
    vectors = spark.createDataFrame([(*x, 1, "p") for x in rows], "vec_id long, embedding array<double>, label int, part int, code string").repartition(4)
    params = vector_codes.CodeParams(parts=4, entries=16, leaf=leaf, chunk=chunk)
    out, books = vector_codes.compress(vectors, params)
    want, plain = plain_codes(rows, 4, 16, 2)
    assert books.tolist() == plain
    got = vector_codes.with_label_errors(out).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_balls(spark):
    points = np.random.default_rng(1).integers(-100, 100, (700, 3))
    tree = vector_codes.grow(points, 5)
    assert (tree.points[tree.of_row] == points).all()
    for i, j, pivot, radius, total, n, kids in zip(tree.start, tree.end, tree.pivot, tree.radius, tree.sums, tree.sizes, tree.children):
        own = np.repeat(tree.points[i:j], tree.counts[i:j], axis=0)
        assert len(own) == n and (own.sum(axis=0) == total).all() and np.sqrt(((own - pivot) ** 2).sum(axis=1)).max() <= radius + 1e-9
        assert kids[0] < 0 or (tree.start[kids[0]], tree.end[kids[1]]) == (i, j) and tree.end[kids[0]] == tree.start[kids[1]]


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    out, books = vector_codes.compress(none)
    assert out.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 7, 1)], none.schema))


def plain_draw(rows, target, p):
    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % p.buckets for n in range(1, p.ngrams + 1) for i in range(len(w) - n + 1)]

    own = [(i, *found(t)) for i, t in rows]
    s, t = collections.Counter(b for _, _, f in own for b in f), collections.Counter(b for x in target for b in found(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + p.buckets) / ((s[b] + 1) * (nt + p.buckets)))) for b in s}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((x for x in out if x[1] >= p.least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = {x: k + 1 for k, x in enumerate(best[: p.percent * len(best) // 100])}
    return sorted(((x[0], *x[2:], drawn.get(x)) for x in out), key=str)


@pytest.mark.parametrize("ngrams", [1, 2, 3])
@pytest.mark.parametrize("empty", [False, True])
def test_resampling(spark, ngrams, empty):
    rows = [(i, " ".join(some(15 + i % 12)) + r.choice(["", "!", "\x00x", " ½ 日本", "--a1"])) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "...!"), (203, " ".join(some(9000))), (None, " ".join(some(40)))]
    target = [] if empty else [" ".join(some(50)) for _ in range(4)] + [None, ""]
    p = resample.ResampleParams(ngrams=ngrams, buckets=97, block_bytes=700, percent=13)
    got = resample.resample(table(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), p)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain_draw(rows, target, p)


def test_ranks_of_copies(spark):
    rows = [(5, " ".join(["same"] * 30))] * 40
    got = resample.resample(table(spark, rows), table(spark, rows)).collect()
    assert sorted(x.rank for x in got if x.rank) == [1, 2, 3, 4] and len(got) == 40
