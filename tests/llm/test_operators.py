"""Document operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridtrack.llm import common, exact_dedup, langid, line_dedup, lm_score, neardup, packing, quality_rules, secrets, sp_codec, toxicity
from gridtrack.llm.common import lower_ascii
from gridtrack.llm.queries import pack_params

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefgilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
text = lambda n, r=rng: " ".join(r.choice(WORDS) for _ in range(n))
LONG = text(20_000)
BASE = text(120)
TEXTS = [
    None, "", " \n\t ", "Short one.", BASE, BASE.upper(), BASE, " ".join(["other", *BASE.split()[1:]]), LONG, "é ß ½ 日本語 ▁ x\x00y", "123 456 !!", text(60),
    "token = 'abcdef123456' and password:short1 secret=ab AKIA" + "Z" * 16 + " " + "0123456789abcdef" * 2, "one two three\n" * 12, text(9), text(300) + "\n" + text(30),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, rank long, norm string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "k", 2, "n") for i, t in enumerate(TEXTS)] + [(None, "null id text here", None, None, None, None, None, None, None), (4, BASE, "en", "s", 1, 1, "k", 2, "n")]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def fold_ascii(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact_dedup(docs, none):
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[fold_ascii(r.text)].append(r.doc_id)
    for keep, best in (("largest", max), ("smallest", min)):
        want = sorted(((r.doc_id, best(ids := [i for i in groups[t] if i is not None], default=None), len(groups[t]), r.doc_id == best(ids, default=None), hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [fold_ascii(r.text)]), key=str)
        for parts in (2, 50):  # with 50, the group of copies is counted apart
            assert sorted(map(tuple, exact_dedup.exact_dedup(docs, keep, parts).collect()), key=str) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sets(t):
    w = words(fold_ascii(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute_components(items):
    own = {i: sets(t) for i, t in items}
    up = {i: i for i in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in own:
        for b in own:
            if a < b and (n := len(own[a] & own[b])) and 100 * n >= 85 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in own}


def test_near_duplicates(spark, docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).where("doc_id is not null").collect()}
    assert got == brute_components([(i, t) for i, t in enumerate(TEXTS)])
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("params", [neardup.NearParams(), neardup.NearParams(small=1, block=8), neardup.NearParams(small=1, block=8, leaders=1)])
def test_near_duplicates_in_a_large_group(spark, params):
    r = random.Random(3)
    base = [r.choice(WORDS) for _ in range(150)]
    items = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(WORDS) + "x"
        items.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(items, "doc_id long, text string"), params).collect()}
    assert got == brute_components(items)


def test_near_copies_cost_a_row_each(spark, monkeypatch):
    """A group of near copies is held against its leaders: no pairs of blocks inside its tree."""
    r = random.Random(4)
    base = [r.choice(WORDS) for _ in range(200)]
    items = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i in range(300) for k in [r.randrange(200)]]
    items += [(1000 + i, " ".join(base[:60] + [f"y{i}-{k}" for k in range(140)])) for i in range(3)]
    dealt = []
    real = neardup._in_blocks

    def counted(rows, params):
        out = real(rows, params)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_in_blocks", counted)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(items, "doc_id long, text string"), neardup.NearParams(block=16)).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in items}
    assert dealt[-1] < 300 * 3  # in pairs of blocks of 16 all would be there 19 times


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(texts, p):
    """Texts less what goes: lines in the order of first places, each for the earliest line alike that stays."""
    places = [(i, k, fold_ascii(x.strip(" \t\n\x0b\x0c\r"))) for i, t in texts for k, x in enumerate((t or "").split("\n"))]
    first, n = {}, collections.Counter(x for _, _, x in places if len(x) >= max(1, p.least_exact))
    for i, k, x in sorted(places):
        first.setdefault(x, (i, k))
    alike = lambda x, y: min(len(x), len(y)) >= p.least_chars and abs(len(x) - len(y)) <= p.distance and lev(x, y) <= p.distance
    leader, stay, size = {}, [], collections.Counter()
    for x in sorted(n, key=first.get):
        leader[x] = next((y for y in stay if alike(x, y)), x)
        if leader[x] == x:
            stay.append(x)
        size[leader[x]] += n[x]
    goes = lambda i, k, x: x in n and size[leader[x]] >= p.repeats and (leader[x] != x or (i, k) != first[x])
    gone = {(i, k) for i, k, x in places if goes(i, k, x)}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in texts}


@pytest.mark.parametrize("tau, repeats, exact", [(1, 2, 1), (2, 2, 1), (3, 2, 1), (2, 4, 12)])
def test_line_dedup(spark, tau, repeats, exact):
    r = random.Random(tau + repeats)
    base = [text(r.randint(3, 8), r) for _ in range(6)] + ["é😀" * 16, "short", " ", text(14, r), "z" * 66]

    def edited(x):
        x = list(x)
        for _ in range(r.randint(0, tau + 1)):
            k = r.choice([0, len(x), r.randrange(len(x) + 1)])
            x[k : k + r.randint(0, 1)] = r.choice(["", "q", "z", "é"])
        return "".join(x)

    texts = [(i, "\n".join(edited(r.choice(base)) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(71, None), (72, "")]
    p = line_dedup.LineParams(distance=tau, least_chars=16, repeats=repeats, least_exact=exact)
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'a' as line", "'b' as dropped_id", "'c' as dropped_lines")
    out = line_dedup.dedup_lines(df, p).collect()
    assert {x.doc_id: x.text for x in out} == brute_lines(texts, p)
    assert all((x.line, x.dropped_id, x.dropped_lines) == ("a", "b", "c") for x in out)
    assert sum(x.line_dedup.n_dropped for x in out) > 5


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_bit_parallel_distance(spark, tau):
    r = random.Random(tau)
    pairs = [("", "a"), ("", ""), ("ab", ""), ("abc" * 30, "abc" * 30)]
    for _ in range(400):
        x = "".join(r.choice("abé😀") for _ in range(r.randint(0, 70)))
        y = list(x)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randint(0, 1)] = r.choice(["", "q", "é", "😀"])
        pairs.append((x, "".join(y)))
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.within(F.col("x"), F.col("y"), tau).alias("near")).collect()
    assert all(v.near == (lev(v.x, v.y) <= tau) for v in rows)


def test_lower_ascii_is_that_of_every_character(spark):
    rows = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.to_binary(F.lpad(F.hex("id"), 8, "0"), F.lit("hex")), "utf-32").alias("c"))
    rows = rows.select(F.concat("c", F.lit("AZaz")).alias("t"))
    assert rows.where(lower_ascii(F.col("t")) != F.translate("t", common.A_Z, common.a_z)).count() == 0


def test_settled_lines_leave_a_neighbour(spark):
    """A~B~C, A and C apart: C stays, as B, its only earlier neighbour, goes for A."""
    a, b, c = "invoice number one aa bb cc", "invoice number one xx bb cc", "invoice number one xx yy cc"
    chain = [f"row {'z' * i}{'a' * (24 - i)} end of row" for i in range(0, 24, 2)]  # each is near the next one only
    texts = [(10 * k + i, x) for k, x in enumerate([a, b, c, *chain]) for i in range(6)] + [(1000 + i, "a line that occurs only twice") for i in range(2)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, line_dedup.LineParams(repeats=6, least_exact=20)).collect()}
    kept = {i for i, x in out.items() if x}
    assert kept == {0, 20, *(30 + 10 * k for k in range(0, len(chain), 2)), 1000, 1001}
    docs = df.selectExpr("doc_id", "text", "'en' as lang")
    assert {r.doc_id for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == kept


def test_line_dedup_edges(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and out.where("doc_id is null").first().text == "null id text here"
    assert line_dedup.dedup_lines(none).count() == 0


def test_secrets(spark, docs, none):
    kinds = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    more = ["é token='a1b2c3d4' token=secret=abcdefg tOkEn : zzz", "api_key=xx apikey==yyyyyyyy", "f" * 23 + " " + "f" * 24]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in rows.join(secrets.find_secrets(rows), "doc_id").collect():
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(r.text or "") if len(m[g]) >= least)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest()
    assert secrets.find_secrets(docs).count() == docs.count()
    assert secrets.find_secrets(none).count() == 0
    red = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert red[12].startswith("[assign]' and [assign] secret=ab [access] ") and red[8] == LONG and red[0] is None


def test_weak_candidates_need_their_other_part(spark):
    weak, strong = "client_id = user99", "AKIA" + "B" * 16
    texts = [(0, f"{weak} x password = hunter22"), (1, weak), (2, f"{weak} {'y ' * 200} password = hunter22"), (3, f"see https://host.example/x {weak} password = hunter22"), (4, f"https://host.example {strong}")]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert "id:0:18" in got[0] and got[1] == "" and "id:" not in got[2] and "endpoint:4:24" in got[3] and "endpoint" not in got[4]


def test_linked_spans_are_those_of_all_pairs(spark):
    """Against a comparison of every weak candidate with every part of its text; some texts have more matches than a fold lists at once."""
    r = random.Random(12)
    bits = ["client_id = user77", "password: hunter22", "secret=abcdefgh", "https://host.example", "a.b@mail.example.org", "host: db01.local", "AKIA" + "C" * 16, "Q" * 34, "0123456789abcdef" * 2, "filler text é", "user=ab", "x@y"]
    texts = [(i, " ".join(r.choice(bits) + " " + "w" * r.randint(0, 30) for _ in range(r.randint(0, 14)))) for i in range(80)]
    texts += [(80, " ".join(r.choice(bits[:6]) for _ in range(900))), (81, "a@b " * 5 + "w" * 200_000)]
    scope, found = 40, {}
    kinds = [(k, re.compile(p, re.A), 2 if k in secrets.NAMED else 0, n, part) for k, p, n, part in (*secrets.BASE, *secrets.WEAK)]
    for i, t in texts:
        spans = {k: [(m.start(), n, m.end(), part) for m in p.finditer(t) if len(m[g]) >= least] for n, (k, p, g, least, part) in enumerate(kinds)}
        base = [s for k, *_ in secrets.BASE for s in spans[k]]
        weak = [s for k, *_ in secrets.WEAK for s in spans[k] if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        near = lambda s, part: any(o[3] == part and abs(o[0] - s[0]) <= scope for o in base + weak)
        linked = [s for s in weak if all(near(s, part) for part in secrets.NEEDS[s[3]])]
        found[i] = (len(linked), ",".join(f"{secrets.ORDER[k]}:{a}:{b}" for a, k, b, _ in sorted(base + linked)))
    got = {x.doc_id: (x.n_linked, x.spans) for x in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), scope).collect()}
    assert got == found and sum(n for n, _ in found.values()) > 100


def test_quality_statistics(docs, none):
    for r in docs.select("doc_id", "text").join(quality_rules.apply(docs, []), "doc_id").collect():
        w, seen, dup, inside = words(r.text), set(), 0, set()
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        for places in at.values():
            if len(places) > 1:
                inside |= {i + k for i in places for k in range(5)}
        for line in (r.text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), dup, len(inside))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
    assert quality_rules.apply(none, []).count() == 0


def test_rules_find_a_planted_conjunction(spark):
    r = random.Random(1)
    rows = [{f: r.random() for f in quality_rules.FEATURES} for _ in range(900)]
    for x in rows:
        x["low"] = int(x["symbol_share"] > 0.6 and x["upper_share"] <= 0.5)
    rules = quality_rules.learn(rows)
    hits = [any(quality_rules._holds(x, rule) for rule in rules) for x in rows]
    assert sum(h == bool(x["low"]) for h, x in zip(hits, rows)) > 870
    df = spark.createDataFrame([tuple(x[f] for f in quality_rules.FEATURES) for x in rows], list(quality_rules.FEATURES))
    assert [bool(v.rule) for v in df.select(quality_rules.expression(rules).alias("rule")).collect()] == hits
    assert quality_rules.learn([]) == []


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = packing.pack(docs, pack_params()).toPandas()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            want[r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    got = collections.Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == want
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 4096
    assert packing.pack(none, pack_params()).count() == 0


def test_packing_looks_up_each_word_of_a_block_once(monkeypatch):
    """Ids are the library's, whatever the store and the blocks hold, and a word that comes again in a block is not looked up again."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(path := P.path("word_bpe_49k.json")), random.Random(4)
    odd = [*TEXTS, "<|startoftext|>a <|endoftext|>", "I'd've 's 'S we'LL", "é ́x Å", "\t\r\n the\tthe", "".join(map(chr, range(33, 256))), " ".join(map(chr, range(33, 256)))]
    odd += ["".join(r.choice("aeinrstLO 日é😀\n'1²ª_µßÀ́\xad\x85\t") for _ in range(r.randint(1, 300))) for _ in range(100)]
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in odd]
    for most, block in ((1_600_000, 6_000_000), (3000, 20_000), (1, 1)):
        monkeypatch.setattr(packing, "BLOCK", block)
        words, got = packing.WordIds(path, most, 1), []
        for at, ids, n in words(pa.array(odd, pa.string())):
            assert at == len(got)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want and words.lower

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    monkeypatch.setattr(packing, "BLOCK", 6_000_000)
    words = packing.WordIds(path, 1_600_000, 1)
    words.known = Counted(words.known)
    assert sum(len(ids) for _, ids, _ in words(pa.array([" ".join(WORDS)] * 50))) == 50 * len(tok.encode(" ".join(WORDS)).ids) + 50
    assert Counted.asked <= 2 * len(set(WORDS))


def test_packing_plan_is_near_the_bound():
    r = random.Random(5)
    lengths = collections.Counter(min(4096, int(r.lognormvariate(6, 1)) + 1) for _ in range(5000))
    p = packing.PackParams("")
    plan = packing.plan(dict(lengths), p)
    used = collections.Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 4096
        for k in pattern:
            used[k] += n
    assert used == lengths
    assert sum(n for _, n in plan) <= 1.01 * sum(k * n for k, n in lengths.items()) / 4096 + 1
    assert packing.plan({}, p) == []


def test_sentencepiece_codec(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = sp_codec.Codec(sp_codec.CodecParams(path, dropout=0.0))
    for t in [t for t in TEXTS if t and "▁" not in t]:
        assert np.frombuffer(plain.encode(t), "<u4").tolist() == sp.encode(t)
    p = sp_codec.CodecParams(path)
    rows = sp_codec.encode_documents(docs, p).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    a, b, c = (sp_codec.Codec(sp_codec.CodecParams(path, seed=s)).encode(BASE) for s in (1, 1, 2))
    assert a == b != c and len(a) > len(plain.encode(BASE)) and plain.decode(a) == BASE
    assert sp_codec.encode_documents(none, p).count() == 0


def test_sentencepiece_draws_every_occurrence(spark):
    """One word many times in a text, and one text in many documents, are segmented in many ways."""
    codec = sp_codec.Codec(sp_codec.CodecParams(path := P.path("piece_bpe_32k.model")))
    word, seen = "international", collections.Counter()
    for d in range(20):
        ids = codec.encode(" ".join([word] * 100), d)
        pieces = [codec.pieces[i] for i in np.frombuffer(ids, "<u4")]
        seen.update("".join(f"|{x}" for x in pieces).split(f"|{sp_codec.BLANK}"))
    assert len(seen) > 10
    one = [codec.encode(word, d) for d in range(400)]
    assert len(set(one)) > 8
    # An occurrence that skips a candidate, and one that skips none, come out as without what is remembered.
    text = " ".join(WORDS[:50]) + " " + word
    units = sp_codec._UNITS.findall(" " + text)
    codec._remember(units)
    key = np.arange(len(units), dtype=np.uint64) * np.uint64(0x1234567890ABCDEF)
    number = np.array([codec.known[u] for u in units])
    ends, of = codec.ends.runs(number)
    hit = np.zeros(len(units), bool)
    hit[of[codec._skipped(key[of], ends)]] = True
    assert 0 < hit.sum() < len(units)
    for k, x in enumerate(codec._merge(number, key)[0]):
        assert hit[k] or x == codec.plain[number[k]]
    rate = codec._skipped(np.arange(200_000, dtype=np.uint64), np.full(200_000, 3, np.uint64)).mean()
    assert abs(rate - 0.1) < 0.005
    rows = spark.createDataFrame([(i, BASE) for i in range(40)], "doc_id long, text string")
    assert len({r.ids for r in sp_codec.encode_documents(rows, sp_codec.CodecParams(path)).collect()}) == 40


def plain_merges(codec, unit, key):
    """The definition: of all neighbours whose join is a piece and is not skipped, the best scored, leftmost first, again and again."""
    merges = dict(zip(codec.keys.tolist(), codec.joined.tolist()))
    parts = [(codec.symbols.runs(np.array([codec.known[unit]]))[0].tolist()[i], i, i + 1) for i in range(len(unit))]
    while True:
        found = []
        for i, ((a, s, m), (b, _, e)) in enumerate(zip(parts, parts[1:])):
            joined = merges.get(a * codec.n + b) if a >= 0 and b >= 0 else None
            if joined is not None and not codec._skipped(np.array([key], np.uint64), np.array([s + (m << 21) + (e << 42)], np.uint64))[0]:
                found.append((-codec.scores[joined], i, joined))
        if not found:
            return [p for p, _, _ in parts]
        _, i, joined = min(found)
        parts[i : i + 2] = [(joined, parts[i][1], parts[i + 1][2])]


def test_sentencepiece_dropout_is_the_plain_loop():
    codec = sp_codec.Codec(sp_codec.CodecParams(P.path("piece_bpe_32k.model"), dropout=0.3))
    r = random.Random(8)
    units = ["international", "thethethe" * 5, *("".join(r.choice("aeinrst") for _ in range(n)) for n in (1, 2, 40, 98, 99, 100, 101, 102, 150))]
    codec._remember(units)
    for k, u in enumerate(units):
        number, key = np.array([codec.known[u]]), np.array([k * 987654321987654321 % 2**64], np.uint64)
        want = plain_merges(codec, u, int(key[0]))
        assert np.frombuffer(codec._merge(number, key)[0][0], "<u4").tolist() == want
        long = codec._merge_long(codec.symbols.runs(number)[0].tolist(), int(key[0]))[0]
        assert np.frombuffer(long, "<u4").tolist() == want
        ends, met = codec.ends.runs(number)[0], codec._merge_long(codec.symbols.runs(number)[0].tolist(), None)[1]
        assert sorted(set(ends.tolist())) == sorted(set(met.tolist()))


def test_sentencepiece_new_units_are_cheap():
    """Units of many lengths merged in one call come out as by the plain loop, and 3,000 new ones of 80 to 98 letters cost less than 10 loops to two million (measured: 4.7; 22 when whole lines moved at every join)."""
    path, r = P.path("piece_bpe_32k.model"), random.Random(21)
    codec = sp_codec.Codec(sp_codec.CodecParams(path, dropout=0.2))
    units = ["".join(r.choice("aeinrst 日é😀") for _ in range(r.randint(1, 60))) for _ in range(150)]
    codec._remember(units)
    key = np.arange(len(units), dtype=np.uint64) * np.uint64(0x1234567890ABCDEF)
    got = codec._merge(np.array([codec.known[u] for u in units]), key)[0]
    for u, k, x in zip(units, key.tolist(), got):
        want = [i for p in plain_merges(codec, u, k) for i in ([p] if p >= 0 else [codec.bytes[b] for b in chr(-2 - p).encode()])]
        assert np.frombuffer(x, "<u4").tolist() == want
    pairs = np.append(codec.keys, np.setdiff1d(np.arange(0, codec.n**2, 9973), codec.keys))
    assert codec._found(pairs).tolist() == [*range(len(codec.keys)), *[-1] * (len(pairs) - len(codec.keys))]

    def cpu(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    words = " ".join("".join(r.choice("aeinrstlohd") for _ in range(r.randint(80, 98))) for _ in range(3000))
    fresh = [sp_codec.Codec(sp_codec.CodecParams(path)) for _ in range(3)]
    assert min(cpu(lambda: c.encode(words, 1)) for c in fresh) < 10 * min(cpu(lambda: sum(range(2_000_000))) for _ in range(9))


def test_sentencepiece_long_words():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, plain, dropped = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.Codec(sp_codec.CodecParams(path, dropout=0.0)), sp_codec.Codec(sp_codec.CodecParams(path))
    r = random.Random(9)
    word = "".join(r.choice("aeinrstlo") for _ in range(5000))
    assert np.frombuffer(plain.encode(word), "<u4").tolist() == sp.encode(word)
    began, long = time.time(), "".join(r.choice("aeinrstlo日本é") for _ in range(200_000))
    assert dropped.decode(dropped.encode(long, 5)) == long and time.time() - began < 60


def test_lm_score(docs, none):
    out = {r.doc_id: r for r in lm_score.fit_score(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))[0].collect()}
    tok = {i: [w.encode() for w in words(fold_ascii(t))] + [b"\n"] for i, t in enumerate(TEXTS)}
    c = collections.Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tok.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * abs(r.base_score) + 1e-9
        assert r.score < 0
    assert lm_score.fit_score(docs)[0].count() == docs.count()
    out, model = lm_score.fit_score(none)
    assert out.count() == 0 and lm_score.score(docs, model).count() == docs.count()


def plain_scores(items, p, false_rate=0):
    """Scores by exact counts: what each level stands for over the sums of it."""
    tok = [(i, [w.encode() for w in words(fold_ascii(t))] + [b"\n"]) for i, t in items]
    train = [t for i, t in tok if zlib.crc32(str(i).encode()) % p.folds != p.held_out]
    c = collections.Counter(w for t in train for w in t)
    both = collections.Counter(x for t in train for x in zip([b"\n", *t], t))
    size = lambda x: 0 if not x else 1 if x == 1 else 0.75 * 2.0 ** (int(np.log2(x)) + 1)
    mass, follows = sum(map(size, c.values())), collections.Counter()
    for (a, _), x in both.items():
        follows[a] += size(x)

    def log(a, w):
        word = (size(c[w]) + 1) / (mass + len(c) + 1)
        return np.log10(0.3 * size(both[a, w]) / follows[a] + 0.7 * word if follows[a] else word)

    return {i: sum(log(a, w) for a, w in zip([b"\n", *t], t)) for i, t in tok}


@pytest.mark.parametrize("repeat", [1, 3])
def test_lm_score_counts_all_pairs(spark, repeat):
    """Scores against exact counts: pairs seen once are in the model, and what is in it does not depend on its size."""
    r = random.Random(6)
    items = [(i, text(r.randint(0, 60), r)) for i in range(300)] * repeat
    p = lm_score.LmParams(bits_per_event=64, probes=20)
    want = plain_scores(items, p)
    got = [(x.doc_id, x.score) for x in lm_score.fit_score(spark.createDataFrame(items, "doc_id long, text string"), p)[0].collect()]
    assert len(got) == len(items)
    assert all(abs(s - want[i]) <= 1e-5 * abs(want[i]) + 1e-9 for i, s in got)


def test_probabilities_sum_to_one(spark):
    """After words of many and few followers, frequent and rare ones, over all words and one that is unknown."""
    r = random.Random(8)
    vocabulary = WORDS + ["the"] * 150
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80)))) for i in range(200)]
    model = lm_score.fit(spark.createDataFrame(items, "doc_id long, text string"), lm_score.LmParams(least_segments=4))
    table = {x.segment: lm_score._loaded(x.asDict(), model.params) for x in model.table.collect()}
    frequent = lm_score._known(model)
    known = sorted({w for i, t in items if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()})
    assert frequent.shape[1] and frequent[1].max() > 1 and model.types == len(known) + 1
    for v in ["the", "unknown", *known[::40]]:
        # "v w" for all words, the end token (as an empty text after "v") and an unknown one: every second token is asked about.
        h, _ = common.span_hashes([[x.encode() for w in [*known, "unknown"] for x in (v, w)] + [v.encode()]])
        tokens = np.append(h, lm_score._END_HASH)
        w, places = np.unique(tokens, return_inverse=True)
        b = lm_score._Block(w.tobytes(), lm_score._planes(places), np.array([len(tokens)]), frequent, model.segments)
        logs = lm_score.token_logs(model, b, lm_score.looked_up(model, b, table, frequent))
        assert abs((10 ** logs[1::2]).sum() - 1) < 0.01


def test_filter_levels():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    top = r.integers(0, 6, 3000)
    f = lm_score.build(h, np.where(top > 0, 2 ** np.maximum(top - 1, 0), 0), lm_score.LmParams())
    got = lm_score.levels(f, h)
    assert (got >= top).all() and (got == top).mean() > 0.95  # a level is never missed, rarely overstated
    assert (lm_score.levels(f, r.integers(0, 1 << 63, 3000, dtype=np.uint64)) == 0).mean() > 0.9


def test_scores_in_many_blocks(spark):
    """Long texts, and blocks of one text each, are scored as in one block."""
    items = [(i, text(random.Random(i).randint(0, 300))) for i in range(60)] + [(60, LONG), (None, "a b"), (60, LONG)]
    df = spark.createDataFrame(items, "doc_id long, text string").coalesce(2)
    one, many = (sorted(map(str, ((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.fit_score(df, lm_score.LmParams(block_chars=k, bits_per_event=64))[0].collect()))) for k in (1 << 30, 50))
    assert one == many and len(one) == 63


def test_models_are_kept_and_probed(spark, tmp_path):
    """A saved model gives the same scores, broadcast or asked in segments, and whatever splits files have in between."""
    r = random.Random(9)
    items = [(i, text(r.randint(0, 90), r)) for i in range(150)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(12)
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = lambda x: sorted((y.doc_id, y.n_known, round(y.base_score, 7), round(y.score, 7)) for y in x.collect())
    spark.conf.set("spark.sql.files.minPartitionNum", "6")
    try:
        out, model = lm_score.fit_score(docs)
        model.save(str(tmp_path / "model"))
        spark.conf.set("spark.sql.files.minPartitionNum", "5")
        want = rows(out)
        for most in (0, 1 << 40):
            kept = lm_score.load(spark, str(tmp_path / "model"), lm_score.LmParams(broadcast_bytes=most))
            assert rows(lm_score.score(docs, kept)) == want
        assert rows(lm_score.score(docs, lm_score.fit(docs))) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_language_id(spark, docs, none):
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    r = random.Random(2)
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(r.randint(3, 40)))
    rows = [(i, make(alphabets[k]), k) for i, k in enumerate(r.choice(list(alphabets)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    out = {x.doc_id: x["ecoc"] for x in langid.predict(df, model).collect()}
    assert sum(out[i].lang_pred == k for i, _, k in rows) >= 298
    assert {x.doc_id for x in langid.predict(docs, model).where("ecoc.lang_pred = 'und'").collect()} == {0, 1, 2, 10}
    assert langid.predict(none, model).count() == 0
    assert langid.predict_texts(langid.train(none), ["text"]).lang_pred.tolist() == ["und"]
    codes = langid.codewords(8)
    assert (codes @ codes.T - np.eye(8) * codes.shape[1]).max() < 0.6 * codes.shape[1]


def test_language_far_from_all_is_flagged(spark):
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    r = random.Random(2)
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(r.randint(3, 40)))
    rows = [(make(alphabets[k]), k) for k in (r.choice(list(alphabets)) for _ in range(400))]
    model = langid.fit([t for t, _ in rows], [k for _, k in rows])
    known = langid.predict_texts(model, [make(a) for a in alphabets.values() for _ in range(100)])
    other = langid.predict_texts(model, [make("uvwxyz") for _ in range(100)] + [make("жзийклмн") for _ in range(100)])
    assert known.ambiguous.mean() < 0.02 and other.ambiguous.mean() > 0.95
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)] + [(1000 + i, make("uvwxyz"), None) for i in range(20)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert len(kept & set(range(400))) > 390 and len(kept & set(range(1000, 1020))) < 2


def test_near_dedup_keeps_one_row(spark):
    rows = [(1, BASE, "b"), (1, BASE, "a"), (1, BASE, None), (2, text(50), "x"), (None, one := text(40), "q"), (None, one, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == sorted([(1, BASE), (2, rows[3][1]), (0, one)])


def test_toxicity(spark, docs, none):
    r = random.Random(4)
    rows = [(i, text(40, r) + (" vilestuff nastyword" if i % 9 == 0 else ""), int(i % 9 == 0)) for i in range(600)]
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {x.doc_id: x.predicted for x in toxicity.score(df, model).collect()}
    assert sum(got[i] == y for i, _, y in rows) > 590
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_pipeline(spark, docs, none, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    for name, table in (("docs", docs.drop("row", "key", "rank", "norm")), ("none", none)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "docs")).toPandas()
    ids = set(out.doc_id.dropna().astype(int))
    assert {0, 1, 2, 10}.isdisjoint(ids)  # no letter
    assert 4 in ids and {5, 6}.isdisjoint(ids) and {8, 11, 12, 15} <= ids
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages_are_their_plain_forms(spark):
    """Each stage on what the stage before kept, against Python over the same rows."""
    r = random.Random(21)
    banner, near = "All rights of this page are kept by its owner", text(80, r).split()
    items = [(i, f"{text(r.randint(20, 60), r)}\n{banner}{'.' * (i % 2)}\n{text(9, r)}") for i in range(12)]
    items += [(20 + i, " ".join([*near[: 10 + i], "new", *near[11 + i :]])) for i in range(4)] + [(30, banner), (31, "12 34"), (32, None), (33, "theé token = 'abcdef123456' a.b@mail.example.org")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in items], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {x.doc_id: x.text for x in df.collect()}

    one = stages["language_id"](spark, docs, "")
    assert one.columns == docs.columns
    model = langid.train(docs)
    plain = langid.predict_texts(model, [t for _, t in items])
    assert rows(one) == {i: t for (i, t), p in zip(items, plain.itertuples()) if p.lang_pred != "und" and not p.ambiguous} == {i: t for i, t in items if i not in (31, 32)}

    two = stages["line_dedup"](spark, one, "")
    deduped = brute_lines(sorted(rows(one).items()), line_dedup.LineParams(repeats=6, least_exact=20))
    want = {i: t for i, t in deduped.items() if t.strip()}
    assert rows(two) == want and 30 not in want and sum(banner in t for t in want.values()) == 1
    assert all(x.n_chars == len(x.text) for x in two.collect())

    three = stages["near_dedup"](spark, two, "")
    kept = {i for i, (_, c) in brute_components(sorted(want.items())).items() if i == c}
    assert rows(three) == {i: t for i, t in want.items() if i in kept} and len(kept & {20, 21, 22, 23}) < 4

    four = stages["secret_scan"](spark, three, "")
    spans = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in secrets.find_secrets(three).collect()}
    for i, t in rows(four).items():
        out, at = "", 0
        for kind, a, b in spans[i]:
            if int(a) >= at:
                out += rows(three)[i][at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        assert t == out + rows(three)[i][at:]
    assert rows(four)[33] == "theé [assign]' [email]"

    five = stages["best_fit_packing"](spark, four, "").collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in rows(four).items()}
    assert {(x.doc_id, x.length, x.ids_crc32) for x in five} == {(i, len(v), zlib.crc32(v.tobytes())) for i, v in ids.items()}
    assert len({x.sequence_id for x in five}) == 1


@pytest.mark.parametrize("block", [4, 256])
def test_templated_lines(spark, block):
    """Lines of one template, with numbers and small edits: the same as comparing all pairs, and no more rows than a multiple of the lines."""
    r = random.Random(block)
    forms = ["Order number {} was shipped to you", "{} in stock, price on demand today", "Total of this page {}", "x" * 30 + "{}" + "y" * 40]
    lines = [r.choice(forms).format(r.randint(1000, 1400)) for _ in range(220)]
    lines += [x[:k] + r.choice(["", "q", "7q"]) + x[k + r.randint(0, 1) :] for x in r.sample(lines, 40) for k in [r.randrange(len(x))]]
    r.shuffle(lines)
    texts = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(len(lines) // 5)]
    p = line_dedup.LineParams(block=block, rounds=2)
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), p).collect()
    assert {x.doc_id: x.text for x in out} == brute_lines(texts, p)


def test_numbered_lines_meet_few(spark, monkeypatch):
    r, rows = random.Random(1), {}
    real = line_dedup.staged

    def counted(df, name):
        out = real(df, name)
        if name in ("line-pairs", "line-cells"):
            rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "staged", counted)
    seen = {}
    for n in (500, 2000):
        rows.clear()
        docs = spark.createDataFrame([(i, f"Order number {r.randint(10**7, 10**8 - 1)} was shipped to the address that you gave.") for i in range(n)], "doc_id long, text string")
        assert line_dedup.dedup_lines(docs).count() == n
        seen[n] = dict(rows)
    assert all(rows["line-pairs"] < 8 * n and rows["line-cells"] < 150 * n for n, rows in seen.items())


@pytest.mark.parametrize("rounds", [1, 3])
def test_chains_are_settled_at_once(spark, rounds):
    """Each line two characters from the next, in order of places: every other pair is apart."""
    lines = ["a" * k + "b" * (70 - k) for k in range(0, 61)]
    texts = [(i, x) for i, x in enumerate(lines)]
    p = line_dedup.LineParams(rounds=rounds)
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), p).collect()
    assert {x.doc_id: x.text for x in out} == brute_lines(texts, p)
