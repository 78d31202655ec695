"""Line deduplication by a segment-partition edit join; DataFrame functions only.

A line of a document is trimmed and has A-Z lowered. Two lines are alike if they are
equal, or if both have `least_chars` code points or more and an edit distance of at most
`distance`. In the order of first places (doc_id, line number) a line stays unless an
earlier one that stays is alike; what goes, goes for the earliest such line. A line and
those that go for it form a class. In classes of `repeats` occurrences or more, all but
the first place of the line that stays are dropped; other classes are left alone, as are
blank lines and lines below `least_exact` code points.

The edit join: lines have length classes, and by the least length of its class a line is
cut into distance + 1 even segments: one at its start, one at its end, the others at
fixed places between. Of the edits between two lines, at least one falls into the first
and one into the last segment if neither is shared; so few are left that a middle one
is shared, less than `distance` places away. Each line therefore enters an index with its
segments and with the places that a middle one can move to; lines that end near the next
lower class enter that too. Index entries of one line alone go at once. The lines of an
entry with up to `block` lines meet there; the counts of all letters and digits are compared
in the join. The rest is verified by a banded bit-parallel edit distance.

Templates (numbered lines, prices, dates) put any number of lines under one segment. Lines of
fuller entries are indexed once more, by all but the two cells in which the edits are, at first
of four cells of a line; in index entries that are still fuller than `block` the cells are
halved, until a cell is a character. What differs then keeps lines apart: a line has a number
of entries that its length bounds, and meets as many lines as share one, not all that share a
template. Lines of up to `distance` characters more enter with the length of the shorter one,
and with what one edit moves between the cells. With a distance of 3, which takes three cells,
fuller entries are left whole.

Lines are settled in rounds, in the order of first places. After `rounds` rounds, connected lines
that still wait for each other are settled at once, in order, where they are up to four times `block`; only for more lines rounds go on. Equality of lines is that of two 64-bit hashes, of segments that
of one, which the verification makes good.

A null text is an empty one. Lines of rows with a null doc_id are left alone. Repeated
rows share their places: they keep and lose the same lines, and count each time. Other
columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from .common import SPACES, let, lower_ascii, released, staged, unused


@dataclass(frozen=True)
class LineParams:
    distance: int = 2
    #: Least code points of a line that can have neighbours, and of one whose copies go.
    least_chars: int = 20
    least_exact: int = 1
    repeats: int = 2
    #: Lines of an index entry that meet as they are, and rounds before connected lines are settled at once.
    block: int = 64
    rounds: int = 6


#: Characters that are counted, and the bits of a count; counts are compared on the circle of that many numbers.
LETTERS = "enirtasodlcumhpgfbvywkqz0123456789.-"
_BITS = 5
_COUNTS = [LETTERS[k : k + 12] for k in range(0, len(LETTERS), 12)]
_MEETS = ["id", "length", *(f"c{k}" for k in range(len(_COUNTS)))]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _class(length: Column) -> Column:
    """The least length of the class of a length; classes are wider than 3."""
    return length - F.when(length < 64, length % 4).otherwise(length % 16)


def _entries_of(line: Column, length: Column, least: Column, params: LineParams) -> list[Column]:
    """Hashes of the segments that a line of class `least` has, and of those that it can share with one."""
    tau = params.distance
    size = F.floor(least / (tau + 1)).cast("int")
    at = [(0, F.substring(line, F.lit(1), size)), (tau, F.substring(line, length - size + 1, size))]
    at += [(i, F.substring(line, i * size + 1 + shift, size)) for i in range(1, tau) for shift in range(1 - tau, tau)]
    return [F.xxhash64(least, F.lit(i), s) for i, s in at]


def index_entries(line: Column, length: Column, params: LineParams) -> list[Column]:
    """What a line has in the index, each a number or null; a line below least_chars has nothing there."""
    own, lower = _class(length), _class(F.greatest(length - params.distance, F.lit(params.least_chars)))
    long = length >= params.least_chars
    out = [F.when(long, e) for e in _entries_of(line, length, own, params)]
    return out + [F.when(long & (lower != own), e) for e in _entries_of(line, length, lower, params)]


def _letter_counts(line: Column, letters: str) -> Column:
    """The counts of some letters, mod 2**_BITS, in one number."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(letters):  # letters of one byte: octets count them
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND((1 << _BITS) - 1).cast("long"), _BITS * k))
    return out


def _letter_distance(a: Column, b: Column, n: int) -> Column:
    """At most twice the edits between lines with these counts of n letters."""
    out = F.lit(0).cast("long")
    for k in range(n):
        d = (F.shiftright(a, _BITS * k) - F.shiftright(b, _BITS * k)).bitwiseAND((1 << _BITS) - 1)
        out = out + F.least(d, (1 << _BITS) - d)
    return out


def within(x: Column, y: Column, tau: int) -> Column:
    """Whether the edit distance is at most tau (3 at most), by bit-parallel steps in a band.

    Bit k of a vector stands for the diagonal on which x is k - tau ahead of y; vector e
    has the diagonals that e edits reach. A character of y moves all diagonals at once:
    along where x has it too, and from vector e - 1 by a substitution, an insertion
    or a deletion.
    """
    width, mask = 2 * tau + 1, (1 << 2 * tau + 1) - 1

    def walked(a: Column) -> Column:
        def same(c: Column, j: Column) -> Column:
            at = lambda k: (j + (k - tau) >= 0) & F.coalesce(F.get(a, j + (k - tau)) == c, F.lit(False))
            return reduce(lambda u, v: u.bitwiseOR(v), (F.when(at(k), 1 << k).otherwise(0) for k in range(width)))

        def step(acc: Column, m: Column) -> Column:
            new: list[Column] = []
            for e in range(tau + 1):
                v = acc[f"e{e}"].bitwiseAND(m)
                if e:
                    old = acc[f"e{e - 1}"]
                    v = v.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(mask)
                new.append(v)
            return F.struct(*(v.alias(f"e{e}") for e, v in enumerate(new)))

        start = F.struct(*(F.lit(((1 << e + 1) - 1) << tau & mask).alias(f"e{e}") for e in range(tau + 1)))
        reached = F.aggregate(F.transform(F.split(y, ""), same), start, step, lambda acc: acc[f"e{tau}"])
        ahead = F.length(x) - F.length(y)
        return F.when(F.length(y) == 0, ahead <= tau).otherwise((F.abs(ahead) <= tau) & (F.getbit(reached, F.greatest(F.lit(0), F.least(F.lit(width - 1), ahead + tau))) == 1))

    return let(F.split(x, ""), walked)


def _key() -> Column:
    return F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")).alias("key")


def _place() -> Column:
    """doc_id and line number in one number, in their order; cheaper to aggregate than a struct."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")).alias("place")


def _occurrences(docs: DataFrame, params: LineParams) -> DataFrame:
    """doc_id, pos, line of all lines that take part."""
    rows = docs.where("doc_id is not null").select("doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "pos", F.trim(F.col("line"), F.lit(SPACES)).alias("line")).where(F.length("line") >= max(1, params.least_exact))
    return rows.select("doc_id", "pos", lower_ascii(F.col("line")).alias("line"))


def _met(rows: DataFrame, texts: DataFrame, params: LineParams) -> DataFrame:
    """Pairs a < b of ids that share an entry in rows (entry, id, own) and have near counts; one of the two is to be there with its own length and places."""
    dealt = rows.join(texts.select(*_MEETS), "id")
    side = lambda x: dealt.select("entry", F.col("own").alias(f"own_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in _MEETS))
    left, right = side("a").where("own_a"), side("b")
    twice = F.col("own_b") & (F.col("id_a") > F.col("id_b"))
    near = (F.col("id_a") != F.col("id_b")) & ~twice & (F.abs(F.col("length_a") - F.col("length_b")) <= params.distance)
    apart = sum((_letter_distance(F.col(f"c{k}_a"), F.col(f"c{k}_b"), len(x)) for k, x in enumerate(_COUNTS)), F.lit(0))
    pairs = left.join(right, (left["entry"] == right["entry"]) & near & (apart <= 2 * params.distance))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _cells(cells: int) -> Column:
    """The entry of a line in which all but the cells i and j (of so many) of a line of length `base` count; the line is `delta` longer, and what is between the cells is `moved` places on."""
    i, j, base, line = F.col("i"), F.col("j"), F.col("base"), F.col("line")
    edge = lambda k: F.floor(k * base / cells).cast("int")
    piece = lambda start, size: F.substring(line, start + 1, size)
    between = F.when(j > i + 1, piece(edge(i + 1) + F.col("moved"), edge(j) - edge(i + 1))).otherwise("")
    return F.xxhash64(F.lit(cells), base, i, j, piece(F.lit(0), edge(i)), between, piece(edge(j + 1) + F.col("delta"), base - edge(j + 1)))


def _moves(delta: int) -> list[int]:
    """Places that the first of two edits can move what follows, if both make a line `delta` longer."""
    return [[0, 1, -1], [0, 1], [1]][delta]


def _halves() -> Column:
    """The pairs of half cells in a pair of cells, with what can have moved between them."""
    i, j, out = F.col("i"), F.col("j"), []
    for a in (0, 1):
        for b in (0, 1):
            for moved in (0, 1, -1):
                x, y = 2 * i + a, 2 * j + b
                free = reduce(lambda u, v: u | v, ((F.col("delta") == d) & F.lit(moved in _moves(d)) for d in range(3)))
                known = F.when(j > i + 1, F.col("moved") == moved).otherwise(free)
                valid = (x <= y) & F.when(y > x + 1, known).otherwise(F.lit(moved == 0))
                out.append(F.when(valid, F.struct(x.cast("int").alias("i"), y.cast("int").alias("j"), F.lit(moved).alias("moved"))))
    return F.array_compact(F.array(*out))


def _full_entries(texts: DataFrame, params: LineParams) -> list[DataFrame]:
    """Pairs of ids of lines with entries fuller than a block, from all but two ever smaller cells."""
    cells = 4
    first = [(d, i, j, moved) for d in range(params.distance + 1) for i in range(cells) for j in range(i, cells) for moved in (_moves(d) if j > i + 1 else [0])]
    options = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("delta", "i", "j", "moved"), x))) for x in first))
    rows = texts.select("id", "line", "length", F.inline(options)).withColumn("base", F.col("length") - F.col("delta")).where(F.col("base") >= params.least_chars)
    columns, out = ["id", "base", "delta", "i", "j", "moved"], []
    while True:
        rows = staged(rows.select(*columns, _cells(cells).alias("entry")), "line-cells")
        own = (F.col("delta") == 0) & (F.col("moved") == 0)
        sizes = rows.groupBy("entry").agg(F.count("*").alias("n"), F.max(own).alias("any")).where("n > 1 and any").select("entry", "n")
        met = staged(rows.join(sizes, "entry"), "line-cells-met")
        last = (F.col("n") <= params.block) | (F.col("base") <= cells)
        out.append(staged(_met(met.where(last).select("entry", "id", own.alias("own")), texts, params), "line-pairs"))
        live = met.where(~last)
        done = live.isEmpty()
        released(rows)
        if done:
            released(met)
            return out
        rows = staged(live.select("id", "base", "delta", F.inline(_halves())).distinct(), "line-halves").join(texts.select("id", "line"), "id")
        cells *= 2


def similar_lines(lines: DataFrame, docs: DataFrame, params: LineParams) -> DataFrame:
    """Pairs (a, b) of keys of alike lines, each pair once; lines: key, doc_id, entries."""
    tau = params.distance
    entries = lines.select(F.col("key.h").alias("id"), F.explode("entries").alias("entry"))
    shared = staged(entries.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1"), "line-shared")
    met = staged(entries.join(shared, "entry"), "line-met")
    need = met.select("id").distinct()
    places = staged(lines.select("key", F.col("key.h").alias("id"), "doc_id").join(need, "id").select("key", "doc_id"), "line-places")
    # Texts are dealt by doc_id here and at the end, whatever the size of the other side, so that cost stays in proportion.
    texts = docs.select("doc_id", "text").join(places.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    texts = _occurrences(texts, params).select(_key(), "line").join(places.select("key"), "key", "left_semi").dropDuplicates(["key"])
    counts = (_letter_counts(F.col("line"), x).alias(f"c{k}") for k, x in enumerate(_COUNTS))
    texts = staged(texts.select("key", F.col("key.h").alias("id"), "line", F.length("line").alias("length"), *counts), "line-texts")
    full = F.col("n") > params.block if tau <= 2 else F.lit(False)
    pairs = [staged(_met(met.where(~full).select("entry", "id", F.lit(True).alias("own")), texts, params), "line-pairs")]
    hot = staged(met.where(full).select("id").distinct(), "line-full")
    if not hot.isEmpty():
        pairs += _full_entries(staged(texts.join(hot, "id"), "line-full-texts"), params)
    both = reduce(DataFrame.union, pairs)
    both = both.distinct() if len(pairs) > 1 else both
    text = lambda x, k, t: texts.select(F.col("id").alias(x), F.col("key").alias(k), F.col("line").alias(t))
    out = both.join(text("a", "ka", "x"), "a").join(text("b", "kb", "y"), "b").where(within(F.col("x"), F.col("y"), tau))
    for table in (shared, met, places, hot):
        released(table)
    return out.select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def _settled(live: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of connected lines, `most` at most, those that go (late) and, of others, the edges that are left."""
    parts = staged(connected_components(live, "early", "late"), "line-parts").select(F.col("node").alias("late"), "label")
    small = parts.groupBy("label").count().where(F.col("count") <= most).select("label")
    small = staged(parts.join(small, "label"), "line-small")
    before = live.groupBy("late").agg(F.collect_list("early.key.h").alias("before"))
    whole = small.join(before, "late", "left").select("label", F.struct("late", F.coalesce("before", F.array().cast("array<long>")).alias("before")).alias("x"))
    order = F.array_sort(F.collect_list("x"))
    stay = lambda xs: F.aggregate(xs, F.array().cast("array<long>"), lambda acc, x: F.when(F.arrays_overlap(acc, x["before"]), acc).otherwise(F.array_append(acc, x["late"]["key"]["h"])))
    found = whole.groupBy("label").agg(order.alias("xs")).select("xs", stay(F.col("xs")).alias("stay"))
    gone = found.select(F.explode(F.transform(F.filter("xs", lambda x: ~F.array_contains(F.col("stay"), x["late"]["key"]["h"])), lambda x: x["late"])).alias("late"))
    return gone, live.join(small.select("late"), "late", "left_anti")


def replaced_lines(lines: DataFrame, pairs: DataFrame, params: LineParams) -> DataFrame:
    """key and leader (the earliest line alike that stays) of the lines that go."""
    places = lambda x: lines.select(F.col("key").alias(x), F.struct("first", "key").alias(f"at_{x}"))
    edges = pairs.join(places("a"), "a").join(places("b"), "b")
    edges = staged(edges.select(F.least("at_a", "at_b").alias("early"), F.greatest("at_a", "at_b").alias("late")), "line-edges")
    gone, live, rounds = [], edges, 0
    while not live.isEmpty():
        rounds += 1
        if rounds == params.rounds + 1:
            new, rest = _settled(live, 4 * params.block)
            gone.append(staged(new, "line-gone"))
        else:
            stay = live.select("early").distinct().join(live.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
            gone.append(new := staged(live.join(stay, "early").select("late").distinct(), "line-gone"))
            rest = live.join(new, "late", "left_anti").join(new.withColumnRenamed("late", "early"), "early", "left_anti")
        before, live = live, staged(rest.select("early", "late"), "line-live")
        if before is not edges:
            released(before)
    if not gone:
        return edges.select(F.col("late.key").alias("key"), F.col("early.key").alias("leader"))
    gone = reduce(DataFrame.union, gone)
    led = edges.join(gone, "late").join(gone.withColumnRenamed("late", "early"), "early", "left_anti")
    return led.groupBy("late").agg(F.min("early").alias("early")).select(F.col("late.key").alias("key"), F.col("early.key").alias("leader"))


def verdicts(lines: DataFrame, gone: DataFrame, repeats: int) -> DataFrame:
    """key, stays (the place that stays, or null) of the lines of which any occurrence is dropped."""
    some = staged(gone.join(lines.select("key", "n"), "key"), "line-led")
    more = staged(some.groupBy(F.col("leader").alias("key")).agg(F.sum("n").alias("more")), "line-classes")
    led = lines.select("key", "first", "n").join(some.select("key"), "key", "left_anti").join(more, "key", "left")
    led = led.where((F.col("n") + F.coalesce("more", F.lit(0)) >= repeats) & (F.col("n") > 1)).select("key", F.col("first").alias("stays"))
    often = lines.select(F.col("key").alias("leader"), F.col("n").alias("own")).join(more.withColumnRenamed("key", "leader"), "leader").where(F.col("own") + F.col("more") >= repeats)
    return led.union(some.join(often, "leader").select("key", F.lit(None).cast(led.schema["stays"].dataType)))


def dedup_lines(docs: DataFrame, params: LineParams = LineParams(), into: str = "line_dedup") -> DataFrame:
    """docs with its text less the dropped lines, and n_lines and n_dropped in a struct column `into`, which is not to be one of docs."""
    if not 1 <= params.distance <= 3 or params.least_chars < 4 * (params.distance + 1):
        raise ValueError("distance: 1 to 3, and least_chars four times as many and 4 at least")
    found = _occurrences(docs, params)
    rows = found.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "doc_id", _place(), *(e.alias(f"e{i}") for i, e in enumerate(index_entries(F.col("line"), F.length("line"), params))))
    entries = rows.columns[4:]
    lines = rows.groupBy("h", "g").agg(F.min("place").alias("first"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *(F.max(e).alias(e) for e in entries))
    lines = staged(lines.select(F.struct("h", "g").alias("key"), "first", "doc_id", "n", F.array_distinct(F.array_compact(F.array(*entries))).alias("entries")), "lines")
    pairs = staged(similar_lines(lines, docs, params), "similar")
    verdict = staged(verdicts(lines, staged(replaced_lines(lines, pairs, params), "line-led-by"), params.repeats), "verdicts")
    dropped = found.select(_key(), "doc_id", "pos").join(verdict, "key").where(F.col("stays").isNull() | (_place() != F.col("stays")))
    own, lost = unused(docs, "dropped_id"), unused(docs, "dropped_lines")
    dropped = staged(dropped.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("pos").alias(lost)), "dropped")

    rows = docs.join(dropped.hint("merge"), F.col("doc_id") == F.col(own), "left")

    def kept(marks: Column) -> Column:
        return F.transform(F.filter(marks, lambda m, j: (m["d"] == 1) & ~((F.get(marks, j - 1)["i"] == m["i"]) & (j > 0))), lambda m: m["l"])

    split = _lines(F.col("text"))
    marks = F.array_sort(F.concat(F.transform(split, lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("d"), x.alias("l"))), F.transform(lost, lambda p: F.struct(p.alias("i"), F.lit(0).alias("d"), F.lit("").alias("l")))))
    text = F.when(F.col(lost).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(let(marks, kept), "\n"))
    counts = F.struct(F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"))
    return rows.withColumns({into: F.when(F.col(lost).isNull(), counts.withField("n_dropped", F.lit(0).cast("long"))).otherwise(counts), "text": text}).drop(own, lost)
