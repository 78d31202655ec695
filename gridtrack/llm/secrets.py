"""Secret scans by multipart credential linking; DataFrame functions only.

Three kinds of match are reported always: assignments, access identifiers and long
hex runs. Weaker candidates (other identifiers and mail
addresses, opaque secrets, endpoints) are
reported only when complementary parts stand within `scope` code points in the same
text: an identifier needs a secret, a secret an identifier, an endpoint both. The
interval join deals parts out to buckets of `scope` code points and keeps of each
bucket and part the first and last place only, which decides the distance test
exactly without any pair of candidates in a bucket.

Null counts as empty: no spans. Repeated rows get the same spans each. Places are code
points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, unused


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ID_NAMES = "|".join(map(_either_case, ("client_?id", "access_?key_?id", "access_?id", "account", "login", "username", "user_?id", "user", "e-?mail")))
HOST_NAMES = "|".join(map(_either_case, ("hostname", "host", "server", "endpoint", "url")))
#: kind, pattern that ends up in spans, least length of group 2 or of the match, part that it plays.
BASE = (("assign", ASSIGN, 6, "secret"), ("access", ACCESS, 20, "id"), ("hex", r"[0-9a-f]{24,}", 24, "secret"))
WEAK = (
    ("id", rf"""({ID_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 3, "id"),
    ("secret", r"[A-Za-z0-9+/]{32,}={0,2}", 32, "secret"),
    ("endpoint", r"[a-z]{2,8}://[A-Za-z0-9._:-]+", 8, "endpoint"),
    # The look behind keeps a long run of such characters from being tried at each of them.
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", 6, "id"),
    ("host", rf"""({HOST_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.:/-]+)""", 3, "endpoint"),
)
#: Kinds whose pattern has a name and a value.
NAMED = ("assign", "id", "host")
#: Matches that a fold lists at once: longer lists are put together from such runs.
RUN = 256
ORDER = [k for k, *_ in (*BASE, *WEAK)]
NEEDS = {"id": ["secret"], "secret": ["id"], "endpoint": ["id", "secret"]}
SPAN = "struct<start: int, kind: int, end: int>"


def _spans(text: Column, kind: str, pattern: str, least: int) -> Column:
    """All leftmost matches with their places: what split() leaves between matches gives the distances."""
    number = ORDER.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind in NAMED else found
    steps = F.transform(
        F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(value, F.length).alias("value")),
        lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (x["value"] >= least).alias("ok")),
    )
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")

    def walked(run: Column) -> Column:
        """Characters that a run takes, and its spans from its beginning."""
        return F.aggregate(
            run,
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.when(x["ok"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(number).alias("kind"), (acc["at"] + x["gap"] + x["size"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
            ),
        )

    def all_runs(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: walked(F.slice(steps, i * RUN + 1, RUN)))
        moved = lambda acc, r: F.transform(r["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("spans")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["spans"], moved(acc, r)).alias("spans")), lambda acc: acc["spans"])

    return F.when(text.rlike(pattern), let(F.filter(steps, lambda x: x["size"].isNotNull()), all_runs)).otherwise(none)


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the row's content (k1, k2), the spans of each kind, and those of the three base kinds together."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *_keys(), *(_spans(F.col("text"), k, p, n).alias(k) for k, p, n, _ in BASE), *(_spans(F.col("text"), k, p, n).alias(f"weak_{k}") for k, p, n, _ in WEAK))
    return staged(rows.withColumn("base", F.array_sort(F.concat(*(k for k, *_ in BASE)))), "secrets")


def _keys() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """k1, k2 and the weak candidates that complementary parts confirm, as array `linked`."""
    weak = F.filter(F.concat(*(F.col(f"weak_{k}") for k, *_ in WEAK)), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    roles = F.array(*(F.lit(part) for *_, part in (*BASE, *WEAK)))
    parts = (
        rows.withColumn("weak", weak).where(F.size("weak") > 0)
        .select("k1", "k2", F.explode(F.concat("base", "weak")).alias("s"))
        .distinct()
        .select("k1", "k2", "s", F.get(roles, F.col("s.kind")).alias("part"), F.floor(F.col("s.start") / scope).alias("bucket"))
    )
    ends = parts.groupBy("k1", "k2", "bucket", "part").agg(F.min("s.start").alias("first"), F.max("s.start").alias("last"))
    near = (
        parts.where(F.col("s.kind") >= len(BASE))
        .select("k1", "k2", "s", F.col("part").alias("own"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
        .join(ends, ["k1", "k2", "bucket"])
        .where((F.col("part") != F.col("own")) & ((F.abs(F.col("first") - F.col("s.start")) <= scope) | (F.abs(F.col("last") - F.col("s.start")) <= scope)))
    )
    linked = near.groupBy("k1", "k2", "s", "own").agg(F.collect_set("part").alias("near"))
    enough = F.lit(False)
    for own, needs in NEEDS.items():
        enough = enough | ((F.col("own") == own) & (F.size(F.array_intersect("near", F.array(*map(F.lit, needs)))) == len(needs)))
    return linked.where(enough).groupBy("k1", "k2").agg(F.collect_list("s").alias("linked"))


def find_secrets(docs: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans."""
    rows = _matches(docs)
    linked = _linked(rows, scope)
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    out = rows.join(linked, ["k1", "k2"], "left").withColumn("linked", F.coalesce("linked", none))
    return out.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE), F.size("linked").cast("long").alias("n_linked"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = 256) -> DataFrame:
    """docs with every reported span replaced by its kind in brackets; what spans share is replaced once."""
    k1, k2, spans, own = unused(docs, "secret_k1"), unused(docs, "secret_k2"), unused(docs, "secret_spans"), [unused(docs, "secret_own0"), unused(docs, "secret_own1")]
    rows = _matches(docs)
    found = rows.join(_linked(rows, scope), ["k1", "k2"], "left")
    found = found.withColumn("spans", F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked")))).where(F.size("spans") > 0)
    found = staged(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans)).dropDuplicates([k1, k2]), "spans")
    kinds = F.array(*map(F.lit, ORDER))
    text = F.col("text")
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.get(kinds, s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    keyed = docs.select("*", *(k.alias(own[i]) for i, k in enumerate((F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.hash(F.coalesce("text", F.lit("")), "doc_id")))))
    keyed = keyed.join(found, (F.col(own[0]) == F.col(k1)) & (F.col(own[1]) == F.col(k2)), "left")
    return keyed.withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(walked)).select(*docs.columns)
