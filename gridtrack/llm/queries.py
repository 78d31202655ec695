"""The registered queries of the document operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, line_dedup, lm_score, neardup, packing, quality_rules, resample, secrets, sp_codec, substrings, toxicity, vector_codes
from .common import fold, read, staged


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = read(spark, sf_dir, "documents"), langid.EcocParams()
    return langid.predict(docs.select("doc_id", "text"), langid.train(docs, p)).select("doc_id", (fold(F.col("doc_id"), p.folds) == p.held_out).alias("held_out"), "ecoc.lang_pred", "ecoc.score", "ecoc.ambiguous")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


def pack_params() -> packing.PackParams:
    import public_tokenizers

    return packing.PackParams(public_tokenizers.path("word_bpe_49k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), pack_params())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.fit_score(read(spark, sf_dir, "documents"))[0]


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = sp_codec.encode_documents(read(spark, sf_dir, "documents"), sp_codec.CodecParams(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", "draw", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_errors(staged(rows, "codes"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_text(books)).alias("codebooks_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "longest")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_language_id, op4_line_dedup, op5_quality_rules, op6_best_fit_packing, op7_secret_scan, op8_lm_score, op9_minhash_near_dedup, op10_sentencepiece, op11_vector_codes, op12_substring_dedup, op13_importance_resampling)}

SQL = {
    "op4_line_dedup": r"""
        with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
        l as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as raw from split),
        o as (select doc_id, pos, raw, translate(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line from l),
        d as (select line, min((doc_id, pos)) as first, length(line) as m, row_number() over (order by min((doc_id, pos))) as k from o where line <> '' group by line),
        t as (select *, [substr(line, 1, m // 3), substr(line, m // 3 + 1, m // 3), substr(line, 2 * (m // 3) + 1)] as s from d where m >= 20),
        p as (select x.k as a, y.k as b from t x join t y on y.m between x.m and x.m + 2 and x.k <> y.k
              where (contains(y.line, x.s[1]) or contains(y.line, x.s[2]) or contains(y.line, x.s[3])) and levenshtein(x.line, y.line) <= 2),
        e as (select distinct least(a, b) as early, greatest(a, b) as late from p),
        -- Lines with their earlier neighbours, in order; a line stays if none of these stays.
        f as (select late as k, list(early) as before from e group by late union all select early, [] from e where early not in (select late from e)),
        stay as (select list_reduce(list([k] || before order by k), lambda acc, x: case when list_has_any(acc, x[2:]) then acc else list_append(acc, x[1]) end) as ks from (select distinct k, before from f)),
        gone as (select k from f where not list_contains((select ks from stay), k)),
        j as (select o.doc_id, o.pos, o.raw, d.line is not null and (d.k in (select k from gone) or (o.doc_id, o.pos) <> d.first) as dropped from o left join d using (line))
        select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
               sha256(coalesce(string_agg(raw, chr(10) order by pos) filter (where not dropped), '')) as text_sha256
        from j group by doc_id
    """,
    "op2_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id is not distinct from max(doc_id) over w as kept, sha256(norm) as text_sha256
        from d window w as (partition by norm)
    """,
    "op11_vector_codes": """
        with recursive kept as (
            select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
        parts as (select vec_id, label, p, v[p * w + 1 : p * w + w] as x from (select *, len(v) // 16 as w, unnest(range(16)) as p from kept)),
        points as (select p, x, count(*) as n from parts group by p, x),
        rounds as (
            select 0 as round, p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts qualify e < 64
            union all
            select round + 1, p, e, coalesce(new, c) from (
                select b.round, b.p, b.e, b.c, list(floor(m.s::double / m.n)::bigint order by m.k) filter (where m.n is not null) as new
                from rounds b left join (
                    select p, e, k, sum(n * x[k])::bigint as s, sum(n)::bigint as n from (
                        select a.p, a.x, a.n, arg_min(b.e, list_sum(list_transform(list_zip(a.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 64 + b.e) as e
                        from points a join rounds b using (p) group by a.p, a.x, a.n), (select unnest(range(1, len(c) + 1)) as k from (select c from rounds limit 1)) group by p, e, k) m using (p, e)
                where b.round < 2 group by b.round, b.p, b.e, b.c)),
        book as (select * from rounds where round = 2),
        near as (select a.p, a.x, min(list_sum(list_transform(list_zip(a.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 64 + b.e)::bigint as d from points a join book b using (p) group by a.p, a.x),
        coded as (select vec_id, label, string_agg(lpad(lower(hex(d % 64)), 2, '0'), '' order by p) as code, sum(d // 64)::bigint as error from parts join near using (p, x) group by vec_id, label)
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
               (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book) as codebooks_sha256
        from coded
    """,
    "op12_substring_dedup": r"""
        with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as a from documents),
        grams as (select doc_id, p, array_to_string(a[p : p + 49], ' ') as g from (select doc_id, a, unnest(range(1, len(a) - 48)) as p from split)),
        starts as (select doc_id, p, min(doc_id) over (partition by g) < doc_id as gone from grams),
        words as (select doc_id, p, w from (select doc_id, unnest(range(1, len(a) + 1)) as p, unnest(a) as w from split)),
        marked as (select doc_id, p, w, coalesce(bool_or(gone) over (partition by doc_id order by p rows between 49 preceding and current row), false) as goes from words left join starts using (doc_id, p)),
        -- The longest level at which a document has a window of another one: 50, 100, 200...
        levels as (select 50 * (1 << unnest(range((select greatest(0, ceil(log2(max(len(a)) / 50.0)))::int + 1 from split)))) as n),
        longer as (select doc_id, n, md5(array_to_string(a[p : p + n - 1], ' ')) as g from (select doc_id, a, n, unnest(range(1, len(a) - n + 2)) as p from split, levels where len(a) >= n)),
        shared as (select doc_id, max(n) as longest from (select doc_id, n, min(doc_id) over w < max(doc_id) over w as met from longer window w as (partition by n, g)) where met group by doc_id)
        select doc_id, len(a) as n_words, coalesce(n, 0) as n_removed, coalesce(sha, sha256('')) as kept_sha256, coalesce(longest, 0) as longest
        from split left join (select doc_id, count(*) filter (where goes) as n, sha256(coalesce(string_agg(w, ' ' order by p) filter (where not goes), '')) as sha from marked group by doc_id) using (doc_id)
        left join shared using (doc_id)
    """,
    "op13_importance_resampling": r"""
        with recursive bits as (
            select i, 0 as k, i as c from range(256) t(i)
            union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
        crcs as (select list(c order by i) as t from bits where k = 8),
        texts as (select 'd' as side, doc_id, text from documents union all select 'b', item_id, text from benchmark),
        split as (select side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as a from texts),
        words as (select side, doc_id, unnest(a) as w from split),
        named as (select w, hex(encode(w)) as h from (select distinct w from words)),
        bucketed as (select w, xor(list_reduce(list_transform(range(-1, len(h) // 2), lambda i: case when i < 0 then 4294967295 else (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 end::bigint),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from named, crcs),
        counts as (select bucket, count(*) filter (where side = 'd') as s, count(*) filter (where side = 'b') as t from words join bucketed using (w) group by bucket),
        gains as (select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from counts) + 10000)::double / ((s + 1)::double * ((select sum(t) from counts) + 10000)::double)))::bigint as gain from counts),
        weighed as (select doc_id, sum(gain)::bigint as weight from words join bucketed using (w) join gains using (bucket) where side = 'd' group by doc_id),
        scored as (select doc_id, len(a) as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from split left join weighed using (doc_id) where side = 'd'),
        ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
        select s.doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from scored s left join ranked using (doc_id)
    """,
}
