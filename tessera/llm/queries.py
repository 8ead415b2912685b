"""The registered queries of the operators; oracle SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, table


def op1_bwt(spark, sf_dir):
    """Bytes of 50-byte strings that a document of smaller doc_id has, cut from every whole text.

    Null and empty texts: n_bytes 0, nothing removed, the digest of no bytes. A null doc_id is larger than all others;
    rows that repeat a doc_id do not cut one another. An empty table gives no rows; other columns are not read.
    """
    from tessera.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_sha256").alias("kept_sha256"))


def op2_bestfit(spark, sf_dir):
    """Every piece of every document's ids with its place in a sequence.

    Null and empty texts are the one id 0. Rows that repeat a doc_id are pieces each for themselves, null ids too; a
    text of any length is cut into pieces. An empty table gives no rows; other columns are not read.
    """
    from tessera.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op3_subword(spark, sf_dir):
    """The quality score of every whole text, learned from labelled rows outside the held-out quarter.

    Null and empty texts have the score of a text without features. Rows that repeat a doc_id each have a row; a null
    doc_id is not held out, and not learned from. An empty table gives no rows; without usable labels scores are 0.5.
    """
    from tessera.llm.quality import THRESHOLD, fit_quality, score_quality

    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 4) == 2
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_wu_manber(spark, sf_dir):
    """Words of every whole document in benchmark windows, and the items that the windows are of.

    Null and empty texts have no words. Repeated rows each have a row, a null doc_id too; an item without an id hits
    words but is not counted or named. Empty documents give no rows, an empty benchmark no hits.
    """
    from tessera.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_bagminhash(spark, sf_dir):
    """The class of near duplicates of every document: its smallest doc_id.

    Null and empty texts, and texts without words, are classes of their own. A null doc_id has no row; rows that repeat
    a doc_id each have a row, of one class. An empty table gives no rows; other columns are not read.
    """
    from tessera.llm.near_dup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_longest_match(spark, sf_dir):
    """Words and word pieces of every whole text: none of a null or empty one; a row for every row."""
    from tessera.llm.token_counts import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_tokens").alias("n_tokens"))


def op7_levenshtein(spark, sf_dir):
    """The toxicity score of every whole text, learned from labelled rows outside the held-out third.

    Nulls, repeats and empty tables as in op3_subword.
    """
    from tessera.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 3) == 1
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_interleave(spark, sf_dir):
    """A shard of 16 and a gapless slot for every row, by the law `rows`.

    A null text has size 1; null ids and sources are values like others; repeated rows are rows each for themselves. An
    empty table gives no rows; other columns are not read.
    """
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    """What the archives of all pages hold when they are read back.

    A null html is an empty payload, a null url is replaced by a name; pages without an id are responses; repeated rows
    are records each for themselves. An empty table gives no rows; other columns are not read.
    """
    from tessera.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_e8(spark, sf_dir):
    """Links and component of every vector.

    Vectors that are null, empty, zero or hold what is not finite, and those without a label or an id, link with
    nothing and are components of their own; rows that repeat an id count as vectors. An empty table gives no rows.
    """
    from tessera.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bwt, op2_bestfit, op3_subword, op4_wu_manber, op5_bagminhash,
        op6_longest_match, op7_levenshtein, op8_interleave, op9_warc, op10_e8,
    )
}

#: Words of a text, as a list; the pattern is a fixed value.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_bwt": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
        p as (select doc_id, k, substr(h, 2 * k + 1, 698) h from (select doc_id, h, unnest(range(0, length(h) // 2 - 49, 300)) k from d where length(h) >= 100) t),
        w as (select doc_id, k + i as i, substr(h, 2 * i + 1, 100) g from (select doc_id, k, h, unnest(range(0, least(300, length(h) // 2 - 49))) i from p) t),
        f as (select g, min(doc_id) m from w group by g),
        hit as (select w.doc_id, w.i, lag(w.i) over (partition by w.doc_id order by w.i) before from w join f using (g) where f.m < w.doc_id),
        run as (select doc_id, i, sum((before is null or i > before + 50)::int) over (partition by doc_id order by i) r from hit),
        span as (select doc_id, min(i) a, max(i) + 50 b from run group by doc_id, r),
        cut as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) from_ from span),
        part as (select doc_id, sum(b - a)::bigint n_removed, count(*) n_spans, max(b) last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) kept from cut join d using (doc_id) group by doc_id)
        select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256
        from d left join part using (doc_id)""",
    "op4_wu_manber": f"""
        with d as (select doc_id, {_WORDS} w from documents),
        b as (select item_id::varchar item_id, {_WORDS} w from benchmark),
        bw as (select distinct item_id, least(13, len(w)) n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') g from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0) t),
        dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) s where len(w) >= n) t),
        hit as (select distinct doc_id, i, n, item_id from dw join bw using (n, g)),
        words as (select doc_id, count(distinct place) n_hit from (select doc_id, unnest(range(i, i + n)) place from hit) t group by 1),
        items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) named from (select distinct doc_id, item_id from hit) t group by 1)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(named, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join words using (doc_id) left join items using (doc_id)""",
    "op5_bagminhash": f"""
        with recursive d as (select doc_id, {_WORDS} w from documents),
        one as (select min(doc_id) rep, array_to_string(w, ' ') t, any_value(w) w from d where len(w) > 0 group by 2),
        s as (select rep, g, count(*) c from (select rep, array_to_string(w[i:i + 4], ' ') g from (select rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from one) t) u group by 1, 2),
        size as (select rep, sum(c) n from s group by 1),
        met as (select a.rep x, b.rep y, sum(least(a.c, b.c)) m from s a join s b on a.g = b.g and a.rep < b.rep group by 1, 2),
        link as (select x, y from met join size p on p.rep = x join size q on q.rep = y where 5 * m >= 4 * (p.n + q.n - m)),
        edge as (select x, y from link union all select y, x from link),
        reach(x, y) as (select rep, rep from one union select reach.x, edge.y from reach join edge on edge.x = reach.y),
        class as (select x rep, min(y) class from reach group by 1)
        select d.doc_id, coalesce(class, d.doc_id) as class_id, d.doc_id = coalesce(class, d.doc_id) as kept
        from d left join one on len(d.w) > 0 and one.t = array_to_string(d.w, ' ') left join class using (rep)""",
    "op10_e8": """
        with recursive e as (select vec_id, label, embedding::double[] v from embeddings),
        ok as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from e
               where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
        link as (select a.vec_id x, b.vec_id y from ok a join ok b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
                 where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
        edge as (select x, y from link union all select y, x from link),
        reach(x, y) as (select vec_id, vec_id from e union select reach.x, edge.y from reach join edge on edge.x = reach.y)
        select e.vec_id, (select count(*) from edge where edge.x = e.vec_id) as n_links, min(reach.y) as component_id, e.vec_id = min(reach.y) as kept
        from e join reach on reach.x = e.vec_id group by e.vec_id""",
    "op9_warc": """
        with p as (
            select page_id, coalesce(html, '') h, sha256(coalesce(html, '')) as payload_digest,
                   strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
        f as (select *, min(page_id) over (partition by payload_digest) as first from p)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id > first then first end as refers_to
        from f""",
}
