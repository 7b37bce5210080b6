"""Thin queries over the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, licences, near_dups, packing, pii, prefix_trie, quality, resampling, tokens, toxicity, vector_search, warc
from .common import table


def tokenizer(name: str) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf, "pages"))


def op2_mixture_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op3_decision_list(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(table(spark, sf, "documents"))


def op7_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    rows = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


#: A key for tests; a run over real data sets one of its own, which Spark redacts by its name.
KEY, KEY_CONF = "civicframe", "spark.civicframe.pii.secret"


def key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_CONF, None) or KEY


def op8_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf, "documents"), key(spark)).select("doc_id", "text", "n_pii")


def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf, "documents"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return tokens.counts(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    nodes, ends = prefix_trie.prefix_trie(table(spark, sf, "conversations"), rebuild=True)
    hashed = prefix_trie.ends_sha256(ends).withColumnsRenamed({"depth": "at", "digest": "of"})
    out = nodes.join(hashed, (nodes.depth == hashed["at"]) & nodes.digest.eqNullSafe(hashed["of"]), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(prefix_trie.EMPTY)).alias("ends_sha256"))


def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.search(table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text, op2_mixture_packing, op3_decision_list, op4_warc, op5_toxicity, op6_licences, op7_winnowing, op8_pseudonyms, op9_near_duplicates, op10_token_counts, op11_prefix_trie, op12_resampling,
        op13_nearest_vectors,
    )
}

_WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: One row: the table of CRC-32, by its polynomial.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc"


def _crc(hexed: str) -> str:
    """SQL for the CRC-32 of bytes in hex, with the table's column crc at hand."""
    octets = f"list_transform(range(length({hexed}) // 2), lambda j: ('0x' || substr({hexed}, 2 * j + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"


ORACLES = {
    "op4_warc": """
        with p as (select page_id, encode(coalesce(html, '')) b from pages),
        d as (select page_id, octet_length(b) n, sha1(b) h from p),
        e as (select *, min(page_id) over (partition by h) f from d)
        select page_id, n::bigint payload_bytes,
          array_to_string(list_transform(range(32), lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 5 * (q // 4) + 1, 5))::bigint) >> (15 - 5 * (q % 4))) & 31)::int, 1)), '') payload_digest,
          case when page_id > f then 'revisit' else 'response' end record_type,
          case when page_id > f then f end refers_to
        from e""",
    "op7_winnowing": f"""
        with d as (select doc_id, {_WORDS7} w from documents),
        b as (select item_id, {_WORDS7} w from benchmark),
        win as (select distinct item_id, least(len(w), 10) k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') p
                from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
        dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') p
               from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from win))),
        m as (select doc_id, i, k, item_id from dw join win using (k, p)),
        c as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from m) group by 1),
        t as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct doc_id, item_id::varchar s from m) group by 1)
        select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
          sha256(coalesce(s, '')) items_sha256, n_hit is not null contaminated
        from d left join c using (doc_id) left join t using (doc_id)""",
    "op11_prefix_trie": f"""
        with tab as ({_CRC_TABLE}),
        o as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
        p as (select conv_id, sha256(octet_length(encode(r))::varchar || ':' || r || x) g, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) w,
                row_number() over (partition by conv_id order by turn nulls first, g) - 1 pos from o),
        c as (select conv_id, conv_id - conv_id % 20 donor, {_crc("hex(encode(conv_id::varchar))")} % 4 h from (select distinct conv_id from p), tab),
        b as (select c.conv_id, 0 part, pos, g, w from c join p on p.conv_id = donor where pos < h union all select conv_id, 1, pos, g, w from c join p using (conv_id) where pos >= h),
        l as (select c.conv_id, list(g order by part, pos) filter (where g is not null) g, list(w order by part, pos) filter (where g is not null) w from c left join b using (conv_id) group by 1),
        q as (select conv_id, coalesce(len(g), 0) n, unnest(range(coalesce(len(g), 0) + 1)) d, coalesce(g[1:d], []) k, coalesce(w[d], 0) w from l),
        t as (select d, k, min(conv_id) conv_id, count(*) n_convs, any_value(w) w, string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = n) e from q group by 1, 2),
        kids as (select d - 1 d, k[1:d-1] k, count(*) n_children from t where d > 0 group by 1, 2),
        u as (select t.*, coalesce(n_children, 0) n_children from t left join kids using (d, k)),
        s as (select j d, k[1:j] k, sum((n_children = 0)::int) n_leaves, sum((n_convs - 1) * w) saved_tokens from (select u.*, unnest(range(d + 1)) j from u) group by 1, 2)
        select u.conv_id, u.d::bigint depth, up.conv_id parent_conv_id, u.n_convs, u.n_children::bigint n_children, n_leaves::bigint n_leaves, saved_tokens::bigint saved_tokens, sha256(coalesce(u.e, '')) ends_sha256
        from u join s on s.d = u.d and s.k = u.k left join u up on up.d = u.d - 1 and up.k = u.k[1:u.d-1]""",
    "op12_resampling": f"""
        with tab as ({_CRC_TABLE}),
        d as (select row_number() over () i, doc_id, {_WORDS7} w from documents),
        b as (select {_WORDS7} w from benchmark),
        dw as (select i, w, count(*) n from (select i, unnest(w) w from d) group by 1, 2),
        bw as (select w, count(*) n from (select unnest(w) w from b) group by 1),
        k as (select w, {_crc("x")} % 10000 k from (select w, hex(encode(w)) x from (select w from dw union select w from bw)), tab),
        s as (select k, sum(n) s from dw join k using (w) group by 1),
        t as (select k, sum(n) t from bw join k using (w) group by 1),
        g as (select k, floor(1000 * ln(((coalesce(t, 0) + 1) * (sa + 10000))::double / ((coalesce(s, 0) + 1) * (ta + 10000))::double))::bigint gain
              from (select unnest(range(10000)) k) left join s using (k) left join t using (k), (select coalesce(sum(s), 0) sa from s), (select coalesce(sum(t), 0) ta from t)),
        m as (select i, floor(sum(n * gain)::double / sum(n))::bigint weight from dw join k using (w) join g using (k) group by 1),
        r as (select i, doc_id, coalesce(len(w), 0)::bigint n_features, coalesce(weight, 0) weight, ('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint h from d left join m using (i)),
        c as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score from r),
        o as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) q, count(*) over (partition by n_features >= 20) n from c)
        select doc_id, n_features, weight, score, case when n_features >= 20 and q <= 10 * n // 100 then q end rank from o""",
    "op13_nearest_vectors": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
}
