"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfattr.llm import (
    alignment,
    decontamination,
    html_text,
    language,
    line_dedup,
    near_duplicates,
    packed_ids,
    packing,
    prefix_trie,
    quality,
    substring_dedup,
    top_k,
    toxicity,
)
from perfattr.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents")).drop("text_key")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packed_ids.token_id_files(documents, public_tokenizers.path(TOKENIZER)).drop("shard", "shard_start")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack_documents(documents, public_tokenizers.path(TOKENIZER))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents")).drop("text_key")
    return found.withColumn("removed", F.array_join("removed", ","))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(table(spark, sf_dir, "documents"), byte_level, pieces)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, runs = prefix_trie.ranked(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.spliced(turns, runs))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_ids": op4_token_ids,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_html_extraction": op13_html_extraction,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": rf"""
        with d as (
            select row_number() over () as r, doc_id,
                   coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
            from documents),
        b as (
            select distinct cast(item_id as varchar) as item,
                   regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark),
        sized as (select item, w, least(10, len(w)) as size from b where len(w) > 0),
        cut as (
            select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as phrase
            from (select *, unnest(range(1, len(w) - size + 2)) as i from sized)),
        sizes as (select distinct size from cut),
        spots as (
            select r, i, size, array_to_string(w[i:i + size - 1], ' ') as phrase
            from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i
                  from d, sizes where len(w) >= size)),
        found as (select s.r, s.i, s.size, c.item from spots s join cut c on c.size = s.size and c.phrase = s.phrase),
        hits as (
            select r, count(distinct p) as n_hit
            from (select r, unnest(range(i, i + size)) as p from (select distinct r, i, size from found))
            group by r),
        items as (select r, list_sort(list(distinct item)) as item from found group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
               cast(coalesce(len(item), 0) as bigint) as n_items,
               sha256(array_to_string(coalesce(item, []), ',')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join hits using (r) left join items using (r)""",
    "op3_near_duplicates": rf"""
        with recursive d as (
            select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
        s as (
            select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as shingle
            from (select *, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as n_shared
            from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
        links as (
            select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b
            where 100 * n_shared >= 75 * (x.n + y.n - n_shared)),
        reach(doc_id, other) as (
            select doc_id, doc_id from d
            union
            select reach.doc_id, links.b from reach join links on links.a = reach.other)
        select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
        from (select doc_id, min(other) as component_id from reach group by doc_id) left join n using (doc_id)""",
    "op5_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
            from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from (select distinct * from v where vec_id % 50 = 0) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op7_line_dedup": r"""
        with recursive d as (select row_number() over () as r, doc_id, string_split(text, chr(10)) as w from documents),
        l as (
            select r, doc_id, i - 1 as line_no, w[i] as line
            from (select *, unnest(range(1, len(w) + 1)) as i from d) where regexp_matches(w[i], '[\p{L}\p{N}]')),
        t as (select distinct line, length(line) as n from l where length(line) >= 20),
        links as (
            select a.line as a, b.line as b
            from t a join (select *, n + unnest([-2, -1, 0, 1, 2]) as m from t) b on a.n = b.m
            where a.line <> b.line and levenshtein(a.line, b.line) <= 2),
        reach(line, other) as (
            select a, a from links
            union
            select reach.line, links.b from reach join links on links.a = reach.other),
        named as (select line, min(other) as class from reach group by line),
        ranked as (
            select r, line_no, row_number() over (
                partition by coalesce(class, l.line) order by doc_id nulls first, r, line_no) as place
            from l left join named using (line)),
        marks as (
            select r, list(cast(line_no as integer) order by line_no) as removed
            from ranked where place > 1 group by r)
        select doc_id, cast(coalesce(len(w), 0) as bigint) as n_lines,
               cast(coalesce(len(removed), 0) as bigint) as n_repeated,
               coalesce(array_to_string(removed, ','), '') as removed
        from d left join marks using (r)""",
    "op12_conversation_prefix_trie": """
        with said as (
            select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
                       partition by conv_id order by turn nulls first, role, text) - 1 as r
            from conversations where conv_id is not null),
        own as (select c, count(*) as n from said group by c),
        hashed as (
            select *, c - c % 5 as base, xor(list_reduce(
                       list_prepend(4294967295::ubigint, list_transform(string_split(cast(c as varchar), ''),
                                                                        lambda s: cast(ascii(s) as ubigint))),
                       lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z:
                                                xor(u >> 1, (u & 1) * 3988292384::ubigint))),
                   4294967295::ubigint) % 9 as h
            from own),
        convs as (
            select a.c, a.base, a.h, a.n, least(a.h, coalesce(b.n, 0)) as m
            from hashed a left join own b on b.c = a.base),
        rebuilt as (
            select v.c, s.r + 1 as pos, role, text from convs v join said s on s.c = v.base where s.r < v.h
            union all
            select v.c, m + s.r - h + 1, role, text from convs v join said s on s.c = v.c where s.r >= v.h),
        paths as (
            select c, pos as d, strlen(text) as bytes, max(pos) over (partition by c) as len,
                   string_agg(sha256(role) || sha256(text), '') over (partition by c order by pos) as k
            from rebuilt
            union all
            select c, 0, 0, coalesce((select max(pos) from rebuilt r where r.c = convs.c), 0), '' from convs),
        named as (select *, min(c) over (partition by k) as rep, count(*) over (partition by k) as n from paths),
        nodes as (
            select k, any_value(d) as d, any_value(rep) as rep, any_value(n) as n,
                   string_agg(c, ',' order by c) filter (d = len) as ends
            from named group by k),
        parents as (
            select n.k, any_value(p.rep) as parent from nodes n
            join named c on c.k = n.k and c.c = n.rep join named p on p.c = c.c and p.d = c.d - 1 group by n.k),
        children as (
            select p.k, count(*) as n from nodes n join named c on c.k = n.k and c.c = n.rep
            join named p on p.c = c.c and p.d = c.d - 1 group by p.k),
        below as (
            select c, k, sum(case when c = rep then 0 else bytes end) over up as saved,
                   max(case when d = len and c = rep and k not in (select k from children) then 1 else 0 end) over up as leaf
            from named window up as (partition by c order by d desc)),
        totals as (select k, sum(saved) as saved, sum(leaf) as leaves from below group by k)
        select rep as conv_id, cast(d as bigint) as depth, parent as parent_conv_id, nodes.n as n_convs,
               coalesce(children.n, 0) as n_children, cast(leaves as bigint) as n_leaves,
               cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
        from nodes left join parents using (k) left join children using (k) join totals using (k)""",
    # The pages of the test tables mark their article; its blocks hold few kinds of references.
    "op13_html_extraction": r"""
        with inner_html as (
            select page_id, url, regexp_replace(
                regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g') as t
            from pages),
        plain as (
            select page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                '&#x27;', chr(39)), '&#39;', chr(39)) as t
            from inner_html),
        spelt as (
            select page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as text
            from plain)
        select page_id, url, text, length(text) as n_chars from spelt""",
}
