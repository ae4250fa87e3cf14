"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm.burst_trie import conversation_trie
from strata.llm.classifier import quality_scores
from strata.llm.column_dedup import digests as removal_digests
from strata.llm.flat_graph import near_vectors
from strata.llm.packing import packed_documents
from strata.llm.quality_rules import quality_rules
from strata.llm.repair_ids import id_round_trip
from strata.llm.spelling_tiles import spelling_variants
from strata.llm.superminhash import near_duplicates
from strata.llm.tag_paths import extract_pages
from strata.llm.word_bpe import digests as bpe_digests
from strata.llm.xent import cross_entropy_difference
from strata.llm.zip_warc import archive_round_trip
from strata.sources.tables import table


def op1_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus: documents labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op4_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mcd_rules": op1_mcd_rules,
    "op2_flat_graph": op2_flat_graph,
    "op3_cross_entropy": op3_cross_entropy,
    "op4_column_suffixes": op4_column_suffixes,
    "op5_vector_best_fit": op5_vector_best_fit,
    "op6_fourier_ridge": op6_fourier_ridge,
    "op7_tag_paths": op7_tag_paths,
    "op8_zip_warc": op8_zip_warc,
    "op9_superminhash": op9_superminhash,
    "op10_word_bpe": op10_word_bpe,
    "op11_spelling_tiles": op11_spelling_tiles,
    "op12_repair_ids": op12_repair_ids,
    "op13_burst_trie": op13_burst_trie,
}


def _components(ids: str, links: str) -> str:
    """CTEs reach, comp: per id of ``ids`` (id) the smallest id reachable over ``links`` (a, b)."""
    return f"""both_ways as (select a, b from {links} union select b, a from {links}),
reach as (select id, id as other from {ids} union select r.id, l.b from reach r join both_ways l on l.a = r.other),
comp as (select id, min(other) as c from reach group by id)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes, by half bytes (the table follows from the polynomial)."""
    steps = [0] * 16
    for i in range(16):
        c = i
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps[i] = c
    halves = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint))"
    half = "xor({c} >> 4, [" + ", ".join(map(str, steps)) + "][1 + (xor({c}, {b}) & 15)])"
    both = half.format(c=f"({half.format(c='c', b='b')})", b="(b >> 4)")
    return f"xor(list_reduce([cast(4294967295 as bigint)] || {halves}, lambda c, b: {both}), 4294967295)"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: DuckDB twins of the operators whose whole result SQL expresses.
SQL: dict[str, str] = {
    "op2_flat_graph": f"""with recursive given as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
fine as (select id, v, sqrt(list_inner_product(v, v)) as n from given
         where v is not null and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
unit as (select id, list_transform(v, lambda x: x / n) as u from fine),
links as (select a.id as a, b.id as b from unit a join unit b on a.id < b.id where list_inner_product(a.u, b.u) >= 0.95),
{_components("given", "links")},
degree as (select a as id, count(*) as n from both_ways group by a)
select c.id as vec_id, coalesce(d.n, 0) as n_links, c.c as component_id, c.id = c.c as kept from comp c left join degree d using (id)""",
    "op8_zip_warc": """with d as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as hex from pages),
f as (select hex, min(page_id) as first from d group by hex),
b as (select hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31), 1)), '') as digest, first from f)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to from d join b using (hex)""",
    "op9_superminhash": f"""with recursive words as (select doc_id as id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
sets as (select id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as g from words),
sizes as (select id, count(*) as n from sets group by id),
shared as (select a.id as a, b.id as b, count(*) as n from sets a join sets b on a.g = b.g and a.id < b.id group by 1, 2),
links as (select s.a, s.b from shared s join sizes x on x.id = s.a join sizes y on y.id = s.b where 100 * s.n >= 80 * (x.n + y.n - s.n)),
{_components("words", "links")}
select c.id as doc_id, coalesce(z.n, 0) as n_shingles, c.c as component_id, c.id = c.c as kept from comp c left join sizes z using (id)""",
    "op11_spelling_tiles": f"""with recursive runs as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_UPPER.lower()}') as r from documents),
each as (select doc_id, r, count(*) as n from runs group by doc_id, r),
summed as (select r, n, {_crc32("doc_id || ':' || r")} as h from each),
words as (select word, cast(sum(n) as bigint) as n from (select case when h % 199 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, n from summed)
          group by word having length(word) >= 6 and sum(n) >= 5),
less as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as d from (select word, n, unnest(range(0, length(word))) as i from words)),
pairs as (select a.word as u, b.word as v from less a join less b on a.i = b.i and a.d = b.d and a.word <> b.word
          union select l.word, w.word from less l join words w on l.d = w.word union select w.word, l.word from less l join words w on l.d = w.word),
near as (select p.u as word, count(*) as k, arg_min(w.word, struct_pack(a := -w.n, b := encode(w.word))) as best, max(w.n) as best_n from pairs p join words w on w.word = p.v group by p.u),
forms as (select w.word, w.n, coalesce(k, 0) as n_near, case when best_n >= 5 * w.n then best end as form, case when best_n >= 5 * w.n then best_n end as form_n
          from words w left join near using (word)),
chain as (select word, word as last, 0 as step from forms union all select c.word, f.form, c.step + 1 from chain c join forms f on f.word = c.last where f.form is not null),
ends as (select word, arg_max(last, step) as root from chain group by word)
select word, form, root, n, n_near, form_n from forms join ends using (word)""",
    "op13_burst_trie": f"""with own as (select conv_id as c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) order by turn nulls first,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as w from conversations where conv_id is not null group by conv_id),
heads as (select c, w, cast({_crc32("cast(c as varchar)")} % 9 as int) as h from own),
whole as (select a.c, coalesce(b.w[1:a.h], []) || a.w[a.h + 1:] as w from heads a left join own b on b.c = a.c - a.c % 5),
members as (select c, w[1:d] as p, d, len(w) = d as ended from (select c, w, unnest(range(0, len(w) + 1)) as d from whole)),
nodes as (select p, d, count(*) as n, min(c) as first, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ended), '')) as ends from members group by p, d),
kids as (select p[1:d - 1] as up, count(*) as k from nodes where d > 0 group by 1),
full_nodes as (select n.*, coalesce(k, 0) as k, case when d = 0 then 0 else (n - 1) * octet_length(encode(p[d].x)) end as own from nodes n left join kids on up = p),
sums as (select q, sum(own) as saved, count(*) filter (k = 0) as leaves from (select p[1:unnest(range(0, d + 1))] as q, own, k from full_nodes) group by q)
select a.first as conv_id, a.d as depth, u.first as parent_conv_id, a.n as n_convs, a.k as n_children, cast(s.leaves as bigint) as n_leaves,
       cast(s.saved as bigint) as saved_tokens, a.ends as ends_sha256
from full_nodes a join sums s on s.q = a.p left join full_nodes u on a.d > 0 and u.p = a.p[1:a.d - 1]""",
}
