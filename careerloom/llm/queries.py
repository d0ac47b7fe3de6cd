"""The queries opN_<name> of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import language_id, personal_data, quality
from .byte_bpe import byte_bpe
from .common import held_out, table
from .conversations import damaged, repair
from .fingerprint import fingerprints
from .html_text import html_text
from .importance import importance
from .near_vectors import near_vectors
from .ngram_join import ngram_join
from .packing import best_fit_packing
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=400)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.fit(docs.where(~held_out()))
    got = language_id.language_id(docs, models)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.quality(docs, weights, threshold=0.7).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, buckets=10_000, seed=2024)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = personal_data.train(personal_data.labelled(docs))
    return personal_data.digest(personal_data.personal_data(docs, model))


_QUERIES = (op1_token_counts, op2_byte_bpe, op3_near_vectors, op4_html_text, op5_suffix_dedup, op6_fingerprints, op7_language_id, op8_quality, op9_packing, op10_ngram_join, op11_conversations, op12_importance, op13_personal_data)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in _QUERIES}


_NEAR_VECTORS = """
with recursive unit as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
reach(v, c) as (select vec_id, vec_id from unit union select reach.v, link.b from reach join link on link.a = reach.c),
comp as (select v, min(c) as component_id from reach group by v),
degree as (select a, count(*) as n from link group by a)
select e.vec_id, coalesce(degree.n, 0) as n_links, coalesce(comp.component_id, e.vec_id) as component_id, e.vec_id = coalesce(comp.component_id, e.vec_id) as kept
from embeddings e left join degree on degree.a = e.vec_id left join comp on comp.v = e.vec_id
"""

_NGRAM_JOIN = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
grams as (
  select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from words),
item as (select doc_id, len(g) as n, unnest(g) as s from grams),
link as (
  select a.doc_id as a, b.doc_id as b from item a join item b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(v, c) as (select doc_id, doc_id from grams union select reach.v, link.b from reach join link on link.a = reach.c)
select grams.doc_id, len(g) as n_shingles, (select min(c) from reach where v = grams.doc_id) as component_id from grams
"""

# crc32 over the bytes of a hexadecimal string, by its table of 256 entries
_CRC_TABLE = "crc_table as (select list(list_reduce(list_prepend(k, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) as tbl from range(256) t(k))"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"

_CONVERSATIONS = rf"""
with recursive {_CRC_TABLE},
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as txt, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations),
kind as (select * exclude (h), {_CRC} % 20 as k from keyed, crc_table),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end as txt
  from kind, range(2) copy(n) where k <> 0 and (n = 0 or k = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, txt) as i from damaged),
row_ as (
  select *, role[1:1] as r, case when not regexp_matches(txt, '[^\x20\x09-\x0D]') then 1
    when row_number() over (partition by conv_id, role, txt order by i) > 1 then 2 when not regexp_matches(txt, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault from placed),
step(f, r, t) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put(f, g, p) as (values (0, 0, ''), (0, 2, 'u'), (0, 3, 'ua'), (1, 1, ''), (1, 2, 'u'), (1, 3, 'ua'), (2, 2, ''), (2, 3, 'a'), (2, 2, 'au'), (3, 3, ''), (3, 2, 'u'), (3, 3, 'ua')),
role_(r, name) as (values ('u', 'user'), ('a', 'assistant')),
way as (
  select f, null::varchar as r, p, 'D' as x, null::varchar as name, g as t, 2 as c from put
  union all select put.f, step.r, p, 'K', null, t, 0 from put join step on step.f = g
  union all select put.f, null, p, 'R', name, t, 1 from put join step on step.f = g join role_ on role_.r = step.r),
best(conv_id, i, s, b) as (
  select distinct conv_id, 0::bigint, 0, {{'c': 0::bigint, 'a': '', 'l': []::varchar[]}} from conversations
  union all
  select best.conv_id, best.i + 1, way.t, min({{'c': b.c + 5 * len(p) + way.c + case when fault = 3 and x <> 'D' then 5 else 0 end, 'a': b.a || repeat('I', len(p)) || x,
    'l': list_concat(b.l, list_transform(string_split(p, ''), lambda q: case q when 'u' then 'user:' when 'a' then 'assistant:' end), case when x = 'D' then [] else [coalesce(name, role) || ':' || txt] end)}})
  from best join row_ on row_.conv_id is not distinct from best.conv_id and row_.i = best.i + 1 join way on way.f = best.s and (x <> 'K' or way.r = row_.r) and (x = 'D' or fault not in (1, 2))
  group by best.conv_id, best.i + 1, way.t),
tail(s, p) as (values (0, []), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])),
size as (select conv_id, count(*) as n from row_ group by conv_id),
last as (
  select best.conv_id, min({{'c': b.c + 5 * len(p), 'a': b.a || repeat('I', len(p)), 'l': list_concat(b.l, p)}}) as b
  from best join tail using (s) left join size on size.conv_id is not distinct from best.conv_id where i = coalesce(n, 0) group by best.conv_id),
pair as (select conv_id, r, lag(r) over (partition by conv_id order by i) as q, i, turn, fault from row_),
seen as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated, count(*) filter (i > 1 and q || r not in ('su', 'ua', 'au')) as illegal from pair group by conv_id)
select last.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  b.c as cost, b.a as audit, sha256(array_to_string(list_filter(b.l, lambda x: x is not null), chr(10))) as repaired_sha256
from last left join seen on seen.conv_id is not distinct from last.conv_id
"""

_IMPORTANCE = rf"""
with {_CRC_TABLE},
doc as (
  select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
aim as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
held as (select id, unnest(w) as w from doc),
wanted as (select unnest(w) as w from aim),
word as (select w, hex(encode(w)) as h from (select distinct w from held union select w from wanted)),
bucket as (select w, {_CRC} % 10000 as b from word, crc_table),
s as (select b, count(*) as s from held join bucket using (w) group by b),
t as (select b, count(*) as t from wanted join bucket using (w) group by b),
every as (select (select count(*) from held)::double as s_all, (select count(*) from wanted)::double as t_all),
gain as (
  select b, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::double) * (t_all + 10000))))::bigint as gain
  from range(10000) all_(b) left join s using (b) left join t using (b), every),
weight as (select id, sum(gain)::bigint as weight from held join bucket using (w) join gain using (b) group by id),
scored as (
  select doc.id, doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from doc left join weight using (id)),
ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= floor(10 * n / 100) then place end as rank from ranked
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op3_near_vectors": _NEAR_VECTORS, "op10_ngram_join": _NGRAM_JOIN, "op11_conversations": _CONVERSATIONS, "op12_importance": _IMPORTANCE}
