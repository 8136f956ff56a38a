"""DuckDB SQL of the queries that SQL expresses."""

from __future__ import annotations

from dossier.llm import quality

QUALITY = f"""with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
 p as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
 r as (select doc_id, count(distinct i + k) as n_repeat_words from (select doc_id, i, count(*) over (partition by doc_id, s) as n from p), range(0, 3) x(k) where n > 1 group by 1),
 l as (select doc_id, host, md5(t) as digest, x as line, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as norm, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as words
  from (select doc_id, host, t, unnest(string_split(t, chr(10))) as x from d)),
 f as (select host, norm from l where norm <> '' group by 1, 2 having count(distinct (doc_id, digest)) > {quality.MOST_DOCS}),
 g as (select doc_id, sum(words) as removed_words, count(*) as removed_lines from l join f using (host, norm) group by 1),
 u as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l where norm <> '' group by 1),
 c as (select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(removed_words, 0)::bigint as removed_words, coalesce(removed_lines, 0) as removed_lines from d left join u using (doc_id) left join r using (doc_id) left join g using (doc_id)),
 b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_words - removed_words < {quality.LEAST_LEFT} * n_words as depleted from c)
 select *, not base_failed and not depleted as kept from b"""

WARC = """with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages), m as (select x, max(page_id) as last from p group by 1),
 d as (select x, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || substr(x, (i // 4) * 5 + 1, 5) as int) >> (15 - 5 * (i % 4))) & 31) + 1]), '') as payload_digest from m)
 select page_id, strlen(h) as payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from p join m using (x) join d using (x)"""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION = f"""with b as (select item_id, {WORDS} as w from benchmark), d as (select doc_id, {WORDS} as w from documents),
 win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
 occ as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win))),
 m as (select doc_id, i, n, item_id from occ join win using (n, s)),
 h as (select doc_id, count(distinct i + k) as n_hit from m, range(0, 10) x(k) where k < n group by 1),
 it as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct cast(item_id as string), ',' order by cast(item_id as string))) as items_sha256 from m group by 1)
 select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join it using (doc_id)"""

NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as c from embeddings
  where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, a.label = b.label as same, a.vec_id <> b.vec_id as other, b.vec_id, list_inner_product(a.c, b.c)::bigint as score from v a, v b where a.vec_id % 100 = 0),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same and other qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
 select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
 from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5"""


def _lloyd(parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds of Lloyd spelled out: each assigns all parts, then moves the entries that have any."""
    nearest = "select vec_id, part, any_value(x) as x, min_by(e, d * {k} + e) as e, min(d) as d from (select vec_id, p.part, p.x, b.e, (xx + cc - 2 * list_inner_product(p.x, b.c))::bigint as d from p join b{r} b using (part)) group by 1, 2".replace("{k}", str(size))
    book = "select part, e, c, list_inner_product(c, c) as cc from "
    sql = f"""with v as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) as c from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as materialized (select *, list_inner_product(x, x) as xx from (select vec_id, part, c[part * len(c) // {parts} + 1 : (part + 1) * len(c) // {parts}] as x from v, range(0, {parts}) r(part))),
 b0 as materialized ({book} (select part, row_number() over (partition by part order by vec_id) - 1 as e, x as c from p) where e < {size})"""
    for r in range(rounds):
        sql += f""", a{r} as materialized ({nearest.replace("{r}", str(r))}),
 s{r} as (select part, e, i, sum(x[i])::hugeint as s, count(*) as n from a{r}, range(1, 100000) k(i) where i <= len(x) group by all),
 m{r} as (select part, e, list(((s - ((s % n) + n) % n) // n)::double order by i) as c from s{r} group by all),
 b{r + 1} as materialized ({book} (select part, e, coalesce(m.c, b.c) as c from b{r} b left join m{r} m using (part, e)))"""
    return sql + f""", f as materialized ({nearest.replace("{r}", str(rounds))}),
 g as (select vec_id, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::bigint as error from f group by 1),
 h as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' order by part, e)) as codebooks_sha256 from b{rounds})
 select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from g join v using (vec_id), h"""


VECTOR_CODES = _lloyd()
VECTOR_LINKS = """with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 u as (select * from v where list_inner_product(x, x) > 0), l as (select a.vec_id as a, b.vec_id as b from u a join u b using (label) where a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.98),
 r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on l.a = r.b), m as (select a as vec_id, min(b) as component_id from r group by 1), n as (select a as vec_id, count(*) as n_links from l group by 1)
 select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from m left join n using (vec_id)"""

ORACLES = {"op1_quality_rules": QUALITY, "op8_warc_archives": WARC, "op10_decontamination": CONTAMINATION, "op11_hard_negatives": NEGATIVES, "op12_vector_codes": VECTOR_CODES, "op13_vector_dedup": VECTOR_LINKS}
