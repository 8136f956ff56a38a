"""Queries over the supplied tables, each with the same question in DuckDB SQL where SQL can put it.

The tables stand in for the engine's own: ``documents`` for files, ``benchmark`` for entries, ``orders`` with their
customers and nations for dated entries in sections and profiles, ``lineitem`` for links. Texts with identifiers
are built in the query from columns, by one expression that both sides read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import identifiers as ids
from dossier.functions import text as tx
from dossier.operators import dedupe, links, parse, ranking, report, scoring, segment
from dossier.sources import files as src
from dossier.sources.shared import removed, shared_folder, shuffles_dropped, spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


FOLD = "strip_accents(lower({}))"
NORM = "trim(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
MEANINGFUL = "list_filter(string_split({}, ' '), lambda w: length(w) >= 4 and not list_contains(" + sql_list(tx.STOPWORDS) + ", w) and not regexp_full_match(w, '\\p{{N}}+'))"

# ---- scalar functions -------------------------------------------------------------------------------------------


@query(f"select doc_id, {NORM.format('text')} as norm from documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query(f"""select doc_id, len(string_split(n, ' ')) as n_words, len(list_distinct(string_split(n, ' '))) as n_distinct,
 len({MEANINGFUL.format('n')}) as n_meaningful from (select doc_id, {NORM.format('text')} as n from documents)""")
def token_sets(spark, sf):
    n = table(spark, sf, "documents").select("doc_id", tx.normalize(F.col("text")).alias("n"))
    return n.select("doc_id", F.size(F.split("n", " ")).cast("long").alias("n_words"), F.size(F.array_distinct(F.split("n", " "))).cast("long").alias("n_distinct"), F.size(tx.meaningful(F.col("n"))).cast("long").alias("n_meaningful"))


DATED = "'Pedido ' || cast(o_orderkey as string) || ' de ' || cast(year(o_orderdate) as string) || ', prazo ' || cast(year(o_orderdate) + o_orderkey % 40 as string) || '.'"
IDENTIFIED = (
    "case when o_orderkey % 3 = 0 then 'PORTARIA N ' || cast(o_orderkey % 1201 + 10 as string) || ', DE 06 DE OUTUBRO DE ' || cast(year(o_orderdate) as string) || '. '"
    " when o_orderkey % 3 = 1 then 'Portaria nº ' || cast(o_orderkey % 1201 + 10 as string) || ' sem data ' else '' end"
    " || 'Edital nº ' || cast(o_orderkey % 90 + 1 as string) || ' / ' || cast(year(o_orderdate) as string) || '-PROGRAD; issn: '"
    " || lpad(cast(o_orderkey % 10000 as string), 4, '0') || '-' || lpad(cast(o_custkey % 1000 as string), 3, '0') || 'x, doi 10.1234/AB' || cast(o_custkey as string) || ', ISBN 978-85-' || lpad(cast(o_orderkey as string), 7, '0')"
)


@query(f"""select o_orderkey, coalesce(cast(list_last(regexp_extract_all(t, '\\b((?:19|20)\\d{{2}})\\b', 1)) as int), 0) as last_year,
 list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: cast(y as int)), lambda y: y between 1990 and 2035)))::varchar as years
 from (select o_orderkey, {DATED} as t from orders)""")
def years_in_text(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.expr(DATED).alias("t"))
    years = F.concat(F.lit("["), F.array_join(F.transform(tx.year_set(F.col("t")), lambda y: y.cast("string")), ", "), F.lit("]"))
    return t.select("o_orderkey", tx.last_year(F.col("t")).alias("last_year"), years.alias("years"))


PAIRS_SQL = """list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)portaria\\s*(?:n[º°o.]?\\s*)?(\\d{2,6})([\\s\\S]{0,50}?\\b(?:19|20)\\d{2}\\b)?', 0),
 lambda m: regexp_extract(m, '(?i)portaria\\s*(?:n[º°o.]?\\s*)?(\\d{2,6})', 1) || case when regexp_matches(m, '\\b(?:19|20)\\d{2}$') then '/' || right(m, 4) else '' end)))"""


@query(f"""select o_orderkey, array_to_string({PAIRS_SQL}, ',') as pairs,
 array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?i)portaria\\s*(?:n[º°o.]?\\s*)?(\\d{{2,6}})', 1))), ',') as numbers,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)edital\\s*(?:n[º°o.]?\\s*)?(\\d{{1,4}}\\s*/\\s*\\d{{2,4}})', 1), lambda x: replace(x, ' ', '')))), ',') as calls,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)issn[:\\s]*(\\d{{4}}\\s*-\\s*\\d{{3}}[\\dxX])', 1), lambda x: upper(replace(x, ' ', ''))))), ',') as issns,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)(10\\.\\d{{4,}}/[^\\s,;]+)', 1), lambda x: lower(x)))), ',') as dois,
 regexp_extract(t, '(10\\.\\d{{4,}}/[^\\s,;]+)', 1) as doi, regexp_extract(t, 'ISBN[:\\s]*([\\dXx\\-]{{10,17}})', 1) as isbn
 from (select o_orderkey, {IDENTIFIED} as t from orders)""")
def identifiers_in_text(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.expr(IDENTIFIED).alias("t"))
    c = F.col("t")
    lists = {"pairs": ids.ordinance_pairs(c), "numbers": ids.ordinance_numbers(c), "calls": ids.call_numbers(c), "issns": ids.issn_numbers(c), "dois": ids.doi_numbers(c)}
    return t.select("o_orderkey", *[F.array_join(v, ",").alias(k) for k, v in lists.items()], ids.first_doi(c).alias("doi"), ids.first_isbn(c).alias("isbn"))


@query("select doc_id, contains(lower(text), 'issn') or contains(lower(text), 'isbn') or contains(lower(text), 'doi') or regexp_matches(text, '10\\.\\d{4,}/') as has_pub_id from documents")
def publication_id_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.has_publication_id(F.col("text")).alias("has_pub_id"))


@query("""select item_id, cast(item_id % 7 + 2015 as string) || '_' || left(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), 60) as hash_key,
 concat_ws(' — ', k, s, case when v <> '' and not contains(lower(s), lower(v)) and length(v) < 80 then v end) || case when item_id % 3 > 0 then ' (' || cast(2000 + item_id % 3 as string) || ')' else '' end as title
 from (select *, case when length(c) > 150 then left(c, 150) || '…' else c end as s from (
  select *, case when item_id % 2 = 0 then 'Artigo' end as k, left(text, 12) || ' X' as v, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as c from benchmark))""")
def keys_and_titles(spark, sf):
    b = table(spark, sf, "benchmark")
    year = (F.col("item_id") % 7 + 2015).cast("int")
    shown = F.when(F.col("item_id") % 3 > 0, 2000 + F.col("item_id") % 3).otherwise(0)
    title = tx.display_title(F.when(F.col("item_id") % 2 == 0, "Artigo").otherwise(""), F.col("text"), F.lit(""), F.concat(F.substring("text", 1, 12), F.lit(" X")), shown)
    return b.select("item_id", tx.hash_key(year, F.col("text")).alias("hash_key"), title.alias("title"))


FOLDERS = ["/Certificados/Participação em Eventos", "/docs/Bancas", "/Formação e Cursos", "/Premiação e Títulos", "/Pareceres técnicos", "/Editoração", "/Bolsas", "/Experiência docente", "/x", "/Organização", "/Orientações"]
FOLDER = "element_at(array({}), cast(p_partkey % {} + 1 as int)) || '/' || p_name".format(", ".join(f"'{f}'" for f in FOLDERS), len(FOLDERS))
FOLDER_DUCK = f"{sql_list(FOLDERS)}[p_partkey % {len(FOLDERS)} + 1] || '/' || p_name"


def _folder_sql(path: str) -> str:
    parts = [f"case when {' or '.join(f'''contains(n, '{p}')''' for p in names)} then {sql_list(kinds)} else [] end" for names, kinds in tx.FOLDER_KINDS]
    return f"select p_partkey, array_to_string(list_sort(list_distinct(flatten([{', '.join(parts)}]))), ',') as kinds from (select p_partkey, {FOLD.format(path)} as n from part)"


@query(_folder_sql(FOLDER_DUCK))
def folder_kinds(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.folder_kinds(F.expr(FOLDER)), ",").alias("kinds"))


@query("""select o_orderkey, case when y >= 2021 then '2021_2024' when y >= 2017 then '2017_2020' when y > 0 then '2016_2019' else '2021_2024' end as quad
 from (select o_orderkey, case when o_orderkey % 5 = 0 then 0 else year(o_orderdate) + 20 end as y from orders)""")
def quad_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.quad_key(F.expr("case when o_orderkey % 5 = 0 then 0 else year(o_orderdate) + 20 end")).alias("quad"))


VENUE = "'Revista ' || p_name || case when p_partkey % 3 = 0 then ', v. ' || cast(p_size as string) || ', p. 1' when p_partkey % 3 = 1 then '. Vol. 2' else '' end"


@query(f"""select p_partkey, regexp_replace(upper('issn 2179-' || lpad(cast(p_partkey % 1000 as string), 3, '0') || 'x'), '[^\\p{{N}}X]', '', 'g') as issn,
 regexp_replace(regexp_replace(v, '(?is)[.,]?\\s*(v\\.|n\\.|p\\.|vol\\.|\\bv\\s*\\d).*$', ''), '^\\s+|\\s+$', '', 'g') as journal,
 trim(regexp_replace(regexp_replace(upper(strip_accents(v)), '[^A-Z0-9 ]', '', 'g'), ' +', ' ', 'g')) as title from (select *, {VENUE} as v from part)""")
def journal_names(spark, sf):
    v = F.col("v")
    p = table(spark, sf, "part").withColumn("v", F.expr(VENUE))
    return p.select("p_partkey", tx.norm_issn(F.expr("'issn 2179-' || lpad(cast(p_partkey % 1000 as string), 3, '0') || 'x'")).alias("issn"), tx.journal_name(v).alias("journal"), tx.norm_title(v).alias("title"))


PATHS = "'/a/b.c/Curriculo_Lattes_' || replace(c_name, '#', '-') || '_2023.' || case c_custkey % 4 when 0 then 'PDF' when 1 then 'jpg' when 2 then 'txt' else 'heic' end"


@query(f"""select c_custkey, regexp_extract(p, '([^/]*)$', 1) as name, lower(regexp_extract(p, '\\.([^.]+)$', 1)) as extension, lower(regexp_extract(p, '\\.([^.]+)$', 1)) = 'pdf' as is_pdf,
 list_contains(['jpg', 'jpeg', 'png', 'tiff', 'tif', 'heic'], lower(regexp_extract(p, '\\.([^.]+)$', 1))) as is_image from (select c_custkey, {PATHS} as p from customer)""")
def file_names(spark, sf):
    f = table(spark, sf, "customer").select("c_custkey", tx.file_parts(F.expr(PATHS)).alias("f"))
    return f.select("c_custkey", "f.name", "f.extension", "f.is_pdf", "f.is_image")


@query(f"""select c_custkey, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(trim(replace(replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', ''), '_', ' '), '-', ' ')),
 '(?i)^(curriculo lattes |curriculo |lattes )', '')), ' '), lambda w: w <> '' and not regexp_full_match(w, '\\p{{N}}+')), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') as name from (select c_custkey, {PATHS} as p from customer)""")
def clean_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.clean_name(F.regexp_extract(F.expr(PATHS), "([^/]*)$", 1)).alias("name"))


# ---- scores -----------------------------------------------------------------------------------------------------


def _files(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))


def _entries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("text").alias("title"), F.substring("text", 1, 40).alias("venue"))


IDF_SQL = f"""with w as (select item_id, unnest(list_distinct({MEANINGFUL.format(NORM.format('text'))})) as token from benchmark),
 d as (select token, count(*) as df from w group by 1), idf as (select token, df, ln(greatest((select count(*) from benchmark), 1) / (1.0 + df)) + 0.5 as weight from d)"""


@query(IDF_SQL + " select token, df, round(weight, 6) as weight from idf")
def idf_weights(spark, sf):
    return scoring.idf(_entries(spark, sf)).withColumn("weight", F.round("weight", 6))


SCORES_SQL = IDF_SQL + f""", f as (select doc_id as file_id, cert, string_split(cert, ' ') as words from (select doc_id, {NORM.format('left(text, 4000)')} as cert from documents)),
 e as (select item_id as entry_id, string_split({NORM.format('text')}, ' ') as tw, {MEANINGFUL.format(NORM.format('text'))} as sig, {MEANINGFUL.format(NORM.format('left(text, 40)'))} as vsig from benchmark),
 es as (select entry_id, 't' as side, unnest(sig) as token from e union all select entry_id, 'v', unnest(vsig) from e),
 tok as (select entry_id, side, token, count(*) as tf, coalesce(any_value(weight), (select ln(case when count(*) = 0 then 2 else count(*) end) + 0.5 from idf)) as weight from es left join idf using (token) group by all),
 tot as (select entry_id, sum(case when side = 't' then tf else 0 end) as total, sum(case when side = 't' then tf * weight else 0 end) as mass, sum(case when side = 'v' then tf * weight else 0 end) as vmass from tok group by 1),
 fw as (select distinct file_id, unnest(words) as token from f),
 met as (select file_id, entry_id, sum(case when side = 't' then tf else 0 end) as matched, sum(case when side = 't' then tf * weight else 0 end) as got, sum(case when side = 'v' then tf else 0 end) as vmatched,
  sum(case when side = 'v' then tf * weight else 0 end) as vgot from fw join tok using (token) group by 1, 2),
 ng as (select distinct entry_id, n, array_to_string(list_slice(tw, s, s + n - 1), ' ') as phrase from e, range(1, 11) r(n), range(1, 200) q(s) where n between 2 and least(len(tw), 10) and s + n - 1 <= len(tw)),
 ph as (select file_id, entry_id, max(n) as longest from met join f using (file_id) join ng using (entry_id) where matched > 0 and contains(cert, phrase) group by 1, 2),
 p as (select file_id, entry_id, matched, vmatched, total, case when mass > 0 then got / mass else 0 end as cov, case when vmass > 0 then vgot / vmass else 0 end as vcov,
  coalesce(longest, 0) / least(greatest(len(tw), 1), 10)::double as phrase from met join tot using (entry_id) join e using (entry_id) left join ph using (file_id, entry_id)),
 t as (select *, case when matched < 2 and phrase < 0.6 then 0 when total >= 3 then greatest(phrase, cov) else phrase end as ts from p),
 scores as (select file_id, entry_id, least(1, case when ts < 0.4 and vcov >= 0.6 and vmatched >= 2 then vcov * 0.8 when vcov >= 0.5 and ts >= 0.3 then least(1, ts + 0.1) else ts end) as score from t)"""


def _scores(spark, sf, least: float = 0.0) -> DataFrame:
    return scoring.text_scores(_files(spark, sf), _entries(spark, sf), least).withColumn("score", F.round("score", 6))


@query(SCORES_SQL + f" select file_id, entry_id, round(score, 6) as score from scores where score >= {scoring.GUESS}")
def text_scores(spark, sf):
    """Pairs of all files and entries that may be shown as a guess."""
    return _scores(spark, sf, scoring.GUESS)


@query(SCORES_SQL.replace("left(text, 40)", "''") + f" select file_id, entry_id, round(score, 6) as score from scores where score >= {scoring.GUESS}")
def title_scores(spark, sf):
    """Titles alone, without venues."""
    return scoring.title_scores(_files(spark, sf), _entries(spark, sf).drop("venue"), scoring.GUESS).withColumn("score", F.round("score", 6))


@query(SCORES_SQL.replace("left(text, 4000)", "text") + f" select file_id, entry_id, round(score, 6) as score from scores where score >= {scoring.GUESS}")
def whole_text_scores(spark, sf):
    """Whole texts, where the other scores read their first part."""
    return scoring.text_scores(_files(spark, sf), _entries(spark, sf), scoring.GUESS, chars=None).withColumn("score", F.round("score", 6))


RANKED_SQL = SCORES_SQL + ", r as (select file_id, entry_id, round(score, 6) as score, row_number() over (partition by file_id order by round(score, 6) desc, entry_id) as rank from scores where score > 0)"
BAND_SQL = "case when score >= 0.9 then 'confident' when score >= 0.35 then 'guess' else 'none' end"


@query(RANKED_SQL + f" select file_id, entry_id, score, {BAND_SQL} as band from r where rank = 1")
def best_entry(spark, sf):
    r = scoring.ranked(_scores(spark, sf)).where("rank = 1")
    return r.select("file_id", "entry_id", "score", scoring.band(F.col("score")).alias("band"))


@query(RANKED_SQL + " select file_id, entry_id, score, rank from r where rank <= 3")
def top_three(spark, sf):
    return scoring.ranked(_scores(spark, sf)).where("rank <= 3").select("file_id", "entry_id", "score", F.col("rank").cast("long").alias("rank"))


#: Each entry three times, as an entry repeated in other sections is.
TRIPLED_SQL = RANKED_SQL.replace("from benchmark", "from b3").replace("with w as", "with b3 as (select item_id * 3 + k as item_id, text from benchmark, range(0, 3) r(k)), w as", 1)
COMBO_SQL = TRIPLED_SQL + """, o as (select file_id, entry_id, row_number() over (partition by file_id order by rank) as k from r where rank > 1 and score >= 0.92),
 c as (select file_id, array_to_string(list(entry_id order by k), ',') as combos from o where k <= 3 group by 1)"""


def _tripled(spark, sf, least: float = 0.0) -> DataFrame:
    e = _entries(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    e = e.withColumn("entry_id", F.col("entry_id") * 3 + F.col("k")).drop("k")
    return scoring.ranked(scoring.text_scores(_files(spark, sf), e, least).withColumn("score", F.round("score", 6)))


def _combo_list(combos: str) -> Column:
    return F.array_join(F.transform(combos, lambda x: x.cast("string")), ",")


@query(COMBO_SQL + " select * from c")
def combo_entries(spark, sf):
    r = _tripled(spark, sf, scoring.GUESS)
    return scoring.combos(r, r.where("rank = 1")).select("file_id", _combo_list("combos").alias("combos"))


REVIEW_SQL = COMBO_SQL + """, v as (select doc_id as file_id, case when coalesce(score, 0) >= 0.35 then entry_id end as entry_id, coalesce(score, 0) as score,
 case when coalesce(score, 0) >= 0.9 then 'confident' when coalesce(score, 0) >= 0.35 then 'guess' else 'none' end as band, coalesce(combos, '') as combos, coalesce(text, '') <> '' and coalesce(score, 0) < 0.35 as no_likely_entry
 from documents left join (select * from r where rank = 1) x on x.file_id = doc_id left join c on c.file_id = doc_id)"""


def _review(spark, sf, least: float = 0.0) -> DataFrame:
    files = _files(spark, sf).select("file_id", (F.col("text") != "").alias("has_text"))
    return scoring.review(_tripled(spark, sf, least), files)


@query(REVIEW_SQL + " select * from v")
def limbo_review(spark, sf):
    """Files without an entry, matched again."""
    return _review(spark, sf).withColumn("combos", _combo_list("combos"))


@query(REVIEW_SQL + " select file_id, entry_id, score, row_number() over (order by score desc, file_id) as place from v")
def review_order(spark, sf):
    """The files of a review in the order in which they are shown."""
    return scoring.by_score(_review(spark, sf)).select("file_id", "entry_id", "score", "place")


@query(REVIEW_SQL + " select count(*) as n_files, count(entry_id) as n_suggested, count(*) filter (band = 'confident') as n_confident, count(*) filter (no_likely_entry) as n_unlikely from v")
def scan_counters(spark, sf):
    return scoring.scan_counters(_review(spark, sf, scoring.GUESS))


@query(RANKED_SQL + """, pr as (select r.*, coalesce(source, '') as profile_id from r join documents on doc_id = file_id), tp as (select profile_id, file_id, entry_id as top, score as top_score from pr where rank = 1 and score >= 0.35),
 two as (select tp.*, s.entry_id as second, s.score as second_score from tp left join (select * from pr where rank = 2) s using (profile_id, file_id)), cv as (select profile_id, top as entry, count(*) as n from tp group by 1, 2),
 td as (select two.*, a.n as cover_top, coalesce(b.n, 0) as cover_second from two join cv a on a.profile_id = two.profile_id and a.entry = top left join cv b on b.profile_id = two.profile_id and b.entry = second
  where top_score - second_score <= 0.08 and second_score >= 0.35 and a.n >= 2 and b.n is null),
 g as (select profile_id, list({'file_id': file_id, 'top': top, 'second': second} order by file_id) as rows, map_concat(map_from_entries(list_distinct(list((second, 0::bigint)))), map_from_entries(list_distinct(list((top, cover_top))))) as held from td group by 1),
 m as (select profile_id, list_reduce(rows, lambda s, r: case when map_extract_value(s.held, r.top) >= 2 and map_extract_value(s.held, r.second) = 0
   then {'held': map_concat(s.held, map([r.top, r.second], [map_extract_value(s.held, r.top) - 1, 1::bigint])), 'moved': list_append(s.moved, r.file_id)} else s end, {'held': held, 'moved': []::bigint[]}).moved as moved from g)
 select profile_id, file_id, case when list_contains(moved, file_id) then second else top end as entry_id, case when list_contains(moved, file_id) then second_score else top_score end as score from two left join m using (profile_id)""")
def global_assignment(spark, sf):
    """Sequential in its near ties, for each source as a profile; also held against a plain loop in the tests."""
    profile = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("source", F.lit("")).alias("profile_id"))
    return scoring.assign(scoring.ranked(_scores(spark, sf, scoring.GUESS)).join(profile, "file_id"))


YEARS = "array(year(o_orderdate), year(o_orderdate) - cast(o_orderkey % 9 as int))"


@query("""select o_orderkey, round(case when year > 0 then case when inside then least(1, score + 0.06) when gap >= 3 then score * 0.8 else score end else score end, 6) as score from (
 select *, list_bool_or(list_transform(years, lambda y: y >= year and y <= last)) as inside, list_min(list_transform(years, lambda y: least(abs(y - year), abs(y - last)))) as gap from (
 select *, case when (e >= year or e = 0) and (e <> 0 or 1997 > year) then case when e = 0 then 1997 else e end else year end as last from (
 select o_orderkey, (o_orderkey % 100 + 1) / 100.0::double as score, case when o_orderkey % 11 = 0 then 0 else 1992 + o_orderkey % 8 end as year, case when o_orderkey % 4 = 0 then 1995 + o_orderkey % 5 else 0 end as e,
 [year(o_orderdate), year(o_orderdate) - o_orderkey % 9] as years from orders)))""")
def year_adjustment(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "cast((o_orderkey % 100 + 1) / 100.0 as double) as score", "cast(case when o_orderkey % 11 = 0 then 0 else 1992 + o_orderkey % 8 end as int) as year", "cast(case when o_orderkey % 4 = 0 then 1995 + o_orderkey % 5 else 0 end as int) as e", f"{YEARS} as years")
    return o.select("o_orderkey", F.round(scoring.year_adjusted(F.col("score"), F.col("years"), F.col("year"), F.col("e"), 1997), 6).alias("score"))


@query(f"""with a as (select o_orderkey as k, unnest({PAIRS_SQL}) as c from (select o_orderkey, {IDENTIFIED} as t from orders where o_orderkey % 100 = 0)),
 b as (select o_orderkey as k, unnest({PAIRS_SQL}) as c from (select o_orderkey, {IDENTIFIED} as t from orders))
 select a.k as file_key, b.k as entry_key, max(case when split_part(a.c, '/', 2) = '' or split_part(b.c, '/', 2) = '' then 0.95 when split_part(a.c, '/', 2) = split_part(b.c, '/', 2) then 0.99 else 0 end)::double as score
 from a join b on split_part(a.c, '/', 1) = split_part(b.c, '/', 1) group by 1, 2""")
def ordinance_matches(spark, sf):
    """Searches: the orders whose number is divisible by 100, against all orders."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), ids.ordinance_pairs(F.expr(IDENTIFIED)).alias("pairs"))
    return scoring.ordinance_matches(o.where("k % 100 = 0"), o)


# ---- pair scores with identifiers, gates and folders --------------------------------------------------------------

KINDS = ["Artigo", "Livro/Capítulo", "Orientação", "Evento", "Formação", "Projeto"]


FRONT = "case doc_id % 5 when 0 then 'PORTARIA N ' || cast(100 + doc_id % 40 as string) || ', DE 1 DE MAIO DE 2020. ' when 1 then 'Edital nº ' || cast(doc_id % 40 + 1 as string) || '/2021 ' when 2 then 'ISSN 1234-' || lpad(cast(doc_id % 40 as string), 4, '0') || ' ' when 3 then 'doi 10.1000/x' || cast(doc_id % 40 as string) || ' 2015 ' else '' end"


def pair_tables(spark, sf):
    """Files from documents with an identifier in front of some, entries from benchmark with matching ones."""
    d = table(spark, sf, "documents")
    text = F.expr(f"{FRONT} || text")
    f = d.select(F.col("doc_id").alias("file_id"), F.expr("'f' || cast(doc_id as string)").alias("cert_key"), text.alias("text"))
    f = f.withColumns({"years": tx.year_set(F.substring("text", 1, scoring.TEXT_CHARS)), "folder_kinds": F.when(F.col("file_id") % 2 == 0, F.array(F.lit("Evento"), F.lit("Projeto"))).otherwise(F.array().cast("array<string>"))})
    b = table(spark, sf, "benchmark")
    e = b.selectExpr(
        "item_id as entry_id", "text as title", "substring(text, 1, 40) as venue", f"element_at(array({', '.join(repr(k) for k in KINDS)}), cast(item_id % 6 + 1 as int)) as kind",
        "case when item_id % 2 = 0 then cast(100 + item_id as string) || '/' || cast(2020 + item_id % 4 as string) else cast(100 + item_id as string) end as portaria", "cast(item_id + 1 as string) || '/2021' as edital",
        "'10.1000/x' || cast(item_id as string) as doi", "'1234-' || lpad(cast(item_id as string), 4, '0') as issn", "cast(2012 + item_id % 10 as int) as year", "cast(case when item_id % 3 = 0 then 2021 else 0 end as int) as end_year", "'h' || cast(item_id as string) as hash_key",
    )
    r = d.selectExpr("'f' || cast(doc_id as string) as cert_key", "'h' || cast(doc_id % 40 as string) as hash_key")
    return f, e, r


NAMED = "case when doc_id % 3 = 0 then 'Certificado_2019-curso' when doc_id % 3 = 1 then 'norma-Técnica ' || cast(1990 + doc_id % 60 as string) else 'x' end"
NAMED_PATH = f"'/r/' || case when doc_id % 4 = 0 then 'Bancas/' when doc_id % 4 = 1 then 'Eventos/Cursos/' else '' end || {NAMED} || '.' || cast(doc_id as string) || '.pdf'"


@query(f"""with d as (select doc_id, {NAMED} || '.' || cast(doc_id as string) as stem, coalesce(text, '') as t, case when doc_id % 4 = 0 then ['Banca'] when doc_id % 4 = 1 then list_sort(['Evento', 'Apresentação', 'Organização de evento', 'Trabalho em evento', 'Formação']) else [] end as kinds from documents),
 y as (select *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(translate(stem, '_-', '  '), '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: cast(y as int)), lambda y: y between 1990 and 2035))) as ny,
  list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: cast(y as int)), lambda y: y between 1990 and 2035))) as ty from d)
 select doc_id, stem as cert_key, md5(t || ' ' || chr(10) || ' ' || translate(stem, '_-', '  ')) as text_md5, array_to_string(case when len(ny) > 0 then ny else ty end, ',') as years, array_to_string(kinds, ',') as kinds, t <> '' as has_text from y""")
def scan_input(spark, sf):
    """Documents as scanned files: matched by text and name, dated by the name first, hinted at by their folder."""
    f = src.scanned(table(spark, sf, "documents").select(F.expr(NAMED_PATH).alias("path"), F.lit("/r").alias("root"), "text"))
    return f.select(F.regexp_extract("file_id", "(\\d+)\\.pdf$", 1).cast("long").alias("doc_id"), "cert_key", F.md5("text").alias("text_md5"), F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), F.array_join("folder_kinds", ",").alias("kinds"), "has_text")


_KNOWN = lambda pattern, change="x": f"list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: {change})"
PAIR_SQL = SCORES_SQL.replace("with w as", f"with docs as (select doc_id, {FRONT} || text as text from documents), w as", 1).replace("as cert from documents))", "as cert from docs))") + f""",
 ft as (select doc_id as file_id, left(text, 4000) as t, case when doc_id % 2 = 0 then ['Evento', 'Projeto'] else [] end as folder_kinds from docs),
 fx as (select *, {PAIRS_SQL} as pairs, {_KNOWN("(?i)edital\\s*(?:n[º°o.]?\\s*)?(\\d{1,4}\\s*/\\s*\\d{2,4})", "replace(x, ' ', '')")} as calls, {_KNOWN("(?i)issn[:\\s]*(\\d{4}\\s*-\\s*\\d{3}[\\dxX])", "upper(replace(x, ' ', ''))")} as issns, {_KNOWN("(?i)(10\\.\\d{4,}/[^\\s,;]+)", "lower(x)")} as dois,
  list_filter({_KNOWN("\\b((?:19|20)\\d{2})\\b", "cast(x as int)")}, lambda y: y between 1990 and 2035) as years, contains(lower(t), 'issn') or contains(lower(t), 'isbn') or contains(lower(t), 'doi') or regexp_matches(t, '10\\.\\d{{4,}}/') as has_pub from ft),
 en as (select item_id as entry_id, {sql_list(KINDS)}[item_id % 6 + 1] as kind, case when item_id % 2 = 0 then cast(100 + item_id as string) || '/' || cast(2020 + item_id % 4 as string) else cast(100 + item_id as string) end as portaria, cast(item_id + 1 as string) || '/2021' as edital,
  '10.1000/x' || cast(item_id as string) as doi, '1234-' || lpad(cast(item_id as string), 4, '0') as issn, 2012 + item_id % 10 as year, case when item_id % 3 = 0 then 2021 else 0 end as end_year from benchmark),
 ap as (select *, coalesce(score, 0) as ts, coalesce(list_max(list_transform(pairs, lambda c: case when split_part(c, '/', 1) <> split_part(portaria, '/', 1) then 0 when split_part(c, '/', 2) = '' or split_part(portaria, '/', 2) = '' then 0.95 when split_part(c, '/', 2) = split_part(portaria, '/', 2) then 0.99 else 0 end)), 0)::double as ord
  from fx cross join en left join scores using (file_id, entry_id) where file_id % 40 <> entry_id and (kind not in ('Artigo', 'Livro/Capítulo') or has_pub) and not (kind in ('Orientação', 'Formação') and (len(pairs) > 0 or contains(lower(t), 'portaria')))),
 rw as (select *, ord > 0 or list_contains(calls, edital) or list_contains(dois, doi) as is_identifier, case when ord > 0 then ord when list_contains(calls, edital) then 0.99 when list_contains(dois, doi) then 1.0 when ts > 0.2 and list_contains(issns, issn) then least(1, ts + 0.15) else ts end::double as raw,
  case when (end_year >= year or end_year = 0) and (end_year <> 0 or 2024 > year) then case when end_year = 0 then 2024 else end_year end else year end as last from ap),
 ag as (select *, case when raw > 0 and year > 0 and len(years) > 0 then case when list_bool_or(list_transform(years, lambda y: y >= year and y <= last)) then least(1, raw + 0.06) when list_min(list_transform(years, lambda y: least(abs(y - year), abs(y - last)))) >= 3 then raw * 0.8 else raw end else raw end as aged from rw),
 sc as (select file_id, entry_id, is_identifier, case when is_identifier then least(1, aged) else least(0.97, aged + case when list_contains(folder_kinds, kind) and aged > 0 then 0.2 else 0 end) end as total from ag)
 select file_id, entry_id, round(total, 6) as score, is_identifier from sc where total > 0 and total >= {scoring.GUESS}"""


@query(PAIR_SQL)
def pair_scores(spark, sf):
    """All rules of the pair score; also held against a plain loop over all pairs in the tests."""
    f, e, r = pair_tables(spark, sf)
    return scoring.pair_scores(f, e, scoring.Options(as_of_year=2024), r, scoring.GUESS).withColumn("score", F.round("score", 6))


# ---- links --------------------------------------------------------------------------------------------------------


def _links(spark, sf) -> DataFrame:
    """Line items as files, confirmed if shipped; those returned (flag R) are linked to nothing."""
    entry = F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))
    return table(spark, sf, "lineitem").withColumn("entry_id", entry).withColumn("is_confirmed", F.col("l_linestatus") == "F")


def _status(spark, sf) -> DataFrame:
    """Orders as entries of the sections (market segments) of nations, with the status that their files give them."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = o.select(F.col("o_orderkey").alias("entry_id"), F.col("c_nationkey").alias("profile"), F.col("c_mktsegment").alias("section"))
    li = _links(spark, sf).select("entry_id", "is_confirmed")
    return links.entry_status(e, li)


STATUS_SQL = """with n as (select l_orderkey as entry_id, count(*) as n_links, count(*) filter (l_linestatus = 'F') as n_confirmed from lineitem where l_returnflag <> 'R' group by 1),
 s as (select o_orderkey as entry_id, c_nationkey as profile, c_mktsegment as section, coalesce(n_links, 0) as n_links, coalesce(n_confirmed, 0) as n_confirmed,
 case when coalesce(n_confirmed, 0) > 0 then 'confirmed' when coalesce(n_links, 0) > 0 then 'suggested' else 'none' end as status from orders join customer on o_custkey = c_custkey left join n on n.entry_id = o_orderkey)"""


@query(STATUS_SQL + " select * from s")
def entry_status(spark, sf):
    return _status(spark, sf).select("entry_id", "profile", "section", "n_links", "n_confirmed", "status")


@query(STATUS_SQL + """ select profile, section, count(*) filter (status = 'none') as n_none, count(*) filter (status = 'suggested') as n_suggested, count(*) filter (status = 'confirmed') as n_confirmed, count(*) as n_total,
 cast(grouping(profile, section) as bigint) as level, round(count(*) filter (status = 'confirmed') / count(*)::double, 6) as coverage from s group by rollup (profile, section)""")
def status_rollup(spark, sf):
    return links.rollup(_status(spark, sf).select("profile", "section", "status"), ["profile", "section"]).withColumn("coverage", F.round("coverage", 6))


@query(STATUS_SQL + " select profile, section, count(*) as n_pending from s where status <> 'confirmed' group by 1, 2")
def pending_sections(spark, sf):
    return links.pending(_status(spark, sf)).groupBy("profile", "section").agg(F.count(F.lit(1)).alias("n_pending"))


@query("select o_orderkey as entry_id, coalesce(max(l_linenumber), -1) + 1 as next_order from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag <> 'R' group by 1")
def next_order(spark, sf):
    li = _links(spark, sf).select("entry_id", F.col("l_linenumber").alias("cert_order"))
    return links.next_order(table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id")), li)


EVENTS = "case event_type when 'purchase' then 'confirm' when 'click' then 'suggest' when 'view' then 'skip' when 'signup' then 'combo' else case when event_id % 2 = 0 then 'undo' else 'delete' end end"


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id as file_id", "event_id as seq", f"{EVENTS} as kind", "event_id % 5 as entry_id", "case when event_id % 3 > 0 then (event_id + event_id % 2) % 5 end as suggested_id")


@query(f"""with e as (select user_id as file_id, event_id as seq, {EVENTS} as kind, event_id % 5 as entry_id from events),
 m as (select file_id, max(seq) filter (kind <> 'delete') as at, arg_max(kind, seq) filter (kind <> 'delete') as kind, arg_max(entry_id, seq) filter (kind <> 'delete') as entry_id from e where kind <> 'combo' group by 1),
 p as (select file_id, entry_id, arg_max(kind, seq) as kind, max(seq) as at from e where kind in ('combo', 'delete') group by 1, 2),
 x as (select m.file_id, case when m.kind in ('confirm', 'suggest') and p.file_id is null then m.entry_id end as entry_id, coalesce(m.kind = 'confirm', false) and p.file_id is null as is_confirmed
  from m left join p on p.file_id = m.file_id and p.entry_id = m.entry_id and p.kind = 'delete' and p.at > m.at and m.kind in ('confirm', 'suggest'))
 select * from x union all select p.file_id, p.entry_id, true from p where p.kind = 'combo' and not exists (select 1 from x where x.file_id = p.file_id and x.entry_id = p.entry_id)""")
def link_state(spark, sf):
    return links.state(_events(spark, sf))


@query(f"""select distinct file_id, 'h' || cast(suggested_id as string) as hash_key from (select user_id as file_id, {EVENTS} as kind, event_id % 5 as entry_id, case when event_id % 3 > 0 then (event_id + event_id % 2) % 5 end as suggested_id from events)
 where suggested_id is not null and (kind = 'skip' or (kind = 'confirm' and entry_id <> suggested_id))""")
def learned_rejections(spark, sf):
    e = spark.range(50).select(F.col("id").alias("entry_id"), F.expr("'h' || cast(id as string)").alias("hash_key"))
    return links.rejections(_events(spark, sf), e)


@query("""select o_orderkey as file_id, 'k' || cast(o_custkey as string) as hash_key, m as entry_id from orders left join (select c_custkey // 2 * 3 as k, min(c_custkey) as m from customer group by 1) on k = o_custkey""")
def relink_by_hash(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.expr("'k' || cast(o_custkey as string)").alias("hash_key"))
    e = table(spark, sf, "customer").selectExpr("'k' || cast(c_custkey div 2 * 3 as string) as hash_key", "0 as section_order", "0 as entry_order", "c_custkey as entry_id")
    return links.relink(f, e)


@query(RANKED_SQL + " select doc_id as file_id, case when doc_id % 4 = 0 then doc_id % 10 else entry_id end as entry_id from documents left join (select * from r where rank = 1 and score >= 0.9) on file_id = doc_id")
def relink_fallback(spark, sf):
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.expr("case when doc_id % 4 = 0 then doc_id % 10 end").alias("entry_id"))
    return links.relink_fallback(left, scoring.ranked(_scores(spark, sf, scoring.CONFIDENT - 1e-6)))


@query("select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_partkey order by l_linenumber, l_shipdate, l_orderkey) - 1 as cert_order from lineitem")
def reorder_links(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey as file_id", "l_partkey as entry_id", "l_linenumber as cert_order", "l_shipdate as import_date", "l_linenumber")
    return links.reorder(li).select(F.col("file_id").alias("l_orderkey"), F.col("entry_id").alias("l_partkey"), "l_linenumber", F.col("cert_order").cast("long").alias("cert_order"))


@query("select p_name || cast(p_partkey % 100 as string) as path from part where p_name || cast(p_partkey % 100 as string) not in (select p_name || cast(p_partkey % 100 as string) from part where p_size < 20)")
def incremental_files(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_name || cast(p_partkey % 100 as string) as path", "p_partkey")
    return links.incremental(p.select("path"), p.where("p_size < 20"))


# ---- duplicates ---------------------------------------------------------------------------------------------------


def _raw_entries(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.selectExpr("cast(conv_id % 20 as long) as section_id", "conv_id * 1000 + turn as entry_id", "conv_id * 1000 + turn as entry_order", "cast(2000 + conv_id % 3 as int) as year", "text || case when turn % 2 = 0 then ', 2020' else '' end as raw_text", "text as title", "turn as sec_no")


EXACT_SQL = f"""with e as (select conv_id % 20 as section_id, conv_id * 1000 + turn as entry_id, 2000 + conv_id % 3 as year, {NORM.format("text || case when turn % 2 = 0 then ', 2020' else '' end")} as norm from conversations),
 x as (select * from (select *, row_number() over (partition by section_id, year, norm order by entry_id) as n from e) where n = 1)"""


@query(EXACT_SQL + " select section_id, entry_id from x")
def dedupe_exact(spark, sf):
    return dedupe.exact(_raw_entries(spark, sf), ["section_id"], "entry_order").select("section_id", "entry_id")


@query(EXACT_SQL + """ select section_id, entry_id from x where not (length(norm) >= 30 and regexp_matches(norm, '(19|20)\\d{2}$')
 and exists (select 1 from x y where y.section_id = x.section_id and y.year = x.year and length(y.norm) > length(x.norm) + 4 and starts_with(y.norm, x.norm)))""")
def dedupe_truncated(spark, sf):
    return dedupe.deduped(_raw_entries(spark, sf), ["section_id"]).select("section_id", "entry_id")


@query()
def merge_section_bodies(spark, sf):
    """Turns as the bodies of conversations, of any number; sequential, and held against a plain loop in the tests."""
    e = _raw_entries(spark, sf).withColumn("section_id", F.floor(F.col("entry_id") / 1000))
    return dedupe.merge_bodies(e, ["section_id"]).select("section_id", "entry_id", F.col("entry_order").cast("long").alias("entry_order"))


# ---- journal ranks ------------------------------------------------------------------------------------------------


def _ranks(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.selectExpr(
        "element_at(array('2016_2019', '2017_2020', '2021_2024'), cast(p_partkey % 3 + 1 as int)) as quad", "p_partkey as row_no", "case when p_partkey % 4 = 0 then '' else '1' || lpad(cast(p_partkey % 500 as string), 7, '0') end as issn",
        "upper(regexp_replace(p_name, '[^A-Za-z0-9 ]', '')) || ' ' || upper(substring(p_type, 1, 20)) as title", "case when p_partkey % 2 = 0 then 'FILOSOFIA' else 'DIREITO' end as area", "case when p_partkey % 13 = 0 then '' else 'A' || cast(p_size % 4 + 1 as string) end as estrato",
    )


RANKS_SQL = """r as (select ['2016_2019', '2017_2020', '2021_2024'][p_partkey % 3 + 1] as quad, p_partkey % 3 as qn, p_partkey as row_no, case when p_partkey % 4 = 0 then '' else '1' || lpad(cast(p_partkey % 500 as string), 7, '0') end as issn,
 upper(regexp_replace(p_name, '[^A-Za-z0-9 ]', '', 'g')) || ' ' || upper(left(p_type, 20)) as title, case when p_partkey % 2 = 0 then 'FILOSOFIA' else 'DIREITO' end as area, case when p_partkey % 13 = 0 then '' else 'A' || cast(p_size % 4 + 1 as string) end as estrato from part)"""


@query("with " + RANKS_SQL + " select distinct area from r")
def rank_areas(spark, sf):
    return ranking.areas(_ranks(spark, sf))


def _articles(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.selectExpr("p_partkey as entry_id", "upper(regexp_replace(p_name, '[^A-Za-z0-9 ]', '')) || ' ' || upper(substring(p_type, 1, 20)) || case p_partkey % 5 when 0 then ' EXTRA, v. 3' when 1 then ' NOVA SERIE' else '' end as venue", "case when p_partkey % 7 = 0 then '1' || lpad(cast(p_partkey % 500 as string), 7, '0') else '' end as issn", "cast(case p_partkey % 3 when 0 then 2016 when 1 then 2018 else 2022 end as int) as year")


@query("with " + RANKS_SQL + """, m as (select * from r where area = 'FILOSOFIA' and estrato <> ''), bi as (select quad, issn, arg_max(estrato, row_no) as e from m where issn <> '' group by 1, 2), bt as (select quad, title, arg_max(estrato, row_no) as e from m where title <> '' group by 1, 2),
 c1 as (select quad, qn, title, arg_max(issn, row_no) as issn from r where title <> '' and issn <> '' group by 1, 2, 3), cr as (select title, arg_min(issn, qn) as issn from c1 group by 1),
 a as (select p_partkey as entry_id, upper(regexp_replace(p_name, '[^A-Za-z0-9 ]', '', 'g')) || ' ' || upper(left(p_type, 20)) || case p_partkey % 5 when 0 then ' EXTRA, v. 3' when 1 then ' NOVA SERIE' else '' end as venue,
  case when p_partkey % 7 = 0 then '1' || lpad(cast(p_partkey % 500 as string), 7, '0') else '' end as issn, ['2016_2019', '2017_2020', '2021_2024'][p_partkey % 3 + 1] as quad from part),
 n as (select entry_id, quad, issn, trim(regexp_replace(venue, '(?is)[.,]?\\s*(v\\.|n\\.|p\\.|vol\\.|\\bv\\s*\\d).*$', '')) as title, list_distinct(list_filter(string_split(trim(regexp_replace(venue, '[^A-Z0-9 ]', '', 'g')), ' '), lambda w: length(w) >= 3)) as vw from (select * replace (upper(venue) as venue) from a)),
 mw as (select quad, row_no, estrato, list_distinct(list_filter(string_split(title, ' '), lambda w: length(w) >= 3)) as tw from m where title <> ''),
 z as (select entry_id, arg_max(estrato, (len(list_intersect(vw, tw)) / least(len(vw), len(tw))::double) * 1e9 - row_no) as e from n join mw using (quad) where len(vw) >= 2 and len(tw) >= 2 and len(list_intersect(vw, tw)) >= 2 and len(list_intersect(vw, tw)) / least(len(vw), len(tw))::double >= 0.8 group by 1)
 select n.entry_id, replace(n.quad, '_', '-') as quadriennium, coalesce(bi.e, bt.e, bx.e, z.e) as estrato, case when bi.e is not null then 'issn' when bt.e is not null then 'title' when bx.e is not null then 'cross' when z.e is not null then 'similar' end as how
 from n left join bi on bi.quad = n.quad and bi.issn = n.issn left join bt on bt.quad = n.quad and bt.title = n.title left join cr on cr.title = n.title left join bi bx on bx.quad = n.quad and bx.issn = cr.issn left join z on z.entry_id = n.entry_id""")
def rank_cascade(spark, sf):
    return ranking.classify(_articles(spark, sf), _ranks(spark, sf), "FILOSOFIA")


# ---- segmentation -------------------------------------------------------------------------------------------------

HEADS = [
    "Projetos de", "pesquisa", "Formação complementar", "Livros publicados (completo)", "Orientações e supervisões concluídas", "Iniciação científica", "Bancas", "Organização de evento)", "2019 - Atual Universidade", "", "Currículo Lattes", "01/02/2023, 10:11 x",
    "Formação acadêmica/titulação", "Mestrado em Letras, 2010", "Atuação profissional", "Universidade do Sul - US, Brasil", "2001 - Atual Vínculo: Servidor, Enquadramento funcional: Professor", "03/2002 - 05/2004 Graduação", "Disciplinas ministradas:", "Especificação:", "Prêmios e títulos",
    "2012", "Projetos de extensão", "Descrição: um projeto, 2015", "Organização de evento", "Participação em eventos", "Participação em banca de trabalhos de conclusão", "Doutorado", "1. Participação em banca de Ana Lima. Tese, 2019. (Letras) Universidade X.", "1.", "2.", "Totais de produção",
]
CV = f"array_join(transform(split(text, '\\n'), (x, k) -> case when (doc_id + k * 7) % 3 = 0 then concat(element_at(array({', '.join(repr(h) for h in HEADS)}), cast((doc_id * 5 + k * 11) % {len(HEADS)} + 1 as int)), '\\n', x) else x end), '\\n')"


def _cv(spark, sf) -> DataFrame:
    """Whole documents, with headers and marks before some of their lines."""
    return table(spark, sf, "documents").select("doc_id", F.expr(CV).alias("text"))


CV_SQL = f"""d as (select doc_id, string_split(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case when (doc_id + (i - 1) * 7) % 3 = 0 then {sql_list(HEADS)}[(doc_id * 5 + (i - 1) * 11) % {len(HEADS)} + 1] || chr(10) || x else x end), chr(10)), chr(10)) as ls from documents),
 l as (select doc_id, unnest(range(0, len(ls))) as line_no, regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') as line from d)"""
NOISE_SQL = "(contains(line, 'wwws.cnpq.br') or starts_with(line, 'impcv.trata') or regexp_matches(line, '^\\d{2}/\\d{2}/\\d{4},?\\s*\\d{1,2}:\\d{2}') or list_contains(" + sql_list(segment.NOISE_LINES) + ", line))"


@query(f"with {CV_SQL} select doc_id, line_no, line from l where not {NOISE_SQL}")
def noise_filter(spark, sf):
    return segment.lines(_cv(spark, sf)).where(~segment.is_noise(F.col("line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def _header_sql(norm: str) -> str:
    rows = " ".join(
        f"when {norm} = '{n}'" + (f" or (starts_with({norm}, '{n}') and len({norm}) - len(replace({norm}, ')', '')) <= len({norm}) - len(replace({norm}, '(', '')))" if len(n) >= segment.PREFIX_LEAST else "") + f" then '{d}'" for n, d, _, _ in segment.HEADERS
    )
    return f"case when {norm} = '{segment.STOP}' then 'stop' when list_contains({sql_list(segment.EXCLUDED)}, {norm}) then 'excluded' when {norm} = '{segment.DONE}' then 'done' when {norm} = '{segment.ONGOING}' then 'ongoing' {rows} end"


@query(f"with {CV_SQL}, n as (select doc_id, line_no, strip_accents(lower(line)) as norm from l) select * from (select doc_id, line_no, {_header_sql('norm')} as header from n) where header is not null")
def header_classify(spark, sf):
    h = segment.header(segment.header_name(F.col("line")), segment.closes_more(F.col("line")))
    l = segment.lines(_cv(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), h.alias("h")).where("h is not null")  # noqa: E741
    return l.select("doc_id", "line_no", F.when(F.col("h.cls") == "section", F.col("h.display")).otherwise(F.col("h.cls")).alias("header"))


def _label_sql() -> str:
    rules = " ".join(f"when {' or '.join(f'''contains(norm, '{p}')''' for p in names)} then '{kind}'" for names, kind in tx.KIND_LABELS)
    return f"with {CV_SQL}, n as (select doc_id, line_no, strip_accents(lower(line)) as norm from l) select doc_id, line_no, case {rules} else '' end as kind from n where {_header_sql('norm')} is not null"


@query(_label_sql())
def kind_labels(spark, sf):
    """Kinds of the entries under each header line of the documents."""
    h = segment.header(segment.header_name(F.col("line")), segment.closes_more(F.col("line")))
    l = segment.lines(_cv(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", h.alias("h")).where("h is not null")  # noqa: E741
    return l.select("doc_id", "line_no", tx.kind_label(F.col("line")).alias("kind"))


def _closes_sql(text: str) -> str:
    return f"(len({text}) - len(replace({text}, ')', '')) > len({text}) - len(replace({text}, '(', '')))"


CHILDREN = [display for _, display, _, child in segment.HEADERS if child]
MODES = {display: mode for _, display, mode, _ in segment.HEADERS}
SECTIONS_SQL = f"""{CV_SQL}, n as (select *, {NOISE_SQL} as noise, strip_accents(lower(line)) as norm, lead(line) over (partition by doc_id order by line_no) as after from l),
 f as (select *, strip_accents(lower(line || ' ' || after)) as both_norm, {_header_sql('norm')} as own from n),
 b as (select *, case when not noise and norm <> '' and own is null and not {_closes_sql('line')} and after <> '' and not {NOISE_SQL.replace('line', 'after')} then {_header_sql('both_norm')} end as joined from f),
 o as (select *, coalesce(joined not in ('stop', 'done', 'ongoing'), false) as opens from b),
 r as (select *, sum(cast(not opens as int)) over (partition by doc_id order by line_no) as run from o),
 t as (select *, opens and sum(cast(opens as int)) over (partition by doc_id, run order by line_no) % 2 = 1 as takes from r),
 k as (select *, coalesce(lag(takes) over (partition by doc_id order by line_no), false) as taken from t),
 m as (select *, case when not taken and not noise and norm <> '' then case when takes then joined else own end end as head from k),
 c as (select *, list_contains({sql_list(CHILDREN)}, head) as child, bool_or(coalesce(head = 'stop', false)) over (partition by doc_id order by line_no) as stopped from m),
 g as (select *, coalesce(last_value(case when head = 'done' then ' (concluídas)' when head = 'ongoing' then ' (em andamento)' when not child then '' end ignore nulls) over (partition by doc_id order by line_no), '') as suffix from c where not stopped),
 a as (select *, last_value(case when head is not null then {{'sec_no': line_no, 'open': head not in ('excluded', 'done', 'ongoing'), 'title': case when child then 'Orientações - ' || head || suffix else head end, 'head': head}} end ignore nulls) over (partition by doc_id order by line_no) as mark from g),
 q as (select doc_id, mark.sec_no as sec_no, mark.title as title, mark.head as head, line_no, line from a where mark.open and head is null and not taken and not noise),
 s as (select doc_id, sec_no, title, {sql_list(MODES.values())}[list_position({sql_list(MODES)}, head)] as mode, line_no, line from (select *, max(length(line)) over (partition by doc_id, sec_no) as longest from q) where longest > 0)"""


@query(f"with {SECTIONS_SQL} select * from s")
def section_assign(spark, sf):
    """Sections of lines; also held against a plain state machine in the tests."""
    return segment.sections(_cv(spark, sf)).select("doc_id", F.col("sec_no").cast("long").alias("sec_no"), "title", "mode", F.col("line_no").cast("long").alias("line_no"), "line")


@query()
def cv_entries(spark, sf):
    """Entries of whole texts, each section read in its own way; held against examples and plain loops in the tests."""
    return parse.cv_entries(_cv(spark, sf))


OWNED = "case doc_id % 4 when 0 then 'Maria da Silva\n\nEndereço para acessar este CV: x\n' when 1 then 'Texto 12\nNome Ana Lima\n' when 2 then 'Ver artigos: 3\nEndereço para acessar este CV: x\nNome em citações\n' else '' end"
OWNED_DUCK = OWNED.replace("\n", "' || chr(10) || '")


@query(f"""with {CV_SQL.replace("coalesce(text, '')", f"{OWNED_DUCK} || coalesce(text, '')", 1)}, n as (select doc_id, line_no, line, lower(line) as low, regexp_replace(substr(line, 6), '^\\s+|\\s+$', '', 'g') as rest from l),
 k as (select *, length(line) between 5 and 70 and not regexp_matches(line, 'http|[:@/]|\\d') and not regexp_matches(low, 'curríc|curric|anotou|ver artigos|visualizar|endereço') and len(list_filter(string_split(line, ' '), lambda x: length(x) >= 2)) >= 2 as looks,
  starts_with(line, 'Nome ') and length(rest) between 3 and 69 and not starts_with(lower(rest), 'em ') and not contains(lower(rest), 'citaç') as labelled from n),
 a as (select *, last_value(case when line <> '' then line end ignore nulls) over w as above, last_value(case when line <> '' then looks end ignore nulls) over w as above_looks from k window w as (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding)),
 g as (select doc_id, arg_min(above, line_no) filter (contains(line, 'Endereço para acessar este CV') and above is not null) as a, arg_min(above_looks, line_no) filter (contains(line, 'Endereço para acessar este CV') and above is not null) as a_looks,
  arg_min(rest, line_no) filter (labelled) as b, arg_min(line, line_no) filter (looks) as c from a group by 1)
 select doc_id, coalesce(case when a_looks then a end, b, c, 'Currículo Lattes') as name from g""")
def owner_names(spark, sf):
    """Documents with an address line after a name, a labelled name, an address line after no name, or none of them."""
    return segment.owner_name(table(spark, sf, "documents").select("doc_id", F.concat(F.expr(OWNED), F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", F.expr(CV).alias("text")))


@query(f"""with {SECTIONS_SQL}, y as (select doc_id, title, sec_no, string_agg(line, chr(10) order by line_no) as body from s group by 1, 2, 3),
 z as (select doc_id, title, min(sec_no) as first, count(*) as n_bodies, string_agg(body, chr(10) || chr(12) || chr(10) order by sec_no) as bodies from y group by 1, 2)
 select doc_id, title, row_number() over (partition by doc_id order by first) - 1 as place, n_bodies, bodies from z""")
def section_bodies(spark, sf):
    """Bodies by title, as the titles are first seen, parted by page breaks."""
    b = segment.by_title(segment.bodies(segment.sections(_cv(spark, sf))))
    return b.select("doc_id", "title", F.col("place").cast("long").alias("place"), F.size("bodies").cast("long").alias("n_bodies"), F.array_join("bodies", "\n\f\n").alias("bodies"))


NUMBERED = "case when o_orderkey % 2 = 1 then cast(o_orderkey % 90 + 1 as string) || '. ' else '' end || 'item ' || cast(o_custkey as string)"


def _lines_of(spark, sf, line: str) -> DataFrame:
    """Orders as the lines of their customers' bodies."""
    return table(spark, sf, "orders").selectExpr("o_custkey as body", "cast(o_orderkey as int) as line_no", f"{line} as line")


@query(f"""with l as (select o_custkey as body, o_orderkey as line_no, {NUMBERED} as line from orders),
 n as (select *, row_number() over (partition by body order by line_no) as k from l),
 c as (select *, sum(case when k > 1 and regexp_matches(line, '^\\s*\\d{{1,3}}\\.(\\s+\\S|\\s*$)') then 1 else 0 end) over (partition by body order by line_no) as chunk_no from n)
 select body, cast(chunk_no as bigint) as chunk_no, array_to_string(list(regexp_replace(line, '^\\s*\\d{{1,3}}\\.\\s*', '') order by line_no), ' ') as chunk from c group by 1, 2""")
def split_numbered(spark, sf):
    return segment.split_numbered(_lines_of(spark, sf, NUMBERED), ["body"]).select("body", "chunk_no", "chunk")


DETACHED = "case when o_orderkey % 3 = 0 then 'text' || cast(o_custkey as string) when o_orderkey % 7 = 0 then '' else cast(o_orderkey % 3 + o_custkey % 50 as string) || '.' end"


@query(f"""with l as (select o_custkey as body, o_orderkey as line_no, {DETACHED} as line from orders), f as (select * from l where line <> ''),
 v as (select *, try_cast(regexp_extract(line, '^(\\d{{1,3}})\\.$', 1) as int) as v, row_number() over (partition by body order by line_no) as k from f),
 n as (select *, v = lag(v) over (partition by body order by k) + 1 as follows from v), a as (select body, bool_or(coalesce(follows, false)) as apart from n group by 1)
 select body, cast(line_no as int) as line_no, line from n join a using (body) where v is null or not apart""")
def detached_numbers(spark, sf):
    return segment.detached_numbers(_lines_of(spark, sf, DETACHED), ["body"]).select("body", "line_no", "line")


PERIOD_TEXT = "'lost ' || cast(year(o_orderdate) as string) || ' - ' || case when o_orderkey % 2 = 0 then 'Atual' else cast(year(o_orderdate) + 2 as string) end || ' first ' || o_orderpriority || ' ' || cast(year(o_orderdate) + 4 as string) || ' - 2005 second'"


@query(f"""select o_orderkey, cast(left(c, 4) as int) as start_year, coalesce(try_cast(regexp_extract(c, '^\\d{{4}}\\s*-\\s*(\\d{{4}})', 1) as int), 0) as end_year, trim(regexp_replace(c, '^\\d{{4}}\\s*-\\s*(?:\\d{{4}}|Atual)', '')) as chunk
 from (select o_orderkey, unnest(string_split(regexp_replace(t, '(\\d{{4}}\\s*-\\s*(?:\\d{{4}}|Atual))', chr(1) || '\\1', 'g'), chr(1))[2:]) as c from (select o_orderkey, {PERIOD_TEXT} as t from orders))""")
def split_periods(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(segment.split_periods(F.expr(PERIOD_TEXT))).alias("c"))
    return o.select("o_orderkey", F.col("c.start").alias("start_year"), F.col("c.end").alias("end_year"), "c.chunk")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
ANCHOR_SQL = f"""with e as (select conv_id as body, cast(conv_id * 1000 + turn as int) as line_no, text || case when turn % 2 = 0 then ', 2020' else '' end as raw from conversations),
 b as (select body, line_no, case line_no % 4 when 0 then raw || ', 2021.' when 1 then 'https://x' when 2 then left(raw, 40) else '(Tipo) ' || left(raw, 30) || '.' end as line from e),
 l as (select * from (select body, line_no, regexp_replace(regexp_replace(line, '^\\s*(\\d{{1,3}}\\.\\s+){{2,}}', ''), '^\\s*\\d{{1,3}}\\.\\s*', '') as line from b) where line <> ''),
 t as (select *, lead(line) over (partition by body order by line_no) as after, {_STRIP.format("regexp_replace(line, '\\s*Citações:\\s*\\d+(\\s*\\|\\s*\\d+)?\\s*$', '')")} as tail, {_STRIP.format(FOLD.format("line"))} as n from l),
 f as (select *, (regexp_matches(tail, '(\\.|\\."|"\\.|\\)\\.)$') or regexp_matches(tail, '(19|20)\\d{{2}}\\.?$')) and not (regexp_matches(tail, '(19|20)\\d{{2}}\\.?$') and coalesce(starts_with(after, '('), false)) as ends, regexp_matches(line, '\\b(19|20)\\d{{2}}\\b') as dated,
  regexp_matches(n, '^({"|".join(segment.METADATA)})') or regexp_matches(line, '^(http|www\\.|\\[http|\\[www\\.|\\p{{Ll}}|-|–)') or regexp_matches(n, '^(portaria|edital)') or (length(line) <= 90 and regexp_matches(n, '(portaria|edital)\\s*n'))
  or (length(line) <= 160 and not contains(left(line, 50), ',') and not regexp_matches(line, '\\b(19|20)\\d{{2}}\\b')) as glue from t),
 g as (select body, list({{'line': line, 'ends': ends, 'glue': glue, 'dated': dated}} order by line_no) as rows from f group by 1),
 k as (select body, rows, list_reduce(rows, lambda s, r: case when s.fresh and s.chunk > 0 and r.glue then {{'ids': list_append(s.ids, s.chunk - 1), 'chunk': s.chunk, 'fresh': s.fresh, 'dated': s.dated}}
   else {{'ids': list_append(s.ids, s.chunk), 'chunk': case when (s.dated or r.dated) and r.ends then s.chunk + 1 else s.chunk end, 'fresh': (s.dated or r.dated) and r.ends, 'dated': (s.dated or r.dated) and not r.ends}} end,
   {{'ids': []::bigint[], 'chunk': 0::bigint, 'fresh': true, 'dated': false}}).ids as ids from g),
 u as (select body, unnest(ids) as chunk_no, unnest(range(1, len(rows) + 1)) as k_no, unnest(rows) as r from k)
 select body, chunk_no, string_agg(r.line, ' ' order by k_no) as chunk from u group by 1, 2"""


@query(ANCHOR_SQL)
def split_year_anchor(spark, sf):
    """A fold over lines; also held against a plain loop in the tests."""
    b = _raw_entries(spark, sf).selectExpr("floor(entry_id / 1000) as body", "cast(entry_id as int) as line_no", "case entry_id % 4 when 0 then raw_text || ', 2021.' when 1 then 'https://x' when 2 then substring(raw_text, 1, 40) else '(Tipo) ' || substring(raw_text, 1, 30) || '.' end as line", "'Artigo' as kind")
    return segment.split_year_anchor(b, ["body"]).select("body", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


LEVELS_SQL = f"""with l as (select l_partkey as body, cast(l_orderkey * 10 + l_linenumber as int) as line_no, case (l_orderkey + l_linenumber) % 7 when 0 then 'Mestrado' when 1 then '1. 2. Doutorado' else 'Participação em banca de X' end as line from lineitem),
 n as (select *, regexp_extract({FOLD.format('line')}, '^(\\d{{1,3}}\\.\\s*)*', 0) as numbers, {FOLD.format('line')} as norm from l),
 v as (select *, map({sql_list(segment.LEVELS)}, {sql_list(segment.LEVELS.values())}) as names from n), r as (select *, map_extract_value(names, substr(norm, length(numbers) + 1)) as level, len(numbers) - len(replace(numbers, '.', '')) as waits, regexp_matches(line, '(?i)Participaç[ãa]o\\s+em\\s+banca\\s+de') as opens from v),
 g as (select body, list({{'line_no': line_no, 'line': line, 'level': level, 'waits': waits, 'opens': opens}} order by line_no) as rows, bool_or(level is not null) as marked from r group by 1),
 k as (select body, marked, rows, list_reduce(rows, lambda s, r: case when r.level is not null and s.fresh and r.waits > 0 and s.now <> '' and s.next is null then {{'levels': list_append(s.levels, null), 'now': s.now, 'next': r.level, 'wait': r.waits, 'fresh': s.fresh}}
   when r.level is not null then {{'levels': list_append(s.levels, null), 'now': r.level, 'next': null, 'wait': 0::bigint, 'fresh': true}}
   when s.next is not null and r.opens and s.wait = 0 then {{'levels': list_append(s.levels, s.next), 'now': s.next, 'next': null, 'wait': 0::bigint, 'fresh': false}}
   else {{'levels': list_append(s.levels, s.now), 'now': s.now, 'next': s.next, 'wait': case when s.next is not null and r.opens then s.wait - 1 else s.wait end, 'fresh': false}} end,
   {{'levels': []::varchar[], 'now': '', 'next': null::varchar, 'wait': 0::bigint, 'fresh': true}}).levels as levels from g),
 u as (select body, marked, unnest(rows) as r, unnest(levels) as level from k)
 select body, r.line_no as line_no, level from u where level is not null and not (marked and level = '')"""


@query(LEVELS_SQL)
def committee_levels(spark, sf):
    """Parts as bodies, their line items as lines; a fold, also held against a plain loop in the tests."""
    li = table(spark, sf, "lineitem").selectExpr("l_partkey as body", "cast(l_orderkey * 10 + l_linenumber as int) as line_no", "case (l_orderkey + l_linenumber) % 7 when 0 then 'Mestrado' when 1 then '1. 2. Doutorado' else 'Participação em banca de X' end as line")
    return segment.committee_levels(li, ["body"]).select("body", "line_no", "level")


VENUES = ["", "Universidade A", "Universidade A - UFX", "Universidade A-UFX", "UNIVERSIDADE A", "Instituto B - SIGLALONGADEMAIS", "Instituto B - UFx"]
BONDS = [k for k, _ in parse.RECORD_KINDS]


@query(f"""with e as (select o_custkey as body, o_orderkey as entry_order, {sql_list(VENUES)}[o_orderkey % 7 + 1] as venue, {sql_list(BONDS)}[o_orderkey // 7 % 3 + 1] as kind, year(o_orderdate) as year, case when o_orderkey % 5 = 0 then 0 else year(o_orderdate) + 1 end as end_year from orders),
 k as (select *, case when venue = '' then 'outros vinculos' else trim(strip_accents(lower(regexp_replace(venue, '\\s*-\\s*[A-ZÀ-Ú]{{2,10}}$', '')))) end as key, case when kind <> 'Disciplina ministrada' and end_year = 0 and year > 0 then 9999 else greatest(year, end_year) end as recent from e),
 i as (select body, key, coalesce(arg_max(venue, lpad(cast(length(venue) as string), 5, '0') || venue) filter (venue <> ''), 'Outros vínculos') as shown, max(recent) as latest from k group by 1, 2),
 o as (select *, row_number() over (partition by body order by latest desc, shown) as place from i)
 select body, shown || ' - ' || {sql_list([s for _, s in parse.RECORD_KINDS])}[list_position({sql_list(BONDS)}, kind)] as label, cast(place * 10 + list_position({sql_list(BONDS)}, kind) as bigint) as label_order,
 cast(row_number() over (partition by body, key, kind order by recent desc, entry_order) - 1 as bigint) as entry_order, cast(entry_order as string) as raw_text from k join o using (body, key)""")
def regroup_institutions(spark, sf):
    """Orders as the entries of their customers' professional records."""
    given = {
        "raw_text": "cast(o_orderkey as string)", "venue": f"element_at(array({', '.join(map(repr, VENUES))}), cast(o_orderkey % 7 + 1 as int))", "kind": f"element_at(array({', '.join(map(repr, BONDS))}), cast(o_orderkey div 7 % 3 + 1 as int))",
        "year": "year(o_orderdate)", "end_year": "case when o_orderkey % 5 = 0 then 0 else year(o_orderdate) + 1 end",
    }
    e = table(spark, sf, "orders").selectExpr("o_custkey as body", "o_orderkey as entry_order", *[f"{given.get(k, repr(v))} as {k}" for k, v in parse.FIELDS.items()])
    return parse.by_institution(e, ["body"]).select("body", "label", F.col("label_order").cast("long").alias("label_order"), F.col("entry_order").cast("long").alias("entry_order"), "raw_text")


RECORD = ["Universidade do Sul, Brasil", "2010 - Atual Vínculo: X", "Portaria 12 da Universidade B", "Universidade C, Brasil. Horista", "2001 - 2004 Vínculo: Y", "UNIVERSIDADE INTEGRAL", "12 Fundação D", "Instituto E, Brasil, CampusDedicação Exclusiva", "linha", "Regime na Faculdade F", "Faculdade G Parcial", "linha", "Dedicação na Universidade H"]
FILL = f"element_at(array({', '.join(map(repr, RECORD))}), cast(o_orderkey % {len(RECORD)} + 1 as int))"


@query(f"""with l as (select o_custkey as body, cast(o_orderkey as int) as line_no, {sql_list(RECORD)}[o_orderkey % {len(RECORD)} + 1] as line from orders), n as (select *, trim(strip_accents(lower(line))) as n from l)
 select body, line_no, last_value(case when regexp_matches(n, 'universidade|instituto|faculdade|fundacao') and not regexp_matches(n, '^\\d|portaria|lotado|outras informac|vinculo:|dedicac|regime|carga hor')
  then trim(regexp_replace(replace(replace(line, ', Brasil.', ''), ', Brasil', ''), '\\s*(Integral|Parcial|Horista|Dedica[çc][ãa]o\\s*[Ee]xclusiva)\\s*$', '')) end ignore nulls) over w as institution,
 last_value(case when contains(line, 'Vínculo:') then cast(left(line, 4) as int) end ignore nulls) over w as start_year from n window w as (partition by body order by line_no rows between unbounded preceding and current row)""")
def forward_fill(spark, sf):
    return segment.forward_fill(_lines_of(spark, sf, FILL), ["body"]).select("body", "line_no", "institution", F.col("period.start").alias("start_year"))


# ---- report and archive -------------------------------------------------------------------------------------------


@query("select n, case when n <= 30 then 1 else 1 + cast(ceil((n - 30) / 36.0) as int) end as pages, case when n < 30 then 1 else 2 + cast(floor((n - 30) / 36.0) as int) end as place from (select distinct o_custkey % 500 as n from orders)")
def toc_pages(spark, sf):
    n = table(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("n")).distinct()
    return n.select("n", report.toc_pages(F.col("n")).alias("pages"), report.toc_place(F.col("n")).alias("place"))


@query("select o_orderkey from (select o_orderkey, case when o_orderkey % 6 = 0 then 0 else year(o_orderdate) end as y from orders) where y <= 0 or y between 1994 and 1996")
def period_filter(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 6 = 0 then 0 else year(o_orderdate) end as y")
    return o.where(report.in_period(F.col("y"), 1994, 1996)).select("o_orderkey")


def _report(spark, sf, **options) -> DataFrame:
    s = _status(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id"), F.year("o_orderdate").alias("year"), "o_orderpriority"), "entry_id")
    e = s.select(F.col("profile").alias("profile_id"), F.col("section").alias("section_title"), F.length("section").cast("long").alias("section_order"), F.col("entry_id").cast("int").alias("entry_order"), "entry_id", F.col("o_orderpriority").alias("label"), "year", "n_confirmed")
    f = _links(spark, sf).selectExpr("entry_id", "l_partkey as file_id", "l_linenumber as cert_order", "cast(l_quantity % 3 as int) as pages", "is_confirmed")
    return report.manifest(e, f, start=1993, **options)


REPORT_SQL = STATUS_SQL + """, e as (select s.profile, s.section, length(s.section) as so, s.entry_id, o_orderpriority as label from s join orders on o_orderkey = s.entry_id where n_confirmed > 0 and year(o_orderdate) >= 1993),
 b as (select profile, section, so, -1 as eo, '' as eid, 0 as co, null::varchar as file_id, 0 as fp, 'section' as kind, section as title from e group by all
 union all select profile, section, so, entry_id, cast(entry_id as string), 0, null, 0, 'entry', label from e
 union all select profile, section, so, entry_id, cast(entry_id as string), l_linenumber + 1, cast(l_partkey as string), unnest(range(1, cast(l_quantity % 3 as int) + 1)), 'file', '' from e join lineitem on l_orderkey = entry_id where l_returnflag <> 'R' and l_linestatus = 'F'),
 m as (select profile, count(*) filter (kind <> 'file') as n from b group by 1),
 pages as (select profile as profile_id, cast(case when n <= 30 then 1 else 1 + ceil((n - 30) / 36.0) end + row_number() over (partition by profile order by so, section, eo, eid, co, file_id, fp) as int) as page, kind, title, file_id, case when fp > 0 then cast(fp as int) end as file_page, kind <> 'section' as shows_number from b join m using (profile))"""


@query(REPORT_SQL + " select * from pages")
def report_manifest(spark, sf):
    return _report(spark, sf)


CV_PAGES_SQL = REPORT_SQL.replace("case when n <= 30 then 1 else 1 + ceil((n - 30) / 36.0) end + row_number()", "case when n <= 30 then 1 else 1 + ceil((n - 30) / 36.0) end + 1 + profile % 4 + row_number()")


@query(CV_PAGES_SQL + """ select * from pages union all select profile, cast(case when n <= 30 then 1 else 1 + ceil((n - 30) / 36.0) end + k as int), 'cv', '', null, cast(k as int), true from m, range(1, 6) r(k) where k <= 1 + profile % 4""")
def report_with_cv(spark, sf):
    """Reports that begin with one to four pages of the curriculum."""
    cv = table(spark, sf, "nation").selectExpr("n_nationkey as profile_id", "1 + n_nationkey % 4 as pages")
    return _report(spark, sf, cv_pages=cv)


SELECTED_SQL = REPORT_SQL.replace("year(o_orderdate) >= 1993)", "year(o_orderdate) >= 1993 and s.section in ('MACHINERY', 'BUILDING'))").replace("case when n <= 30 then 1 else 1 + ceil((n - 30) / 36.0) end + row_number()", "row_number()")


@query(SELECTED_SQL + " select * from pages")
def report_selection(spark, sf):
    """Two sections, without a table of contents."""
    return _report(spark, sf, sections=["MACHINERY", "BUILDING"], include_toc=False)


@query(REPORT_SQL + """, t as (select *, row_number() over (partition by profile_id order by page) - 1 as line from pages where kind <> 'file')
 select profile_id, case when line < 30 then 1 else 2 + cast(floor((line - 30) / 36.0) as int) end as toc_page, cast(line as int) as line, case when kind = 'entry' then 1 else 0 end as level, title, page from t""")
def report_contents(spark, sf):
    return report.contents(_report(spark, sf))


ARCHIVED = {
    "raw_text": "o_orderpriority || ', ' || cast(o_orderkey as string)", "title": "o_orderpriority", "kind": "o_orderstatus", "year": "year(o_orderdate)", "authors": "'A' || cast(o_custkey as string)", "venue": "case when o_orderkey % 4 = 0 then '' else 'V' || cast(o_orderkey % 9 as string) end",
    "doi": "'10.1/' || cast(o_orderkey as string)", "isbn": "case when o_orderkey % 3 = 0 then '978' else '' end", "portaria": "cast(o_orderkey % 500 as string) || '/2020'", "issn": "'1234-' || lpad(cast(o_orderkey % 9999 as string), 4, '0')", "edital": "cast(o_orderkey % 99 as string) || '/2021'", "end_year": "case when o_orderkey % 5 = 0 then 0 else year(o_orderdate) + 1 end",
}


def _archives(spark, sf) -> DataFrame:
    """Archives written and read again: orders as entries of the sections of nations, line items as their files or as files in limbo, refusals by customer.

    Orders and line items are dealt by order before their texts are made, as the plain columns are much smaller.
    """
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    with shuffles_dropped(spark):
        o = stored(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "c_nationkey", "c_mktsegment"))
    key = F.expr("cast(c_nationkey as string) || c_mktsegment")
    e = o.repartition("o_orderkey").select(key.alias("section_id"), F.col("o_orderkey").alias("entry_id"), F.col("o_orderkey").cast("int").alias("entry_order"), *[F.expr(x).alias(c) for c, x in ARCHIVED.items()])
    s = o.select("c_nationkey", "c_mktsegment", key.alias("section_id")).distinct().select(F.col("c_nationkey").alias("profile_id"), "section_id", F.col("c_mktsegment").alias("title"), F.length("c_mktsegment").cast("long").alias("section_order"))
    p = s.select("profile_id").distinct().withColumns({"name": F.expr("'P' || cast(profile_id as string)"), "raw_text": F.lit('a "b"\nc')})
    file = ["'/d/f' || cast(l_partkey as string) || '-' || cast(l_orderkey as string) as file_path", "'text ' || cast(l_suppkey as string) as extracted_text", "l_discount as confidence", "is_confirmed", "false as is_rejected", "l_shipdate as import_date", "l_linenumber as cert_order"]
    li = _links(spark, sf)
    linked = li.where("entry_id is not null").repartition("l_orderkey").selectExpr("cast(null as int) as profile_id", "l_orderkey as entry_id", *file)
    limbo = li.where("entry_id is null").join(o.select("o_orderkey", F.col("c_nationkey").alias("profile_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    k = linked.unionByName(limbo.selectExpr("profile_id", "cast(null as bigint) as entry_id", *file))
    r = o.selectExpr("c_nationkey as profile_id", "'f' || cast(o_custkey as string) as cert_key", "'h' || o_orderpriority || '||x' as hash_key")
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        src.write_archives(src.manifest_lines(p, s, e, k, r), folder)
        removed(o)
        return src.archived(src.read_archives(spark, folder))


NATION = "cast(profile as int) as profile_id"
ENTRY_FIELDS = ("rawText", "title", "kind", "year", "authors", "venue", "doi", "isbn", "portaria", "issn", "edital", "endYear", "order", "certificateStatus")


@query(f"""with n as (select l_orderkey, count(*) as n_files, count(*) filter (l_linestatus = 'F') as n_ok from lineitem where l_returnflag <> 'R' group by 1)
 select c_nationkey as profile_id, c_mktsegment as section_title, cast(length(c_mktsegment) as bigint) as section_order, {', '.join(f'{x} as {c}' for c, x in ARCHIVED.items() if c != 'order')}, cast(o_orderkey as int) as entry_order,
 case when n_ok > 0 then 'confirmed' when n_files > 0 then 'suggested' else 'none' end as status, coalesce(n_files, 0) as n_files from orders join customer on o_custkey = c_custkey left join n on l_orderkey = o_orderkey""")
def archive_round_trip(spark, sf):
    """Profiles to files of JSON and back: the fields of each entry."""
    named = [F.col(f"entry.{c}").alias({"rawText": "raw_text", "endYear": "end_year", "order": "entry_order", "certificateStatus": "status"}.get(c, c)) for c in ENTRY_FIELDS]
    return src.archived_entries(_archives(spark, sf)).select(F.expr(NATION), "section_title", "section_order", *named, F.size("entry.certificates").cast("long").alias("n_files"))


@query("""select c_nationkey as profile_id, case when l_returnflag <> 'R' then c_mktsegment end as section_title, '/d/f' || cast(l_partkey as string) || '-' || cast(l_orderkey as string) as path, 'text ' || cast(l_suppkey as string) as extracted_text,
 l_discount as confidence, l_linestatus = 'F' as is_confirmed, false as is_rejected, cast(l_shipdate as string) as import_date, l_linenumber as cert_order from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""")
def archive_files(spark, sf):
    """Profiles to files of JSON and back: the fields of each file, those in limbo too."""
    f = src.archived_files(_archives(spark, sf))
    names = {"originalFilePath": "path", "extractedText": "extracted_text", "confidence": "confidence", "isConfirmed": "is_confirmed", "isRejected": "is_rejected", "order": "cert_order"}
    return f.select(F.expr(NATION), "section_title", *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.date_format("importDate", "yyyy-MM-dd HH:mm:ss").alias("import_date"))


@query("select distinct c_nationkey as profile_id, 'f' || cast(o_custkey as string) as cert_key, 'h' || o_orderpriority || '||x' as hash_key from orders join customer on o_custkey = c_custkey")
def archive_rejections(spark, sf):
    return src.archived_rejections(_archives(spark, sf)).select(F.expr(NATION), "cert_key", "hash_key")


@query("""with t as (select distinct case when p_partkey % 2 = 0 then 'N' || cast(p_size as string) else 'N' || cast(p_size as string) || ' (' || cast(p_partkey % 4 + 2 as string) || ')' end as name from part),
 w as (select distinct 'N' || cast(p_size as string) as wanted from part), c as (select wanted, n from w, range(2, 12) r(n) where wanted || ' (' || cast(n as string) || ')' not in (select name from t))
 select wanted, case when wanted in (select name from t) then wanted || ' (' || cast((select min(n) from c where c.wanted = w.wanted) as string) || ')' else wanted end as name from w""")
def unique_names(spark, sf):
    p = table(spark, sf, "part")
    names = p.selectExpr("case when p_partkey % 2 = 0 then 'N' || cast(p_size as string) else 'N' || cast(p_size as string) || ' (' || cast(p_partkey % 4 + 2 as string) || ')' end as name")
    return src.unique_name(names, p.selectExpr("'N' || cast(p_size as string) as wanted"))


WISHES = "'P' || cast(n_regionkey as string)"


@query(f"""with t as (select 'P' || cast(r_regionkey as string) || case when r_regionkey % 2 = 0 then '' else ' (' || cast(r_regionkey + 1 as string) || ')' end as name from region union all select 'P2 (3)'),
 w as (select n_nationkey as wish, {WISHES} as wanted from nation), k as (select *, row_number() over (partition by wanted order by wish) - case when wanted in (select name from t) then 0 else 1 end as k from w)
 select cast(wish as string) as wish, case when k = 0 then wanted else wanted || ' (' || cast(list_filter(range(2, 60), lambda n: wanted || ' (' || cast(n as string) || ')' not in (select name from t))[k] as string) || ')' end as name from k""".replace("list_filter(range(2, 60), lambda n: wanted || ' (' || cast(n as string) || ')' not in (select name from t))[k]", "(select list(n order by n) from range(2, 60) r(n) where k.wanted || ' (' || cast(n as string) || ')' not in (select name from t))[k]"))
def free_names(spark, sf):
    """Nations as archives that want the names of regions, some of which are taken."""
    taken = table(spark, sf, "region").selectExpr("'P' || cast(r_regionkey as string) || case when r_regionkey % 2 = 0 then '' else ' (' || cast(r_regionkey + 1 as string) || ')' end as name").unionByName(spark.sql("select 'P2 (3)' as name"))
    return src.free_names(taken, table(spark, sf, "nation").selectExpr("cast(n_nationkey as string) as wish", f"{WISHES} as wanted").withColumn("wish", F.lpad("wish", 2, "0"))).select(F.regexp_replace("wish", "^0(.)", "$1").alias("wish"), "name")


def _imported(spark, sf) -> dict[str, DataFrame]:
    bundle = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 2 = 0").selectExpr("cast(c_nationkey as string) as profile", "'curriculo.pdf' as inner").distinct()
    return src.import_archives(_archives(spark, sf), table(spark, sf, "nation").where("n_nationkey % 5 = 0").selectExpr("'P' || cast(n_nationkey as string) as name"), "/base", bundle)


@query("""select c_nationkey as nation, 'P' || cast(c_nationkey as string) || case when c_nationkey % 5 = 0 then ' (2)' else '' end as name, '/base/P' || cast(c_nationkey as string) || case when c_nationkey % 5 = 0 then ' (2)' else '' end as save_path,
 case when c_nationkey % 2 = 0 then '/base/P' || cast(c_nationkey as string) || case when c_nationkey % 5 = 0 then ' (2)' else '' end || '/Currículo Lattes.pdf' end as pdf_path, 'a "b"' || chr(10) || 'c' as raw_text from (select distinct c_nationkey from customer join orders on o_custkey = c_custkey)""")
def imported_profiles(spark, sf):
    p = _imported(spark, sf)["profiles"]
    return p.select(F.regexp_extract("profile_id", "(\\d+)$", 1).cast("int").alias("nation"), "name", "save_path", "pdf_path", "raw_text")


@query("""with f as (select l_orderkey, count(*) as n_files, sum(l_discount) as confidence from lineitem where l_returnflag <> 'R' group by 1) select 'P' || cast(c_nationkey as string) || case when c_nationkey % 5 = 0 then ' (2)' else '' end as name, c_mktsegment as title, o_orderkey as entry_order, o_orderpriority as entry, coalesce(n_files, 0) as n_files, round(coalesce(confidence, 0), 4) as confidence
 from orders join customer on o_custkey = c_custkey left join f on l_orderkey = o_orderkey""")
def imported_entries(spark, sf):
    """Imported profiles, sections, entries and files, joined by their new ids."""
    t = {k: v for k, v in _imported(spark, sf).items()}
    files = t["links"].where("entry_id is not null").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("confidence").alias("confidence"))
    e = t["profiles"].select("profile_id", "name").join(t["sections"], "profile_id").join(t["entries"].select("section_id", "entry_id", "entry_order", F.col("title").alias("entry")), "section_id").join(files, "entry_id", "left")
    return e.select("name", "title", F.col("entry_order").cast("long").alias("entry_order"), "entry", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"))


# ---- files, manual work and views -----------------------------------------------------------------------------------


@query("""select conv_id as file_id, string_agg(coalesce(text, ''), chr(10) order by turn) as text, length(regexp_replace(string_agg(coalesce(text, ''), chr(10) order by turn), '^\\s+|\\s+$', '', 'g')) < 20 as needs_ocr from conversations where turn < 5 group by 1""")
def text_layers(spark, sf):
    """Conversations as files, their turns as pages."""
    return src.text_layer(table(spark, sf, "conversations").selectExpr("conv_id as file_id", "turn as page_no", "text"))


@query(f"""select c_custkey, name, case when ext = 'pdf' and c_custkey % 3 > 0 then 'T' || cast(c_custkey as string) else '' end as text, case when ext = 'pdf' and c_custkey % 3 > 0 then 'layer' when ext in ('pdf', 'jpg', 'jpeg', 'png', 'tiff', 'tif', 'heic') then 'ocr' else 'none' end as source
 from (select c_custkey, regexp_extract(p, '([^/]*)$', 1) as name, lower(regexp_extract(p, '\\.([^.]+)$', 1)) as ext from (select c_custkey, {PATHS} as p from customer))""")
def text_dispatch(spark, sf):
    c = table(spark, sf, "customer")
    f = c.select("c_custkey", F.expr(PATHS).alias("path")).select("c_custkey", "path", tx.file_parts(F.col("path")).alias("f")).select("c_custkey", "path", "f.name", "f.is_pdf", "f.is_image")
    layers = c.select(F.expr(PATHS).alias("path"), F.expr("'T' || cast(c_custkey as string)").alias("text"), (F.col("c_custkey") % 3 == 0).alias("needs_ocr"))
    return src.extracted(f, layers).select("c_custkey", "name", "text", "source")


INNER = "case o_orderkey % 4 when 0 then 'manifest.json' when 1 then 'd' || cast(o_orderkey % 9 as string) || '/manifest.json' when 2 then 'a/b/manifest.json' else 'x.txt' end"


@query(f"select archive, arg_min(i, lpad(cast(len(string_split(i, '/')) as string), 4, '0') || i) as manifest from (select o_custkey as archive, {INNER} as i from orders) where i = 'manifest.json' or regexp_full_match(i, '[^/]+/manifest\\.json') group by 1")
def manifest_paths(spark, sf):
    return src.first_manifest(table(spark, sf, "orders").selectExpr("o_custkey as archive", f"{INNER} as inner"))


@query("with " + RANKS_SQL + " select '2017_2020' as quad, issn, title, area, estrato from r")
def ranking_files(spark, sf):
    """A ranking table written as compressed, tab-separated text and read again."""
    path = f"{shared_folder(spark)}/ranking-{uuid.uuid4().hex}"
    _ranks(spark, sf).select(F.concat_ws("\t", "issn", "title", "area", "estrato").alias("value")).write.option("compression", "gzip").text(path)
    return src.read_ranking(spark, path, "2017_2020").drop("row_no")


@query("select item_id, trim(text, chr(10)) as text from benchmark where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0")
def whole_texts(spark, sf):
    """Benchmark items written as a text file each, and read as whole files."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    table(spark, sf, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(folder)
    t = src.texts_of(spark, folder)
    return t.select(F.regexp_extract("path", "item_id=(\\d+)/", 1).cast("long").alias("item_id"), F.btrim("text", F.lit("\n")).alias("text"))


@query("""select l_orderkey, l_linenumber, round(least(500.0 / case when l_linenumber % 4 in (1, 3) then l_quantity * 20 else l_quantity * 10 end, 700.0 / case when l_linenumber % 4 in (1, 3) then l_quantity * 10 else l_quantity * 20 end), 6) as factor from lineitem""")
def page_scales(spark, sf):
    """Line items as pages, turned by quarters."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(report.scale_to_fit(F.col("l_quantity") * 10, F.col("l_quantity") * 20, 500.0, 700.0, F.col("l_linenumber") % 4 * 90), 6).alias("factor"))


MARKED = "'antes 1. 2. Participação em banca de ' || c_name || '. 3. 4. Título ' || c_mktsegment || case when c_custkey % 2 = 0 then ' participacao  em Banca de outra. Participaçao em banca de mais' else '' end"
EVENT_TEXT = "'Semana de ' || c_name || ', 2020. (Congresso, Organização de evento)' || case when c_custkey % 3 > 0 then ' Mostra ' || c_mktsegment || ' (Outro, Organização de evento ) fim' else '' end"


@query(f"""select c_custkey, array_to_string(list_transform(string_split(regexp_replace(t, '(?i)Participaç[ãa]o\\s+em\\s+banca\\s+de', chr(1) || '\\0', 'g'), chr(1))[2:], lambda p: regexp_replace(p, '\\s(\\d{{1,3}}\\.\\s)+', ' ', 'g')), '|') as parts from (select c_custkey, {MARKED} as t from customer)""")
def committee_parts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.array_join(segment.split_committees(F.expr(MARKED)), "|").alias("parts"))


@query(f"""select c_custkey, array_to_string(case when len(p) > 2 then list_transform(p[:-2], lambda x: trim(x)) else [trim(t)] end, '|') as parts from (select c_custkey, t, string_split(regexp_replace(t, '(?i)evento\\s*\\)', '\\0' || chr(1), 'g'), chr(1)) as p from (select c_custkey, {EVENT_TEXT} as t from customer))""")
def event_parts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.array_join(segment.split_events(F.expr(EVENT_TEXT)), "|").alias("parts"))


ROLE = "case c_custkey % 5 when 0 then '3. Conferencista no ' when 1 then '1. 2. Ouvinte: ' when 2 then 'Mediador (ouvinte) ' when 3 then 'Apresentação de ' else '' end || c_name"


@query(f"""select c_custkey, starts_with(n, 'ouvinte') or contains(n, '(ouvinte)') or not list_bool_or(list_transform({sql_list(tx.PRESENTATION_ROLES)}, lambda r: starts_with(n, r))) as listener
 from (select c_custkey, regexp_replace(trim({FOLD.format('r')}), '^\\s*(\\d{{1,3}}\\.\\s*)+', '') as n from (select c_custkey, {ROLE} as r from customer))""")
def listeners(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.is_listener(F.expr(ROLE)).alias("listener"))


JUNK = "case p_partkey % 4 when 0 then '(Carga horária: 20h).' when 1 then '01 12 2023. ' || p_name when 2 then 'DURANTE, F.. Ep.' else p_name end"


@query(f"""select p_partkey, len(list_filter(string_split({NORM.format("t || ' ' || p_type")}, ' '), lambda w: length(w) >= 4 and not list_contains({sql_list(tx.ADMIN_WORDS)}, w) and not regexp_full_match(w, '\\p{{N}}+') and not list_contains(['durante', 'economy', 'small'], w))) = 0 as junk
 from (select p_partkey, p_type, {JUNK} as t from part)""")
def junk_entries(spark, sf):
    owner = F.array(*map(F.lit, ("durante", "economy", "small")))
    return table(spark, sf, "part").select("p_partkey", tx.is_junk(F.expr(JUNK), F.col("p_type"), owner).alias("junk"))


@query("""select p_partkey, cast(floor(p_retailprice / 2500 * 100) as int) as percent, case when length(p_name || ' ' || p_type || ' ' || p_brand) > 22 then left(p_name || ' ' || p_type || ' ' || p_brand, 20) || '…' else p_name || ' ' || p_type || ' ' || p_brand end as label,
 contains(strip_accents(lower(p_name)), 'red') as found, case when p_size % 9 < 2 then 'green' when p_size % 9 < 4 then 'blue' when p_size % 9 < 7 then 'orange' else 'gray' end as color from part""")
def shown_values(spark, sf):
    rank = F.expr("element_at(array('A1', 'a2 x', 'A3', 'A4', 'B1', 'b4', 'B', 'C', ''), cast(p_size % 9 + 1 as int))")
    p = table(spark, sf, "part")
    label = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return p.select("p_partkey", tx.percent(F.col("p_retailprice") / 2500).alias("percent"), tx.short_label(label).alias("label"), tx.search_contains(F.col("p_name"), F.lit("RÉD")).alias("found"), tx.rank_color(rank).alias("color"))


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F'")
def limbo_files(spark, sf):
    li = _links(spark, sf).withColumns({"is_rejected": F.col("l_linestatus") == "O"})
    return links.limbo(li).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_quantity > 20")
def readable_files(spark, sf):
    li = _links(spark, sf).withColumn("text", F.when(F.col("l_quantity") > 20, "t").otherwise(""))
    return links.readable(li).select("l_orderkey", "l_linenumber")


@query("""select 'profile' as what, cast(n_nationkey as bigint) as id from nation where n_regionkey <> 1 union all select 'section', c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey <> 1
 union all select 'entry', o_orderkey from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where n_regionkey <> 1 union all select 'link', s_suppkey from supplier join nation on n_nationkey = s_nationkey where n_regionkey <> 1""")
def delete_cascade(spark, sf):
    """The nations of a region as deleted profiles, customers as sections, orders as entries, suppliers as links."""
    n = table(spark, sf, "nation").selectExpr("n_nationkey as profile_id", "n_regionkey")
    gone = n.where("n_regionkey = 1").select("profile_id")
    left = links.cascade(n, table(spark, sf, "customer").selectExpr("c_nationkey as profile_id", "c_custkey as section_id"), table(spark, sf, "orders").selectExpr("o_custkey as section_id", "o_orderkey as entry_id"), table(spark, sf, "supplier").selectExpr("s_nationkey as profile_id", "s_suppkey as id"), gone)
    ids_ = [t.select(F.lit(what).alias("what"), F.col(c).cast("long").alias("id")) for t, what, c in zip(left, ("profile", "section", "entry", "link"), ("profile_id", "section_id", "entry_id", "id"), strict=True)]
    return ids_[0].unionByName(ids_[1]).unionByName(ids_[2]).unionByName(ids_[3])


FILE_ID = "cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string)"


def _certs(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey as entry_id", f"{FILE_ID} as file_id", "l_linenumber as cert_order", "l_shipdate as import_date", "l_linestatus = 'F' as is_confirmed", "l_discount", "l_returnflag")


@query(f"select l_orderkey as entry_id, {FILE_ID} as file_id, l_linestatus = 'F' or o_orderstatus = 'F' as is_confirmed from lineitem join orders on o_orderkey = l_orderkey")
def confirm_entries(spark, sf):
    chosen = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as entry_id")
    return links.confirm_entry(_certs(spark, sf), chosen).select("entry_id", "file_id", "is_confirmed")


@query(f"select l_orderkey as entry_id, {FILE_ID} as file_id, (l_linestatus = 'F') <> (l_returnflag = 'A') as is_confirmed from lineitem")
def toggle_links(spark, sf):
    c = _certs(spark, sf)
    return links.toggle(c, c.where("l_returnflag = 'A'")).select("entry_id", "file_id", "is_confirmed")


@query(f"select l_orderkey as entry_id, {FILE_ID} as file_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate, {FILE_ID}) - 1 as int) as cert_order from lineitem where l_returnflag <> 'A'")
def delete_files(spark, sf):
    c = _certs(spark, sf)
    return links.delete_links(c, c.where("l_returnflag = 'A'").select("entry_id", "file_id")).select("entry_id", "file_id", "cert_order")


@query(f"""with d as (select l_orderkey, {FILE_ID} as file_id, row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate, {FILE_ID}) - 1 as k, max({FILE_ID}) over (partition by l_orderkey) as last from lineitem)
 select l_orderkey as entry_id, file_id, cast(row_number() over (partition by l_orderkey order by case when file_id = last then -1 else k end) - 1 as int) as cert_order from d""")
def move_files(spark, sf):
    """The last file of each entry moved to the front."""
    c = _certs(spark, sf)
    return links.move(c, c.groupBy("entry_id").agg(F.max("file_id").alias("file_id")).withColumn("to", F.lit(0))).select("entry_id", "file_id", "cert_order")


@query("select l_orderkey * 10 + l_linenumber as file_id, 'confirm' as kind, l_orderkey as entry_id from lineitem where l_discount >= 0.05 and l_returnflag <> 'R'")
def confirm_suggested(spark, sf):
    li = _links(spark, sf).selectExpr("l_orderkey * 10 + l_linenumber as file_id", "entry_id", "l_discount as score")
    return links.confirm_suggested(li, 0.05)


@query("select l_orderkey, l_linenumber from lineitem where 'f' || cast(l_partkey as string) in (select 'f' || cast(p_partkey as string) from part where p_size > 25)")
def existing_files(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "'f' || cast(l_partkey as string) as path")
    return links.existing(li, table(spark, sf, "part").where("p_size > 25").selectExpr("'f' || cast(p_partkey as string) as path")).select("l_orderkey", "l_linenumber")


@query("select c_mktsegment as title, array_to_string(list(o_orderkey order by o_orderkey), ',') as entries from orders join customer on c_custkey = o_custkey group by 1")
def entry_picker(spark, sf):
    """Each segment's orders in their order; a row joins the texts of its parts."""
    s = table(spark, sf, "customer").selectExpr("c_custkey as section_id", "c_mktsegment as title")
    e = table(spark, sf, "orders").selectExpr("o_custkey as section_id", "o_orderkey as entry_id", "o_orderkey as entry_order")
    parts = links.picker(s, e).select("title", F.struct("part", F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("text")).alias("x"))
    return parts.groupBy("title").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), ",").alias("entries"))


@query("select l_orderkey as file_id, l_linenumber, case when o_totalprice > 150000 then l_orderkey end as entry_id from lineitem left join orders on o_orderkey = l_orderkey")
def unlink_deleted(spark, sf):
    """Line items as the links of orders, of which the cheaper ones are deleted."""
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey as file_id", "l_orderkey as entry_id", "l_linenumber")
    return links.unlink_deleted(li, table(spark, sf, "orders").where("o_totalprice > 150000").selectExpr("o_orderkey as entry_id")).select("file_id", "l_linenumber", "entry_id")


@query("select l_orderkey as file_id, l_linenumber from lineitem where (l_orderkey, l_suppkey % 7) not in (select o_orderkey, o_custkey % 7 from orders)")
def without_rejected(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey as file_id", "'h' || cast(l_suppkey % 7 as string) as hash_key", "l_linenumber")
    return links.without_rejected(li, table(spark, sf, "orders").selectExpr("o_orderkey as file_id", "'h' || cast(o_custkey % 7 as string) as hash_key")).select("file_id", "l_linenumber")


@query("select * from (select 'h' || cast(o_custkey as string) as hash_key, cast(o_orderkey as bigint) as entry_id, 'Outros Documentos' as section_title from orders where o_orderpriority = '1-URGENT' union all select 'h' || cast(c_custkey // 2 * 3 as string), c_custkey + 10000000, 'y' from customer)")
def reimport_entries(spark, sf):
    """The entries that a text read anew leaves: its own, and those added by hand."""
    return _reimported(spark, sf)[0].select("hash_key", "entry_id", "section_title")


@query(STATUS_SQL + " select count(*) filter (status = 'confirmed') as n_entries from s")
def confirmed_entries(spark, sf):
    return links.confirmed_entries(_status(spark, sf))


@query("select n_nationkey as profile_id, n_name as name from nation")
def profile_list(spark, sf):
    return src.profiles_by_name(table(spark, sf, "nation").selectExpr("n_nationkey as profile_id", "n_name as name"))


@query("""with e as (select o_orderkey as entry_id, case when o_orderstatus = 'F' then 'Artigo' else 'Banca' end as kind from orders), r as (select o_orderkey as entry_id, 'A' || cast(o_orderkey % 4 + 1 as string) as estrato from orders where o_totalprice > 100000)
 select e.entry_id, kind, case when kind = 'Artigo' then estrato end as estrato from e left join r using (entry_id)""")
def report_ranks(spark, sf):
    o = table(spark, sf, "orders")
    e = o.selectExpr("o_orderkey as entry_id", "case when o_orderstatus = 'F' then 'Artigo' else 'Banca' end as kind")
    return ranking.with_ranks(e, o.where("o_totalprice > 100000").selectExpr("o_orderkey as entry_id", "'A' || cast(o_orderkey % 4 + 1 as string) as estrato"))


def _sections(spark, sf) -> DataFrame:
    """Customers as sections of nations; those of one segment hold documents added by hand."""
    return table(spark, sf, "customer").selectExpr("c_custkey as section_id", "cast(c_nationkey as string) as profile_id", "case when c_mktsegment = 'FURNITURE' then 'Outros Documentos' else c_mktsegment end as title", "cast(length(c_name) as bigint) as section_order")


@query("""with m as (select o_orderkey from orders join customer on c_custkey = o_custkey where c_mktsegment = 'FURNITURE' and o_orderstatus = 'F')
 select 'entry' as what, o_orderkey as id from orders where o_orderkey not in (select * from m) union all select 'link', l_orderkey * 10 + l_linenumber from lineitem where l_orderkey not in (select * from m)""")
def delete_manual_documents(spark, sf):
    o = table(spark, sf, "orders")
    e, k = links.delete_manual(_sections(spark, sf), o.selectExpr("o_custkey as section_id", "o_orderkey as entry_id"), table(spark, sf, "lineitem").selectExpr("l_orderkey as entry_id", "l_linenumber"), o.where("o_orderstatus = 'F'").selectExpr("o_orderkey as entry_id"))
    return e.select(F.lit("entry").alias("what"), F.col("entry_id").alias("id")).unionByName(k.select(F.lit("link").alias("what"), (F.col("entry_id") * 10 + F.col("l_linenumber")).alias("id")))


@query("""select cast(s_nationkey as string) as profile_id, s_suppkey as entry_id, cast(s_nationkey as string) || '-manual' as section_id, cast(row_number() over (partition by s_nationkey order by s_suppkey) - 1 as int) as entry_order, 'Documento' as kind from supplier""")
def add_manual_documents(spark, sf):
    """Suppliers as documents added by hand to nations that have no section for them yet."""
    d = table(spark, sf, "supplier").selectExpr("cast(s_nationkey as string) as profile_id", "s_suppkey as entry_id", "s_name as title")
    s = _sections(spark, sf).where("title <> 'Outros Documentos'").withColumn("section_id", F.col("section_id").cast("string"))
    return links.add_manual(s, d)[1].select("profile_id", "entry_id", "section_id", "entry_order", "kind")


@query(f"""with old as (select o_orderkey as entry_id, 'h' || cast(o_custkey as string) as hash_key, o_orderpriority = '1-URGENT' as manual from orders), new as (select 'h' || cast(c_custkey // 2 * 3 as string) as hash_key, min(c_custkey + 10000000) as e from customer group by 1)
 select cast(l_orderkey as string) || '-' || {FILE_ID} as file_id, cast(case when coalesce(manual, false) then l_orderkey else coalesce(e, case when l_quantity > 20 and l_discount >= 0.05 then l_partkey + 10000000 end) end as string) as entry_id,
 l_linestatus = 'F' and (coalesce(manual, false) or e is not null) as is_confirmed from lineitem left join old on old.entry_id = case when l_returnflag <> 'R' then l_orderkey end left join new on new.hash_key = old.hash_key""")
def reimport_links(spark, sf):
    """Orders as old entries (urgent ones added by hand), customers as new ones, line items as files with and without text."""
    return _reimported(spark, sf)[1].withColumn("entry_id", F.col("entry_id").cast("string"))


def _reimported(spark, sf) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf, "orders").selectExpr("o_orderkey as entry_id", "'h' || cast(o_custkey as string) as hash_key", "case when o_orderpriority = '1-URGENT' then 'Outros Documentos' else 'x' end as section_title")
    new = table(spark, sf, "customer").selectExpr("c_custkey + 10000000 as entry_id", "'h' || cast(c_custkey div 2 * 3 as string) as hash_key", "'y' as section_title", "0 as section_order", "0 as entry_order")
    k = _links(spark, sf).selectExpr(f"cast(l_orderkey as string) || '-' || {FILE_ID} as file_id", "entry_id", "case when l_quantity > 20 then 't' else '' end as text", "is_confirmed")
    r = table(spark, sf, "lineitem").selectExpr(f"cast(l_orderkey as string) || '-' || {FILE_ID} as file_id", "l_partkey + 10000000 as entry_id", "case when l_discount >= 0.05 then 0.95 else 0.5 end as score", "1 as rank")
    return links.reimport(old, new, k, r)
