"""Golden cases of the functions."""

from pyspark.sql import functions as F

from dossier.functions import identifiers as ids
from dossier.functions import text as tx
from dossier.operators import report, segment


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr).first()[0]


def test_normalize(spark):
    assert one(spark, tx.normalize(F.col("t")), t="  Ação, É: ó nº 1/2 ") == "acao e o nº 1 2"
    assert one(spark, tx.normalize(F.col("t")), t="...") == ""


def test_ordinances(spark):
    pairs = lambda t: one(spark, ids.ordinance_pairs(F.col("t")), t=t)
    assert pairs("PORTARIA N 2891, DE 06 DE OUTUBRO DE 2022") == ["2891/2022"]
    assert pairs("PORTARIA N 2090, DE") == ["2090"]
    score = lambda a, b: one(spark, ids.ordinance_score(F.array(F.lit(a)), F.array(F.lit(b))))
    assert [score("2891/2022", x) for x in ("2891/2022", "2891", "2891/2021", "1")] == [0.99, 0.95, 0.0, 0.0]


def test_other_identifiers(spark):
    assert one(spark, ids.call_numbers(F.col("t")), t="Edital nº 41/2024-PROGRAD") == ["41/2024"]
    assert one(spark, ids.issn_numbers(F.col("t")), t="ISSN: 2179-3786") == ["2179-3786"]
    assert one(spark, ids.issn_numbers(F.col("t")), t="2019-2024") == []
    assert one(spark, ids.doi_numbers(F.col("t")), t="see 10.1234/ABC, x") == ["10.1234/abc"]
    assert one(spark, ids.has_publication_id(F.col("t")), t="doido")


def test_years(spark):
    assert one(spark, tx.last_year(F.col("t")), t="1999 a 2004.") == 2004
    assert one(spark, tx.last_year(F.col("t")), t="12004") == 0
    assert one(spark, tx.year_set(F.col("t")), t="1980 1990 2035 2036 1990") == [1990, 2035]
    quads = [one(spark, tx.quad_key(F.lit(y))) for y in (2021, 2017, 2016, 0)]
    assert quads == ["2021_2024", "2017_2020", "2016_2019", "2021_2024"]


def test_journal_name_cuts_inside_a_word(spark):
    assert one(spark, tx.journal_name(F.col("t")), t="Kriterion. Belo Horizonte") == "Kriterio"


def test_headers(spark):
    cls = lambda t: one(spark, segment.header(tx.normalize_header(F.col("t")))["display"], t=t)
    assert cls("Organização de evento)") is None
    assert cls("Organização de evento (completo)") == "Organização de eventos"
    assert cls("Livros publicados") == "Livros publicados"


def test_toc(spark):
    assert [one(spark, report.toc_pages(F.lit(n))) for n in (30, 31, 66, 67)] == [1, 2, 2, 3]
    assert one(spark, report.in_period(F.lit(0), 2000, 2001))


def test_listener(spark):
    assert not one(spark, tx.is_listener(F.col("t")), t="12. Conferencista no(a) X")
    assert one(spark, tx.is_listener(F.col("t")), t="ENCONTRO, 2020")


def test_rank_note(spark):
    assert one(spark, segment.is_rank_note(F.col("t")), t="B1, ISSN 2358-2472, fonte Qualis/CAPES (2021-2024)")
    assert not one(spark, segment.is_rank_note(F.col("t")), t="Artigo sobre ISSN")
