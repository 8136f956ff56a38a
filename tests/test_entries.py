"""Entries from chunks and lines."""

from pyspark.sql import functions as F

from dossier.operators import entries


def test_sentences_keep_abbreviations(spark):
    t = "SILVA, J. A.; SOUZA, B. O título do texto. Revista, v. 3, n. 2, p. 5, 2020."
    got = spark.createDataFrame([(t,)], ["t"]).select(entries.sentences(F.col("t")), entries.title_authors_venue(F.col("t"))).first()
    assert got[0] == ["SILVA, J. A.; SOUZA, B. O título do texto.", "Revista, v. 3, n. 2, p. 5, 2020."]
    for text, parts in (("DURANTE, F.. Titulo do livro. Fim", ["DURANTE, F.. Titulo do livro.", "Fim"]), ("obra, p.p. 3. Vol. 2. xv. y", ["obra, p.p. 3. Vol. 2. xv.", "y"]), ("ver Jr. depois", ["ver Jr.", "depois"])):
        assert spark.createDataFrame([(text,)], ["t"]).select(entries.sentences(F.col("t"))).first()[0] == parts
    t = "SOUZA, BRUNO. O título. Revista, v. 3, 2020. ISSN: 2179-3786"
    e = spark.createDataFrame([(t,)], ["t"]).select(entries.entry(F.col("t")).alias("e")).first().e
    assert (e.authors, e.title, e.venue, e.year, e.issn) == ("SOUZA, BRUNO.", "O título.", "Revista, v. 3, 2020.", 2020, "2179-3786")


def test_committee_and_event(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], ["t"]).select(c(F.col("t"))).first()[0]
    got = one(entries.committee_entry, "Participação em banca de Ana Lima. Título, 2019. (Filosofia) Universidade X.")
    assert (got.title, got.venue, got.year) == ("Ana Lima", "Universidade X", 2019)
    assert one(entries.event_title, "SILVA, J.. SEMANA DE X, 2020. (Congresso, Organização de evento)") == "SEMANA DE X"


def body(spark, lines):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "body int, line_no int, line string")


def test_education(spark):
    lines = ["2017-2021 Doutorado em Filosofia.", "Universidade Federal, UF, Brasil", "Ano de obtenção: 2021", "", "2014 - 2016 Mestrado em Letras", "sem escola", "Graduação em X."]
    got = [(r.title, r.venue, r.year) for r in entries.education(body(spark, lines), ["body"]).orderBy("entry_order").collect()]
    assert got == [("Doutorado em Filosofia — Universidade Federal", "Universidade Federal", 2021), ("Mestrado em Letras", "", 2016), ("Graduação em X", "", 2016)]


def test_projects(spark):
    lines = ["2019 - Atual Um projeto de nome bastante longo", "Situação: Em andamento", "Descrição: texto 2020", "Integrantes: A; B; C", "Um nome partido em", "duas linhas", "Descrição: outro, 2018"]
    got = [(r.title, r.year) for r in entries.projects(body(spark, lines), ["body"]).orderBy("entry_order").collect()]
    assert got == [("Um projeto de nome bastante longo", 2020), ("Um nome partido em duas linhas", 2018)]
