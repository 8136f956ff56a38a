"""Entries from the text of a chunk or the lines of a body: titles, authors, venues, degrees and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import identifiers as ids
from dossier.functions import text as tx
from dossier.functions.binding import let
from dossier.operators import segment

# Abbreviations that end no sentence, degree levels, and openings of a project's notes.
ABBREVIATIONS = ("v", "n", "p", "ed", "org", "vol", "pp", "op", "cit", "et", "al", "dr", "ph")
LEVEL = (
    "^(P[óo]s[- ][Dd]outorado|Doutorado|Mestrado Profissional|Mestrado|Gradua[çc][ãa]o|Especializa[çc][ãa]o|Aperfei[çc]oamento|Curso [Tt]écnico|"
    "Ensino Fundamental|Ensino Médio|Livre-doc[êe]ncia|Resid[êe]ncia|Habilita[çc][ãa]o)\\b"
)
PROJECT_NOTES = ("situacao", "natureza", "alunos", "integrantes", "financiador", "descricao", "palavras", "numero de producoes", "numero de produc", "coordenador", "membro")
CAPITALS = "^[A-ZÁÀÂÃÉÊÍÓÔÕÚÜÇ][A-ZÁÀÂÃÉÊÍÓÔÕÚÜÇ\\s,\\.;\\-']{4,}$"
CITED, CANDIDATE, LAST_PLACE, DATED_TAIL = "\\s*\\(Citações:.*?\\)", "banca de\\s+([^.]+)\\.", "\\)\\s*([^.()]+)\\.?\\s*$", "(?s),\\s*(19|20)\\d{2}.*$"
SHORT_TITLE = 28
PERIODS = "^\\s*(\\d{4}\\s*-\\s*(?:\\d{4}|[Aa]tual)\\s*)+"


def sentences(text: Column) -> Column:
    """Parts that end with a full stop before a space, unless an abbreviation or a single letter is before it, stops in it aside."""
    dots = "\\.{0,3}"
    short = "|".join(["[^\\s.]", *[dots.join(w) for w in ABBREVIATIONS]])
    stop = f"(?<!(?:^|\\s){dots}(?i:{short}){dots})\\. "
    parts = F.split(F.regexp_replace(text, stop, ".\u0001"), "\u0001")
    return F.filter(F.transform(parts, tx.strip), lambda s: s != "")


def title_authors_venue(text: Column) -> Column:
    """struct<title, authors, venue>: a first sentence in capitals, or of capitals with semicolons, has the authors."""
    def pick(s: Column) -> Column:
        first = F.coalesce(F.get(s, 0), F.lit(""))
        named = (F.size(s) > 1) & (first.rlike(CAPITALS) | (F.contains(first, F.lit(";")) & (first == F.upper(first))))
        at = lambda k: F.coalesce(F.get(s, F.when(named, k + 1).otherwise(k)), F.lit(""))
        title = tx.strip(F.regexp_replace(at(0), CITED, ""))
        return F.struct(F.when(title == "", F.when(first == "", text).otherwise(first)).otherwise(title).alias("title"), F.when(named, first).otherwise("").alias("authors"), F.when(F.size(s) > 1, at(1)).otherwise("").alias("venue"))

    return let(sentences(text), pick)


def entry(text: Column) -> Column:
    """struct of an entry's fields: title, authors, venue, year, doi, isbn, portaria, issn and edital."""
    listed = lambda c: F.array_join(c, " ")
    fields = [tx.last_year(text).alias("year"), ids.first_doi(text).alias("doi"), ids.first_isbn(text).alias("isbn")]
    fields += [listed(ids.ordinance_pairs(text)).alias("portaria"), listed(ids.issn_numbers(text)).alias("issn"), listed(ids.call_numbers(text)).alias("edital")]
    return let(title_authors_venue(text), lambda t: F.struct(t["title"].alias("title"), t["authors"].alias("authors"), t["venue"].alias("venue"), *fields))


def committee_entry(text: Column) -> Column:
    """An entry's fields, as ``entry`` has them: the candidate, the institution at the end, and the last year."""
    name = tx.strip(F.regexp_extract(text, CANDIDATE, 1))
    fields = {"title": F.when(name == "", text).otherwise(name), "authors": F.lit(""), "venue": tx.strip(F.regexp_extract(text, LAST_PLACE, 1)), "year": tx.last_year(text), "doi": F.lit(""), "isbn": F.lit("")}
    fields |= {"portaria": F.array_join(ids.ordinance_pairs(text), " "), "issn": F.lit(""), "edital": F.array_join(ids.call_numbers(text), " ")}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def event_title(chunk: Column) -> Column:
    """Name of an organised event: after the authors' two stops, up to the year."""
    rest = F.when(F.contains(chunk, F.lit(".. ")), F.regexp_replace(chunk, "^.*?\\.\\. ", "")).otherwise(chunk)
    name = tx.strip(F.regexp_replace(rest, DATED_TAIL, ""))
    return F.when(F.length(name) >= 3, name).otherwise(chunk)


def _numbered(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """Lines with text that are no noise, numbered without gaps from 0."""
    w = Window.partitionBy(*group).orderBy("line_no")
    return body_lines.where((F.col("line") != "") & ~segment.is_noise(F.col("line"))).withColumn("k", F.row_number().over(w) - 1)


def education(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """A row for each degree: title, venue and year. A degree runs from a line with its level to the next one.

    The year is that of graduation, or the last of the text, or that of the degree before.
    """
    bare = tx.strip(F.regexp_replace("line", PERIODS, ""))
    w = Window.partitionBy(*group).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = _numbered(body_lines, group).withColumn("level", bare.rlike(LEVEL)).withColumn("n", F.sum(F.col("level").cast("int")).over(w)).where("n > 0")  # noqa: E741
    n = tx.normalize_header(F.col("line"))
    school = F.when(n.rlike("^(universidade|instituto|faculdade|fundacao|centro)"), F.col("k"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), " ")
    g = l.withColumn("bare", bare).groupBy(*group, "n").agg(F.min_by("bare", "k").alias("first"), ordered.alias("text"), F.min_by("line", school).alias("school"), F.min(school).alias("has_school"))
    graduated = F.nullif(F.regexp_extract("text", "Ano de obten[çc][ãa]o:\\s*(\\d{4})", 1), F.lit("")).cast("int")
    g = g.withColumn("own", F.nullif(F.coalesce(graduated, tx.last_year(F.col("text"))), F.lit(0)))
    before = Window.partitionBy(*group).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.regexp_replace("first", "^[ .]+|[ .]+$", "")
    venue = F.when(F.col("has_school").isNotNull(), tx.strip(F.split_part("school", F.lit(","), F.lit(1)))).otherwise("")
    out = g.withColumn("venue", venue).withColumn("year", F.coalesce(F.last("own", ignorenulls=True).over(before), F.lit(0)))
    return out.select(*group, (F.col("n") - 1).alias("entry_order"), F.when(F.col("venue") == "", title).otherwise(F.concat(title, F.lit(" — "), F.col("venue"))).alias("title"), "venue", "year", F.col("text").alias("raw_text"))


def is_project_note(line: Column) -> Column:
    n = tx.normalize_header(line)
    rest = tx.strip(F.regexp_replace(line, "\\d{4}\\s*-\\s*(?:\\d{4}|Atual)", ""))
    return n.rlike("^(" + "|".join(PROJECT_NOTES) + ")") | (F.length(line) - F.length(F.replace(line, F.lit(";"), F.lit(""))) >= 2) | (rest == "") | tx.normalize_header(rest).rlike("^(situacao|numero)")


def projects(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """A row for each description line: the project's title is the last line before it that is no note.

    A short title takes the line above along, if that is no note either. The project's text runs to the next start.
    """
    up = Window.partitionBy(*group).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy(*group).orderBy("k")
    l = _numbered(body_lines, group).withColumn("note", is_project_note(F.col("line")))  # noqa: E741
    l = l.withColumn("above", F.when(~F.lag("note").over(w), F.lag("line").over(w)))  # noqa: E741
    l = l.withColumn("title_line", F.last(F.when(~F.col("note"), F.struct("k", "line", "above")), ignorenulls=True).over(up))  # noqa: E741
    anchors = l.where(F.startswith(tx.normalize_header(F.col("line")), F.lit("descricao")) & F.col("title_line").isNotNull())
    both = (F.length("title_line.line") < SHORT_TITLE) & F.col("title_line.above").isNotNull()
    joined = F.when(both, F.concat_ws(" ", "title_line.above", "title_line.line")).otherwise(F.col("title_line.line"))
    starts = anchors.select(*group, F.when(both, F.col("title_line.k") - 1).otherwise(F.col("title_line.k")).alias("start"), joined.alias("joined")).dropDuplicates([*group, "start"])
    bare = tx.strip(F.regexp_replace("joined", "^(\\d{4}\\s*-\\s*(?:\\d{4}|Atual)\\s*)+", ""))
    starts = starts.withColumn("title", F.when(F.length(bare) < 3, F.col("joined")).otherwise(bare)).drop("joined")
    filled = l.join(starts.withColumnRenamed("start", "k"), [*group, "k"], "left").withColumn("at", F.last(F.when(F.col("title").isNotNull(), F.col("k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), " ")
    g = filled.where("at is not null").groupBy(*group, "at").agg(F.max("title").alias("title"), ordered.alias("raw_text"))
    year = lambda c: F.nullif(tx.last_year(F.col(c)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("at")) - 1
    return g.select(*group, place.alias("entry_order"), "title", F.coalesce(year("title"), year("raw_text"), F.lit(0)).alias("year"), "raw_text")
