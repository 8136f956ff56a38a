"""From whole texts to sections of entries: each section's way of reading, the choice of a split, and the clean-up after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import identifiers as ids
from dossier.functions import text as tx
from dossier.operators import dedupe, entries, segment
from dossier.sources.shared import cut

#: Fields of an entry, and what they are where a way of reading doesn't give them.
FIELDS = {"raw_text": "", "title": "", "kind": "", "year": 0, "end_year": 0, "authors": "", "venue": "", "doi": "", "isbn": "", "portaria": "", "issn": "", "edital": ""}
# Kinds of a professional record with their titles, marks of its lines, least lengths, and of awards.
RECORD_KINDS = (("Vínculo institucional", "Vínculo institucional"), ("Atividade administrativa", "Atividades administrativas"), ("Disciplina ministrada", "Disciplinas ministradas"))
BOND = "^\\d{4}\\s*-\\s*(\\d{4}|Atual)\\s+Vínculo:"
SPAN_STARTS, SPAN_ENDS = "^(especificacao|cargos ocupados)", "^(atividades$|outras informacoes|disciplinas ministradas|especificacao|cargos ocupados)"
ACTIVITY_CUT = "(?s)(\\s*[-,.]?\\s*(?iu:portaria|resolu[çc][ãa]o)\\b| , ).*$"
LEAKS = "grande area|subarea|^area:|^/ area|^compreende|^fala |^le |^escreve|^periodico|^ordenar por|^ordem "
RECORD_LEAKS, ORGANISED = "disciplinas ministradas|vinculo:|conselhos, comissoes", "Organização de evento"
YEAR_HEAD = "^((?:19|20)\\d{2}[\\s,]+)+"
CHUNK_LEAST, UNDATED_LEAST, AWARD_LEAST, ACTIVITY_LEAST = 8, 50, 6, 3


def _columns(given: dict[str, Column]) -> list[Column]:
    return [given.get(k, F.lit(v)).cast("int" if isinstance(v, int) else "string").alias(k) for k, v in FIELDS.items()]


def _joined(rows: Column, by: str = " ") -> Column:
    return F.array_join(F.transform(rows, lambda r: r["line"]), by)


def bodies(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """One row a body: its kind, committee flag, rows (ordered lines), joined text, and the split that fits it.

    ``body_lines``: group, line_no, line, kind, committee. Detached item numbers, two or more bare ones in sequence,
    are taken out first. Then: "committee" phrases if there are two and numbers were detached; "number"ed lines or year
    "period"s, two or more, if no line has a cluster of numbers; else the "year" that ends an entry.
    """
    l = body_lines.where(~segment.is_noise(F.col("line")) & ~segment.is_rank_note(F.col("line")))  # noqa: E741
    g = l.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"), F.first("kind").alias("kind"), F.first("committee").alias("committee"))
    v = F.transform(F.filter("rows", lambda r: r["line"] != ""), lambda r: F.nullif(F.regexp_extract(r["line"], segment.BARE_NUMBER, 1), F.lit("")).cast("int"))
    g = g.withColumn("v", v)
    g = g.withColumn("detached", F.exists(F.zip_with("v", F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), lambda x, y: F.coalesce(y == x + 1, F.lit(False))), lambda x: x))
    g = g.withColumn("rows", F.when(F.col("detached"), F.filter("rows", lambda r: ~r["line"].rlike(segment.BARE_NUMBER))).otherwise(F.col("rows")))
    g = g.withColumn("joined", _joined(F.col("rows")))
    cluster = F.exists("rows", lambda r: r["line"].rlike(segment.CLUSTER))
    numbered = F.size(F.filter("rows", lambda r: r["line"].rlike(segment.NUMBER_START)))
    count = lambda pattern: F.size(F.regexp_extract_all("joined", F.lit(pattern), F.lit(0)))
    split = (
        F.when(F.col("committee") & F.col("detached") & (count(segment.COMMITTEE) >= 2), "committee")
        .when(~cluster & (numbered >= 2), "number")
        .when(~cluster & (count(segment.PERIOD) >= 2), "period")
        .otherwise("year")
    )
    return g.withColumn("split", split).select(*group, "kind", "committee", "split", "rows", "joined")


def chunks(found: DataFrame, group: list[str]) -> DataFrame:
    """group, kind, committee, split, chunk_no and chunk of all bodies of ``bodies``, each by its own split."""
    keep = [*group, "kind", "committee", "split"]
    periods = segment.marked(F.col("joined"), segment.PERIOD)
    by_text = found.where(F.col("split").isin("committee", "period")).select(*keep, F.posexplode(F.when(F.col("split") == "period", periods).otherwise(segment.split_committees(F.col("joined")))).alias("chunk_no", "chunk"))
    each = found.where(F.col("split").isin("number", "year")).select(*keep, F.explode("rows").alias("r")).select(*keep, "r.line_no", "r.line")
    by_number = segment.split_numbered(each.where("split = 'number'"), keep)
    by_year = segment.split_year_anchor(each.where("split = 'year'"), keep)
    return by_text.unionByName(by_number.withColumn("chunk_no", F.col("chunk_no").cast("int"))).unionByName(by_year.withColumn("chunk_no", F.col("chunk_no").cast("int")))


def merge_notes(parts: DataFrame, group: list[str]) -> DataFrame:
    """Chunks where those that begin with a note (key words, home page) are part of the one before; renumbered from 0."""
    keep = [*group, "kind", "committee", "split"]
    w = Window.partitionBy(*keep).orderBy("chunk_no")
    head = ~segment.is_metadata(tx.strip(F.col("chunk"))) | F.lag("chunk").over(w).isNull()
    p = parts.withColumn("head", head)
    p = p.withColumn("entry_order", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    line = F.when(F.col("head"), F.col("chunk")).otherwise(tx.strip(F.col("chunk"))).alias("line")
    return p.groupBy(*keep, "entry_order").agg(_joined(F.array_sort(F.collect_list(F.struct("chunk_no", line)))).alias("chunk"))


def generic(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """The entries of bodies that have no way of reading of their own: group, entry_order and FIELDS.

    Chunks under CHUNK_LEAST characters are none; nor are undated ones under UNDATED_LEAST, unless years opened them.
    """
    c = merge_notes(chunks(cut(bodies(body_lines, group)), group), group).withColumn("chunk", tx.strip(F.col("chunk")))
    period = F.when(F.col("split") == "period", tx.last_year(F.substring("chunk", 1, 14))).otherwise(0)
    bare = F.when(F.col("split") == "period", F.regexp_replace("chunk", f"^\\s*{segment.PERIOD}\\s*", "")).otherwise(F.col("chunk"))
    c = c.withColumns({"period_year": period, "text": bare})
    c = c.where((F.length("text") >= CHUNK_LEAST) & ((F.col("split") == "period") | (F.length("text") >= UNDATED_LEAST) | (tx.last_year(F.col("text")) > 0)))
    t = F.col("text")
    c = c.withColumn("e", F.when(F.col("committee"), entries.committee_entry(t)).otherwise(entries.entry(t).cast(ENTRY)))
    given = {k: F.col(f"e.{k}") for k in ("title", "authors", "venue", "doi", "isbn", "portaria", "issn", "edital")}
    year = F.when((F.col("period_year") > 0) & ~F.col("committee"), F.col("period_year")).otherwise(F.col("e.year"))
    kind = F.when(F.col("committee"), "Banca").otherwise(F.col("kind"))
    return c.select(*group, F.col("entry_order").cast("int").alias("entry_order"), *_columns(given | {"raw_text": t, "kind": kind, "year": year}))


ENTRY = "struct<title:string,authors:string,venue:string,year:int,doi:string,isbn:string,portaria:string,issn:string,edital:string>"


def organised(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """The organised events of bodies with two or more event marks: one for each mark."""
    l = body_lines.where(~segment.is_noise(F.col("line")))  # noqa: E741
    g = l.groupBy(*group).agg(_joined(F.array_sort(F.collect_list(F.struct("line_no", "line")))).alias("text"))
    g = g.where(F.size(F.regexp_extract_all("text", F.lit(segment.EVENT_MARK), F.lit(0))) >= 2)
    c = g.select(*group, F.posexplode(segment.split_events(F.col("text"))).alias("entry_order", "chunk"))
    t = F.regexp_replace(tx.strip(F.regexp_replace("chunk", "^\\s*(\\d+\\.\\s*)+", "")), "\\s(\\d+\\.\\s){2,}", " ")
    c = c.withColumn("chunk", t).where(F.length("chunk") >= CHUNK_LEAST)
    t = F.col("chunk")
    return c.select(*group, "entry_order", *_columns({"raw_text": t, "title": entries.event_title(t), "kind": F.lit(ORGANISED), "year": tx.last_year(t)}))


def unread(body_lines: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """The lines of bodies that ``found`` has no entry of: the generic split reads them."""
    return body_lines.join(found.select(*group).distinct(), group, "left_anti")


def leaked(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """The bodies of projects that are the rest of a professional record, of which there are no projects."""
    return body_lines.where(tx.normalize_header(F.col("line")).rlike(RECORD_LEAKS)).select(*group).distinct()


def awards(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """Awards, and the years of a column that was set apart, matched by their places.

    The years head the first line or stand on lines of their own. An award ends at a full stop, if any line ends with
    one, and else at a word with a capital. An award without a year in the column takes its own last one, then
    the column's last. Lines that leak in from other columns are left out.
    """
    w = Window.partitionBy(*group).orderBy("line_no")
    whole = Window.partitionBy(*group)
    n = tx.normalize_header(F.col("line"))
    l = body_lines.where((F.col("line") != "") & ~segment.is_noise(F.col("line")) & ~n.rlike(LEAKS)).withColumn("k", F.row_number().over(w))  # noqa: E741
    headed = F.max((F.col("k") == 1) & F.col("line").rlike(YEAR_HEAD)).over(whole)
    l = l.withColumn("headed", headed)  # noqa: E741
    lone = ~F.col("headed") & F.col("line").rlike("^(19|20)\\d{2}$")
    head = F.when(F.col("headed") & (F.col("k") == 1), F.regexp_extract("line", YEAR_HEAD, 0))
    l = l.withColumns({"years": F.when(lone, F.array("line")).when(head.isNotNull(), F.regexp_extract_all(head, F.lit("(\\d{4})"), F.lit(1))), "line": F.when(head.isNotNull(), tx.strip(F.regexp_replace("line", YEAR_HEAD, ""))).otherwise(F.col("line")), "lone": lone})  # noqa: E741
    years = l.groupBy(*group).agg(F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("years").isNotNull(), F.struct("line_no", "years")))), lambda x: x["years"])), lambda y: y.cast("int")).alias("column"))
    rest = l.where("not lone and line <> ''")
    stops = F.max(F.endswith("line", F.lit("."))).over(whole)
    last_word = F.regexp_replace(F.element_at(F.split("line", " +"), -1), "^[.,;)]+|[.,;)]+$", "")
    ends = F.when(stops, F.endswith("line", F.lit("."))).otherwise(last_word.rlike("^\\p{Lu}"))
    rest = rest.withColumn("ends", ends)
    rest = rest.withColumn("entry_order", F.coalesce(F.sum(F.col("ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    a = rest.groupBy(*group, "entry_order").agg(_joined(F.array_sort(F.collect_list(F.struct("line_no", "line")))).alias("text")).where(F.length("text") >= AWARD_LEAST)
    a = a.join(years, group, "left")
    own = F.nullif(tx.last_year(F.col("text")), F.lit(0))
    year = F.coalesce(F.get("column", F.col("entry_order")), own, F.try_element_at("column", F.lit(-1)), F.lit(0))
    return a.select(*group, "entry_order", *_columns({"raw_text": F.col("text"), "title": F.col("text"), "kind": F.lit("Prêmio/Título"), "year": year}))


def activity_title(content: Column) -> Column:
    """Short name of an office: without a date before it, up to an ordinance, a resolution or a comma that stands apart."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(tx.strip(content), "^\\d{1,2}/\\d{1,2}/\\d{4}\\s*-\\s*", ""), ACTIVITY_CUT, ""), "^[ \\-,.;]+|[ \\-,.;]+$", "")


def professional(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """The bonds, activities and courses of a professional record: group, entry_order and FIELDS.

    Institution and period are those last named before; an activity's text runs from its mark to the next line that
    begins something else; an ordinance after a bond, before activities or another institution, is the bond's. A
    course stands behind its mark or on the next line. A record without any of them is one entry.
    """
    w = Window.partitionBy(*group).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = body_lines.where((F.col("line") != "") & ~segment.is_noise(F.col("line"))).withColumn("n", tx.normalize_header(F.col("line")))  # noqa: E741
    line, n = F.col("line"), F.col("n")
    l = l.withColumns({"school": tx.is_institution(line), "bond": line.rlike(BOND), "starts": n.rlike(SPAN_STARTS), "dated": line.rlike("^\\d{1,2}/\\d{4}")})  # noqa: E741
    breaks = line.rlike("^\\d{1,2}/\\d{4}\\s*-") | F.col("school") | n.rlike(SPAN_ENDS) | F.startswith(line, F.lit("https://")) | F.col("bond")
    mark = F.when(F.col("starts"), F.col("line_no")).when(breaks, -1)
    l = l.withColumn("span", F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.lit(-1)))  # noqa: E741
    l = l.withColumn("detail", (F.col("span") >= 0) & ~F.col("starts"))  # noqa: E741
    l = l.withColumn("course", F.contains(n, F.lit("disciplinas ministradas")) & ~F.col("detail"))  # noqa: E741
    l = l.withColumn("inline", F.when(F.col("course"), tx.strip(F.regexp_extract("line", "(?s):(.*)$", 1))))  # noqa: E741
    l = l.withColumn("taken", F.coalesce(F.lag(F.col("course") & (F.col("inline") == "")).over(w), F.lit(False)))  # noqa: E741
    l = l.withColumn("after", F.lead("line").over(w)).withColumn("free", ~F.col("detail") & ~F.col("taken"))  # noqa: E741
    l = l.withColumn("institution", F.coalesce(F.last(F.when(F.col("free") & F.col("school"), tx.institution_name(line)), ignorenulls=True).over(so_far), F.lit("")))  # noqa: E741
    period, y = F.substring("line", 1, 20), tx.last_year(F.substring("line", 1, 20))
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    open_ = F.contains(F.lower(F.substring("line", 1, 25)), F.lit("atual"))
    stretch = F.struct(F.coalesce(number(period, "/(\\d{4})"), y).alias("start"), F.when(open_, 0).otherwise(F.coalesce(number(F.substring("line", 1, 30), "-\\s*\\d{0,2}/?(\\d{4})"), F.lit(0))).alias("end"))
    is_period = F.col("free") & F.col("dated") & ~F.col("school") & ~F.col("bond") & (n != "atividades")
    l = l.withColumn("period", F.last(F.when(is_period, stretch), ignorenulls=True).over(so_far)).withColumn("label", F.coalesce(F.last(F.when(is_period & (y > 0), y), ignorenulls=True).over(so_far), F.lit(0)))  # noqa: E741
    owner = F.when(F.col("free") & (F.col("school") | (n == "atividades")), -1).when(F.col("free") & F.col("bond"), F.col("line_no"))
    l = cut(l.withColumn("owner", F.coalesce(F.last(owner, ignorenulls=True).over(so_far), F.lit(-1))))  # noqa: E741

    pairs = ids.ordinance_pairs(line)
    bonds = l.where("free and owner >= 0 and (bond or contains(n, 'portaria'))").groupBy(*group, "owner").agg(F.min_by("line", "line_no").alias("line"), F.min_by("institution", "line_no").alias("institution"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))).alias("pairs"))
    office = tx.strip(F.regexp_extract("line", "Enquadramento funcional:\\s*([^,]+)", 1))
    office = F.when(office == "", "Vínculo institucional").otherwise(office)
    named = F.when(F.col("institution") == "", office).otherwise(F.concat(office, F.lit(" — "), F.col("institution")))
    start, end = number(line, "^(\\d{4})"), F.coalesce(number(line, "^\\d{4}\\s*-\\s*(\\d{4})"), F.lit(0))
    bond = bonds.select(*group, F.col("owner").alias("at"), *_columns({"raw_text": line, "title": named, "kind": F.lit(RECORD_KINDS[0][0]), "year": start, "end_year": end, "venue": F.col("institution"), "portaria": F.array_join("pairs", " ")}))

    first = l.where("starts and not taken").select(*group, "span", "institution", "period", "label")
    text = l.where("detail").groupBy(*group, "span").agg(_joined(F.array_sort(F.collect_list(F.struct("line_no", "line")))).alias("text"))
    acts = first.join(text, [*group, "span"]).withColumn("title", activity_title(F.col("text"))).where(F.length("title") >= ACTIVITY_LEAST)
    begun = F.when(F.col("period.start") > 0, F.col("period.start")).otherwise(F.col("label"))
    act = acts.select(*group, F.col("span").alias("at"), *_columns({"raw_text": tx.strip(F.col("text")), "title": F.col("title"), "kind": F.lit(RECORD_KINDS[1][0]), "year": begun, "end_year": F.coalesce("period.end", F.lit(0)), "venue": F.col("institution"), "portaria": F.array_join(ids.ordinance_pairs(F.col("text")), " ")}))

    said = tx.strip(F.when(F.col("inline") != "", F.col("inline")).otherwise(F.coalesce("after", F.lit(""))))
    courses = l.where("course and free").withColumn("said", said).where(F.length("said") >= ACTIVITY_LEAST)
    told = tx.last_year(F.col("said"))
    course = courses.select(*group, F.col("line_no").alias("at"), *_columns({"raw_text": F.col("said"), "title": F.col("said"), "kind": F.lit(RECORD_KINDS[2][0]), "year": F.when(told > 0, told).otherwise(F.col("label")), "venue": F.col("institution")}))

    found = bond.unionByName(act).unionByName(course)
    last = l.groupBy(*group).agg(F.max_by("institution", "line_no").alias("institution"), _joined(F.array_sort(F.collect_list(F.struct("line_no", "line"))), "\n").alias("whole"))
    none = last.join(found.select(*group).distinct(), group, "left_anti")
    title = F.when(F.col("institution") == "", "Atuação profissional").otherwise(F.col("institution"))
    alone = none.select(*group, F.lit(0).alias("at"), *_columns({"raw_text": F.col("whole"), "title": title, "kind": F.lit(RECORD_KINDS[0][0]), "venue": F.col("institution")}))
    place = (F.row_number().over(Window.partitionBy(*group).orderBy("at", "kind")) - 1).cast("int")
    return found.unionByName(alone).withColumn("entry_order", place).select(*group, "entry_order", *FIELDS)


def by_institution(record: DataFrame, group: list[str]) -> DataFrame:
    """A professional record's entries with ``label`` (institution and kind), label_order, and entry_order anew.

    Spellings with and without an abbreviation at the end are one institution, under the longest one. Institutions and
    the entries of each kind come most recent first; what is open, courses aside, is most recent of all.
    """
    key = F.when(F.col("venue") == "", "outros vinculos").otherwise(tx.institution_key(F.col("venue")))
    recent = F.when((F.col("kind") != RECORD_KINDS[2][0]) & (F.col("end_year") == 0) & (F.col("year") > 0), 9999).otherwise(F.greatest("year", "end_year"))
    e = record.withColumns({"key": key, "recent": recent})
    named = F.when(F.col("venue") != "", F.col("venue"))
    i = e.groupBy(*group, "key").agg(F.coalesce(F.max_by(named, F.when(named.isNotNull(), F.struct(F.length(named), named))), F.lit("Outros vínculos")).alias("shown"), F.max("recent").alias("latest"))
    i = i.withColumn("institution_order", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("latest"), "shown")))
    kinds, shown = F.array(*[F.lit(k) for k, _ in RECORD_KINDS]), F.array(*[F.lit(s) for _, s in RECORD_KINDS])
    e = e.join(i, [*group, "key"]).withColumn("k", F.array_position(kinds, F.col("kind")).cast("int"))
    place = F.row_number().over(Window.partitionBy(*group, "key", "kind").orderBy(F.desc("recent"), "entry_order")) - 1
    out = e.withColumns({"entry_order": place.cast("int"), "label": F.concat_ws(" - ", "shown", F.get(shown, F.col("k") - 1)), "label_order": F.col("institution_order") * 10 + F.col("k")})
    return out.select(*group, "label", "label_order", "entry_order", *FIELDS)


def cv_entries(docs: DataFrame) -> DataFrame:
    """doc_id, section, section_order, entry_order and FIELDS of all entries of whole texts (``docs``: doc_id, text).

    Lines become sections; each section's mode picks its way of reading; bodies of equal titles are merged in the
    order of the text, without repeated and cut-off entries; entries that nothing but the owner's name and
    administrative words are left of, and sections without entries, go.
    """
    group = ["doc_id", "sec_no", "part", "section"]
    lines = cut(segment.sections(docs).withColumn("part", F.lit(0)).withColumnRenamed("title", "section"))
    mode = lambda *m: lines.where(F.col("mode").isin(*m))
    levels = F.contains("section", F.lit("trabalhos de conclusão"))
    graded = segment.committee_levels(mode("banca").where(levels), ["doc_id", "sec_no", "section"])
    w = Window.partitionBy("doc_id", "sec_no").orderBy("line_no")
    turn = F.coalesce(F.col("level") != F.lag("level").over(w), F.lit(True)).cast("int")
    graded = graded.withColumn("turn", turn).withColumn("part", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    graded = graded.withColumn("section", F.when(F.col("level") == "", F.col("section")).otherwise(F.concat_ws(" - ", "section", "level")))
    plain = [*group, "line_no", "line"]
    committee = graded.select(*plain).unionByName(mode("banca").where(~levels).select(*plain)).withColumns({"kind": F.lit("Banca"), "committee": F.lit(True)})
    events = mode("eventos").select(*plain).withColumns({"kind": F.lit("Evento"), "committee": F.lit(False)})
    other = mode("none").select(*plain, tx.kind_label(F.col("section")).alias("kind")).withColumn("committee", F.lit(False))
    project_lines, event_lines = mode("projetos").select(*plain), mode("organizacao").select(*plain)
    projects, organised_ = cut(entries.projects(project_lines, group)), cut(organised(event_lines, group))
    no_projects = unread(project_lines, projects, group).join(leaked(project_lines, group), group, "left_anti").withColumns({"kind": F.lit("Projeto"), "committee": F.lit(False)})
    no_marks = unread(event_lines, organised_, group).withColumns({"kind": F.lit(ORGANISED), "committee": F.lit(False)})
    read = generic(reduce(DataFrame.unionByName, [committee, events, other, no_projects, no_marks]), group)
    heard = F.when(tx.is_listener(F.col("raw_text")), "Participação em Eventos - Ouvinte").otherwise("Participação em Eventos - Apresentação")
    read = read.withColumn("section", F.when(F.col("kind") == "Evento", heard).otherwise(F.col("section")))
    record = by_institution(professional(mode("atuacao").select(*plain), group), group)
    record = record.withColumns({"section": F.concat_ws(" - ", "section", "label"), "part": F.col("label_order").cast("int")}).drop("label", "label_order")
    degrees = entries.education(mode("formacao").select(*plain), group).select(*group, F.col("entry_order").cast("int").alias("entry_order"), *_columns({"raw_text": F.col("raw_text"), "title": F.col("title"), "kind": F.lit("Formação"), "year": F.col("year"), "venue": F.col("venue")}))
    projects = projects.select(*group, F.col("entry_order").cast("int").alias("entry_order"), *_columns({"raw_text": F.col("raw_text"), "title": F.col("title"), "kind": F.lit("Projeto"), "year": F.col("year")}))
    parts = [read, record, degrees, projects, organised_, awards(mode("premios").select(*plain), group)]
    all_ = reduce(DataFrame.unionByName, parts).withColumn("body", F.col("sec_no").cast("long") * 100_000 + F.col("part")).drop("sec_no", "part")
    merged = dedupe.merge_bodies(all_, ["doc_id", "section"], "body")
    owner = segment.owner_name(docs).select("doc_id", F.filter(tx.words(tx.normalize(F.col("name"))), lambda x: F.length(x) >= 4).alias("owner"))
    kept = merged.join(owner, "doc_id").where(~tx.is_junk(F.col("title"), F.col("venue"), F.col("owner")))
    first = F.min("body").over(Window.partitionBy("doc_id", "section"))
    order = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first", "section"))
    return kept.withColumn("first", first).withColumn("section_order", order - 1).select("doc_id", "section", F.col("section_order").cast("long").alias("section_order"), "entry_order", *FIELDS)
