"""Segmentation of a document's ordered lines: noise, headers, sections, and the splits of a section's body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.functions.binding import let

# Section headers (folded name, shown title, mode, child of a group), delimiters and level markers.
HEADERS = (
    ("formacao academica/titulacao", "Formação acadêmica/titulação", "formacao", False),
    ("pos-doutorado", "Pós-doutorado", "formacao", False),
    ("formacao complementar", "Formação complementar", "none", False),
    ("premios e titulos", "Prêmios e títulos", "premios", False),
    ("atuacao profissional", "Atuação profissional", "atuacao", False),
    ("projetos de pesquisa", "Projetos de pesquisa", "projetos", False),
    ("projeto de pesquisa", "Projetos de pesquisa", "projetos", False),
    ("projetos de extensao", "Projetos de extensão", "projetos", False),
    ("projeto de extensao", "Projetos de extensão", "projetos", False),
    ("projetos de desenvolvimento", "Projetos de desenvolvimento", "projetos", False),
    ("membro de corpo editorial", "Membro de corpo editorial", "none", False),
    ("artigos completos publicados em periodicos", "Artigos completos publicados em periódicos", "none", False),
    ("artigos aceitos para publicacao", "Artigos aceitos para publicação", "none", False),
    ("livros publicados", "Livros publicados", "none", False),
    ("capitulos de livros publicados", "Capítulos de livros publicados", "none", False),
    ("trabalhos publicados em anais de eventos", "Trabalhos publicados em anais de eventos", "none", False),
    ("trabalhos completos publicados em anais de congressos", "Trabalhos completos publicados em anais", "none", False),
    ("resumos expandidos publicados em anais de congressos", "Resumos expandidos publicados em anais", "none", False),
    ("resumos publicados em anais de congressos", "Resumos publicados em anais", "none", False),
    ("textos em jornais de noticias/revistas", "Textos em jornais de notícias/revistas", "none", False),
    ("apresentacao de trabalho e palestra", "Apresentação de trabalho e palestra", "none", False),
    ("apresentacoes de trabalho", "Apresentação de trabalho e palestra", "none", False),
    ("apresentacao de trabalho", "Apresentação de trabalho e palestra", "none", False),
    ("outras producoes bibliograficas", "Outras produções bibliográficas", "none", False),
    ("trabalhos tecnicos", "Trabalhos técnicos", "none", False),
    ("demais tipos de producao tecnica", "Demais produções técnicas", "none", False),
    ("entrevistas, mesas redondas, programas e comentarios na midia", "Entrevistas, mesas redondas e programas na mídia", "none", False),
    ("demais producoes tecnicas", "Demais produções técnicas", "none", False),
    ("produtos tecnicos", "Produtos técnicos", "none", False),
    ("programas de computador", "Programas de computador", "none", False),
    ("participacao em eventos", "Participação em eventos", "eventos", False),
    ("organizacao de evento", "Organização de eventos", "organizacao", False),
    ("participacao em banca de trabalhos de conclusao", "Participação em bancas (trabalhos de conclusão)", "banca", False),
    ("participacao em bancas de trabalhos de conclusao", "Participação em bancas (trabalhos de conclusão)", "banca", False),
    ("participacao em banca de comissoes julgadoras", "Participação em bancas (comissões julgadoras)", "banca", False),
    ("participacao em bancas de comissoes julgadoras", "Participação em bancas (comissões julgadoras)", "banca", False),
    ("dissertacoes de mestrado: orientador principal", "Dissertações de mestrado", "none", True),
    ("dissertacoes de mestrado: coorientador", "Dissertações de mestrado (coorientação)", "none", True),
    ("teses de doutorado: orientador principal", "Teses de doutorado", "none", True),
    ("teses de doutorado: coorientador", "Teses de doutorado (coorientação)", "none", True),
    ("iniciacao cientifica", "Iniciação científica", "none", True),
    ("orientacao de outra natureza", "Orientações de outra natureza", "none", True),
    ("trabalho de conclusao de curso de graduacao", "TCC de graduação", "none", True),
    ("supervisao de pos-doutorado", "Supervisão de pós-doutorado", "none", True),
)
EXCLUDED = (
    "identificacao", "idiomas", "areas de atuacao", "endereco", "linhas de pesquisa", "linha de pesquisa", "producao", "producao bibliografica",
    "producao tecnica", "orientacoes e supervisoes", "eventos", "bancas", "educacao e popularizacao de c&t", "outras informacoes relevantes", "dados complementares",
)
STOP, DONE, ONGOING = "totais de producao", "orientacoes e supervisoes concluidas", "orientacoes e supervisoes em andamento"
NOISE_LINES = ("Currículo Lattes", "Ordenar por", "Ordem Cronológica", "Ordem de Importância")
PREFIX_LEAST = 12
#: Characters of a folded line that decide on a header; the longest name has 62.
HEAD_CHARS = 160
PERIOD = "\\b\\d{4}\\s*-\\s*(?:\\d{4}|[Aa]tual)\\b"
COMMITTEE = "(?iu)Participaç[ãa]o\\s+em\\s+banca\\s+de"
EVENT_MARK = "(?i)evento\\s*\\)"
BARE_NUMBER, NUMBER_START, CLUSTER = "^\\s*(\\d{1,3})\\.\\s*$", "^\\s*\\d{1,3}\\.(\\s+\\S|\\s*$)", "^\\s*(\\d{1,3}\\.\\s+){2,}"
TIME_STAMP = "^\\d{2}/\\d{2}/\\d{4},?\\s*\\d{1,2}:\\d{2}"
METADATA = ("palavras-chave", "referencias adicionais", "home page", "meio de divulgacao")
CITED_KINDS = ("Artigo", "Livro/Capítulo", "Trabalho em evento", "Produção técnica", "Mídia", "Corpo editorial")
RANK_NOTE = "(?iu)^(A[1-4]|B[1-5]|C|N[ãa]o classificado)\\s*,\\s*ISSN"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0) and line, trimmed, of each text."""
    return docs.select("doc_id", F.posexplode(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), tx.strip)).alias("line_no", "line"))


def is_noise(line: Column) -> Column:
    """Marks of printing: page footers, time stamps and menu words."""
    return F.contains(line, F.lit("wwws.cnpq.br")) | F.startswith(line, F.lit("impcv.trata")) | line.rlike(TIME_STAMP) | line.isin(*NOISE_LINES)


def closes_more(text: Column) -> Column:
    """More closing than opening parentheses: the end of a note begun on a line before."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return count(")") > count("(")


def header_name(line: Column) -> Column:
    """What of a line a header is found by: of the folded line, if that is long, its first HEAD_CHARS characters and a mark that no name has."""
    return let(tx.normalize_header(line), lambda n: F.when(F.length(n) <= HEAD_CHARS, n).otherwise(F.concat(F.substring(n, 1, HEAD_CHARS), F.lit("\u0001"))))


def header(norm: Column, closes: Column | None = None) -> Column:
    """struct<name, cls, display, mode, child> of a line by its ``header_name``, or null: stop, excluded, done, ongoing or section.

    The table is short and fixed: a literal map by the first PREFIX_LEAST characters; the first fitting row counts.
    A long name also fits as a prefix, unless the line ``closes`` more parentheses than it opens (by default told from ``norm``).
    """
    closes = closes_more(norm) if closes is None else closes
    row = lambda cls, name="", display="", mode="none", child=False: F.struct(*[F.lit(v).alias(k) for k, v in (("name", name), ("cls", cls), ("display", display), ("mode", mode), ("child", child))])
    rows = [("stop", STOP), *(("excluded", n) for n in EXCLUDED), ("done", DONE), ("ongoing", ONGOING), *(("section", *h) for h in HEADERS)]
    heads: dict[str, list] = {}
    for r in rows:
        heads.setdefault(r[1][:PREFIX_LEAST], []).append(row(*r))
    table = F.create_map(*[x for k, v in heads.items() for x in (F.lit(k), F.array(*v))])

    def first(n: Column) -> Column:
        long_name = lambda h: (h["cls"] == "section") & (F.length(h["name"]) >= PREFIX_LEAST) & F.startswith(n, h["name"]) & ~closes
        return F.get(F.filter(F.try_element_at(table, F.substring(n, 1, PREFIX_LEAST)), lambda h: (h["name"] == n) | long_name(h)), 0)

    return let(norm, lambda n: F.when(F.substring(n, 1, PREFIX_LEAST).isin(*heads), first(n)))


def sections(docs: DataFrame) -> DataFrame:
    """Body lines by section: doc_id, sec_no (line of the header), title, mode, line_no and line.

    A header may be broken over two lines, of which the first is then no header itself; of a run of such first
    lines every other one counts, as each takes its successor with it. Lines from the first stop header on, under
    excluded and group headers, and before any header belong to no section. Titles of group children carry the
    group's state. Empty lines inside a section stay; sections without any text do not.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    l = lines(docs).withColumns({"norm": header_name(F.col("line")), "closes": closes_more(F.col("line")), "noise": is_noise(F.col("line"))})  # noqa: E741
    l = l.withColumns({"next": F.lead("line").over(w), "own": header(F.col("norm"), F.col("closes"))})
    both = F.concat_ws(" ", "line", "next")
    joined = header(header_name(both), closes_more(both))
    may = ~F.col("noise") & (F.col("norm") != "") & F.col("own").isNull() & ~F.col("closes") & F.col("next").isNotNull() & (F.col("next") != "") & ~is_noise(F.col("next"))
    l = l.withColumn("both", F.when(may, joined)).withColumn("opens", F.coalesce(F.col("both.cls").isin("section", "excluded"), F.lit(False)))
    run = F.sum(F.when(F.col("opens"), 0).otherwise(1)).over(w)
    l = l.withColumn("run", run).withColumn("takes", F.col("opens") & (F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc_id", "run").orderBy("line_no")) % 2 == 1))
    l = l.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False)))
    head = F.when(~F.col("taken") & ~F.col("noise") & (F.col("norm") != ""), F.when(F.col("takes"), F.col("both")).otherwise(F.col("own")))
    l = l.withColumn("head", head)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stopped = F.max((F.col("head.cls") == "stop").cast("int")).over(running)
    l = l.withColumn("stopped", F.coalesce(stopped, F.lit(0))).where("stopped = 0")
    group = F.when(F.col("head.cls") == "done", " (concluídas)").when(F.col("head.cls") == "ongoing", " (em andamento)").when((F.col("head.cls") == "excluded") | ((F.col("head.cls") == "section") & ~F.col("head.child")), "")
    l = l.withColumn("suffix", F.coalesce(F.last(group, ignorenulls=True).over(running), F.lit("")))
    title = F.when(F.col("head.child"), F.concat(F.lit("Orientações - "), F.col("head.display"), F.col("suffix"))).otherwise(F.col("head.display"))
    mark = F.when(F.col("head").isNotNull(), F.struct(F.col("line_no").alias("sec_no"), (F.col("head.cls") == "section").alias("open"), title.alias("title"), F.col("head.mode").alias("mode")))
    l = l.withColumn("at", F.last(mark, ignorenulls=True).over(running)).where("at.open and head is null and not taken and not noise")
    l = l.withColumn("some", F.max(F.length("line")).over(Window.partitionBy("doc_id", "at.sec_no"))).where("some > 0")
    return l.select("doc_id", "at.sec_no", "at.title", "at.mode", "line_no", "line")


def bodies(section_lines: DataFrame) -> DataFrame:
    """doc_id, title, mode, sec_no and body of each section."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return section_lines.groupBy("doc_id", "title", "mode", "sec_no").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))


def is_metadata(line: Column) -> Column:
    return tx.normalize_header(line).rlike("^(" + "|".join(METADATA) + ")")


def is_continuation(line: Column) -> Column:
    """Lines that never open an entry: links, lower case, dashes, and notes on ordinances and calls."""
    n = tx.normalize_header(line)
    return line.rlike("^(http|www\\.|\\[http|\\[www\\.|\\p{Ll}|-|–)") | n.rlike("^(portaria|edital)") | ((F.length(line) <= 90) & n.rlike("(portaria|edital)\\s*n"))


def is_rank_note(line: Column) -> Column:
    return F.contains(F.lower(line), F.lit("fonte qualis")) | line.rlike(RANK_NOTE)


def has_year(text: Column) -> Column:
    return text.rlike("\\b(19|20)\\d{2}\\b")


def ends_with_year(line: Column) -> Column:
    return tx.strip(line).rlike("(19|20)\\d{2}\\.?$")


def ends_sentence(line: Column) -> Column:
    return tx.strip(line).rlike("(\\.|\\.\"|\"\\.|\\)\\.)$")


def is_stray(line: Column, kind: Column) -> Column:
    """A piece of a citation left alone by a page break: short, without a year, no comma near its start."""
    return kind.isin(*CITED_KINDS) & (F.length(line) <= 160) & ~F.contains(F.substring(line, 1, 50), F.lit(",")) & ~has_year(line)


def detached_numbers(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """Lines with text, without bare numbers where a column of item numbers was set apart.

    Two neighbours among the lines with text that are numbers in sequence show such a column; then all bare
    numbers of the body go. Numbers that are in no sequence stay.
    """
    w = Window.partitionBy(*group).orderBy("line_no")
    v = F.nullif(F.regexp_extract("line", BARE_NUMBER, 1), F.lit("")).cast("int")
    full = body_lines.where("line <> ''").withColumn("v", v)
    full = full.withColumn("follows", F.coalesce(F.col("v") == F.lag("v").over(w) + 1, F.lit(False)))
    apart = F.max("follows").over(Window.partitionBy(*group))
    return full.withColumn("apart", apart).where("v is null or not apart").drop("v", "follows", "apart")


def split_numbered(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """Chunks, from 0 on, that begin at the first line and at lines with an item number; numbers are taken off all lines."""
    w = Window.partitionBy(*group).orderBy("line_no")
    starts = F.col("line").rlike(NUMBER_START) & F.lag("line").over(w).isNotNull()
    l = body_lines.where("line <> ''").withColumn("starts", starts.cast("int"))  # noqa: E741
    l = l.withColumn("chunk_no", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # noqa: E741
    ordered = F.array_sort(F.collect_list(F.struct("line_no", tx.strip_number(F.col("line")).alias("line"))))
    return l.groupBy(*group, "chunk_no").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("chunk"))


def marked(text: Column, pattern: str) -> Column:
    """The parts of a text that begin at each match of ``pattern``; what stands before the first is lost."""
    parts = F.split(F.regexp_replace(text, pattern, "\u0001$0"), "\u0001")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def split_periods(text: Column) -> Column:
    """array<struct<start, end, chunk>>: the text after each year range; an open range ends at 0."""
    return F.transform(
        marked(text, PERIOD),
        lambda p: F.struct(
            F.regexp_extract(p, "^(\\d{4})", 1).cast("int").alias("start"),
            F.coalesce(F.nullif(F.regexp_extract(p, "^\\d{4}\\s*-\\s*(\\d{4})", 1), F.lit("")).cast("int"), F.lit(0)).alias("end"),
            tx.strip(F.regexp_replace(p, f"^{PERIOD}", "")).alias("chunk"),
        ),
    )


def split_committees(text: Column) -> Column:
    """Entries that begin with the committee phrase, without what is left of item numbers."""
    return F.transform(marked(text, COMMITTEE), lambda p: F.regexp_replace(p, "\\s(\\d{1,3}\\.\\s)+", " "))


def split_events(text: Column) -> Column:
    """The parts that end with each event mark, if there are two or more (what follows the last is lost); else the text as a whole."""
    parts = F.split(F.regexp_replace(text, EVENT_MARK, "$0\u0001"), "\u0001")
    return F.when(F.size(parts) > 2, F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), tx.strip)).otherwise(F.array(tx.strip(text)))


def by_title(section_bodies: DataFrame) -> DataFrame:
    """doc_id, title, place (from 0, as the title is first seen) and bodies (in order) of each title of ``bodies``."""
    g = section_bodies.groupBy("doc_id", "title").agg(F.min("sec_no").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("sec_no", "body"))), lambda x: x["body"]).alias("bodies"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).drop("first")


def split_year_anchor(body_lines: DataFrame, group: list[str], kind: str = "kind") -> DataFrame:
    """Chunks that end where a year has been seen and a line ends a sentence or with a year.

    A fold over each body's ordered line flags (is the buffer empty, has it a year, is there a chunk yet) gives each
    line its chunk; notes, continuations and strays after an end go to the chunk before.
    """
    line = F.regexp_replace(F.regexp_replace(F.col("line"), "^\\s*(\\d{1,3}\\.\\s+){2,}", ""), "^\\s*\\d{1,3}\\.\\s*", "")
    l = body_lines.withColumn("line", line).where("line <> ''")  # noqa: E741
    w = Window.partitionBy(*group).orderBy("line_no")
    tail = tx.strip(F.regexp_replace("line", "\\s*Citações:\\s*\\d+(\\s*\\|\\s*\\d+)?\\s*$", ""))
    ends = (ends_sentence(tail) | ends_with_year(tail)) & ~(ends_with_year(tail) & F.coalesce(F.startswith(F.lead("line").over(w), F.lit("(")), F.lit(False)))
    glue = is_metadata(F.col("line")) | is_continuation(F.col("line")) | is_stray(F.col("line"), F.col(kind))
    l = l.withColumns({"ends": ends, "glue": glue, "dated": has_year(F.col("line"))})
    flags = l.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "ends", "glue", "dated"))).alias("rows"))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("chunk"), F.lit(True).alias("empty"), F.lit(False).alias("dated"))

    def step(s: Column, r: Column) -> Column:
        back = s["empty"] & (s["chunk"] > 0) & r["glue"]
        dated = s["dated"] | r["dated"]
        closes = dated & r["ends"]
        return F.when(back, F.struct(F.array_append(s["ids"], s["chunk"] - 1).alias("ids"), s["chunk"].alias("chunk"), s["empty"].alias("empty"), s["dated"].alias("dated"))).otherwise(
            F.struct(
                F.array_append(s["ids"], s["chunk"]).alias("ids"),
                F.when(closes, s["chunk"] + 1).otherwise(s["chunk"]).alias("chunk"),
                closes.alias("empty"),
                (dated & ~closes).alias("dated"),
            )
        )

    ids = flags.withColumn("ids", F.aggregate("rows", start, step, lambda s: s["ids"]))
    each = ids.select(*group, F.posexplode(F.arrays_zip("rows", "ids")).alias("at", "x")).select(*group, F.col("x.ids").alias("chunk_no"), "at", "x.rows.line")
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return each.groupBy(*group, "chunk_no").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("chunk"))


# Level markers of committees.
LEVELS = {"mestrado": "Mestrado", "doutorado": "Doutorado", "exame de qualificacao de mestrado": "Qualificação de Mestrado", "exame de qualificacao de doutorado": "Qualificação de Doutorado", "graduacao": "Graduação"}


def committee_levels(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """level of each line of committees, where a marker behind k item numbers takes effect k entries later.

    A fold over each body's ordered lines. A marker with item numbers before it waits if no line has come since the last level
    took effect and no other marker waits; every other marker takes effect at once. Lines at which an entry opens count down a waiting one.
    An entry opens where its phrase begins, which may go on in the next line. Lines before the first marker are left out once
    there is one.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    b = body_lines.select(*group, "line_no", "line").groupBy(*group).agg(ordered.alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.translate(r["line"], "\n\u0001", "  ")), "\n")
    parts = F.split(F.regexp_replace(text, COMMITTEE, "\u0001$0"), "\n")
    names = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])

    def told(r: Column, part: Column) -> Column:
        norm = tx.normalize_header(r["line"])
        numbers = F.regexp_extract(norm, "^(\\d{1,3}\\.\\s*)*", 0)
        level = F.try_element_at(names, F.substring(norm, F.length(numbers) + 1, F.length(norm)))
        waits = F.length(numbers) - F.length(F.replace(numbers, F.lit("."), F.lit("")))
        return F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), level.alias("level"), waits.alias("waits"), F.contains(part, F.lit("\u0001")).alias("opens"))

    b = b.withColumn("rows", F.zip_with("rows", parts, told))
    state = {"out": F.array().cast("array<string>"), "now": F.lit(""), "next": F.lit(None).cast("string"), "left": F.lit(0), "fresh": F.lit(True)}

    def step(s: Column, r: Column) -> Column:
        new = lambda **k: F.struct(*[k.get(c, s[c]).alias(c) for c in state])
        waits = s["fresh"] & (r["waits"] > 0) & (s["now"] != "") & s["next"].isNull()
        left = F.when(s["next"].isNotNull() & r["opens"], s["left"] - 1).otherwise(s["left"])
        due = s["next"].isNotNull() & (left < 0)
        now, none = F.when(due, s["next"]).otherwise(s["now"]), F.lit(None).cast("string")
        skipped = F.array_append(s["out"], none)
        marker = F.when(waits, new(out=skipped, next=r["level"], left=r["waits"])).otherwise(new(out=skipped, now=r["level"], next=none, left=F.lit(0), fresh=F.lit(True)))
        return F.when(r["level"].isNotNull(), marker).otherwise(new(out=F.array_append(s["out"], now), now=now, next=F.when(~due, s["next"]), left=left, fresh=F.lit(False)))

    start = F.struct(*[v.alias(k) for k, v in state.items()])
    found = b.select(*group, "rows", F.aggregate("rows", start, step, lambda s: s["out"]).alias("levels"), F.exists("rows", lambda r: r["level"].isNotNull()).alias("marked"))
    each = found.select(*group, "marked", F.explode(F.arrays_zip("rows", "levels")).alias("x")).select(*group, "marked", "x.rows.line_no", "x.rows.line", F.col("x.levels").alias("level"))
    return each.where(F.col("level").isNotNull() & ~(F.col("marked") & (F.col("level") == ""))).drop("marked")


def forward_fill(body_lines: DataFrame, group: list[str]) -> DataFrame:
    """Lines of a professional record with the institution and the period last named before or on them."""
    w = Window.partitionBy(*group).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = tx.is_institution(F.col("line"))
    bond = F.regexp_extract("line", "^(\\d{4})\\s*-\\s*(?:\\d{4}|Atual)\\s+Vínculo:", 1)
    end = F.regexp_extract("line", "^\\d{4}\\s*-\\s*(\\d{4})\\s+Vínculo:", 1)
    period = F.when(bond != "", F.struct(bond.cast("int").alias("start"), F.coalesce(F.nullif(end, F.lit("")).cast("int"), F.lit(0)).alias("end")))
    return body_lines.withColumn("institution", F.last(F.when(named, tx.institution_name(F.col("line"))), ignorenulls=True).over(w)).withColumn("period", F.last(period, ignorenulls=True).over(w))


def owner_name(docs: DataFrame) -> DataFrame:
    """doc_id and name: the line above the address line, a labelled one, or the first that looks like a name."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("line")
    low = F.lower(t)
    looks = (
        F.length(t).between(5, 70) & ~t.rlike("http|[:@/]|\\d") & ~low.rlike("curríc|curric|anotou|ver artigos|visualizar|endereço")
        & (F.size(F.filter(F.split(t, " "), lambda x: F.length(x) >= 2)) >= 2)
    )
    rest = tx.strip(F.substring(t, 6, 1 << 20))
    labelled = F.startswith(t, F.lit("Nome ")) & F.length(rest).between(3, 69) & ~F.startswith(F.lower(rest), F.lit("em ")) & ~F.contains(F.lower(rest), F.lit("citaç"))
    l = lines(docs).withColumns({"looks": looks, "labelled": labelled, "rest": rest})  # noqa: E741
    above = F.last(F.when(F.col("line") != "", F.struct("line", "looks")), ignorenulls=True).over(w)
    l = l.withColumn("above", F.when(F.contains(t, F.lit("Endereço para acessar este CV")), above))
    first = lambda value, when: F.min_by(value, F.when(when, F.col("line_no")))
    g = l.groupBy("doc_id").agg(
        F.min_by("above", F.when(F.col("above").isNotNull(), F.col("line_no"))).alias("a"), first("rest", F.col("labelled")).alias("b"), F.max("labelled").alias("has_b"), first("line", F.col("looks")).alias("c"), F.max("looks").alias("has_c")
    )
    return g.select("doc_id", F.coalesce(F.when(F.col("a.looks"), F.col("a.line")), F.when(F.col("has_b"), F.col("b")), F.when(F.col("has_c"), F.col("c")), F.lit("Currículo Lattes")).alias("name"))
