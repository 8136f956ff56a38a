"""Text functions as column expressions: folding, tokens, years, keys, titles and labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case precomposed letters of Latin-1 and Latin Extended-A, and the base letter of each."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()

# Words that never identify a document, administrative words, and roles of an active participant.
STOPWORDS = (
    "para por com dos das uma que nas nos ao aos pela pelo the and of in on de do da em no na os as um se sua seu como sobre entre ou etc este"
    " esta pelos pelas anais revista journal vol carga horaria hora horas outras informacoes atual nivel regime certificado certificamos"
    " declaracao declaramos total"
).split()
ADMIN_WORDS = (
    "carga horaria hora horas episodio vol num pagina paginas total certificado certificamos declaracao declaramos outras informacoes nivel regime atual"
).split()
PRESENTATION_ROLES = (
    "conferencista apresentacao comunicacao moderador mediador palestrante debatedor expositor avaliador coordenador organizador relator painelista"
    " entrevistado instrutor"
).split()
#: Kinds that a folder name hints at, by the parts of a name.
FOLDER_KINDS = (
    (("banca",), ("Banca",)),
    (("aprovacao",), ("Vínculo institucional",)),
    (
        ("evento", "apresenta", "poster", "debatedor", "mediador", "mesa", "palestra", "conferen", "congress", "coloquio", "simposio", "semana"),
        ("Evento", "Apresentação", "Organização de evento", "Trabalho em evento"),
    ),
    (("organizacao",), ("Organização de evento",)),
    (("orienta", "monitoria"), ("Orientação",)),
    (("parecer", "tecnic"), ("Produção técnica",)),
    (("formacao", "curso", "alura", "lingua", "idioma", "capacita"), ("Formação",)),
    (("projeto", "extensao", "pesquisa"), ("Projeto",)),
    (("premio", "titulo"), ("Prêmio/Título",)),
    (("edito",), ("Corpo editorial", "Mídia")),
    (("didatica", "disciplina", "experiencia", "docencia"), ("Disciplina ministrada", "Vínculo institucional")),
    (("bolsa",), ("Formação", "Projeto")),
)
#: Kind of an entry by the parts of its section's title; the first rule that fits counts.
KIND_LABELS = (
    (("artigo",), "Artigo"),
    (("livro", "capitulo"), "Livro/Capítulo"),
    (("anais",), "Trabalho em evento"),
    (("banca",), "Banca"),
    (("dissertacoes", "teses", "iniciacao", "orientac", "tcc", "supervisao"), "Orientação"),
    (("apresentac",), "Apresentação"),
    (("participacao em eventos",), "Evento"),
    (("organizacao de evento",), "Organização de evento"),
    (("projeto",), "Projeto"),
    (("premio", "titulo"), "Prêmio/Título"),
    (("formacao", "doutorado"), "Formação"),
    (("corpo editorial",), "Corpo editorial"),
    (("entrevista",), "Mídia"),
    (("tecnic", "produto"), "Produção técnica"),
)
NO_STRINGS = "array<string>"


def fold(text: Column) -> Column:
    """Lower case without accents; punctuation stays."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "\\p{M}", "")


def normalize(text: Column) -> Column:
    """Folded words of letters and digits, parted by one space."""
    return F.trim(F.regexp_replace(fold(text), "[^\\p{L}\\p{N}]+", " "))


def strip(text: Column) -> Column:
    """Without white space at both ends; unlike trim(), this takes tabs and line ends too."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def normalize_header(line: Column) -> Column:
    return strip(fold(line))


def words(normalized: Column) -> Column:
    """The words of a normalized text, in order and with repeats."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def is_meaningful(word: Column) -> Column:
    return (F.length(word) >= 4) & ~word.isin(STOPWORDS) & ~word.rlike("^\\p{N}+$")


def meaningful(normalized: Column) -> Column:
    """Words that may identify a text, with repeats."""
    return F.filter(words(normalized), is_meaningful)


def last_year(text: Column) -> Column:
    """The last 19xx or 20xx that stands alone, else 0."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit("\\b((?:19|20)\\d{2})\\b"), 1), F.lit(-1)).cast("int"), F.lit(0))


def year_set(text: Column) -> Column:
    """Distinct years from 1990 to 2035, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit("\\b((?:19|20)\\d{2})\\b"), 1), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(1990, 2035))))


def strip_number(line: Column) -> Column:
    """Without a leading item number of up to three digits."""
    return F.regexp_replace(line, "^\\s*\\d{1,3}\\.\\s*", "")


def hash_key(year: Column, title: Column) -> Column:
    """Key that survives a re-import: year and the first 60 characters of the title."""
    return F.concat_ws("_", year.cast("string"), F.substring(strip(F.lower(title)), 1, 60))


def display_title(kind: Column, title: Column, raw: Column, venue: Column, year: Column) -> Column:
    core = F.replace(strip(F.when(title == "", raw).otherwise(title)), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(core) > 150, F.concat(F.substring(core, 1, 150), F.lit("…"))).otherwise(core)
    shown = (venue != "") & ~F.contains(F.lower(short), F.lower(venue)) & (F.length(venue) < 80)
    head = F.concat_ws(" — ", F.nullif(kind, F.lit("")), F.nullif(short, F.lit("")), F.when(shown, venue))
    return F.when(year > 0, F.concat(head, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(head)


def _rules(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def folder_kinds(path: Column) -> Column:
    """Distinct kinds that a path hints at, sorted."""
    none = F.array().cast(NO_STRINGS)
    found = [F.when(_rules(fold(path), parts), F.array(*map(F.lit, kinds))).otherwise(none) for parts, kinds in FOLDER_KINDS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def kind_label(title: Column) -> Column:
    label = F.lit("")
    for parts, kind in reversed(KIND_LABELS):
        label = F.when(_rules(normalize_header(title), parts), kind).otherwise(label)
    return label


def is_listener(raw: Column) -> Column:
    """An event entry without an active role at its start."""
    n = F.regexp_replace(normalize_header(raw), "^\\s*(\\d{1,3}\\.\\s*)+", "")
    active = F.lit(False)
    for role in PRESENTATION_ROLES:
        active = active | F.startswith(n, F.lit(role))
    return F.startswith(n, F.lit("ouvinte")) | F.contains(n, F.lit("(ouvinte)")) | ~active


def is_junk(title: Column, venue: Column, owner_words: Column) -> Column:
    """Nothing that identifies the entry is left beside the owner's name, administrative words and numbers."""
    tokens = words(normalize(F.concat_ws(" ", title, venue)))
    return ~F.exists(tokens, lambda w: (F.length(w) >= 4) & ~w.isin(ADMIN_WORDS) & ~w.rlike("^\\p{N}+$") & ~F.array_contains(owner_words, w))


def norm_issn(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^\\p{N}X]", "")


def norm_title(text: Column) -> Column:
    """Journal title in upper case, of A-Z, 0-9 and single spaces alone."""
    kept = F.regexp_replace(F.upper(fold(text)), "[^A-Z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def journal_name(venue: Column) -> Column:
    """Venue up to its first volume, number or page mark; the mark may end a word, as it always has."""
    return strip(F.regexp_replace(venue, "(?is)[.,]?\\s*(v\\.|n\\.|p\\.|vol\\.|\\bv\\s*\\d).*$", ""))


def quad_key(year: Column) -> Column:
    """Evaluation period of a year; unknown years fall in the newest."""
    return F.when(year >= 2021, "2021_2024").when(year >= 2017, "2017_2020").when(year > 0, "2016_2019").otherwise("2021_2024")


def rank_color(rank: Column) -> Column:
    """Colour bucket of a rank, by its first two characters."""
    top = F.substring(F.upper(rank), 1, 2)
    return F.when(top.isin("A1", "A2"), "green").when(top.isin("A3", "A4"), "blue").when(F.startswith(top, F.lit("B")), "orange").otherwise("gray")


def clean_name(file_name: Column) -> Column:
    """A person's name from a file name: marks to spaces, known prefixes and numbers off, words capitalised."""
    base = F.trim(F.translate(F.regexp_replace(file_name, "\\.[^.]*$", ""), "_-", "  "))
    rest = F.trim(F.regexp_replace(base, "(?i)^(curriculo lattes |curriculo |lattes )", ""))
    return F.initcap(F.array_join(F.filter(F.split(rest, " "), lambda w: (w != "") & ~w.rlike("^\\p{N}+$")), " "))


def file_parts(path: Column) -> Column:
    """struct<name, stem, extension, is_pdf, is_image> of a path."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    return F.struct(
        name.alias("name"),
        F.regexp_replace(name, "\\.[^.]+$", "").alias("stem"),
        extension.alias("extension"),
        (extension == "pdf").alias("is_pdf"),
        extension.isin("jpg", "jpeg", "png", "tiff", "tif", "heic").alias("is_image"),
    )


def search_contains(text: Column, query: Column) -> Column:
    """Search that ignores case and accents; an empty query finds all."""
    return F.contains(normalize(text), normalize(query))


def percent(score: Column) -> Column:
    """Whole percents, cut off."""
    return (score * 100).cast("int")


def short_label(text: Column, most: int = 22) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 2), F.lit("…"))).otherwise(text)


# What names an institution, what a line that names one never has, work regimes glued to its end, and its abbreviation.
SCHOOLS, NO_SCHOOL = "universidade|instituto|faculdade|fundacao", "^\\d|portaria|lotado|outras informac|vinculo:|dedicac|regime|carga hor"
REGIME, ABBREVIATION = "\\s*(Integral|Parcial|Horista|Dedica[çc][ãa]o\\s*[Ee]xclusiva)\\s*$", "\\s*-\\s*[A-ZÀ-Ú]{2,10}$"


def is_institution(line: Column) -> Column:
    """The line of a professional record that names the institution of what follows."""
    n = normalize_header(line)
    return n.rlike(SCHOOLS) & ~n.rlike(NO_SCHOOL)


def institution_name(line: Column) -> Column:
    """Institution without the country and without a work regime glued to its end."""
    return strip(F.regexp_replace(F.regexp_replace(line, ", Brasil\\.?", ""), REGIME, ""))


def institution_key(name: Column) -> Column:
    """Grouping key of an institution: folded, without the abbreviation after a last dash."""
    return normalize_header(F.regexp_replace(name, ABBREVIATION, ""))
