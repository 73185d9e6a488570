"""Labels, captions, headings, paths and questions' references as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that captions, sections and labels are known by.
TABLE_WORDS = "таблица|табл\\.?|table"
FIGURE_WORDS = "рисунок|рис\\.?|figure|fig\\.?"
REFERENCE_STEMS = "источник|литератур|библиограф|reference"
STOP_WORDS = ["и", "в", "во", "на", "по", "за", "от", "до", "к", "с", "со", "при", "показатель", "показатели", "итого", "итог", "всего", "тыс", "млн", "млрд", "руб", "рублей", "р.", "ед", "ед.", "шт", "шт.", "чел", "чел.", "год", "годы", "гг", "г.", "гг.", "значение", "уровень", "динамика", "-", "—", "–"]
HEADING_WORDS = "введение|заключение|выводы|приложение|содержание|список|глава|раздел|introduction|conclusion|appendix|chapter|section"


def bare_label(raw: Column) -> Column:
    """A label's digits and dots: spaces and a leading letter go, a comma is a dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", ""), r"^\p{L}+", ""), ",", ".")


def caption_number(raw: Column) -> Column:
    """A label's number without any words or letters before it, with their dots and dashes; null without one."""
    t = F.regexp_replace(F.regexp_replace(F.translate(raw, " ", " "), r"^\s*(\p{L}+[\s.\-]*)+", ""), r"\s+", "")
    return F.nullif(F.replace(t, F.lit(","), F.lit(".")), F.lit(""))


def plain_label(raw: Column) -> Column:
    """The label as it is, without spaces, a comma as a dot; null as empty."""
    return F.replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", ""), F.lit(","), F.lit("."))


def closed_label(raw: Column) -> Column:
    """plain_label without closing dots and brackets."""
    return F.regexp_replace(plain_label(raw), r"[.)]+$", "")


def title_in(text: Column, words: str) -> Column:
    """struct(number, title) of the first caption of such words anywhere in a text; nulls without one."""
    pattern = rf"(?iU)(?:^|[^\p{{L}}])(?:{words})\s*(?:№\s*)?(\p{{L}}?\s*\d++(?:[.,]\d++)*+)\s*[-—–:.]\s*([^\n]+)"
    return F.struct(F.nullif(bare_label(F.regexp_extract(text, pattern, 1)), F.lit("")).alias("number"), F.nullif(F.trim(F.regexp_extract(text, pattern, 2)), F.lit("")).alias("title"))


def kept_label(raw: Column) -> Column:
    """The label with its letter, upper-case, without spaces and closing marks."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?U)\s+", ""), ",", "."), r"[.)]+$", ""))


def caption(text: Column) -> Column:
    """struct(kind, number, tail) of a caption at the start of a text; nulls without one."""
    pattern = rf"(?iUs)^\s*({TABLE_WORDS}|{FIGURE_WORDS})\s*(?:№\s*)?(\p{{L}}?\s*\d+(?:\s*[.,]\s*\d+)*)\s*(?:[-—–:.]\s*)?(.*)$"
    word = F.lower(F.regexp_extract(text, pattern, 1))
    kind = F.when(word.rlike("^таб|^table"), "table").when(word != "", "figure")
    tail = F.nullif(F.trim(F.regexp_extract(text, pattern, 3)), F.lit(""))
    return F.struct(kind.alias("kind"), F.nullif(bare_label(F.regexp_extract(text, pattern, 2)), F.lit("")).alias("number"), tail.alias("tail"))


def base_path(path: Column) -> Column:
    return F.substring_index(path, " [row ", 1)


def row_index(path: Column) -> Column:
    """k of a path that ends in [row k], else a number beyond all rows."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"\[row\s+(\d+)\]", 1), F.lit("")).cast("long"), F.lit(1_000_000_000))


def cells(line: Column, keep_empty: bool = False) -> Column:
    """Cells of a row by ' | ', else by tabs, else by two spaces; empty ones go unless kept."""
    parts = F.when(line.contains("|"), F.split(line, r"\s*\|\s*")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, r"\s{2,}"))
    parts = F.transform(parts, lambda c: F.trim(c))
    return parts if keep_empty else F.filter(parts, lambda c: c != "")


def folded_cells(parts: Column, most: int) -> Column:
    """At most `most` cells: what is beyond goes into the last one."""
    rest = F.array_join(F.slice(parts, F.lit(most), F.size(parts)), " / ")
    return F.when(F.size(parts) <= most, parts).otherwise(F.concat(F.slice(parts, 1, most - 1), F.array(rest)))


def measure_name(raw: Column) -> Column:
    """The key of a measure: lower-case words without stop words, at most eight."""
    t = F.regexp_replace(F.lower(F.trim(raw)), r"(?U)[^\w\s-]", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " "), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.array_join(F.slice(words, 1, 8), " ")


def plausible(name: Column) -> Column:
    return (name != "") & ~name.rlike(r"^[\d\s-]+$")


def is_heading(text: Column) -> Column:
    """3 to 300 characters without formula signs, and numbered in at most 25 words, or in capitals in at most 12 and no full stop, or begun by a known word in at most 20."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    numbered = t.rlike(r"(?U)^\d+(\.\d+)*\.?\s+\S") & (words <= 25)
    capitals = (t == F.upper(t)) & t.rlike(r"(?U)\p{Lu}") & (words <= 12) & ~t.endswith(".")
    known = t.rlike(rf"(?iU)^({HEADING_WORDS})\b") & (words <= 20)
    return F.length(t).between(3, 300) & ~t.rlike("[=÷×]") & (numbered | capitals | known)


def heading_level(text: Column) -> Column:
    number = F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def chunk_type(element_type: Column, path: Column, text: Column) -> Column:
    """The type given, else reference by its path, else what the text's tag says, else text."""
    tag = F.lower(F.regexp_extract(text, r"^\[([^\]]+)\]", 1))
    guessed = F.when(F.lower(path).rlike(REFERENCE_STEMS), "reference").when(tag.rlike("^таблиц|^table"), "table").when(tag.rlike("^рисун|^figure"), "figure").when(tag.rlike("^заголов|^heading"), "heading").otherwise("text")
    return F.coalesce(F.nullif(F.lower(F.trim(element_type)), F.lit("")), guessed)


def clean_for_context(text: Column) -> Column:
    """Without leading tags, row marks and sizes; one dash; cells joined by a dash; single spaces."""
    t = F.regexp_replace(text, r"^\[[^\]]*\]\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\[row\s+\d+\]", ""), r"\s*\(\d+×\d+\)", "")
    t = F.replace(F.translate(t, "–—", "--"), F.lit(" | "), F.lit(" — "))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def anchor_id(path: Column, page: Column, title: Column) -> Column:
    return F.concat(F.lit("anch-"), F.substring(F.sha1(F.concat_ws("|", path, F.concat(F.lit("p="), F.coalesce(page.cast("string"), F.lit(""))), F.concat(F.lit("t="), F.coalesce(title, F.lit(""))))), 1, 16))


def language_guess(text: Column) -> Column:
    return F.when(text.rlike("[A-Za-z]{3}") & ~text.rlike("[А-Яа-яЁё]{3}"), "en").otherwise("ru")


TABLE_FORMS, FIGURE_FORMS = r"таблиц\w*|табл\.?|table", r"рисун\w*|рис\.?|figure|fig\.?"
CHAPTER_FORMS = r"глав\w*|раздел\w*|chapters?|sections?"


def _dotted(numbers: Column) -> Column:
    return F.array_distinct(F.transform(numbers, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def table_numbers(text: Column) -> Column:
    """Numbers after a table word, normalised, each once, in order of appearance."""
    return _dotted(F.regexp_extract_all(F.lower(text), F.lit(rf"(?iU)(?:{TABLE_FORMS})\s*(?:№\s*)?(\d+(?:[.,]\d+)*)"), F.lit(1)))


def figure_numbers(text: Column) -> Column:
    return _dotted(F.regexp_extract_all(F.lower(text), F.lit(rf"(?iU)(?:{FIGURE_FORMS})\s*(?:№\s*)?(\d+(?:[.,]\d+)*)"), F.lit(1)))


def numbers_of(text: Column, forms: str) -> Column:
    """Numbers of such words in either order ('таблица 2.1' first, then '2.1 таблица', also 'во 2-й таблице'), each once."""
    t = F.lower(text)
    after = F.regexp_extract_all(t, F.lit(rf"(?iU)(?:{forms})\s*(?:№\s*)?(\d+(?:[.,]\d+)*)"), F.lit(1))
    before = F.regexp_extract_all(t, F.lit(rf"(?iU)(?<![\d.,])(\d+(?:[.,]\d+)*)(?:\s*-?\s*(?:й|я|е|ю|ой|ую|ом))?\s+(?:{forms})"), F.lit(1))
    return _dotted(F.concat(after, before))


def listed_numbers(text: Column, forms: str) -> Column:
    """Numbers after such a word, with all that an enumeration goes on with: 'таблицы 1.1, 1.2 и 1.3'."""
    number = r"\d+(?:\.\d+)*"
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"(?iU)(?:{forms})\s*(?:№\s*)?({number}(?:\s*(?:,|;|и|and)\s*{number})*)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(number), F.lit(0)))))


def bare_numbers(text: Column, forms: str, width: int = 40) -> Column:
    """Numbers with a dot that stand at most `width` characters behind such a word, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?iU)(?<=(?:{forms.replace("w*", "w{0,6}")})[^\n]{{1,{width}}})(?<![\d.])(\d+\.\d+)(?![\d.])"), F.lit(1)))


def object_references(text: Column) -> Column:
    """array of struct(kind, number) of the tables, figures and chapters that a text names, enumerations included."""
    of = lambda kind, forms: F.transform(listed_numbers(text, forms), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("number")))
    return F.concat(of("table", TABLE_FORMS), of("figure", FIGURE_FORMS), of("chapter", CHAPTER_FORMS))


def is_comparison(text: Column) -> Column:
    """Two objects or more, and a word for comparing."""
    return (F.size(object_references(text)) >= 2) & F.lower(text).rlike("сравн|сопостав|что общего|чем отличаются|общие и отличия|сходств|различи|динамик|тенденци|compare")


def version_key(number: Column) -> Column:
    return F.transform(F.split(number, r"\."), lambda x: x.cast("int"))
