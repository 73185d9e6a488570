"""Numbers in text as Column expressions: two parsers, tolerances, kinds, scales and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Spaces that separate thousands, words for scales, kinds of a column by its header.
SPACES = "   "
MULTIPLIERS = [(r"\b(тыс|k)\b\.?", 1e3), (r"\b(млн|mln|m)\b\.?", 1e6), (r"\b(млрд|bn|b)\b\.?", 1e9)]
KINDS = [
    ("percent", ["%", "процент", "темп", "рост", "прирост"]),
    ("count", ["шт", "ед", "чел", "человек", "кол-во", "количество", "единиц"]),
    ("money", ["руб", "тыс", "млн", "млрд", "стоим", "выруч", "доход", "расход", "затрат", "прибыл", "себестоим"]),
    ("ratio", ["коэфф", "показат", "удельн", "на 1", "на 1 руб", "на рубль", "рентаб"]),
]
# Each unit with the ways it is written.
UNITS = {
    "%": ["%", "percent", "perc", "pct", "проц", "процент"],
    "‰": ["‰", "permil", "per mille", "промилле"],
    "п.п.": ["pp", "п.п.", "пп"],
    "шт": ["pcs", "шт", "шт.", "штук", "ед", "units", "unit"],
    "₽": ["rub", "₽", "руб", "руб.", "р", "р."],
    "€": ["eur", "€", "евро"],
    "$": ["usd", "$", "доллар", "долл."],
    "тыс.": ["тыс", "тыс.", "k"],
    "млн": ["млн", "млн.", "mln", "m"],
}
PERCENT, PERMILLE, POINTS, CURRENCY = r"%", "‰", r"(?iU)п\.?\s?п\.?|\bpp\b", r"(?i)руб\.?|₽|\$|€|usd|eur|rub"


def spaced(text: Column) -> Column:
    """No-break and thin spaces as spaces, trimmed; null as empty."""
    return F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, "   "))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(spaced(text), r"(?U)\s+", " "))


def plain_number(text: Column) -> Column:
    """The first number of a text; brackets around all of it negate; of one separator the last is decimal; null without digits."""
    t = spaced(text)
    inner = F.regexp_extract(t, r"^\((.*)\)$", 1)
    body = F.when(t.rlike(r"^\(.*\)$"), inner).otherwise(t)
    run = F.regexp_extract(body, r"[+-]?\s*(?:(?:\d+[ ']?)*\d(?:[.,]\d+)?|[.,]\d+)", 0)
    value = F.regexp_replace(F.regexp_replace(run, r"[ ']", ""), ",", ".").try_cast("double")
    return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)


def with_unit(text: Column) -> Column:
    """struct(value, unit, had_unit): multipliers applied, percent as a share; null value without a number."""
    t = F.regexp_replace(spaced(text), CURRENCY, "")
    factor = F.lit(1.0)
    for pattern, k in reversed(MULTIPLIERS):
        factor = F.when(t.rlike("(?iU)" + pattern), k).otherwise(factor)
    bare = reduce(lambda x, m: F.regexp_replace(x, "(?iU)" + m[0], ""), MULTIPLIERS, t)
    number = plain_number(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, PERCENT, ""), PERMILLE, ""), POINTS, "")) * factor
    unit = F.when(t.contains("%"), "%").when(t.contains("‰"), "permille").when(t.rlike(POINTS), "pp").otherwise("")
    unit = F.when(number.isNull(), "").otherwise(unit)
    return F.struct(F.when(unit == "%", number / 100).otherwise(number).alias("value"), unit.alias("unit"), (unit != "").alias("had_unit"))


TOKEN = r"(?iU)([-−]?)((?:\d{1,3}(?:[  ]\d{3})+|\d+(?:[.,]\d+)?))\s*(тыс|млн|миллион|млрд|миллиард)?"


def all_numbers(text: Column) -> Column:
    """All numbers of a text in order, signs and scale words applied: array<double>."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def value(token: Column) -> Column:
        t = F.lower(token)
        digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"\d[\d  .,]*", 0), "[  ]", ""), ",", ".")
        scale = F.when(t.contains("млрд") | t.contains("миллиард"), 1e9).when(t.contains("млн") | t.contains("миллион"), 1e6).when(t.contains("тыс"), 1e3).otherwise(1.0)
        return F.when(t.rlike("^[-−]"), -1.0).otherwise(1.0) * scale * digits.try_cast("double")

    return F.filter(F.transform(found, value), lambda x: x.isNotNull())


def cell_number(cell: Column) -> Column:
    """The first number of a cell without a percent sign, else null."""
    return F.when(~cell.contains("%"), F.get(all_numbers(cell), 0))


def close(a: Column, b: Column, rel, tolerance) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) if isinstance(tolerance, float) else tolerance, rel * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))


def adaptive_close(expected: Column, given: Column, kind: Column, quality: Column) -> Column:
    """Whether two numbers agree under the tolerance of their kind, widened for low and mid recognition quality."""
    size = F.greatest(F.abs(expected), F.abs(given))
    money = F.when(size >= 1e6, 2000.0).when(size >= 1e5, 200.0).when(size >= 1e4, 20.0).when(size >= 1e3, 5.0).otherwise(1.0)
    rel = F.when(kind.isin("percent", "ratio"), 0.03).when(kind == "count", 0.01).otherwise(0.02)
    tolerance = F.when(kind == "percent", 1.2).when(kind == "count", 1.0).when(kind == "money", money).when(kind == "ratio", 0.02).otherwise(0.8)
    wide = lambda low, mid: F.when(F.lower(quality) == "low", low).when(F.lower(quality) == "mid", mid).otherwise(1.0)
    return F.coalesce(close(expected, given, rel * wide(1.8, 1.3), tolerance * wide(2.5, 1.6)), F.lit(False))


def cross_close(expected: Column, given: Column, scale: Column, quality: Column) -> Column:
    """Agreement of the same money value in two tables."""
    wide = lambda low, mid: F.when(quality == "low", low).when(quality == "mid", mid).otherwise(1.0)
    return close(expected, given, 0.005 * wide(1.6, 1.3), F.greatest(F.lit(2000.0), 2.0 * scale) * wide(2.0, 1.6))


def kind_of(header: Column) -> Column:
    h = F.lower(F.coalesce(header, F.lit("")))
    found = F.lit("unknown")
    for kind, stems in reversed(KINDS):
        found = F.when(reduce(lambda a, b: a | b, [h.contains(s) for s in stems]), kind).otherwise(found)
    return found


def scale_of(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("млрд"), 1e9).when(t.contains("млн"), 1e6).when(t.contains("тыс"), 1e3).otherwise(1.0)


def unit_of(text: Column) -> Column:
    """The canonical unit, else the text, trimmed and lower-cased; null as empty."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    table = F.create_map(*[F.lit(x) for unit, ways in UNITS.items() for way in ways for x in (way, unit)])
    return F.coalesce(F.element_at(table, t), t)


def decimal_of(text: Column) -> Column:
    """A text that is a single number, with spaces, a percent sign or a decimal comma, as a decimal; else null."""
    t = F.replace(F.regexp_replace(spaced(text), r"(?U)[\s%]+", ""), F.lit(","), F.lit("."))
    return F.when(t != "", t.try_cast("decimal(38,18)"))


def is_year(x: Column) -> Column:
    """Whether a number, rounded to even, is a year from 1900 to 2100."""
    return F.rint(x).between(1900, 2100)


def is_small_index(x: Column) -> Column:
    return F.abs(x) <= 200


#: Ways to get a column from two others; a null where a denominator is near 0.
OPERATIONS = ["add", "sub", "rsub", "mul", "div", "rdiv", "pct", "rpct", "pctchg", "rpctchg"]


def predicted(op: Column, a: Column, b: Column) -> Column:
    over = lambda x, y: F.when(F.abs(y) >= 1e-12, F.try_divide(x, y))
    return (
        F.when(op == "add", a + b).when(op == "sub", a - b).when(op == "rsub", b - a).when(op == "mul", a * b).when(op == "div", over(a, b)).when(op == "rdiv", over(b, a))
        .when(op == "pct", over(a, b) * 100).when(op == "rpct", over(b, a) * 100).when(op == "pctchg", over(a, b) * 100 - 100).when(op == "rpctchg", over(b, a) * 100 - 100)
    )


def formatted(x: Column, percent: bool = False, lang: str = "ru") -> Column:
    """Two decimals with grouped thousands, by language; percent ×100 with its sign."""
    t = F.format_number(x * 100 if percent else x, 2)
    t = F.translate(t, ",.", " ,") if lang == "ru" else t
    return F.concat(t, F.lit("%")) if percent else t


def tidy(text: Column) -> Column:
    """Numbers in prose made plain: grouped digits joined, decimal commas as points, no space before %, one dash."""
    t = F.regexp_replace(text, r"(?<=\d)[  ](?=\d{3}(?!\d))", "")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d)", ".")
    return F.regexp_replace(F.regexp_replace(t, r"\s+%", "%"), "--|–", "—")
