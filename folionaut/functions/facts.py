"""Labelled facts (prices, percentages, numbers, dates) found in a text column.

Three patterns cover all facts: labelled values, numeric dates and dates with a month name. Labelled
values of different labels never overlap, so one scan finds them all; dates of the two forms may. One
``regexp_replace`` marks a text's matches and ``split`` cuts it there, so spans follow from one running
sum. Each match becomes a row before anything is read from it: lambda bodies are interpreted, columns of
rows are compiled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.text import let

# System fields, their types and aliases.
FIELDS = {
    "price": ("currency", ["cost"]),
    "amount": ("currency", []),
    "total": ("currency", []),
    "discount_percent": ("percentage", ["discount"]),
    "tax_percent": ("percentage", ["tax"]),
    "rating": ("number", []),
    "score": ("number", []),
    "rank": ("number", []),
    "count": ("number", []),
    "quantity": ("number", []),
    "version": ("number", []),
    "weight": ("number", []),
    "length": ("number", []),
    "date": ("date", []),
    "published_date": ("date", []),
    "event_date": ("date", []),
    "created_date": ("date", []),
    "updated_date": ("date", []),
}

# Currency symbols, measuring units, month names and date labels.
CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY"}
UNITS = {"weight": "kg|g|lb|oz", "length": "mm|cm|km|m|in|ft"}
MONTHS = (
    "January February March April May June July August September October November December"
).split()
DATE_LABEL = r"(?iU)(?=[pecu])\b(published|event|created|updated)\s*(?:date)?\s*[:=]?\s*\z"
DATE_LABEL_WINDOW = 40

CURRENCY_FIELDS = {"price": "price", "cost": "price", "amount": "amount", "total": "total"}
PERCENT_FIELDS = {"discount": "discount_percent", "tax": "tax_percent"}
NUMBER_FIELDS = {name: name for name in ("rating", "score", "rank", "count", "quantity", "version", "weight", "length")}
LABELS = CURRENCY_FIELDS | PERCENT_FIELDS | NUMBER_FIELDS

# How a value may follow its label.
AMOUNT = r"\s*[:=]?\s*[€$£¥]?\s*(?:[0-9][0-9.,]*[0-9]|[0-9])\s*(?:EUR|USD|GBP|JPY|€|\$|£|¥)?"
PERCENT = r"\s*[:=]?\s*\d+(?:[.,]\d+)?\s*%"
NUMBER = r"\s*[:=]?\s*[#v]?\d+(?:[.,]\d+)*"
# A number without a unit takes the white space after it, unless a multiplication sign would follow.
AFTER_NUMBER = r"(?:\s*(?!x))?"


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _letters(place: int) -> str:
    return "[" + "".join(sorted({label[place] for label in LABELS})) + "]"


# Word boundaries are costly, so each pattern first looks at the characters that could begin a match.
LABELLED = (
    rf"(?iU)(?={_letters(0)}{_letters(1)})\b(?:"
    + "|".join(
        [_any(CURRENCY_FIELDS) + AMOUNT, _any(PERCENT_FIELDS) + PERCENT]
        + [rf"{label}{NUMBER}(?:\s*(?:{units})\b)?" for label, units in UNITS.items()]
        + [_any(name for name in NUMBER_FIELDS if name not in UNITS) + NUMBER + AFTER_NUMBER]
    )
    + ")"
)
NUMERIC_DATE = r"(?U)(?=\d{4}[-/])\b(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})\b"
NAMED_DATE = r"(?U)(?=\d{1,2} [A-Z]|[A-Z][a-z])\b(?:\d{1,2} [A-Z][a-z]+ \d{4}|[A-Z][a-z]+ \d{1,2},? \d{4})\b"

# Order of facts in a text: by field, then by place. Fields 1-3 are currencies, 4-5 percentages.
FIELD_ORDER = list(dict.fromkeys(LABELS.values()))


def _plain(raw: Column, locale: str) -> Column:
    """A number of the locale with a decimal point and nothing else between its digits."""
    if locale.lower().startswith(("de", "hu")):
        return F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.replace(raw, F.lit(","), F.lit(""))


def _number(plain: Column) -> Column:
    """Null when it is not one number. A second point ends it here, since a failing cast costs an exception."""
    return F.when(F.substring_index(plain, ".", 2) == plain, plain.try_cast("double"))


def parse_number(raw: Column, locale: str = "en") -> Column:
    """A number in the written form of the locale; null when it is not one number."""
    return let(_plain(raw, locale), _number)


# Control characters put before and behind a match, and one of the same length to stand for them in the text.
BEFORE, BEHIND, OTHER = "\x01", "\x03", "\x02"

# The kinds of spans: labelled values, numeric dates, dates with a month name.
LABELLED_KIND, NUMERIC_KIND, NAMED_KIND = range(3)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before each match: what is ahead of the first one, then each match, ``BEHIND`` and what follows."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{BEFORE}$0{BEHIND}")), BEFORE, -1)


def _starts(pieces: Column) -> Column:
    """Where the match of each piece starts, in code points from zero. The first piece has none."""
    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        return F.struct((state["at"] + F.length(piece) - 1).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    return F.aggregate(pieces, first, step, lambda state: state["out"])


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _group(match: Column, pattern: str, group: int = 1) -> Column:
    """A group of a match, empty when it takes no part."""
    return F.regexp_extract(match, pattern, group)


def _match(piece: Column) -> Column:
    return F.substring_index(piece, BEHIND, 1)


def _order(kind: Column, match: Column) -> Column:
    """Where a fact stands among those of its text: by field, dates last."""
    places = {label: FIELD_ORDER.index(field) + 1 for label, field in LABELS.items()}
    return (
        F.when(kind == LABELLED_KIND, _lookup(places, F.regexp_extract(F.lower(F.upper(match)), "^[a-z]+", 0)))
        .when(kind == NUMERIC_KIND, F.when(F.contains(match, F.lit("-")), 101).otherwise(102))
        .otherwise(F.when(match.rlike(r"^(?U)\d"), 103).otherwise(104))
    )


def _digits(match: Column, locale: str) -> Column:
    return _plain(_group(match, r"(?U)\d(?:.*\d)?", 0), locale)


def _iso(kind: Column, match: Column) -> Column:
    """yyyy-MM-dd of a date, which need not be a day of the calendar."""
    day, year = _group(match, r"(?U)\b\d{1,2}\b", 0), _group(match, r"(?U)\d{4}", 0)
    month = _lookup({name: f"{n:02d}" for n, name in enumerate(MONTHS, 1)}, F.regexp_extract(match, "[A-Z][a-z]+", 0))
    return F.when(kind == NUMERIC_KIND, F.translate(match, "/", "-")).when(
        kind == NAMED_KIND, F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"))
    )


def _day(iso: Column) -> Column:
    return F.when(~F.startswith(iso, F.lit("0000")), iso.try_cast("date"))


def _ranks(kinds: list[Column], locale: str) -> Column:
    """For each kind and piece the place among the valid facts of the text; costly, and left out by Spark where it isn't asked for."""

    def keys(kind: int) -> Column:
        def key(span: Column, n: Column) -> Column:
            match = _match(span["piece"])
            valid = (let(_digits(match, locale), _number) if kind == LABELLED_KIND else let(_iso(F.lit(kind), match), _day)).isNotNull()
            return F.struct((~valid).alias("no"), _order(F.lit(kind), match).alias("order"), span["start"].alias("start"), F.lit(kind).alias("kind"), n.alias("n"))

        found = F.filter(F.transform(kinds[kind], key), lambda k: k["n"] > 0)
        return F.coalesce(found, F.array().cast("array<struct<no:boolean,order:int,start:int,kind:int,n:int>>"))

    placed = F.transform(F.sort_array(F.concat(*map(keys, range(len(kinds))))), lambda k, rank: F.struct(k["kind"], k["n"], rank.alias("rank")))
    return let(F.sort_array(placed), lambda ranks: F.array(*[
        F.transform(F.filter(ranks, lambda r: r["kind"] == kind), lambda r: r["rank"]) for kind in range(len(kinds))  # noqa: B023
    ]))


def extract_facts(rows: DataFrame, text: str = "text", locale: str = "en") -> DataFrame:
    """One row per fact: the input columns (but for the text) and the fact's columns."""
    keep = [c for c in rows.columns if c != text]
    # Substring tests keep most texts away from the patterns.
    folded = rows.select(*keep, F.col(text).alias("_text"), F.lower(F.upper(text)).alias("_folded"))
    labelled = reduce(lambda a, b: a | b, [F.contains("_folded", F.lit(word)) for word in LABELS])
    strange = F.contains("_text", F.lit(BEFORE)) | F.contains("_text", F.lit(BEHIND))
    unmarked = F.when(strange, F.translate("_text", BEFORE + BEHIND, OTHER * 2)).otherwise(F.col("_text"))
    tested = folded.select(*keep, unmarked.alias("_text"), labelled.alias("_labelled"), F.col("_text").rlike(r"(?U)\d{4}").alias("_dated"))
    parts = tested.select(
        *keep, "_text",
        *[
            F.when(F.col(possible), _pieces(F.col("_text"), pattern)).alias(f"_pieces{kind}")
            for kind, (possible, pattern) in enumerate((("_labelled", LABELLED), ("_dated", NUMERIC_DATE), ("_dated", NAMED_DATE)))
        ],
    )
    spans = [
        F.arrays_zip(F.col(f"_pieces{kind}").alias("piece"), _starts(F.col(f"_pieces{kind}")).alias("start")).alias(f"_spans{kind}")
        for kind in range(3)
    ]
    cut = parts.select(*keep, "_text", *spans)
    kinds = [F.col(f"_spans{kind}") for kind in range(3)]
    ranked = cut.select(*keep, "_text", F.array(*kinds).alias("_kinds"), _ranks(kinds, locale).alias("_ranks"))
    # "outer" keeps Spark from testing the arrays first, for which it would read each text twice.
    each = ranked.select(*keep, "_text", "_ranks", F.posexplode_outer("_kinds").alias("_kind", "_spans"))
    every = each.select(*keep, "_text", "_ranks", "_kind", F.posexplode_outer("_spans").alias("_n", "_span")).filter("_n > 0")
    kind, match, start = F.col("_kind"), F.col("_match"), F.col("_start")
    matched = every.select(*keep, "_text", "_ranks", "_kind", "_n", _match(F.col("_span.piece")).alias("_match"), F.col("_span.start").alias("_start"))
    read = matched.select(
        *matched.columns, _order(kind, match).cast("int").alias("_order"), _iso(kind, match).alias("_iso"),
        F.when(kind == LABELLED_KIND, _digits(match, locale)).alias("_plain"),
    )
    # A filter isn't pushed below a generator, so values are read once.
    values = F.struct(_number(F.col("_plain")).alias("_number"), F.when(_day(F.col("_iso")).isNotNull(), F.col("_iso")).alias("_date"))
    valued = read.select(*matched.columns, "_order", F.inline_outer(F.array(values)))
    valid = valued.filter(F.col("_number").isNotNull() | F.col("_date").isNotNull())

    order, number = F.col("_order"), F.col("_number")
    window = F.col("_text").substr(F.greatest(start - DATE_LABEL_WINDOW, F.lit(0)) + 1, F.least(start, F.lit(DATE_LABEL_WINDOW)))
    symbol, code = _group(match, r"(?U)([€$£¥])\s*\d"), _group(match, r"(?iU)\d\s*(EUR|USD|GBP|JPY|€|\$|£|¥)\z")
    measured = [FIELD_ORDER.index(name) + 1 for name in UNITS]
    named = valid.select(
        *valid.columns, F.when(kind != LABELLED_KIND, F.lower(_group(window, DATE_LABEL))).alias("_label"),
        F.when(order < 4, symbol).alias("_symbol"), F.when(order < 4, code).alias("_code"),
        F.when(order.isin(measured), _group(match, r"(?iU)\d\s*([a-z]+)\z")).alias("_unit"),
    )
    label, code, unit = F.col("_label"), F.col("_code"), F.col("_unit")
    value_type = F.when(order < 4, "currency").when(order < 6, "percentage").when(order < 100, "number").otherwise("date")
    return named.select(
        *keep,
        F.get(F.get("_ranks", kind), F.col("_n") - 1).alias("fact_order"),
        F.when(kind == LABELLED_KIND, F.get(F.array(*[F.lit(name) for name in FIELD_ORDER]), order - 1))
        .otherwise(F.when(label != "", F.concat(label, F.lit("_date"))).otherwise("date")).alias("field"),
        F.regexp_replace(match, r"(?U)\s+\z", "").alias("raw_value"),
        number.alias("normalized_number"),
        F.concat("_date", F.lit("T00:00:00Z")).alias("normalized_date_utc"),
        F.coalesce(
            _lookup(CURRENCY_SYMBOLS, F.col("_symbol")), _lookup(CURRENCY_SYMBOLS, code), F.when(code != "", F.upper(code))
        ).alias("currency_code"),
        F.when(order.between(4, 5), (number / 100).cast("string")).when(unit != "", unit).alias("unit"),
        start.alias("char_start"),
        (start + F.length(match)).alias("char_end"),
        value_type.alias("value_type"),
        F.when(value_type == "date", 1.0).when(value_type == "number", 0.85).otherwise(0.9).alias("confidence"),
    )
