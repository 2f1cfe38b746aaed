"""Code and sentiment columns: normalisation, splitting, annotation parsing, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import UNKNOWN
from .binding import bind
from .text import clean_text

# Cyrillic capitals that look like Latin ones, and the Latin letters they mean.
CYRILLIC_LOOKALIKES = "АВСЕКМНОРТХ"
LATIN_LOOKALIKES = "ABCEKMHOPTX"

# Spellings of the three sentiments.
SENTIMENT_ALIASES = {
    0: ("0", "0.0", "neutral", "нейтральная", "нейтральный", "нейтрально"),
    1: ("1", "1.0", "positive", "позитивная", "позитивный", "позитивно"),
    2: ("2", "2.0", "negative", "негативная", "негативный", "негативно"),
}
SENTIMENT_NAMES = ("нейтральная", "позитивная", "негативная")

# The four classes of the pair model. Class 0 means the code is absent,
# classes 1, 2 and 3 are sentiments 0, 1 and 2.
PAIR_CLASS_NAMES = ("absent", "neutral", "positive", "negative")

DESCRIPTION_FORMATS = ("v1", "v2")

_ANNOTATION_TYPE = "array<struct<code:string,sentiment:int>>"


def normalize_code(value: Column) -> Column:
    squeezed = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)[\s\x1c-\x1f]+", "")
    return F.translate(F.upper(squeezed), CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES)


def split_items(value: Column) -> Column:
    """Non-blank items between ``, ;`` and line ends, each stripped; ``null`` gives no items."""
    parts = F.split(F.coalesce(value.cast("string"), F.lit("")), r"[;,\n\r]+")
    return F.filter(F.transform(parts, clean_text), lambda x: x != "")


def split_codes(value: Column) -> Column:
    codes = F.transform(split_items(value), normalize_code)
    return F.array_distinct(F.filter(codes, lambda x: x != ""))


def drop_unknown(codes: Column) -> Column:
    return F.filter(codes, lambda x: x != UNKNOWN)


def parent_code(code: Column) -> Column:
    norm = normalize_code(code)
    letters = F.regexp_extract(norm, "^([A-Z]+)", 1)
    return F.when(letters == "", norm).otherwise(letters)


def _alias_map() -> Column:
    cells: list[Column] = []
    for sentiment, spellings in SENTIMENT_ALIASES.items():
        for spelling in spellings:
            cells += [F.lit(spelling), F.lit(sentiment)]
    return F.create_map(*cells)


def sentiment_names() -> Column:
    cells: list[Column] = []
    for sentiment, name in enumerate(SENTIMENT_NAMES):
        cells += [F.lit(sentiment), F.lit(name)]
    return F.create_map(*cells)


def parse_sentiment(value: Column) -> Column:
    """0, 1 or 2; null for any other spelling."""
    return F.try_element_at(_alias_map(), F.lower(clean_text(value)))


def _pair(code: Column, sentiment: Column) -> Column:
    return F.struct(code.alias("code"), sentiment.cast("int").alias("sentiment"))


def _empty_annotations() -> Column:
    return F.array().cast(_ANNOTATION_TYPE)


def _read_pairs(items: Column, labels: Column) -> Column:
    """``(code, sentiment, labelled)`` per item other than UNKNOWN: aligned with labels, or inline."""
    pattern = r"^([^\n]+?)\s*[:=|]\s*([^:=|]+?)\s*$"

    def entry(code: Column, label: Column, labelled: Column) -> Column:
        sentiment = parse_sentiment(label).cast("int")
        return F.struct(code.alias("code"), sentiment.alias("sentiment"), labelled.alias("labelled"))

    known = drop_unknown(F.transform(items, normalize_code))
    aligned = F.zip_with(known, labels, lambda code, label: entry(code, label, F.lit(True)))
    inline = F.transform(
        F.filter(items, lambda x: normalize_code(x) != UNKNOWN),
        lambda x: entry(normalize_code(F.regexp_extract(x, pattern, 1)), F.regexp_extract(x, pattern, 2), x.rlike(pattern)),
    )
    return F.when(F.size(labels) > 0, aligned).otherwise(inline)


def parse_annotations(codes: Column, sentiments: Column | None = None) -> Column:
    """One sentiment per code, from two aligned lists or from inline labels such as ``A1:2``.

    Returns ``struct(annotations, status)``; the status is ``ok`` or the first fault met.
    """
    labels = split_items(sentiments) if sentiments is not None else F.array().cast("array<string>")

    def judge(items: Column, labels: Column, n_known: Column, pairs: Column, unique: Column) -> Column:
        first_fault = F.try_element_at(F.filter(pairs, lambda p: p["sentiment"].isNull()), F.lit(1))
        n_codes = F.size(F.array_distinct(F.transform(unique, lambda p: p["code"])))
        status = (
            F.when(n_known == 0, "ok")
            .when((F.size(labels) > 0) & (n_known != F.size(labels)), "count_mismatch")
            .when(first_fault.isNotNull(), F.when(first_fault["labelled"], "bad_sentiment").otherwise("missing_sentiment"))
            .when(F.exists(pairs, lambda p: p["code"] == ""), "empty_code")
            .when(n_codes < F.size(unique), "conflict")
            .otherwise("ok")
        )
        return bind(status, lambda st: F.struct(
            F.when((n_known > 0) & (st == "ok"), F.transform(unique, lambda p: _pair(p["code"], p["sentiment"])))
            .otherwise(_empty_annotations()).alias("annotations"),
            st.alias("status"),
        ))

    return bind(split_items(codes), lambda items: bind(labels, lambda ls: bind(
        F.size(drop_unknown(F.transform(items, normalize_code))), lambda n: bind(
            _read_pairs(items, ls), lambda pairs: bind(
                F.array_distinct(pairs), lambda unique: judge(items, ls, n, pairs, unique))))))


def parse_code_sentiments(value: Column) -> Column:
    """Inline labels where one code may carry several sentiments; digits 0, 1, 2 only.

    Returns ``struct(labels, status)`` with status ``ok`` or ``bad_label``.
    """
    pattern = r"^([^\n]+?)\s*[:=|]\s*([012])\s*$"

    def read(items: Column) -> Column:
        bad = F.exists(items, lambda x: ~x.rlike(pattern))
        pairs = F.transform(
            items,
            lambda x: _pair(
                normalize_code(F.regexp_extract(x, pattern, 1)), F.regexp_extract(x, pattern, 2).try_cast("int")
            ),
        )
        labels = F.when(bad, _empty_annotations()).otherwise(F.array_distinct(pairs))
        return F.struct(labels.alias("labels"), F.when(bad, "bad_label").otherwise("ok").alias("status"))

    return bind(F.filter(split_items(value), lambda x: normalize_code(x) != UNKNOWN), read)


def pair_text(pair: Column) -> Column:
    return F.concat(pair["code"], F.lit(":"), pair["sentiment"].cast("string"))


def or_unknown(text: Column) -> Column:
    return F.when(text == "", UNKNOWN).otherwise(text)


def annotations_to_text(annotations: Column) -> tuple[Column, Column, Column]:
    """``codes``, ``sentiments`` and ``code_sentiments`` texts; no annotation gives UNKNOWN, '', UNKNOWN."""
    codes = F.array_join(F.transform(annotations, lambda p: p["code"]), ", ")
    sentiments = F.array_join(F.transform(annotations, lambda p: p["sentiment"].cast("string")), ", ")
    both = F.array_join(F.transform(annotations, pair_text), ", ")
    return or_unknown(codes).alias("codes"), sentiments.alias("sentiments"), or_unknown(both).alias("code_sentiments")


def code_description(code: Column, parent_name: Column, name: Column, fmt: str = "v2") -> Column:
    if fmt not in DESCRIPTION_FORMATS:
        raise ValueError(f"Unsupported code description format {fmt!r}; expected one of {DESCRIPTION_FORMATS}.")
    body = F.concat(F.lit("Категория: "), parent_name, F.lit(". Подкатегория: "), name)
    return body if fmt == "v2" else F.concat(code, F.lit(". "), body)


def sentiment_of_class(pair_class: Column) -> Column:
    """Classes 1, 2, 3 are sentiments 0, 1, 2; class 0 (absent) has none."""
    return F.when(pair_class > 0, pair_class - 1)


def class_of_sentiment(sentiment: Column) -> Column:
    return F.coalesce(sentiment + 1, F.lit(0))
