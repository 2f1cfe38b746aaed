"""Licence scan through a positional index of rare words, with DataFrame functions only.

The document frequencies of all template words are counted over the whole corpus. For each template the
rarest word of its mandatory key phrase (highest IDF) is looked up first: a file without any of these words
has no match and its words are never listed. In the other files every template word has a posting list of
positions; shifted by the word's place in the key phrase, the lists of a phrase intersect exactly at its
starts. Each start that is found this way is a verified key phrase, and places the whole template on the file: the share
of template words that stand at their relative position is the coverage. Nothing is shuffled but the word counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE = 0.5


class Template(NamedTuple):
    label: str
    words: list[str]
    key_at: int
    key: list[str]


def template(label: str, text: str, key: str) -> Template:
    words, phrase = text.split(), key.split()
    at = next(n for n in range(len(words)) if words[n : n + len(phrase)] == phrase)
    return Template(label, words, at, phrase)


# Phrases and their labels.
BASE = [
    template("gpl", "gnu general public license", "gnu general public license"),
    template("apache", "apache license", "apache license"),
    template("cc-by", "cc by", "cc by"),
    template("mit", "mit license", "mit license"),
]
# Opening sentences of licences, and the phrase that each must have.
LONG = [
    template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
# Before lower-casing, capital letters belong to words too.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. The two other letters whose lower case has an ASCII letter are replaced by a letter that has none."""
    out = F.coalesce(text, F.lit(""))
    for letter in ("K", "İ"):
        out = F.replace(out, F.lit(letter), F.lit("ß"))
    return F.lower(out)


def document_frequencies(docs: DataFrame, text_col: str, templates: list[Template]) -> dict[str, int]:
    """In how many texts of ``docs`` each template word stands; one row for each template word comes to the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    pattern = f"(?<!{WORD})({'|'.join(vocabulary)})(?!{WORD})"
    found = F.array_distinct(F.regexp_extract_all(lowered(F.col(text_col)), F.lit(pattern), 1))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def _starts(spots: Column, key: list[str], by_rarity: dict[str, int]) -> Column:
    """Where the key phrase stands: posting lists shifted to the phrase's start and intersected, rarest first."""

    def shifted(n: int) -> Column:
        return F.transform(F.filter(spots, lambda s: s["word"] == key[n]), lambda s: s["at"] - n)

    order = sorted(range(len(key)), key=lambda n: (by_rarity[key[n]], n))
    out = shifted(order[0])
    for n in order[1:]:
        out = F.array_intersect(out, shifted(n))
    return out


def _coverage(words: Column, starts: Column, t: Template) -> Column:
    """Best share of the template's words that stand in their place, over all starts of its key phrase; 0 without one."""
    expected = [F.struct(F.lit(n - t.key_at).alias("at"), F.lit(w).alias("word")) for n, w in enumerate(t.words)]

    def share(start: Column) -> Column:
        right = F.filter(F.array(*expected), lambda e: F.get(words, start + e["at"]) == e["word"])
        return F.size(right) / F.lit(float(len(t.words)))

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[Template] = BASE, long: list[Template] = LONG,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """One row per row of ``docs``.

    doc_id; n_words; n_base, first_word and last_word (number of places of base phrases, their smallest and largest
    start; null without one); base_labels; labels (with those of the long templates whose coverage is ``min_coverage`` or
    more); score (best coverage, 1 for a base phrase, 0 without a match); places (label and start of each match).
    A null or empty text has no words. Rows that repeat give repeated results. Other columns are not read.
    """
    templates = [*base, *long]
    frequency = document_frequencies(docs, text_col, templates)
    rarest = sorted({min(t.key, key=lambda w: (frequency[w], w)) for t in templates})
    vocabulary = sorted({w for t in templates for w in t.key})
    text = lowered(F.col(text_col))
    has_rare = F.lit(False)
    for word in rarest:
        has_rare = has_rare | F.contains(F.col("text"), F.lit(word))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.regexp_count("text", F.lit(ANY_WORD)).cast("bigint").alias("n_words"),
        F.when(has_rare, F.regexp_extract_all("text", F.lit(f"({WORD}+)"), 1)).alias("words"),
    )
    placed = F.transform("words", lambda word, at: F.struct(word.alias("word"), at.alias("at")))
    rows = rows.withColumn("spots", F.filter(placed, lambda s: s["word"].isin(vocabulary)))
    found = {f"s{n}": F.coalesce(_starts(F.col("spots"), t.key, frequency), F.array().cast("array<int>")) for n, t in enumerate(templates)}
    rows = rows.select("doc_id", "n_words", "words", *(c.alias(name) for name, c in found.items()))
    rows = rows.select(
        "doc_id", "n_words", *found,
        *(_coverage(F.col("words"), F.col(f"s{n}"), t).alias(f"c{n}") for n, t in enumerate(templates)),
    )
    first_long = len(base)
    labels = [F.when(F.size(f"s{n}") > 0, F.lit(t.label)) for n, t in enumerate(base)]
    more = [F.when(F.col(f"c{n}") >= min_coverage, F.lit(t.label)) for n, t in enumerate(long, first_long)]
    every = F.concat(*(F.col(f"s{n}") for n in range(first_long)))
    places = F.concat(*(F.transform(f"s{n}", lambda s, label=t.label: F.struct(F.lit(label).alias("label"), s.alias("start"))) for n, t in enumerate(templates)))

    def joined(values: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*values)))), ",")

    return rows.select(
        "doc_id", "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        joined(labels).alias("base_labels"), joined([*labels, *more]).alias("labels"),
        F.greatest(*(F.col(f"c{n}") for n in range(len(templates)))).alias("score"),
        places.alias("places"),
    )
