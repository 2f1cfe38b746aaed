"""Labelled responses: loading rules, filters, reports, wide and long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import drop_unknown, parent_code, parse_annotations, split_codes
from ..functions.text import clean_text, combine_text
from ..settings import MAX_LITERAL_CODES, UNKNOWN, collect_bounded


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}. Existing columns: {df.columns}")
    return df


def require_rows(df: DataFrame, message: str = "No usable responses remain.") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def parse_responses(
    df: DataFrame, text_col: str, codes_col: str, context_col: str | None = None, row_id: str = "row_id"
) -> DataFrame:
    """Wide form ``(row_id, text, answer, context, codes)`` with UNKNOWN already removed from codes."""
    require_columns(df, [c for c in (row_id, text_col, codes_col, context_col) if c])
    context = F.col(context_col) if context_col else None
    return df.select(
        F.col(row_id).alias("row_id"),
        combine_text(F.col(text_col), context).alias("text"),
        clean_text(F.col(text_col)).alias("answer"),
        (clean_text(context) if context is not None else F.lit("")).alias("context"),
        drop_unknown(split_codes(F.col(codes_col))).alias("codes"),
    )


def usable_rows(df: DataFrame, keep_unlabelled: bool = False) -> DataFrame:
    """Non-empty answers; unlabelled rows go too unless the pair model keeps them as all-absent."""
    kept = df.where(F.col("answer") != "")
    return kept if keep_unlabelled else kept.where(F.size("codes") > 0)


def explode_codes(df: DataFrame) -> DataFrame:
    """Long form: one row per (response, code) with the position of the code in its list.

    The outer form with a filter behind it parses the codes once; the inner one would let the
    planner push a filter on the list below, and parse them again for it.
    """
    return df.select("*", F.posexplode_outer("codes").alias("pos", "code")).where(F.col("code").isNotNull())


def rows_with_known_codes(df: DataFrame, codebook: DataFrame) -> DataFrame:
    """Rows all of whose codes are in the codebook, a literal of checked size: a test in the row."""
    known = F.array(*[F.lit(r["code"]) for r in collect_bounded(codebook.select("code"), MAX_LITERAL_CODES, "The codebook")]).cast("array<string>")
    return df.where(F.size(F.array_except("codes", known)) == 0)


def parse_annotated(
    df: DataFrame,
    text_col: str,
    codes_col: str,
    sentiments_col: str | None = None,
    context_col: str | None = None,
    prefix: str | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """Responses with one sentiment per code, and the parse status of each row."""
    sentiments = F.col(sentiments_col) if sentiments_col else None
    context = F.col(context_col) if context_col else None
    parsed = parse_annotations(F.col(codes_col), sentiments)
    return df.select(
        F.col(row_id).alias("row_id"),
        combine_text(F.col(text_col), context, prefix).alias("text"),
        clean_text(F.col(text_col)).alias("answer"),
        (clean_text(context) if context is not None else F.lit("")).alias("context"),
        parsed.alias("parsed"),
    ).select("row_id", "text", "answer", "context", "parsed.annotations", "parsed.status")


def usable_annotated(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """Rows to train the pair model on: non-empty, no conflict. Other faults are errors when strict."""
    if strict:
        fault = parsed.where((F.col("answer") != "") & ~F.col("status").isin("ok", "conflict"))
        first = fault.select("row_id", "status").limit(1).collect()
        if first:
            raise ValueError(f"Line {first[0]['row_id'] + 2} cannot be used: its annotation is {first[0]['status']}.")
    kept = parsed.where((F.col("answer") != "") & (F.col("status") == "ok"))
    return kept.withColumn("codes", F.transform("annotations", lambda a: a["code"]))


def load_report(parsed: DataFrame) -> DataFrame:
    """Counts of loaded and skipped rows, one row. The skipped source rows are in ``conflict_rows``."""
    filled = F.col("answer") != ""
    return parsed.agg(
        F.count("*").alias("input_rows"),
        F.count_if(filled & (F.col("status") == "ok")).alias("loaded_rows"),
        F.count_if(~filled).alias("empty_text_rows"),
        F.count_if(filled & (F.col("status") == "conflict")).alias("skipped_conflicting_sentiment_rows"),
    )


def conflict_rows(parsed: DataFrame) -> DataFrame:
    """Source lines (position + 2) of the rows skipped for conflicting sentiments.

    A table and not one list: their number grows with the data.
    """
    skipped = parsed.where((F.col("answer") != "") & (F.col("status") == "conflict"))
    return skipped.select((F.col("row_id") + 2).alias("source_row"))


def response_groups(long: DataFrame) -> DataFrame:
    """Back to one row per response: first text, ordered unique codes, stratum = first code."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "code")))
    grouped = long.groupBy("row_id").agg(F.min_by("text", "pos").alias("text"), entries.alias("entries"))
    codes = F.array_distinct(F.transform("entries", lambda e: e["code"]))
    return grouped.select("row_id", "text", codes.alias("codes")).withColumn(
        "stratum", F.coalesce(F.try_element_at("codes", F.lit(1)), F.lit("__empty__"))
    )


def single_label(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with exactly one code: from the code list where there is one, else by counting per row_id."""
    if "codes" in df.columns:
        kept = df.where(F.size("codes") == 1)
    elif {"row_id", "code"} <= set(df.columns):
        one = df.groupBy("row_id").agg(F.count_distinct("code").alias("_n")).where(F.col("_n") == 1)
        kept = df.join(one.select("row_id"), "row_id", "left_semi")
    else:
        raise ValueError("The single-label filter needs a column codes, or row_id and code.")
    return require_rows(kept, "No single-label samples found.") if strict else kept


def n_codes(long: DataFrame) -> DataFrame:
    """Number of distinct codes of the row, attached to each of its code rows."""
    distinct = F.size(F.collect_set("code").over(W.partitionBy("row_id")))  # a row's codes: bounded by the codebook
    return long.withColumn("n_codes", distinct)


def single_label_corpus(
    df: DataFrame, text_col: str, codes_col: str, codebook: DataFrame | None = None, row_id: str = "row_id"
) -> DataFrame:
    """Texts with exactly one code; codes outside the codebook keep an inferred parent."""
    rows = df.select(
        F.col(row_id).alias("row_id"),
        clean_text(F.col(text_col)).alias("text"),
        F.filter(split_codes(F.col(codes_col)), lambda c: c != UNKNOWN).alias("codes"),
    ).where((F.col("text") != "") & (F.size("codes") == 1))
    rows = rows.select("row_id", "text", F.element_at("codes", 1).alias("code"))
    if codebook is None:
        name: Column = F.lit("")
        parent: Column = parent_code(F.col("code"))
        parent_name: Column = F.lit("")
    else:
        dims = codebook.select("code", "name", F.col("parent_code").alias("_parent"), F.col("parent_name").alias("_pname"))
        rows = rows.join(dims, "code", "left")
        name = F.coalesce("name", F.lit(""))
        parent = F.coalesce("_parent", parent_code(F.col("code")))
        parent_name = F.coalesce("_pname", F.lit(""))
    return rows.select(
        "row_id", "text", F.col("code").alias("codes"), "code", name.alias("code_name"), parent.alias("parent_code"),
        parent_name.alias("parent_name"), F.lit("example").alias("point_type"), F.lit(4).alias("point_radius"),
    )


def attach(source: DataFrame, predictions: DataFrame) -> DataFrame:
    """All source columns plus the predictions, by row key. Columns of an earlier run with the same names are replaced."""
    again = [c for c in predictions.columns if c != "row_id" and c in source.columns]
    return source.drop(*again).join(predictions, "row_id", "left")
