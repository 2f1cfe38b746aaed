"""Text columns: cleaning, combining with the context, prefixes, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two labels of a text that carries its question as context.
CONTEXT_LABEL = "Контекст: "
ANSWER_LABEL = "Ответ: "

# The Unicode blanks and the four separators: all that ``_BLANK_RUN`` matches. A trim looks at the ends of a text only, a pattern at all blanks.
_EDGE_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"


def _as_column(value: Column | str | None) -> Column:
    """Columns pass through; Python strings are literals here, never column names."""
    return value if isinstance(value, Column) else F.lit(value)


def clean_text(value: Column) -> Column:
    """Missing becomes the empty string; Unicode blanks are stripped at both ends."""
    return F.coalesce(F.btrim(value.cast("string"), F.lit(_EDGE_BLANKS)), F.lit(""))


def after_semicolon_prefix(value: Column, prefix: Column | str | None) -> Column:
    """``"8;x"`` with prefix ``p`` becomes ``"8; p x"``; texts without ``;`` stay as they are."""
    text = clean_text(value)
    insert = clean_text(_as_column(prefix))
    position = F.locate(";", text)
    before = clean_text(text.substr(F.lit(1), position - 1))
    after = clean_text(text.substr(position + 1, F.length(text)))
    joined = F.concat(before, F.lit("; "), insert, F.when(after != "", F.concat(F.lit(" "), after)).otherwise(""))
    return F.when((insert == "") | (position == 0), text).otherwise(joined)


def combine_text(answer: Column, context: Column | None = None, prefix: Column | str | None = None) -> Column:
    body = after_semicolon_prefix(answer, prefix) if prefix is not None else clean_text(answer)
    if context is None:
        return body
    ctx = clean_text(context)
    labelled = F.concat(F.lit(CONTEXT_LABEL), ctx, F.lit("\n" + ANSWER_LABEL), body)
    return F.when(ctx != "", labelled).otherwise(body)


def with_prefix(text: Column, prefix: str | None) -> Column:
    """Model input: the saved prefix in front of the text."""
    return F.concat(F.lit(prefix or ""), text)


def resolve_prefix(prompts: dict[str, str], prompt_name: str | None = None, input_prefix: str | None = None) -> str:
    """The prefix to store with an index: a named prompt or an explicit prefix, not both."""
    if prompt_name is not None and input_prefix is not None:
        raise ValueError("Give either a prompt name or an input prefix, not both.")
    if prompt_name is None:
        return input_prefix or ""
    if prompt_name not in prompts:
        raise ValueError(f"Unknown prompt {prompt_name!r}; known prompts: {sorted(prompts)}.")
    return prompts[prompt_name]


def join_labels(labels: Column, sep: str = ", ", drop_empty: bool = False) -> Column:
    kept = F.filter(labels, lambda x: x != "") if drop_empty else labels
    return F.array_join(kept, sep)


def compact_float(value: Column, digits: int = 4) -> Column:
    return F.round(value.cast("double"), digits)


def format_candidates(candidates: Column, sentiment_names: Column | None = None) -> Column:
    """``[(code, score), …]`` as ``"A1:0.8123; A2:…"``, with a sentiment name where given.

    Scores are rounded half-up in decimal, so every engine prints the same digits.
    """

    def one(item: Column) -> Column:
        parts = [item["code"], F.lit(":"), F.round(item["score"], 4).cast("decimal(20,4)").cast("string")]
        if sentiment_names is not None:
            parts += [F.lit(":"), F.element_at(sentiment_names, item["sentiment"])]
        return F.concat(*parts)

    return F.array_join(F.transform(F.filter(candidates, lambda c: c["code"] != ""), one), "; ")


def shorten(text: Column, limit: int = 120) -> Column:
    """Blanks collapsed; beyond ``limit`` characters a shorter form that ends in dots, for display."""
    flat = clean_text(F.regexp_replace(text, _BLANK_RUN, " "))
    shown = F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(shown)


def format_nearest(groups: Column, limit: int = 120) -> Column:
    """``[(code, [text, …]), …]`` as ``code -> "text" | "text"; …``; codes without texts are left out."""

    def one(group: Column) -> Column:
        texts = F.transform(
            F.filter(group["texts"], lambda t: t != ""),
            lambda t: F.concat(F.lit('"'), shorten(t, limit), F.lit('"')),
        )
        return F.when(
            (group["code"] != "") & (F.size(texts) > 0),
            F.concat(group["code"], F.lit(" -> "), F.array_join(texts, " | ")),
        )

    return F.array_join(F.filter(F.transform(groups, one), lambda s: s.isNotNull()), "; ")
