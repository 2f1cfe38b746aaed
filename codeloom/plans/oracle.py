"""The same results in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from ..functions.codes import CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES, SENTIMENT_ALIASES, SENTIMENT_NAMES
from ..operators.annotation import USER_PROMPT, system_prompt
from . import views

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(8239)||chr(12288)"
RESP = views.RESPONSES_SQL.format(documents="documents", labels="labels")
REPL = views.REPLIES_SQL.format(conversations="conversations")
VECS = views.VECTORS_SQL.format(embeddings="embeddings")
CODE_LIST = "[" + ",".join(f"'{c}'" for c in views.CODES) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def norm(x: str) -> str:
    return f"translate(upper(regexp_replace({x}, '\\s+', '', 'g')), '{CYRILLIC_LOOKALIKES}', '{LATIN_LOOKALIKES}')"


def items(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[;,\\n\\r]+'), lambda v: {strip('v')}), lambda v: v <> '')"


def first_seen(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def alias_case(x: str) -> str:
    arms = " ".join(f"WHEN '{a}' THEN {s}" for s, names in SENTIMENT_ALIASES.items() for a in names)
    return f"CASE lower({x}) {arms} END"


CB = "cb(ord, code, name, parent_code, parent_name) AS (VALUES " + ", ".join(
    f"({o}, '{c}', '{n}', '{p}', '{pn}')" for o, c, n, p, pn in views.CODEBOOK
) + ")"

# Named blocks; each lists the blocks it needs.
BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {
    "cb": (CB, ()),
    "resp": (f"resp AS ({RESP})", ()),
    "repl": (f"repl AS ({REPL})", ()),
    "vecs": (f"vecs AS ({VECS})", ()),
    "split0": (f"split0 AS (SELECT *, list_transform({items('raw_codes')}, lambda c: {norm('c')}) AS l FROM resp)", ("resp",)),
    "coded": (f"coded AS (SELECT row_id, answer, context, raw_sentiments, {first_seen('l')} AS all_codes, list_filter({first_seen('l')}, lambda c: c <> 'UNKNOWN') AS codes FROM split0)", ("split0",)),
    "wide": (
        f"wide AS (SELECT row_id, {strip('answer')} AS answer, CASE WHEN {strip('context')} <> '' THEN 'Контекст: ' || {strip('context')} || chr(10) || 'Ответ: ' || {strip('answer')} ELSE {strip('answer')} END AS text, codes FROM coded WHERE {strip('answer')} <> '' AND len(codes) > 0)",
        ("coded",),
    ),
    "long": ("long AS (SELECT row_id, answer AS text, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS pos FROM wide)", ("wide",)),
    "ann0": (f"ann0 AS (SELECT row_id, answer, list_filter(l, lambda c: c <> 'UNKNOWN') AS known, {items('raw_sentiments')} AS s FROM split0)", ("split0",)),
    "ann1": (f"ann1 AS (SELECT *, CASE WHEN len(known) = len(s) THEN list_transform(known, lambda c, i: {{'code': c, 's': {alias_case('s[i]')}}}) END AS pairs FROM ann0)", ("ann0",)),
    "ann2": (
        "ann2 AS (SELECT *, CASE WHEN len(known) = 0 THEN 'ok' WHEN len(s) = 0 THEN 'missing_sentiment' WHEN len(known) <> len(s) THEN 'count_mismatch'"
        " WHEN len(list_filter(pairs, lambda p: p.s IS NULL)) > 0 THEN 'bad_sentiment'"
        " WHEN len(list_distinct(list_transform(pairs, lambda p: p.code))) < len(list_distinct(pairs)) THEN 'conflict' ELSE 'ok' END AS status FROM ann1)",
        ("ann1",),
    ),
    "ann": (f"ann AS (SELECT row_id, {strip('answer')} AS answer, status, CASE WHEN status = 'ok' AND len(known) > 0 THEN {first_seen('pairs')} ELSE [] END AS ps FROM ann2)", ("ann2",)),
    "goldp": ("goldp AS (SELECT row_id, p.code AS code, p.s AS sentiment FROM (SELECT row_id, unnest(ps) AS p FROM ann WHERE status = 'ok'))", ("ann",)),
    "scores": ("scores AS (SELECT doc_id AS row_id, code, CAST((doc_id * 31 + n_chars * 7 + ord * 17) % 101 AS DOUBLE) / 100 AS score FROM documents, cb)", ("cb",)),
    "ranked": ("ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, code) AS rn FROM scores)", ("scores",)),
    "gold": ("gold AS (SELECT row_id, unnest(codes) AS code FROM coded)", ("coded",)),
    "rows_": ("rows_ AS (SELECT DISTINCT row_id FROM gold)", ("gold",)),
    "pred": ("pred AS (SELECT r.row_id, code, score, rn FROM ranked r JOIN rows_ USING (row_id) WHERE score >= 0.5 AND rn <= 3)", ("ranked", "rows_")),
    "cells": (
        "cells AS (SELECT r.row_id, k.code, g.code IS NOT NULL AS g, p.code IS NOT NULL AS p FROM rows_ r CROSS JOIN cb k LEFT JOIN gold g ON g.row_id = r.row_id AND g.code = k.code LEFT JOIN pred p ON p.row_id = r.row_id AND p.code = k.code)",
        ("rows_", "cb", "gold", "pred"),
    ),
    "percode": (
        "percode AS (SELECT code, count(*) FILTER (g AND p) AS tp, count(*) FILTER (g) AS gn, count(*) FILTER (p) AS pn FROM cells GROUP BY code)", ("cells",),
    ),
    "probs0": (
        "probs0 AS (SELECT doc_id AS row_id, code, ord, CAST((doc_id * 31 + n_chars * 7 + ord * 17) % 101 AS DOUBLE) / 100 AS s, (doc_id + ord) % 3 AS turn FROM documents, cb)", ("cb",),
    ),
    "probs": (
        "probs AS (SELECT row_id, code, CAST(1 AS DOUBLE) - s AS p0, " + ", ".join(
            f"s * CASE (turn + {k}) % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS p{k + 1}" for k in range(3)
        ) + " FROM probs0)", ("probs0",),
    ),
    "presence": (
        "presence AS (SELECT *, CAST(1 AS DOUBLE) - p0 AS score, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS sentiment FROM probs)", ("probs",),
    ),
    "pranked": ("pranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, code) AS rn FROM presence)", ("presence",)),
    "prows": ("prows AS (SELECT row_id FROM ann WHERE status = 'ok')", ("ann",)),
    "ppred": ("ppred AS (SELECT row_id, code, sentiment, score, rn FROM pranked JOIN prows USING (row_id) WHERE score >= 0.5 AND rn <= 3)", ("pranked", "prows")),
    "pcells": (
        "pcells AS (SELECT r.row_id, k.code, coalesce(g.sentiment + 1, 0) AS gc, coalesce(p.sentiment + 1, 0) AS pc FROM prows r CROSS JOIN cb k LEFT JOIN goldp g ON g.row_id = r.row_id AND g.code = k.code LEFT JOIN ppred p ON p.row_id = r.row_id AND p.code = k.code)",
        ("prows", "cb", "goldp", "ppred"),
    ),
    "unit": ("unit AS (SELECT row_id, code, parent_code, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM vecs)", ("vecs",)),
    "unitn": ("unitn AS (SELECT row_id, code, parent_code, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY row_id)), 1e-12::DOUBLE) AS v FROM unit)", ("unit",)),
    "cmean": ("cmean AS (SELECT code, any_value(parent_code) AS parent_code, i, avg(v) AS v, count(*) AS n_examples FROM unitn GROUP BY code, i)", ("unitn",)),
    "ccent": ("ccent AS (SELECT code, parent_code, i, n_examples, v / sqrt(sum(v * v) OVER (PARTITION BY code)) AS v FROM cmean)", ("cmean",)),
    "csim": ("csim AS (SELECT u.row_id, c.code, round(sum(u.v * c.v), 12) AS score FROM unitn u JOIN ccent c ON u.i = c.i GROUP BY u.row_id, c.code)", ("unitn", "ccent")),
    "crank": ("crank AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, code) AS rn FROM csim)", ("csim",)),
    "strat": ("strat AS (SELECT row_id, codes[1] AS stratum FROM wide)", ("wide",)),
    "wterms": (
        "wtok AS (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents), "
        "wall AS (SELECT row_id, unnest(t) AS term FROM wtok UNION ALL SELECT row_id, unnest(list_transform(t[1:len(t)-1], lambda v, i: v || ' ' || t[i + 1])) FROM wtok), "
        "wterms AS (SELECT row_id, 'word' AS space, term, count(*) AS tf FROM wall GROUP BY ALL)", (),
    ),
    "cterms": (
        f"cwords AS (SELECT row_id, ' ' || w || ' ' AS w, count(*) AS n FROM (SELECT doc_id AS row_id, unnest(string_split_regex(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL), "
        "cgrams AS (SELECT row_id, n, unnest(list_concat(list_transform(range(1, len(w) - 1), lambda i: substring(w, i, 3)), list_transform(range(1, len(w) - 2), lambda i: substring(w, i, 4)), list_transform(range(1, len(w) - 3), lambda i: substring(w, i, 5)))) AS term FROM cwords), "
        "cterms AS (SELECT row_id, 'char' AS space, term, sum(n) AS tf FROM cgrams GROUP BY ALL)", (),
    ),
    "vocab": (
        "terms AS (SELECT * FROM wterms UNION ALL SELECT * FROM cterms), counted AS (SELECT space, term, count(*) AS df, sum(tf) AS cf FROM terms GROUP BY ALL HAVING count(*) >= 2), "
        "vocab AS (SELECT space, term, df, cf FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY cf DESC, term) AS rn FROM counted) WHERE rn <= CASE space WHEN 'word' THEN 100000 ELSE 150000 END)",
        ("wterms", "cterms"),
    ),
}


def _collect(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _collect(BLOCKS[name][1], seen)
            seen.append(name)
    return seen


def build(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` the named blocks (and ``extra``), then ``body``."""
    parts = [BLOCKS[n][0] for n in _collect(names, [])]
    if extra:
        parts.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def div(a: str, b: str, empty: str = "0") -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE {empty}::DOUBLE END"


def draw_split(val: float, test: float, seed: int, stratify: bool) -> str:
    """Blocks ``assigned(row_id, split)`` from ``strat``: two holdouts by hash order and largest remainder."""
    group = "stratum" if stratify else "''"
    rel = val / (1.0 - test)
    out = [f"h0 AS (SELECT row_id, {group} AS g FROM strat)"]
    for name, source, size, s in (("t", "h0", test, seed), ("v", "h1", rel, seed + 1)):
        out.append(
            f"{name}c AS (SELECT g, count(*) AS c FROM {source} GROUP BY g), "
            f"{name}s AS (SELECT *, sum(c) OVER () AS n, count(*) OVER () AS k, min(c) OVER () AS lo, ceil((sum(c) OVER ())::DOUBLE * {size!r}::DOUBLE)::BIGINT AS h FROM {name}c), "
            f"{name}q AS (SELECT *, h * c // n + CASE WHEN row_number() OVER (ORDER BY h * c % n DESC, g) <= h - sum(h * c // n) OVER () THEN 1 ELSE 0 END AS q, lo >= 2 AND h >= k AND n - h >= k AS fits FROM {name}s), "
            f"{name}r AS (SELECT s.row_id, s.g, q.fits, q.q, q.h, q.n, row_number() OVER (PARTITION BY s.g ORDER BY md5('{s}|' || s.row_id)) AS rn, row_number() OVER (ORDER BY md5('{s}|' || s.row_id)) AS ra FROM {source} s JOIN {name}q q USING (g)), "
            f"{name}m AS (SELECT row_id, g, CASE WHEN fits THEN rn <= q ELSE ra <= least(h, n - 1) END AS held FROM {name}r)"
        )
        if name == "t":
            out.append("h1 AS (SELECT row_id, g FROM tm WHERE NOT held)")
    out.append("assigned AS (SELECT t.row_id, CASE WHEN t.held THEN 'test' WHEN v.held THEN 'val' ELSE 'train' END AS split FROM tm t LEFT JOIN vm v USING (row_id))")
    return ", ".join(out)


SPLIT = draw_split(0.1, 0.1, 42, True)

SAMPLED = (
    "sp AS (SELECT a.row_id, k.code, k.parent_code, g.sentiment, md5('42|' || a.row_id || '|' || k.code) AS h FROM ann a CROSS JOIN cb k LEFT JOIN goldp g ON g.row_id = a.row_id AND g.code = k.code WHERE a.status = 'ok'), "
    "sn AS (SELECT row_id, greatest(count(sentiment), 1) * 2 AS wanted, count(*) - count(sentiment) AS negs, list(parent_code) FILTER (sentiment IS NOT NULL) AS parents FROM sp GROUP BY row_id), "
    "sh AS (SELECT sp.*, least(wanted, negs) AS target, coalesce(list_contains(parents, parent_code), false) AS hard FROM sp JOIN sn USING (row_id)), "
    "s1 AS (SELECT *, sentiment IS NULL AND hard AND row_number() OVER (PARTITION BY row_id, sentiment IS NULL, hard ORDER BY h) <= ceil(target / 2.0) AS pick FROM sh), "
    "s2 AS (SELECT *, count(*) FILTER (pick) OVER (PARTITION BY row_id) AS picked, row_number() OVER (PARTITION BY row_id, sentiment IS NULL, pick ORDER BY h) AS rr FROM s1), "
    "sampled AS (SELECT row_id, code, coalesce(sentiment + 1, 0)::INT AS label, sentiment::INT AS sentiment FROM s2 WHERE sentiment IS NOT NULL OR pick OR rr <= target - picked)"
)


def overall(cells: str) -> str:
    """Metric columns over a block of (row_id, code, g, p)."""
    return (
        f"o1 AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (g) AS gn, count(*) FILTER (p) AS pn, count(*) AS n FROM {cells}), "
        f"o2 AS (SELECT avg({div('2 * tp', 'gn + pn')}) AS macro FROM (SELECT code, count(*) FILTER (g AND p) AS tp, count(*) FILTER (g) AS gn, count(*) FILTER (p) AS pn FROM {cells} GROUP BY code)), "
        f"o3 AS (SELECT count(*) AS n_rows, avg((bad = 0)::INT) AS exact, avg((np = 0)::INT) AS unk FROM (SELECT row_id, count(*) FILTER (g <> p) AS bad, count(*) FILTER (p) AS np FROM {cells} GROUP BY row_id))"
    )


OVERALL_COLS = (
    f"n_rows, {r6(div('tp', 'pn'))} AS micro_precision, {r6(div('tp', 'gn'))} AS micro_recall, {r6(div('2 * tp', 'gn + pn'))} AS micro_f1, {r6('macro')} AS macro_f1,"
    f" {r6('exact')} AS subset_accuracy, {r6(div('gn + pn - 2 * tp', 'n'))} AS hamming_loss"
)


def frame(ranked: str, sep: str, review: str, extra: str = "", extra_cols: str = "", sentiments: bool = False, blank: str = "false", digits: int = 6) -> str:
    """Prediction columns from a block (row_id, code, score, rn[, sentiment])."""
    shown = "code || ':' || printf('%.4f', round(score, 4))"
    if sentiments:
        names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SENTIMENT_NAMES))
        named = f"CASE sentiment {names} END"
        shown += f" || ':' || {named}"
        extra_cols = (
            f", coalesce(string_agg(CAST(sentiment AS VARCHAR), ', ' ORDER BY rn) FILTER (ok), '') AS predicted_sentiments"
            f", coalesce(string_agg(code || ':' || sentiment, ', ' ORDER BY rn) FILTER (ok), 'UNKNOWN') AS predicted_code_sentiments"
            f", coalesce(string_agg(code || ':' || {named}, '; ' ORDER BY rn) FILTER (ok), '') AS predicted_sentiment_names"
        )
    return (
        f"f0 AS (SELECT r.*, k.name, k.parent_code, k.parent_name, {blank} AS blank, r.score >= 0.5 AND r.rn <= 3 AND NOT ({blank}) AS ok FROM {ranked} r JOIN cb k USING (code) {extra}), "
        "f1 AS (SELECT *, ok AND row_number() OVER (PARTITION BY row_id, parent_code, ok ORDER BY rn) = 1 AS newp FROM f0), "
        f"f2 AS (SELECT row_id, coalesce(string_agg(code, ', ' ORDER BY rn) FILTER (ok), 'UNKNOWN') AS predicted_codes, coalesce(string_agg(name, '{sep}' ORDER BY rn) FILTER (ok), 'UNKNOWN') AS predicted_names,"
        f" coalesce(string_agg(parent_code, ', ' ORDER BY rn) FILTER (newp), '') AS predicted_parent_codes, coalesce(string_agg(parent_name, '{sep}' ORDER BY rn) FILTER (newp), '') AS predicted_parent_names,"
        f" round(max(score) FILTER (rn = 1), {digits}) AS confidence, round(max(score) FILTER (rn = 1) - max(score) FILTER (rn = 2), {digits}) AS margin,"
        f" string_agg({shown}, '; ' ORDER BY rn) FILTER (rn <= 4) AS top_candidates, (count(*) FILTER (ok) = 0 OR max(score) FILTER (rn = 1) - max(score) FILTER (rn = 2) < 0.05::DOUBLE OR {review} OR bool_or(blank)) AS needs_review{extra_cols} FROM f1 GROUP BY row_id)"
    )


def replies_blocks() -> str:
    """Blocks from ``repl`` to ``labs`` (row_id, i, code, s) and ``inv`` (row_id, i, invalid)."""
    fenced = "CASE WHEN starts_with(t, '```') THEN " + strip("regexp_replace(regexp_replace(t, '^```(json)?', ''), '```\\s*$', '')") + " ELSE t END"
    code = norm("coalesce(json_extract_string(x, '$.code'), '')")
    return (
        f"q0 AS (SELECT *, {strip('raw_response')} AS t FROM repl), "
        f"q1 AS (SELECT *, {fenced} AS u FROM q0), "
        "q2 AS (SELECT *, CASE WHEN json_valid(u) THEN u ELSE regexp_extract(u, '(?s)\\{.*\\}') END AS j FROM q1), "
        "q3 AS (SELECT *, CASE WHEN llm_error = '' AND j <> '' AND json_valid(j) AND starts_with(j, '{') THEN json_extract(j, '$.labels') END AS labels FROM q2), "
        "q4 AS (SELECT row_id, unnest(CASE WHEN json_type(labels) = 'ARRAY' THEN json_extract(labels, '$[*]') ELSE [] END) AS x, generate_subscripts(CASE WHEN json_type(labels) = 'ARRAY' THEN json_extract(labels, '$[*]') ELSE [] END, 1) AS i FROM q3), "
        f"q5 AS (SELECT row_id, i, json_type(x) = 'OBJECT' AS obj, json_extract_string(x, '$') AS whole, {code} AS code, json_extract_string(x, '$.sentiment') AS st FROM q4), "
        f"q5s AS (SELECT *, coalesce({strip('st')}, '') AS ss FROM q5), "
        f"q6 AS (SELECT *, CASE WHEN NOT obj THEN whole WHEN NOT list_contains({CODE_LIST}, code) THEN nullif(code, '') WHEN NOT regexp_full_match(ss, '[012]') THEN code || ':' || coalesce(st, 'null') END AS invalid, obj AND list_contains({CODE_LIST}, code) AND regexp_full_match(ss, '[012]') AS ok FROM q5s), "
        "q7 AS (SELECT row_id, code, ss::INT AS s, min(i) AS i FROM q6 WHERE ok GROUP BY ALL), "
        "q8 AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) AS rn, count(*) OVER (PARTITION BY row_id) AS n FROM q7), "
        "labs AS (SELECT row_id, code, s, rn FROM q8 WHERE rn <= 4), "
        "inv AS (SELECT row_id, i, invalid FROM q6 WHERE invalid IS NOT NULL UNION ALL SELECT DISTINCT row_id, 999999, 'too_many_labels' FROM q8 WHERE n > 4)"
    )


STUB = "CAST((len(text) * 13 + ord * 29) % 101 AS DOUBLE) / 100"
SCORER_ROWS = (
    f"srow AS (SELECT row_id, {strip('answer')} AS answer, context, lang, CASE WHEN {strip('context')} <> '' THEN 'Контекст: ' || {strip('context')} || chr(10) || 'Ответ: ' || {strip('answer')} ELSE {strip('answer')} END AS text FROM resp)"
)


def stub_pairs(suffix: str = "", where: str = "true") -> str:
    return (
        f"{SCORER_ROWS}, sc AS (SELECT row_id, answer, k.code, k.ord, CAST((len(text) * 13 + len('Категория: ' || k.parent_name || '. Подкатегория: ' || k.name || '{suffix}') * 29) % 101 AS DOUBLE) / 100 AS s FROM srow CROSS JOIN cb k WHERE {where}), "
        "sprob AS (SELECT row_id, code, CASE WHEN answer = '' THEN 1 ELSE CAST(1 AS DOUBLE) - s END AS p0, CASE WHEN answer = '' THEN 0 ELSE s * 0.2::DOUBLE END AS p1, CASE WHEN answer = '' THEN 0 ELSE s * 0.5::DOUBLE END AS p2, CASE WHEN answer = '' THEN 0 ELSE s * 0.3::DOUBLE END AS p3 FROM sc)"
    )


def evaluated_blocks() -> str:
    """Gold and predicted (code, sentiment) pairs of the reply table, rows with known gold only."""
    return replies_blocks() + (
        ", eg AS (SELECT row_id, unnest(string_split(gold, ', ')) AS p FROM repl), eg2 AS (SELECT DISTINCT row_id, p, p[1:2] AS code FROM eg), "
        "ep2 AS (SELECT row_id, code || ':' || s AS p, code, rn FROM labs), "
        "erows AS (SELECT DISTINCT row_id FROM eg2), "
        "egc AS (SELECT DISTINCT row_id, code FROM eg2), epc AS (SELECT row_id, code, min(rn) AS rn FROM ep2 GROUP BY ALL), "
        "ecell AS (SELECT r.row_id, k.code, g.code IS NOT NULL AS g, p.code IS NOT NULL AS p FROM erows r CROSS JOIN cb k LEFT JOIN egc g ON g.row_id = r.row_id AND g.code = k.code LEFT JOIN epc p ON p.row_id = r.row_id AND p.code = k.code), "
        "jcell AS (SELECT r.row_id, k.code || ':' || s.s AS code, g.p IS NOT NULL AS g, p.p IS NOT NULL AS p FROM erows r CROSS JOIN cb k CROSS JOIN (VALUES (0), (1), (2)) s(s) LEFT JOIN eg2 g ON g.row_id = r.row_id AND g.p = k.code || ':' || s.s LEFT JOIN ep2 p ON p.row_id = r.row_id AND p.p = k.code || ':' || s.s), "
        "sacc AS (SELECT eg2.code, count(*) AS pairs, count(ep2.p) AS hit, count(epc.code) AS found FROM eg2 LEFT JOIN ep2 USING (row_id, p) LEFT JOIN epc ON epc.row_id = eg2.row_id AND epc.code = eg2.code GROUP BY eg2.code)"
    )


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    comb = f"CASE WHEN {strip('context')} <> '' THEN 'Контекст: ' || {strip('context')} || chr(10) || 'Ответ: ' || {strip('answer')} ELSE {strip('answer')} END"
    sql["clean_combine"] = build(f"SELECT row_id, {comb} AS text FROM resp", "resp")
    sql["semicolon_prefix"] = build(
        f"SELECT row_id, lang || '; about:' || CASE WHEN {strip('answer')} <> '' THEN ' ' || {strip('answer')} ELSE '' END AS text FROM resp", "resp")
    sql["split_codes_long"] = build(
        "SELECT row_id, (generate_subscripts(all_codes, 1) - 1)::INT AS pos, unnest(all_codes) AS code, regexp_extract(unnest(all_codes), '^([A-Z]+)', 1) AS parent_code FROM coded", "coded")
    sql["loaded_responses"] = build("SELECT row_id, text, array_to_string(codes, ',') AS codes FROM wide", "wide")
    sql["code_enriched"] = build(
        "SELECT row_id, code, coalesce(name, code) AS code_name, coalesce(parent_code, '') AS parent_code, coalesce(parent_name, '') AS parent_name FROM long LEFT JOIN (SELECT * FROM cb WHERE code <> 'B2') USING (code)",
        "long", "cb")
    sql["unknown_codes"] = build("SELECT code, count(*) AS n_rows FROM long WHERE code IN ('B2', 'C1') GROUP BY code", "long")
    sql["annotations_parsed"] = build(
        "SELECT row_id, status, CASE WHEN len(ps) = 0 THEN 'UNKNOWN' ELSE array_to_string(list_transform(ps, lambda p: p.code), ', ') END AS codes,"
        " array_to_string(list_transform(ps, lambda p: CAST(p.s AS VARCHAR)), ', ') AS sentiments,"
        " CASE WHEN len(ps) = 0 THEN 'UNKNOWN' ELSE array_to_string(list_transform(ps, lambda p: p.code || ':' || p.s), ', ') END AS code_sentiments FROM ann", "ann")
    sql["load_report"] = build(
        "SELECT count(*) AS input_rows, count(*) FILTER (answer <> '' AND status = 'ok') AS loaded_rows, count(*) FILTER (answer = '') AS empty_text_rows,"
        " count(*) FILTER (answer <> '' AND status = 'conflict') AS skipped_conflicting_sentiment_rows FROM ann", "ann")
    sql["conflict_source_rows"] = build("SELECT row_id + 2 AS source_row FROM ann WHERE answer <> '' AND status = 'conflict'", "ann")
    inl = "list_transform(" + items("inline_labels") + ", lambda x: regexp_extract(x, '^(.+?)[:=|]', 1) || ':' || right(x, 1))"
    sql["inline_sentiments"] = build(f"SELECT row_id, 'ok' AS status, array_to_string({first_seen('p')}, ',') AS labels FROM (SELECT row_id, {inl} AS p FROM resp)", "resp")
    sql["response_groups"] = build("SELECT row_id, text, array_to_string(codes, ',') AS codes, codes[1] AS stratum FROM wide", "wide")
    sql["codes_per_row"] = build("SELECT row_id, code, (count(*) OVER (PARTITION BY row_id))::INT AS n_codes FROM long", "long")
    sql["single_label_corpus"] = build(
        "SELECT w.row_id, w.answer AS text, w.codes[1] AS codes, w.codes[1] AS code, coalesce(name, '') AS code_name, coalesce(parent_code, w.codes[1][1:1]) AS parent_code, coalesce(parent_name, '') AS parent_name, 'example' AS point_type, 4 AS point_radius"
        " FROM wide w LEFT JOIN (SELECT * FROM cb WHERE code <> 'A2') c ON c.code = w.codes[1] WHERE len(codes) = 1", "wide", "cb")
    raw = f"CASE p_size WHEN 1 THEN ' ' WHEN 2 THEN 'brand' ELSE split_part(p_name, ' ', 1) || ' ' || regexp_extract(p_brand, '[0-9]+') END"
    sql["codebook_violations"] = (
        f"WITH c AS (SELECT p_partkey + 2 AS line, {norm(raw)} AS code, p_name AS name, p_type AS cat FROM part), "
        "d AS (SELECT *, CASE WHEN regexp_extract(code, '^([A-Z]+)', 1) = '' THEN code ELSE regexp_extract(code, '^([A-Z]+)', 1) END AS parent FROM c), "
        "e AS (SELECT *, CASE WHEN code = '' OR name = '' OR cat = '' THEN 'incomplete_row' WHEN code = parent THEN 'invalid_leaf' END AS kind FROM d) "
        "SELECT kind, CAST(line AS VARCHAR) AS subject, 1::BIGINT AS n_rows FROM e WHERE kind IS NOT NULL UNION ALL "
        "SELECT 'duplicate_code', code, count(*) FROM e WHERE kind IS NULL GROUP BY code HAVING count(*) > 1 UNION ALL "
        "SELECT 'inconsistent_parent_name', parent, count(DISTINCT cat) FROM e WHERE kind IS NULL GROUP BY parent HAVING count(DISTINCT cat) > 1"
    )
    sql["codebook_rendered"] = (
        "WITH f AS (SELECT lang, source, min(doc_id) AS ord FROM documents GROUP BY ALL) SELECT count(*) AS n_codes, "
        "string_agg(upper(lang) || regexp_extract(source, '[0-9]+') || '. Категория: ' || lang || '. Подкатегория: ' || source, chr(10) ORDER BY ord) AS rendered FROM f"
    )
    sql["split_assignments"] = build("SELECT row_id, split FROM assigned", "strat", extra=SPLIT)
    sql["split_random"] = build("SELECT row_id, split FROM assigned", "strat", extra=draw_split(0.15, 0.2, 7, False))
    sql["split_summary"] = build("SELECT split, count(*) AS rows_long, count(DISTINCT row_id) AS responses, count(DISTINCT code) AS codes FROM long JOIN assigned USING (row_id) GROUP BY split", "long", "strat", extra=SPLIT)
    sql["split_members"] = build("SELECT row_id, array_to_string(codes, ',') AS codes FROM wide JOIN assigned USING (row_id) WHERE split = 'val'", "wide", "strat", extra=SPLIT)
    sql["label_distribution"] = build(
        "SELECT code, name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(split) AS total FROM cb LEFT JOIN (SELECT code, split FROM long JOIN assigned USING (row_id)) USING (code) GROUP BY code, name",
        "cb", "long", "strat", extra=SPLIT)
    sql["coverage_repair"] = build(
        "SELECT row_id, CASE WHEN row_id IN (SELECT unnest(moved) FROM walk WHERE step = (SELECT max(step) FROM walk)) THEN 'train' ELSE split END AS split FROM cs",
        "wide", "long",
        extra=(
            "cs AS (SELECT row_id, codes, CASE WHEN list_contains(codes, 'C1') THEN 'val' WHEN list_contains(codes, 'B2') THEN 'test' WHEN list_contains(codes, 'A4') THEN 'val' WHEN list_contains(codes, 'A2') THEN 'test' ELSE 'train' END AS split FROM wide), "
            "cl AS (SELECT row_id, split, codes, unnest(codes) AS code FROM cs), "
            "cm AS (SELECT code, row_number() OVER (ORDER BY code) AS step FROM (SELECT code FROM cl GROUP BY code HAVING count(*) FILTER (split = 'train') = 0)), "
            "cf AS (SELECT step, code, row_id, codes FROM (SELECT cm.step, cl.*, row_number() OVER (PARTITION BY cl.code ORDER BY CASE split WHEN 'val' THEN 0 ELSE 1 END, row_id) AS rn FROM cl JOIN cm USING (code)) WHERE rn = 1), "
            "walk(step, covered, moved) AS (SELECT 0::BIGINT, []::VARCHAR[], []::BIGINT[] UNION ALL SELECT cf.step, CASE WHEN list_contains(covered, cf.code) THEN covered ELSE list_concat(covered, cf.codes) END, CASE WHEN list_contains(covered, cf.code) THEN moved ELSE list_append(moved, cf.row_id) END FROM walk JOIN cf ON cf.step = walk.step + 1)"
        ), recursive=True)
    sql["pairs_full"] = build(
        "SELECT a.row_id, k.code, k.name AS code_name, 'Категория: ' || k.parent_name || '. Подкатегория: ' || k.name AS code_description, coalesce(g.sentiment + 1, 0)::INT AS label, g.sentiment::INT AS sentiment, k.ord AS code_position"
        " FROM ann a CROSS JOIN cb k LEFT JOIN goldp g ON g.row_id = a.row_id AND g.code = k.code WHERE a.status = 'ok'", "ann", "cb", "goldp")
    sql["pairs_sampled"] = build("SELECT * FROM sampled", "ann", "cb", "goldp", extra=SAMPLED)
    sql["pair_distribution"] = build(
        "SELECT s.split, l.label, count(p.row_id) AS n_pairs FROM (VALUES ('train'), ('val'), ('test')) s(split) CROSS JOIN (VALUES (0), (1), (2), (3)) l(label) LEFT JOIN (SELECT row_id, label, split FROM sampled JOIN assigned USING (row_id)) p ON p.split = s.split AND p.label = l.label GROUP BY ALL",
        "ann", "cb", "goldp", "strat", extra=SAMPLED + ", " + SPLIT)
    sql["class_weights"] = build(
        f"SELECT l.label, count(s.row_id) AS n_pairs, {r6('CASE WHEN count(s.row_id) = 0 THEN 1 ELSE least(greatest((SELECT count(*) FROM sampled)::DOUBLE / (4 * count(s.row_id)), 0.25), 10) END')} AS weight FROM (VALUES (0), (1), (2), (3)) l(label) LEFT JOIN sampled s USING (label) GROUP BY l.label",
        "ann", "cb", "goldp", extra=SAMPLED)
    n_wide = "(SELECT count(*) FROM wide)"
    sql["positive_weights"] = build(
        f"SELECT k.code, count(l.row_id) AS positives, {r6(f'CASE WHEN count(l.row_id) = 0 THEN 1 ELSE least(greatest(({n_wide} - count(l.row_id))::DOUBLE / count(l.row_id), 1), 20) END')} AS weight FROM cb k LEFT JOIN long l USING (code) GROUP BY k.code", "cb", "long")
    sql["balanced_weights"] = build(
        f"SELECT k.code, count(l.row_id) AS positives, {r6(div(n_wide, '2 * count(l.row_id)', '1'))} AS positive_weight, {r6(div(n_wide, f'2 * ({n_wide} - count(l.row_id))', '1'))} AS negative_weight FROM cb k LEFT JOIN long l USING (code) GROUP BY k.code", "cb", "long")
    sql["class_sizes"] = build("SELECT code, count(DISTINCT text) AS n_texts FROM long GROUP BY code ORDER BY n_texts DESC, code LIMIT 20", "long")
    sql["positive_pairs"] = build(
        "SELECT code, least(a.f, b.f) AS row_a, greatest(a.f, b.f) AS row_b, CASE WHEN a.f < b.f THEN a.d ELSE b.d END AS a, CASE WHEN a.f < b.f THEN b.d ELSE a.d END AS b, 1.0::DOUBLE AS label FROM pk JOIN px a USING (code) JOIN px b USING (code) WHERE a.r = p % n AND b.r = (p % n + p // n + 1) % n",
        "long",
        extra=(
            "po AS (SELECT code, md5(text) AS d, min(row_id) AS f FROM long GROUP BY ALL), px AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS r FROM po), "
            "pn AS (SELECT code, count(*) AS n, count(*) * (count(*) - 1) // 2 AS total, least(count(*) * (count(*) - 1) // 2, 5000) AS m FROM po GROUP BY code HAVING count(*) >= 10), "
            "pt AS (SELECT *, unnest(range(m)) AS t FROM pn), "
            "pk AS (SELECT code, n, t * (total // m) + least(t, total % m) + ('0x' || substring(md5('42|pair|' || code || '|' || t), 1, 8))::BIGINT % (total // m + CASE WHEN t < total % m THEN 1 ELSE 0 END) AS p FROM pt)"
        ))
    complements = (
        "po AS (SELECT code, md5(text) AS d, min(row_id) AS f, count(DISTINCT row_id) AS held FROM long GROUP BY ALL), "
        "pn AS (SELECT code, count(*) AS n, count(*) * (count(*) - 1) // 2 AS total, least(count(*) * (count(*) - 1) // 2, 5000) AS m FROM po GROUP BY code HAVING count(*) >= 10), "
        "pu AS (SELECT md5(text) AS d, min(row_id) AS f, count(DISTINCT row_id) AS uses FROM long GROUP BY ALL), "
        "pa AS (SELECT code, d, po.f, held = uses AS own, row_number() OVER (PARTITION BY code, held = uses ORDER BY d) - 1 AS i FROM po JOIN pn USING (code) JOIN pu USING (d)), "
        "pc AS (SELECT code, u.d, u.f, row_number() OVER (PARTITION BY code ORDER BY u.d) - 1 AS k FROM pn CROSS JOIN pu u WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.code = pn.code AND pa.d = u.d AND own)), "
        "ps AS (SELECT code, n, total, m, (SELECT count(*) FROM pa WHERE pa.code = pn.code AND own) AS owned, (SELECT count(*) FROM pc WHERE pc.code = pn.code) AS v FROM pn)"
    )

    def drawn(name: str, total: str, wanted: str, key: str) -> str:
        numbers = f"SELECT code, {total} AS cells, least({total}, {wanted}) AS w FROM ps"
        return (
            f"{name} AS (SELECT code, w, t, t * (cells // w) + least(t, cells % w) + ('0x' || substring(md5('42|{key}|' || code || '|' || t), 1, 8))::BIGINT % (cells // w + CASE WHEN t < cells % w THEN 1 ELSE 0 END) AS p "
            f"FROM (SELECT *, unnest(range(w)) AS t FROM ({numbers}) WHERE w > 0))"
        )

    sql["negative_candidates"] = build("SELECT code, k, f AS row FROM pc", "long", extra=complements)
    sql["contrastive_negatives"] = build(
        "SELECT x.code, pa.f AS row_a, pc.f AS row_b, 0.0::DOUBLE AS label, 'negative' AS sample_type FROM px x JOIN pa USING (code, own, i) LEFT JOIN pc self ON self.code = x.code AND self.d = pa.d AND NOT x.own "
        "JOIN pc ON pc.code = x.code AND pc.k = CASE WHEN x.own OR x.j < self.k THEN x.j ELSE x.j + 1 END",
        "long", extra=complements + ", " + drawn("pd", "owned * v + (n - owned) * greatest(v - 1, 0)", "m", "cell")
        + ", px AS (SELECT code, p < owned * v AS own, CASE WHEN p < owned * v THEN p // v ELSE (p - owned * v) // (v - 1) END AS i, CASE WHEN p < owned * v THEN p % v ELSE (p - owned * v) % (v - 1) END AS j FROM pd JOIN ps USING (code))")
    sql["triplets"] = build(
        "SELECT code, least(a.f, b.f) AS row_a, greatest(a.f, b.f) AS row_b, pc.f AS row_n FROM pd x JOIN ps USING (code) JOIN pr a USING (code) JOIN pr b USING (code) JOIN pg ON pg.code = x.code AND pg.t = x.t % pg.w JOIN pc ON pc.code = x.code AND pc.k = pg.p WHERE a.r = x.p % n AND b.r = (x.p % n + x.p // n + 1) % n".replace("SELECT code,", "SELECT x.code,"),
        "long", extra=complements + ", pr AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS r FROM po), " + drawn("pd", "total", "m", "pair") + ", " + drawn("pg", "v", "m", "negative"))
    sql["negatives_audit"] = build("SELECT code, least(count(DISTINCT text) * (count(DISTINCT text) - 1) // 2, 5000) AS n_pairs, least(count(DISTINCT text) * (count(DISTINCT text) - 1) // 2, 5000) AS n_distinct, 0::BIGINT AS n_wrong FROM long GROUP BY code HAVING count(DISTINCT text) >= 10", "long")
    sql["training_tables"] = build(
        "SELECT 'pairs' AS table_name, split || ':' || label AS part, count(*) AS n FROM (SELECT split, unnest(list_concat(list_transform(ps, lambda p: p.s + 1), list_transform(range(least(3 * greatest(len(ps), 1), 10 - len(ps))), lambda i: 0))) AS label FROM tann JOIN assigned USING (row_id)) GROUP BY split, label"
        " UNION ALL SELECT t.name, code, least(n * (n - 1) // 2, 5000) FROM (SELECT code, count(DISTINCT text) AS n FROM (SELECT unnest(list_transform(ps, lambda p: p.code)) AS code, answer AS text FROM tann JOIN assigned USING (row_id) WHERE split = 'train') GROUP BY code HAVING count(DISTINCT text) >= 10) CROSS JOIN (VALUES ('positive_pairs'), ('negative_pairs'), ('triplets')) t(name)",
        "ann", extra="tann AS (SELECT * FROM ann WHERE status = 'ok' AND answer <> ''), strat AS (SELECT row_id, CASE WHEN len(ps) = 0 THEN 'UNKNOWN' ELSE ps[1].code || ':' || ps[1].s END AS stratum FROM tann), " + SPLIT)
    # vectors
    sql["code_centroids"] = build(f"SELECT c.code, k.name AS code_name, k.parent_code, k.parent_name, n_examples, (i - 1)::INT AS pos, {r6('v')} AS value FROM ccent c JOIN cb k USING (code)", "ccent", "cb")
    sql["parent_centroids"] = build(
        f"SELECT m.parent_code, p.parent_name, p.child_codes, n_examples, (i - 1)::INT AS pos, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY m.parent_code))')} AS value FROM (SELECT parent_code, i, avg(v) AS v, count(*) AS n_examples FROM unitn GROUP BY ALL) m"
        " JOIN (SELECT parent_code, any_value(parent_name) AS parent_name, string_agg(DISTINCT code, ', ' ORDER BY code) AS child_codes FROM cb WHERE code IN (SELECT code FROM vecs) GROUP BY parent_code) p USING (parent_code)", "unitn", "cb")
    sql["single_label_centroids"] = build(
        f"SELECT code, n_examples, (i - 1)::INT AS pos, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY code))')} AS value FROM (SELECT code, i, avg(v) AS v, count(*) AS n_examples FROM unitn u WHERE row_id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM vecs x WHERE x.row_id + 1 = u.row_id AND x.code <> u.code) GROUP BY ALL)", "unitn")
    sql["nearest_centroid"] = build("SELECT row_id, code, round(score, 4) + 0.0::DOUBLE AS score FROM csim", "csim")
    near = (
        "np AS (SELECT row_id, code, rn FROM crank WHERE rn <= 5 AND score >= 0.3 AND rn <= 2), "
        "nq AS (SELECT p.row_id, p.code, p.rn, e.row_id AS ex, round(sum(u.v * e.v), 12) AS score FROM np p JOIN unitn u ON u.row_id = p.row_id JOIN unitn e ON e.code = p.code AND e.i = u.i GROUP BY ALL), "
        "nr AS (SELECT *, row_number() OVER (PARTITION BY row_id, code ORDER BY score DESC, ex || '|' || code) AS k FROM nq), "
        "ng AS (SELECT row_id, code, rn, code || ' -> ' || string_agg('\"vector ' || ex || '\"', ' | ' ORDER BY k) AS g FROM nr WHERE k <= 2 GROUP BY row_id, code, rn), "
        "nn AS (SELECT row_id, string_agg(g, '; ' ORDER BY rn) AS nearest_examples FROM ng GROUP BY row_id), "
        "f0 AS (SELECT c.*, k.name, k.parent_code, k.parent_name, score >= 0.3 AND rn <= 2 AS ok FROM crank c JOIN cb k USING (code)), "
        "f1 AS (SELECT *, ok AND row_number() OVER (PARTITION BY row_id, parent_code, ok ORDER BY rn) = 1 AS newp FROM f0), "
        "f2 AS (SELECT row_id, coalesce(string_agg(code, ', ' ORDER BY rn) FILTER (ok), 'UNKNOWN') AS predicted_codes, coalesce(string_agg(name, ', ' ORDER BY rn) FILTER (ok), 'UNKNOWN') AS predicted_names,"
        " coalesce(string_agg(parent_code, ', ' ORDER BY rn) FILTER (newp), '') AS predicted_parent_codes, coalesce(string_agg(parent_name, ', ' ORDER BY rn) FILTER (newp), '') AS predicted_parent_names,"
        " round(max(score) FILTER (rn = 1), 4) AS confidence, round(max(score) FILTER (rn = 1) - max(score) FILTER (rn = 2), 4) AS margin, string_agg(code || ':' || printf('%.4f', round(score, 4)), '; ' ORDER BY rn) FILTER (rn <= 5) AS top_candidates,"
        " max(score) FILTER (rn = 1) < 0.3 OR max(score) FILTER (rn = 1) - max(score) FILTER (rn = 2) < 0.05::DOUBLE AS needs_review FROM f1 GROUP BY row_id)"
    )
    sql["index_classify"] = build("SELECT f2.*, coalesce(nearest_examples, '') AS nearest_examples FROM f2 LEFT JOIN nn USING (row_id)", "crank", "cb", extra=near)
    sql["nearest_examples"] = build(
        "SELECT row_id, code, k::INT AS rank, ex || '|' || code AS example_id, round(score, 4) + 0.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, ex || '|' || code) AS k FROM (SELECT u.row_id, u.code, e.row_id AS ex, round(sum(u.v * e.v), 12) AS score FROM unitn u JOIN unitn e ON e.code = u.code AND e.i = u.i GROUP BY ALL)) WHERE k <= 3", "unitn")
    sql["index_tables"] = build("SELECT count(*) AS n_examples, 0::BIGINT AS n_bad_embeddings, count(DISTINCT code)::INT AS n_codes, count(DISTINCT parent_code)::INT AS n_parents, max(len(embedding))::INT AS embedding_dim FROM vecs", "vecs")
    sql["cosine_pairs"] = build("SELECT a.row_id, 'query: ' || any_value(a.text) AS text, round(sum(u.v * w.v), 4) AS similarity FROM vecs a JOIN unitn u ON u.row_id = a.row_id JOIN unitn w ON w.row_id = a.row_id + 1 AND w.i = u.i GROUP BY a.row_id", "vecs", "unitn")
    # decoding
    sql["ranked_candidates"] = build("SELECT row_id, rn::INT AS rank, code, score FROM ranked WHERE rn <= 5", "ranked")
    sql["decode_scores"] = build("SELECT row_id, rn::INT AS rank, code, score FROM ranked WHERE rn <= 3 AND score >= 0.5", "ranked")
    sql["sentiment_decode"] = build(f"SELECT row_id, rn::INT AS rank, code, {r6('score')} AS score, sentiment::INT AS sentiment FROM pranked WHERE rn <= 3 AND score >= 0.5", "pranked")
    sql["softmax_probabilities"] = build(f"SELECT row_id, (i - 1)::INT AS pair_class, {r6('e / sum(e) OVER (PARTITION BY row_id)')} AS p, CASE WHEN i > 1 THEN (i - 2)::INT END AS sentiment FROM (SELECT row_id, i, exp(v) AS e FROM unit WHERE i <= 4)", "unit")
    sql["predictions_linear"] = build("SELECT * FROM f2", "ranked", "cb", "resp", extra=frame(
        "ranked", ", ", "max(score) FILTER (rn = 1) < 0.5", f"JOIN (SELECT row_id, {strip('answer')} = '' AS b FROM resp) x USING (row_id)", blank="x.b", digits=4))
    sql["predictions_encoder"] = build("SELECT * FROM f2", "ranked", "cb", extra=frame("ranked", "; ", "false"))
    sql["predictions_pair"] = build("SELECT * FROM f2", "pranked", "cb", extra=frame("pranked", "; ", "false", sentiments=True))
    sql["prediction_frame"] = build(
        "SELECT r.row_id, r.context, r.lang, t.true_codes, CASE WHEN t.true_codes IS NOT NULL THEN coalesce(p.c, 'UNKNOWN') END AS predicted_codes, CASE WHEN t.true_codes IS NOT NULL THEN q.c END AS top_candidates, t.true_codes = coalesce(p.c, 'UNKNOWN') AS correct FROM resp r"
        " LEFT JOIN (SELECT row_id, string_agg(code, ', ' ORDER BY code) AS true_codes FROM long GROUP BY row_id) t USING (row_id)"
        " LEFT JOIN (SELECT row_id, string_agg(code, ', ' ORDER BY code) AS c FROM ranked WHERE rn <= 3 AND score >= 0.5 GROUP BY row_id) p USING (row_id)"
        " LEFT JOIN (SELECT row_id, string_agg(code || ':' || printf('%.4f', round(score, 4)), '; ' ORDER BY rn) AS c FROM ranked WHERE rn <= 5 GROUP BY row_id) q USING (row_id)", "resp", "long", "ranked")
    # metrics
    single = "o4 AS (SELECT avg((t.code = g.c)::INT) AS top1 FROM (SELECT row_id, min(code) AS c FROM gold GROUP BY row_id HAVING count(*) = 1) g LEFT JOIN {top} t USING (row_id))"
    first_pred = single.replace("(t.code = g.c)::INT", "coalesce(t.code = g.c, false)::INT").format(top="(SELECT row_id, code FROM pred WHERE rn = 1)")
    best = single.format(top="(SELECT row_id, code FROM ranked WHERE rn = 1)")
    sql["metrics_overall"] = build(f"SELECT {OVERALL_COLS}, {r6('top1')} AS single_label_top1_accuracy, {r6('unk')} AS unknown_prediction_rate FROM o1, o2, o3, o4", "cells", extra=overall("cells") + ", " + first_pred)
    lrap = (
        "l1 AS (SELECT a.row_id, a.code, count(*) AS all_n, count(*) FILTER (h.code IS NOT NULL) AS true_n FROM (SELECT s.row_id, s.code, s.score FROM scores s JOIN gold USING (row_id, code)) a JOIN scores b ON b.row_id = a.row_id AND b.score >= a.score LEFT JOIN gold h ON h.row_id = b.row_id AND h.code = b.code GROUP BY ALL), "
        "l2 AS (SELECT avg(v) AS lrap FROM (SELECT row_id, avg(true_n::DOUBLE / all_n) AS v FROM l1 GROUP BY row_id))"
    )
    sql["lrap"] = build(f"SELECT {OVERALL_COLS}, {r6('top1')} AS single_label_top1_accuracy, {r6('unk')} AS unknown_prediction_rate, {r6('lrap')} AS lrap, 0.5::DOUBLE AS threshold FROM o1, o2, o3, o4, l2", "cells", "scores", extra=overall("cells") + ", " + best + ", " + lrap)
    sql["metrics_per_code"] = build(f"SELECT code, gn AS support, {r6(div('tp', 'pn'))} AS precision, {r6(div('tp', 'gn'))} AS recall, {r6(div('2 * tp', 'gn + pn'))} AS f1 FROM percode", "percode")
    sql["error_rows"] = build(
        "SELECT row_id, g.c AS gold, coalesce(p.c, '') AS pred FROM (SELECT row_id, array_to_string(codes, ',') AS c, array_to_string(list_sort(codes), ',') AS s FROM coded WHERE len(codes) > 0) g LEFT JOIN (SELECT row_id, string_agg(code, ',' ORDER BY rn) AS c, string_agg(code, ',' ORDER BY code) AS s FROM pred GROUP BY row_id) p USING (row_id) WHERE g.s <> coalesce(p.s, '')",
        "coded", "pred")
    sql["row_accounting"] = build("SELECT count(*) AS input_rows, count(*) FILTER (k > 0) AS evaluated_rows, count(*) FILTER (k = 0) AS rows_without_known_gold_codes FROM (SELECT len(list_filter(codes, lambda c: c NOT IN ('A1', 'A2'))) AS k FROM coded)", "coded")
    th = "th AS (SELECT i, (10 + 5 * i)::DOUBLE / 100 AS threshold FROM range(17) t(i))"
    sql["threshold_search"] = build(
        f"SELECT threshold, {r6('mi')} AS micro_f1, {r6('ma')} AS macro_f1, threshold = max_by(threshold, {{'a': round(mi, 12), 'b': threshold}}) OVER () AS best_micro, threshold = max_by(threshold, {{'a': round(ma, 12), 'b': threshold}}) OVER () AS best_macro FROM t3",
        "ranked", "rows_", "gold", "cb",
        extra=f"{th}, t1 AS (SELECT threshold, r.code, g.code IS NOT NULL AS g, score >= threshold AND rn <= 3 AS p FROM ranked r JOIN rows_ USING (row_id) LEFT JOIN gold g ON g.row_id = r.row_id AND g.code = r.code CROSS JOIN th), "
              f"t2 AS (SELECT threshold, code, count(*) FILTER (g AND p) AS tp, count(*) FILTER (g) AS gn, count(*) FILTER (p) AS pn FROM t1 GROUP BY ALL), t3 AS (SELECT threshold, {div('2 * sum(tp)', 'sum(gn) + sum(pn)')} AS mi, avg({div('2 * tp', 'gn + pn')}) AS ma FROM t2 GROUP BY threshold)")
    sql["gold_targets"] = build("SELECT row_id, status, status <> 'conflict' AS valid, array_to_string(list_transform(ps, lambda p: p.code || ':' || p.s), ',') AS gold FROM ann", "ann")
    joint_cells = "jc AS (SELECT row_id, code || ':' || k.s AS code, gc = k.s AS g, pc = k.s AS p FROM pcells CROSS JOIN (VALUES (1), (2), (3)) k(s))"
    pres = "prc AS (SELECT row_id, code, gc > 0 AS g, pc > 0 AS p FROM pcells)"

    def renamed(block: str, suffix: str) -> str:
        return overall(block).replace("o1 AS", f"{suffix}1 AS").replace("o2 AS", f"{suffix}2 AS").replace("o3 AS", f"{suffix}3 AS")

    def as_row(suffix: str, names: str) -> str:
        return f"{suffix} AS (SELECT {names} FROM {suffix}1, {suffix}2, {suffix}3)"

    joint_names = f"n_rows, {r6(div('tp', 'pn'))} AS joint_micro_precision, {r6(div('tp', 'gn'))} AS joint_micro_recall, {r6(div('2 * tp', 'gn + pn'))} AS joint_micro_f1, {r6('macro')} AS joint_macro_f1, {r6('exact')} AS joint_subset_accuracy"
    sql["joint_metrics"] = build(
        "SELECT j.*, x.* EXCLUDE (n_rows), o4.top1 AS single_label_top1_accuracy FROM j, x, o4", "pcells", "ppred", "goldp",
        extra=f"{joint_cells}, {pres}, {renamed('jc', 'j')}, {renamed('prc', 'x')}, {as_row('j', joint_names)}, {as_row('x', OVERALL_COLS + ', ' + r6('unk') + ' AS unknown_prediction_rate')}, "
              f"o4 AS (SELECT {r6('avg(coalesce(t.code = g.c, false)::INT)')} AS top1 FROM (SELECT row_id, min(code) AS c FROM goldp GROUP BY row_id HAVING count(*) = 1) g LEFT JOIN (SELECT row_id, code FROM ppred WHERE rn = 1) t USING (row_id))")
    sql["sentiment_accuracy"] = build(
        f"SELECT {r6('avg((gc = pc)::INT) FILTER (gc > 0)')} AS gold_code_sentiment_accuracy, {r6('avg((gc = pc)::INT) FILTER (gc > 0 AND pc > 0)')} AS detected_gold_sentiment_accuracy, count(*) FILTER (gc > 0) AS gold_codes, count(*) FILTER (gc > 0 AND pc > 0) AS detected_gold_codes, {r6('avg((gc = pc)::INT)')} AS joint_pair_accuracy FROM pcells", "pcells")
    sql["sentiment_by_code"] = build(f"SELECT code, {r6('avg((gc = pc)::INT) FILTER (gc > 0)')} AS gold_code_sentiment_accuracy, {r6('avg((gc = pc)::INT) FILTER (gc > 0 AND pc > 0)')} AS detected_gold_sentiment_accuracy FROM pcells GROUP BY code", "pcells")
    sql["presence_threshold_search"] = build(
        f"SELECT a.threshold, {r6('a.mi')} AS micro_f1, {r6('a.ma')} AS macro_f1, {r6('b.mi')} AS joint_micro_f1, {r6('b.ma')} AS joint_macro_f1 FROM t3 a JOIN u3 b USING (threshold)", "pranked", "prows", "goldp", "cb",
        extra=f"{th}, t1 AS (SELECT threshold, r.code, coalesce(g.sentiment + 1, 0) AS gc, CASE WHEN score >= threshold AND rn <= 3 THEN r.sentiment + 1 ELSE 0 END AS pc FROM pranked r JOIN prows USING (row_id) LEFT JOIN goldp g ON g.row_id = r.row_id AND g.code = r.code CROSS JOIN th), "
              f"t2 AS (SELECT threshold, code, count(*) FILTER (gc > 0 AND pc > 0) AS tp, count(*) FILTER (gc > 0) AS gn, count(*) FILTER (pc > 0) AS pn FROM t1 GROUP BY ALL), t3 AS (SELECT threshold, {div('2 * sum(tp)', 'sum(gn) + sum(pn)')} AS mi, avg({div('2 * tp', 'gn + pn')}) AS ma FROM t2 GROUP BY threshold), "
              f"u2 AS (SELECT threshold, code, s, count(*) FILTER (gc = s AND pc = s) AS tp, count(*) FILTER (gc = s) AS gn, count(*) FILTER (pc = s) AS pn FROM t1 CROSS JOIN (VALUES (1), (2), (3)) k(s) GROUP BY ALL), u3 AS (SELECT threshold, {div('2 * sum(tp)', 'sum(gn) + sum(pn)')} AS mi, avg({div('2 * tp', 'gn + pn')}) AS ma FROM u2 GROUP BY threshold)")
    pm = (
        "pl AS (SELECT q.row_id, q.code, coalesce(g.sentiment + 1, 0) AS label, CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 ELSE sentiment_ + 1 END AS pred FROM (SELECT *, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS sentiment_ FROM probs) q JOIN prows USING (row_id) LEFT JOIN goldp g ON g.row_id = q.row_id AND g.code = q.code), "
        f"pcl AS (SELECT c, n, count(*) FILTER (label = c AND pred = c) AS tp, count(*) FILTER (label = c) AS gn, count(*) FILTER (pred = c) AS pn FROM pl CROSS JOIN (VALUES (0, 'absent'), (1, 'neutral'), (2, 'positive'), (3, 'negative')) k(c, n) GROUP BY c, n)"
    )
    f1c = div("2 * tp", "gn + pn")
    sql["pair_class_report"] = build(f"SELECT c AS model_class, n AS class_name, gn AS support, pn AS predicted, {r6(div('tp', 'pn'))} AS precision, {r6(div('tp', 'gn'))} AS recall, {r6(f1c)} AS f1 FROM pcl", "probs", "prows", "goldp", extra=pm)
    sql["pair_metrics"] = build(
        f"SELECT n_pairs, {r6('acc')} AS accuracy, {r6('ma')} AS macro_f1, {r6('wa')} AS weighted_f1, {r6(div('tp', 'pn'))} AS presence_precision, {r6(div('tp', 'gn'))} AS presence_recall, {r6(div('2 * tp', 'gn + pn'))} AS presence_f1, {r6('sa')} AS sentiment_accuracy_on_gold_pairs FROM pa, pb",
        "probs", "prows", "goldp",
        extra=pm + ", pa AS (SELECT count(*) AS n_pairs, avg((label = pred)::INT) AS acc, count(*) FILTER (label > 0 AND pred > 0) AS tp, count(*) FILTER (label > 0) AS gn, count(*) FILTER (pred > 0) AS pn, avg((label = pred)::INT) FILTER (label > 0) AS sa FROM pl), "
              f"pb AS (SELECT avg(f) AS ma, sum(f * gn) / sum(gn) AS wa FROM (SELECT {f1c} AS f, gn FROM pcl WHERE gn + pn > 0))")
    sql["matched_pairs"] = build("SELECT row_id, code, gc - 1 AS sentiment FROM pcells WHERE gc > 0 AND gc = pc", "pcells").replace("gc - 1 AS", "(gc - 1)::INT AS")
    sql["densified_scores"] = build(f"SELECT row_id, code, {r6('CASE WHEN l.doc_id IS NULL THEN 1 ELSE p0 END')} AS p_absent, {r6('CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 - p0 END')} AS presence FROM probs LEFT JOIN labels l ON l.doc_id = row_id", "probs")
    # text
    sql["word_ngrams"] = build("SELECT row_id, term, tf FROM wterms", "wterms")
    sql["char_ngrams"] = build("SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM cterms GROUP BY term", "cterms")
    sql["vocabulary"] = build("SELECT space, term, df, cf::BIGINT AS cf FROM vocab", "vocab")
    sql["tfidf_weights"] = build(
        "SELECT row_id, space, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id, space)), 5) + 0.0::DOUBLE AS weight FROM (SELECT t.row_id, t.space, t.term, (1 + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS w FROM terms t JOIN vocab v USING (space, term))", "vocab")
    sql["linear_scores_given"] = build(
        "SELECT d.doc_id AS row_id, k.code, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE round(1 / (1 + exp(-(coalesce(m, 0) + (k.ord % 3 - 1) / 2.0::DOUBLE))), 4) END + 0.0::DOUBLE AS score "
        "FROM documents d CROSS JOIN cb k LEFT JOIN lm ON lm.row_id = d.doc_id AND lm.code = k.code", "vocab", "cb",
        extra="lx AS (SELECT *, row_number() OVER (ORDER BY space DESC, term) - 1 AS idx, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1 AS idf FROM vocab), "
        "lf AS (SELECT row_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY row_id, space)) AS v FROM (SELECT t.row_id, t.space, idx, (1 + ln(tf::DOUBLE)) * idf AS w FROM terms t JOIN lx USING (space, term))), "
        "lm AS (SELECT row_id, code, sum(v * ((idx * 7 + ord * 13) % 21 - 10) / 10.0::DOUBLE) AS m FROM lf CROSS JOIN cb GROUP BY row_id, code)")
    labelled = ", ".join(BLOCKS[n][0] for n in ("wterms", "cterms", "vocab")).replace("doc_id AS row_id", "row_id").replace("lower(text)", "lower(answer)").replace("FROM documents", "FROM wide")
    sql["model_summary"] = build(
        "SELECT count(*) AS n_features, count(*) FILTER (space = 'word') AS n_word_features, count(*) FILTER (space = 'char') AS n_char_features, (SELECT count(DISTINCT code) FROM long)::INT AS n_classes FROM vocab",
        "long", extra=labelled)
    sides = (
        "lk AS (SELECT DISTINCT row_id FROM terms JOIN vocab USING (space, term)), lt AS (SELECT count(*) AS total FROM lk), "
        "lc AS (SELECT code, count(*) AS positives FROM long JOIN lk USING (row_id) GROUP BY code), "
        "lq AS (SELECT code, coalesce(positives, 0) AS positives, total - coalesce(positives, 0) AS negatives, total FROM (SELECT DISTINCT code FROM long) LEFT JOIN lc USING (code), lt)"
    )
    weigh = lambda c: f"round(CASE WHEN {c} > 0 THEN total / (2.0::DOUBLE * {c}) ELSE 1 END, 6) + 0.0::DOUBLE"
    sql["linear_optimality"] = build(
        f"SELECT code, positives, negatives, {weigh('positives')} AS positive_weight, {weigh('negatives')} AS negative_weight, true AS at_optimum FROM lq", "long", extra=labelled + ", " + sides)
    sql["multi_hot_labels"] = build("SELECT row_id, code, 1 AS label FROM long WHERE code <> 'A1'", "long")
    # projection
    sql["projection_index"] = build(
        "SELECT target, n, 0::DOUBLE AS mean_x, 0::DOUBLE AS mean_y, 0::DOUBLE AS covariance, true AS ordered, (SELECT round(sum(v), 5) FROM (SELECT var_pop(v) AS v FROM unit GROUP BY i)) AS total, true AS within "
        "FROM (SELECT 'examples' AS target, count(*) AS n FROM vecs UNION ALL SELECT 'codes', count(DISTINCT code) FROM vecs UNION ALL SELECT 'parents', count(DISTINCT parent_code) FROM vecs)", "unit", "vecs")
    sql["minmax_scaled"] = f"SELECT doc_id, n_chars, {r6('960::DOUBLE + (n_chars - min(n_chars) OVER ()) * (-920)::DOUBLE / (max(n_chars) OVER () - min(n_chars) OVER ())')} AS y FROM documents"
    sql["projection_sample"] = build("SELECT row_id, code FROM vecs ORDER BY md5('42|' || row_id) LIMIT 300", "vecs")
    sql["centroid_points"] = build(
        "SELECT code, name AS code_name, parent_code, parent_name, n AS n_examples, 'subcategory_centroid' AS point_type, 7 AS point_radius, 'subcategory_centroid: ' || code || ' ' || name || '; n_examples=' || n AS text FROM cb JOIN (SELECT code, count(*) AS n FROM vecs GROUP BY code) USING (code) UNION ALL "
        "SELECT parent_code, parent_name, parent_code, parent_name, n, 'parent_centroid', 7, 'parent_centroid: ' || parent_code || ' ' || parent_name || '; n_examples=' || n FROM (SELECT DISTINCT parent_code, parent_name FROM cb) JOIN (SELECT parent_code, count(*) AS n FROM vecs GROUP BY parent_code) USING (parent_code)", "cb", "vecs")
    # annotation
    rendered = "\n".join(f"{c}. Категория: {pn}. Подкатегория: {n}" for _, c, n, _, pn in views.CODEBOOK)
    prompt = system_prompt(rendered, views.CODES).replace("'", "''")
    user = USER_PROMPT.replace("\n", "' || chr(10) || '")
    cell = f"CASE WHEN {strip('context')} <> '' THEN 'Контекст: ' || {strip('context')} || chr(10) || 'Ответ: ' || ap ELSE ap END"
    ap = f"CASE WHEN contains({strip('answer')}, ';') THEN {strip(f'split_part({strip(chr(97) + chr(110) + chr(115) + chr(119) + chr(101) + chr(114))}, chr(59), 1)')} ELSE {strip('answer')} END"
    sql["llm_requests"] = build(f"SELECT row_id, {strip('answer')} <> '' AS filled, md5('{prompt}') AS system, '{user}' || CAST(to_json({cell}) AS VARCHAR) AS user_prompt FROM (SELECT *, {ap} AS ap FROM resp)", "resp")
    sql["llm_parsed"] = build(
        "SELECT r.row_id, coalesce(l.t, '') AS labels, coalesce(v.n, 0)::INT AS n_invalid, coalesce(v.t, '') AS invalid, l.t IS NULL OR v.n IS NOT NULL AS needs_review FROM repl r LEFT JOIN (SELECT row_id, string_agg(code || ':' || s, ',' ORDER BY rn) AS t FROM labs GROUP BY row_id) l USING (row_id) LEFT JOIN (SELECT row_id, count(*) AS n, string_agg(invalid, ',' ORDER BY i) AS t FROM inv GROUP BY row_id) v USING (row_id)",
        "repl", extra=replies_blocks())
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SENTIMENT_NAMES))
    sql["llm_columns"] = build(
        "SELECT r.row_id, coalesce(c, 'UNKNOWN') AS predicted_codes, coalesce(nm, 'UNKNOWN') AS predicted_names, coalesce(pc, '') AS predicted_parent_codes, coalesce(pn, '') AS predicted_parent_names, coalesce(st, '') AS predicted_sentiments, coalesce(cs, 'UNKNOWN') AS predicted_code_sentiments, coalesce(sn, '') AS predicted_sentiment_names, coalesce(cs, '') AS top_candidates, c IS NULL OR v.t IS NOT NULL AS needs_review, coalesce(v.t, '') AS invalid_codes, r.llm_error FROM repl r"
        " LEFT JOIN c2 USING (row_id) LEFT JOIN (SELECT row_id, string_agg(invalid, ', ' ORDER BY i) AS t FROM inv GROUP BY row_id) v USING (row_id)", "repl", "cb",
        extra=replies_blocks() + ", c1 AS (SELECT l.*, k.name, k.parent_code, k.parent_name, row_number() OVER (PARTITION BY row_id, k.parent_code ORDER BY rn) = 1 AS newp FROM labs l JOIN cb k USING (code)), "
              f"c2 AS (SELECT row_id, string_agg(code, ', ' ORDER BY rn) AS c, string_agg(name, '; ' ORDER BY rn) AS nm, string_agg(parent_code, ', ' ORDER BY rn) FILTER (newp) AS pc, string_agg(parent_name, '; ' ORDER BY rn) FILTER (newp) AS pn, string_agg(CAST(s AS VARCHAR), ', ' ORDER BY rn) AS st, string_agg(code || ':' || s, ', ' ORDER BY rn) AS cs, string_agg(code || ':' || CASE s {names} END, '; ' ORDER BY rn) AS sn FROM c1 GROUP BY row_id)")
    sql["run_statistics"] = build(
        f"SELECT count(*) AS input_rows, count(*) FILTER (llm_error = '') AS successful_rows, count(*) FILTER (llm_error <> '') AS failed_rows, count(*) FILTER (rev) AS needs_review_rows, {r6('avg(rev::INT)')} AS needs_review_rate, {r6('sum(round(latency_seconds, 4))')} AS latency_seconds_total, {r6('avg(round(latency_seconds, 4))')} AS latency_seconds_mean,"
        f" {r6('quantile_cont(round(latency_seconds, 4), 0.5)')} AS latency_seconds_p50, {r6('quantile_cont(round(latency_seconds, 4), 0.95)')} AS latency_seconds_p95, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, 12.5::DOUBLE AS wall_time_seconds, {r6('count(*) / 12.5::DOUBLE')} AS throughput_rows_per_second, 8 AS concurrency"
        " FROM (SELECT r.*, NOT EXISTS (SELECT 1 FROM labs l WHERE l.row_id = r.row_id) OR EXISTS (SELECT 1 FROM inv v WHERE v.row_id = r.row_id) AS rev FROM repl r)", "repl", extra=replies_blocks())
    sql["evaluate_saved"] = build(
        f"SELECT (SELECT count(*) FROM repl) AS input_rows, (SELECT count(*) FROM erows) AS evaluated_rows, (SELECT count(*) FROM repl) - (SELECT count(*) FROM erows) AS rows_without_known_gold_codes, x.* EXCLUDE (n_rows), j.* EXCLUDE (n_rows), o4.top1 AS single_label_top1_accuracy, o5.* FROM x, j, o4, o5", "repl", "cb",
        extra=evaluated_blocks() + f", {renamed('ecell', 'x')}, {renamed('jcell', 'j')}, {as_row('x', OVERALL_COLS + ', ' + r6('unk') + ' AS unknown_prediction_rate')}, {as_row('j', joint_names)}, "
        f"o4 AS (SELECT {r6('avg(coalesce(t.code = g.c, false)::INT)')} AS top1 FROM (SELECT row_id, min(code) AS c FROM egc GROUP BY row_id HAVING count(*) = 1) g LEFT JOIN (SELECT row_id, code FROM labs WHERE rn = 1) t USING (row_id)), "
        f"o5 AS (SELECT {r6('sum(hit)::DOUBLE / sum(pairs)')} AS gold_code_sentiment_accuracy, {r6('sum(hit)::DOUBLE / sum(found)')} AS detected_gold_sentiment_accuracy, (SELECT count(*) FROM egc) AS gold_codes, (SELECT count(*) FROM egc JOIN epc USING (row_id, code)) AS detected_gold_codes, sum(pairs)::BIGINT AS gold_code_sentiment_pairs, sum(found)::BIGINT AS gold_pairs_with_detected_code FROM sacc)")
    sql["evaluate_job"] = build(
        f"SELECT code, gn AS support, {r6(div('tp', 'pn'))} AS precision, {r6(div('tp', 'gn'))} AS recall, {r6(div('2 * tp', 'gn + pn'))} AS f1, {r6('hit::DOUBLE / pairs')} AS gold_code_sentiment_accuracy, CASE WHEN found > 0 THEN {r6('hit::DOUBLE / found')} END AS detected_gold_sentiment_accuracy FROM (SELECT code, count(*) FILTER (g AND p) AS tp, count(*) FILTER (g) AS gn, count(*) FILTER (p) AS pn FROM ecell GROUP BY code) LEFT JOIN sacc USING (code)",
        "repl", "cb", extra=evaluated_blocks())
    echo = f"'{user}' || CAST(to_json(text) AS VARCHAR)"
    echoed = "SELECT row_id, CASE WHEN answer = '' THEN 'UNKNOWN' ELSE c END AS predicted_codes, CASE WHEN answer = '' THEN 'UNKNOWN' ELSE c || ':' || n % 3 END AS predicted_code_sentiments, answer = '' AS needs_review, CASE WHEN answer = '' THEN 'empty_text' ELSE '' END AS llm_error, CASE WHEN answer = '' THEN 0 ELSE n END AS prompt_tokens, CASE WHEN answer = '' THEN 0 ELSE 7 END::BIGINT AS completion_tokens"
    turns = f" FROM (SELECT *, {CODE_LIST}[1 + n % 10] AS c FROM (SELECT row_id, answer, len({echo}) AS n FROM srow))"
    sql["fan_out_echo"] = build(echoed + turns, "resp", extra=SCORER_ROWS)
    sql["annotate_resumed"] = build(echoed + ", CASE WHEN answer = '' THEN 0 ELSE 1 END::BIGINT AS times_answered" + turns, "resp", extra=SCORER_ROWS)
    # scorers, streaming, stores
    sql["stub_scores_multilabel"] = build(f"SELECT row_id, code, {r6(f'CASE WHEN answer = {chr(39) * 2} THEN 0 ELSE {STUB} END')} AS score FROM srow CROSS JOIN cb", "resp", "cb", extra=SCORER_ROWS)
    sql["stub_scores_pairs"] = build("SELECT row_id, code, (i - 1)::INT AS pair_class, round([p0, p1, p2, p3][i], 6) + 0.0::DOUBLE AS p FROM sprob CROSS JOIN range(1, 5) t(i)", "resp", "cb", extra=stub_pairs())
    sql["rescored_codebook"] = build(
        f"SELECT row_id, rn::INT AS rank, code, {r6('sc')} AS score, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS sentiment FROM (SELECT *, 1::DOUBLE - p0 AS sc, row_number() OVER (PARTITION BY row_id ORDER BY 1::DOUBLE - p0 DESC, code) AS rn FROM sprob) WHERE sc >= 0.5 AND rn <= 3",
        "resp", "cb", extra=stub_pairs(" (new)", "k.parent_code <> 'B'"))
    sql["classified_by_scorer"] = build(
        "SELECT f2.*, resp.context, resp.lang FROM f2 JOIN resp USING (row_id)", "resp", "cb",
        extra=SCORER_ROWS + f", ms AS (SELECT row_id, code, CASE WHEN answer = '' THEN 0 ELSE {STUB} END AS score FROM srow CROSS JOIN cb), mr AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, code) AS rn FROM ms), " + frame("mr", "; ", "false"))
    sql["incremental_scored"] = build(f"SELECT row_id, code, CASE WHEN text = '' THEN 0 ELSE {STUB} END AS score FROM (SELECT doc_id AS row_id, {strip('text')} AS text FROM documents) CROSS JOIN cb", "cb")
    sql["source_roundtrip"] = build(f"SELECT row_id, context, raw_codes, {strip('answer')} AS answer FROM resp", "resp")
    sql["source_one_file"] = build(f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, row_id AS row_key, context, raw_codes, {strip('answer')} AS answer FROM resp", "resp")
    sql["codebook_file"] = "SELECT 'R' || r_regionkey || 'N' || n_nationkey AS code, n_name AS name, 'R' || r_regionkey AS parent_code, CASE WHEN r_regionkey > 0 THEN r_name ELSE '' END AS parent_name FROM nation JOIN region ON n_regionkey = r_regionkey"
    sql["report_files"] = sql["evaluate_job"]
    of_train = ", ".join(BLOCKS[n][0] for n in ("wterms", "cterms", "vocab")).replace("doc_id AS row_id", "row_id").replace("lower(text)", "lower(answer)").replace("FROM documents", "FROM wide JOIN assigned USING (row_id) WHERE split = 'train'")
    # The words of the character n-grams have a condition of their own.
    of_train = of_train.replace("WHERE split = 'train') WHERE w <> ''", "WHERE split = 'train') AS train WHERE w <> ''")
    sql["text_model_job"] = build(
        "SELECT split || '_rows' AS fact, count(*) AS n FROM assigned GROUP BY split UNION ALL SELECT 'n_classes', count(DISTINCT code) FROM long UNION ALL SELECT 'n_features', count(*) FROM vocab UNION ALL SELECT 'rows_read', count(*) FROM resp",
        "long", "strat", extra=SPLIT + ", " + of_train)
    sql["index_job"] = build(
        "SELECT count(*) AS n_examples, count(DISTINCT code) AS n_subcategory_centroids, count(DISTINCT parent_code) AS n_parent_centroids, 256::BIGINT AS embedding_dim FROM long JOIN assigned USING (row_id) JOIN cb USING (code) WHERE split = 'train'",
        "long", "strat", "cb", extra=SPLIT)
    sql["row_identity"] = "SELECT count(*) AS n_rows, count(*) AS n_distinct, 0::BIGINT AS first, count(*) - 1 AS last, count(*) + 1 AS last_source_row FROM events"
    sql["store_roundtrip"] = build(
        "SELECT row_id, split, split AS assigned, CASE WHEN len(ps) = 0 THEN 'UNKNOWN' ELSE array_to_string(list_transform(ps, lambda p: p.code), ', ') END AS codes, array_to_string(list_transform(ps, lambda p: CAST(p.s AS VARCHAR)), ', ') AS sentiments, CASE WHEN len(ps) = 0 THEN 'UNKNOWN' ELSE array_to_string(list_transform(ps, lambda p: p.code || ':' || p.s), ', ') END AS code_sentiments FROM ann JOIN assigned USING (row_id)",
        "ann", extra="strat AS (SELECT row_id, CASE WHEN len(ps) = 0 THEN 'UNKNOWN' ELSE ps[1].code || ':' || ps[1].s END AS stratum FROM ann WHERE status = 'ok' AND answer <> ''), " + SPLIT)
    quality = "qr AS (SELECT row_id, code, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 4) DESC, rn) AS rn, round(score, 4) AS score FROM crank WHERE rn <= 5), qc AS (SELECT v.row_id, k.code, v.code = k.code AS g, q.code IS NOT NULL AS p FROM vecs v CROSS JOIN cb k LEFT JOIN (SELECT * FROM qr WHERE score >= 0.3 AND rn <= 2) q ON q.row_id = v.row_id AND q.code = k.code), "
    sql["centroid_quality"] = build(
        f"SELECT {OVERALL_COLS}, {r6('top1')} AS single_label_top1_accuracy, {r6('unk')} AS unknown_prediction_rate FROM o1, o2, o3, o4", "crank", "cb", "vecs",
        extra=quality + overall("qc") + ", o4 AS (SELECT avg(coalesce(q.code = v.code, false)::INT) AS top1 FROM vecs v LEFT JOIN (SELECT * FROM qr WHERE rn = 1 AND score >= 0.3) q USING (row_id))")
    return sql
