"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from codeloom.llm import licenses, url_filters

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql() -> str:
    def starts(t: licenses.Template) -> str:
        same = " AND ".join(f"w[i + {n + 1}] = '{word}'" for n, word in enumerate(t.key))
        return f"list_filter(range(len(w)), lambda i: {same})"

    def coverage(t: licenses.Template, n: int) -> str:
        hits = " + ".join(f"coalesce((CASE WHEN i + {at - t.key_at} >= 0 THEN w[i + {at - t.key_at + 1}] END = '{word}')::INT, 0)" for at, word in enumerate(t.words))
        return f"coalesce(list_max(list_transform(s{n}, lambda i: ({hits}) / {float(len(t.words))})), 0.0)::DOUBLE"

    templates = [*licenses.BASE, *licenses.LONG]
    base = range(len(licenses.BASE))
    found = ", ".join(f"{starts(t)} AS s{n}" for n, t in enumerate(templates))
    covered = ", ".join(f"{coverage(t, n)} AS c{n}" for n, t in enumerate(templates))
    every = "(" + " || ".join(f"s{n}" for n in base) + ")"
    labels = ", ".join(f"CASE WHEN len(s{n}) > 0 THEN '{templates[n].label}' END" for n in base)
    more = ", ".join(f"CASE WHEN c{n} >= {licenses.MIN_COVERAGE} THEN '{t.label}' END" for n, t in enumerate(templates) if n not in base)

    def joined(values: str) -> str:
        return f"array_to_string(list_sort(list_distinct([{values}])), ',')"

    return f"""
        WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
        s AS (SELECT doc_id, w, {found} FROM t),
        c AS (SELECT *, {covered} FROM s)
        SELECT doc_id, len(w)::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word,
          list_max({every})::BIGINT AS last_word, {joined(labels)} AS base_labels, {joined(labels + ', ' + more)} AS labels,
          greatest({', '.join(f'c{n}' for n in range(len(templates)))}) AS score
        FROM c"""


DEDUP_SQL = r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS nth,
      first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""

WARC_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS nth,
      first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first_id END AS refers_to FROM r"""

DECONTAMINATION_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS words
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM iw),
    dw AS (SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
    m AS (SELECT r, p, dw.size, item_id FROM dw JOIN iw USING (size, words)),
    hits AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS word FROM (SELECT DISTINCT r, p, size FROM m)) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

NGRAM_JOIN_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM pairs JOIN n AS p ON x = p.doc_id JOIN n AS q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
    reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)"""

HARD_NEGATIVES_SQL = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT a.r, a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.y, b.y)::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r AND len(a.y) = len(b.y) WHERE a.id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS n FROM s WHERE same QUALIFY n <= 5),
    m AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id,
        p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
    SELECT * FROM m"""

# CRC-32 of a feature's bytes, with the byte steps made from the polynomial.
RESAMPLING_SQL = f"""
    WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
    d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    i AS (SELECT {WORDS} AS w FROM benchmark),
    df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1])) AS f FROM d),
    tf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1])) AS f FROM i),
    known AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM tf)),
    hashed AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda p: ('0x' || substr(h, 2 * p + 1, 2))::BIGINT),
        lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM known, steps),
    s AS (SELECT bucket, count(*)::DOUBLE AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
    t AS (SELECT bucket, count(*)::DOUBLE AS t FROM tf JOIN hashed USING (f) GROUP BY bucket),
    sums AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS all_s, (SELECT count(*) FROM tf)::DOUBLE AS all_t),
    gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
    sized AS (SELECT r, sum(gain)::DOUBLE AS gain, count(*) AS n FROM df JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r),
    scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(gain / n), 0)::BIGINT AS weight,
      floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN sized USING (r)),
    ranked AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS eligible FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * eligible // 100 THEN place END AS rank
    FROM scored LEFT JOIN ranked USING (r)"""


def _url_sql() -> str:
    rules = sorted(url_filters.RULES, key=lambda r: (-len(r.name), r.name))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in rules]
    rule = " ".join(f"WHEN {fit} THEN '{r.name}'" for fit, r in zip(fits, rules, strict=True))
    ruled = " ".join(f"WHEN {fit} THEN '{r.verdict}'" for fit, r in zip(fits, rules, strict=True))
    verdicts = ("allow", "block")
    runs = ", ".join(
        f"sum({v}) OVER (PARTITION BY gram % {1 << 5 * n})::DOUBLE AS {v}_{n}, sum({v}) OVER (PARTITION BY (gram >> 5) % {1 << 5 * n})::DOUBLE AS {v}_after_{n}"
        for v in verdicts for n in (1, 2, 3)
    )

    def chance(v: str) -> str:
        known = f"(({v}_1 + 1) / (total_{v} + 32))"
        for n in (1, 2, 3):
            count = f"{v}_{n + 1}" if n < 3 else f"{v}::DOUBLE"
            known = f"(CASE WHEN {v}_after_{n} >= {url_filters.MIN_SEEN} THEN ({count} + {url_filters.STRENGTH} * {known}) / ({v}_after_{n} + {url_filters.STRENGTH}) ELSE {known} END)"
        return known

    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = ", ".join(f"'{d}'" for d in url_filters.CALIBRATION_DIGITS)
    return rf"""
        WITH p AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT *, coalesce({lowered.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
        j AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, substr(md5(coalesce(url, '')), 1, 1) IN ({digits}) AS kept_out,
          translate(regexp_replace({lowered.format("coalesce(rest, url, '')")}, '[^a-z0-9/.-]', chr(127), 'g'), '0123456789/.-', '{{{{{{{{{{{{{{{{{{{{|}}~') AS spelling FROM h),
        c AS (SELECT *, list_transform(string_split('```' || spelling || '`', ''), lambda x: ascii(x) - 96) AS codes FROM j),
        e AS (SELECT r, kept_out, ruled, unnest(list_transform(range(4, len(codes) + 1), lambda i: ((codes[i - 3] * 32 + codes[i - 2]) * 32 + codes[i - 1]) * 32 + codes[i]))::BIGINT AS gram FROM c),
        counts AS (SELECT gram, count(*) FILTER (NOT kept_out AND ruled = 'allow') AS allow, count(*) FILTER (NOT kept_out AND ruled = 'block') AS block FROM e GROUP BY gram),
        totals AS (SELECT sum(allow)::DOUBLE AS total_allow, sum(block)::DOUBLE AS total_block FROM counts),
        runs AS (SELECT *, {runs} FROM counts),
        gains AS (SELECT gram, floor(1000 * ln({chance('allow')} / {chance('block')}))::BIGINT AS gain FROM runs, totals),
        sums AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS score FROM e JOIN gains USING (gram) GROUP BY r),
        scored AS (SELECT c.*, CASE WHEN total_allow > 0 AND total_block > 0 THEN CASE WHEN spelling = '' THEN 0 ELSE score END END AS score FROM c JOIN sums USING (r), totals),
        histogram AS (SELECT score, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block FROM scored WHERE kept_out AND ruled IS NOT NULL GROUP BY score),
        steps AS (SELECT score, sum(allow) OVER o AS allow, sum(block) OVER o AS block, sum(allow) OVER () AS all_allow, sum(block) OVER () AS all_block FROM histogram
          WINDOW o AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
        cut AS (SELECT score AS cut FROM steps WHERE 100 * allow <= {url_filters.MAX_FALSE_PERCENT} * all_allow AND block * all_allow > allow * all_block
          ORDER BY block * all_allow - allow * all_block DESC, score LIMIT 1)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN spelling <> '' AND score <= (SELECT cut FROM cut) THEN 'block' ELSE 'allow' END) AS verdict, score FROM scored"""


ORACLES: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op7_exact_dedup": DEDUP_SQL,
    "op8_ngram_jaccard": NGRAM_JOIN_SQL,
    "op9_warc": WARC_SQL,
    "op10_decontaminate": DECONTAMINATION_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_resampling": RESAMPLING_SQL,
    "op13_url_filters": _url_sql(),
}
