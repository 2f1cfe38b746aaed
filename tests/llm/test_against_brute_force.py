"""Operators without SQL against plain Python, and the registered queries against their SQL."""

import contextlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import exact_dedup, ngram_join, pieces, quality, substring_dedup, token_counts, toxicity
from codeloom.llm import words as W
from codeloom.llm.components import components
from codeloom.llm.oracle import ORACLES
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)

    def key(row):
        return [str(round(v, 9)) if isinstance(v, float) else str(v) for v in row]

    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.fetchall()))


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(n, n + 1) for n in range(1000, 1040)] + [(5, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: root(x) for a, b in links if b is not None and a != b for x in (a, b)}


def test_near_copies_in_chains(spark):
    """Copies with growing changes link in chains; the components must be those of all pairs."""
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(6):
        base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            rows.append((n, " ".join(base)))
            n += 1
            at = rng.randrange(100)
            size = rng.choice([1, 2, 3, 3, 12, 25])
            base = base[:at] + [f"t{rng.randrange(10**6)}" for _ in range(size)] + base[at + size :]
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in label):
            break
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(set(label.values())) > 6 and got == label


def test_every_exact_repeat_of_fifty_words_is_found(spark):
    docs = {r.doc_id: WORD.findall(lower(r.text)) for r in table(spark, "documents").collect()}
    owners = defaultdict(set)
    for i, words in docs.items():
        for p in range(len(words) - 49):
            owners[tuple(words[p : p + 50])].add(i)
    for r in substring_dedup.repeated_passages(table(spark, "documents")).collect():
        words = docs[r.doc_id]
        assert r.n_words == len(words)
        true = {q for p in range(len(words) - 49) if len(owners[tuple(words[p : p + 50])]) > 1 for q in range(p, p + 50)}
        got = {q for s in r.spans for q in range(s.low, s.high)}
        assert true <= got and len(got) == r.n_repeated
        assert all(s.high - s.low >= 50 for s in r.spans)


def test_compact_windows_cover_every_range():
    rng = np.random.default_rng(1)
    for size in (5, 40, 90):
        values = rng.integers(0, 30, size).astype(np.uint64)
        windows = substring_dedup.compact_windows(values, 5)
        for i in range(size):
            for j in range(i + 5, size + 1):
                holding = [w for w in windows if w[1] <= i <= w[0] < j <= w[2]]
                assert len(holding) == 1 and values[holding[0][0]] == values[i:j].min()


def test_sampled_segmentations_follow_the_weights():
    """Frequencies of all segmentations of a word against their exact probabilities."""
    model = pieces.load_model()
    text, draws = "then", 20_000
    ids, bounds = pieces.encode_texts(model, [text] * draws, W.mix(np.arange(draws, dtype=np.uint64)))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    spelled = {s: i for i, s in enumerate(model.spelled) if s and i not in set(model.byte_ids.tolist())}

    def ways(rest):
        if not rest:
            return [()]
        return [(spelled[rest[:k]], *more) for k in range(1, len(rest) + 1) if rest[:k] in spelled for more in ways(rest[k:])]

    chances = {w: math.exp(sum(model.weights[i] for i in w)) for w in ways(b" " + text.encode())}
    total = sum(chances.values())
    assert set(seen) <= set(chances)
    for way, chance in chances.items():
        expected = chance / total
        assert abs(seen[way] / draws - expected) < 5 * math.sqrt(expected * (1 - expected) / draws) + 1e-4


def test_tokens_add_up_and_crossing_rules():
    ends = np.array([3, 5, 9, 12])
    starts, stops = np.array([0, 4, 10]), np.array([4, 10, 12])
    count = {rule: token_counts.attribute(ends, starts, stops, rule)[0].tolist() for rule in token_counts.RULES}
    # Token (3, 5) lies half in the first and half in the second section, token (9, 12) by a third in the second.
    assert count["first"] == [2, 2, 0] and count["most"] == [2, 1, 1]
    assert count["share"] == [1.5, pytest.approx(0.5 + 1 + 1 / 3), pytest.approx(2 / 3)]


def test_token_counts_of_lines(spark):
    encoding = token_counts.load_encoding(token_counts.RANKS)
    rows = defaultdict(list)
    for r in token_counts.token_counts(table(spark, "documents"), rule="first").collect():
        rows[r.doc_id].append(r)
    for r in table(spark, "documents").collect():
        raw, spot, per_line = r.text.encode(), 0, Counter()
        for token in encoding.encode_ordinary(r.text):
            per_line[raw[:spot].count(b"\n")] += 1
            spot += len(encoding.decode_single_token_bytes(token))
        assert {x.section: x.n_tokens for x in rows[r.doc_id] if x.n_tokens} == per_line


def test_sections_by_characters(spark):
    df = spark.createDataFrame([(1, "über alles")], "doc_id int, text string").selectExpr("*", "array(named_struct('start', 0, 'end', 4), named_struct('start', 5, 'end', 10)) AS parts")
    rows = token_counts.token_counts(df, sections_col="parts", rule="share").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 5), (6, 11)] and rows[1].n_crossing == 1




def test_quality_and_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for scored, label in ((quality.quality_scores(docs, labels), "quality"), (toxicity.toxicity_scores(docs, labels), "toxic")):
        rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
        assert sum(p == y for p, y in rows) / len(rows) > 0.9


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    spoiled = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 1 - quality, quality) AS quality")
    a, b = (sorted(map(str, quality.quality_scores(docs, x).collect())) for x in (labels, spoiled))
    assert a == b


def test_pipeline_stages_against_single_operators(spark, tmp_path):
    docs = table(spark, "documents")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if n < 4:
            assert docs.columns == before.columns
        if n == 0:
            want = quality.quality_scores(before, table(spark, "labels")).filter("predicted = 1")
        elif n == 1:
            want = exact_dedup.exact_dedup(before).filter("kept")
        elif n == 2:
            want = ngram_join.similar_documents(before).filter("component_id = doc_id")
        elif n == 3:
            items = [WORD.findall(lower(r.text)) for r in table(spark, "benchmark").collect()]
            grams = {tuple(w[p : p + min(13, len(w))]) for w in items for p in range(max(1, len(w) - 12)) if w}
            keep = []
            for r in before.collect():
                words = WORD.findall(lower(r.text))
                hit = {q for size in {len(g) for g in grams} for p in range(len(words) - size + 1) if tuple(words[p : p + size]) in grams for q in range(p, p + size)}
                if not hit or 20 * len(hit) < len(words):
                    keep.append(r.doc_id)
            assert ids == sorted(keep)
            continue
        else:
            want = before
            assert docs.filter("NOT lossless").isEmpty()
        assert ids == sorted(r.doc_id for r in want.select("doc_id").collect())


def _fresh(tag, n):
    return [f"{tag}{k}" for k in range(n)]


def test_exact_repeats_where_the_first_document_has_only_a_part(spark):
    """The smallest and the largest id of the lists hold a quotation; two documents between them share the whole passage."""
    rows, want = [], {}
    for case in range(40):
        base, shared = 10 * case, _fresh(f"s{case}x", 60)
        rows += [
            (base, " ".join(_fresh(f"a{case}x", 40) + shared[:40] + _fresh(f"b{case}x", 40))),
            (base + 1, " ".join(_fresh(f"c{case}x", 30) + shared + _fresh(f"d{case}x", 70))),
            (base + 2, " ".join(_fresh(f"e{case}x", 55) + shared + _fresh(f"f{case}x", 20))),
            (base + 3, " ".join(_fresh(f"g{case}x", 40) + shared[20:] + _fresh(f"h{case}x", 40))),
        ]
        want |= {base: ([], base), base + 1: ([(30, 90)], base + 1), base + 2: ([(55, 115)], base + 1), base + 3: ([], base + 3)}
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: ([(s.low, s.high) for s in r.spans], r.class_id) for r in got} == want


def test_the_first_document_keeps_what_it_shares_with_a_middle_one(spark):
    rows, want = [], {}
    for case in range(30):
        base, shared = 10 * case, _fresh(f"s{case}x", 90)
        rows += [
            (base, shared), (base + 1, _fresh(f"a{case}x", 20) + shared),
            (base + 2, _fresh(f"b{case}x", 20) + shared[:44] + _fresh(f"c{case}x", 40) + shared[48:] + _fresh(f"d{case}x", 20)),
        ]
        want |= {base: [(0, 90)], base + 1: [(20, 110)], base + 2: []}
    got = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()
    assert {r.doc_id: [(s.low, s.high) for s in r.spans] for r in got} == want


def test_exact_repeats_where_the_first_document_has_a_part_earlier(spark):
    """The smallest id holds most of the passage once more before it; the other document still keeps all of the passage."""
    rows = []
    for case in range(40):
        shared = _fresh(f"s{case}x", 60)
        rows += [(2 * case, _fresh(f"a{case}x", 20) + shared[:45] + _fresh(f"b{case}x", 60) + shared), (2 * case + 1, _fresh(f"c{case}x", 30) + shared + _fresh(f"d{case}x", 30))]
    got = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()
    spans = {r.doc_id: [(s.low, s.high) for s in r.spans] for r in got}
    assert all(any(lo <= 125 and hi >= 185 for lo, hi in spans[2 * case]) and spans[2 * case + 1] == [(30, 90)] for case in range(40))


def test_near_repeats_between_the_ends_of_a_list(spark):
    """The smallest and the largest id have a part of each passage; texts between them share all of it but for one word."""
    rows, want = [], {}
    for case in range(20):
        base, shared = 10 * case, _fresh(f"s{case}x", 64)
        changed = [*shared[:40], f"other{case}", *shared[41:]]
        rows += [
            (base, _fresh(f"a{case}x", 20) + shared[5:35] + _fresh(f"b{case}x", 30)),
            (base + 1, _fresh(f"c{case}x", 30) + shared + _fresh(f"d{case}x", 20)),
            (base + 2, _fresh(f"e{case}x", 45) + changed + _fresh(f"f{case}x", 10)),
            (base + 3, _fresh(f"g{case}x", 20) + shared[5:35] + _fresh(f"h{case}x", 30)),
        ]
        want |= {base: ([], base, 0), base + 1: ([(30, 94)], base + 1, 1), base + 2: ([(45, 109)], base + 1, 1), base + 3: ([], base + 3, 0)}
    got = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()
    assert {r.doc_id: ([(s.low, s.high) for s in r.spans], r.class_id, r.n_links) for r in got} == want


@pytest.mark.parametrize("most", [64, 3])
def test_links_of_near_copies_and_long_documents(spark, most):
    """Copies count as links; a document of many blocks is compared where its passages are; lists are divided where they are long."""
    base = _fresh("p", 120)
    near = [[*base[: 30 + n], f"new{n}", *base[31 + n :]] for n in range(5)]
    long = _fresh("q", 2000) + base + _fresh("r", 2500) + _fresh("s", 100) + _fresh("t", 10)
    texts = [base, base, *near, long, _fresh("u", 60) + long[4620:4720] + _fresh("v", 5)]
    rows = [(n, " ".join(w)) for n, w in enumerate(texts)]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), max_list=most).collect()}
    spans = {n: [(s.low, s.high) for s in r.spans] for n, r in got.items()}
    assert spans == {**{n: [(0, 120)] for n in range(7)}, 7: [(2000, 2120), (4620, 4720)], 8: [(60, 160)]}
    assert {r.class_id for r in got.values()} == {0}
    if most == 64:
        assert [got[n].n_links for n in range(9)] == [7] * 7 + [8, 1]


@pytest.mark.parametrize("block", [512, 9])
def test_near_repeats_inside_a_long_list(spark, monkeypatch, block):
    """Eighty texts have a line of 26 words; some pairs among them go on alike after a changed word, in one block or in several."""
    monkeypatch.setattr(substring_dedup, "PAIR_BLOCK", block)
    line, rows, want = _fresh("line", 26), [], {}
    for n in range(80):
        more = [f"changed{n}", *_fresh(f"p{n // 2}x", 40)] if n % 10 < 2 else _fresh(f"o{n}x", 41)
        rows.append((n, " ".join(_fresh(f"a{n}x", n % 7) + line + more + _fresh(f"z{n}x", 15))))
        want[n] = ([(n % 7, n % 7 + 67)], n // 2 * 2, 1) if n % 10 < 2 else ([], n, 0)
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: ([(s.low, s.high) for s in r.spans], r.class_id, r.n_links) for r in got} == want


def test_equal_ranges_split_at_the_same_place():
    """Values that repeat: a range has its minimum at the same place whatever stands around it."""
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 3, 40).astype(np.uint64)
    for size in (0, 700):
        before, after = (rng.integers(0, 3, size + n).astype(np.uint64) for n in (9, 30))
        places = set()
        for left, right in ((0, 0), (len(before), len(after))):
            values = np.concatenate([before[:left], shared, after[:right]])
            holding = [w for w in substring_dedup.compact_windows(values, 20) if w[1] <= left <= w[0] < left + 40 <= w[2]]
            places |= {c - left for c, _, _ in holding}
            assert len(holding) == 1
        assert len(places) == 1


def test_shortest_seed_of_a_near_repeat():
    assert substring_dedup.seed_length(50, 5, 80) == 20 and substring_dedup.seed_length(50, 5, 100) == 46
    grams = np.arange(1000, dtype=np.uint64)
    for c in range(40, 60):
        a = substring_dedup.marks_around(grams, np.array([c]), np.array([40]), np.array([60]), 20)[0]
        b = substring_dedup.marks_around(grams, np.array([c]), np.array([0]), np.array([100]), 20)[0]
        assert any((a >> 12 * n) & 4095 and (a >> 12 * n) & 4095 == (b >> 12 * n) & 4095 for n in range(5))


def test_a_passage_goes_on_without_its_first_run():
    """All three runs together are below the threshold; the last is too short alone, and long enough with the second."""
    first, second, third = (W.mix(np.arange(low, low + n, dtype=np.uint64)) for low, n in ((100, 20), (200, 44), (300, 45)))
    new = lambda low: W.mix(np.arange(low, low + 4, dtype=np.uint64))
    own, other = np.concatenate([first, new(400), second, new(500), third]), np.concatenate([first, second, new(600), third])
    assert substring_dedup.verified_spans(own, other) == [(0, 117)]
    assert substring_dedup.verified_spans(own[24:], other) == [(0, 93)]


def test_texts_are_looked_up_in_one_way_at_any_size(spark, monkeypatch):
    """No step sends what it wants to all tasks by a count of its own, and the rows of a text are counted once."""
    plans, write = {}, substring_dedup.materialize

    def kept(df, label):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            df.explain(True)
        plans[label] = said.getvalue()
        return write(df, label)

    monkeypatch.setattr(substring_dedup, "materialize", kept)
    shared = _fresh("s", 60)
    rows = spark.createDataFrame([(i, " ".join(_fresh(f"a{i}x", 20) + shared)) for i in range(3)], "doc_id bigint, text string")
    assert [(s.low, s.high) for r in substring_dedup.repeated_passages(rows).collect() for s in r.spans] == [(20, 80)] * 3
    assert {"ranges", "passages", "repeats"} <= set(plans)
    assert not any("strategy=broadcast" in plan for plan in plans.values())
    assert [label for label, plan in plans.items() if "count(distinct" in plan] == ["text-owners"]


def test_plans_stay_small(spark, monkeypatch):
    """Each scan and each stage of a plan costs the driver memory, and those that may run at once cost it together."""
    plans, write = {}, substring_dedup.materialize

    def scans(df):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            df.explain()
        return said.getvalue().count("FileScan")

    def kept(df, label):
        plans[label] = max(scans(df), plans.get(label, 0))
        return write(df, label)

    monkeypatch.setattr(substring_dedup, "materialize", kept)
    monkeypatch.setattr("codeloom.llm.components.materialize", kept)
    shared = _fresh("s", 60)
    rows = spark.createDataFrame([(i, " ".join(_fresh(f"a{i}x", 20) + shared)) for i in range(5)], "doc_id bigint, text string")
    result = substring_dedup.repeated_passages(rows)
    plans["result"] = scans(result)
    assert [(s.low, s.high) for r in result.collect() for s in r.spans] == [(20, 80)] * 5
    assert {"regions", "repeats", "links"} <= set(plans) and max(plans.values()) <= 10, plans
