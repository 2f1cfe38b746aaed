import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.operators import annotation as ann
from codeloom.operators import features as ft
from codeloom.operators import hashing, index, linear, mining


def test_hash_rank_equals_window_rank(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), hashing.hash_order(1, F.col("id")).alias("h"))
    ranked = hashing.hash_rank(df, ["g"], "h", digits=1).collect()
    for g in ("hot", "cold"):
        ordered = sorted((r["h"], r["rank"]) for r in ranked if r["g"] == g)
        assert [rank for _, rank in ordered] == list(range(len(ordered)))


def long_texts(spark, n):
    rows = [(i, f"text {i % (n - 3)}", c) for i in range(n) for c in (["A"] if i % 2 else ["A", "B"])]
    return spark.createDataFrame(rows, "row_id bigint, text string, code string")


@pytest.mark.parametrize("n,limit", [(14, 5000), (33, 40), (34, 40)])
def test_positive_pairs_are_distinct_pairs(spark, n, limit):
    found = [r for r in mining.positive_pairs(long_texts(spark, n), 4, limit, 3).collect() if r["code"] == "A"]
    texts = n - 3
    assert len(found) == min(texts * (texts - 1) // 2, limit)
    assert len({frozenset((r["text_a"], r["text_b"])) for r in found}) == len(found)
    assert all(r["text_a"] != r["text_b"] for r in found)


def test_negatives_and_triplets_against_brute_force(spark):
    long = long_texts(spark, 24)
    rows = long.collect()
    codes_of = {}
    for r in rows:
        codes_of.setdefault(r["row_id"], (r["text"], set()))[1].add(r["code"])
    candidates = {t for t, codes in codes_of.values() if "B" not in codes}
    own = {t for t, codes in codes_of.values() if "B" in codes}
    found = mining.contrastive_negatives(long, 4, 30, seed=5).collect()
    assert {r["code"] for r in found} == {"B"}  # every response carries A
    assert len(found) == 30 and len({(r["text_a"], r["text_b"]) for r in found}) == 30
    assert all(r["text_a"] in own and r["text_b"] in candidates and r["text_a"] != r["text_b"] for r in found)
    triples = mining.triplets(long, 4, 30, 5).collect()
    assert len(triples) == 30 and all(r["negative"] in candidates and r["anchor"] in own and r["positive"] in own for r in triples)


def all_candidates(rows, code):
    """Texts without the code, in the order of their digests, with their first row."""
    of = {}
    for r in rows:
        of.setdefault(r["text"], {}).setdefault(r["row_id"], set()).add(r["code"])
    texts = [t for t, uses in of.items() if any(code not in codes for codes in uses.values())]
    return [(t, min(of[t])) for t in sorted(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())]


def shared_texts(spark, n=60):
    """Texts with several responses, some of them with and some without a code; one code on two thirds of all."""
    rows = []
    for i in range(n):
        codes = {"HOT"} if i % 3 else {"COLD"}
        codes |= {"SOME"} if i % 4 == 0 else set()
        rows += [(i, f"text {i % 25}", c) for c in codes]
    return spark.createDataFrame(rows, "row_id bigint, text string, code string").repartition(4)


def test_candidates_by_position(spark):
    long = shared_texts(spark)
    rows = long.collect()
    got = {}
    for r in mining.negative_candidates(long, 2).collect():
        got.setdefault(r["code"], {})[r["k"]] = r["row"]
    for code in ("HOT", "COLD", "SOME"):
        want = [row for _, row in all_candidates(rows, code)]
        assert [got.get(code, {})[k] for k in range(len(want))] == want and len(got.get(code, {})) == len(want)
    found = mining.complements(mining.mining_tables(long), long.select("code"))
    # Back from the text to its place among the candidates.
    numbered = found.texts.select("g", "row")
    asked = mining.candidates_at(found, found.sizes.selectExpr("code", "explode(sequence(0L, n_candidates - 1)) AS k"))
    places = mining.candidate_positions(found, asked.withColumnRenamed("k", "wanted").join(numbered, "row").select("code", "g", "wanted"))
    assert places.where("k <> wanted").count() == 0 and places.count() == sum(len(v) for v in got.values())


def test_all_cells_of_small_classes(spark):
    """With more pairs wanted than there are, every pair of a text and a candidate that are not the same comes once."""
    long = shared_texts(spark)
    rows = long.collect()
    pairs = mining.contrastive_negatives(long, 2, 10_000, ratio=50.0, seed=3).collect()
    for code in ("HOT", "COLD", "SOME"):
        own = {r["text"] for r in rows if r["code"] == code}
        want = {(a, b) for a in own for b, _ in all_candidates(rows, code) if a != b}
        got = [(r["text_a"], r["text_b"]) for r in pairs if r["code"] == code]
        assert len(got) == len(set(got)) and set(got) == want
    few = mining.contrastive_negatives(long, 2, 10_000, ratio=50.0, cap=7, seed=3).collect()
    assert {c: sum(r["code"] == c for r in few) for c in ("HOT", "COLD", "SOME")} == {"HOT": 7, "COLD": 7, "SOME": 7}


def brute_force_terms(text):
    grams = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(3, min(5, len(padded)) + 1):
            grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return sorted(grams)


def test_char_ngrams(spark):
    text = "To be  or\tnot Üb a"
    df = spark.createDataFrame([(0, text)], "row_id bigint, text string")
    got = df.select(ft.char_wb_ngrams(F.col("text")).alias("g")).first()["g"]
    assert sorted(got) == brute_force_terms(text)
    counted = {r["term"]: r["tf"] for r in ft.char_terms(df).collect()}
    assert sum(counted.values()) == len(got)
    assert df.select(ft.word_ngrams(F.col("text")).alias("g")).first()["g"] == ["to", "be", "or", "not", "üb", "to be", "be or", "or not", "not üb"]


def test_counts_in_the_task_equal_counts_by_columns(spark, monkeypatch):
    texts = ["To be  or\tnot Üb a", "", None, "be be BE or", "_x 12 a1 日本語 ñandú", "a" * 300 + " \u00a0 x\x1cy", "or or not to be"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    filled = df.na.fill("", ["text"])
    want = {(r.space, r.term): (r.df, r.cf) for r in ft.vocabulary(ft.text_terms(filled), 1, None, None).collect()}
    assert {(r.space, r.term): (r.df, r.cf) for r in ft.term_counts(df).collect()} == want
    # A task that hands on its counts early gives the same sums.
    monkeypatch.setattr(ft, "MAX_LOCAL_TERMS", 3)
    parts = list(ft._count_terms(iter([pa.RecordBatch.from_pydict({"row_id": list(range(7)), "text": [(t or "").lower() for t in texts]})])))
    assert len(parts) > 4
    summed = {}
    for part in parts:
        for r in part.to_pylist():
            old = summed.get((r["space"], r["term"]), (0, 0))
            summed[r["space"], r["term"]] = (old[0] + r["df"], old[1] + r["cf"])
    assert summed == want


def test_sparse_rows_equal_the_join(spark, monkeypatch):
    texts = ["to be or not", "be or be", "nothing known", "", "not to be or", "日本語 or to be"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    vocab = ft.with_index(ft.vocabulary(ft.term_counts(df.where("row_id <> 2"))), F.lit(5)).cache()
    assert sorted(r.idx for r in vocab.collect()) == list(range(vocab.count()))
    order = [(r.space, r.term) for r in vocab.orderBy("idx").collect()]
    assert order == sorted((x for x in order if x[0] == "word")) + sorted(x for x in order if x[0] == "char")
    read = lambda: {r.row_id: list(zip(r.indices, [round(v, 9) for v in r.values], strict=True)) for r in ft.sparse_rows(df, vocab).collect()}
    sent = read()
    assert set(sent) == {r.row_id for r in ft.rows_with_terms(df, vocab).collect()} and 3 not in sent
    plan = ft.sparse_rows(df, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    weights = {(r.row_id, r.term): r.weight for r in ft.tfidf(df, vocab).collect()}
    monkeypatch.setattr(ft, "MAX_SENT_BYTES", 0)
    assert ft.send_vocabulary(vocab) is None and read() == sent
    assert {(r.row_id, r.term): round(r.weight, 9) for r in ft.tfidf(df, vocab).collect()} == {k: round(w, 9) for k, w in weights.items()}


def test_vocabulary_limit_with_ties(spark):
    df = spark.createDataFrame([(i, "aa bb cc dd" if i < 3 else "aa bb") for i in range(5)], "row_id bigint, text string")
    kept = {r["term"] for r in ft.vocabulary(ft.word_terms(df), 2, 3, None).collect()}
    assert kept == {"aa", "bb", "aa bb"}


def test_text_model_learns(spark):
    base = {"A1": ["wage too small", "raise my wage", "wage paid late"], "B1": ["desk by a window", "broken desk lamp", "shared desk"]}
    rows = [(f"{t} {k}", [c]) for c, ts in base.items() for t in ts for k in range(4)]
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "row_id bigint, text string, codes array<string>")
    model = linear.fit_text_model(df, max_iter=20)
    scores = {(r["row_id"], r["code"]): r["score"] for r in linear.score_texts(model, df).collect()}
    assert all(scores[i, c[0]] > 0.5 for i, (_, c) in enumerate(rows))
    empty = spark.createDataFrame([(0, "")], "row_id bigint, text string")
    assert {r["score"] for r in linear.score_texts(model, empty).collect()} == {0.0}


def test_blocked_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(23, 8)), rng.normal(size=(31, 8))
    queries = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(q)], "code string, row_id bigint, vector array<double>")
    cands = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(c)], "code string, cand_id bigint, vector array<double>")
    got = {(r["row_id"], r["rank"]): r["cand_id"] for r in index.blocked_top_k(queries, cands, ["code"], 3, block_rows=5).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    order = np.argsort(-(unit(q) @ unit(c).T), axis=1)[:, :3]
    assert got == {(i, r + 1): order[i, r] for i in range(23) for r in range(3)}


def test_user_encoder_and_prefix(spark):
    df = spark.createDataFrame([(0, "abc"), (1, "")], "row_id bigint, text string")
    encoder = lambda texts: np.array([[len(t), 4.0] for t in texts])
    got = {r["row_id"]: r["embedding"] for r in index.encode(df, "text", encoder, prefix="").collect()}
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == pytest.approx([0.0, 1.0])


REPLIES = [
    ('{"labels":[{"code":"A1","sentiment":2},{"code":"A1","sentiment":2}]}', ["A1:2"], [], False),
    ('```json\n{"labels":[{"code":"А1","sentiment":"1"}]}\n```', ["A1:1"], [], False),
    ('so: {"labels":[{"code":"ZZ","sentiment":1}]} ok', [], ["ZZ"], True),
    ('{"labels":[{"code":"A1","sentiment":4},{"code":"A1","sentiment":true}]}', [], ["A1:4", "A1:true"], True),
    ('{"labels":[{"code":"B1","sentiment":1},{"code":"B1","sentiment":2}]}', ["B1:1", "B1:2"], [], False),
    ('{"labels":[]}', [], [], True),
    ('{"labels":"[{\\"code\\":\\"A1\\",\\"sentiment\\":1}]"}', [], [], True),
    ('{"labels":["{\\"code\\":\\"A1\\",\\"sentiment\\":1}"]}', [], ['{"code":"A1","sentiment":1}'], True),
    ('{"labels":[{"code":"A1","sentiment":"\\t1"},{"code":"A1","sentiment":1.0}]}', ["A1:1"], ["A1:1.0"], True),
    ("[1]", [], [], True),
    ("nothing", [], [], True),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "row_id bigint, raw_response string")
    for row, (_, labels, invalid, review) in zip(ann.parse_replies(df, ["A1", "B1"]).orderBy("row_id").collect(), REPLIES, strict=True):
        assert [f"{p['code']}:{p['sentiment']}" for p in row["labels"]] == labels
        assert (row["invalid"], row["needs_review"]) == (invalid, review)


def test_replies_after_the_first_value_and_repeated_keys(spark):
    rows = [
        '{"labels":[{"code":"A1","sentiment":1}]} {"labels":[]}', '{"labels":[{"code":"A1","sentiment":1}]}, {"a":1}',
        '{"labels":[],"labels":[{"code":"B1","code":"A1","sentiment":0,"sentiment":2}]}', 'x {"labels":[{"code":"A1","sentiment":1.50}]} y',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id bigint, raw_response string")
    got = ann.parse_replies(df, ["A1", "B1"]).orderBy("row_id").collect()
    assert [r.parse_error for r in got] == ["invalid_json", "invalid_json", "", ""]
    assert [[(p.code, p.sentiment) for p in r.labels] for r in got] == [[], [], [("A1", 2)], []]
    assert got[3].invalid == ["A1:1.5"]
    # What a retry would accept is what the parser reads.
    assert [ann.has_labels(r) for r in rows] == [r.parse_error == "" for r in got]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_fan_out_turns_failures_into_rows(spark, small_codebook):
    def client(system, user):
        if "bad" in user:
            raise RuntimeError("down")
        return {"content": '{"labels":[{"code":"A1","sentiment":1}]}', "prompt_tokens": 3, "completion_tokens": 2}

    df = spark.createDataFrame([(0, "fine"), (1, "bad"), (2, " ")], "row_id bigint, text string")
    shared = ann.instructions(small_codebook)
    requests = ann.build_requests(df, shared, "text")
    answered = ann.fan_out(requests.where("filled"), client, shared, max_retries=1).drop("request_key")
    rows = {r["row_id"]: r for r in answered.unionByName(ann.empty_rows(requests.where("NOT filled"))).collect()}
    assert rows[0]["llm_error"] == "" and rows[0]["prompt_tokens"] == 3
    assert rows[1]["llm_error"] == "RuntimeError: down" and rows[1]["attempts"] == 2
    assert rows[2]["llm_error"] == "empty_text" and rows[2]["attempts"] == 0
