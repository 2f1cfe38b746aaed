"""Annotation runs that break, restart, change their instructions, and follow a stream of files."""

import json
import os
import uuid

import pytest

from codeloom.operators import annotation as ann
from codeloom.plans import jobs
from codeloom.sources.ledger import Ledger
from codeloom.streaming import annotating, scoring


def counting_client(folder, failing=()):
    """Writes down every request it gets; fails for texts with a word of ``failing``."""
    folder = str(folder)
    os.makedirs(folder, exist_ok=True)

    def ask(system, user, schema=None):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([user, schema], f)
        if any(word in user for word in failing):
            raise RuntimeError("down")
        return {"content": '{"labels":[{"code":"A1","sentiment":1}]}', "prompt_tokens": len(user)}

    def asked():
        sent = []
        for name in os.listdir(folder):
            with open(f"{folder}/{name}") as f:
                sent.append(json.load(f))
        return sent

    ask.asked = asked
    return ask


def answers(spark, n=40):
    return spark.createDataFrame([(i, f"text number {i}x" if i % 8 else " ") for i in range(n)], "row_id bigint, answer string")


class Stop(RuntimeError):
    pass


def stop_after(slices):
    def on_slice(done, n_slices):
        if done == slices:
            raise Stop
    return on_slice


def test_a_broken_run_asks_no_row_twice(spark, small_codebook, tmp_path):
    client, folder = counting_client(tmp_path / "sent"), str(tmp_path / "ledger")
    with pytest.raises(Stop):
        jobs.annotate(answers(spark), small_codebook, client, "answer", ledger=folder, slice_rows=7, on_slice=stop_after(2))
    first = len(client.asked())
    assert 0 < first < 35 and len(Ledger(spark, folder).slices()) == 2
    stored, stats = jobs.annotate(answers(spark), small_codebook, client, "answer", ledger=folder, slice_rows=7)
    sent = [user for user, _ in client.asked()]
    assert len(sent) == 35 and len(set(sent)) == 35
    rows = stored.collect()
    assert len(rows) == 40 and sum(r.predicted_codes == "A1" for r in rows) == 35 and sum(r.llm_error == "empty_text" for r in rows) == 5
    # A third run has nothing to ask, and gives the same rows.
    again, _ = jobs.annotate(answers(spark), small_codebook, client, "answer", ledger=folder)
    assert len(client.asked()) == 35 and sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert stats.first()["successful_rows"] == 35


def test_a_slice_without_commit_is_asked_again(spark, small_codebook, tmp_path):
    client, folder = counting_client(tmp_path / "sent"), str(tmp_path / "ledger")
    jobs.annotate(answers(spark), small_codebook, client, "answer", ledger=folder, slice_rows=7)
    ledger = Ledger(spark, folder)
    broken = ledger.slices()[0]
    lost = spark.read.parquet(f"{folder}/{broken}").count()
    os.remove(f"{folder}/{broken}/_SUCCESS")
    assert broken not in ledger.slices() and ledger.replies().count() == 35 - lost
    stored, _ = jobs.annotate(answers(spark), small_codebook, client, "answer", ledger=folder, slice_rows=100)
    assert len(client.asked()) == 35 + lost and stored.where("predicted_codes = 'A1'").count() == 35
    with pytest.raises(ValueError, match="committed"):
        ledger.commit(ledger.replies().drop("run"), ledger.slices()[0], 9)


def test_failed_requests_are_retried_by_the_next_run(spark, small_codebook, tmp_path):
    folder = str(tmp_path / "ledger")
    down = counting_client(tmp_path / "down", failing=("number 3x", "number 9x"))
    stored, _ = jobs.annotate(answers(spark), small_codebook, down, "answer", ledger=folder, max_retries=0)
    assert {r.row_id for r in stored.where("llm_error LIKE 'RuntimeError%'").collect()} == {3, 9}
    up = counting_client(tmp_path / "up")
    kept, _ = jobs.annotate(answers(spark), small_codebook, up, "answer", ledger=folder, retry_failed=False)
    assert up.asked() == [] and kept.where("llm_error LIKE 'RuntimeError%'").count() == 2
    mended, _ = jobs.annotate(answers(spark), small_codebook, up, "answer", ledger=folder)
    assert len(up.asked()) == 2 and mended.where("predicted_codes = 'A1'").count() == 35
    assert Ledger(spark, folder).replies().count() == 37 and Ledger(spark, folder).latest().count() == 35


def test_other_instructions_or_texts_are_other_requests(spark, small_codebook, tmp_path):
    client, folder = counting_client(tmp_path / "sent"), str(tmp_path / "ledger")
    jobs.annotate(answers(spark, 10), small_codebook, client, "answer", ledger=folder)
    jobs.annotate(answers(spark, 10).selectExpr("row_id", "if(row_id = 1, 'changed', answer) AS answer"), small_codebook, client, "answer", ledger=folder)
    assert len(client.asked()) == 8 + 1
    jobs.annotate(answers(spark, 10), small_codebook, client, "answer", ledger=folder, max_labels=2, structured_output=True)
    assert len(client.asked()) == 8 + 1 + 8
    schemas = {schema for _, schema in client.asked()}
    assert schemas == {None, ann.reply_schema(["A1", "A2", "B1"], 2)}


def test_an_empty_table_asks_nothing(spark, small_codebook, tmp_path):
    client = counting_client(tmp_path / "sent")
    stored, stats = jobs.annotate(answers(spark).limit(0), small_codebook, client, "answer")
    assert stored.collect() == [] and client.asked() == [] and stats.first()["input_rows"] == 0


def test_arriving_files_are_annotated_once(spark, small_codebook, tmp_path):
    client, source, folder = counting_client(tmp_path / "sent"), str(tmp_path / "in"), str(tmp_path / "ledger")
    answers(spark, 16).repartition(2).write.parquet(source)
    run = lambda checkpoint: annotating.annotate_stream(
        spark, source, folder, str(tmp_path / checkpoint), client, small_codebook, answers(spark).schema, "answer"
    )
    assert run("c") == 2 and len(client.asked()) == 14
    # Nothing new, also without the checkpoint: the ledger knows what was asked.
    assert run("c") == 2 and run("other") == 2 and len(client.asked()) == 14
    answers(spark, 24).where("row_id >= 14").coalesce(1).write.mode("append").parquet(source)
    assert run("c") == 3 and len({user for user, _ in client.asked()}) == len(client.asked()) == 21
    shared = ann.instructions(small_codebook)
    requests = ann.build_requests(answers(spark, 24), shared, "answer")
    assert ann.collect_replies(requests, Ledger(spark, folder)).count() == 24


def test_batches_of_a_stream_are_counted_after_an_idle_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    df = answers(spark, 5)
    run = lambda: scoring.score_stream(spark, source, out, checkpoint, lambda rows: rows.select("row_id"), df.schema)
    df.coalesce(1).write.parquet(source)
    assert [run(), run(), run()] == [1, 1, 1]
    df.coalesce(1).write.mode("append").parquet(source)
    assert [run(), run()] == [2, 2]
