from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.plans import reports
from waybridge.sources import store, uploads

T0 = datetime(2024, 1, 1)
JOB = "job_id int, account_id int, idempotency_key string, created_at timestamp"


def test_first_submission_answers_repeats(spark):
    jobs = spark.createDataFrame(
        [(1, 7, "k", T0), (2, 7, "k", T0 + timedelta(hours=1)), (3, 8, "k", T0), (4, 7, None, T0), (5, 7, None, T0)], JOB
    )
    got = {r["job_id"]: (r["answer_job_id"], r["idempotent_replay"]) for r in store.first_submissions(jobs).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False)}
    known = spark.createDataFrame([(9, 8, "k", T0 - timedelta(days=9))], JOB)
    got = {r["job_id"]: r["answer_job_id"] for r in store.first_submissions(jobs, known).collect()}
    assert got == {1: 1, 2: 1, 3: 9, 4: 4, 5: 5}
    assert sorted(r["job_id"] for r in store.new_jobs(jobs, known).collect()) == [1, 4, 5]


def test_upsert_update_delete(spark):
    a = spark.createDataFrame([("x", 1, T0), ("y", 1, T0)], "k string, v int, at timestamp")
    b = spark.createDataFrame([("x", 2, T0 + timedelta(1)), ("z", 3, T0)], "k string, v int, at timestamp")
    assert sorted((r["k"], r["v"]) for r in store.upsert_latest(a, b, ["k"], ["at"]).collect()) == [("x", 2), ("y", 1), ("z", 3)]
    changes = spark.createDataFrame([("x", None)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in store.update_rows(a, changes, "k", ["v"]).collect()) == [("x", 1), ("y", 1)]
    left = store.delete_rows(a, a.filter("k = 'x'"), ["k"])
    assert [r["k"] for r in left.collect()] == ["y"]


def test_status_update_sets_completion_for_final_states_only(spark):
    schema = "job_id int, status string, error string, completed_at timestamp"
    jobs = spark.createDataFrame([(1, "queued", None, None), (2, "queued", None, None), (3, "failed", "e", T0)], schema)
    changes = spark.createDataFrame([(1, "complete", None, T0), (2, "scoring", None, T0)], "job_id int, status string, error string, changed_at timestamp")
    got = {r["job_id"]: (r["status"], r["error"], r["completed_at"] is not None) for r in store.update_job_status(jobs, changes).collect()}
    assert got == {1: ("complete", None, True), 2: ("scoring", None, False), 3: ("failed", "e", True)}


def test_upload_gate_reads_files(spark, tmp_path):
    for name, body in {"a.pdf": b"%PDF-1.4 x", "b.pdf": b"", "c.pdf": b"PK..", "d.pdf": b"%PDF" + b"x" * 100}.items():
        (tmp_path / name).write_bytes(body)
    sent = spark.createDataFrame([(f"file:{tmp_path}/{n}.pdf",) for n in "abcd"], "path string")
    gated = uploads.gate_uploads(uploads.read_uploads(spark, str(tmp_path)), 50, sent)
    got = {r["path"][-5:]: r["reject_code"] for r in gated.collect()}
    assert got == {"a.pdf": None, "b.pdf": "invalid_pdf", "c.pdf": "invalid_pdf", "d.pdf": "file_too_large"}


def test_pages_from_json_and_arrays(spark, tmp_path):
    from waybridge.sources import pages as pg

    (tmp_path / "p.json").write_text('{"job_id": 1, "page_no": 1, "text": "a"}\n')
    assert pg.read_pages(spark, str(tmp_path / "p.json"), "json").collect()[0]["text"] == "a"
    texts = spark.createDataFrame([(1, ["a", "b"])], "job_id int, pages array<string>")
    got = pg.pages_from_texts(texts, "job_id", "pages").collect()
    assert [(r["page_no"], r["text"]) for r in got] == [(1, "a"), (2, "b")]


def test_append_is_read_back(spark, tmp_path):
    df = spark.range(5).withColumn("p", F.col("id") % 2)
    for _ in range(2):
        store.append(df, str(tmp_path / "t"), ["p"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_keyset_pages_cover_all_rows_once(spark):
    rows = [(i, T0 + timedelta(seconds=i // 3)) for i in range(23)]
    df = spark.createDataFrame(rows, "job_id int, created_at timestamp")
    seen, cursor = [], None
    while True:
        page = reports.keyset_page(df, "job_id", limit=5, before=cursor).collect()
        seen += [r["job_id"] for r in page]
        if not page or page[0]["next_key"] is None:
            break
        cursor = (page[0]["next_created_at"], page[0]["next_key"])
    assert sorted(seen) == list(range(23))
    assert len(seen) == 23


def test_result_lists_are_cut_by_page_ranges(spark, monkeypatch):
    monkeypatch.setattr(reports, "DOCS_PER_PART", 10)
    jobs = spark.createDataFrame([(1, "complete"), (2, "queued")], "job_id int, status string")
    docs = spark.createDataFrame([(1, i, "bol", i, i) for i in range(1, 26)], "job_id int, document_id int, doc_type string, page_start int, page_end int")
    got = reports.job_details(jobs, docs).collect()
    sizes = sorted((r["job_id"], r["part_no"], len(r["documents"] or [])) for r in got)
    assert sizes == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 0)]


def test_box_forms(each):
    got = each(reports.bbox_struct, ["[1,2,3,4]", '{"x":1,"y":2,"w":3,"h":4}', None])
    assert got[0] == got[1] and got[0]["h"] == 4.0 and got[2] is None


def test_stage_states(spark):
    jobs = spark.createDataFrame([(1, "extracting"), (2, "failed"), (3, "complete")], "job_id int, status string")
    got = {}
    for r in reports.stage_rows(jobs).orderBy("ord").collect():
        got.setdefault(r["job_id"], []).append(r["state"])
    assert got[1] == ["completed"] * 3 + ["current"] + ["pending"] * 5
    assert got[2] == ["completed"] * 8 + ["pending"]
    assert got[3] == ["completed"] * 8 + ["current"]


def test_percentiles_and_empty_usage(spark):
    jobs = spark.createDataFrame([(T0, T0 + timedelta(seconds=s)) for s in (1, 2, 3, 4)], "created_at timestamp, completed_at timestamp")
    assert reports.processing_percentiles(jobs).first()["p50_seconds"] == 2.5
    empty = spark.createDataFrame([], "request_count bigint, cache_hit_count bigint")
    assert tuple(reports.usage_totals(empty).first()) == (0, 0, 0.0)


def test_vocabulary_is_closed():
    for t, names in vocab.REQUIRED_FIELDS.items():
        assert set(names) <= set(vocab.CANONICAL_FIELDS[t])
    assert set(vocab.CHARGE_SYNONYMS.values()) < set(vocab.CHARGE_TYPES)
