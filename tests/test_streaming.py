"""Streams against the same rows in batch."""
import datetime as dt
import json
import os
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from lexloom.plans.index_flow import build_index
from lexloom.session import shared_dir
from lexloom.streaming import requests as Q, sinks

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def token(text):
    return json.dumps({"choices": [{"delta": {"content": text}}]})


def event(request, seconds, data):
    return {"request_id": request, "ts": (T0 + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "data": data}


def write_batch(folder, n, rows):
    path = folder / f"{n}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in this order


def stream(spark, folder):
    s = spark.readStream.schema("request_id string, ts timestamp, data string").option("maxFilesPerTrigger", 1).json(str(folder))
    return s.withWatermark("ts", Q.WATERMARK)


def run(spark, df, name):
    path = shared_dir(spark, name)
    q = sinks.start_updates(df, path, shared_dir(spark, name + "-state"), "append")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path), q


def test_request_metrics_on_done_and_timeout(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_batch(src, 1, [event("a", 0, '{"thinking": "hm"}'), event("a", 1, token("He")), event("a", 2, '{"choi'), event("b", 5, token("x")), event("a", 3, token("llo"))])
    write_batch(src, 2, [event("a", 4, "[DONE]"), event("b", 6, ""), event("b", 7, token("yz"))])
    write_batch(src, 3, [event("z", 4000, token("t"))])
    write_batch(src, 4, [event("z", 8000, token("t")), event("late", 1, token("dropped"))])
    write_batch(src, 5, [event("z", 8001, "[DONE]")])
    out, q = run(spark, Q.request_metrics(stream(spark, src)), "rm")
    got = {r["request_id"]: r for r in out.where("request_id in ('a', 'b')").collect()}
    a, b = got["a"], got["b"]
    assert (a["ttft_ms"], a["stream_ms"], a["token_count"], a["response_chars"], a["tokens_per_second"], a["finished"]) == (1000.0, 2000.0, 2, 5, 1.0, True)
    assert (b["token_count"], b["response_chars"], b["stream_ms"], b["finished"]) == (2, 3, 2000.0, False)


def test_sessions_close_and_late_rows_are_counted(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_batch(src, 1, [event("a", 0, "x"), event("a", 60, "x"), event("b", 10, "x")])
    write_batch(src, 2, [event("end", 5000, "x")])
    write_batch(src, 3, [event("end", 5001, "x")])
    write_batch(src, 4, [event("a", 30, "x"), event("end", 9000, "x")])
    late = Q.LateRows()
    spark.streams.addListener(late)
    out, q = run(spark, Q.request_sessions(stream(spark, src)), "rs")
    assert {(r["request_id"], r["token_count"]) for r in out.where("request_id <> 'end'").collect()} == {("a", 2), ("b", 1)}
    deadline = time.time() + 30  # progress events come on their own thread
    while late.of(q) < 1 and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert late.of(q) >= 1


def test_late_rows_count_more_than_the_last_batches():
    late = Q.LateRows()
    for n in range(250):
        op = SimpleNamespace(numRowsDroppedByWatermark=2)
        late.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(runId="r", stateOperators=[op, op])))
    assert late.of(SimpleNamespace(runId="r")) == 1000


def test_feedback_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    cols = "user_id int, message_id int, ts timestamp, conversation_id string, query string, response string, sources string, feedback_type string, feedback_text string"

    def fb(m, s, q, kind, text):
        return {"user_id": 1, "message_id": m, "ts": event("", s, "")["ts"], "conversation_id": "c", "query": q, "response": "r", "sources": None, "feedback_type": kind, "feedback_text": text}
    write_batch(src, 1, [fb(1, 0, "first", "up", "a"), fb(2, 1, "other", "up", None)])
    write_batch(src, 2, [fb(1, 5, "second", "down", "b"), fb(1, 9, "third", "up", "c")])
    s = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).json(str(src))
    log = shared_dir(spark, "fb")
    sinks.start_feedback(s, log, shared_dir(spark, "fb-state")).awaitTermination()
    got = {r["message_id"]: (r["query"], r["feedback_type"], r["feedback_text"]) for r in sinks.read_feedback(spark, log).collect()}
    assert got == {1: ("first", "up", "c"), 2: ("other", "up", None)}


def test_updates_keep_the_last_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_batch(src, 1, [event("a", 0, "x"), event("b", 1, "x")])
    write_batch(src, 2, [event("a", 9, "x")])
    out = sinks.run_available(Q.session_activity(stream(spark, src), "request_id"), ["request_id"], "act")
    assert {r["request_id"]: r["n_messages"] for r in out.collect()} == {"a": 2, "b": 1}
    w = sinks.run_available(Q.windowed(stream(spark, src).withColumn("v", F.lit(1.0)), ["request_id"], "v", "10 seconds", "5 seconds"), ["window_start", "request_id"], "win")
    assert w.where("request_id = 'a'").agg(F.sum("n")).first()[0] == 4


def test_unseen_texts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_batch(src, 1, [event("a", 0, "same"), event("b", 1, "same"), event("c", 2, "new")])
    write_batch(src, 2, [event("d", 3, "same"), event("e", 3000, "fill")])
    write_batch(src, 3, [event("g", 6000, "fill2")])
    write_batch(src, 4, [event("f", 6001, "same")])
    raw = spark.readStream.schema("request_id string, ts timestamp, data string").option("maxFilesPerTrigger", 1).json(str(src))
    out, _ = run(spark, Q.unseen(raw.withColumn("h", F.xxhash64("data")), ["h"]), "un")
    assert out.where("data = 'same'").count() == 2  # once, and again after its time to live


def test_ingest_of_arriving_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("A first sentence. " * 100)
    (src / "b.exe").write_text("x")
    (src / "c.txt").write_text("   ")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sinks.start_ingest(spark, str(src), out, state).awaitTermination()
    (src / "d.html").write_text("<b>late</b> file")
    sinks.start_ingest(spark, str(src), out, state).awaitTermination()
    status = {r["path"].rsplit("/", 1)[1]: (r["status"], r["chunk_count"] > 0, r["error_message"]) for r in spark.read.parquet(out + "/status").collect()}
    assert status == {"a.txt": ("completed", True, None), "b.exe": ("failed", False, "unsupported file type"), "c.txt": ("failed", False, "no text"), "d.html": ("completed", True, None)}
    chunks = spark.read.parquet(out + "/chunks")
    assert [r["chunk_index"] for r in chunks.where(F.col("document_id").endswith("a.txt")).orderBy("chunk_index").collect()] == [0, 1]


def test_whole_index_build(spark):
    """A document with a good contents page, one with wrong numbers, one without a contents page."""
    body = {i: f"{i}. Topic {'abcdefgh'[i - 1]}\nsome text {i}" for i in range(1, 7)}
    toc = "Contents\n" + "\n".join(f"{i} Topic {'abcdefgh'[i - 1]} ...... {i}" for i in range(1, 7))
    rows = [("good", 1, toc)] + [("good", i + 1, body[i]) for i in body]
    rows += [("none", i, body[i]) for i in body]
    bad = "Contents\n" + "\n".join(f"{i} Topic {'abcdefgh'[i - 1]} ...... {p}" for i, p in zip(range(1, 7), (1, 2, 3, 4, 5, 2)))
    rows += [("bad", 1, bad)] + [("bad", i + 1, body[i]) for i in body]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string").withColumn("token_count", F.length("text").cast("bigint"))
    out = build_index(pages)
    got = {}
    for r in out.orderBy("document_id", "node_id").collect():
        got.setdefault(r["document_id"], []).append((r["node_id"], r["title"], r["start_index"], r["end_index"]))
    topics = [f"Topic {c}" for c in "abcdef"]
    assert [t for _, t, _, _ in got["none"]] == topics
    assert [s for _, _, s, _ in got["none"]] == [1, 2, 3, 4, 5, 6]
    assert [t for _, t, _, _ in got["good"]] == ["Preface"] + topics
    assert [s for _, _, s, _ in got["good"]] == [1, 2, 3, 4, 5, 6, 7]
    assert got["bad"] == got["good"]
    assert out.where("document_id = 'none' and node_id = '0000'").first()["text"] == body[1] + "\n" + (body[2] + "\n" if got["none"][0][3] == 2 else "")


def test_sql_functions(spark):
    from lexloom.functions.sql import register
    register(spark)
    assert spark.sql("SELECT round(cosine_similarity(array(1D, 0D), array(1D, 1D)), 4)").first()[0] == 0.7071
    assert spark.sql("SELECT rrf_term(NULL, 60, 1D), rrf_term(1, 59, 3D), estimate_tokens('abcde'), strip_html('<p>a</p>  b')").first()[:] == (0.0, 0.05, 2, "a b")
    rows = spark.sql("SELECT d.id, s.pos, s.content FROM VALUES (1, 'aaa bbb ccc') AS d(id, t), LATERAL split_text(d.t, 7, 0) s ORDER BY pos").collect()
    assert [(r["pos"], r["content"]) for r in rows] == [(0, "aaa"), (1, "bbb"), (2, "ccc")] or [r["content"] for r in rows] == ["aaa bbb", "ccc"]


def test_ask_flow(spark):
    from lexloom.operators import tree as R
    from lexloom.plans.ask_flow import answer_questions
    docs = spark.createDataFrame([("u", "d1", 0, "small business guide", None), ("u", "d2", 1, "loss notes", "carry forward of losses"), ("v", "d3", 0, "small business guide", None)],
                                 "owner string, document_id string, pos int, name string, description string")
    nodes = spark.createDataFrame([("d1", [0], "Scope", 1, 2, "small business relief applies"), ("d1", [1], "Limits", 3, 4, "revenue limit of the relief"), ("d2", [0], "Losses", 1, 9, "losses carry forward"), ("d3", [0], "Other", 1, 1, "small business relief revenue")],
                                  "document_id string, path array<bigint>, title string, start_index int, end_index int, text string")
    qs = spark.createDataFrame([("u", 1, "small business relief revenue", None), ("u", 2, "weather in paris", None), ("u", 3, "zzzz qqqq", None), ("u", 4, "elaborate on that relief revenue", "see Article 5")],
                               "owner string, query_id int, question string, context string")

    def client():
        return lambda prompts: ["Relief is 3 million [2]. More [1] and [9]." for _ in prompts]
    out = {r["query_id"]: r for r in answer_questions(qs, docs, R.number_nodes(nodes), client).collect()}
    assert out[2]["route"] == "programming" and out[3]["route"] == "low_confidence"
    assert (out[1]["route"], out[1]["n_sources"], out[1]["n_cited"], out[1]["grounding"]) == ("answered", 2, 2, "grounded")
    assert out[1]["answer"] == "Relief is 3 million [2]. More [1] and [9]." and 0 <= out[1]["quality"] <= 100
    assert out[4]["question"].startswith("Regarding Article 5: ")
