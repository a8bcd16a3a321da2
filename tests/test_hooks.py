import json
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import control
from tidemark.operators import evaluation, generation
from tidemark.sources import readers, writers
from tidemark.streaming import timeline


def unit(*at):
    return [1.0 if i in at else 0.0 for i in range(64)]


def test_injected_search(spark):
    index = spark.createDataFrame([("v", 0, unit(5), unit(0), False), ("v", 1, unit(0), unit(1), False), ("v", 2, None, unit(2), True)], "video_id string, idx int, es array<float>, ec array<float>, mask boolean")
    queries = spark.createDataFrame([("q1", "v", "a", unit(0), [0]), ("q2", "v", "b", unit(2), [2, 9]), ("q3", "v", "b", unit(2), [7])], "query_id string, video_id string, type string, v array<float>, gt_seg_idx array<int>")
    got = {r.query_id: r.rank for r in evaluation.per_query(queries, index, 0.5, evaluation.caption_search).collect()}
    assert got == {"q1": 1, "q2": 1, "q3": 0}  # the static row takes its flat subtitle channel: 0, above the others' -0.7
    fixed = lambda q, i, a: q.select("query_id", F.lit(7).alias("idx"), F.lit(2).alias("rank"))
    means = {r.type: (r.n, r.mrr, r.hit_1, r.hit_5) for r in evaluation.evaluate(queries, index, 0.5, fixed).collect()}
    assert means == {None: (3, 0.1667, 0.0, 0.3333), "a": (1, 0.0, 0.0, 0.0), "b": (2, 0.25, 0.0, 0.5)}
    with pytest.raises(ValueError):
        evaluation.evaluate(queries.limit(0), index, 0.5)
    seen = []
    prefixed = evaluation.with_prefix(fixed, lambda q: seen.append(q.first().text) or q, "query: ")
    prefixed(queries.withColumn("text", F.lit("t")), index, 0.5)
    assert seen == ["query: t"]
    variants = spark.createDataFrame([("q1", 0, unit(1)), ("q1", 1, unit(0))], "query_id string, variant int, v array<float>")
    top = evaluation.pooled(evaluation.caption_search, variants)(queries.where("query_id = 'q1'"), index, 0.0).orderBy("rank").collect()
    assert {(r.idx, r.rank) for r in top} == {(0, 1), (1, 2), (2, 3)}


def test_captions_resume_and_retry(spark):
    rows = spark.createDataFrame([("v", 0, "f0", "there"), ("v", 1, "good", None), ("v", 2, "bad", " "), ("v", 3, "broken", None), ("v", 4, None, None)], "video_id string, idx int, rep_frame string, caption string")

    def captioner(frame, sampled):
        if frame == "broken":
            raise RuntimeError
        return f"{frame}!" if sampled else frame

    got = {r.idx: (r.caption, r.failed, r.calls) for r in generation.caption_all(rows, captioner, lambda t: t == "bad").collect()}
    assert got == {0: ("there", False, 0), 1: ("good", False, 1), 2: ("bad!", False, 2), 3: (None, True, 2), 4: (None, True, 0)}
    want = spark.createDataFrame([("v", "m", "ko", 1, 2, 5), ("w", "m", "ko", 1, 2, 5)], "video_id string, model string, lang string, mtime int, size int, beam int")
    cache = spark.createDataFrame([("v", "m", "ko", 1, 2, None), ("w", "m", "ko", 9, 2, 5)], want.schema)
    assert {r.video_id: r.hit for r in generation.from_cache(want, cache).collect()} == {"v": True, "w": False}


def test_report_flow(spark):
    segments = spark.createDataFrame([("v", i) for i in range(12)], "video_id string, idx int")
    assert {(r.chunk, r.idx) for r in generation.chunks(segments, 8, 2).collect()} == {(0, i) for i in range(8)} | {(1, i) for i in range(6, 12)}
    with pytest.raises(ValueError):
        generation.chunks(segments, 5, 5)
    text = "- a [seg#0, seg#1, seg#2, seg#3]\n\n* b [SEG # 4] [seg#99]"
    answers = spark.createDataFrame([("v", 0, text), ("v", 1, "c [seg#6]")], "video_id string, chunk long, text string")
    again = spark.createDataFrame([("v", 1, "d [seg#6, seg#7]"), ("v", 0, "worse [seg#0]")], answers.schema)
    mapped = generation.map_report(segments, answers, again, 8, 2).orderBy("chunk", "line").collect()
    assert [(r.chunk, r.cites, r.coverage) for r in mapped] == [(0, [0, 1, 2, 3], 0.625), (0, [4], 0.625), (1, [6, 7], 0.333333)]
    mapped = generation.map_report(segments, answers, again, 8, 2)
    final = spark.createDataFrame([("v", "all [seg#0, seg#1, seg#2, seg#3, seg#4, seg#6, seg#7]\nfine [seg#1, seg#5]\nbehind the")], "video_id string, text string")
    reduced = generation.reduce_report(mapped, final, segments)
    assert [(r.sent_id, r.cites, r.dropped) for r in reduced.orderBy("sent_id").collect()] == [(0, [0, 1, 2, 3, 4, 6, 7], "dump"), (1, [1], None), (2, [], "tail")]
    assert [tuple(r) for r in generation.needs_retry(reduced).collect()] == [("v", "dump")]


def test_sources(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(struct.pack("<3h", 0, 16384, -32768))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    (tmp_path / "a.json").write_text("{}")
    got = {r.path.rsplit("/", 1)[1]: r.samples for r in readers.wav_samples(spark, f"{tmp_path}/*.wav").collect()}
    assert got == {"a.wav": [0.0, 0.5, -1.0], "b.wav": None}
    assert [r.stem for r in readers.paired_files(spark, str(tmp_path)).collect()] == ["a"]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("Contents/section0.xml", "<hp:p id='1'><hp:t>하나 </hp:t><hp:t>둘 &amp; &lt;셋&gt;</hp:t></hp:p><hp:p><hp:t> </hp:t></hp:p><hp:p><hp:t>넷</hp:t></hp:p>")
    assert [r.text for r in readers.zipped_paragraphs(spark, str(tmp_path / "m.zip")).orderBy("n").collect()] == ["하나 둘 & <셋>", "넷"]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"query_id": i, "split": s}) for i, s in (("a", "external"), ("b", "dev"))))
    with pytest.raises(ValueError):
        readers.external_queries(spark, str(tmp_path / "q.jsonl"))


def test_sinks(spark, tmp_path):
    index = spark.createDataFrame([("v", 0, unit(1), unit(2)), ("v", 1, None, unit(0))], "video_id string, idx int, emb_sub array<float>, emb_cap array<float>")
    writers.index_table(index, str(tmp_path / "i"), index)
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    for wrong in (index.limit(1), index.union(index), index.withColumn("emb_cap", F.lit([2.0] + [0.0] * 63).cast("array<float>"))):
        with pytest.raises(ValueError):
            writers.index_table(wrong, str(tmp_path / "j"), index)
    writers.blind_kit(index, "idx", ["video_id"], str(tmp_path / "kit"))
    sheet, keys = spark.read.option("header", True).csv(str(tmp_path / "kit/sheet")), spark.read.parquet(str(tmp_path / "kit/keymap"))
    assert sheet.columns == ["blind", "video_id"] and sheet.join(keys, "blind").count() == 2
    failed = spark.createDataFrame([(1, True), (2, True)], "n int, failed boolean")
    assert not writers.with_success(failed, str(tmp_path / "s")) and writers.with_success(failed.union(failed.selectExpr("n", "false")), str(tmp_path / "s"))


def test_control(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('{"alpha": 0.5, "paths": {"work": "w"}, "report_model": "m", "judge_model": "m"}')
    base = control.load_config(str(tmp_path / "c.yaml"))
    assert control.arm_configs(base, {"x": {"alpha": 1}}, "full")["x"] == base | {"alpha": 1, "paths": {"work": "w/full/x"}}
    with pytest.raises(KeyError):
        control.arm_configs(base, {"x": {"beta": 1}}, "full")
    with pytest.raises(ValueError):
        control.check_judge(base)
    control.check_judge(base | {"same_model_judge": True})
    (tmp_path / "p.yaml").write_text('{"name": "n", "command": ["run", "$HOME"], "expected": [], "log_dir": "/tmp/logs"}')
    plan = control.load_plan(str(tmp_path / "p.yaml"), repository=str(tmp_path))
    assert plan["command"][1].startswith("/") and control.plan_hash(plan) == control.plan_hash(dict(reversed(plan.items())))
    with pytest.raises(ValueError):
        control.load_plan(str(tmp_path / "p.yaml"), repository="/tmp")
    assert control.touches_protected(["--split", "TEST.jsonl", "dev"]) == ["TEST.jsonl"]
    told = {r.key: r.mismatch for r in control.run_provenance(spark, {"a": 1, "b": 2}, {"a": 1, "b": 3}).collect()}
    assert told["a"] is False and told["b"] is True and "spark" in told
    good, bad = (lambda: spark.range(0)), (lambda: spark.range(2))
    ran = []
    with pytest.raises(ValueError):
        control.run_stages([("canary", lambda: ran.append(1), {"empty": good}), ("full", lambda: ran.append(2), {"empty": bad}), ("report", lambda: ran.append(3), {})], spark, str(tmp_path / "done"))
    assert ran == [1, 2] and not (tmp_path / "done").exists()
    assert control.run_stages([("canary", lambda: None, {"empty": good})], spark, str(tmp_path / "done")) == ["canary"]
    with pytest.raises(FileExistsError):
        control.run_stages([], spark, str(tmp_path / "done"))


def test_complete_segments_stream(spark, tmp_path):
    rows = [("v", f"2024-01-01 00:00:{s:02d}", s) for s in range(12)]
    spark.createDataFrame(rows, "video_id string, ts string, frame int").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("video_id string, ts timestamp, frame int").parquet(str(tmp_path / "in"))
    q = timeline.complete_segments(s).writeStream.format("memory").queryName("whole").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(spark.table("whole").collect(), key=lambda r: r.window.start)
    assert [(r.frames, r.held) for r in got] == [(5, [0, 1, 2, 3, 4]), (5, [5, 6, 7, 8, 9])]
    assert timeline.progress(q)["rows"] == 12
    assert np.isfinite(timeline.progress(q)["last_ms"])
