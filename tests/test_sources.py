import csv
import fnmatch
import gzip
import hashlib
import json
import os
import random
from urllib.parse import unquote

import pytest
import zstandard
from pyspark.sql import functions as F

from winnow import schemas
from winnow.operators import curate
from winnow.operators.checks import ValidationError
from winnow.sources import checksums, datasets, jsonl, sinks
from winnow.streaming import stateless

ROW = schemas.T.StructType().add("a", "long").add("s", "string")


def zst(path, text, window_log=21):
    params = zstandard.ZstdCompressionParameters(window_log=window_log, enable_ldm=False)
    with open(path, "wb") as raw, zstandard.ZstdCompressor(compression_params=params).stream_writer(raw) as out:
        out.write(text.encode())


def test_zst_windows_blank_lines_and_tail(spark, tmp_path):
    zst(tmp_path / "b.jsonl.zst", '{"a":1,"s":"x"}\n\n  \n{"a":2,"s":"é"}', 25)
    zst(tmp_path / "a.jsonl.zst", '{"a":3,"s":"y"}\nbroken\n{"a":4}\n\n', 28)
    zst(tmp_path / "c.json", '{"a":9}\n')
    scan = jsonl.scan_zst_jsonl(spark, str(tmp_path), ROW)
    rows = sorted(tuple(r) for r in jsonl.good_lines(scan).collect())
    assert rows == [(1, "x"), (2, "é"), (3, "y"), (4, None)]
    assert [r[0] for r in jsonl.bad_lines(jsonl.scan_zst_jsonl(spark, str(tmp_path), ROW)).collect()] == ["broken"]


def test_zst_frames_of_different_windows_in_one_file(spark, tmp_path):
    """Lines across frames, a skippable frame, numbers of lines, bad lines, and a split size below the file's."""
    lines = [json.dumps({"a": n, "s": hashlib.sha256(b"%d" % n).hexdigest() * 20}) for n in range(3000)] + ["[1]", "5", '"t"', '{"a":']
    text = "\n".join(lines)
    for i, log in enumerate((28, 21, 27, 28)):
        zst(tmp_path / f"part{i}", text[i * len(text) // 4 : (i + 1) * len(text) // 4], log)
    parts = [(tmp_path / f"part{i}").read_bytes() for i in range(4)]
    parts.insert(2, b"\x50\x2a\x4d\x18\x03\x00\x00\x00\n\n\n")
    (tmp_path / "whole.jsonl.zst").write_bytes(b"".join(parts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        scan = jsonl.scan_zst_jsonl(spark, str(tmp_path), ROW, with_order=True)
        good = jsonl.good_lines(scan).orderBy("_row").collect()
        assert [(r["a"], r["_row"]) for r in good] == [(n, n) for n in range(3000)]
        assert {r["_file"].rsplit("/")[-1] for r in good} == {"whole.jsonl.zst"}
        assert sorted(r[0] for r in jsonl.bad_lines(scan).collect()) == ['"t"', "5", "[1]", '{"a":']
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_zst_without_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jsonl.scan_zst_jsonl(spark, str(tmp_path), ROW)


def test_many_lines_in_a_large_window(spark, tmp_path):
    zst(tmp_path / "a.jsonl.zst", "".join(f'{{"a":{n},"s":"{"x" * (n % 50)}"}}\n' for n in range(20000)), 28)
    rows = jsonl.good_lines(jsonl.scan_zst_jsonl(spark, str(tmp_path), ROW))
    assert rows.agg(F.count("*"), F.sum("a")).first()[:] == (20000, sum(range(20000)))


def test_strict_and_lenient_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":\n[1]\n5\n{"a":"no"}\n{"a":2,"s":"t"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.scan_jsonl_strict(spark, str(tmp_path / "x.jsonl"), ROW).collect()
    scan = jsonl.scan_jsonl_lenient(spark, str(tmp_path / "x.jsonl"), ROW)
    assert sorted(r["a"] for r in jsonl.good_lines(scan).collect()) == [1, 2]
    assert jsonl.bad_lines(scan).count() == 4


def test_documents_and_dispatch(spark, tmp_path):
    rows = [{"a": 1, "s": "x"}, {"a": 2, "s": None}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "data.json").write_text(json.dumps({"data": rows, "version": 3}))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.createDataFrame(rows, ROW).write.parquet(str(tmp_path / "r.parquet"))
    for name in ("list.json", "data.json", "r.jsonl", "r.parquet"):
        found = datasets.read_dataset(spark, str(tmp_path / name), ROW).collect()
        assert sorted(map(tuple, found)) == [(1, "x"), (2, None)], name
    with pytest.raises(ValueError, match="must be"):
        datasets.read_dataset(spark, str(tmp_path / "r.txt"))
    (tmp_path / "bad.json").write_text("[1, 2]")
    with pytest.raises(Exception, match="(?i)malformed"):
        datasets.read_dataset(spark, str(tmp_path / "bad.json"), ROW).collect()


def test_text_of_polymorphic_fields(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"answer":0,"label":1.0,"target":[1,{"b":2}],"ans":"x"}\n')
    row = datasets.read_dataset(spark, str(tmp_path / "p.jsonl")).first()
    assert (row["answer"], row["label"], row["target"], row["ans"]) == ("0", "1.0", '[1,{"b":2}]', "x")


def test_union_keeps_order_and_widens(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "q")], "x int, y string")
    rows = datasets.union_sources([a, b]).orderBy("file_no").collect()
    assert [(r["file_no"], r["x"], r["y"]) for r in rows] == [(0, 1, None), (1, 2, "q")]


def test_entropy_files(spark, tmp_path):
    (tmp_path / "e0.jsonl").write_text('{"idx":1,"entropy_0":0.5}\n{"idx":2,"entropy_0":1}\n{"idx":1,"entropy_0":0.75}\n')
    (tmp_path / "e1.jsonl").write_text('{"idx":1,"entropy_1":2.5}\n')
    files = {str(tmp_path / "e0.jsonl"): "entropy_0", str(tmp_path / "none"): "entropy_2", str(tmp_path / "e1.jsonl"): "entropy_1"}
    with pytest.warns(UserWarning, match="skipped"):
        rows = datasets.read_entropy_files(spark, files)
    found = {r["idx"]: (r["entropy_0"], r["entropy_1"]) for r in rows.collect()}
    assert found == {1: (0.75, 2.5), 2: (1.0, None)}
    sinks.write_sorted_jsonl(rows.repartition(4), str(tmp_path / "merged"))
    lines = [json.loads(x) for f in sorted(os.listdir(tmp_path / "merged")) if f.startswith("part")
             for x in open(tmp_path / "merged" / f)]
    assert [x["idx"] for x in lines] == [1, 2]


def test_checksums(spark, tmp_path):
    """Bytes of any kind, under a suffix (whole files) and under a glob without one (files may be split)."""
    rng = random.Random(4)
    contents = {
        "a.txt": b"alpha", "b.txt": b"x" * 300_000, "c.txt": rng.randbytes(3_000_000), "d.txt": b"", "e.txt": b"\n",
        "f.txt": b"\xef\xbb\xbf", "g.txt": b"\xef\xbb\xbf\n", "h.txt": b"\xef\xbb\xbfa\r\n\n\rb", "i.txt": b"\n\xef\xbb\xbf\n\n",
        "no suffix": rng.randbytes(70_000) + b"\n", "j.gz": b"not compressed\n" * 50,
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    expected = {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        for glob in ("*.txt", "*.gz", "[a-i].*", "no*"):
            files = checksums.file_checksums(spark, str(tmp_path), glob=glob)
            found = {unquote(os.path.basename(r["path"])): (r["length"], r["sha256"]) for r in files.collect()}
            named = {n for n, data in contents.items() if data and fnmatch.fnmatch(n, glob)}
            assert found == {n: (len(contents[n]), expected[n]) for n in named}, glob
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = checksums.file_checksums(spark, str(tmp_path), glob="*.txt")
    checksums.pin(files, {n: expected[n].upper() for n in ("a.txt", "f.txt")})
    for wrong in ({"a.txt": "0" * 64}, {"z.txt": expected["a.txt"]}, {"d.txt": expected["d.txt"]}):
        with pytest.raises(ValidationError, match="checksum"):
            checksums.pin(files, wrong)


def test_sinks(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith a break', True), (2, None, None)]
    df = spark.createDataFrame(rows, "n int, response string, verified boolean").coalesce(1)
    out = str(tmp_path / "detail")
    sinks.write_detail_csv(df, out)
    (part,) = [f for f in os.listdir(out) if f.startswith("part")]
    with open(os.path.join(out, part), newline="") as stream:
        assert list(csv.reader(stream)) == [["n", "response", "verified"], ["1", rows[0][1], "true"], ["2", "", ""]]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_detail_csv(df, out)
    sinks.write_detail_csv(df, out, overwrite=True)
    with pytest.raises(ValidationError, match="empty"):
        sinks.write_detail_csv(df.where("n > 5"), str(tmp_path / "none"))
    assert len(sinks.preview(df)) == 2


DECODING = {"temperature": 0.6, "stop": ["a", "b"], "scorer": {"name": "n", "limit": 20}}


def test_summary_sink(spark, tmp_path):
    from winnow.operators import metrics

    graded = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "position int, sample_index int, correct int")
    named = sinks.named_metrics(metrics.summary(graded, 2), 2)
    sinks.write_summary(sinks.with_provenance(named, model="m", seed=42, decoding=DECODING), str(tmp_path / "s"))
    (part,) = [f for f in os.listdir(tmp_path / "s") if f.startswith("part")]
    row = json.loads((tmp_path / "s" / part).read_text())
    assert (row["mean_at_2"], row["pass_at_2"], row["acc"], row["total"], row["orig_total"]) == (0.5, 1.0, 0.5, 2, 1)
    assert row["decoding"] == DECODING
    assert row["pass_at_1"] is None and row["model"] == "m" and row["timestamp_utc"].startswith("20")


def test_curation_from_zst_to_jsonl(spark, tmp_path):
    """The whole curation job: scan, filter, number in file order, write, release."""
    from winnow.session import release

    folder = tmp_path / "in"
    folder.mkdir()
    good = "<think>t</think> <answer>\\boxed{4}</answer>"
    for name in ("b", "a"):
        lines = []
        for n in range(50):
            info = {"reference_answer": "4" if n % 3 else "5"}
            messages = [{"role": "user", "content": f"{name}{n:02d}", "info": info},
                        {"role": "assistant", "content": good, "info": {}}]
            lines.append(json.dumps({"messages": messages}))
        zst(folder / f"{name}.jsonl.zst", "broken\n" + "\n".join(lines), 28 if name == "a" else 21)
    scan = jsonl.scan_zst_jsonl(spark, str(folder), schemas.CHAT, with_order=True)
    rows = curate.with_drop_reason(jsonl.good_lines(scan))
    report = {r["reason"]: r["n"] for r in curate.drop_report(rows).collect()}
    assert report == {"kept": 66, "incorrect": 34}
    sinks.write_jsonl(curate.indexed(curate.kept(rows)), str(tmp_path / "kept"))
    assert release(spark) > 0 and release(spark) == 0
    kept = jsonl.scan_jsonl_strict(spark, str(tmp_path / "kept"), schemas.CHAT).orderBy("idx").collect()
    expected = [f"{name}{n:02d}" for name in "ab" for n in range(50) if n % 3]
    assert [r["messages"][0]["content"] for r in kept] == expected
    assert [r["idx"] for r in kept] == list(range(66))


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = "<think>t</think> <answer>\\boxed{4}</answer>"
    for f in range(3):
        with gzip.open(folder / f"{f}.jsonl.gz", "wt") as out:
            for n in range(40):
                info = {"reference_answer": str(n % 6)}
                messages = [{"role": "user", "content": f"q{f}-{n}", "info": info},
                            {"role": "assistant", "content": good if n % 5 else "KodCode", "info": {}}]
                out.write(json.dumps({"messages": messages}) + "\n")
    held = sorted(folder.iterdir())[-1]
    last = held.read_bytes()
    held.unlink()
    # The last file arrives between two runs that share their progress.
    for arriving in (None, last):
        if arriving is not None:
            held.write_bytes(arriving)
        stream = stateless.read_chat_stream(spark, str(folder), files_per_trigger=1)
        query = stateless.run_available(stream, curate.with_drop_reason, str(tmp_path / "out"), str(tmp_path / "progress"))
        query.awaitTermination()
    batch = curate.with_drop_reason(spark.read.schema(schemas.CHAT).json(str(folder)))
    streamed = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    pick = ["to_json(messages) as m", "reason"]
    assert sorted(map(str, streamed.selectExpr(*pick).collect())) == sorted(map(str, batch.selectExpr(*pick).collect()))
    assert streamed.count() == 120


@pytest.fixture
def long_files(spark, tmp_path):
    """Files of several splits, with and without a byte order mark and a last line feed."""
    end, start = b"end", b"\xef\xbb\xbf"
    parts = {"a": b"line\r\n" * 9000, "b": start + b"\x00\xff\n" * 20_000 + end, "c": end, "d": start + b"\n" * 50_000}
    for name, data in parts.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    yield parts
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_long_file_is_followed_by_several_tasks(spark, tmp_path, long_files):
    rows = checksums.file_checksums(spark, str(tmp_path), glob="*.bin", step=40_000).collect()
    found = {r["path"].split("/")[-1][0]: (r["length"], r["sha256"]) for r in rows}
    assert found == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in long_files.items()}


def test_files_of_a_folder_are_one_stream(spark, tmp_path, long_files):
    (row,) = checksums.folder_checksums(spark, str(tmp_path), glob="*.bin", step=90_000).collect()
    whole = b"".join(long_files[n] for n in sorted(long_files))
    assert (row["length"], row["sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
