"""Strict readers, writers and snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import result_key
from docloom.operators import store
from docloom.sources import files


def record(**changes):
    import hashlib

    base = {
        "key": "", "category": "fixed", "breaking": False, "breaking_reason": "", "model": "m", "effort": "low",
        "prompt_version": "v2", "release": "1.2.0", "text": "Fixed a bug.", "classified_at": 1.5,
    }
    base.update(changes)
    if "key" not in changes:
        digest = hashlib.sha256("\n".join([base["prompt_version"], base["model"], base["effort"], str(base["text"]).strip()]).encode())
        base["key"] = digest.hexdigest()
    return base


def write(path, lines, tail="\n"):
    path.mkdir()
    (path / "a.jsonl").write_text("\n".join(lines) + tail)
    return str(path)


CASES = {
    "not valid JSON": '{"key": "torn',
    "not a JSON object": "[1]",
    "missing or unexpected fields extra": json.dumps(record() | {"extra": 1}),
    "missing or unexpected fields effort": json.dumps({k: v for k, v in record().items() if k != "effort"}),
    "model is not a string": json.dumps(record(model=3, key="x")),
    "text is empty": json.dumps(record(text="  ")),
    "breaking is not true or false": json.dumps(record(breaking="true")),
    "classified_at is not a number": json.dumps(record(classified_at="1.5")),
    "unknown category": json.dumps(record(category="odd")),
    "malformed release": json.dumps(record(release="1.2")),
    "key does not match its text and settings": json.dumps(record(key="0" * 64)),
}


def test_strict_lines(spark, tmp_path):
    lines = [json.dumps(record()), *CASES.values(), json.dumps(record(text="Übung — zwei", classified_at=7))]
    good, bad = files.read_strict_jsonl(spark, write(tmp_path / "in", lines, tail=""))
    assert {(r.line_no, r.reason) for r in bad.collect()} == {(i + 2, reason) for i, reason in enumerate(CASES)}
    rows = {r.text: r for r in good.collect()}
    assert set(rows) == {"Fixed a bug.", "Übung — zwei"}
    assert rows["Fixed a bug."].classified_at.timestamp() == 1.5


def test_line_numbers_over_file_splits(spark, tmp_path):
    path = write(tmp_path / "in", [f"line {i} " + "x" * (i % 50) for i in range(1, 4001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        assert {(r.line_no, r.value.split()[1]) for r in lines.collect()} == {(i, str(i)) for i in range(1, 4001)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_lines_are_read_back(spark, tmp_path):
    path = write(tmp_path / "in", [json.dumps(record(text=f"Added {i}.", classified_at=i / 4)) for i in range(20)])
    good, _ = files.read_strict_jsonl(spark, path)
    files.write_jsonl(good, str(tmp_path / "out"))
    again, bad = files.read_strict_jsonl(spark, str(tmp_path / "out"))
    assert bad.isEmpty() and again.exceptAll(good).isEmpty() and again.count() == 20


def test_manifest(spark, tmp_path):
    good = {"version": "1.2.3", "installed_at": 5, "paths": ["man3/a.3", "man7/b.7.gz"]}
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({
        "/man": good, "/empty": good | {"paths": [], "incomplete": True}, "man": good, "/v": good | {"version": "latest"},
        "/t": good | {"installed_at": "soon"}, "/f": good | {"incomplete": "yes"}, "/p": good | {"paths": ["etc/x"]}, "/s": good | {"paths": "man3/a.3"},
        "/o": 7,
    }, indent=1))
    (folder / "b.json").write_text("{broken")
    records, bad = files.read_manifest_strict(spark, str(folder), r"^man[37]/[^/]+\.[37](?:\.gz)?$")
    assert {(r.dir, r.path, r.incomplete) for r in records.collect()} == {
        ("/man", "man3/a.3", False), ("/man", "man7/b.7.gz", False), ("/empty", None, True)
    }
    assert {(r.dir, r.reason) for r in bad.collect()} == {
        ("man", "folder is not absolute"), ("/v", "invalid version"), ("/t", "invalid timestamp"), ("/f", "incomplete is not true or false"),
        ("/p", "unexpected path"), ("/s", "paths is not a list of strings"), ("/o", "record is not an object"),
        (None, "not a JSON object of folder to record"),
    }


def test_cells(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    samples = {"t0": [0.0, 1.0], "t1": [1.0, 2.0], "server_recv": [0.1, 1.1], "server_send": [0.9, 1.9], "delay": [0.8, 0.8], "error": [None, "x.Y"]}
    (folder / "a.json").write_text(json.dumps({"cell": {"mode": "threads", "concurrency": 2}, "worker": {"wall_s": 2.0, "samples": samples}}, indent=2))
    (folder / "b.json").write_text(json.dumps({"cell": {"mode": "raw-asyncio", "concurrency": 2}, "worker": None}, indent=2))
    rows = files.scan_cells(spark, str(folder)).collect()
    assert sorted((r["mode"], r["t0"], r["error"], r["completed"]) for r in rows if r["completed"]) == [("threads", 0.0, None, True), ("threads", 1.0, "x.Y", True)]
    assert [(r["mode"], r["t0"]) for r in rows if not r["completed"]] == [("raw-asyncio", None)]


def test_page_tree(spark, tmp_path):
    for rel in ("index.html", "doc/a.html", "doc/skip/b.html", "doc/c.txt"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(f"<p>{rel} é</p>")
    pages = files.scan_pages(spark, str(tmp_path), excluded=("doc/skip/",))
    assert {(r.rel, r.html) for r in pages.collect()} == {("index.html", "<p>index.html é</p>"), ("doc/a.html", "<p>doc/a.html é</p>")}


def test_documents_refuse_duplicates(spark, tmp_path):
    docs = spark.createDataFrame([("a", "man3", "x"), ("a", "man7", "y"), ("b", "man3", "z")], "name string, section string, body string")
    files.write_documents(docs, str(tmp_path / "ok"), gzip=True)
    assert {p.name for p in (tmp_path / "ok").iterdir() if p.is_dir()} == {"section=man3", "section=man7"}
    with pytest.raises(ValueError, match="appears 2 times"):
        files.write_documents(docs.unionByName(docs.filter("section = 'man7'")), str(tmp_path / "no"))


def test_sorted_lines(spark, tmp_path):
    lines = spark.range(500).select((499 - F.col("id")).alias("n"), F.format_string("%03d", 499 - F.col("id")).alias("line"))
    files.write_sorted_lines(lines.repartition(6), ["n"], str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt")
    assert "".join(p.read_text() for p in parts).split() == [f"{i:03d}" for i in range(500)]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.latest_version(spark, root) == 0 and store.read_snapshot(spark, root).isEmpty()
    text = spark.createDataFrame([("a",), ("b",)], "text string")
    rows = text.select(
        result_key(F.lit("v"), F.lit("m"), F.lit("low"), F.col("text")).alias("key"), F.lit("fixed").alias("category"), F.lit(False).alias("breaking"),
        *[F.lit("").alias(c) for c in ("breaking_reason", "model", "effort", "prompt_version", "release")], "text", F.current_timestamp().alias("classified_at"),
    )
    store.commit_snapshot(rows, root)
    changed = rows.filter("text = 'a'").withColumn("category", F.lit("added"))
    store.commit_changes(changed, root)
    assert {(r.text, r.category) for r in store.read_snapshot(spark, root).collect()} == {("a", "added"), ("b", "fixed")}
    assert store.stored_keys(spark, root).count() == 2
    for i in range(store.COMPACT_AFTER + 3):
        store.commit_changes(changed.withColumn("release", F.lit(f"1.{i}.0")), root)
    assert len(store._visible(spark, root)) < store.COMPACT_AFTER
    assert {(r.text, r.release) for r in store.read_snapshot(spark, root).collect()} == {("a", f"1.{i}.0"), ("b", "")}
    spark.range(1).select(F.lit(99).cast("bigint").alias("version"), F.lit(2).alias("schema_version"), F.lit(False).alias("is_full")).write.mode("append").parquet(f"{root}/commits")
    with pytest.raises(ValueError, match="newer"):
        store.read_snapshot(spark, root)
