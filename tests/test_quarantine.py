"""Logs of which some files are damaged."""

import bz2
import gzip
import json
import os

from sloframe.sources import quarantine, readers


def lines(n, at=0):
    return "".join(json.dumps({"i": i, "t": "é" * 20}) + "\n" for i in range(at, at + n)).encode()


def test_damaged_files_are_left_out_and_listed(spark, tmp_path):
    packed = gzip.compress(lines(4000))
    files = {
        "a/whole.jsonl.gz": packed, "a/cut.jsonl.gz": packed[: len(packed) // 2], "a/no_end.jsonl.gz": packed[:-4], "b/not_packed.jsonl.gz": lines(5),
        "b/two.jsonl.gz": gzip.compress(lines(3, 10_000)) + gzip.compress(lines(2, 10_003)), "b/plain.jsonl": lines(7, 20_000), "b/bytes.jsonl": lines(3) + b"\xff\xfe\n",
        "c/small.jsonl.bz2": bz2.compress(lines(6, 30_000)), "c/cut.jsonl.bz2": bz2.compress(lines(500))[:-9], "c/empty.jsonl": b"", "c/other.txt": b"\xff",
        "c/bad line.jsonl": b'{"i": 40000}\n{"i": \n',
    }
    for name, content in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows, outcomes = quarantine.read_whole_logs(spark, str(tmp_path), "i bigint, t string")
    assert sorted(r.i for r in rows.collect()) == [*range(4000), *range(10_000, 10_005), *range(20_000, 20_007), *range(30_000, 30_006), 40_000]
    bad = {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[-1]: r.error for r in outcomes.where("status = 'unreadable'").collect()}
    assert sorted(bad) == ["a/cut.jsonl.gz", "a/no_end.jsonl.gz", "b/bytes.jsonl", "b/not_packed.jsonl.gz", "c/cut.jsonl.bz2"]
    assert bad["a/cut.jsonl.gz"].startswith("EOFError") and bad["b/bytes.jsonl"].startswith("UnicodeDecodeError")
    assert outcomes.count() == 10  # an empty file has nothing to read


def test_a_folder_without_damage_reads_as_before(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_bytes(lines(5, 10 * i))
    rows, outcomes = quarantine.read_whole_logs(spark, str(tmp_path), "i bigint, t string")
    same = readers.read_logs(spark, str(tmp_path), "i bigint, t string")
    assert sorted(rows.collect()) == sorted(same.collect()) and outcomes.where("status <> 'ok'").count() == 0
