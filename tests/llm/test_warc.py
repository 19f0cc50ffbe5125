"""Archives: the exact round trip, determinism, rolling, damage."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import pytest

from loomline.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def cases():
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 7}.example/{i}", "".join(rng.choice("abc é\r\n") for _ in range(rng.randrange(400)))) for i in range(150)]
    rows += [(1000 + i, "http://copy.example/", "<p>" + "copy " * 60) for i in range(80)]
    rows += [(2000 + i, None, "short") for i in range(5)] + [(3000, "http://x y/\n", None), (3001, "u", ""), (-5, "neg", "<p>" + "copy " * 60), (None, "no id", "<p>" + "copy " * 60), (None, "n2", "q" * 200), (1000, "again", "<p>" + "copy " * 60)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p in groups[html or ""] if p is not None]
        first = min(ids) if ids and len(groups[html or ""]) > 1 and len(data) >= 100 else page
        revisit = page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def test_round_trip(spark):
    rows = cases()
    assert rows_of(warc.round_trip(pages(spark, rows))) == expected(rows)


def test_deterministic_shards(spark, tmp_path):
    rows = cases()
    seen = []
    for k, df in enumerate((pages(spark, rows), pages(spark, rows[::-1]).repartition(7))):
        root = warc.write(df, f"file://{tmp_path}/{k}", shard_bytes=4000, file_bytes=1500)
        entries = sorted(tuple(r) for r in warc.files(spark, root).collect())
        told = json.loads((tmp_path / str(k) / warc.MANIFEST).read_text())
        assert (told["n_files"], told["n_records"], told["bytes"]) == (len(entries), len(rows), sum(e[2] for e in entries))
        assert rows_of(warc.read(spark, root)) == expected(rows)
        assert not list((tmp_path / str(k)).glob("_temporary*"))
        seen.append(entries)
    assert seen[0] == seen[1] and len(seen[0]) > 8
    assert len({e[0].split("-")[1] for e in seen[0]}) > 3 and any(e[0].endswith("0001.warc.gz") for e in seen[0])


def test_even_shards(spark, tmp_path):
    """One id far from all others, one with a third of all rows, and a third without any."""
    rows = [(i, f"u{i}", f"{i} " * 60) for i in range(200)] + [(1 << 40, "far", "x" * 300)]
    rows += [(77, f"hot{i}", f"{i}h" * 60) for i in range(200)] + [(None, f"none{i}", f"{i}n" * 60) for i in range(200)]
    total = sum(len(h) for _, _, h in rows)
    root = warc.write(pages(spark, rows), f"file://{tmp_path}/w", shard_bytes=total // 20)
    shards = defaultdict(int)
    for r in warc.files(spark, root).collect():
        shards[r["file"].split("-")[1]] += r["n_records"]
    assert sum(shards.values()) == len(rows) and len(shards) >= 19 and max(shards.values()) <= 2 * len(rows) / 20
    assert rows_of(warc.read(spark, root)) == expected(rows)


def test_records_are_members(spark, tmp_path):
    warc.write(pages(spark, [(1, "http://a/", "x" * 50), (2, "http://b/", "y")]), f"file://{tmp_path}/w")
    (entry,) = warc.files(spark, f"file://{tmp_path}/w").collect()
    data = (tmp_path / "w" / entry["file"]).read_bytes()
    first = zlib.decompressobj(31)
    text = first.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\n") and first.unused_data


def test_unfinished_and_damaged(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"file://{tmp_path}/none")
    warc.write(pages(spark, [(1, "http://a/", "x" * 500)]), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("shard*.gz")
    (tmp_path / "w" / "stray.warc.gz").write_bytes(b"no archive")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 1
    file.write_bytes(file.read_bytes()[:-20])
    with pytest.raises(Exception, match="record|stream|file ends"):
        warc.read(spark, f"file://{tmp_path}/w").collect()


def test_empty_and_extra_columns(spark):
    assert warc.round_trip(pages(spark, []).limit(0)).collect() == []
    df = pages(spark, [(1, "a", "b")]).selectExpr("*", "'x' AS digest", "'y' AS shard", "'z' AS first_id", "1 AS salt", "0 AS n")
    assert warc.round_trip(df).count() == 1
