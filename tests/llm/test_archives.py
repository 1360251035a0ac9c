"""Archives that come out alike from any dealing of the pages; operators on workers without the library."""

import hashlib
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voltloom.llm import warc
from voltloom.llm.files import opened

PAGES = "page_id bigint, url string, html string, shard int, N string"


def rows():
    big = "<p>" + "é" * 80
    made = [(i * 7 % 501, f"http://h/{i}", f"<p>{i % 40} " + "word " * (i % 97), 0, "x") for i in range(600)]
    return made + [(None, "u", big, 0, "x")] * 3 + [(4, None, big, 0, "x")] * 9 + [(4, "", big, 0, None), (4, "v", big, 0, "x")] + [
        (6, "u", None, 0, "x"), (6, "u", "", 0, "y"), (-3, "u", big + "!", 0, "x"), (-3, "u", big + "?", 0, "x")]


def contents(folder, manifest):
    fs, top = opened(folder)
    files = {}
    for r in manifest.collect():
        with fs.open_input_stream(f"{top}/{r['name']}", compression=None) as stream:
            data = stream.read()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["bytes"]
        files[r["name"]] = r["sha256"], r["records"]
    return files


def expected(made):
    """Per page: payload size, digest, type, owner; by plain loops."""
    least = {}
    for page, _, html, *_ in made:
        body = (html or "").encode()
        if page is not None and len(body) >= 100:
            least[body] = min(page, least.get(body, page))
    out = Counter()
    for page, _, html, *_ in made:
        body = (html or "").encode()
        owner = least.get(body)
        again = page is not None and owner is not None and page > owner
        out[page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", owner if again else None] += 1
    return out


def test_same_files_from_any_dealing(spark, monkeypatch):
    made = rows()
    pages = spark.createDataFrame(made, PAGES)
    settings = {"roll_bytes": 3000, "shard_bytes": 12_000}
    first = warc.write(pages.repartition(3), **settings)
    files = contents(*first)
    assert len({n.split("-")[1] for n in files}) > 5 and any(n.endswith("-00002.warc.gz") for n in files)
    assert sum(records for _, records in files.values()) == len(made)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert contents(*warc.write(pages.orderBy(F.desc("url")).repartition(7), **settings)) == files
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    read = warc.read(*first).collect()
    assert len({r["record_id"] for r in read}) == len(made)
    assert Counter(tuple(r)[:5] for r in read) == expected(made)


def test_records_repeated_often_are_written_in_parts(spark, monkeypatch):
    made = rows() + [(4, "http://hot", "<b>" + "hot " * 60, 0, "x")] * 200 + [(None, None, None, 0, "x")] * 50 + [(9, "http://hot", "<b>" + "hot " * 60, 0, "x")] * 41
    pages = spark.createDataFrame(made, PAGES).repartition(5)
    monkeypatch.setattr(warc, "REPEATS", 8)
    first = warc.write(pages, shard_bytes=4_000)
    files = contents(*first)
    assert max(records for _, records in files.values()) < 120  # 200 equal records are not one file's
    assert contents(*warc.write(pages.repartition(2), shard_bytes=4_000)) == files
    read = warc.read(*first).collect()
    assert len({r["record_id"] for r in read}) == len(made)
    assert Counter(tuple(r)[:5] for r in read) == expected(made)


def test_no_pages(spark):
    folder, manifest = warc.write(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and warc.read(folder, manifest).count() == 0


@pytest.mark.parametrize("call", ["bpe.digests(bpe.encode(d))", "tokenfiles.digests(d)", "counts.token_counts(d, white=True)", "warc.digests(d.withColumnsRenamed({'doc_id': 'page_id', 'text': 'html'}).withColumn('url', F.lit(None).cast('string')))"])
def test_workers_without_the_library(call, tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    program = f"""
import sys
sys.path.insert(0, {top!r})
from pyspark.sql import SparkSession, functions as F
from voltloom.llm import bpe, counts, tokenfiles, warc
s = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
     .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
def seen(batches):
    import importlib.util, pyarrow as pa
    for _ in batches:
        yield pa.record_batch([pa.array([importlib.util.find_spec("voltloom") is not None])], names=["seen"])
assert not any(r[0] for r in s.range(2).mapInArrow(seen, "seen boolean").collect())
d = s.createDataFrame([(1, "a few words"), (2, None), (3, "a few words more")], "doc_id bigint, text string")
assert {call}.count() == 3
"""
    path = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != top)
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
