import os

from pyspark.sql import functions as F

from tessella.sources import io


def test_newest_document_of_each_pool_that_has_items(spark, tmp_path):
    texts = {
        "a/one.json": ('{"episodes": [{"i": 1}]}', 100),
        "a/two.json": ('{"episodes": [{"i": 1}, {"i": 2}], "more": 3}', 200),
        "a/empty.json": ("", 300),
        "a/none.json": ('{"episodes": []}', 400),
        "a/other.json": ('{"rows": [1]}', 500),
        "a/broken.json": ('{"episodes": [', 600),
        "a/notes.txt": ('{"episodes": [{"i": 1}]}', 700),
        "b/x.json": ('{"episodes": [{"i": 1}]}', 100),
        "b/y.json": ('{"episodes": [{"i": 1}, {"i": 2}, {"i": 3}]}', 100),
        "c/z.json": ("null", 100),
        "d/old.list": ('[{"i": 1}, 2]', 100),
        "d/kind.list": ('{"i": 1}', 200),
        "d/cut.list": ('[{"i": 1}, {', 300),
        "d/none.list": ("[]", 400),
    }
    for name, (text, at) in texts.items():
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text(text)
        os.utime(file, (at, at))
    got = io.newest_documents(spark, str(tmp_path), "*.json", r"/([^/]+)/[^/]+$", "episodes", "i int").collect()
    assert {(r.pool, r.path.rsplit("/", 1)[1], r.n_items) for r in got} == {("a", "two.json", 2), ("b", "y.json", 3)}
    lists = io.newest_documents(spark, str(tmp_path), "*.list", r"/([^/]+)/[^/]+$").collect()
    assert [(r.pool, r.path.rsplit("/", 1)[1], r.n_items) for r in lists] == [("d", "old.list", 2)]
    files = io.files_of(spark, str(tmp_path), "*.json").withColumn("pool", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    assert {(r.pool, r.path.rsplit("/", 1)[1]) for r in io.last_file(files, ["pool"], newest=True).collect()} == {("a", "broken.json"), ("b", "y.json"), ("c", "z.json")}
    assert {(r.pool, r.path.rsplit("/", 1)[1]) for r in io.last_file(files, ["pool"]).collect()} == {("a", "two.json"), ("b", "y.json"), ("c", "z.json")}
