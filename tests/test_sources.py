"""Sources and sinks on files made here."""

import hashlib

import pytest

from vitrine.sources import files


def test_jsonl_modes(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1, "ok": true}\nnot json\n{"id": 2, "ok": false}\n')
    assert sorted(r["id"] for r in files.read_jsonl(spark, path, "id long, ok boolean", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, path, "id long, ok boolean", strict=True).collect()
    out = str(tmp_path / "out")
    rows = spark.range(3)
    files.write_jsonl(rows, out)
    files.write_jsonl(rows, out, append=True)
    assert spark.read.json(out).count() == 6


def test_urls_and_images(spark, tmp_path):
    (tmp_path / "u.txt").write_text("a.b\n\n http://c/d#x \nhttp://c/d\nftp://no\n")
    assert sorted(r["url"] for r in files.read_urls(spark, str(tmp_path / "u.txt")).collect()) == ["http://c/d", "https://a.b/"]
    (tmp_path / "img" / "sub").mkdir(parents=True)
    for name in ("b.png", "a.JPG", "c.txt", "sub/d.webp"):
        (tmp_path / "img" / name).write_bytes(name.encode())
    found = files.read_images(spark, str(tmp_path / "img")).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["a.JPG", "b.png"]
    assert found[0]["hash"] == hashlib.sha256(b"a.JPG").hexdigest()
    assert files.read_images(spark, str(tmp_path / "img"), recursive=True).count() == 3
    assert files.read_images(spark, str(tmp_path / "img"), head=1).count() == 1


def test_json_lines_in_a_column(spark):
    lines = spark.createDataFrame([('{"id": 1}',), ("",), ("not json",), ('{"id": 2, "x": 3}',), (None,)], "line string")
    assert sorted(r["id"] for r in files.parse_jsonl(lines, "line", "id long", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.parse_jsonl(lines, "line", "id long", strict=True).collect()


def test_objects_stay_in_their_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.png").write_bytes(b"x")
    row = files.read_object(spark, str(tmp_path), "/a\\b.png").first()
    assert (row["key"], row["content_type"], bytes(row["content"])) == ("a/b.png", "image/png", b"x")
    for bad in ("", " ", "a/../b.png", "/"):
        with pytest.raises(ValueError, match="object key"):
            files.read_object(spark, str(tmp_path), bad)


def test_introspection(spark):
    spark.range(1).createOrReplaceTempView("known_rows")
    assert files.has_table(spark, "known_rows") and not files.has_table(spark, "unknown_rows")
    assert files.has_column(spark.range(1), "ID") and not files.has_column(spark.range(1), "other")


def test_jdbc_reads_ranges_of_a_key(spark):
    """The options that the reader gets; there is no driver for a store here."""
    class Reader:
        def __init__(self):
            self.given = {}

        def format(self, kind):
            self.given["format"] = kind
            return self

        def option(self, key, value):
            self.given[key] = value
            return self

        def options(self, **more):
            self.given |= more
            return self

        def load(self):
            return self.given

    class Session:
        read = Reader()

    got = files.read_jdbc(Session(), "jdbc:x", "images", "id", 1, 100, user="u")
    assert got == {"format": "jdbc", "url": "jdbc:x", "dbtable": "images", "user": "u", "partitionColumn": "id", "lowerBound": 1, "upperBound": 100, "numPartitions": 12}
