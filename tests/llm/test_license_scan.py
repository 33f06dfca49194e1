"""Licences: templates, inheritance along paths, odd rows."""

from storyspark.llm import license_scan as LS

SCHEMA = "path string, text string, licence string"
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def scanned(spark, rows):
    out = LS.scan(spark.createDataFrame(rows, SCHEMA))
    return {r.path: (r.licence, r.origin, r.licence_dir) for r in out.collect()}


def test_own_and_inherited(spark):
    prose = "some words about something else " * 20
    rows = [("LICENSE", GPL, ""), ("a/LICENSE.txt", "text\n" * 30 + MIT, ""), ("a/x.py", prose, ""), ("a/b/c/y.py", prose, ""),
            ("ab/z.py", prose, ""), ("a/b/own.py", prose + "\nLicensed under CC BY-NC 4.0. " + prose, ""),
            ("top.py", prose, ""), ("a/b/d/notice.md", LS.TEMPLATES[3][1], ""), ("a/b/d/e/f.py", prose, ""),
            ("g/only.txt", "licensed under the Apache License, version 2.0", ""), ("g/h.py", prose, "")]
    got = scanned(spark, rows)
    assert got["a/x.py"] == ("MIT", "inherited", "a") and got["a/b/c/y.py"] == ("MIT", "inherited", "a")
    assert got["ab/z.py"] == got["top.py"] == ("GPL-3.0", "inherited", "")
    assert got["a/b/own.py"] == ("CC-BY-NC-4.0", "own", None)
    assert got["a/b/d/e/f.py"] == ("Apache-2.0", "inherited", "a/b/d") and got["g/h.py"] == ("Apache-2.0", "inherited", "g")


def test_every_template_names_its_licence(spark):
    rows = [(f"d{i}/t.txt", "word " * 50 + "\n" + t, "") for i, (_, t) in enumerate(LS.TEMPLATES) if "icen" in t or "opyright" in t]
    got = scanned(spark, rows)
    for i, (name, t) in enumerate(LS.TEMPLATES):
        if f"d{i}/t.txt" in got:
            assert got[f"d{i}/t.txt"][0] == name, t


def test_odd_rows(spark):
    rows = [(None, None, "x"), ("a", "", "x"), ("b/c", "a licence to act freely was never on the table for them", "x"), ("r/s", MIT, "x"), ("r/s", MIT, "x"),
            ("l/long", "word " * 100000 + "\n" + MIT, "x"), ("t/ties", MIT + "\n" + GPL, "x")]
    out = LS.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r.path: r for r in out}
    assert by[None].origin == by["a"].origin == by["b/c"].origin == "none" and by["r/s"].licence == "MIT" and by["l/long"].licence == "MIT"
    assert by["t/ties"].licence in ("MIT", "GPL-3.0") and by["t/ties"].origin == "own"
    assert LS.scan(spark.createDataFrame([], SCHEMA)).collect() == []
