"""Parsing in batches, strict lines, and proofs of sufficiency."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import types as ST

from millrace.operators import spans
from millrace.sources import jsonlines, parsing


def sheet(rows):
    cells = lambda r, i: "".join(f'<c r="{chr(65 + j)}{i}"{t}>{v}</c>' for j, t, v in r)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}">{cells(r, i)}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"


def workbook(n=3):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="S{i}" r:id="r{i}"/>' for i in range(n)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(n)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>')
        for i in range(n):
            rows = [[(0, ' t="s"', "<v>0</v>"), (2, ' t="s"', "<v>1</v>")], [(1, "", "<v>4.5</v>"), (2, ' t="b"', "<v>1</v>"), (3, ' t="inlineStr"', "<is><t>x\ty</t></is>")]]
            z.writestr(f"xl/worksheets/s{i}.xml", sheet(rows if i != 1 else []))
    return out.getvalue()


def test_batches_hold_what_the_whole_holds():
    rng = random.Random(1)
    for _ in range(20):
        text = "\x0c".join("\n\n".join(rng.choices(["a", "b c", " ", "d\ne"], k=rng.randrange(4))) for _ in range(rng.randrange(1, 30)))
        whole = [b for *_, blocks in parsing.fragments(text.encode(), 10**6) for b in blocks]
        parts = list(parsing.fragments(text.encode(), 4))
        assert [b for *_, blocks in parts for b in blocks] == whole
        assert [p[0] for p in parts] == list(range(1, len(parts) + 1)) and all(b - a < 4 for _, a, b, _ in parts)
        assert parts[-1][2] == text.count("\x0c") + 1 and all(a <= x[1] <= b for _, a, b, blocks in parts for x in blocks)


def test_sheets():
    got = list(parsing.fragments(workbook(), 2))
    assert [(no, a, b) for no, a, b, _ in got] == [(1, 1, 2), (2, 3, 3)]
    assert got[0][3] == [("#/texts/0", 1, "section_header", 1, "S0"), ("#/tables/0", 1, "table", None, "one\t\ttwo\n\t4.5\tTRUE\tx y"), ("#/texts/1", 2, "section_header", 1, "S1")]
    assert got[1][3][1][0] == "#/tables/1"


def test_folder_against_its_manifest(spark, tmp_path, monkeypatch):
    files = {"a.txt": "one\n\ntwo\x0cthree".encode(), "b.html": b"<html><h1>T</h1><p>x", "c.xlsx": workbook(2), "d.txt": b"\xff\xfe", "e.pdf": b"%PDF-1.7", "f.txt": b"fine", "g.xlsx": b"PK\x03\x04broken", "empty.txt": b""}
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    rows = [(n, len(c), hashlib.sha256(c).hexdigest() if n != "f.txt" else "0") for n, c in files.items()] + [("gone.txt", 1, "x")]
    got = parsing.parsed_folder(spark, str(tmp_path / "in"), spark.createDataFrame(rows, "name string, size long, sha256 string"), 1).collect()
    problems = {r.name: r.problem for r in got if r.problem}
    assert problems == {"d.txt": "not UTF-8", "e.pdf": "no parser for this type", "f.txt": "failed the integrity check", "g.xlsx": "not a container", "gone.txt": "failed the integrity check"}
    a = sorted((r.batch_no, r.page_from, r.page_to, [(b.ref, b.text) for b in r.blocks]) for r in got if r.name == "a.txt")
    assert a == [(1, 1, 1, [("#/texts/0", "one"), ("#/texts/1", "two")]), (2, 2, 2, [("#/texts/2", "three")])]
    assert len([r for r in got if r.name == "c.xlsx"]) == 2 and [len(r.blocks) for r in got if r.name == "empty.txt"] == [0]
    monkeypatch.setattr(parsing, "PAGES", 1)
    with pytest.raises(ValueError, match="too many"):
        list(parsing.fragments(b"a\x0cb"))


@pytest.mark.parametrize(("line", "problem"), [('{"id": "a"}', None), (" ", "blank row"), ("{", "not JSON"), ("[1]", "not an object"), ('{"id": Infinity}', "non-finite value"), ('{"id": 1e999}', "non-finite value"), ('{"a": {"b": 1, "b": 1}}', "repeated key"), ('{"a": [{"Raw_Tool": 1}]}', "unsafe key"), ("[" * 100_000, "not JSON")])
def test_lines(line, problem):
    import re

    assert jsonlines.line_problem(line, re.compile(jsonlines.UNSAFE, re.I)) == problem


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(f'{{"id": "k{i if i != 700 else 3}", "n": {i}}}\n' for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = jsonlines.numbered_lines(spark, str(path))
        assert all(f'"n": {r.line - 1}}}' in r.value for r in lines.collect())
        bad = jsonlines.judged_lines(lines, "id").where("problem is not null").collect()
        assert [(r.line, r.problem) for r in bad] == [(701, "repeated id")]
        schema = ST.StructType().add("id", "string").add("n", "long")
        with pytest.raises(Exception, match="x.jsonl:701: repeated id"):
            jsonlines.strict_json_lines(spark, str(path), schema, "id").collect()
        path.write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}')
        assert sorted(map(tuple, jsonlines.strict_json_lines(spark, str(path), schema, "id").collect())) == [("a", 1), ("b", 2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_members_that_a_proof_needs(spark):
    rng = random.Random(7)
    facts, members, want = [], [], {}

    def covers(ranges, a, b):
        return all(any(lo <= x < hi for lo, hi in ranges) for x in range(a, b))

    for f in range(120):
        a, b = 5, 5 + rng.randrange(1, 12)
        mine = [(lo := rng.randrange(0, 18), lo + rng.randrange(0, 9)) for _ in range(rng.randrange(1, 6))]
        facts.append((f, a, b))
        members += [(f, m, lo, hi) for m, (lo, hi) in enumerate(mine)]
        want[f] = (covers(mine, a, b), sum(not covers(mine[:m] + mine[m + 1 :], a, b) for m in range(len(mine))), len(mine))
    got = spans.proven(spark.createDataFrame(facts, "f int, low int, high int"), spark.createDataFrame(members, "f int, m int, low int, high int"), "f", "m")
    assert {r.f: (r.sufficient, r.needed, r.members) for r in got.collect()} == want
