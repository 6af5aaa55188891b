import json

import pytest

from reqweave.config import EngineConfig
from reqweave.sources import convert, documents, sinks, xlsx
from reqweave.streaming import watch

CELLS = [("A-1", 'quotes "x" & <y>'), ("É-2", "日本\nline\ttab"), (None, None), ("=1+1", "_x0041_ \x0b\x01"), ("", "z" * 32767)]


def items(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, code string, description string")


def test_sheet_round_trip(spark, tmp_path):
    path = str(tmp_path / "new" / "out.xlsx")
    sinks.excel(items(spark, CELLS), path, ("i",))
    assert list(xlsx.read_file(path)) == [["Requirement Code", "Description"], *[list(r) for r in CELLS]]
    back = spark.read.format("xlsx").load(path)
    assert [tuple(r) for r in back.collect()] == CELLS and back.columns == ["Requirement Code", "Description"]


def test_empty_sheet(spark, tmp_path):
    path = str(tmp_path / "out.xlsx")
    sinks.excel(items(spark, []), path)
    assert list(xlsx.read_file(path)) == [["Requirement Code", "Description"]]


@pytest.mark.parametrize("path", ["", "  ", None])
def test_bad_path(spark, path):
    with pytest.raises(ValueError):
        sinks.excel(items(spark, CELLS), path)


def test_bad_table_and_failed_write(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.excel(spark.range(1), str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError):
        sinks.excel("rows", str(tmp_path / "x.xlsx"))
    (tmp_path / "file").write_text("")
    with pytest.raises(OSError) as e:
        sinks.excel(items(spark, CELLS), str(tmp_path / "file" / "x.xlsx"))
    assert e.value.__cause__ is not None
    with pytest.raises(OSError):
        sinks.excel(items(spark, [("a", "z" * 32768)]), str(tmp_path / "y.xlsx"))
    assert not (tmp_path / "y.xlsx").exists()


def test_lines(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, "\n"), (4, "x\n\ny"), (5, None)], "doc_id int, text string")
    got = {}
    for r in documents.lines(docs).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {1: ["a", "b", "c"], 3: [""], 4: ["x", "", "y"]}


def test_directories(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n", "utf-8")
    (tmp_path / "b.MD").write_text("no", "utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("below", "utf-8")
    got = documents.markdown_files(spark, str(tmp_path)).collect()
    assert [(r.stem, r.text) for r in got] == [("a", "# A\n")]
    pdf = documents.pdf_files(spark, str(tmp_path))
    assert [(r.stem, bytes(r.content)) for r in pdf.collect()] == [("c", b"%PDF")]
    names = lambda ext=None: [p.rpartition("/")[2] for p in documents.list_files(spark, str(tmp_path), ext)]
    assert names("..md") == ["a.md"] and names() == ["a.md", "b.MD", "c.pdf"] and documents.list_files(spark, str(tmp_path / "none")) == []
    with pytest.raises(Exception, match="not installed"):
        convert.to_markdown(pdf, convert.converter("fitz")).collect()
    with pytest.raises(ValueError):
        convert.converter("other")


def test_converters(spark):
    class Upper:
        def markdown(self, content):
            if b"bad" in content:
                raise ValueError("unreadable")
            return content.decode().upper()

        def pages(self, content):
            return [content[i : i + 1] for i in range(len(content))]

    files = spark.createDataFrame([("/x/a.PDF", "a", b"abc"), ("/x/b.pdf", "b", b"bad"), ("/x/c.txt", "c", b"c")], "doc_id string, stem string, content binary")
    got = {r.stem: (r.text, r.error) for r in convert.to_markdown(files, Upper()).collect()}
    assert got == {"a": ("ABC", None), "b": (None, "ValueError: unreadable"), "c": (None, "not a .pdf file")}
    pages = convert.to_pages(files.where("stem = 'a'"), Upper()).orderBy("page_no").collect()
    assert [(r.page_no, bytes(r.png)) for r in pages] == [(1, b"a"), (2, b"b"), (3, b"c")]


def test_json_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "out.json")
    sinks.json_rows(items(spark, [(None, "é")]).coalesce(1), path)
    line = next(p for p in (tmp_path / "out.json").glob("part-*")).read_text("utf-8")
    assert json.loads(line) == {"i": 0, "code": None, "description": "é"} and "é" in line


def test_quarantine(spark):
    docs = spark.createDataFrame([(1, "x"), (2, " \n"), (3, None)], "doc_id int, text string")
    assert [r.doc_id for r in documents.not_blank(docs).collect()] == [1]
    assert sorted(tuple(r) for r in documents.quarantined(docs).collect()) == [(2, "blank"), (3, "no text")]


def test_config(tmp_path):
    assert EngineConfig().split_size == 13300
    (tmp_path / "c.yaml").write_text("model: m\nworkers: 2\n")
    assert EngineConfig.from_yaml(str(tmp_path / "c.yaml")) == EngineConfig(model="m", workers=2)
    with pytest.raises(ValueError):
        EngineConfig.of({"colour": 1})


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for n, text in enumerate(["AB-1 x\n3\n", "# T\nbody\n"]):
        (tmp_path / "in" / f"{n}.md").write_text(text)
        watch.clean_stream(spark, str(tmp_path / "in"), out, check).awaitTermination()
    got = {r.doc_id.rpartition("/")[2]: r.text for r in spark.read.parquet(out).collect()}
    assert got == {"0.md": "AB-1 x\n\n", "1.md": "# T\n"}
