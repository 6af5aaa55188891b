"""Whole ways from a directory to its results: commands, page images, batch and stream."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from reqweave import __main__ as commands
from reqweave.config import EngineConfig
from reqweave.log import counted, logger
from reqweave.operators import chunks, generate
from reqweave.plans import cleaning, vision
from reqweave.sources import convert, documents, files, sinks, xlsx
from reqweave.streaming import watch

DOC = "# Title\n\nnoise\n\n## AB-1 : one\nThe first.\n\n12\n\n## AB-2 : two\nThe second.\n\n## Other\nno more\n"


class Pages:
    """A converter whose pages are the lines of a file."""

    def markdown(self, content):
        return content.decode()

    def pages(self, content):
        if b"bad" in content:
            raise ValueError("unreadable")
        return content.split(b"\n")


class Reader(generate.RuleBackend):
    """Answers with the images' own text as codes."""

    def ask(self, prompt, model, system, schema, images, temperature):
        import base64

        seen = [base64.b64decode(i).decode() for i in images]
        if "fail" in seen:
            raise OSError("no answer")
        return json.dumps({"root": [{"code": s, "description": f"{len(seen)} pages"} for s in seen]})


def test_page_images_to_requirements(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.pdf").write_bytes("\n".join(f"A-{i}" for i in range(1, 12)).encode())
    (source / "b.pdf").write_bytes(b"B-1\nfail\nB-3")
    config = EngineConfig.of({"model": "rules"})
    got = vision.extract(spark, str(source), Pages(), Reader(), out, config).orderBy("pdf", "page_index", "item_no").collect()
    # pages go by number, so 10 and 11 come last; a failed request loses its own pages only
    assert [r.code for r in got] == [*(f"A-{i}" for i in range(1, 12)), "B-3"]
    assert [r.page_index for r in got] == [1, 1, 3, 3, 5, 5, 7, 7, 9, 9, 11, 3]
    lines = [json.loads(x) for f in (tmp_path / "out" / "responses").glob("*.json") for x in f.read_text("utf-8").splitlines()]
    assert len(lines) == 8 and all(set(x) == {"pdf", "page_index", "image", "response"} for x in lines)
    assert {x["image"] for x in lines if x["page_index"] == 11} == {"a/page_11.png"}
    # a second run converts new files only and asks for nothing that it knows
    (source / "c.pdf").write_bytes(b"C-1")
    (source / "a.pdf").write_bytes(b"changed")

    class Once(Reader):
        def ask(self, prompt, model, system, schema, images, temperature):
            if len(images) == 2:
                raise OSError("asked again")
            return super().ask(prompt, model, system, schema, images, temperature)

    again = vision.extract(spark, str(source), Pages(), Once(), out, config).collect()
    assert {r.code for r in again} == {r.code for r in got} | {"C-1"}
    with pytest.raises(RuntimeError):
        vision.responses(spark.read.parquet(f"{out}/pages"), Reader(), f"{out}/cache", EngineConfig.of({"model": "none"}))


def test_page_and_markdown_files(spark, tmp_path):
    pages = spark.createDataFrame([("/x/a.pdf", 1, b"one"), ("/x/a.pdf", 10, b"ten"), ("/y/b.pdf", 1, b"")], "pdf string, page_no long, png binary")
    assert sinks.page_files(pages, str(tmp_path / "png")).agg(F.sum("bytes")).first()[0] == 6
    assert (tmp_path / "png" / "a" / "page_10.png").read_bytes() == b"ten" and (tmp_path / "png" / "b" / "page_1.png").read_bytes() == b""
    texts = spark.createDataFrame([("1", "d", "é"), ("2", "d", "later"), ("3", "e", None)], "doc_id string, stem string, text string")
    assert {(r.name, r.bytes) for r in sinks.markdown_files(texts, f"file://{tmp_path}/md").collect()} == {("d.md", 5), ("e.md", 0)}
    assert sorted(p.name for p in (tmp_path / "md").iterdir()) == ["d.md", "e.md"]


def test_file_administration(spark, tmp_path):
    at = str(tmp_path / "new" / "dir")
    assert not files.dir_exists(spark, at)
    files.create_dir(spark, at)
    files.create_dir(spark, at)
    (tmp_path / "f").write_text("x")
    files.copy_file(spark, str(tmp_path / "f"), f"{at}/g")
    files.copy_file(spark, str(tmp_path / "f"), f"{at}/g")
    assert files.dir_exists(spark, at) and files.file_exists(spark, f"{at}/g") and not files.file_exists(spark, at) and not files.dir_exists(spark, f"{at}/g")
    assert files.delete_file(spark, f"{at}/g") and not files.delete_file(spark, f"{at}/g") and not files.delete_file(spark, at)
    with pytest.raises(FileNotFoundError):
        files.copy_file(spark, f"{at}/g", f"{at}/h")


def test_batch_cleaning(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text(DOC, "utf-8")
    (source / "b.md").write_text("nothing here\n", "utf-8")
    got = {r.stem: r.text for r in cleaning.clean_directory(spark, str(source), str(tmp_path / "out"), as_files=True).collect()}
    assert "AB-1" in got["a"] and "The second." in got["a"] and "noise" not in got["a"] and "12" not in got["a"] and got["b"] == ""
    assert (tmp_path / "out-files" / "a.md").read_text("utf-8") == got["a"]
    stream = watch.clean_stream(spark, str(source), str(tmp_path / "stream"), str(tmp_path / "check"))
    stream.awaitTermination()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "stream")).collect()} == {got["a"]}


def test_stream_extracts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text(DOC, "utf-8")
    run = lambda: watch.extract_stream(
        spark, str(source), generate.RuleBackend(), str(tmp_path / "out"), str(tmp_path / "cache"), str(tmp_path / "check"), EngineConfig.of({"model": "rules"})
    ).awaitTermination()
    run()
    (source / "b.md").write_text(DOC.replace("AB", "CD"), "utf-8")
    run()
    assert sorted(r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["AB-1", "AB-2", "CD-1", "CD-2"]


def test_commands(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text(DOC, "utf-8")
    (source / "blank.md").write_text(" \n", "utf-8")
    (source / "p.pdf").write_bytes(DOC.encode())
    (source / "q.pdf").write_bytes(b"bad")
    out = str(tmp_path / "out")
    settings = ["--rules", "--log", str(tmp_path / "log"), "--set", f"input_dir={source}", "--set", f"output_dir={out}", "--set", f"markdown_dir={tmp_path}/md", "--set", "model=rules"]
    assert commands.main(["extract", *settings], spark) == 0
    assert [r[0] for r in xlsx.read_file(f"{out}/requirements.xlsx")] == ["Requirement Code", "AB-1", "AB-2"]
    assert spark.read.json(f"{out}/raw_responses").columns == ["chunk_index", "chunk_preview", "raw_response"]
    assert "2 requirements" in (tmp_path / "log").read_text()
    assert commands.main(["clean", *settings], spark) == 0 and commands.main(["chunks", *settings], spark) == 0
    assert (tmp_path / "out" / "cleaned-files" / "a.md").exists()
    chunk = json.loads(spark.read.text(f"{out}/chunks").first()[0])
    assert "AB-1" in chunk["page_content"] and chunk["metadata"]["chunk_no"] == 0
    monkeypatch.setitem(convert.CONVERTERS, "pages", Pages())
    assert commands.main(["extract", "--from", "pages", *settings], spark) == 0
    assert spark.read.parquet(f"{out}/requirements").count() == 2
    (source / "q.pdf").unlink()
    assert commands.main(["vision", "--from", "pages", *settings], spark) == 0
    assert len(documents.list_files(spark, f"{out}/vision/responses", "json")) > 0
    assert commands.main(["clean", "--set", "input_dir=/none"], spark) == 1


def test_logger_and_counts(spark, tmp_path):
    log = logger("reqweave.test", str(tmp_path / "x.log"))
    assert logger("reqweave.test", str(tmp_path / "x.log")) is log and len(log.handlers) == 2
    log.info("said")
    assert " - reqweave.test - INFO - said" in (tmp_path / "x.log").read_text()
    assert log.level == logging.INFO
    table, seen = counted(spark.range(10), "t", small="id < 3")
    table.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "small": 3}


class Span:
    """A stand-in for a page of the PDF library."""

    def __init__(self, blocks, tables):
        self.blocks, self.tables = blocks, tables

    def get_text(self, kind):
        return {"blocks": self.blocks}

    def find_tables(self):
        return self


def test_headings_and_tables_of_pages(monkeypatch):
    line = lambda y, size, text: {"bbox": (0, y, 90, y + 9), "spans": [{"size": size, "text": text}]}
    block = lambda *lines: {"bbox": (0, lines[0]["bbox"][1], 90, lines[-1]["bbox"][3]), "lines": list(lines)}
    table = type("T", (), {"bbox": (0, 50, 100, 80), "extract": lambda self: [["a", "b|c"], ["1\n2", None], ["x"]]})()
    page = Span([block(line(0, 20, "Title")), block(line(20, 14, "Part"), line(30, 10, "Plain text, the most of it.")), block(line(55, 10, "a b|c")), {"bbox": (0, 90, 1, 91)}], [table])
    monkeypatch.setattr(convert, "_library", lambda name: type("L", (), {"open": staticmethod(lambda stream, filetype: [page])}))
    want = "# Title\n\n## Part\n\nPlain text, the most of it.\n\n| a | b\\|c |\n| --- | --- |\n| 1 2 |  |\n| x |  |"
    assert convert.PageConverter().markdown(b"%PDF") == want
    assert convert.heading_levels({}) == {} and convert.table_markdown([]) == ""
    monkeypatch.undo()
    with pytest.raises(convert.MissingBackend):
        convert.converter("docling").markdown(b"%PDF")


def test_sizes_by_another_tokenizer(spark):
    words = lambda c: F.size(F.split(c, " "))
    rows = [(1, i, "h", None, "a b c") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, section_no long, header1 string, header2 string, content string")
    got = chunks.optimise(df, max_tokens=6, count=words).orderBy("bin_no").collect()
    assert [(r.chunk_count, r.token_count) for r in got] == [(2, 6), (2, 6)]
    assert chunks.header_groups(df, count=words).first().token_sum == 12
