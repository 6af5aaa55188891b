import random

import pytest
from pyspark.sql import functions as F

from reqweave.operators import chunks, sections

CASES = {
    "none": ("just text\nmore", [(None, None, "just text\nmore")]),
    "header only": ("# A", [("A", None, "# A")]),
    "before": ("x\n# A\ny", [(None, None, "x"), ("A", None, "# A\ny")]),
    "deeper": ("# A\n## B\ntext", [("A", "B", "# A  \n## B\ntext")]),
    "level three": ("# A\n### C\nt", [("A", None, "# A\n### C\nt")]),
    "cleared": ("# A\n## B\nb\n# C\nc", [("A", "B", "# A  \n## B\nb"), ("C", None, "# C\nc")]),
    "paragraphs": ("# A\none\n\ntwo", [("A", None, "# A\none  \ntwo")]),
    "fence": ("# A\n```\n# no\n\nx\n```\nend", [("A", None, "# A\n```\n# no\n\nx\n```\nend")]),
    "tag": ("#tag\n# A\nx", [("A", None, "#tag  \n# A\nx")]),
    "empty name": ("#\nx", [("", None, "#\nx")]),
    "again": ("## B\nx\n## B\ny", [(None, "B", "## B\nx  \n## B\ny")]),
}


def lines(spark, texts):
    rows = [(d, i, x) for d, t in texts.items() for i, x in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "doc_id string, line_no long, line string")


def test_sections(spark):
    got = sections.sections(lines(spark, {k: t for k, (t, _) in CASES.items()})).orderBy("doc_id", "section_no").collect()
    for name, (_, want) in CASES.items():
        assert [(r.header1, r.header2, r.content) for r in got if r.doc_id == name] == want, name


def test_strip_headers(spark):
    got = sections.sections(lines(spark, {"d": "# A\nx\n## B\ny"}), strip_headers=True).orderBy("section_no").collect()
    assert [(r.header1, r.header2, r.content) for r in got] == [("A", None, "x"), ("A", "B", "y")]


@pytest.mark.parametrize("bad", [[("#", "a")], "##", [("#", 1), ("##", "b")], [("##", "a"), ("#", "b")], [("", "a"), ("#", "b")]])
def test_bad_headers(bad):
    with pytest.raises(ValueError):
        sections.check_headers(bad)


def greedy(sizes, limit):
    out, bin_no, held = [], 0, 0
    for n in sizes:
        if held > 0 and held + n > limit:
            bin_no, held = bin_no + 1, 0
        held += n
        out.append(bin_no)
    return out


def test_bins(spark):
    rng = random.Random(3)
    groups = [[0, 0, 3500], [3500, 1], [3501], [0], [3500, 0, 3500]] + [[rng.choice([0, 1, 50, 1200, 3500, 4000]) for _ in range(rng.randrange(1, 30))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(groups)), "i int, sizes array<bigint>")
    got = df.orderBy("i").select(chunks.bins(F.col("sizes"), 3500)).collect()
    assert [r[0] for r in got] == [greedy(g, 3500) for g in groups]


def test_split_pieces():
    text = "para one\n\n" + "word " * 50 + "\n\n" + "x" * 300
    parts = chunks.recursive_split(text, 100, 20)
    assert all(len(p) <= 100 for p in parts)
    assert parts[0] == "para one" and set(parts[-1]) == {"x"}
    assert "".join(text.split()) in "".join("".join(parts).split()) or len("".join(parts)) >= len(text.strip()) - 60


def test_overlap_repeats_the_end():
    words = " ".join(f"w{i:03d}" for i in range(100))
    parts = chunks.recursive_split(words, 60, 15)
    for a, b in zip(parts, parts[1:]):
        assert set(a.split()) & set(b.split())
    assert [w for p in parts for w in p.split()][0] == "w000" and parts[-1].endswith("w099")


def test_only_oversize_is_split(spark):
    df = spark.createDataFrame([("a", "short"), ("b", "long " * 4000), ("c", "x" * 14003), ("d", "y" * 14004)], "doc_id string, content string")
    got = chunks.split_oversize(df).groupBy("doc_id").agg(F.collect_list("sub_chunk_index").alias("n")).collect()
    assert {r.doc_id: sorted(r.n) for r in got} == {"a": [], "b": [1, 2], "c": [], "d": [1, 2]}


def test_pack(spark):
    rows = [("d", 0, "A", None, "x" * 8000), ("d", 1, "B", "b", "y" * 40), ("d", 2, "A", "a", "z" * 8000), ("d", 3, None, None, "w")]
    df = spark.createDataFrame(rows, "doc_id string, section_no long, header1 string, header2 string, content string")
    got = {(r.header1, r.bin_no): r for r in chunks.pack(df).collect()}
    assert set(got) == {("A", 0), ("A", 1), ("B", 0), ("unknown", 0)}
    assert got["A", 0].merged_from == ["UNKNOWN"] and got["A", 1].merged_from == ["a"]
    assert got["B", 0].token_count == 10 and got["unknown", 0].chunk_count == 1 and got["unknown", 0].group_no == 3
    wide = chunks.pack(df, max_tokens=5000).where("header1 = 'A'").first()
    assert wide.content == "x" * 8000 + "\n\n" + "z" * 8000 and wide.token_count == 4000 and wide.chunk_count == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id string, section_no long, header1 string, header2 string, content string")
    assert chunks.optimise(df).count() == 0
