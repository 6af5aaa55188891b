"""Line noise and blocks, against a line-by-line reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from reqweave.functions import text as T
from reqweave.operators import clean

STRIP = [("\t12 ", "12", True), ("\xa07\xa0", "7", True), ("　7　", "7", True), ("\x1c7", "7", True), ("²", "²", True), ("٣٤", "٣٤", True), ("1a", "1a", False), ("", "", False)]
CODES = [("HAA-21", True), ("HAA-21X", False), ("HAA-21_", False), ("HAA-21-3", True), ("A-1", False), ("ABCDEFGHIJK-1", False), ("**HAA-1**", False), ("HAA-٣", True), ("  AB-1 : x", True)]
BANNERS = [("Proprietary & confidential", True), ("PROPRIETARY\rCONFIDENTIAL", True), ("PROPRIETARY CONFIDENTIAL", True), ("CONFIDENTIAL PROPRIETARY", False), ("PROPRıETARY CONFIDENTIAL", True)]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_strip_and_digits(spark):
    raw = [r for r, _, _ in STRIP]
    assert column(spark, raw, T.strip) == [s for _, s, _ in STRIP] == [r.strip() for r in raw]
    assert column(spark, raw, lambda c: T.is_digits(T.strip(c))) == [d for _, _, d in STRIP] == [r.strip().isdigit() for r in raw]


def test_codes_and_banners(spark):
    assert column(spark, [r for r, _ in CODES], clean.is_requirement_line) == [m for _, m in CODES]
    assert column(spark, ["## " + r for r, _ in CODES], clean.is_requirement_heading)[:3] == [True, False, False]
    assert column(spark, [r for r, _ in BANNERS], clean.is_banner) == [m for _, m in BANNERS]


@pytest.mark.parametrize("line,noise", [("<!-- x", True), ("  <!- y", True), ("a <!-- x", False), ("", False), ("  ", False), ("12", True), (" 12 ", True)])
def test_noise(spark, line, noise):
    assert column(spark, [line], clean.is_noise) == [noise]


LINES = ["# T", "## HAA-1 / x", "#tag", "####### deep", "REQ-5 : y", "  AB-2 z", "body", "", "  ", "# juice", "## Juice", " ## HAA-3", "HAA-1X", "more"]


def by_the_rules(lines):
    """Which lines are kept: one pass, remembering the open block and blank lines not yet known to be inside it."""
    import re

    kept, owner, waiting = [], None, []
    for i, line in enumerate(lines):
        s = line.strip()
        heading, code = s.startswith("#"), bool(re.match(r"[A-Z]{2,10}-\d+\b", s))
        if heading and re.match(r"#{1,6}\s+[A-Z]{2,10}-\d+\b", s):
            owner, waiting = "heading", []
            kept.append(i)
        elif heading:
            owner, waiting = None, []
            if s.lower() not in ("# juice", "## juice"):
                kept.append(i)
        elif code and owner != "heading":
            owner, waiting = "line", []
            kept.append(i)
        elif owner and not s:
            waiting.append(i)
        elif owner:
            kept += [*waiting, i]
            waiting = []
    return kept


def test_blocks_follow_the_rules(spark):
    rng = random.Random(5)
    docs = [[rng.choice(LINES) for _ in range(rng.randrange(1, 25))] for _ in range(400)]
    rows = [(d, n, line) for d, lines in enumerate(docs) for n, line in enumerate(lines)]
    got = clean.filter_blocks(spark.createDataFrame(rows, "doc_id long, line_no long, line string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.line_no)
    assert [sorted(found.get(d, [])) for d in range(len(docs))] == [by_the_rules(lines) for lines in docs]


def test_block_text_separates_blocks(spark):
    lines = ["# T", "AB-1 x", "y", "", "AB-2 z", "", "", "# U", "gone"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no long, line string")
    assert clean.block_text(clean.filter_blocks(df)).first().text == "# T\nAB-1 x\ny\n\nAB-2 z\n\n# U\n"
