"""Replies, prompts, calls and requirement tables."""

import json

import pytest
from pyspark.sql import functions as F

from reqweave.operators import generate, parse, prompts, requirements
from reqweave.plans import extraction

A, B = {"code": "A-1", "description": "x"}, {"code": "B-2", "description": None}
ROW = lambda d: (d.get("code"), d.get("description"))
#: reply, strict items (None: error), lenient items
REPLIES = [
    (json.dumps([A, B]), [ROW(A), ROW(B)], [ROW(A), ROW(B)]),
    (json.dumps({"requirements": [A]}), [ROW(A)], []),
    (json.dumps({"requirement": A}), [ROW(A)], []),
    (json.dumps(A), [ROW(A)], []),
    (json.dumps({"code": "A-1"}), [], []),
    (json.dumps({"code": None, "description": None}), [(None, None)], []),
    ("{}", [], []),
    ("[]", [], []),
    ("nonsense [", None, []),
    ('"text"', [], []),
    ("12", [], []),
    ("null", [], []),
    (None, [], []),
    ("", None, []),
    (json.dumps([{"code": 7, "description": "x"}]), None, []),
    (json.dumps([A, 5]), None, [ROW(A)]),
    (json.dumps([{"description": "d"}]), [(None, "d")], [(None, "d")]),
    (json.dumps([{}]), [(None, None)], []),
    (json.dumps([{"code": "", "description": ""}]), [("", "")], []),
    (json.dumps({"root": [A, "s"]}), [], [ROW(A)]),
    (json.dumps({"requirements": A}), None, []),
    (json.dumps({"requirements": None}), None, []),
    (json.dumps({"requirement": "text"}), None, []),
    (json.dumps({"requirements": [A], "requirement": B}), [ROW(A)], []),
    (json.dumps([[A]]), None, []),
    (json.dumps([{"code": "É-1", "description": "日本\n"}]), [("É-1", "日本\n")], [("É-1", "日本\n")]),
    (json.dumps([{"code": "A-1", "description": "x", "extra": [1]}]), [ROW(A)], [ROW(A)]),
]


@pytest.mark.parametrize("dialect", parse.DIALECTS)
def test_replies(spark, dialect):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(REPLIES)], "i int, response string")
    got = parse.parse_responses(df, dialect).orderBy("i").collect()
    for r, (reply, strict, lenient) in zip(got, REPLIES):
        want = strict if dialect == "strict" else lenient
        if dialect == "strict":
            assert r.parse_error == (want is None), reply
        assert [tuple(x) for x in r["items"]] == (want or []), reply


def test_unknown_dialect_and_prompt(spark):
    with pytest.raises(ValueError):
        parse.parse_responses(spark.range(1), "loose")
    with pytest.raises(ValueError):
        prompts.prompt("other", F.lit("x"))


def test_prompt(spark):
    text = lambda **k: spark.range(1).select(prompts.prompt("requirement_extraction", F.lit("  doc \n"), **k)).first()[0]
    assert text().endswith("-----\ndoc") and prompts.EXAMPLES in text() and prompts.REQUIREMENTS_SCHEMA not in text()
    assert prompts.EXAMPLES not in text(include_few_shot=False) and prompts.REQUIREMENTS_SCHEMA in text(with_schema=True)


class Flaky:
    """Fails ``fails`` times, then answers."""

    def __init__(self, fails, answer="ok"):
        self.fails, self.answer, self.calls = fails, answer, 0

    def ask(self, *args):
        self.calls += 1
        if self.calls <= self.fails:
            raise OSError("down")
        return self.answer


@pytest.mark.parametrize("retries", [1, 2, 3, 5])
def test_attempts(retries):
    b = Flaky(99)
    assert generate.generate(b, "p", "m", max_retries=retries) == (None, "OSError: down")
    assert b.calls == retries


def test_third_attempt_and_empty_reply():
    assert generate.generate(Flaky(2), "p", "m") == ("ok", None)
    assert generate.generate(Flaky(0, None), "p", "m") == (None, "reply without text")


class Down(generate.RuleBackend):
    def running(self):
        return False


def test_preflight():
    generate.preflight(generate.RuleBackend(), "rules")
    with pytest.raises(RuntimeError):
        generate.preflight(Down(), "rules")
    with pytest.raises(RuntimeError):
        generate.preflight(generate.RuleBackend(), "other")
    http = generate.HttpBackend("http://127.0.0.1:9", timeout=0.2)
    assert not http.running() and http.models() == [] and not http.pull("m")


def test_http_backend():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, value):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):
            self._reply({"models": [{"name": "m"}]})

        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._reply({"response": "[]"})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    b = generate.HttpBackend(f"http://127.0.0.1:{server.server_port}", timeout=5, unload=True)
    generate.preflight(b, "m")
    assert generate.generate(b, "p", "m", schema=prompts.REQUIREMENTS_SCHEMA, images=["aGk="], temperature=0.5) == ("[]", None)
    server.shutdown()
    assert seen[0]["format"]["type"] == "array" and seen[0]["images"] == ["aGk="] and seen[0]["keep_alive"] == 0
    assert seen[0]["options"] == {"temperature": 0.5} and seen[0]["system"] == generate.JSON_INSTRUCTION and seen[0]["stream"] is False


def test_a_connection_is_kept():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    opened, answers = [], iter(["[1]", "gone", "[2]", "bad"])

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            opened.append(1)
            super().setup()

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            said = next(answers)
            if said == "gone":  # the server gives up the connection
                self.close_connection = True
                return
            body = json.dumps({"response": said}).encode()
            self.send_response(500 if said == "bad" else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    b = generate.HttpBackend(f"http://127.0.0.1:{server.server_port}", timeout=5)
    ask = lambda: generate.generate(b, "p", "m", max_retries=1)
    assert ask() == ("[1]", None) and ask() == ("[2]", None) and len(opened) == 2
    assert ask()[1].startswith("OSError: HTTP 500") and len(opened) == 2
    server.shutdown()


def test_prompts_in_own_words(spark):
    made = spark.range(1).select(prompts.prompt("trial", F.lit(" text ")).alias("p"), prompts.ad_hoc("Sum it up.")(F.lit("x")).alias("q")).first()
    assert made.p == f"{prompts.TRIAL_TASK}\n\nDocument:\n-----\ntext" and made.q == "Sum it up.\n\nDocument:\n-----\nx"
    with pytest.raises(ValueError):
        prompts.prompt("other", F.lit("x"))


DOCS = [("a.md", "# Title\n## HAA-1 / CREATED\nmust run\n12\n<!-- x -->\nfast\n# End\nREQ-2 : stop\nnow"), ("b.md", "nothing"), ("c.md", "  "), ("d.md", None)]


def test_whole_extraction_asks_once(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    config = extraction.EngineConfig(model="rules", workers=2)
    for _ in range(2):
        items = extraction.extract(docs, generate.RuleBackend(), str(tmp_path / "cache"), config).orderBy("doc_id", "chunk_no", "item_no").collect()
        assert [(r.doc_id, r.code, r.description) for r in items] == [("a.md", "HAA-1", "CREATED must run fast"), ("a.md", "REQ-2", "stop now")]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2  # the second run asked for nothing


def test_a_failing_chunk_leaves_the_others(spark, tmp_path):
    class Half(generate.RuleBackend):  # within the test, so that workers get it by value
        def ask(self, prompt, *args):
            if "REQ-2" in prompt.rpartition("-----")[2]:
                raise OSError("no")
            return generate.RuleBackend.ask(self, prompt, *args)

    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    config = extraction.EngineConfig(model="rules", workers=2)
    answered = extraction.responses(docs, Half(), str(tmp_path / "cache"), config).cache()
    assert [r.reason for r in extraction.failures(answered).collect()] == ["OSError: no"]
    assert [r.code for r in parse.explode_items(answered, "doc_id").collect()] == ["HAA-1"]


def test_reports(spark):
    items = spark.createDataFrame([("d", 0, i, c, "x") for i, c in enumerate(["A-1", None, "", "A-1", "B", "C", "D", "E", " F"])], "doc_id string, chunk_no int, item_no int, code string, description string")
    r = requirements.summary(items).first()
    assert (r.n, r.first_codes, r.more) == (9, "A-1, A-1, B, C, D", 2)
    v = requirements.validation(items).first()
    assert (v["items"], v.empty_codes, v.untrimmed, v.repeated_codes) == (9, 2, 1, 1)
    assert [tuple(x) for x in requirements.duplicate_codes(items).collect()] == [("A-1", 2)]
    assert requirements.merge(items, items).count() == 18


def test_pages_go_by_number(spark):
    pages = spark.createDataFrame([("p", i, bytes([i])) for i in (10, 1, 2, 11, 3)], "pdf string, page_no int, png binary")
    got = generate.page_batches(pages).orderBy("batch_no").collect()
    assert [(r.page_index, r.pages) for r in got] == [(1, [1, 2]), (3, [3]), (10, [10]), (11, [11])]
