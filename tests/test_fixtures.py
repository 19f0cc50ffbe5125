"""Literal cases of rules that the tables do not reach (FIXTURES.md)."""

import random

import pytest
from pyspark.sql import functions as F

from loomline import schemas
from loomline.functions import budget, chunking, edits, lint, spans, tokens
from loomline.functions import text as X
from loomline.operators import accounting, compress, dataset, levels, requests, sampling, segments, tools, validate
from loomline.sources import io


def one(spark, column, **values):
    """A column over literal values."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def many(spark, column, name, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_sizes(spark):
    assert one(spark, F.struct(X.tokens_floor(F.col("c")), X.tokens_ceil(F.col("c"))), c="abcdefg") == (1, 2)
    assert one(spark, X.clip(F.col("c"), 3), c="x" * 1237) == "xxx… (+1,234 more chars)"


def test_budgets(spark):
    rows = spark.createDataFrame([(4000, 100), (1000, 0), (600, 0)], "t int, m int")
    assert [r[0] for r in rows.select(budget.compression_budget(F.col("t"), F.col("m"))).collect()] == [2000, 800, 570]
    sizes = spark.createDataFrame([(n,) for n in (4999, 5000, 12000, 22000)], "t int")
    assert [r[0] for r in sizes.select(budget.length_bucket(F.col("t"))).collect()] == ["short", "medium", "long", "xlong"]
    assert one(spark, budget.reject_reason(F.lit(150), F.lit(1), F.lit(0))) == "too_few_tokens"
    assert one(spark, budget.intent_budget(F.lit(4096), F.lit(100))) == int((4096 - 256 - 512) / 1.15) - 100
    assert one(spark, budget.generation_cap(F.lit(1000), F.lit(1100))) == 256


LONE = {
    "Traceback (most recent call last):\n  x": "log_output",
    "Here's the result of running `cat -n` on f.py:\n FAILED": "file_read",
    "$ ls\n" + "x" * 300: "log_output",
    "import x\n\ndef f(): ...\n2024-01-01 10:00:00": "file_read",
    "2024-01-01 10:00:00 up": "log_output",
    "service level=WARN ok": "log_output",
    "a\nb\nc\nd\ne\nf\ng": "log_output",
    "plain words": "file_read",
    "[tool_calls]: []": "file_operation",
    "The file /a.py has been edited": "file_edit_confirm",
    "Here's the files and directories up to": "directory_listing",
}


def test_lone_kind(spark):
    assert many(spark, X.lone_kind(F.col("c")), "c", LONE) == list(LONE.values())


def test_message_kind(spark):
    cases = [
        ("system", "x", None, 0, "system_prompt"), ("user", "x", None, 0, "user_turn_current"), ("user", "x", None, 1, "user_turn_history"), ("assistant", "x", None, 1, "assistant_thinking"),
        ("assistant", "", "think", 1, "assistant_thinking"), ("assistant", "", "finish", 1, "meta_action"), ("assistant", "", "str_replace_editor", 1, "file_operation"),
        ("assistant", "", "bash", 1, "bash_command"), ("assistant", "", "zip", 1, "tool_call"), ("tool", "FAILED", None, 1, "log_output"), ("tool", "/a", None, 1, "file_read"),
        ("tool", "fine", None, 1, "tool_result"), ("other", "x", None, 1, "tool_result"), ("tool", None, None, 1, "tool_result"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "r string, c string, t string, p int")
    assert [r[0] for r in df.select(X.message_kind(*map(F.col, "rctp"))).collect()] == [c[4] for c in cases]


def test_outputs_of_models(spark):
    t = F.col("t")
    assert one(spark, X.unwrap(t), t="thought</think>body") == "body"
    assert one(spark, X.unwrap(t), t="[SEG id=a]\n\n x \n[/SEG]") == "x"
    assert one(spark, X.looks_truncated(t), t="word " * 60 + ".") is True
    assert one(spark, X.looks_truncated(t), t="short.") is False
    assert one(spark, X.label_category(t), t="Bash output") == "bash_grep"
    assert tuple(one(spark, X.command_frame(t), t="Output was lost\nx")) == ("", "Output was lost\nx")
    assert tuple(one(spark, X.command_frame(t), t="Exit code: 0\n\nOutput:\nx")) == ("Exit code: 0\n\nOutput:\n", "x")
    assert one(spark, X.unix_lines(t), t="a\r\nb\rc") == "a\nb\nc"
    log = "for a in b\nwhile waiting\nif x\nreturn code"
    assert one(spark, X.with_line_numbers(t), t=log) == log
    arrows = "\n".join(f" {i}→import x" for i in range(5))
    assert one(spark, X.with_line_numbers(t), t=arrows) == arrows
    assert one(spark, X.with_line_numbers(t), t="import a\nimport b\nx\ny\n") == "1\timport a\n2\timport b\n3\tx\n4\ty\n"
    assert one(spark, X.without_padding(t), t="\t 12\tx") == "12\tx"
    assert one(spark, X.body_of(t, "a.c"), t="[SEG id=abc kind=k level=L1]x[/SEG]") == (False, None)


def test_hints_lose_no_span(spark, data):
    """Texts without a hint have no span: each group's matches, and every document."""
    odd = ['File "a.py"', "line\u00a0:\u0663", " 12:3 ", "commit 0123abc", "http://x", "MyFault", "a_b_c", "aBcDe", "FooBarbaz", "'abcd/x'", "/workspace/x", "use numpy", "tests/a.py", "x", "é \u2003 plain"]
    texts = [o + " " + "." * 60 for o in odd] + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.col("t").rlike(spans.HINT).alias("hint")).collect()
    hinted = {r["i"] for r in rows if r["hint"]}
    assert {i for i, t in enumerate(texts) if spans.find(t, "file_read")} <= hinted and len(hinted) < len(texts)
    assert sum(bool(spans.find(t, "file_read")) for t in texts[: len(odd)]) >= 12


def test_sql_names(spark):
    from loomline.functions.register import register

    assert len(register(spark)) == 11
    assert spark.sql("SELECT loom_tokens_ceil('abcde') AS n, loom_lint('import os\nx') AS l").first() == (2, "x")
    text = "[SEG id=a kind=k level=L1]x[/SEG] [SEG id=a kind=k level=L2]y[/SEG]"
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM loom_parse_segments('{text}')").collect()] == [("a", "k", "L2", "y")]
    assert [r["text"] for r in spark.sql("SELECT * FROM loom_chunk('aaaaaaaa\nbbbbbbbb', 2)").collect()] == ["aaaaaaaa", "bbbbbbbb"]


def test_blocks(spark):
    text = "[SEG id=s1 kind=k level=L1][/SEG]"
    assert one(spark, X.body_of(F.col("t"), "s1"), t=text) == (True, None)
    assert one(spark, X.body_of(F.col("t"), "s2"), t=text) == (False, None)
    assert one(spark, X.unwrap(F.col("t")), t="<think>a</think>[SEG id=s1]body") == "body"
    assert one(spark, X.unwrap(F.col("t")), t="[SEG id=s1]\nbody\n[/SEG] rest") == "body"
    assert one(spark, X.without_padding(F.col("t")), t="     12\t    x") == "12\t    x"
    assert one(spark, X.matchable(F.col("t")), t="  1\ta\n  2\tb\n") == "a\nb"
    assert one(spark, X.without_reminders(F.col("t")), t="<system-reminder>x\ny</system-reminder> ") is None
    assert one(spark, X.is_tagged(F.col("t")), t="[REF:abc src=/x] y") is True


def test_numbers_and_names(spark):
    code = "import a\ndef f():\n    return 1\nx = 1"
    numbered = one(spark, X.with_line_numbers(F.col("t")), t=code)
    assert numbered.startswith("1\timport a\n2\tdef") and one(spark, X.with_line_numbers(F.col("t")), t=numbered) == numbered
    assert one(spark, X.name_words(F.col("t")), t="mcp__srv__readFile.now") == "srv read File now"
    assert set(one(spark, X.keywords(F.col("t")), t="the readFile snake_case")) == {"readfile", "read", "file", "snake_case", "snake", "case"}
    assert one(spark, X.wants_code(F.col("t")), t="please fix this") and not one(spark, X.wants_code(F.col("t")), t="hello")
    assert one(spark, X.lacks_tool(F.col("t")), t="I don't have a calendar integration")
    assert many(spark, X.ratio_level(F.col("c")), "c", ["0.2", "25%", "0.35", "0.5", "x"]) == ["L3", "L2", "L1", "L0", None]
    assert one(spark, X.patch_of(F.col("t")), t="so:\n```diff\n--- a/x\n+++ b/x\n```") == "--- a/x\n+++ b/x"
    assert one(spark, X.patch_of(F.col("t")), t=" no diff here ") == "no diff here"
    assert one(spark, X.touched_files(F.col("t")), t="diff --git a/p.py b/p.py\ndiff --git a/p.py b/p.py") == ["p.py"]


def levels_of(spark, rows):
    df = spark.createDataFrame([("s", i, k, c) for i, (k, c) in enumerate(rows)], "s string, i int, kind string, content string")
    df = levels.with_position(df, ["s"], ["i"])
    df = levels.label_rows(levels.with_staleness(df, ["s"], levels.accessed_paths(F.col("content"))), ["s"])
    return {r["pos"]: (r["level"], r["level_reason"], r["is_stale"]) for r in df.collect()}


PATH = '"path": "/w/a.py"'


@pytest.mark.parametrize(
    ("rows", "stale"),
    [
        ([("file_operation", PATH), ("tool_result", ""), ("file_operation", PATH), ("tool_result", "")], {0, 1}),
        ([("file_operation", PATH), ("file_read", ""), ("file_operation", PATH), ("tool_result", "")], {0}),
        ([("file_operation", PATH + PATH)], {0}),
        ([("file_operation", '"path": "a.py"'), ("file_operation", '"path": "a.py"')], set()),
        ([("file_operation", '"path": "/w/Makefile"'), ("file_operation", '"path": "/w/Makefile"')], set()),
    ],
)
def test_staleness(spark, rows, stale):
    assert {k for k, v in levels_of(spark, rows).items() if v[2]} == stale
    seg = spark.createDataFrame([([{"seg_id": f"s{i}", "kind": k, "content": c} for i, (k, c) in enumerate(rows)],)], "segs array<struct<seg_id: string, kind: string, content: string>>")
    assert set(levels.with_stale_positions(seg, "segs").first()["stale"]) == stale


def test_levels(spark):
    def at(n, i, kind):
        return levels_of(spark, [("meta_action", "")] * i + [(kind, "")] + [("meta_action", "")] * (n - i - 1))[i][:2]

    assert at(20, 2, "assistant_thinking") == ("L3", "ancient(pos=0.11)")
    assert at(10, 9, "tool_result") == ("L0", "is_current_turn")
    assert at(20, 10, "bash_command") == ("L1", "action_bash_command")
    assert at(20, 6, "tool_result") == ("L3", "old_tool_result")
    assert at(20, 12, "file_read") == ("L2", "mid_file_read")


def test_downsampling(spark):
    picked = one(spark, segments.downsampled(F.sequence(F.lit(0), F.lit(19))))
    assert picked == [0, 2, 5, 7, 10, 12, 15, 17]
    assert one(spark, segments.downsampled(F.sequence(F.lit(0), F.lit(3)))) == [0, 1, 2, 3]


def test_trajectory_with_tools(spark):
    call = [{"function": {"name": "bash", "arguments": '{"cmd": "ls"}'}}]
    bad = [{"function": {"name": "bash", "arguments": "ls"}}]
    m = [("system", "x" * 600, None), ("user", "go", None), ("assistant", "see", call), ("tool", "ok", None), ("assistant", None, bad)]
    rows = spark.createDataFrame([("t", "r", 1, m)], schemas.TRAJECTORY)
    s = segments.samples(rows).first()
    assert (s["sample_id"], s["turn_idx"], s["decision_idx"], s["resolved"]) == ("t_t1", 1, 4, True)
    assert [x["kind"] for x in s["input_segments"]] == ["system_prompt", "user_turn_history", "bash_command", "tool_result"]
    assert s["input_segments"][0]["content"].endswith("[...truncated...]") and len(s["input_segments"][0]["content"]) == 518
    assert s["input_segments"][2]["content"] == 'see\n[tool_calls]: [{"name": "bash", "args": {"cmd": "ls"}}]'
    assert s["input_segments"][3]["is_current_turn"] and s["target_action"]["args"] == '"ls"'
    assert not spark.createDataFrame([s], segments.samples(rows).schema).select(segments.is_meaningful(F.col("target_action"))).first()[0]


def truncated(tokens, limit):
    """The greedy removal, step by step."""
    left = list(enumerate(tokens))
    head, tail = max(2, len(left) * 30 // 100), max(2, len(left) * 50 // 100)
    while sum(t for _, t in left) > limit and head + tail < len(left):
        middle = left[head : len(left) - tail]
        left.remove(max(middle, key=lambda x: (x[1], -x[0])))
    while sum(t for _, t in left) > limit and len(left) > 4:
        left.remove(max(left[2:], key=lambda x: (x[1], -x[0])))
    return [i for i, _ in left]


def test_truncation(spark):
    rng = random.Random(3)
    cases = [([10, 10, 50, 40, 30, 20, 10, 10, 10, 10], 120), *(([rng.randrange(50) for _ in range(rng.randrange(1, 25))], 120) for _ in range(60))]
    rows = [(k, i, t) for k, (ts, _) in enumerate(cases) for i, t in enumerate(ts)]
    kept = segments.within_budget(spark.createDataFrame(rows, "k int, pos int, tokens int"), ["k"], 120).collect()
    got = {k: sorted(r["pos"] for r in kept if r["k"] == k) for k in range(len(cases))}
    assert got[0] == [0, 1, 5, 6, 7, 8, 9]
    assert got == {k: truncated(ts, limit) for k, (ts, limit) in enumerate(cases)}


def test_line_packing(spark):
    text = "\n".join(["x" * 9000] * 3)
    assert len(one(spark, segments.packed_lines(F.col("t"), 16_000), t=text)) == 3
    rng = random.Random(1)
    for _ in range(10):
        text = "\n".join("y" * rng.randrange(60) for _ in range(rng.randrange(1, 30)))
        parts = one(spark, segments.packed_lines(F.col("t"), 100), t=text)
        assert "\n".join(parts) == text and all(len(p) < 100 or "\n" not in p for p in parts)


@pytest.mark.parametrize(
    ("counts", "target", "expected"),
    [({"a": 60, "b": 30, "c": 10}, 10, {"a": 6, "b": 3, "c": 1}), ({"a": 5, "b": 5}, 5, {"a": 3, "b": 2}), ({"a": 7, "b": 7}, 3, {"a": 1, "b": 2}), ({"a": 99, "b": 1}, 10, {"a": 10})],
)
def test_allocation(spark, counts, target, expected):
    rows = sampling.allocate(spark.createDataFrame(list(counts.items()), "k string, n long"), ["k"], target).collect()
    assert {r["k"]: r["take"] for r in rows} == expected


def test_per_kind_short(spark):
    rows = sampling.per_kind(spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, i int"), "k", "i", 3, 1).collect()
    assert sorted((r["k"], r["short"]) for r in rows) == [("a", False)] * 3 + [("b", True)]


def test_validation(spark):
    def reason(output, original="x" * 100_000, limit=100):
        return one(spark, validate.text_reason(F.col("o"), F.lit(limit), F.col("a")), o=output, a=original)

    assert reason("y" * 600) == "exceeds_budget" and reason("y" * 60) == "too_short"
    assert reason("[SEG id=a]" + "y" * 190, "x" * 1000) == "truncated_segments"
    assert reason("y" * 200, "x" * 250) == "near_identity"
    assert reason(" Sure, here it is" + "y" * 200) == "hallucinated_preamble" and reason("Yes, " + "y" * 200) == "looks_like_qa_response"
    assert reason("```" + "y" * 200 + "```\n") == "wrapped_in_codefence" and reason("y" * 200) is None
    assert one(spark, validate.verbatim_run(F.col("o"), F.col("i")), o="abcdef\nx\nghijkl\nmnopqr", i="abcdef ghijkl mnopqr") == 14


def test_lazy_and_lost(spark):
    def block(k, kind, level, body):
        return f"[SEG id={k} kind={kind} level={level}]\n{body}\n[/SEG]"

    line = "some words of a line of code {}\n"
    body = "".join(line.format(i) for i in range(40))
    filler = block("z", "tool_result", "L3", "q" * 6000)
    lazy = block("a", "file_read", "L1", body[:1000]) + block("b", "file_read", "L1", body[:1000])
    whole = block("a", "file_read", "L1", body) + block("b", "file_read", "L1", body) + filler
    lost_in, lost_out = block("c", "tool_result", "L0", "alpha beta gamma " + "w" * 900) + filler, block("c", "tool_result", "L0", "v" * 400)
    pairs = spark.createDataFrame([("1", whole, lazy, len(lazy) // 4), ("2", lost_in, lost_out, len(lost_out) // 4)], "sample_id string, original string, output string, budget int")
    kept = spark.createDataFrame([("2", "c", t) for t in ("alpha", "beta", "gamma")], "sample_id string, seg_id string, text string")
    assert {r["sample_id"]: r["reject_reason"] for r in validate.validate(pairs, kept).collect()} == {"1": "lazy_file_reads", "2": "shrunk_lost_mustkeep"}


def test_segment_states(spark):
    side = lambda d: spark.createDataFrame([(k, "x" * n, "k", "L1") for k, n in d.items()], "seg_id string, content string, kind string, level string")
    rows = validate.segment_states(side({"s0": 100, "s1": 100, "s2": 100}), side({"s0": 69, "s1": 70, "s9": 5}), ["seg_id"]).collect()
    assert {r["seg_id"]: r["state"] for r in rows} == {"s0": "SHRUNK", "s1": "INTACT", "s2": "DROPPED", "s9": "ADDED"}


SPAN_CASES = [
    ("file_path", "/workspace/a/b"), ("file_path", "/x/y.py"), ("file_path", "src/a.py"), ("stack_trace_path", 'File "a.py"'), ("line_number", "line 12"), ("line_number", "L7"),
    ("hash", "commit 1a2b3c4"), ("hash", "1234567"), ("url", "https://e.org/a"), ("error_class", "ValueError"), ("error_class", "DeprecationWarning"), ("identifier", "a_b_c"),
    ("identifier", "fooBarBaz"), ("identifier", "HttpClient"), ("quoted_literal", "'abcd/ef'"), ("package_name", "numpy"),
]


@pytest.mark.parametrize(("kind", "text"), SPAN_CASES)
def test_spans(kind, text):
    pad = " . " * 20
    assert [(k, t) for _, _, k, t in spans.find(pad + text + pad, "file_read")] == [(kind, text)]
    thought = [k for *_, k, _ in spans.find(pad + text + pad, "assistant_thinking")]
    assert thought == ([kind] if kind in spans.THOUGHT_GROUPS else [])
    assert spans.find(pad + text + pad, "system_prompt") == [] and spans.find(text, "file_read") == []


def test_span_quirks(spark):
    pad = " . " * 20
    assert [t for *_, t in spans.find(pad + "deadline 5" + pad, "x")] == ["line 5"]
    assert [t for *_, t in spans.find(pad + "xsrc/a.py" + pad, "x")] == ["/a.py"]
    assert spans.find(pad + "a_b fooBar numpyx 12ab ftp://e" + pad, "x") == []
    rows = spans.span_rows(spark.createDataFrame([(1, pad + "numpy", "k")], "i int, t string, k string"), ["i"], "t", "k").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("package_name", "numpy")]


def test_lint():
    body = "Here's the result of running `cat -n` on /w/a.py:\n     1\timport os\n     2\tfrom x import y\n     3\tf(\n     4\t    a,\n     5\t    b,\n     6\t)\n     7\tp = 0\n     8\tq = 0\n\n     9\t@deco"
    assert lint.lint(body) == "[file: a.py]\n     from x import y\n     f(a, b)\n     p = q = 0"
    assert lint.lint(None) is None and lint.lint("  ") == "  "
    assert lint.lint("import os, json\nimport os, numpy") == "import os, numpy"
    assert lint.lint("f(\n  a,  # why\n)") == "f(\n  a,  # why\n)"
    assert lint.lint("x = f(1)\ny = f(1)") == "x = f(1)\ny = f(1)"


def greedy(sizes, most):
    """Neighbours in runs, step by step."""
    runs, held = [], []
    for i, n in enumerate(sizes):
        if held and sum(sizes[k] for k in held) + n > most:
            runs.append(held)
            held = []
        held.append(i)
    return [*runs, held] if held else runs


def test_chunks():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randrange(12) for _ in range(rng.randrange(30))]
        assert [list(range(r.start, r.stop)) for r in chunking.packed(sizes, 10)] == greedy(sizes, 10)
    for _ in range(50):
        lines = ["x" * rng.randrange(70) if rng.random() < 0.9 else "def f():" for _ in range(rng.randrange(1, 40))]
        text = "\n".join(lines)
        out = chunking.chunks(text, 20)
        assert "\n".join(t for t, *_ in out) == text  # no line is cut
        at = 1
        for body, first, last, n in out:
            assert first == at and last == first + body.count("\n") and n == chunking.estimate(body)
            assert sum(map(chunking.estimate, body.split("\n"))) <= 20 or first == last or chunking.is_boundary(body)
            at = last + 1
    # Parts of a line are packed with the lines about them, and count as lines.
    out = chunking.chunks("ab\n" + "x" * 90 + "\ncd", 10)
    assert "".join(t for t, *_ in out).replace("\n", "") == "ab" + "x" * 90 + "cd" and out[0][0].startswith("ab\nx") and out[-1][0].endswith("x\ncd")
    assert list(chunking.pieces("a, b" * 20, 10))[0].endswith((",", " ")) and "".join(chunking.pieces("a, b" * 20, 10)) == "a, b" * 20
    # Blocks of a definition are whole up to the single limit.
    block = "def f():\n" + "\n".join("    y" for _ in range(20))
    assert [c[0] for c in chunking.chunks(f"{block}\n{block}", 10, single=1000)] == [block, block]
    assert chunking.without_repeated_definitions("def a():\n  1\ndef b():\n  2\ndef a():\n  1\nx = 1") == "def a():\n  1\ndef b():\n  2"
    assert chunking.without_repeated_definitions("def a(): 1\ndef a(): 2\n# Lines 5-9\ny") == "def a(): 1\n# Lines 5-9\ny"


def test_recovery():
    source = 'def g(\n    a,\n    b,\n):\n    """d"""\n    return a  # first\n'
    assert edits.locate("def g(a, b): return a", source) == source.rstrip()[: source.index("  # first")]
    assert edits.locate("def f(): return 1", "def f(): return 1\ndef f(): return 1") is None
    old, new = edits.recover("def g(a, b): return a", "def g(a, b): return b", source)
    assert old in source and '"""d"""' in new and new.endswith("return b") and edits.recover("nothing", "x", source) is None


def test_shell_replacements(spark):
    command = "python -c \"s.replace('a','b')\""
    found = edits.replacements(command)
    assert [(r.old, r.new, command[slice(*r.old_span)]) for r in found] == [("a", "b", "'a'")]
    assert [(r.old, r.new) for r in edits.replacements("$o='x y'; $n='z'; (gc f).Replace($o, $n)")] == [("x y", "z")]
    source = "def f(\n    a,\n):\n    return (n + 1) * 2\n"
    text, n = edits.rewrite("sed.replace('def f(a): return (n + 1) * 2', 'def f(a): return n * 2')", [source])
    assert n == 1 and "def f(\n    a,\n):\n    return n * 2" in text
    assert edits.rewrite("x.replace('q','r')", [source])[1] == 0
    spark.udtf.register("shell_replacements", edits.ShellReplacements)
    assert spark.sql("SELECT old, new FROM shell_replacements('s.replace(\"a\",\"b\")')").first() == ("a", "b")


def test_patches():
    source = "a = 1\n    max_retries = -1  ## keep\nb = 2"
    patch = "*** Begin Patch\n*** Update File: x\n@@\n-max_retries = -1\n+max_retries = 3\n*** End Patch"
    text, n = edits.rewrite(patch, [source])
    assert n == 1 and "-    max_retries = -1  ## keep\n+max_retries = 3" in text
    twice = patch.replace("-max_retries = -1", " a = 1\n-max_retries = -1").replace("*** End Patch", " # only a remark\n*** End Patch")
    assert edits.rewrite_patch(twice, ["x", source, "a = 1\nmax_retries=-1"]) == (twice, 0)  # the remark is a line of its own
    assert edits.rewrite_patch(patch, [source + "\nmax_retries = -1"]) == (patch, 0)  # not unique
    assert edits.recounted("@@ -1,9 +1,9 @@\n x\n-y\n+z") == "@@ -1,2 +1,2 @@\n x\n-y\n+z\n"
    assert edits.without_numbers("+  12\tx\n y") == "+x\n y"
    diff = "--- a/p.py\n+++ b/p.py\n@@ -9,3 +9,3 @@\n x = 1\n-y=2\n+y = 3\n z = 4\n"
    out = edits.reanchored(diff, {"p.py": "w = 0\nx = 1\ny = 2\nz = 4\n"})
    assert "-y = 2\n+y = 3" in out and edits.reanchored(diff, {}) is None
    assert [(c.removed, c.added, c.before, c.after) for c in edits.changes(diff)] == [(["y=2"], ["y = 3"], "x = 1", "z = 4")]


def test_prices(spark):
    df = spark.createDataFrame([("anthropic/claude-sonnet-4",), ("gpt-5-mini-x",), ("foo",)], "model string")
    rows = accounting.prefix_join(df, accounting.model_name(F.col("model")), accounting.PRICES, "p", 3.0).collect()
    assert [(r["p"], r["p_matched"]) for r in rows] == [(3.0, True), (0.25, True), (3.0, False)]
    enc = accounting.prefix_join(spark.createDataFrame([("gpt-4o",), ("gpt-4o-mini",), ("gpt-4ox",)], "m string"), F.col("m"), accounting.ENCODINGS, "e", "cl100k_base", "-").collect()
    assert [r["e"] for r in enc] == ["o200k_base", "o200k_base", "cl100k_base"]


def usage(spark, *rows):
    return spark.createDataFrame([(i, "claude-sonnet", 200, *r) for i, r in enumerate(rows)], schemas.USAGE)


def test_accounting(spark):
    none = (0, 0, 0, None, None)
    log = usage(spark, (0, 0, *none), (1000, 200, *none), (500, 100, *none))
    row = accounting.saved_cost(accounting.by_model(log)).first()
    assert (row["content_first_orig"], row["content_rest_orig"], row["saved_usd"]) == (1000, 500, 0.0031)
    total = accounting.snapshot(usage(spark, (20_000, 20, *none), (0, 0, 0, 0, 0, None, 20_000))).first()
    assert total["saved"] == -20 and total["ratio"] > 1 and total["expansions"] == 1
    total = accounting.snapshot(usage(spark, (1000, 300, *none), (0, 0, 0, 0, 200, "below_min", None), (0, 0, 0, 0, 500, "gpu", None))).first()
    assert (total["original"], total["compressed"], total["skipped"]) == (1000, 300, 700)
    ten = usage(spark, *[(10, 1, *none)] * 10)
    assert [accounting.recent(ten, ["model"], "seq", p).first()["seq"] for p in (0, 5, 99)] == [9, 4, 4]


def test_tools(spark):
    def signal(ranks):
        rows = spark.createDataFrame([(1, "mcp__x" if k in ranks else "Read", k) for k in range(8)], "q int, name string, rank int")
        return tools.mcp_signal(rows, ["q"]).first()["signal"]

    assert (signal({0}), signal({4}), signal({6})) == (3.0, 1.0, 0.3)
    few = spark.createDataFrame([(1, "a", False, "d")] * 4, "q int, name string, kept boolean, description string")
    assert {r["fate"] for r in tools.applied(few, spark.createDataFrame([(1, 0.0)], "q int, signal double"), ["q"]).collect()} == {"keep"}
    ranked = spark.createDataFrame([(1, n, k, 1 - k / 10) for k, n in enumerate(["x", "y", "Read", "Bash", "z"])], "q int, name string, rank int, score double")
    kept = tools.with_whitelist(ranked, ["q"], F.lit(True), 3).filter("kept").orderBy("place").collect()
    assert [r["name"] for r in kept] == ["Read", "Bash", "x"]
    assert tools.dynamic_k(ranked, ["q"], 0.95, 2, 4).filter("kept").count() == 2


def test_wire_shapes(spark):
    body = """{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "u", "name": "Read", "input": {"file_path": "/a"}}]},
      {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u", "content": [{"type": "text", "text": "x"}]}, {"type": "tool_result", "tool_use_id": "v", "content": "y"}]}], "extra": 1}"""
    blocks = requests.message_blocks(spark.createDataFrame([("r", body)], "request_id string, body string"))
    rows = blocks.orderBy("msg_idx", "block_idx").collect()
    assert [(r["block_type"], r["text"]) for r in rows] == [("text", "hi"), ("tool_use", None), ("tool_result", "x"), ("tool_result", "y")]
    assert {r["tool_use_id"]: r["source_path"] for r in requests.with_call_path(blocks).collect()} == {"u": "/a", "v": None}
    assert [r["tool_use_id"] for r in requests.orphans(blocks).collect()] == ["v"]
    assert [r["block_type"] for r in requests.demoted(blocks).orderBy("msg_idx", "block_idx").collect()] == ["text", "tool_use", "tool_result", "text"]
    folded = requests.folded_unsigned(blocks, F.lit(False)).orderBy("msg_idx", "block_idx").collect()
    assert [(r["role"], r["block_type"], r["text"]) for r in folded] == [("user", "text", "hi"), ("user", "text", "[Tool result — Read]\nx"), ("user", "tool_result", "y")]
    hidden = requests.concealed(blocks, ["Read"])
    assert hidden.filter("block_type = 'tool_use'").count() == 0 and hidden.first()["stop_reason"] == "end_turn"
    chat = '{"messages": [{"role": "assistant", "content": null, "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "c", "content": "z"}]}'
    rows = requests.chat_blocks(spark.createDataFrame([("r", chat)], "request_id string, body string")).orderBy("msg_idx").collect()
    assert [(r["block_type"], r["tool_use_id"], r["text"]) for r in rows] == [("tool_use", "c", None), ("tool_result", "c", "z")]
    items = '{"input": [{"role": "user", "content": [{"type": "input_text", "text": "q"}]}, {"type": "function_call", "call_id": "c", "name": "f", "arguments": "{}"}, {"type": "function_call_output", "call_id": "c", "output": "w"}]}'
    rows = requests.response_blocks(spark.createDataFrame([("r", items)], "request_id string, body string")).orderBy("msg_idx").collect()
    assert [(r["block_type"], r["text"]) for r in rows] == [("text", "q"), ("tool_use", None), ("tool_result", "w")]


def test_compression(spark):
    code = "import os\n" + "\n".join(f"\n\nvalue_{i} = call(\n    {i},\n)" for i in range(60))
    rows = [(1, code, "/a.py", False), (2, code, "/b.py", False), (3, "[REF:ab] x", None, False), (4, "tiny", None, False), (5, code, None, True), (6, code[:900], "/a.py", False)]
    df = spark.createDataFrame([(s, c, "file_read", "L2", None, p, pin) for s, c, p, pin in rows], "seq int, content string, kind string, level string, intent string, path string, pinned boolean")
    out = compress.compress(df, compress.linting, least=100)
    got = {r["seq"]: r for r in out.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {1: None, 2: None, 3: "already_compressed", 4: "below_min_tokens", 5: "pinned", 6: "path_shortcircuit"}
    assert got[1]["output"].startswith("[REF:") and " src=/a.py]" in got[1]["output"] and got[1]["compressed_tokens"] < got[1]["original_tokens"]
    again = compress.compress(df, compress.linting, cache=compress.new_cache(out), least=100)
    assert {r["seq"] for r in again.filter("cache_hit").collect()} == {1, 2}

    def fails(content, kind, level, intent):
        raise ValueError

    assert {r["reason"] for r in compress.compress(df.filter("seq < 3"), compress.external(fails), least=100).collect()} == {"compressor_error"}
    assert {r["reason"] for r in compress.compress(df.filter("seq < 3"), compress.identity, least=100).collect()} == {"ineffective"}


def test_tokens(spark):
    assert one(spark, tokens.counter(None)(F.col("t")), t="abcde") == 2
    ids = F.array(*map(F.lit, [5, 7, 8, 9, 4]))
    assert one(spark, tokens.masked_labels(ids, F.array(F.lit(7), F.lit(8)))) == [-100, -100, -100, 9, 4]
    assert one(spark, tokens.masked_labels(ids, F.array(F.lit(1)))) == [-100] * 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert io.append_new(df, f"{tmp_path}/x", "id").count() == 2 and io.append_new(df, f"{tmp_path}/x", "id").count() == 0
    assert len(io.dataset_key("a", 1)) == 16 and io.dataset_key("a", 1) != io.dataset_key("a", 2)
    lines = [r["line"] for r in io.markdown(df, "T").collect()]
    assert lines[:3] == ["## T", "", "| id | v |"] and lines[-1] == "| 2 | b |"
    (tmp_path / "p.txt").write_text("one\ntwo")
    assert io.whole_texts(spark, f"{tmp_path}/p.txt").first()["text"] == "one\ntwo"


def trajectory(k):
    call = lambda name, args: [{"function": {"name": name, "arguments": args}}]
    body = "".join(f"def handler_{k}_{i}_x(value):\n    raise ValueError('/workspace/app/mod_{i}.py')\n" for i in range(90))
    path = '{"path": "/w/a.py"}'
    turns = [("system", "s" * 600, None), ("user", "start", None), ("assistant", "look", call("str_replace_editor", path)), ("tool", body, None), ("assistant", "again", call("str_replace_editor", path)), ("tool", body, None), ("assistant", "run", call("execute_bash", "ls"))]
    return (f"t{k}", "repo", k % 2, turns)


def test_training_rows(spark):
    rows = spark.createDataFrame([trajectory(k) for k in range(40)], schemas.TRAJECTORY)
    out = dataset.built(rows, "SYSTEM", 30, 4).collect()  # four strata of one validation row each
    assert {r["split"] for r in out} == {"train", "val"} and sum(r["split"] == "train" for r in out) == 30
    for r in out:
        m, user = r["metadata"], r["messages"][1]["content"]
        assert r["messages"][0]["content"] == "SYSTEM" and m["n_must_keep"] >= 5 and m["target_action_name"] in ("str_replace_editor", "execute_bash")
        assert user.count("[SEG id=") == user.count("[/SEG]") == m["n_segments"] and "- error_class: `ValueError`" in user
        # The superseded access and the result after it, which no rule recognises as a read.
        assert m["n_stale"] == (2 if m["sample_id"].endswith("_t2") else 0)
    pool = dataset.segment_pool(dataset.prepared(rows.limit(1)), least=1000).collect()
    assert pool and all(r["entry_id"] == f"{r['sample_id']}__{r['seg_id']}" and r["user_intent"] == "start" for r in pool)


def test_truncation_of_samples(spark):
    rows = spark.createDataFrame([trajectory(1)], schemas.TRAJECTORY)
    out = dataset.prepared(rows, most_tokens=2500).orderBy("sample_id").collect()
    assert [r["was_truncated"] for r in out] == [False, True] and out[1]["total_input_tokens"] <= 2500


def test_recovered_edits(spark):
    reads = spark.createDataFrame([("/a", 1, "x = 1\ny = 2\n"), ("/a", 2, "x = 1\n\ny  =  2  # two\n"), ("/b", 1, "z")], "path string, seq int, content string")
    calls = spark.createDataFrame([("/a", 3, "x = 1 y = 2", "x = 1 y = 3"), ("/b", 3, "q", "r"), ("/c", 3, "q", "r")], "path string, seq int, old string, new string")
    got = {r["path"]: r["recovered"]["old"] for r in dataset.recovered_edits(calls, reads).collect()}
    assert got == {"/a": "x = 1\n\ny  =  2", "/b": None, "/c": None}


def test_small_rules(spark):
    rates = spark.createDataFrame([(0.5,), (0.8,), (0.9,)], "r double")
    assert [r[0] for r in rates.select(validate.decision(F.col("r"))).collect()] == ["stop", "warn", "go"]
    blocks = spark.createDataFrame([("r", i, i % 3, i == 1) for i in range(12)], "id string, i int, saving int, skipped boolean")
    assert [r["i"] for r in requests.sampled(blocks, "id", "i", "saving", "skipped").orderBy("i").collect()] == [2, 4, 5, 7]
    assert one(spark, X.command_frame(F.col("t")), t="Exit code: 0\nOutput:\nhello\n") == ("Exit code: 0\nOutput:\n", "hello\n")
    assert one(spark, X.intent_text(F.col("a"), F.col("b")), a=" why ", b="do it") == "why\n(overall task: do it)"
    assert one(spark, X.label_category(F.col("t")), t="Docstring kept") == "docstring" and one(spark, X.sanitized_source(F.col("t")), t=" a]b\nc ") == "a_b c"
    assert one(spark, X.looks_truncated(F.col("t")), t="[SEG id=a kind=k level=L1] x") is True and one(spark, X.looks_truncated(F.col("t")), t="[SEG id=a] x") is False


def test_keyword_search(spark, data):
    """Against the scores of all pairs: words shared, words inside others, names, texts without words."""
    from loomline.operators import tools

    q = spark.createDataFrame([(1, "read the foo_bar file"), (2, "data pipe"), (3, "123"), (4, "wiki")], "item_id long, q string")
    d = spark.createDataFrame([(1, "readFile of Pipeline", "wiki"), (250, "file foo a", "web data"), (300, "12", "wiki"), (400, None, "wiki"), (500, "unlike", "wiki"), (600, "x" * 90 + " read file foo_bar", "web")], "doc_id long, d string, name string")
    every = tools.keyword_scores(q.crossJoin(d), "q", "d", "name").filter("score > 0")
    key = lambda df: sorted((r["item_id"], r["doc_id"], r["score"]) for r in df.collect())
    assert key(tools.keyword_search(q, d)) == key(every) != []
    for k in (1, 2, 9):
        assert key(tools.keyword_best(q, d, k)) == key(tools.top_k(every, ["item_id"], k, pos="doc_id").filter("kept"))
    assert tools.keyword_best(q.limit(0), d, 3).count() == tools.keyword_best(q, d.limit(0), 3).count() == 0
    from loomline.plans import q_text, scratch  # noqa: F401
    from loomline.plans.registry import QUERIES

    # No document is left out: those past the first 200, past 80 characters, of any residue.
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id % 20 = 7").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars")
    items = spark.read.parquet(f"{data}/benchmark.parquet").filter("item_id % 20 = 0")
    path = scratch.folder(spark, "keywords")
    docs.write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    pairs = items.select("item_id", F.col("text").alias("q")).crossJoin(docs.select("doc_id", F.col("text").alias("d"), F.col("source").alias("name")))
    best = tools.top_k(tools.keyword_scores(pairs, "q", "d", "name"), ["item_id"], 5, pos="doc_id", positive=True).filter("kept")
    assert key(QUERIES["keyword_scores"](spark, path)) == key(best) != []
    # Several blocks of queries, few rows at once, a memo that runs over.
    rows = docs.select("doc_id", F.col("text").alias("d"), F.col("source").alias("name"))
    assert key(tools.keyword_best(items.select("item_id", F.col("text").alias("q")), rows, 5, block=500, at_once=3, memo=50)) == key(best)
