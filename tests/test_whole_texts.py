"""Registered queries over documents whose news comes late in the text."""

from __future__ import annotations

from spindrift.plans.catalog import QUERIES

PLAIN = "a line of plain words\n" * 20


def tables(spark, path, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def section(i, text):
    return f"diff --git a/src/{i}.py b/src/{i}.py\n--- a/src/{i}.py\n+++ b/lib/{i % 7}.py\n{text.replace('diff', '')}"


def is_binary(section):
    head = section.encode()[:8192]
    return 0 in head or sum(32 <= b <= 126 or b in (9, 10, 13) for b in head) < 0.85 * len(head)


def test_diffs_of_whole_texts(spark, tmp_path):
    texts = [None, "", "short", PLAIN, PLAIN + "\x00", PLAIN + "é" * 400, PLAIN * 40 + "\x00" * 9, PLAIN + "diff " * 9, PLAIN + "+++ b/late.py\nmore", "word " * 30_000 + "\n--- a/later.py\n"]
    sf = tables(spark, tmp_path, texts)
    names = {r.doc_id: r.names for r in QUERIES["diff_filenames"](spark, sf).collect()}
    late = {8: ["late.py"], 9: ["later.py"]}
    assert names == {i: "|".join(sorted([f"lib/{i % 7}.py", f"src/{i}.py", *late.get(i, [])])) for i in range(len(texts))}
    got = {r.doc_id: (r.diff, r.n) for r in QUERIES["filter_binary_diffs"](spark, sf).collect()}
    want = {}
    for i, t in enumerate(texts):
        s = section(i, t or "")
        want[i] = (f"diff --git a/src/{i}.py b/src/{i}.py\n[binary file: src/{i}.py]", 1) if is_binary(s) else (s, 0)
    assert got == want and [i for i in want if want[i][1]] == [4, 5]


def test_state_of_all_files(spark, tmp_path):
    texts = [None, "", "short", "x" * 1000, "abcdefghij" * 1234]
    got = QUERIES["current_state_files"](spark, tables(spark, tmp_path, texts)).collect()
    want = []
    for i, t in enumerate(texts):
        path = f"src0/en/{i}.md"
        parts = [t[a : a + 1000] for a in range(0, len(t), 1000)] if t else []
        blocks = [f"File: {path} (lines {k}-{k})\n```markdown\n{part}\n```\n" for k, part in enumerate(parts, 1)]
        want += [(path, "\n".join(blocks))] if blocks else []
    assert [tuple(r) for r in got] == want
