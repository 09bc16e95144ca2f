from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import codec, models, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("0xd1310ba6, 0x98dfb5ac, 0x2ffd72db", "xx"),
        ("<550e8400-e29b-41d4-a716-446655440000>", "<>"),
        ("short abc 123", "short abc 123"),
        ("2024-01-15T10:30:00.123456Z", "TZ"),
        ("", ""),
    ],
)
def test_sanitize(spark, given, wanted):
    assert one(spark, text.sanitize(F.col("t")), t=given).replace("  ", " ") == wanted


def test_sanitize_survives_long_runs(spark):
    assert one(spark, text.sanitize(F.col("t")), t="f" * 200_000) == ""
    assert one(spark, text.sanitize(F.col("t"), replace=True), t="Q" * 40 + " " + "a1" * 20) == "BASE64_TOKEN HEX_TOKEN"


def test_chunks(spark):
    assert one(spark, text.chunk_fixed(F.col("t"), 4), t="abcdefghij") == ["abcd", "efgh", "ij"]
    assert one(spark, text.chunk_fixed(F.col("t"), 4), t="") == []
    assert list(text.lines_packed("", 10)) == []
    assert list(text.lines_packed("aaaa\nbbbb\ncccc", 10)) == [("aaaa\nbbbb", 1, 2), ("cccc", 3, 3)]
    cut = list(text.lines_packed("x" * 100, 50))
    assert cut == [("x" * 30 + "...[line truncated]", 1, 1)]


def test_packed_lines_keep_every_line():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab \n\n") for _ in range(rng.randint(1, 300)))
        parts = list(text.lines_packed(t, 40))
        if max(map(len, t.split("\n"))) <= 40:
            assert "\n".join(p for p, _, _ in parts) == t
        assert all(len(p) <= 40 for p, _, _ in parts)
        assert [a for _, a, _ in parts][0] == 1 and all(b + 1 == c for (_, _, b), (_, c, _) in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("most", range(0, 14))
def test_truncate_bytes(spark, most):
    t = "aé€😀z"
    assert one(spark, text.truncate_bytes(F.col("t"), most), t=t) == t.encode()[:most].decode("utf-8", "ignore")


def test_binary(spark):
    assert one(spark, text.is_binary(F.col("t")), t="a\x00b") is True
    assert one(spark, text.is_binary(F.col("t")), t="") is False
    assert one(spark, text.is_binary(F.col("t")), t="plain\ttext\r\n") is False
    assert one(spark, text.is_binary(F.col("t")), t="é" * 50) is True


def test_diffs(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/y.py\n+1\ndiff --git a/b.bin b/b.bin\n\x00\x01"
    assert one(spark, text.diff_filenames(F.col("t")), t=diff) == ["b.bin", "x.py", "y.py"]
    out = one(spark, text.filter_binary(F.col("t")), t=diff)
    assert out.binary_files == ["b.bin"]
    assert out.diff.endswith("+1\ndiff --git a/b.bin b/b.bin\n[binary file: b.bin]")
    assert one(spark, text.filter_binary(F.col("t")), t="no header\x00").diff == "no header\x00"


def test_metadata_text(spark):
    col = text.metadata_text(F.col("m"), F.col("f"), F.col("c"), 2, 5, 100)
    assert one(spark, col, m="abcdefgh", f=["x", "y", "z"], c="") == "Commit Message: abcde\n[...3 bytes truncated]\nFiles: x, y\n[...1 files omitted]"
    col = text.metadata_text(F.col("m"), F.col("f"), F.col("c"), 100, 50, 4)
    assert one(spark, col, m="m", f=["xx", "yy"], c="ok") == "Commit Message: m\nFiles: xx\n[...1 files omitted]\nReview Comments: ok"


@pytest.mark.parametrize(("path", "wanted"), [("a/b.PY", "python"), (".py", ""), ("a.b/c", ""), ("x.tar.md", "markdown"), ("noext", ""), ("dir.py/.json", "")])
def test_language(spark, path, wanted):
    assert one(spark, text.language_of(F.col("p")), p=path) == wanted


@pytest.mark.parametrize(("given", "wanted"), [('"a"', "a"), ("'\"a'", '"a'), ("  \"'x'\" ", "x"), ('"', ""), ("plain", "plain")])
def test_unquoted(spark, given, wanted):
    assert one(spark, text.unquoted(F.col("t")), t=given) == wanted


def test_codec(spark):
    df = spark.createDataFrame([("x" * 1000,), (None,)], "t string").withColumn("z", codec.compress("t")).withColumn("u", codec.decompress("z"))
    rows = df.collect()
    assert rows[0].u == rows[0].t and len(rows[0].z) < 100 and rows[1].u is None
    with pytest.raises(codec.CodecError):
        codec.decompress_text(b"nonsense")


def test_pack_aligns_oversize_items():
    class Model:
        dimension = 1

        def embed_batch(self, texts):
            return [[float(len(t))] for t in texts]

    texts = ["a" * 40, "b" * 50_000, "c" * 80, "d" * 4000]
    assert [v[0] for v in models._embed_rows(Model(), texts, 2048)] == [float(len(t)) for t in texts]
    assert models.pack([10, 5000, 10], 256 * 4) == [[1], [0, 2]]
    assert models.pack([], 100) == []


def test_embedding_and_rerank(spark):
    df = spark.createDataFrame([(1, "parser fix for tokens"), (2, "x" * 2000 + " parser"), (3, None)], "id int, t string")
    v = df.select("id", models.embedding(F.col("t")).alias("v")).collect()
    assert len(v[0].v) == 512 and abs(sum(x * x for x in v[0].v) - 1) < 1e-5 and not any(v[2].v)
    scores = {r.id: r.rerank_score for r in models.rerank(df, "parser tokens", "id", "t").collect()}
    assert scores == {1: 1.0, 2: 0.5, 3: 0.0}
    with pytest.raises(ValueError):
        models.create(models.EMBEDDERS, "none")


class Counted:
    """An embedder that tells how many texts it got at once."""

    dimension = 1

    def embed_batch(self, texts):
        return [[float(len(texts))] for _ in texts]


def test_batches_are_embedded_by_slices(spark):
    """However many rows an Arrow batch has, a few of their vectors are Python's numbers at a time; rows keep their order."""
    models.EMBEDDERS["counted"] = Counted
    df = spark.range(1500).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("t"))
    got = df.select("id", models.embedding(F.col("t"), "counted").alias("v"), models.embedding(F.col("t")).alias("h"), codec.decompress(codec.compress("t")).alias("c"), "t").collect()
    del models.EMBEDDERS["counted"]
    assert max(r.v[0] for r in got) <= models.SLICE_ROWS and len(got) == 1500
    assert all(r.c == r.t and any(r.h) == (r.t is not None) for r in got)
    assert all(r.h == models.HashingEmbedder().embed_batch([r.t or ""])[0] for r in got)
    nothing = df.where("id < 0").select(models.embedding(F.col("t")).alias("h"), codec.decompress(codec.compress("t")).alias("c"))
    assert nothing.collect() == []


def test_sanitizer_matches_a_plain_regex(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0af-,: xX\tGZ({)}h_/=") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    plain = lambda t: re.sub(text.BASE64_RUN.replace("}+=", "}="), "", re.sub(text.HEX_RUN.replace("*+", "*").replace("}+", "}").replace("++", "+"), "", t))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.sanitize(F.col("t")).alias("c")).collect()
    assert [r.c for r in sorted(rows)] == [plain(t) for t in texts]
