"""The band join, the archives and the spelling variants against plain versions, and on odd rows."""

from __future__ import annotations

import glob
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from spindrift.llm import bandjoin, bpe, language, linededup, spelling, topk, toxicity, warc

RNG = random.Random(11)


# --- band join

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, u string, shard int, first string"
ITEMS = "item_id long, price double, p string, reach int, near string"


def plain_band(items, lines, k=5):
    half = lambda x: int(np.floor(100 * x + 0.5))
    good = []
    for sale, line, item, q, amount in lines:
        if None not in (sale, item, q, amount) and q >= 1 and np.isfinite(amount) and abs(amount) < 1e13:
            a = half(amount)
            good.append(((2 * a + q) // (2 * q), sale, line, item, zlib.crc32(f"{sale},{'' if line is None else line},{item}".encode())))
    out = []
    for item, price in items:
        pairs = []
        if item is not None and price is not None and np.isfinite(price) and abs(price) < 1e13:
            p = half(price)
            pairs = sorted((abs(u - p), u, s, n is not None, n or 0, n, i, c) for u, s, n, i, c in good if i != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p))
        sums = (len(pairs), sum(x[0] for x in pairs), sum(x[-1] for x in pairs))
        out += [(item, r, x[0], x[1], x[2], x[5], x[6], *sums) for r, x in enumerate(pairs[:k], 1)] or [(item, 0, None, None, None, None, None, *sums)]
    return sorted(map(repr, out))


def band(spark, items, lines, k=5):
    found = bandjoin.near_lines(
        spark.createDataFrame([(*x, "x", 1, "y") for x in items], ITEMS).repartition(3), spark.createDataFrame([(*x, "x", 1, "y") for x in lines], LINES).repartition(4), k
    )
    assert found.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    return sorted(repr(tuple(r)) for r in found.collect())


def test_band_join_against_all_pairs(spark):
    """A hot item, hot prices, repeated rows, prices around the borders of shards, few lines that aren't an item's own."""
    price = lambda: RNG.choice([9.76, 19.51, 0.03, 5.12, 655.36, 655.35, 1310.72, RNG.randint(1, 4000) / 100, RNG.randint(1, 400_000) / 100])
    items = [(i, price()) for i in range(80)] + [(3, 9.76), (3, 9.76), (None, 9.76), (90, None), (91, float("nan")), (92, float("inf")), (93, 1e300), (94, -0.05), (95, 0.0), (96, 88_888.88)]
    lines = []
    for n in range(1500):
        q = RNG.choice([1, 1, 2, 3, 7])
        lines.append((RNG.randint(0, 60), RNG.choice([None, 1, 2, 3]), 7 if n % 3 == 0 else RNG.randint(0, 90), q, round(price() * q, 2)))
    lines += lines[:40] + [(1, 1, 5, 0, 9.76), (1, 1, 5, -2, 9.76), (None, 1, 5, 1, 9.76), (1, 1, None, 1, 9.76), (1, 1, 5, None, 9.76), (1, 1, 5, 1, None), (1, 1, 5, 1, float("nan")), (1, 1, 5, 1, 1e200)]
    lines += [(2, 1, 5, 3, -0.1), (2, 2, 6, 1, -0.15), (2, 9, 4, 2, 177_777.7), (2, 8, 4, 1, 88_890.0)]
    assert band(spark, items, lines) == plain_band(items, lines)
    assert band(spark, items[:20], lines, 2) == plain_band(items[:20], lines, 2)
    own = [(1, n, 7, 1, 9.76) for n in range(30)] + [(2, 1, 8, 1, 9.77)]
    assert band(spark, [(7, 9.76), (8, 9.76)], own) == plain_band([(7, 9.76), (8, 9.76)], own)


def test_band_join_of_empty_tables(spark):
    assert band(spark, [], [(1, 1, 2, 1, 3.0)]) == []
    assert band(spark, [(1, 3.0)], []) == [repr((1, 0, None, None, None, None, None, 0, 0, 0))]


def test_shards_rise_without_gaps(spark):
    edges = sorted({s * x + e for x in (0, 511, 512, 65_535, 65_536, 1 << 17, (1 << 17) + 1024, 1 << 20, 1 << 33, (1 << 40) - 1) for e in (-1, 0, 1) for s in (-1, 1)})
    rows = spark.createDataFrame([(u,) for u in edges], "u long").select("u", bandjoin.shard(F.col("u")).alias("s")).orderBy("u").collect()
    assert all(0 <= b.s - a.s and (b.u - a.u > 1 or b.s - a.s <= 1) for a, b in itertools.pairwise(rows))
    wide = spark.range(0, 1 << 44, 999_999_937).select(F.col("id").alias("u")).where("u > 5000")
    reach = F.greatest(F.lit(10), bandjoin.floor_div(F.col("u") * 2, F.lit(1000).cast("long")))
    assert wide.select(F.max(bandjoin.shard(F.col("u") + reach) - bandjoin.shard(F.col("u") - reach))).first()[0] <= 2


def test_segment_tree():
    u = np.array(sorted(RNG.sample(range(500), 61)), np.int64)
    first = [[(int(x), RNG.randint(0, 9), 1, RNG.choice([1, 1, 2, 3]))] for x in u]
    tree = bandjoin.SegmentTree(u, np.arange(1, 62), np.arange(61) * 7, first, 3)
    for p in range(0, 500, 13):
        inside = [i for i, x in enumerate(u) if abs(x - p) <= 40]
        n, gaps, crc, near = tree.band(p, 40)
        assert (n, gaps, crc) == (sum(i + 1 for i in inside), sum((i + 1) * abs(int(u[i]) - p) for i in inside), sum(7 * i for i in inside))
        for item in (0, 1, 2, 3):  # whichever is excluded, three are left if there are three
            want = [x for x in bandjoin.nearest([first[i][0] for i in inside], p, 99) if x[3] != item][:3]
            assert [x for x in near if x[3] != item][:3] == want
    assert len(tree.canonical(0, 61)) <= 12


# --- archives

PAGES = "page_id long, url string, html string, payload string, digest int, records int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], PAGES).repartition(3)


def some_pages():
    copy, odd = "<p>copied page</p>" * 20, "é\x00\r\n\r\nWARC/1.0\r\n" * 30
    rows = [(i, f"http://a.example/{i}", f"<p>{i}</p>" * RNG.randint(1, 400)) for i in range(60)] + [(100 + i, "http://b.example/", copy) for i in range(9)]
    rows += [(200, None, None), (201, "", ""), (202, "http://x/ü q\r\nX: y", "short"), (203, "u", "short"), (204, "u", odd), (205, "u", odd), (206, "u", "x" * 3_000_000), (100, "again", copy), (None, "n", copy), (None, None, None)]
    return rows + [(207, "u", "y" * 99), (208, "u", "y" * 99), (210, "u", "z" * 100), (209, "u", "z" * 100)]


def plain_archive(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    own = lambda i, h: first.get(h) if i is not None and first.get(h) not in (None, i) else None
    return sorted(repr((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if own(i, h) is not None else "response", own(i, h))) for i, _, h in rows)


def test_archives_come_back(spark):
    rows = some_pages()
    assert sorted(repr(tuple(r)) for r in warc.digests(pages(spark, rows)).collect()) == plain_archive(rows)
    assert warc.digests(pages(spark, rows).limit(0)).count() == 0


def test_bundles_are_seekable_files(spark, tmp_path):
    rows = some_pages()
    archive = warc.write(pages(spark, rows), str(tmp_path / "archive"), bundle_bytes=30_000, frame_bytes=4_000)
    assert archive.count() > 3 and warc.record_map(archive).count() == len(rows)
    assert warc.export(archive, f"file://{tmp_path}/files").count() == archive.count()
    html, found = {i: h for i, _, h in rows if i is not None and i != 100}, Counter()
    for name in glob.glob(f"{tmp_path}/files/*.warc.zst"):
        raw = open(name, "rb").read()
        # any Zstandard reader gets the records one after the other, and passes over the seek table
        text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        reader = warc.BundleReader(raw)
        assert sum(f[2] for f in reader.frames) == len(text) and sum(f[1] for f in reader.frames) < len(raw)
        found["frames"] += len(reader.frames)
        found["records"] += text.count(b"WARC-Record-ID:")
    assert found["records"] == len(rows) and found["frames"] > archive.count()
    assert not glob.glob(f"{tmp_path}/files/.*.zst.*")
    ids = spark.createDataFrame([(f"urn:x-page:{i}",) for i in (3, 204, 205, 206, 9999)], "record_id string")
    got = {r.record_id: r for r in warc.fetch(archive, ids).collect()}
    assert set(got) == {f"urn:x-page:{i}" for i in (3, 204, 205, 206)} and got["urn:x-page:205"].payload is None and got["urn:x-page:205"].refers_to_id == "urn:x-page:204"
    assert all(bytes(got[f"urn:x-page:{i}"].payload) == html[i].encode() for i in (3, 204, 206))
    assert "FileScan parquet [bundle_id#" in (plan := warc.record_map(archive)._jdf.queryExecution().executedPlan().toString()) and "content" not in plan


def test_broken_bundles_are_told(spark):
    own = warc.BundleWriter(frame_bytes=10)
    for i in range(3):
        own.add(f"r{i}", warc.render(f"r{i}", None, b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None, "2024-01-01T00:00:00Z"))
    good = own.close()
    reader = warc.BundleReader(good)
    assert [warc.parse(reader.record(*p[1:]))["payload"] for p in own.places] == [b"payload 0", b"payload 1", b"payload 2"] and len(reader.frames) == 3
    with pytest.raises(warc.ArchiveError):
        warc.BundleReader(good[:-1])
    with pytest.raises(warc.ArchiveError):
        warc.BundleReader(b"")
    text = reader.record(*own.places[0][1:])
    for bad in (text.replace(b"payload 0", b"payload 1"), text[:-1], b"x" + text):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)
    swapped = own.places[1][1:3] + own.places[0][3:]
    assert warc.parse(reader.record(*swapped))["record_id"] == "r1"
    table = pa.table({"bundle_id": ["b"], "content": [good], "records": [[{"record_id": "r0", "frame": 1, "offset": 0, "length": own.places[1][3]}]]})
    with pytest.raises(Exception, match="isn't where the map has it"):
        warc.read(spark.createDataFrame(table.to_pandas(), warc.BUNDLE)).count()


# --- spelling


def plain_words(rows, least=7):
    import re

    counted = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counted[run] += 1
    return {w: n for w, n in counted.items() if n >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counted):
    form = {}
    near = {w: [v for v in counted if one_apart(w, v)] for w in counted}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counted[v], v), default=None)
        form[w] = best if best is not None and counted[best] >= 10 * counted[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted(repr((w, form[w], root(w), n, len(near[w]), counted[form[w]] if form[w] else None)) for w, n in counted.items())


def near_texts():
    """Words over few letters, so that runs of equal ones are common, their edits, and chains of forms."""
    words = {"".join(RNG.choice("abÉé") for _ in range(RNG.randint(7, 11))) for _ in range(60)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "ababababa"}
    for w in list(words):
        i = RNG.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1 :]}
    counts = {w: RNG.choice([1, 2, 3, 25]) for w in words} | {"kettlesx": 2, "kettles": 20, "kettlesa": 200, "settlesa": 2000}
    bag = [w for w, n in counts.items() for _ in range(n)]
    RNG.shuffle(bag)
    texts = [" ".join(x.upper() if RNG.random() < 0.1 and x.isascii() else x for x in bag[i : i + 50]) for i in range(0, len(bag), 50)]
    return list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (900, None), (901, ""), (902, "x1y2 short ÷×÷×÷×÷×"), (903, "÷×÷×÷×÷×")]


@pytest.mark.parametrize(("shard", "hot"), [(20_000, 50_000), (40, 5)])
def test_spelling_against_all_pairs(spark, monkeypatch, shard, hot):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, word int, key string, n int").repartition(3)
    counted = plain_words(rows)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == counted
    monkeypatch.setattr(spelling.near_words, "__defaults__", (shard, hot))
    assert sorted(repr(tuple(r)) for r in spelling.variants(docs).collect()) == plain_variants(counted)


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert spelling.variants(docs).collect() == [] == spelling.variants(docs.limit(0)).collect()


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links, 9).collect()} == {f"w{i}": "w9" for i in range(9)}



# --- operators of earlier rounds on rows that crashed them


def test_columns_of_any_name(spark):
    """Names with dots and backticks pass through every operator that adds columns."""
    rows = [(1, "some words of a text", "k", 3), (2, None, None, None), (3, "word " * 30, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `c``d.e` int")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    made = {
        "lines": linededup.dedup(docs), "language": language.identify(docs, {"en": b"some words", "de": b"andere"}), "toxicity": toxicity.score(docs, toxicity.Model()), "ids": coded,
        "back": bpe.decode(coded, ranks), "both": bpe.round_trip(docs, ranks, public_tokenizers.PATTERN),
    }
    for name, df in made.items():
        assert {"a.b", "c`d.e"} <= set(df.columns), name
        assert sorted((r["doc_id"], r["a.b"], r["c`d.e"]) for r in df.collect()) == [(i, a, c) for i, _, a, c in rows], name


def test_lines_of_repeated_ids_as_in_sql(spark, tmp_path):
    line = "A line of more than twenty characters"
    rows = [(1, line), (1, line), (2, f"{line}\nother"), (None, f"x\n{line}"), (3, None), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "kept_sha256", "n_dropped", "n_lines"]
    got = linededup.digests(spark.read.parquet(str(tmp_path / "documents.parquet"))).select(*columns).collect()
    want = con.sql(linededup.ORACLE).select(*columns).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (3, 0)]


def test_components_that_overflow_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e300, 1.0]), (2, [2.0**21, -(2.0**21)]), (3, [-1e10, 0.0]), (50, [3.0, 4.0]), (51, []), (52, None)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()}
    assert got[0, 50] == 256 * 256 * 11 and got[0, 2] == 256 * 256 * -(2**21) and {v for _, v in got} == {0, 2, 50, 51}


def test_toxicity_of_repeated_ids(spark):
    """A labelled id with several rows counts once, with its least text, whatever their order is."""
    rows = [(i, "vile hateful slur words" if i % 2 else "kind plain words") for i in range(40)] + [(1, "kind plain words"), (3, "zzz"), (None, "vile slur"), (None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, 1)], "doc_id long, toxic int")
    seen = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
        seen.append(sorted((r.doc_id or -1, r.text or "", round(r.score, 9), r.predicted) for r in scored))
    assert seen[0] == seen[1]
    assert {r.predicted for r in scored if r.text == "vile hateful slur words"} == {1} and {r.predicted for r in scored if r.text == "kind plain words"} == {0}
