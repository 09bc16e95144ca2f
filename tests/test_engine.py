from __future__ import annotations

import asyncio
import io
import json
import os
import subprocess
import sys
from datetime import UTC

import pytest
from pyspark.sql import functions as F

import spindrift
from spindrift import api, cli, tools
from spindrift.functions.models import EchoGenerator, GenerationError
from spindrift.operators import rank, relational, vector
from spindrift.operators.store import Store
from spindrift.plans import conversation, vector_index
from spindrift.plans.search import Engine, QueryParams, export, json_rows, markdown, table_rows
from spindrift.sources import git, history, perforce
from spindrift.sources.detect import detect
from spindrift.streaming.feed import index_workspace


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_top_k(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", [-1.0, 0.0]), ("e", None), ("f", [2.0, 0.0])], "id string, embedding array<float>")
    want = [("a", 1.0), ("f", 1.0), ("c", 0.707107)]
    assert [(i, round(s, 6)) for i, s in rows(vector.top_k(df, [1.0, 0.0], 3))] == want
    assert [(i, round(s, 6)) for i, s in rows(vector.top_k_native(df.where("embedding is not null"), [1.0, 0.0], 3))] == want
    assert len(rows(vector.top_k(df, [1.0, 0.0], 50))) == 6


def test_merge_and_pool(spark):
    m = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "result_id string, score double")
    d = spark.createDataFrame([("x", 0.7, "x_chunk_1"), ("y", 0.5, "y_chunk_0"), ("z", 0.9, "z_chunk_0")], "result_id string, score double, vector_id string")
    out = {r.result_id: (round(r.score, 6), r.source, r.vector_id) for r in vector.merged(m, d).collect()}
    assert out == {"x": (0.88, "metadata", None), "y": (0.5, "metadata", None), "z": (0.9, "diff", "z_chunk_0")}
    hits = spark.createDataFrame([("x", 0.5, "x_chunk_2"), ("x", 0.9, "x_chunk_1"), ("x", 0.9, "x_chunk_0")], "result_id string, score double, vector_id string")
    assert rows(vector.pooled(hits)) == [("x", 0.9, "x_chunk_0")]
    assert rows(vector.file_scores(hits)) == [("x", 0.5, "x_chunk_2")]
    assert rows(vector.file_scores(hits, "max")) == [("x", 0.9, "x_chunk_0")]
    with pytest.raises(ValueError):
        vector.file_scores(hits, "sum")


def test_thresholds(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.5), ("c", 1.0)], "result_id string, score double")
    assert [r[0] for r in rows(rank.relative_threshold(df, 0.5).orderBy("result_id"))] == ["a", "b"]
    assert len(rows(rank.relative_threshold(df, 1.0))) == 3
    assert rows(rank.relative_threshold(df.limit(0), 0.5)) == []
    close = spark.createDataFrame([("a", 0.9), ("b", 0.2)], "result_id string, score double")
    assert len(rows(rank.relative_threshold(close, 0.8))) == 2  # the range counts as 1


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create()
    s.create()
    new = spark.createDataFrame([("1", "p1"), ("2", "p2")], "id string, prompt string")
    s.upsert("prompt_cache", new, 1)
    s.upsert("prompt_cache", spark.createDataFrame([("2", "q2"), ("3", "q3")], "id string, prompt string"), 2)
    want = [("1", "p1"), ("2", "q2"), ("3", "q3")]
    assert rows(s.table("prompt_cache").orderBy("id")) == want
    s.upsert("prompt_cache", new, 1)  # a replay changes nothing
    assert rows(s.table("prompt_cache").orderBy("id")) == want
    assert s.delete("prompt_cache", F.col("id") == "3", 3) == 1
    assert s.delete("prompt_cache", spark.createDataFrame([("9",)], "id string"), 4) == 0
    s.insert_or_ignore("prompt_cache", spark.createDataFrame([("1", "no"), ("4", "yes")], "id string, prompt string"), 5)
    s.compact("prompt_cache")
    assert rows(s.table("prompt_cache").orderBy("id")) == [("1", "p1"), ("2", "q2"), ("4", "yes")]
    assert s.log("prompt_cache").count() == 0


def test_store_after_compaction(spark, tmp_path):
    """What is written after a compaction under a later number is newer, whatever the clock says; a replay of what was folded changes nothing."""
    s = Store(spark, str(tmp_path / "s"))
    frame = lambda *r: spark.createDataFrame(r, "id string, prompt string")
    read = lambda: rows(s.table("prompt_cache").orderBy("id"))
    s.upsert("prompt_cache", frame(("1", "a"), ("2", "b"), ("3", "c")), 10)
    s.delete("prompt_cache", F.col("id") == "3", 11)
    s.compact("prompt_cache")
    assert read() == [("1", "a"), ("2", "b")]
    s.upsert("prompt_cache", frame(("1", "new")), 20)
    assert s.delete("prompt_cache", F.col("id") == "2", 21) == 1
    assert read() == [("1", "new")]
    s.upsert("prompt_cache", frame(("1", "a"), ("2", "b"), ("3", "c")), 10)
    assert read() == [("1", "new")]
    s.compact("prompt_cache")
    s.upsert("prompt_cache", frame(("4", "early")), 5)  # older than the base, but of a key that it doesn't have
    s.upsert("prompt_cache", frame(("1", "old")), 6)
    assert read() == [("1", "new"), ("4", "early")]
    assert s.upsert("prompt_cache", frame(("5", "next"))) > 21
    plan = s.table("prompt_cache")._jdf.queryExecution().toString()
    s.compact("prompt_cache")
    assert "Aggregate" in plan and "Exchange" not in s.table("prompt_cache")._jdf.queryExecution().toString()


def test_a_limit_skips_nothing(spark, workspace, tmp_path):
    s = Store(spark, str(tmp_path / "index"))
    for limit, new in ((4, 4), (5, 1), (100, 4), (100, 0)):
        assert index_workspace(spark, s, "w", str(workspace), batch_size=3, max_commits=limit) == new
    ids = git.commit_ids(str(workspace))
    assert {r.id for r in s.table("changelists").collect()} == set(ids)
    late = Store(spark, str(tmp_path / "late"))
    assert index_workspace(spark, late, "w", str(workspace), start_after=ids[6]) == 2
    with pytest.raises(git.UnknownCommitError):
        index_workspace(spark, late, "w", str(workspace), start_after="none")


def test_many_batches_are_compacted(spark, workspace, tmp_path):
    one, many = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "many"))
    index_workspace(spark, one, "w", str(workspace))
    index_workspace(spark, many, "w", str(workspace), batch_size=1)
    assert many.log("changelists").select("batch_seq").distinct().count() <= 8 and many.base("changelists").count() > 0
    for t in ("changelists", "changelist_files", "file_chunks", "file_contents", "vectors"):
        cells = lambda x: sorted(map(str, x.table(t).drop("last_indexed_at", "revision_id").collect()))  # noqa: B023, E731
        assert cells(many) == cells(one), t


def test_index_after_compaction(spark, workspace, tmp_path):
    s = Store(spark, str(tmp_path / "index"))
    assert index_workspace(spark, s, "w", str(workspace), batch_size=3, max_commits=4) == 4
    for table in ("changelists", "changelist_files", "file_chunks", "file_contents", "vectors", "experts"):
        s.compact(table)
    assert index_workspace(spark, s, "w", str(workspace), batch_size=3) == 5
    whole = Store(spark, str(tmp_path / "whole"))
    index_workspace(spark, whole, "w", str(workspace))
    for t in ("changelists", "file_chunks", "file_contents", "vectors"):
        cells = lambda x: sorted(map(str, x.table(t).drop("last_indexed_at", "revision_id").collect()))  # noqa: B023, E731
        assert cells(s) == cells(whole), t


def test_an_older_branch_that_is_merged_later(spark, workspace, tmp_path):
    """Its commits stand before the cursor in the listing; they are indexed all the same, once, and files are as the merge has them."""

    def run(*args, at=1_600_000_000):
        who = {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Bob"), ("EMAIL", "bob@example.com"), ("DATE", f"{at} +0000"))}
        return subprocess.run(["git", "-C", str(workspace), *args], check=True, capture_output=True, env={**os.environ, **who, "GIT_CONFIG_GLOBAL": "/dev/null"}).stdout.decode().strip()

    s = Store(spark, str(tmp_path / "index"))
    main = git.commit_ids(str(workspace))
    run("checkout", "-q", "-b", "older", main[2])
    for i in range(3):
        (workspace / f"branch{i}.md").write_text(f"a line of the branch {i}\n" * 20)
        (workspace / "src" / "mod2.py").write_text(f"old = {i}\n" * 40) if i == 1 else None
        run("add", "-A")
        run("commit", "-q", "-m", f"Branch {i}", at=1_600_000_000 + i)
    run("checkout", "-q", "main")
    assert index_workspace(spark, s, "w", str(workspace), batch_size=4) == 9
    assert index_workspace(spark, s, "w", str(workspace)) == 0
    run("merge", "-q", "-X", "ours", "-m", "Merge", "older", at=1_800_000_000)
    ids = git.commit_ids(str(workspace))
    assert len(ids) == 12 and ids.index(main[-1]) == 11 and ids[0] not in main  # all that is new is before the cursor
    assert index_workspace(spark, s, "w", str(workspace), batch_size=2, max_commits=11) == 2  # a limit inside the run
    (workspace / "late.md").write_text("written while the run was under way\n" * 9)
    run("add", "-A")
    run("commit", "-q", "-m", "Late", at=1_800_000_100)
    assert index_workspace(spark, s, "w", str(workspace), batch_size=2) == 2
    assert {r.id for r in s.table("changelists").collect()} == set(git.commit_ids(str(workspace)))
    row = s.table("experts").first()
    assert row.frontier == [git.head(str(workspace))] and row.target is None and row.listed == 13
    want = {p for p in git.tracked(str(workspace)) if (workspace / p).stat().st_size >= 128 and p != "raw.bin"}
    held = {}
    for r in s.table("file_chunks").orderBy("file_path", "chunk_index").collect():
        held[r.file_path] = held.get(r.file_path, "") + r.content
    assert set(held) == want and held["src/mod2.py"].strip() == (workspace / "src" / "mod2.py").read_text().strip()
    assert git.ancestors(str(workspace), [main[0], "0" * 40, git.head(str(workspace))], main[3]) == [main[0], "0" * 40]


def test_contents_of_odd_paths(workspace):
    """A newline in a path, of a file that is there or not, shifts nobody else's answer."""
    at = str(workspace)
    (workspace / "two\nlines.md").write_text("odd name\n" * 3)
    (workspace / "a b.md").write_text("blank in it\n")
    for args in (("add", "-A"), ("-c", "user.name=a", "-c", "user.email=a@example.com", "commit", "-q", "-m", "Odd")):
        subprocess.run(["git", "-C", at, *args], check=True, capture_output=True)
    asked = ["no\nsuch", "two\nlines.md", "none missing\n", "a b.md", "src", "raw.bin", "src/mod2.py"]
    got = dict(git.contents(at, asked))
    want = {"two\nlines.md": "odd name\n" * 3, "a b.md": "blank in it\n", "src/mod2.py": (workspace / "src" / "mod2.py").read_text()}
    assert got == {p: want.get(p) for p in asked} and "two\nlines.md" in git.tracked(at)
    assert dict(git.contents(at, [p for p in asked if "\n" not in p])) == {p: want.get(p) for p in asked if "\n" not in p}


def test_pages_of_a_listing(workspace):
    """Any page is that part of the whole listing, from any head and without what others know."""
    at = str(workspace)
    ids = git.commit_ids(at)
    for until, known in (("HEAD", ()), (ids[6], ()), ("HEAD", (ids[3],)), (ids[7], (ids[1], "0" * 40))):
        whole = git.commit_ids(at, (), until, known)
        assert git.count_ids(at, (), until, known) == len(whole) > 0
        for lo, hi in ((0, 2), (1, 4), (3, 99), (5, 5), (-2, 1), (50, 60)):
            assert git.ids_between(at, lo, hi, (), until, known) == whole[max(0, lo) : hi]
        assert [git.place_of(at, i, (), until, known) for i in whole] == list(range(len(whole))) and git.place_of(at, "none", (), until, known) is None
    under = git.commit_ids(at, ("src",))
    assert git.ids_between(at, 1, 3, ("src",)) == under[1:3] and git.count_ids(at, ("src",)) == len(under) < len(ids)
    assert git.ids_after(at, ids[2], 3) == ids[3:6] and git.ids_after(at, None, 0) == [] and git.ids_after(at, ids[-1], 5) == []


def test_a_batch_that_breaks_off_leaves_nothing(spark, workspace, tmp_path, monkeypatch):
    from spindrift.plans import indexing

    s, broken = Store(spark, str(tmp_path / "index")), []
    tables = ("changelists", "changelist_files", "file_chunks", "file_contents", "vectors")

    def fail(*_):
        broken.append([Store(spark, s.root).table(t).count() for t in tables])  # all writes are made, and nobody sees them
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(indexing.vector_index, "maintain", fail)
        with pytest.raises(Exception, match="cut off"):
            index_workspace(spark, s, "w", str(workspace))
    assert broken and all(b == [0] * 5 for b in broken) and s.table("experts").first().last_processed is None
    assert index_workspace(spark, s, "w", str(workspace)) == 9
    vector_index.build(s, "diffs", cells=3)
    exact, near = (Engine(spark, s.root).search(QueryParams("def value_1_1", scope="diffs", probes=n, reranker=None, min_score=0.0)).collect() for n in (0, 3))
    assert exact == near and exact


def test_pages(spark):
    feed = spark.createDataFrame([(str(i), i) for i in range(5)], "id string, ordinal int")
    assert [r[0] for r in rows(relational.page_after(feed, "1", 2))] == ["2", "3"]
    assert rows(relational.page_after(feed, "9", 2)) == []
    assert len(rows(relational.page_after(feed, None, 2))) == 2
    assert relational.remaining(10, 7, 3) == 4 and relational.remaining(2, 7, 3) == 0


def test_git_source(spark, workspace):
    history.register(spark)
    df = spark.read.format("spindrift_git").option("path", str(workspace)).option("slice_size", "4").load()
    got = df.orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(9)) and got[0].author == "Ada <ada@example.com>" and got[0].message == "Change parser part 0"
    assert sorted(got[7].files) == ["src/mod0.py", "src/renamed.py"]
    files = spark.read.format("spindrift_git").option("path", str(workspace)).option("table", "content").load()
    found = {r.file_path: r.content for r in files.collect()}
    assert found["raw.bin"] is None and found["notes.md"].startswith("scheduler") and "src/mod1.py" not in found
    assert "+def f0():" in got[0].diff and got[8].files == ["src/mod1.py"]
    ids = git.commit_ids(str(workspace))
    assert git.ids_page(str(workspace), ids[1], 1, 3) == ids[::-1][3:6] and git.count(str(workspace)) == 9 == git.count(str(workspace), False)
    assert git.latest_time(str(workspace)) == max(r.ts for r in got).replace(tzinfo=UTC) and git.count(str(workspace / "src" / "none")) == 0
    assert [r[0] for r in git.read_commits(str(workspace), [ids[3], ids[1]])] == [ids[3], ids[1]] and list(git.read_commits(str(workspace), [])) == []
    assert [r[4] for r in git.read_commits(str(workspace), ids[:1], ("none",))] == [""]
    own = history.provider("git")
    assert history.content(own, str(workspace), "notes.md").startswith("scheduler") and own.detect(str(workspace))
    with pytest.raises(ValueError):
        history.provider("svn")
    assert git.ids_after(str(workspace), ids[2], 2) == ids[3:5] and git.ids_after(str(workspace), None, 0) == []
    with pytest.raises(git.UnknownCommitError):
        git.ids_after(str(workspace), "f" * 40, 2)
    assert detect(str(workspace)) == "git" and detect(" ") is None and detect(str(workspace / "src")) is None


def test_index_in_one_or_many_batches(spark, workspace, tmp_path):
    tables = []
    for size in (100, 2):
        s = Store(spark, str(tmp_path / f"index{size}"))
        assert index_workspace(spark, s, "w", str(workspace), batch_size=size) == 9
        assert index_workspace(spark, s, "w", str(workspace), batch_size=size) == 0
        tables.append({t: sorted(map(str, s.table(t).drop("last_indexed_at", "revision_id").collect())) for t in ("changelists", "changelist_files", "file_chunks", "file_contents", "vectors")})
    assert tables[0] == tables[1]
    assert {r.split("file_path='")[1].split("'")[0] for r in tables[0]["file_contents"]} == {"notes.md", "src/renamed.py", "src/mod2.py"}


def test_surface(spark, workspace, tmp_path):
    data = str(tmp_path / "data")
    assert api.populate(spark, data, "demo", str(workspace), max_commits=8) == 8
    assert api.populate(spark, data, "demo", max_commits=8) == 0
    with pytest.raises(ValueError):
        api.populate(spark, data, "demo", str(tmp_path))
    with pytest.raises(api.ExpertNotFoundError):
        api.query_expert(spark, data, "other", "x")
    with pytest.raises(ValueError):
        api.check_name("a b")
    found = api.query_expert(spark, data, "demo", "scheduler notes", min_score=0.05).persist()
    kinds = [r.result_type for r in found.collect()]
    assert "commit" in kinds and "file_chunk" in kinds
    assert found.first().score >= found.tail(1)[0].score
    assert api.query_expert(spark, data, "demo", "scheduler notes", users=("nobody",), scope="metadata").isEmpty()
    shown = export(found, "scheduler notes", "demo")
    assert shown["filters"] == {"users": None, "files": None} and len(shown["results"]) == len(kinds) == json_rows(found).count() == table_rows(found, True).count()
    assert markdown(found, "q").startswith("# Query Results: q")
    said = list(api.prompt_expert_stream(spark, data, "demo", "scheduler notes", paired=True, debug=True))
    assert said[:2] == ["scheduler ", "notes"] and said[2].content == "scheduler notes" and said[2].usage.total_tokens > 0
    assert spark.read.json(f"{data}/logs").count() == 1

    async def gathered():
        return [x async for x in api.prompt_expert_stream_async(spark, data, "demo", "scheduler notes")]

    assert asyncio.run(gathered())[:2] == said[:2]
    with api.Context(spark, data, "demo") as own:
        assert own.store is own.store and own.engine.embedder == "hashing"
        assert "store" in own.__dict__
    assert "store" not in own.__dict__
    assert spindrift.query_expert is api.query_expert and "populate" in dir(spindrift)
    with pytest.raises(AttributeError):
        spindrift.nothing
    listed = api.list_experts(spark, data)
    assert listed[0]["commit_count"] == 8 and "demo" in api.listing_markdown(listed)
    other = str(tmp_path / "other")
    assert api.import_expert(other, f"{data}/data/demo") == "demo"
    with pytest.raises(api.ExpertExistsError):
        api.import_expert(other, f"{data}/data/demo")
    with pytest.raises(api.InvalidIndexError):
        api.import_expert(other, str(workspace))
    out = io.StringIO()
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list"}}, {"id": 4, "method": "tools/call", "params": {"name": "query", "arguments": {"expert_name": "none", "prompt": "x"}}}]
    tools.serve(spark, other, io.StringIO("\n".join(map(json.dumps, calls))), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4] and "demo" in replies[2]["result"]["content"][0]["text"] and replies[3]["result"]["isError"]
    assert tools.budgets(5) == {"max_changes": 3, "max_file_chunks": 2}
    assert all("demo" in t["description"] for t in replies[1]["result"]["tools"]) and "no index 'none'" in replies[3]["result"]["content"][0]["text"]
    asked = {"expert_name": "demo", "prompt": "scheduler notes", "max_changes": 4, "search_scope": "metadata"}
    assert tools.call(spark, data, "query", asked).count("## ") == 1
    assert tools.call(spark, data, "query", {**asked, "users": ["nobody"]}).startswith("No matching")
    assert tools.call(spark, data, "prompt", {"expert_name": "demo", "prompt": "scheduler notes", "impostor": True, "temperature": 0.1}) == "scheduler notes"
    with pytest.raises(ValueError):
        tools.call(spark, data, "query", {**asked, "limit": 3})
    assert cli.main(["--data-dir", data, "--llm-provider", "echo", "prompt", "demo", "scheduler notes", "--temperature", "0.2"]) == 0
    assert cli.main(["--data-dir", data, "--no-reranking", "query", "demo", "scheduler notes", "--output", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text())["expert"] == "demo" and cli.main(["--data-dir", data, "query", "none", "x"]) == 1
    assert cli.parser().parse_args(["populate", "x"]).max_commits == 60_000


P4 = '''#!{python}
import sys
args = sys.argv[1:]
DESCRIBED = {described!r}
if args[0] == "info":
    print("Client root: {root}")
elif args[0] == "where":
    print("//depot/... //ws/... {root}/...")
elif args[0] == "changes":
    found = [(n, p) for n, p in ((9, "src/a.txt"), (10, "doc/b.txt"), (11, "src/a.txt"), (10, "src/c.txt")) if ("//depot/" + p).startswith(args[-1][:-3])]
    for n, _ in found[:1] if "-m" in args else found:
        print(f"Change {{n}} on 2024/01/{{n:02}} 10:00:00 by ada@ws 'text'")
elif args[0] == "describe":
    for n in args[2:]:
        print(DESCRIBED[n])
elif args[0] == "files":
    print("//depot/src/a.txt#2 - edit change 11 (text)\\n//depot/old.txt#3 - delete change 10 (text)\\n//depot/doc/b.txt#1 - add change 10 (text)")
elif args[0] == "print":
    for p in args[1:]:
        p = p.split("@")[0]
        if not p.endswith("none.txt"):
            print(p + "#2 - edit change 11 (text)\\n" + "content of " + p + "\\n" + "line " * 40)
'''


def test_perforce_end_to_end(spark, tmp_path, monkeypatch):
    """A stand-in for the client, through the provider, the data source and the index."""
    root = tmp_path / "ws"
    root.mkdir()
    one = "Change {n} by ada@ws on 2024/01/{n:02} 10:00:00\n\n\tChange number {n}\n\tmore\n\nAffected files ...\n\n... //depot/{f}#2 edit\n\nDifferences ...\n\n==== //depot/{f}#2 (text) ====\n\n@@ -1 +1 @@\n-a\n+b{n}\n"
    described = {str(n): one.format(n=n, f=f) for n, f in ((9, "src/a.txt"), (10, "doc/b.txt"), (11, "src/a.txt"))}
    client = tmp_path / "p4"
    client.write_text(P4.format(python=sys.executable, described=described, root=root))
    client.chmod(0o755)
    own, at = perforce.Perforce(str(client)), str(root)
    assert own.detect(at) and not own.detect(str(tmp_path)) and not perforce.Perforce("no-such-client").detect(at)
    assert own.commit_ids(at) == ["9", "10", "11"] and own.commit_ids(at, ("src",)) == ["9", "10", "11"] and own.commit_ids(at, ("doc",)) == ["10"]
    assert own.ids_after(at, "9", 5) == ["10", "11"] and own.ids_after(at, None, 1) == ["9"] and own.ids_after(at, "77", 2) == [] and own.ids_after(at, "9", 0) == []
    with pytest.raises(perforce.UnknownChangeError):
        own.ids_after(at, "x", 1)
    assert [(r[0], r[3], r[5]) for r in own.read_commits(at, ["10", "9"])] == [("10", "Change number 10\nmore", ["doc/b.txt"]), ("9", "Change number 9\nmore", ["src/a.txt"])]
    assert own.tracked(at, "11") == ["doc/b.txt", "src/a.txt"] and own.count(at) == 3 and own.latest_time(at).day == 9
    assert dict(own.contents(at, ["src/a.txt", "none.txt"], "11"))["none.txt"] is None
    history.register(spark)
    df = spark.read.format("spindrift_history").options(provider="p4", command=str(client), path=at, message="full").load()
    assert [(r.ordinal, r.id) for r in df.orderBy("ordinal").collect()] == [(0, "9"), (1, "10"), (2, "11")]
    s = Store(spark, str(tmp_path / "index"))
    assert index_workspace(spark, s, "w", at, batch_size=2, kind="p4", command=str(client)) == 3
    assert sorted(r.file_path for r in s.table("file_contents").collect()) == ["doc/b.txt", "src/a.txt"]
    assert [r.last_processed for r in s.table("experts").collect()] == ["11"]


def test_params():
    for bad in ({"prompt": " "}, {"prompt": "x", "max_changes": 0}, {"prompt": "x", "scope": "none"}, {"prompt": "x", "max_file_chunks": 101}):
        with pytest.raises(ValueError):
            QueryParams(**bad)


def test_conversation(spark):
    cl = spark.createDataFrame([("2", 20, "second", ["b"], "d2", "p2"), ("1", 10, "first", [f"f{i}" for i in range(12)], "x" * 50, "p1")], "id string, t int, message string, files array<string>, diff string, generated_prompt string")
    cl = cl.withColumn("ts", F.timestamp_seconds("t"))
    chunks = spark.createDataFrame([("b.py", 5, 6, "two"), ("b.py", 1, 2, "one"), ("a.md", 1, 1, "doc")], "file_path string, line_start int, line_end int, content string")
    system, said = conversation.build(cl, "why?", chunks, most=20)
    assert [m["role"] for m in said] == ["user"] * 4 and said[-1]["content"] == "why?" and system == conversation.SYSTEM
    assert said[0]["content"].startswith("Commit: first\nFiles: f0, f1, f2, f3, f4, f5, f6, f7, f8, f9 (and 2 more)\nChanges:\n" + "x" * 20 + conversation.BREVITY)
    state = said[2]["content"]
    assert state.index("a.md") < state.index("lines 1-2") < state.index("lines 5-6") and "```python\none\n```" in state
    paired = conversation.build(cl, "why?", paired=True)[1]
    assert [m["role"] for m in paired] == ["user", "assistant", "user", "assistant", "user"] and paired[0]["content"] == "p1"
    with pytest.raises(conversation.NoChangelistsError):
        conversation.build(cl.limit(0), "why?")
    cache = spark.createDataFrame([("1", "cached")], "id string, prompt string")
    made = {r.id: (r.prompt, r.hit) for r in conversation.generated_prompts(cl, cache).collect()}
    assert made["1"] == ("cached", True) and made["2"][1] is False
    assert EchoGenerator(3).generate("", [{"role": "user", "content": "hello"}]).content == "hel"


class Scribe:
    """A generator that notes every request in a file, and refuses those that say so while another file is there."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, system, messages):
        with open(f"{self.folder}/asked", "a") as f:
            f.write(json.dumps(messages[-1]["content"]) + "\n")
        if "refuse" in messages[-1]["content"] and os.path.exists(f"{self.folder}/down"):
            raise RuntimeError("service is down")
        return EchoGenerator(400).generate(system, messages)


def test_prompts_are_kept_as_they_come(spark, tmp_path):
    """A run that fails halfway has kept what had an answer; the next one asks for the rest alone, and for equal requests once."""
    s, folder = Store(spark, str(tmp_path / "s")), str(tmp_path)
    s.create()
    rows = [(str(i), f"message {i % 20}" + (" refuse" if i in (7, 33) else ""), ["f"], "d") for i in range(40)] + [("40", "other", [], None), ("40", "other", [], None)]
    changes = spark.createDataFrame(rows, "id string, message string, files array<string>, diff string").repartition(3)
    s.upsert("prompt_cache", spark.createDataFrame([("1", "mine"), ("2", "")], "id string, prompt string"))
    asked = lambda: [json.loads(x) for x in (tmp_path / "asked").read_text().splitlines()]
    (tmp_path / "down").write_text("")
    with pytest.raises(GenerationError, match="service is down"):
        conversation.keep_prompts(s, changes, lambda: Scribe(folder), round_size=8)
    first, kept = asked(), {r.id for r in s.table("prompt_cache").where("prompt != ''").collect()}
    assert {"7", "33"}.isdisjoint(kept) and len(kept) > 1 and len(first) == len(set(first))
    (tmp_path / "down").unlink()
    hits, made = conversation.keep_prompts(s, changes, lambda: Scribe(folder), round_size=8)
    assert (hits, made) == (len(kept), 41 - len(kept))
    again = asked()[len(first) :]
    assert len(again) == len(set(again)) and all("refuse" in r for r in set(first) & set(again))
    got = {r.id: r.prompt for r in s.table("prompt_cache").collect()}
    assert len(got) == 41 and got["1"] == "mine" and "message 2" in got["22"] and got["2"] == got["22"]
    assert conversation.keep_prompts(s, changes, lambda: Scribe(folder)) == (41, 0) and len(asked()) == len(first) + len(again)


def test_rounds_of_prompts_do_not_grow_with_the_requests(spark, tmp_path):
    """Rounds are bounded whatever there is to ask; every request is asked once."""
    s, folder = Store(spark, str(tmp_path / "s")), str(tmp_path)
    s.create()
    rows = [(str(i), f"message {i % 40}", ["f"], "d") for i in range(60)]
    changes = spark.createDataFrame(rows, "id string, message string, files array<string>, diff string")
    assert conversation.keep_prompts(s, changes, lambda: Scribe(folder), round_size=1) == (0, 60)
    assert len(s.snapshot().numbers("prompt_cache")) <= conversation.MOST_ROUNDS
    asked = (tmp_path / "asked").read_text().splitlines()
    assert len(asked) == len(set(asked)) == 40 and s.table("prompt_cache").count() == 60


def test_described_diffs_are_filtered_once(spark):
    """Binary sections go, plain diffs stay as they are, blank ones are dropped; the filter isn't computed again to drop them."""
    head = "Change {0} by ada@ws on 2024/01/15 14:30:00\n\n\tFix it\n\nAffected files ...\n\n... //depot/a#1 edit\n\nDifferences ...\n\n"
    plain, odd = "==== //depot/a#1 (text) ====\n\n+x\n", "==== //depot/b#1 (text) ====\n\n+" + "\u00ff\x00" * 40 + "\n"
    outputs = [(head.format(1) + plain * 2,), (head.format(2) + plain + odd + plain,), (head.format(3),), (None,), (head.format(4) + plain + head.format(5) + plain.replace("x", "caf\u00e9"),)]
    rows = perforce.describe_rows(spark.createDataFrame(outputs, "output string"))
    whole, note = (plain * 2).strip("\n"), "diff --git a///depot/b b///depot/b\n[binary file: //depot/b]\n"
    assert {r.id: r.diff for r in rows.collect()} == {"1": whole, "2": plain + note + plain.strip("\n"), "4": plain.strip("\n"), "5": plain.replace("x", "caf\u00e9").strip("\n")}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("//depot") + rows._jdf.queryExecution().optimizedPlan().toString().count("binary file") < 3


def test_perforce(spark):
    out = (
        "Change 12 by ada@ws on 2024/01/15 14:30:00\n\n\tFix it\n\tnow\n\nAffected files ...\n\n... //depot/src/a.cpp#4 edit\n... //other/b.cpp#1 add\n\nDifferences ...\n\n"
        "==== //depot/src/a.cpp#4 (text) ====\n\n@@ -1 +1 @@\n-a\n+b\n\n==== //other/b.cpp#1 (text) ====\n\n+z\n\n"
        "Change 13 by bob@ws on 2024/01/16 10:00:00\n\nAffected files ...\n\n... //depot/src/c.bin#1 add\n\nDifferences ...\n\n"
    )
    mapping = perforce.Mapping.of_where("//depot/... //ws/... /home/ada/ws/...")
    got = list(perforce.described(out, mapping, ("//depot/",)))
    assert [(g[0], g[2], g[3], g[5]) for g in got] == [("12", "ada@ws", "Fix it\nnow", ["src/a.cpp"]), ("13", "bob@ws", "Changelist 13", ["src/c.bin"])]
    assert "+b" in got[0][4] and "+z" not in got[0][4] and got[1][4] == ""
    kept = perforce.describe_rows(spark.createDataFrame([(out,)], "output string"), mapping=mapping).collect()
    assert [r.id for r in kept] == ["12"]
    assert perforce.changelist_ids("Change 10 on x\nChange 9 on y\nChange 10 on x\n") == ["9", "10"]
    assert perforce.latest_time("Change 7 on 2024/02/03 by a@b 'x'").day == 3 and perforce.latest_time("") is None
    assert mapping.to_depot("src") == "//depot/src" and mapping.to_local("//depot/x/y") == "x/y"
    printed = "//depot/a.txt#3 - edit change 5 (text)\nhello\n//depot/b.bin#1 - add change 6 (binary)\nxx\n"
    assert dict(perforce.printed_files(printed)) == {"//depot/a.txt": "hello", "//depot/b.bin": None}
    assert perforce.client_root("User name: a\nClient root: /home/ada/ws\n") == "/home/ada/ws"
