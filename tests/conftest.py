from __future__ import annotations

import os
import subprocess

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def workspace(tmp_path):
    """A small git history: nine commits, a rename, a deletion, a binary file."""
    root = tmp_path / "work"
    root.mkdir()
    env = {**os.environ, "GIT_AUTHOR_NAME": "Ada", "GIT_AUTHOR_EMAIL": "ada@example.com", "GIT_COMMITTER_NAME": "Ada", "GIT_COMMITTER_EMAIL": "ada@example.com", "GIT_CONFIG_GLOBAL": "/dev/null"}
    clock = [1_700_000_000]

    def git(*args):
        clock[0] += 60
        when = {"GIT_AUTHOR_DATE": f"{clock[0]} +0000", "GIT_COMMITTER_DATE": f"{clock[0]} +0000"}
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env={**env, **when})

    git("init", "-q", "-b", "main")
    for i in range(6):
        (root / "src").mkdir(exist_ok=True)
        (root / "src" / f"mod{i % 3}.py").write_text(f"def f{i}():\n" + "".join(f"    value_{i}_{j} = {j}\n" for j in range(30)))
        git("add", "-A")
        git("commit", "-q", "-m", f"Change parser part {i}", "-m", "body")
    (root / "raw.bin").write_bytes(bytes(range(256)) * 4)
    (root / "notes.md").write_text("scheduler notes\n" * 40)
    git("add", "-A")
    git("commit", "-q", "-m", "Add scheduler notes")
    git("mv", "src/mod0.py", "src/renamed.py")
    git("commit", "-q", "-m", "Rename module")
    git("rm", "-q", "src/mod1.py")
    git("commit", "-q", "-m", "Delete module one")
    return root
