"""Command line: ``python -m spindrift.cli populate|query|prompt|list|import``; ``serve`` speaks the tool protocol on stdio."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from spindrift import __version__, api
from spindrift.functions.models import EMBEDDERS
from spindrift.functions.providers import NAMES, Settings
from spindrift.plans.search import SCOPES, export, table_rows
from spindrift.sources.history import PROVIDERS


def session() -> SparkSession:
    builder = SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--data-dir", default=str(Path.home() / ".spindrift"))
    p.add_argument("--debug", action="store_true", help="show all scores; log calls of the generator under logs/ of the data folder")
    p.add_argument("--llm-provider", default="auto", help=f"{', '.join(NAMES)}, or a registered generator")
    p.add_argument("--base-url-override", help="address of an OpenAI-compatible server")
    p.add_argument("--embedding-provider", default="hashing", choices=sorted(EMBEDDERS), help="of a new index; a known one keeps its own")
    p.add_argument("--expert-model")
    p.add_argument("--promptgen-model")
    p.add_argument("--no-reranking", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("populate", help="make or update an index")
    c.add_argument("expert")
    c.add_argument("workspace", nargs="?")
    c.add_argument("subdirs", nargs="*")
    c.add_argument("--max-commits", type=int, default=60_000)
    c.add_argument("--vcs-type", choices=list(PROVIDERS))
    c.add_argument("--batch-size", type=int, default=500)
    c.add_argument("--start-at", help="index what comes after this changelist")
    for name in ("query", "prompt"):
        c = sub.add_parser(name)
        c.add_argument("expert")
        c.add_argument("text")
        c.add_argument("--max-changes", type=int, default=10)
        c.add_argument("--max-file-chunks", type=int, default=10)
        c.add_argument("--users", default="", help="authors, separated by commas")
        c.add_argument("--files", default="", help="paths, separated by commas")
        if name == "query":
            c.add_argument("--search-scope", default="all", type=str.lower, choices=list(SCOPES))
            c.add_argument("--min-score", type=float, default=0.1)
            c.add_argument("--relative-threshold", type=float, default=0.8)
            c.add_argument("--output", help="JSON file")
        else:
            c.add_argument("--amogus", "--playful", action="store_true", dest="playful")
            c.add_argument("--impostor", "--paired", action="store_true", dest="paired")
            c.add_argument("--temperature", type=float, default=0.7)
    sub.add_parser("list")
    sub.add_parser("import").add_argument("path")
    sub.add_parser("serve")
    return p


def _items(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "import":
            print(api.import_expert(a.data_dir, a.path))
            return 0
        spark = session()
        settings = Settings(a.llm_provider, a.expert_model, a.promptgen_model, a.base_url_override, temperature=getattr(a, "temperature", 0.7))
        if a.command == "populate":
            n = api.populate(spark, a.data_dir, a.expert, a.workspace, a.subdirs, a.max_commits, a.batch_size, a.start_at, a.vcs_type, a.embedding_provider)
            print(n, "changelists indexed")
        elif a.command == "list":
            print(api.listing_markdown(api.list_experts(spark, a.data_dir)))
        elif a.command == "serve":
            from spindrift.tools import serve

            serve(spark, a.data_dir, sys.stdin, sys.stdout, settings)
        else:
            own = {"max_changes": a.max_changes, "max_file_chunks": a.max_file_chunks, "users": _items(a.users), "files": _items(a.files)}
            own |= {"reranker": None} if a.no_reranking else {}
            if a.command == "prompt":
                for piece in api.prompt_expert_stream(spark, a.data_dir, a.expert, a.text, a.llm_provider, a.playful, a.paired, settings, a.debug, **own):
                    if isinstance(piece, str):
                        print(piece, end="", flush=True)
                    elif piece.usage:
                        print(f"\n[{piece.usage.input_tokens} tokens in, {piece.usage.output_tokens} out]", file=sys.stderr)
                print()
                return 0
            own |= {"scope": a.search_scope, "min_score": a.min_score, "relative_threshold": a.relative_threshold}
            found = api.query_expert(spark, a.data_dir, a.expert, a.text, **own).persist()
            table_rows(found, a.debug).show(200, truncate=False)
            if a.output:
                Path(a.output).parent.mkdir(parents=True, exist_ok=True)
                Path(a.output).write_text(json.dumps(export(found, a.text, a.expert, _items(a.users), _items(a.files)), indent=2, ensure_ascii=False), "utf-8")
    except (api.EngineError, ValueError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
