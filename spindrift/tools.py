"""A tool server: JSON-RPC lines on stdio, tools list, import, query, prompt."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace
from typing import TextIO

from pyspark.sql import SparkSession

from spindrift import __version__, api
from spindrift.functions.providers import Settings
from spindrift.plans.search import markdown

# The tools' names, parameters and defaults.
MOST_CHANGES, TEMPERATURE = 20, 0.7
_FILTERS = {
    "expert_name": {"type": "string", "description": "the index to search"},
    "prompt": {"type": "string", "description": "what to look for, best as a sentence"},
    "max_changes": {"type": "integer", "description": "how many results at most; changelists get the larger half", "default": MOST_CHANGES},
    "users": {"type": "array", "items": {"type": "string"}, "description": "only changelists of these authors"},
    "files": {"type": "array", "items": {"type": "string"}, "description": "only changelists and files with these paths"},
}
_SCHEMAS = {
    "list": {},
    "import": {"source_path": {"type": "string", "description": "folder of an index that lies elsewhere"}},
    "query": {**_FILTERS, "search_scope": {"type": "string", "enum": ["metadata", "diffs", "files", "all"], "description": "what is searched", "default": "all"}},
    "prompt": {
        **_FILTERS,
        "impostor": {"type": "boolean", "description": "tell changelists as answers to prompts made from them", "default": False},
        "amogus": {"type": "boolean", "description": "playful answers; leave it off", "default": False},
        "temperature": {"type": "number", "minimum": 0.0, "maximum": 1.0, "description": "of the text generator", "default": TEMPERATURE},
    },
}
_REQUIRED = {"import": ["source_path"], "query": ["expert_name", "prompt"], "prompt": ["expert_name", "prompt"]}
# End of the fixed values.
_ABOUT = {
    "list": "Lists the indexes with their sizes, ranges and workspaces.",
    "import": "Makes an index that lies in another folder known here, by a link.",
    "query": "Finds changelists and files of an index by meaning and returns them whole; they can be long.",
    "prompt": "Answers a question about a code base from its history: why it is as it is, what was tried, what went wrong.",
}


def known_indexes(experts: Sequence[dict]) -> str:
    """What the tools' descriptions say of the indexes there are."""
    if not experts:
        return "No index is there yet; make one with the populate command."
    out = ["Indexes:"]
    for e in experts:
        span = f", {e['first_processed'][:8]} to {e['last_processed'][:8]}" if e["first_processed"] and e["last_processed"] else ""
        out.append(f"- {e['name']}: {e['workspace_path']}, {e['commit_count']} {e['vcs_type']} changelists{span}")
    return "\n".join(out)


def tools(experts: Sequence[dict]) -> list[dict]:
    known = known_indexes(experts)
    schema = lambda name: {"type": "object", "properties": _SCHEMAS[name], "required": _REQUIRED.get(name, [])}
    return [{"name": name, "description": f"{_ABOUT[name]}\n\n{known}", "inputSchema": schema(name)} for name in _SCHEMAS]


def budgets(n: int) -> dict[str, int]:
    """Changelists get the larger half, file chunks the other; one at least of each."""
    return {"max_changes": max(1, -(-n // 2)), "max_file_chunks": max(1, n // 2)}


def call(spark: SparkSession, data_dir: str, name: str, args: dict, settings: Settings | None = None) -> str:
    if name not in _SCHEMAS:
        raise ValueError(f"unknown tool {name!r}")
    if unknown := set(args) - set(_SCHEMAS[name]):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    if name == "list":
        return api.listing_markdown(api.list_experts(spark, data_dir))
    if name == "import":
        return f"Imported {api.import_expert(data_dir, args['source_path'])} from {args['source_path']}"
    own = budgets(int(args.get("max_changes", MOST_CHANGES))) | {"users": tuple(args.get("users") or ()), "files": tuple(args.get("files") or ())}
    try:
        if name == "query":
            return markdown(api.query_expert(spark, data_dir, args["expert_name"], args["prompt"], scope=args.get("search_scope", "all"), **own), args["prompt"])
        settings = replace(settings or Settings(provider="echo"), temperature=float(args.get("temperature", TEMPERATURE)))
        return api.prompt_expert(
            spark, data_dir, args["expert_name"], args["prompt"], generator=settings.provider, playful=bool(args.get("amogus")), paired=bool(args.get("impostor")), settings=settings, **own
        ).content
    except api.ExpertNotFoundError as e:
        raise api.ExpertNotFoundError(f"no index {args['expert_name']!r}; the tool list names those there are") from e
    except api.NoResultsError as e:
        raise api.NoResultsError(f"nothing found for {args['prompt']!r}; try broader or other words, or fewer filters") from e


def answer(spark: SparkSession, data_dir: str, request: dict, settings: Settings | None = None) -> dict | None:
    """The reply to one message; None for notifications."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "spindrift", "version": __version__}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": tools(api.list_experts(spark, data_dir))}}
    if method == "tools/call":
        try:
            text, bad = call(spark, data_dir, params.get("name", ""), params.get("arguments") or {}, settings), False
        except Exception as e:  # whatever a tool raises is its answer; the server goes on
            text, bad = f"{type(e).__name__}: {e}", True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}


def serve(spark: SparkSession, data_dir: str, lines: TextIO, out: TextIO, settings: Settings | None = None) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(spark, data_dir, json.loads(line), settings)
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
