"""Registered queries of what surrounds text generators: requests, streams, session files, providers, the tool server, the command line."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import spindrift
from spindrift import cli, tools
from spindrift.functions import generators as g
from spindrift.functions import models, providers
from spindrift.plans import derived as d
from spindrift.plans.registry import literal_rows, query
from spindrift.plans.scratch import folder

_TURNS = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def _each(spark: SparkSession, sf_dir: str, told: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``told`` of the messages of every conversation, in their order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    whole = d.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))

    def run(frames):
        for f in frames:
            rows = []
            for i, turns_ in zip(f["conv_id"], f["turns"], strict=True):
                rows += [(i, *r) for r in told([{"role": t["role"], "content": t["text"]} for t in turns_])]
            yield pd.DataFrame(rows, columns=["conv_id", *(c.split()[0] for c in schema.split(", "))])

    return whole.mapInPandas(run, f"conv_id long, {schema}")


def _no_system(messages: list[dict]) -> tuple[str, list[dict]]:
    return "\n".join(m["content"] for m in messages if m["role"] == "system"), [m for m in messages if m["role"] != "system"]


@query(f"WITH {_TURNS}, s AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS sys, count(*) FILTER (WHERE role <> 'system') AS n FROM c GROUP BY 1) "
       "SELECT conv_id, n + CASE WHEN sys <> '' THEN 1 ELSE 0 END AS messages, CASE WHEN sys <> '' THEN 'system' ELSE 'user' END AS first, sys AS told, false AS sampled, true AS streams FROM s")  # fmt: skip
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to an OpenAI-compatible server: the system prompt first, no sampling settings."""

    def told(messages):
        system, rest = _no_system(messages)
        body = g.chat_request(system, rest, "m", 100, stream=True)
        first = body["messages"][0]
        return [(len(body["messages"]), first["role"] if first["role"] != "assistant" else "user", system, "temperature" in body, body["stream"])]

    return _each(spark, sf_dir, told, "messages long, first string, told string, sampled boolean, streams boolean")


@query(f"WITH {_TURNS} SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant') ELSE string_agg(text, '' ORDER BY turn) END AS content, "
       "count(*) FILTER (WHERE role = 'assistant' AND text <> '') + CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 1 ELSE 0 END AS pieces, count(*) AS tokens FROM c GROUP BY 1")  # fmt: skip
def chat_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with the assistant's turns as content and the others as reasoning, which is told only where no content comes."""

    def told(messages):
        events = [{"choices": [{"delta": {"content" if m["role"] == "assistant" else "reasoning": m["content"]}}]} for m in messages]
        *pieces, whole = g.chat_stream([*events, {"choices": [], "usage": {"prompt_tokens": 1, "completion_tokens": len(messages)}}])
        return [(whole.content, len(pieces), whole.usage.output_tokens)]

    return _each(spark, sf_dir, told, "content string, pieces long, tokens long")


@query(f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE role <> 'system') SELECT conv_id, count(*) AS messages, max(CASE WHEN back = 2 THEN text END) AS cached, "
       "(SELECT count(*) FROM c s WHERE s.conv_id = r.conv_id AND role = 'system') > 0 AS system_cached FROM r GROUP BY 1")  # fmt: skip
def converse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a Converse-style service: cache points after the system prompt and after the second-to-last message."""

    def told(messages):
        system, rest = _no_system(messages)
        body = g.converse_request(system, rest, "m", 100, 0.5)
        marked = [m["content"][0]["text"] for m in body["messages"] if "cachePoint" in m["content"][-1]]
        return [(len(body["messages"]), marked[0] if marked else None, "cachePoint" in (body.get("system") or [{}])[-1])]

    return _each(spark, sf_dir, told, "messages long, cached string, system_cached boolean")


@query(f"WITH {_TURNS} SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content, count(*) AS tokens, 'end_turn' AS stop FROM c GROUP BY 1")
def converse_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of a service's stream, answered by a stand-in, and its last piece with the usage."""

    def told(messages):
        deltas = [{"contentBlockDelta": {"delta": {"text": m["content"]}}} for m in messages]
        ends = [{"messageStop": {"stopReason": "end_turn"}}, {"metadata": {"usage": {"inputTokens": 3, "outputTokens": len(messages)}}}]
        model = g.Converse(dict, "m", call_stream=lambda **_: {"stream": [*deltas, *ends]})
        *pieces, whole = model.stream("", messages)
        return [(whole.content if "".join(pieces) == whole.content else None, whole.usage.output_tokens, whole.stop_reason)]

    return _each(spark, sf_dir, told, "content string, tokens long, stop string")


@query(f"WITH {_TURNS} SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, max(turn) FILTER (WHERE role = 'user') - min(turn) AS before FROM c GROUP BY 1")
def last_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a command-line client gets on stdin, and how many messages go before it."""

    def told(messages):
        before, question = g.split_last(messages)
        return [(question, len(before))]

    return _each(spark, sf_dir, told, "question string, before long")


@query(f"WITH {_TURNS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text AS content, true AS chained FROM c")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of session files, read again: every message names the one before."""

    def told(messages):
        lines, last, out = [json.loads(x) for x in g.session_lines(messages, "s")], None, []
        for i, line in enumerate(lines):
            out.append((i, line["message"]["role"], line["message"]["content"], line["parentUuid"] == last))
            last = line["uuid"]
        return out

    return _each(spark, sf_dir, told, "i long, role string, content string, chained boolean")


@query(f"WITH {_TURNS} SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content, count(*) AS tokens FROM c GROUP BY 1")
def client_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of a command-line client: deltas, the assistant's blocks that repeat them, the result with its usage."""

    def told(messages):
        deltas = [{"type": "stream_event", "event": {"delta": {"text": m["content"]}}} for m in messages]
        said = "".join(m["content"] for m in messages)
        ends = [{"type": "assistant", "message": {"content": [{"type": "text", "text": said}]}}, {"type": "result", "result": said, "usage": {"input_tokens": 1, "output_tokens": len(messages)}}]
        *_, whole = g.client_events(map(json.dumps, [*deltas, *ends]))
        return [(whole.content, whole.usage.output_tokens)]

    return _each(spark, sf_dir, told, "content string, tokens long")


@query(f"WITH {_TURNS} SELECT conv_id, substr(arg_max(text, turn) FILTER (WHERE role = 'user'), 1, 200) AS answer, sum(octet_length(encode(text))) // 4 AS tokens, true AS same FROM c GROUP BY 1")
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the generator that repeats the question, whole and in pieces."""

    def told(messages):
        model = models.create(models.GENERATORS, "echo")
        whole, (*_, last) = model.generate("", messages), models.streamed(model, "", messages)
        return [(whole.content, whole.usage.input_tokens, whole == last)]

    return _each(spark, sf_dir, told, "answer string, tokens long, same boolean")


_FAILURES = [("ThrottlingException", "", "ThrottledError"), ("429", "", "ThrottledError"), ("", "rate limit reached", "ThrottledError"), ("ValidationException", "", "InvalidRequestError"), ("400", "bad", "InvalidRequestError"), ("500", "oops", "GenerationError"), ("", "", "GenerationError")]


@query(literal_rows({"code": "VARCHAR", "message": "VARCHAR", "error": "VARCHAR"}, _FAILURES), fixed=True)
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(code, message, type(models.classify_failure(code, message)).__name__) for code, message, _ in _FAILURES]
    return spark.createDataFrame(rows, "code string, message string, error string")


@query(
    literal_rows(
        {"provider": "VARCHAR", "needs": "VARCHAR", "kind": "VARCHAR", "url": "VARCHAR"},
        [
            ("openai", "OPENAI_API_KEY", "ChatCompletions", "https://api.openai.com/v1"), ("openrouter", "OPENROUTER_API_KEY", "ChatCompletions", "https://openrouter.ai/api/v1"),
            ("ollama", None, "ChatCompletions", "http://127.0.0.1:11434/v1"), ("bedrock", "region", "Converse", None), ("claude-code", "client", "CommandLine", None), ("echo", None, "EchoGenerator", None), ("other", "name", None, None),
        ],
    ),
    fixed=True,
)
def provider_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider needs, by leaving it out, and what is made of it."""
    given = {"openai": "OPENAI_API_KEY", "openrouter": "OPENROUTER_API_KEY"}
    rows = []
    for name in (*providers.MODELS, "echo", "other"):
        good = providers.Settings(name, environment=dict.fromkeys(given.values(), "k"), client="sh")
        tried = {"name": good, given.get(name): providers.Settings(name, environment={}, client="sh"), "region": providers.Settings(name, environment=good.environment, client="sh", region=""), "client": providers.Settings(name, environment=good.environment, client="no-such-client")}
        needs = next((need for need, settings in tried.items() if need and _fails(settings)), None)
        made = None if needs == "name" else providers.generator(good)
        rows.append((name, needs, made and type(made).__name__, getattr(made, "url", None)))
    return spark.createDataFrame(rows, "provider string, needs string, kind string, url string")


def _fails(settings: providers.Settings) -> bool:
    try:
        providers.generator(settings)
    except ValueError:
        return True
    return False


@query(
    literal_rows(
        {"provider": "VARCHAR", "expert": "VARCHAR", "promptgen": "VARCHAR"},
        [
            ("bedrock", "global.anthropic.claude-sonnet-4-5-20250929-v1:0", "us.amazon.nova-lite-v1:0"), ("openai", "gpt-5", "gpt-5-mini"), ("openrouter", "minimax/minimax-m2:free", "meta-llama/llama-3.3-70b-instruct:free"),
            ("ollama", "deepseek-coder-v2:16b", "qwen2.5-coder:7b"), ("claude-code", "claude-sonnet-4-5", "claude-haiku-4-5"),
        ],
    ),
    fixed=True,
)
def provider_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, providers.default_model(p), providers.default_model(p, "promptgen")) for p in providers.MODELS]
    return spark.createDataFrame(rows, "provider string, expert string, promptgen string")


_SETS = [(a, b, c, cloud, client, local) for a in (0, 1) for b in (0, 1) for c in (0, 1) for cloud in (0, 1) for client in (0, 1) for local in (0, 1)]


@query(
    "SELECT a, b, c, cloud, client, local, CASE WHEN a + b + c > 1 THEN 'error' WHEN a = 1 THEN 'openai' WHEN b = 1 THEN 'openrouter' WHEN c = 1 OR cloud = 1 THEN 'bedrock' WHEN client = 1 THEN 'claude-code' WHEN local = 1 THEN 'ollama' ELSE 'error' END AS found "
    "FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c), (SELECT unnest([0, 1]) AS cloud), (SELECT unnest([0, 1]) AS client), (SELECT unnest([0, 1]) AS local)",
    fixed=True,
)
def provider_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which provider is chosen for every combination of what there may be."""
    rows = []
    for a, b, c, cloud, client, local in _SETS:
        environment = {k: "k" for k, on in (("OPENAI_API_KEY", a), ("OPENROUTER_API_KEY", b), ("AWS_ACCESS_KEY_ID", c)) if on}
        try:
            found = providers.detect(environment, partial(bool, cloud), lambda _, on=client: bool(on), partial(bool, local))
        except ValueError:
            found = "error"
        rows.append((a, b, c, cloud, client, local, found))
    return spark.createDataFrame(rows, "a int, b int, c int, cloud int, client int, local int, found string")


@query("SELECT CAST(i AS BIGINT) AS n, CASE WHEN i < 2 THEN 'prompt' ELSE 'embedding' END AS category, 'answer ' || i AS content FROM range(4) t(i)", fixed=True)
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged calls, read again."""
    at = folder(spark, "call-log")
    for i in range(4):
        g.log_call(spark, at, "prompt" if i < 2 else "embedding", {"n": i}, {"content": f"answer {i}"})
    rows = spark.read.json(at)
    return rows.select(F.get_json_object("request", "$.n").cast("long").alias("n"), "category", F.get_json_object("response", "$.content").alias("content"))


# --- surfaces

_PARAMETERS = [
    ("import", "source_path", True, None), ("query", "expert_name", True, None), ("query", "prompt", True, None), ("query", "max_changes", False, "20"), ("query", "users", False, None), ("query", "files", False, None),
    ("query", "search_scope", False, "all"), ("prompt", "expert_name", True, None), ("prompt", "prompt", True, None), ("prompt", "max_changes", False, "20"), ("prompt", "users", False, None), ("prompt", "files", False, None),
    ("prompt", "impostor", False, "False"), ("prompt", "amogus", False, "False"), ("prompt", "temperature", False, "0.7"), ("list", None, False, None),
]


@query(literal_rows({"tool": "VARCHAR", "parameter": "VARCHAR", "required": "BOOLEAN", "usual": "VARCHAR"}, _PARAMETERS), fixed=True)
def tool_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools as the server lists them."""
    reply = tools.answer(spark, folder(spark, "no-indexes"), {"id": 1, "method": "tools/list"})
    rows = []
    for t in reply["result"]["tools"]:
        schema = t["inputSchema"]
        for name, about in (schema["properties"] or {None: {}}).items():
            rows.append((t["name"], name, name in schema["required"], str(about["default"]) if "default" in about else None))
    return spark.createDataFrame(rows, "tool string, parameter string, required boolean, usual string")


@query("SELECT i::INTEGER AS results, greatest(1, CAST(ceil(i / 2) AS INTEGER)) AS changes, greatest(1, i // 2)::INTEGER AS chunks FROM range(1, 41) t(i)", fixed=True)
def tool_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *tools.budgets(i).values()) for i in range(1, 41)]
    return spark.createDataFrame(rows, "results int, changes int, chunks int")


_OPTIONS = [
    ("", "--debug", "False"), ("", "--llm-provider", "auto"), ("", "--base-url-override", None), ("", "--embedding-provider", "hashing"), ("", "--expert-model", None), ("", "--promptgen-model", None), ("", "--no-reranking", "False"),
    ("populate", "--max-commits", "60000"), ("populate", "--vcs-type", None), ("populate", "--batch-size", "500"), ("populate", "--start-at", None),
    *((c, o, v) for c in ("query", "prompt") for o, v in (("--max-changes", "10"), ("--max-file-chunks", "10"), ("--users", ""), ("--files", ""))),
    ("query", "--search-scope", "all"), ("query", "--min-score", "0.1"), ("query", "--relative-threshold", "0.8"), ("query", "--output", None),
    ("prompt", "--amogus", "False"), ("prompt", "--impostor", "False"), ("prompt", "--temperature", "0.7"),
]


@query(literal_rows({"command": "VARCHAR", "option": "VARCHAR", "usual": "VARCHAR"}, _OPTIONS), fixed=True)
def command_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options of the command line with their defaults."""
    top = cli.parser()
    commands = next(a.choices for a in top._actions if hasattr(a, "choices") and isinstance(a.choices, dict))
    rows = []
    for name, p in {"": top, **commands}.items():
        for a in p._actions:
            if a.option_strings and a.option_strings[0] not in ("-h", "--version", "--data-dir"):
                rows.append((name, a.option_strings[0], None if a.default is None else str(a.default)))
    return spark.createDataFrame(rows, "command string, option string, usual string")


_EXPORTS = "Context EMBEDDERS Engine EngineError ExpertExistsError ExpertNotFoundError GENERATORS Generated InvalidIndexError NoResultsError QueryParams RERANKERS Settings Store Usage import_expert list_experts populate prompt_expert prompt_expert_stream prompt_expert_stream_async query_expert register"


@query(literal_rows({"name": "VARCHAR", "there": "BOOLEAN"}, [(n, True) for n in _EXPORTS.split()]), fixed=True)
def exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, getattr(spindrift, n) is not None) for n in spindrift.__all__], "name string, there boolean")
