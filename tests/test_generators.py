from __future__ import annotations

import json
import sys
from datetime import UTC, datetime

import pytest

from spindrift.functions import generators as g
from spindrift.functions import models, providers
from spindrift.functions.models import EchoGenerator, Generated, GenerationError, InvalidRequestError, ThrottledError, Usage, classify_failure

SAID = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}]


def test_chat():
    body = g.chat_request("sys", SAID, "m", 10, stream=True)
    assert [m["role"] for m in body["messages"]] == ["system", "user", "assistant", "user"] and "temperature" not in body and body["stream"]
    reply = {"choices": [{"message": {"content": "", "reasoning_content": "why"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 1}}, "model": "m"}
    assert g.chat_answer(reply) == Generated("why", Usage(3, 2, 1), "m", "stop")
    with pytest.raises(GenerationError):
        g.chat_answer({"choices": [{"message": {}}]})


def test_chat_stream():
    delta = lambda **d: {"choices": [{"delta": d}]}
    got = list(g.chat_stream([delta(reasoning_content="hm"), delta(content="x"), delta(content="y"), {"choices": [], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}]))
    assert got[:2] == ["x", "y"] and got[2].content == "xy" and got[2].usage == Usage(1, 2)
    assert list(g.chat_stream([delta(reasoning="only")]))[0] == "only"
    with pytest.raises(GenerationError):
        list(g.chat_stream([]))
    assert list(g.server_events([b'data: {"a": 1}\n', b"\n", b": note\n", b"data: [DONE]\n"])) == [{"a": 1}]


def test_converse():
    body = g.converse_request("sys", SAID, "m", 5, 0.5)
    assert "cachePoint" in body["messages"][1]["content"][-1] and len(body["messages"][2]["content"]) == 1 and "cachePoint" in body["system"][1]
    assert g.converse_request("", SAID[:1], "m", 5, 0.5)["messages"] == [{"role": "user", "content": [{"text": "a"}]}]
    *pieces, whole = g.converse_stream([{"contentBlockDelta": {"delta": {"text": "h"}}}, {"contentBlockDelta": {"delta": {"text": "i"}}}, {"messageStop": {"stopReason": "end"}}, {"metadata": {"usage": {"inputTokens": 4, "outputTokens": 1, "cacheReadInputTokens": 2}}}])
    assert pieces == ["h", "i"] and whole == Generated("hi", Usage(4, 1, 2), "", "end")
    model = g.Converse(lambda **k: {"output": {"message": {"content": [{"text": "ok"}]}}, "stopReason": "end"}, "m")
    assert model.generate("s", SAID).content == "ok"

    def fail(**_):
        raise RuntimeError("ThrottlingException: slow down")

    with pytest.raises(ThrottledError):
        g.Converse(fail, "m").generate("s", SAID)
    assert isinstance(classify_failure("400", "bad"), InvalidRequestError)


def test_command_line(tmp_path):
    before, question = g.split_last(SAID)
    assert (len(before), question) == (2, "c")
    with pytest.raises(GenerationError):
        g.split_last([])
    lines = [json.loads(x) for x in g.session_lines(before, "s", datetime(2024, 1, 1, tzinfo=UTC))]
    assert lines[0]["parentUuid"] is None and lines[1]["parentUuid"] == lines[0]["uuid"] and lines[0]["timestamp"] < lines[1]["timestamp"]
    events = [{"type": "stream_event", "event": {"delta": {"text": "a"}}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}]}}, {"type": "result", "result": "a", "usage": {"input_tokens": 2, "output_tokens": 1}}]
    assert list(g.client_events(map(json.dumps, events))) == ["a", Generated("a", Usage(2, 1))]
    with pytest.raises(GenerationError):
        list(g.client_events([json.dumps({"type": "result", "is_error": True, "result": "no"})]))
    script = "import sys, json; q = sys.stdin.read(); print(json.dumps({'type': 'result', 'result': q.upper()}))"
    assert g.CommandLine((sys.executable, "-c", script), str(tmp_path)).generate("x\ny", SAID).content == "C"
    with pytest.raises(GenerationError):
        g.CommandLine((sys.executable, "-c", "import sys; sys.exit(3)"), str(tmp_path)).generate("", SAID)


def test_log(spark, tmp_path):
    for i in range(2):
        g.log_call(spark, str(tmp_path / "log"), "prompt", {"n": i}, {"ok": True})
    assert spark.read.json(str(tmp_path / "log")).where("category = 'prompt'").count() == 2


def test_streams(tmp_path):
    """Pieces come before the client has ended; a failing client's message is the error's."""
    script = "import sys, json\nsys.stdin.read()\nfor w in 'ab': print(json.dumps({'type': 'stream_event', 'event': {'delta': {'text': w}}}), flush=True)\nprint(json.dumps({'type': 'result', 'result': 'ab', 'usage': {'input_tokens': 1, 'output_tokens': 2}}))"
    assert list(g.CommandLine((sys.executable, "-c", script), str(tmp_path)).stream("", SAID)) == ["a", "b", Generated("ab", Usage(1, 2))]
    with pytest.raises(ThrottledError):
        list(g.CommandLine((sys.executable, "-c", "import sys; sys.exit('429 too many requests')"), str(tmp_path)).stream("", SAID))
    assert not list(tmp_path.iterdir())
    events = {"stream": [{"contentBlockDelta": {"delta": {"text": "h"}}}, {"metadata": {"usage": {"inputTokens": 4, "outputTokens": 1}}}]}
    told = list(g.Converse(dict, "m", call_stream=lambda **_: events).stream("s", SAID))
    assert told == ["h", Generated("h", Usage(4, 1))]
    assert list(models.streamed(EchoGenerator(), "", SAID))[-1].content == "c"
    whole = type("Whole", (), {"generate": lambda self, system, messages: Generated("all")})()
    assert list(models.streamed(whole, "", SAID)) == ["all", Generated("all")]


def test_providers(monkeypatch):
    no = lambda *_: False
    assert providers.detect({"OPENAI_API_KEY": "k"}, no, no, no) == "openai" and providers.detect({"AWS_PROFILE": "p"}, no, no, no) == "bedrock"
    assert providers.detect({}, lambda: True, no, lambda: True) == "bedrock" and providers.detect({}, no, lambda _: "/bin/x", no) == "claude-code" and providers.detect({}, no, no, lambda: True) == "ollama"
    for bad in ({"OPENAI_API_KEY": "k", "OPENROUTER_API_KEY": "k"}, {}):
        with pytest.raises(ValueError):
            providers.detect(bad, no, no, no)
    env = {"OPENROUTER_API_KEY": "k"}
    made = providers.generator(providers.Settings("openrouter", environment=env))
    assert (made.url, made.model, made.key) == (providers.URLS["openrouter"], providers.MODELS["openrouter"]["expert"], "k")
    assert providers.generator(providers.Settings("ollama", base_url="http://here", prompt_model="m"), "promptgen").model == "m"
    assert providers.generator(providers.Settings("echo")) == EchoGenerator()
    for bad in (providers.Settings("openai", environment={}), providers.Settings("none"), providers.Settings("claude-code", client="no-such-client"), providers.Settings("bedrock", region="")):
        with pytest.raises(ValueError):
            providers.generator(bad)
    assert providers.default_model("openai", chosen="x") == "x"
    with pytest.raises(KeyError):
        providers.default_model("none")


def test_embedders():
    asked = []

    def call(**request):
        asked.append(request)
        return {"body": json.dumps({"embedding": [len(json.loads(request["body"])["inputText"]), 2.0]})}

    assert providers.HostedEmbedder(call).embed_batch(["ab", "c"]) == [[2, 2.0], [1, 2.0]] and asked[0]["modelId"] == providers.HOSTED_EMBEDDER
    with pytest.raises(GenerationError):
        providers.HostedEmbedder(lambda **_: 1 / 0).embed_batch(["x"])
    assert models.create(models.EMBEDDERS, "local").dimension == 512 and models.create(models.EMBEDDERS, "bedrock").dimension == 1024
    with pytest.raises(ValueError):
        models.create(models.EMBEDDERS, "local").embed_batch(["x"])


def test_calls_are_logged(spark, tmp_path):
    logged = g.Logged(EchoGenerator(), spark, str(tmp_path / "log"))
    assert logged.generate("s", SAID).content == "c" and list(logged.stream("s", SAID))[-1].content == "c"
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and all(json.loads(r.response)["content"] == "c" for r in rows)
