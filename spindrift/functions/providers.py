"""Named services: which one to use, what it needs, which models it takes by default; and embedders behind services.

Nothing here opens a connection before a model is used.
"""

from __future__ import annotations

import importlib.util
import json
import os
import shutil
import tempfile
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial

from spindrift.functions.generators import ChatCompletions, CommandLine, Converse
from spindrift.functions.models import EMBEDDERS, GENERATORS, TextGenerator, Truncated, classify_failure, create

# Names, environment variables, addresses and default models of the services.
KEYS = {"openai": "OPENAI_API_KEY", "openrouter": "OPENROUTER_API_KEY"}
URLS = {"openai": "https://api.openai.com/v1", "openrouter": "https://openrouter.ai/api/v1", "ollama": "http://127.0.0.1:11434/v1"}
CLOUD_VARIABLES = ("AWS_ACCESS_KEY_ID", "AWS_PROFILE")
DEFAULT_REGION = "us-west-2"
CLIENT = "claude"
MODELS = {
    "bedrock": {"expert": "global.anthropic.claude-sonnet-4-5-20250929-v1:0", "promptgen": "us.amazon.nova-lite-v1:0"},
    "openai": {"expert": "gpt-5", "promptgen": "gpt-5-mini"},
    "openrouter": {"expert": "minimax/minimax-m2:free", "promptgen": "meta-llama/llama-3.3-70b-instruct:free"},
    "ollama": {"expert": "deepseek-coder-v2:16b", "promptgen": "qwen2.5-coder:7b"},
    "claude-code": {"expert": "claude-sonnet-4-5", "promptgen": "claude-haiku-4-5"},
}
HOSTED_EMBEDDER, HOSTED_DIMENSION = "amazon.titan-embed-text-v2:0", 1024
LOCAL_EMBEDDER, LOCAL_DIMENSION = "jinaai/jina-code-embeddings-0.5b", 512
TASK_PREFIX = "Represent this code for retrieving similar code: "
# End of the fixed values.

NAMES = ("auto", *MODELS)


def default_model(provider: str, role: str = "expert", chosen: str | None = None) -> str:
    """``chosen``, else the provider's default for the role (expert, promptgen); KeyError for an unknown provider."""
    if chosen:
        return chosen
    if not provider:
        raise ValueError("no provider is configured")
    return MODELS[provider][role]


def cloud_credentials() -> bool:
    """Whether the cloud's own library is here and finds credentials."""
    if importlib.util.find_spec("boto3") is None:
        return False
    import boto3

    try:
        return boto3.Session().get_credentials() is not None
    except Exception:  # whatever a broken profile raises
        return False


def server_runs(url: str = URLS["ollama"], timeout: float = 2.0) -> bool:
    """Whether a local server answers."""
    try:
        with urllib.request.urlopen(url.removesuffix("/v1"), timeout=timeout) as reply:
            return reply.status == 200 and b"running" in reply.read()
    except OSError:
        return False


def detect(
    environment: Mapping[str, str] | None = None, cloud: Callable[[], bool] = cloud_credentials, on_path: Callable[[str], object] = shutil.which, local: Callable[[], bool] = server_runs
) -> str:
    """The provider to use: the only one whose variables are set (several are an error), else the first of cloud credentials, a client on the path, a local server."""
    environment = os.environ if environment is None else environment
    named = ["bedrock"] if any(environment.get(v) for v in CLOUD_VARIABLES) else []
    named += [name for name, key in reversed(KEYS.items()) if environment.get(key)]
    if len(named) > 1:
        raise ValueError(f"several providers have keys: {', '.join(named)}; choose one")
    if named:
        return named[0]
    for name, there in (("bedrock", cloud), ("claude-code", partial(on_path, CLIENT)), ("ollama", local)):
        if there():
            return name
    raise ValueError("no text generator is configured")


@dataclass(frozen=True)
class Settings:
    """What a generator is made from."""

    provider: str = "auto"
    model: str | None = None
    prompt_model: str | None = None
    base_url: str | None = None
    most_tokens: int = 4096
    temperature: float = 0.7
    region: str = DEFAULT_REGION
    client: str = CLIENT
    environment: Mapping[str, str] = field(default_factory=lambda: dict(os.environ))


def _cloud_call(region: str, name: str, **request: object):
    import boto3

    return getattr(boto3.client("bedrock-runtime", region_name=region), name)(**request)


def generator(settings: Settings, role: str = "expert") -> TextGenerator:
    """The provider's generator; ValueError where it is unknown or lacks what it needs. Registered generators go by their names."""
    name = detect(settings.environment) if settings.provider == "auto" else settings.provider
    if name in GENERATORS:
        return create(GENERATORS, name)
    if name not in MODELS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted({*NAMES, *GENERATORS}))}")
    model = default_model(name, role, settings.model if role == "expert" else settings.prompt_model)
    if name in URLS:
        key = settings.environment.get(KEYS[name], "") if name in KEYS else name
        if not key:
            raise ValueError(f"{name} needs {KEYS[name]}")
        return ChatCompletions(settings.base_url or URLS[name], model, key, settings.most_tokens)
    if name == "bedrock":
        if not settings.region:
            raise ValueError("bedrock needs a region")
        call = partial(_cloud_call, settings.region)
        return Converse(partial(call, "converse"), model, settings.most_tokens, settings.temperature, partial(call, "converse_stream"))
    if not shutil.which(settings.client):
        raise ValueError(f"{settings.client} isn't on the path")
    command = (settings.client, "--print", "--output-format", "stream-json", "--verbose", "--model", model, "--system-prompt", "{system}", "--resume", "{session}")
    return CommandLine(command, os.path.join(tempfile.gettempdir(), "spindrift-sessions"))


@dataclass
class HostedEmbedder:
    """An embedder behind a service: one request a text. ``call`` takes the request's fields and returns the reply."""

    call: Callable[..., dict] | None = None
    model: str = HOSTED_EMBEDDER
    dimension: int = HOSTED_DIMENSION
    region: str = DEFAULT_REGION

    def _vector(self, text: str) -> list[float]:
        call = self.call or partial(_cloud_call, self.region, "invoke_model")
        try:
            body = call(modelId=self.model, body=json.dumps({"inputText": text}))["body"]
        except Exception as e:
            raise classify_failure(type(e).__name__, str(e)) from e
        return json.loads(body.read() if hasattr(body, "read") else body)["embedding"]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]


@dataclass
class LocalEmbedder:
    """A sentence model from files on this machine, if its library is installed; it is loaded when first used."""

    model: str = LOCAL_EMBEDDER
    dimension: int = 896

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if not hasattr(self, "_loaded"):
            if importlib.util.find_spec("sentence_transformers") is None:
                raise ValueError("the local embedder needs the library sentence_transformers")
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model, trust_remote_code=True)
        return [list(map(float, v)) for v in self._loaded.encode(texts)]


EMBEDDERS.setdefault("bedrock", HostedEmbedder)
#: Documents and queries get one task prefix; vectors are cut to their first components.
EMBEDDERS.setdefault("local", lambda: Truncated(LocalEmbedder(), LOCAL_DIMENSION, TASK_PREFIX))
