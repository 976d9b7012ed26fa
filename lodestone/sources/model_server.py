"""Client of a local model server with a plain JSON-over-HTTP interface."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from urllib import error, request

from lodestone.config import ModelServerConfig
from lodestone.errors import EmbeddingError, GenerationError, HTTPStatusError, NetworkError, SerializationError


def call(url: str, body: dict | None, timeout: float) -> dict:
    """POST body as JSON, or GET without one; the decoded answer."""
    try:
        data = None if body is None else json.dumps(body).encode()
    except (TypeError, ValueError) as e:
        raise SerializationError(str(e)) from e
    try:
        with request.urlopen(request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return json.loads(answer.read() or b"{}")
    except error.HTTPError as e:
        raise HTTPStatusError(f"HTTP {e.code}") from e
    except (error.URLError, OSError) as e:
        raise NetworkError(str(e)) from e
    except ValueError as e:
        raise SerializationError(str(e)) from e


def _available(config: ModelServerConfig) -> bool:
    try:
        call(f"{config.base_url}/api/tags", None, config.timeout_seconds)
    except (NetworkError, SerializationError):
        return False
    return True


@dataclass(frozen=True)
class ChatClient:
    """A LanguageModel; picklable, so executors can hold it."""

    config: ModelServerConfig = field(default_factory=ModelServerConfig)

    def complete(self, prompt: str, temperature: float | None = None, max_tokens: int | None = None) -> str:
        c = self.config
        options = {"temperature": c.temperature if temperature is None else temperature, "num_predict": max_tokens or c.max_tokens}
        if c.num_ctx is not None:
            options["num_ctx"] = c.num_ctx
        body = {"model": c.chat_model, "prompt": prompt, "stream": False, "options": options}
        if c.keep_alive is not None:
            body["keep_alive"] = c.keep_alive
        answer = call(f"{c.base_url}/api/generate", body, c.timeout_seconds).get("response")
        if not isinstance(answer, str):
            raise GenerationError("the answer holds no text")
        return answer

    def is_available(self) -> bool:
        return _available(self.config)


@dataclass(frozen=True)
class EmbeddingClient:
    """An EmbeddingModel."""

    config: ModelServerConfig = field(default_factory=ModelServerConfig)

    @property
    def dimension(self) -> int:
        return self.config.embedding_dimension

    def embed(self, text: str) -> list[float]:
        c = self.config
        vector = call(f"{c.base_url}/api/embeddings", {"model": c.embedding_model, "prompt": text}, c.timeout_seconds).get("embedding")
        if not isinstance(vector, list) or not vector:
            raise EmbeddingError("the answer holds no vector")
        return [float(x) for x in vector]

    def is_available(self) -> bool:
        return _available(self.config)
