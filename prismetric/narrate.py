"""A short reading of a profile by a chat model behind an HTTP service."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .model import TableProfile
from .render.reports import report_to_dict
from .voices import Persona, resolve

# Defaults, and prices in dollars for a thousand tokens read and written.
TIMEOUT, MOST_BYTES, TEMPERATURE = 30.0, 24_000, 0.6
PRICES = {"gpt-4o-mini": (0.00015, 0.0006), "gpt-4o": (0.0025, 0.01), "gpt-4.1-mini": (0.0004, 0.0016), "gpt-4.1": (0.002, 0.008)}
BASE_URL, KEY, MODEL = "PRISMETRIC_LLM_BASE_URL", "PRISMETRIC_LLM_API_KEY", "PRISMETRIC_LLM_MODEL"


class LLMUnavailableError(RuntimeError):
    """No service is set, or it gave nothing of use."""


@dataclass(frozen=True)
class LLMConfig:
    base_url: str
    api_key: str | None
    model: str
    timeout: float = TIMEOUT

    @property
    def endpoint(self) -> str:
        base, end = self.base_url.rstrip("/"), "/chat/completions"
        return base if base.endswith(end) else base + end


@dataclass(frozen=True)
class LLMResult:
    text: str
    model: str
    prompt_tokens: int | None
    completion_tokens: int | None
    total_tokens: int | None
    cost_usd: float | None
    elapsed_seconds: float


def load_config(env: dict[str, str] | None = None, *, timeout: float | None = None, base_url: str | None = None, model: str | None = None) -> LLMConfig:
    """From the environment; address and model may come from a settings file instead, the key never."""
    env = os.environ if env is None else env
    found = {name: env.get(name, "").strip() or (other or "").strip() for name, other in ((BASE_URL, base_url), (MODEL, model))}
    for name, value in found.items():
        if not value:
            raise LLMUnavailableError(f"{name} is not set.")
    return LLMConfig(found[BASE_URL], env.get(KEY, "").strip() or None, found[MODEL], TIMEOUT if timeout is None else timeout)


def shortened(report: TableProfile) -> str:
    """The profile as JSON within the bound: fewer frequent values, then none, then cut."""
    data = report_to_dict(report)
    for keep in (None, 3, 0):
        if keep is not None:
            for c in data["columns"]:
                c["top"] = c["top"][:keep]
        if len(text := json.dumps(data, default=str)) <= MOST_BYTES:
            return text
    return text[:MOST_BYTES]


def messages(report: TableProfile, persona: Persona | None = None) -> list[dict[str, str]]:
    return [{"role": "system", "content": (persona or resolve(None)).prompt}, {"role": "user", "content": f"The profile:\n{shortened(report)}"}]


def cost(model: str, read: int | None, written: int | None) -> float | None:
    rates = PRICES.get(model) or next((r for name, r in PRICES.items() if model.startswith(name)), None)
    return round(read / 1000 * rates[0] + written / 1000 * rates[1], 6) if rates and read is not None and written is not None else None


def post(config: LLMConfig, body: dict[str, Any]) -> dict[str, Any]:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {config.api_key}"} if config.api_key else {})
    request = urllib.request.Request(config.endpoint, json.dumps(body).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=config.timeout) as answer:  # noqa: S310
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise LLMUnavailableError(f"Provider returned HTTP {e.code}: {e.read().decode(errors='replace')[:500] or e.reason}") from e
    except TimeoutError as e:
        raise LLMUnavailableError(f"Provider timed out after {config.timeout:.0f}s.") from e
    except urllib.error.URLError as e:
        raise LLMUnavailableError(f"Could not reach provider: {e.reason}") from e
    except ValueError as e:
        raise LLMUnavailableError("Provider returned non-JSON response.") from e


def read(report: TableProfile, config: LLMConfig, persona: Persona | None = None, send: Callable[[LLMConfig, dict[str, Any]], dict[str, Any]] = post) -> LLMResult:
    began = time.monotonic()
    answer = send(config, {"model": config.model, "messages": messages(report, persona), "temperature": TEMPERATURE, "stream": False})
    took = time.monotonic() - began
    try:
        content = answer["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError) as e:
        raise LLMUnavailableError("Provider response had no choices.") from e
    if isinstance(content, list):
        content = "".join(p.get("text", "") for p in content if isinstance(p, dict))
    if not isinstance(content, str) or not content.strip():
        raise LLMUnavailableError("Provider returned an empty completion.")
    used = answer.get("usage") or {}
    counts = [used.get(f"{k}_tokens") for k in ("prompt", "completion", "total")]
    return LLMResult(content.strip(), config.model, *counts, cost(config.model, *counts[:2]), took)
