"""A chat model behind an HTTP endpoint, as the agent's loop wants one."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

# fixed values: the code of a request that went well
WELL = "20000"


class ChatError(RuntimeError):
    """What the endpoint answered instead of a message; ``Retrying`` tries again."""


@dataclass
class HttpChat:
    """A client of ``url`` with a key.

    ``thinking`` is sent to models that reason before they call tools and have to be told not to; ``limit_name`` is
    what a model calls the bound on its tokens, which is sent only without tools.
    """

    url: str
    key: str
    temperature: float = 0.3
    top_p: float = 0.8
    max_tokens: int | None = None
    timeout: float = 60.0
    thinking: dict | None = None
    limit_name: str = "maxTokens"
    tool_choice: str | dict | None = None

    def payload(self, messages: list[dict], tools: list[dict]) -> dict:
        out: dict = {"messages": [_sent(m) for m in messages], "topP": self.top_p, "temperature": self.temperature}
        if self.thinking is not None:
            out["thinking"] = self.thinking
        if tools:
            out["tools"] = [{"type": "function", "function": tool} for tool in tools]
            if self.tool_choice is not None:
                out["toolChoice"] = self.tool_choice
        elif self.max_tokens is not None:
            out[self.limit_name] = self.max_tokens
        return out

    def chat(self, messages: list[dict], tools: list[dict]) -> dict:
        head = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        request = urllib.request.Request(self.url, json.dumps(self.payload(messages, tools)).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            body = json.load(answer)
        if body.get("status", {}).get("code") != WELL:
            raise ChatError(str(body.get("status")))
        return received(body["result"]["message"])


def _sent(message: dict) -> dict:
    """A message of the loop as the endpoint wants it."""
    out = {k: v for k, v in message.items() if k in ("role", "content")}
    if message.get("calls"):
        out["toolCalls"] = [{"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": c["arguments"]}} for c in message["calls"]]
    if "tool_call_id" in message:
        out["toolCallId"] = message["tool_call_id"]
    return out


def received(message: dict) -> dict:
    """The endpoint's message as the loop wants it; arguments may come as an object or as its JSON."""
    calls = []
    for call in message.get("toolCalls") or []:
        arguments = call["function"]["arguments"]
        calls.append({"id": call["id"], "name": call["function"]["name"], "arguments": json.loads(arguments) if isinstance(arguments, str) else arguments})
    return {"text": message.get("content") or None, **({"calls": calls} if calls else {})}
