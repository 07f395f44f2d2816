"""The profile as a tool for other programs: JSON-RPC over standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path
from typing import IO, Any

from pyspark.sql import SparkSession

from . import narrate, voices
from .model import BANDS
from .operators.profile import profile
from .render.reports import report_to_dict
from .session import session
from .sources.errors import ExcelReaderError, RemoteAccessError, SQLiteTableError, UnsupportedFormatError
from .sources.load import load

# The protocol and its error codes.
PROTOCOL = "2025-06-18"
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
SERVER = {"name": "prismetric", "version": "0.1"}
PATH = {"path": {"type": "string", "description": "The data file."}, "table": {"type": "string", "description": "The table of an SQLite file."}, "sample": {"type": "integer", "minimum": 1, "description": "Profile only the first rows."}}


def _schema(more: dict[str, Any]) -> dict[str, Any]:
    return {"type": "object", "properties": PATH | more, "required": ["path"], "additionalProperties": False}


TOOLS = [
    {"name": "summon", "description": "Profile a data file: schema, statistics, personal data and anomalies as JSON.", "inputSchema": _schema({"fail_on_pii": {"type": "string", "enum": list(BANDS), "description": "Tell of a finding of this band or above."}})},
    {"name": "read", "description": "Profile a data file and have a chat model write a short reading of it.", "inputSchema": _schema({"persona": {"type": "string"}, "timeout": {"type": "number", "minimum": 1}})},
]


class ToolError(ValueError):
    """Told to the caller as the tool's result."""


def _args(args: dict[str, Any], **kinds: tuple[type | tuple[type, ...], Callable[[Any], bool], str]) -> None:
    for name, (kind, fits, said) in kinds.items():
        value = args.get(name)
        if value is not None and (not isinstance(value, kind) or isinstance(value, bool) or not fits(value)):
            raise ToolError(f"'{name}' must be {said}.")


def _profiled(spark: SparkSession, args: dict[str, Any]):
    _args(args, path=(str, bool, "a non-empty string"), table=(str, lambda v: True, "a string when provided"), sample=(int, lambda v: v >= 1, "a positive integer when provided"))
    if not args.get("path"):
        raise ToolError("'path' is required and must be a non-empty string.")
    path = Path(args["path"])
    if not path.exists():
        raise ToolError(f"File not found: {path}")
    try:
        return profile(load(spark, path, table=args.get("table")), path=path, sample=args.get("sample"))
    except (UnsupportedFormatError, SQLiteTableError, ExcelReaderError, RemoteAccessError) as e:
        raise ToolError(str(e)) from e


def tool_summon(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    _args(args, fail_on_pii=(str, BANDS.__contains__, f"one of {sorted(BANDS)}"))
    report = _profiled(spark, args)
    out: dict[str, Any] = {"profile": report_to_dict(report)}
    worst = report.most_personal() if any(report.personal()) else None
    level = args.get("fail_on_pii")
    if level and worst and worst[0] >= BANDS[level]:
        out["pii_breach"] = {"threshold": level, "confidence": worst[0], "kind": worst[1], "column": worst[2]}
    return out


def tool_read(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    _args(args, timeout=((int, float), lambda v: v >= 1, "a number >= 1.0 when provided"), persona=(str, lambda v: True, "a string when provided"))
    try:
        persona = voices.resolve(args.get("persona"))
        report = _profiled(spark, args)
        result = narrate.read(report, narrate.load_config(timeout=args.get("timeout")), persona)
    except voices.UnknownPersonaError as e:
        raise ToolError(str(e)) from e
    except narrate.LLMUnavailableError as e:
        raise ToolError(f"LLM unavailable: {e}") from e
    return {"profile": report_to_dict(report), "reading": {**asdict(result), "persona": persona.id}}


HANDLERS = {"summon": tool_summon, "read": tool_read}


def _failed(number: Any, code: int, said: str) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": said}}


def handle(request: Any, spark: Callable[[], SparkSession] = session) -> dict[str, Any] | None:
    """The answer to one request; None for a notification."""
    if not isinstance(request, dict):
        return _failed(None, INVALID, "Request must be a JSON object.")
    if "id" not in request:
        return None
    number, method, params = request["id"], request.get("method"), request.get("params") or {}
    done = lambda result: {"jsonrpc": "2.0", "id": number, "result": result}
    if not isinstance(method, str):
        return _failed(number, INVALID, "Missing method.")
    if not isinstance(params, dict):
        return _failed(number, BAD_PARAMS, "params must be an object.")
    if method == "initialize":
        wanted = params.get("protocolVersion")
        return done({"protocolVersion": wanted if isinstance(wanted, str) else PROTOCOL, "serverInfo": SERVER, "capabilities": {"tools": {"listChanged": False}}})
    if method == "ping":
        return done({})
    if method == "tools/list":
        return done({"tools": TOOLS})
    if method != "tools/call":
        return _failed(number, NO_METHOD, f"Unknown method: {method}")
    name, args = params.get("name"), params.get("arguments") or {}
    if not isinstance(name, str) or not isinstance(args, dict):
        return _failed(number, BAD_PARAMS, "'name' must be a string and 'arguments' an object.")
    if name not in HANDLERS:
        return _failed(number, NO_METHOD, f"Unknown tool: {name}")
    try:
        payload, bad = HANDLERS[name](spark(), args), False
    except ToolError as e:
        payload, bad = {"error": str(e)}, True
    except Exception as e:  # the loop goes on
        return _failed(number, INTERNAL, f"Tool crashed: {e}")
    return done({"content": [{"type": "text", "text": json.dumps(payload, default=str, indent=2)}], "isError": bad, "structuredContent": payload})


def message(stream: IO[str]) -> str | None:
    """The next message: a line, or as many characters as a header says."""
    for line in stream:
        text = line.strip()
        if text.lower().startswith("content-length:"):
            size = text.partition(":")[2].strip()
            while (line := stream.readline()).strip():
                pass
            return stream.read(int(size)) if size.isdigit() else None
        if text:
            return text
    return None


def serve(inp: IO[str] | None = None, out: IO[str] | None = None) -> None:
    inp, out = inp or sys.stdin, out or sys.stdout
    while (raw := message(inp)) is not None:
        try:
            answer = handle(json.loads(raw))
        except json.JSONDecodeError as e:
            answer = _failed(None, PARSE, f"Parse error: {e}")
        if answer is not None:
            out.write(json.dumps(answer, default=str) + "\n")
            out.flush()
