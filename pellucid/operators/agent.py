"""The agent loop on executors: agent, stage check and reporter for each image, bounded, with one row as its record.

A chat is made once for each partition and is called with the messages so far, as (role, name, content), and the image's data
URL or null. A reply that is a JSON object with ``tool`` runs that tool; any other reply ends the agent's turn and is
checked for a stage marker. The reporter asks for the final response, with validation and retries. Failures of the chat, of a tool
or of the loop are columns of the image's row and stop nothing else; no state crosses rows, so a task may run again.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.operators import reasoner, stages
from pellucid.operators.plugins import Tool

Chat = Callable[[list[tuple[str, str, str]], str | None], str]
#: Fields that a final response must have.
RESPONSE = {"is_success": bool, "reasoning": str, "finally_result": int}
QUESTION = "Is this image authentic (0) or forged (1)?"
REMINDER = "Name the stage: update stage to: <stage>."
SYSTEM = "Weigh the evidence of the conversation. Reply with a JSON object of is_success, reasoning and finally_result (0 or 1)."
RECORD = "image_path string, is_success boolean, finally_result int, reasoning string, stage string, trail array<string>, llm_calls int, tool_calls int, llm_errors int, tool_errors int, llm_time double, tool_time double, error string, messages array<struct<role: string, name: string, content: string>>"


def named_stage(text: str) -> str | None:
    """The stage that a reply's last marker names."""
    found = re.findall(stages.MARKER, text.lower())
    return found[-1].upper() if found and found[-1].upper() in stages.STAGES else None


def wanted_tool(text: str) -> str | None:
    try:
        got = json.loads(text)
    except ValueError:
        return None
    return got["tool"] if isinstance(got, dict) and isinstance(got.get("tool"), str) else None


def report(chat: Chat, messages: list[tuple[str, str, str]], tries: int) -> tuple[dict | None, str | None, int]:
    """The final response from the history, its error and the calls that it took."""
    history = "\n".join(f"{role}{f' {name}' if name else ''}: {content}" for role, name, content in messages)
    got, error, n = reasoner.ask(lambda said: chat([("system", "", SYSTEM), ("human", "", said)], None), history, tries, RESPONSE)
    if got is not None and got["finally_result"] not in (0, 1):
        return None, "finally_result must be 0 or 1", n
    return got, error, n


def solve(path: str, image: str | None, chat: Chat, tools: dict[str, Tool], cap: int = 20, tries: int = 3) -> dict:
    """One image's record."""
    messages = [("human", "", QUESTION if image else f"{QUESTION} The image is available to tools.")]
    out: dict = {"image_path": path, "is_success": None, "finally_result": None, "reasoning": None, "trail": [], "llm_calls": 0, "tool_calls": 0, "llm_errors": 0, "tool_errors": 0, "llm_time": 0.0, "tool_time": 0.0, "error": None}
    stage, node = "INITIAL", "agent"
    try:
        while node in ("agent", "reporter"):
            if node == "reporter":
                began = time.monotonic()
                got, error, n = report(chat, messages, tries)
                out["llm_calls"] += n
                out["llm_time"] += time.monotonic() - began
                out["llm_errors"] += n - (got is not None)
                done = bool(got and got["is_success"])
                if got:
                    out |= {"is_success": done, "finally_result": got["finally_result"], "reasoning": got["reasoning"]}
                else:
                    out |= {"is_success": False, "reasoning": error}
                if not done:
                    messages.append(("tool", "report_conflict_tool", error or "the report was not successful"))
                reply = f"update stage to: {'done' if done else 'forensic_report_formulation'}"
            else:
                began = time.monotonic()
                out["llm_calls"] += 1
                try:
                    reply = chat(messages, image)
                except Exception:
                    out["llm_errors"] += 1
                    raise
                finally:
                    out["llm_time"] += time.monotonic() - began
                if (name := wanted_tool(reply)) is not None:
                    messages.append(("ai", "", reply))
                    began = time.monotonic()
                    out["tool_calls"] += 1
                    try:
                        result = json.dumps(tools[name].execute(path)) if name in tools else json.dumps({"error": f"no tool {name}"})
                    except Exception as e:
                        out["tool_errors"] += 1
                        result = json.dumps({"error": f"{type(e).__name__}: {e}"})
                    out["tool_time"] += time.monotonic() - began
                    messages.append(("tool", name, result))
                    if len(messages) // 2 >= cap:
                        stage, node = "MAX_ITERATIONS", "raise:max_iterations"
                        out["trail"].append(stage)
                    continue
            messages.append(("ai", "", reply))
            found = named_stage(reply)
            if found is None:
                messages.append(("human", "", REMINDER))
            stage = "MAX_ITERATIONS" if len(messages) // 2 >= cap and found != "DONE" else found or stage
            out["trail"].append(stage)
            if stage in ("MAX_ITERATIONS", "ERROR"):
                node = f"raise:{stage.lower()}"
            elif stage == "DONE":
                node = "reporter" if out["is_success"] is None else "end" if out["is_success"] else "agent"
            else:
                node = "reporter" if stage == "FORENSIC_REPORT_FORMULATION" else "agent"
        if node.startswith("raise:"):
            out |= {"error": node.removeprefix("raise:"), "is_success": False}
    except Exception as e:
        out |= {"error": f"{type(e).__name__}: {e}", "is_success": False}
    return out | {"stage": stage, "messages": [{"role": r, "name": n, "content": c} for r, n, c in messages]}


def run(images: DataFrame, make: Callable[[], tuple[Chat, dict[str, Tool]]], cap: int = 20, tries: int = 3) -> DataFrame:
    """A record for each row of image_path and, if there is such a column, image (a data URL).

    make: gives a chat and the tools by name, once for each partition on its executor.
    """
    names = [f.split()[0] for f in RECORD.split(", ") if f.split()[0] not in ("name:", "content:")]

    def partition(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, tools = make()
        for pdf in parts:
            rows = [solve(path, image, chat, tools, cap, tries) for path, image in zip(pdf["image_path"], pdf["image"])]
            yield pd.DataFrame(rows, columns=names).astype({"finally_result": "Int32", "is_success": "boolean"})

    image = F.col("image") if "image" in images.columns else F.lit(None).cast("string")
    return images.select("image_path", image.alias("image")).mapInPandas(partition, RECORD)


def scripted() -> tuple[Chat, dict[str, Tool]]:
    """A fixed rule instead of a model, by the number n in the path: a tool, the evidence, the report, whose verdict is n's parity.
    Without a marker for multiples of 7; the tool fails for multiples of 5."""

    def semantic(path: str) -> dict:
        n = int(re.findall(r"\d+", path)[-1])
        if n % 5 == 0:
            raise ValueError("no profile")
        return {"n": n, "semantic_result": n % 2}

    numbers: dict[str, int] = {}

    def chat(messages: list[tuple[str, str, str]], image: str | None) -> str:
        if messages[0][0] == "system":
            n = int(re.findall(r'n is (\d+)', messages[1][2])[-1])
            return json.dumps({"is_success": True, "reasoning": "rule", "finally_result": n % 2})
        said = [m for m in messages if m[0] == "ai"]
        n = numbers["n"]
        if n % 7 == 0:
            return "I can't say."
        return (json.dumps({"tool": "semantic_context_extraction"}), f"n is {n}, update stage to: evidence_adjudication", "update stage to: forensic_report_formulation")[min(len(said), 2)]

    def seen(messages: list[tuple[str, str, str]], image: str | None) -> str:
        numbers["n"] = int(re.findall(r"\d+", image)[-1]) if image else numbers["n"]
        return chat(messages, image)

    return seen, {"semantic_context_extraction": Tool("semantic_context_extraction", "An image's profile.", semantic)}
