"""The pluggable reasoning step: structured replies with validation and retries, failures as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reasoner(Protocol):
    """Made once for each partition, on its executor; gives a reply's text for a prompt, and for an image's data URL if there is one."""

    def __call__(self, prompt: str) -> str: ...


def offline() -> Reasoner:
    """A fixed rule instead of a model: the verdict is the parity of the prompt's length."""

    def reply(prompt: str) -> str:
        return json.dumps({"observations": prompt[:40], "detected_anomalies": "", "limitations": "rule", "pred_label": len(prompt) % 2})

    return reply


def http(url: str, model: str, key: str = "", timeout: float = 60, system: str | None = None, tries: int = 3, pause: float = 1.0, **settings) -> Callable[[], Reasoner]:
    """A client of a chat-completions service, which also gets the image.

    settings: more fields of a request, such as temperature and max_tokens. Transport errors and overload are tried again after a pause that doubles.
    """

    def make() -> Reasoner:
        import time
        import urllib.error
        import urllib.request

        def sent(body: bytes) -> str:
            r = urllib.request.Request(f"{url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(r, timeout=timeout) as f:
                return json.load(f)["choices"][0]["message"]["content"]

        def reply(prompt: str, image: str | None = None) -> str:
            content = [{"type": "image_url", "image_url": {"url": image}}, {"type": "text", "text": prompt}] if image else prompt
            messages = [{"role": "system", "content": system}] * (system is not None) + [{"role": "user", "content": content}]
            body = json.dumps({"model": model, "messages": messages, **settings}).encode()
            for n in range(tries):
                try:
                    return sent(body)
                except urllib.error.HTTPError as e:
                    if n + 1 == tries or e.code not in (408, 429) and e.code < 500:
                        raise
                except OSError:
                    if n + 1 == tries:
                        raise
                time.sleep(pause * 2**n)
            raise ValueError("tries must be 1 or more")

        return reply

    return make


#: Fields that a reply must have, and their kinds.
PROFILE = {"observations": str, "detected_anomalies": str, "limitations": str, "pred_label": int}


def parse(reply: str, fields: dict[str, type] = PROFILE) -> dict:
    """A reply's JSON object, checked; a ValueError says what is wrong."""
    text = reply.replace("“", '"').replace("”", '"').replace("```json\n", "").replace("```", "").strip()
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"not JSON at line {e.lineno}, column {e.colno}: {e.msg}") from e
    if not isinstance(got, dict):
        raise ValueError("not a JSON object")
    for name, kind in fields.items():
        if not isinstance(got.get(name), kind) or isinstance(got.get(name), bool) and kind is not bool:
            raise ValueError(f"{name} must be {kind.__name__}")
    if "pred_label" in fields and got["pred_label"] not in (0, 1):
        raise ValueError("pred_label must be 0 or 1")
    return got


def ask(reason: Callable[[str], str], prompt: str, tries: int = 3, fields: dict[str, type] = PROFILE) -> tuple[dict | None, str | None, int]:
    """(parsed reply, error, tries used). Each new try is told what was wrong."""
    said, error = prompt, None
    for n in range(1, tries + 1):
        try:
            return parse(reason(said), fields), None, n
        except ValueError as e:
            error = str(e)
            said = f"{prompt}\n\nYour reply was not valid ({error}). Reply again with the JSON object only."
        except Exception as e:
            return None, f"{type(e).__name__}: {e}", n
    return None, error, tries


def profiles(prompts: DataFrame, make: Callable[[], Reasoner] = offline, tries: int = 3) -> DataFrame:
    """image_path, prompt and, if there is such a column, image (a data URL) -> the profile's fields, error and tries; one failure never stops the rest."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reason = make()
        for pdf in parts:
            rows = []
            for path, prompt, image in zip(pdf["image_path"], pdf["prompt"], pdf["image"]):
                got, error, n = ask((lambda said, image=image: reason(said, image)) if image else reason, prompt or "", tries)
                got = got or {}
                rows.append((path, got.get("observations"), got.get("detected_anomalies"), got.get("limitations"), got.get("pred_label"), error, n))
            yield pd.DataFrame(rows, columns=["image_path", "observations", "detected_anomalies", "limitations", "pred_label", "error", "tries"]).astype({"pred_label": "Int32"})

    image = F.col("image") if "image" in prompts.columns else F.lit(None).cast("string")
    return prompts.select("image_path", "prompt", image.alias("image")).mapInPandas(run, "image_path string, observations string, detected_anomalies string, limitations string, pred_label int, error string, tries int")


def prompt(features, prefix: str = "Features: "):
    """A user prompt with a row's features as JSON."""
    return F.concat(F.lit(prefix), F.to_json(features))
