"""Text expressions for messages and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pellucid.functions.paths import strip

REDACTED = "<redacted image data>"


def _spelled(word: str) -> str:
    """A pattern of a word in a JSON string, whose characters may be escaped."""

    def one(c: str) -> str:
        code = "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in f"{ord(c):04x}")
        return rf"(?:{c}|\\u{code}" + (r"|\\/)" if c == "/" else ")")

    return "".join(map(one, word))


def redact(json_text: Column) -> Column:
    """JSON text in which every "url" entry with image data, at any depth, has a placeholder; all else stays as it is.

    In JSON, a quote after a brace or comma begins a string, so what the pattern takes for a key is one. Keys and values may be written with escapes.
    """
    entry = r'([{,]\s*"' + _spelled("url") + r'"\s*:\s*")' + _spelled("data:image/") + r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
    return F.regexp_replace(json_text, entry, f'$1{REDACTED}"')


def truncate(s: Column, most: int = 4096) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def straight_quotes(s: Column) -> Column:
    return F.translate(s, "“”", '""')


def strip_fences(s: Column) -> Column:
    """Without code fences and the white space around."""
    return strip(F.replace(F.replace(s, F.lit("```json\n"), F.lit("")), F.lit("```"), F.lit("")))


def template_variables(s: Column) -> Column:
    """Names in braces, up to a dot or bracket, each once in order of appearance."""
    found = F.regexp_extract_all(s, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)(?:[.\[][^{}]*)?\}"), F.lit(1))
    return F.array_distinct(found)


def last_section(s: Column) -> Column:
    return F.element_at(F.split(s, "###"), -1)


def safe_division(n: Column, d: Column, default: Column | None = None) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(float("nan")) if default is None else default)


def error_text(code: Column, message: Column) -> Column:
    return F.concat(F.lit("["), code, F.lit("] "), message)


def history_entry(role: Column, name: Column, content: Column, reasoning: Column) -> Column:
    """A message as the report sees it."""
    label = F.initcap(role)
    label = F.when(role == "ai", "AIMessage").when(role == "tool", F.concat(F.lit("ToolMessage"), F.coalesce(F.concat(F.lit(":"), name), F.lit("")))).otherwise(F.concat(label, F.lit("Message")))
    thought = F.coalesce(F.concat(F.lit("\n[Reasoning]: "), F.nullif(reasoning, F.lit(""))), F.lit(""))
    return F.concat(F.lit("["), label, F.lit("]:"), F.coalesce(content, F.lit("None")), thought)
