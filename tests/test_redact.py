"""Redaction of JSON text equals the recursive rewrite of its tree, and changes nothing else."""

import json
import random

from pyspark.sql import functions as F

from pellucid.functions import text


def tree(r, depth=0):
    kind = r.random()
    if depth < 4 and kind < 0.4:
        return {r.choice(["url", "url", "url", "urls", "Url", 'x"url', "a, url", "{url", "é"]) + r.choice(["", "", "", str(r.randrange(3))]): tree(r, depth + 1) for _ in range(r.randrange(4))}
    if depth < 4 and kind < 0.6:
        return [tree(r, depth + 1) for _ in range(r.randrange(4))]
    return r.choice([1, 1.5, None, True, "", "data:image/png;base64,QQ==", 'data:image/"\\', "data:text/x", "x data:image/png", ', "url": "data:image/z"', "日本"])


def rewritten(x):
    if isinstance(x, dict):
        return {k: text.REDACTED if k == "url" and isinstance(v, str) and v.startswith("data:image/") else rewritten(v) for k, v in x.items()}
    return [rewritten(v) for v in x] if isinstance(x, list) else x


def escaped(s, r):
    """Some characters of the words at hand written as escapes."""
    for word in ("url", "data:image/"):
        new = "".join((f"\\u{ord(c):04x}" if r.random() < 0.5 else f"\\u{ord(c):04X}") if r.random() < 0.3 else "\\/" if c == "/" and r.random() < 0.3 else c for c in word)
        s = s.replace(word, new) if r.random() < 0.5 else s
    return s


def test_redacted_trees(spark):
    r = random.Random(4)
    given = []
    for _ in range(3000):
        s = json.dumps(tree(r), ensure_ascii=r.random() < 0.5, separators=r.choice([(",", ":"), (", ", ": "), (" ,\n", " :\t")]))
        given.append(escaped(s, r))
    given += ['{"url":"data:image/' + "A" * 300_000 + '\\\\"}', '{"url": "data:image/x"', "not json", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)] + [(10**6, None)], "i long, s string")
    got = {x.i: x.t for x in df.select("i", text.redact(F.col("s")).alias("t")).collect()}
    hit = 0
    for i, s in enumerate(given[:3000]):
        assert json.loads(got[i]) == rewritten(json.loads(s)), s[:200]
        if rewritten(json.loads(s)) == json.loads(s):
            assert got[i] == s
        else:
            hit += 1
    assert hit > 50 and got[3000] == '{"url":"' + text.REDACTED + '"}' and got[3002] == "not json" and got[10**6] is None
