"""Redaction of credentials and of paths, and entity candidates in free text: rules with memory, run as Arrow UDFs."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Documented prefixes of credentials, and keys whose value is a secret.
PREFIXES = (
    "sk- sk_live_ sk_test_ pk_live_ rk_live_ ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxb- xoxp- xoxa- xoxs- xapp- "
    "AKIA ASIA ya29. AIza hf_ npm_ dop_v1_ shpat_ sq0atp- SG. eyJ"
).split()
KEYS = set(
    "password passwd secret token api_key apikey api-key access_key secret_key private_key client_secret credential credentials bearer contraseña contrasena clave".split()
)
REACH = 3  # words after a key within which its value is looked for
MASK = "[redacted]"

_WORDS = re.compile(r"(\S+)(\s*)")
_KNOWN = re.compile("(?:" + "|".join(map(re.escape, PREFIXES)) + ").{7,}", re.S)
_BLOB = re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+=_-]{32,}\Z")
_BARE = re.compile(r"^[^\w-]+|[^\w-]+$")


def _opaque(word: str) -> bool:
    core = word.strip("\"',;")
    return bool(_KNOWN.match(core) or ("BEGIN" in core and "PRIVATE" in core) or _BLOB.match(core))


def _value(word: str) -> bool:
    w = word.strip("\"'`,;")
    return len(w.encode()) >= 8 and (bool(re.search(r"[0-9.\-_+/=]", w)) or (w.upper() != w and w.lower() != w))


def mask_secrets(text: str) -> tuple[str, int]:
    """The text with its credentials masked, white space kept, and how many there were."""
    found, armed, out = 0, 0, [text[: len(text) - len(text.lstrip())]]
    for word, gap in _WORDS.findall(text):
        cut_at = re.search("[=:]", word)
        if cut_at and cut_at.end() < len(word) and _BARE.sub("", word[: cut_at.start()]).lower() in KEYS and len(word[cut_at.end() :].strip("\"'`,;").encode()) >= 6:
            word, found, armed = word[: cut_at.end()] + MASK, found + 1, 0
        elif _opaque(word) or (armed and _value(word)):
            word, found, armed = MASK, found + 1, 0
        else:
            armed = REACH if _BARE.sub("", word).lower() in KEYS else max(0, armed - 1)
        out.append(word + gap)
    return "".join(out), found


def glob_pattern(glob: str) -> re.Pattern:
    """A path pattern: `*` within a segment, `**` over segments, `?` one character, `~/` the home folder."""
    g = os.path.expanduser(glob).replace("\\", "/")
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", g) if p)
    body = body.replace(".*/", "(?:.*/)?", 1) if g.startswith("**/") else body
    anchored = g.startswith(("/", "~")) or re.match(r"[A-Za-z]:", g) is not None
    return re.compile(f"{body}\\Z" if anchored else f"(?:.*/)?{body}\\Z")


def mask_paths(text: str, globs: list[re.Pattern]) -> tuple[str, int]:
    """The text with every path that a pattern matches masked, trailing punctuation kept, and how many there were."""
    found, out = 0, [text[: len(text) - len(text.lstrip())]]
    for word, gap in _WORDS.findall(text):
        core = word.rstrip(".,;:!?)\"'`")
        path = core.lstrip("(\"'`").replace("\\", "/")
        if path and any(g.match(path) or any(g.match(s) for s in path.split("/")) for g in globs):
            word, found = MASK + word[len(core) :], found + 1
        out.append(word + gap)
    return "".join(out), found


def redact(text: Column, globs: list[str] = ()) -> Column:
    """Struct (text, secrets, paths) of the text with its credentials and the paths of `globs` masked; null stays null."""

    def run(texts: pd.Series) -> pd.DataFrame:
        patterns = [glob_pattern(g) for g in globs]
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, 0, 0))
                continue
            masked, secrets = mask_secrets(t)
            masked, paths = mask_paths(masked, patterns) if patterns else (masked, 0)
            rows.append((masked, secrets, paths))
        return pd.DataFrame(rows, columns=["text", "secrets", "paths"])

    return F.pandas_udf(run, "text string, secrets int, paths int")(text)


def entity_candidates(text: str, normalize, most: int = 6) -> list[str]:
    """Spans in backticks first, then paths, identifiers, dotted words and capitalised words but the first."""
    seen: dict[str, str] = {}

    def offer(span: str) -> None:
        span = re.sub(r"^[^\w/]+|[^\w/]+$", "", span)
        if 2 <= len(span.encode()) <= 64 and (key := normalize(span)):
            seen.setdefault(key, span)

    for span in re.findall(r"`([^`]*)`", text):
        offer(span)
    for i, word in enumerate(text.split()):
        if len(seen) >= most:
            break
        word = word.strip("()\"',.;:")
        if len(word.encode()) < 2:
            continue
        if "/" in word or "::" in word or "_" in word or (i and word[0].isupper()) or ("." in word and not word.endswith(".") and any(c.isalpha() for c in word)):
            offer(word)
    return list(seen.values())[:most]


def plain_normalize(text: str) -> str:
    """The store's normal form of a name, for use inside Python tasks."""
    return " ".join(text.split()).lower().strip(".,;:!?\"'")


def extract_entities(text: Column) -> Column:
    """At most six entity candidates of a text in order of appearance; null gives null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else entity_candidates(t, plain_normalize))

    return F.pandas_udf(run, "array<string>")(text)
