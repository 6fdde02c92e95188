"""Text functions of the memory store as column expressions, so that they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EDGE = ".,;:!?\"'"

# Acknowledgements, question words, and the markers of durable statements, in English and Spanish.
ACKNOWLEDGEMENTS = (
    "ok|okay|oki|k|yes|yep|yeah|no|nope|sure|thanks|thank you|ty|please|continue|go on|go ahead|next|stop|wait|hmm|y|n|si|sí|dale|vale|listo|"
    "gracias|sigue|continua|continúa|adelante|hazlo|perfecto|genial|bien|correcto|exacto|eso|arreglalo|arréglalo"
).split("|")
QUESTION_WORDS = (
    "how what why where when who which can could would should is are does do did cómo como qué que por dónde donde cuándo cuando quién quien cuál cual "
    "puedes podrías podrias sabes hay"
).split()
SALIENT = {
    "constraint": "never|always|must|don't|do not|avoid|required|requires|forbidden|nunca|siempre|no uses|no use|no hagas|evita|hay que|tienes que|debes|obligatorio|prohibido",
    "preference": "prefer|prefers|i like|rather than|instead of|please use|from now on|prefiero|preferimos|mejor usa|me gusta|en vez de|en lugar de|de ahora en adelante|a partir de ahora",
    "decision": "we use|we're using|we are using|we decided|let's use|switch to|moving to|the convention is|the rule is|usamos|vamos a usar|decidimos|cambiamos a|la convención es|la regla es|se usa",
    "note": "remember|note that|keep in mind|gotcha|careful|warning|recuerda|acuérdate|acuerdate|ten en cuenta|ojo|importante|cuidado",
}
# File extensions and the language they stand for.
LANGUAGE_OF = {
    "rust": "rs toml", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "python": "py", "go": "go", "ruby": "rb", "kotlin": "java kt kts", "c": "c h",
    "cpp": "cpp cc hpp", "csharp": "cs", "swift": "swift", "php": "php", "bash": "sh bash zsh", "powershell": "ps1", "sql": "sql", "html": "html htm",
    "css": "css scss less", "json": "json jsonc", "yaml": "yaml yml", "markdown": "md markdown", "dockerfile": "dockerfile", "make": "makefile mk", "zig": "zig", "lua": "lua", "r": "r",
}
DAY = 86_400_000


def normalize_text(text: Column) -> Column:
    """Trimmed, runs of white space as one blank, lower case, without punctuation at either edge; null stays null."""
    one = F.lower(F.regexp_replace(F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", ""), f"{BLANKS}+", " "))
    return F.regexp_replace(one, f"^[{EDGE}]+|[{EDGE}]+$", "")


def identity(*parts: Column) -> Column:
    """First 16 bytes of SHA-256 over the parts, each ended by a NUL; a null part counts as empty."""
    ended = [x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))]
    return F.unhex(F.substring(F.sha2(F.concat(*ended), 256), 1, 32))


def est_tokens(text: Column) -> Column:
    """A quarter of the characters or the number of words, whichever is more; 0 for null."""
    words = F.size(F.filter(F.split(text, f"{BLANKS}+"), lambda w: w != ""))
    return F.coalesce(F.greatest(F.floor(F.char_length(text) / 4).cast("int"), words), F.lit(0))


def ymd(ms: Column) -> Column:
    """Date of an epoch in milliseconds, UTC, as `YYYY-MM-DD`."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY).cast("int")), "yyyy-MM-dd")


def parse_when(text: Column) -> Column:
    """Epoch milliseconds of a date or a bare epoch; integers below 1e11 are seconds; null where it is neither.

    Days up to 31 are taken in every month and roll over, as in `2025-02-31`.
    """
    t = F.trim(text)
    number = F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.cast("long"))
    scaled = F.when(F.abs(number) < 100_000_000_000, number * 1000).otherwise(number)
    part = lambda i: F.regexp_extract(t, r"^(\d{1,4})-(\d{1,2})-(\d{1,2})Z*$", i).cast("int")
    dated = t.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}Z*$")
    fine = dated & part(2).between(1, 12) & part(3).between(1, 31)
    day = F.datediff(F.make_date(part(1), part(2), F.lit(1)), F.lit("1970-01-01").cast("date")) + part(3) - 1
    return F.when(number.isNotNull(), scaled).when(fine, day.cast("long") * DAY)


def contains_phrase(lower_text: Column, phrases: str) -> Column:
    """Whether one of the phrases (divided by |) stands in the text between characters that are no letters or digits."""
    return lower_text.rlike(rf"(?:^|[^\p{{L}}\p{{N}}])(?:{phrases})(?:$|[^\p{{L}}\p{{N}}])")


def skip_reason(text: Column, min_chars: int = 12) -> Column:
    """Why a prompt isn't worth keeping; null to keep it. A null text is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}+|{BLANKS}+$", "")
    bare = F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return (
        F.when(t == "", "empty")
        .when(t.startswith("/") & ~t.contains(" "), "slash command")
        .when(t.startswith("!"), "shell passthrough")
        .when(bare.isin(*ACKNOWLEDGEMENTS), "acknowledgement")
        .when(F.char_length(t) < min_chars, "too short")
    )


def salience(text: Column) -> Column:
    """The kind of durable statement that a text makes, or null: short texts and questions make none."""
    t = F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")
    low = F.lower(t)
    kind = F.when((F.octet_length(t) < 20) | t.endswith("?") | F.regexp_extract(low, f"^(.*?)(?:{BLANKS}|$)", 1).isin(*QUESTION_WORDS), F.lit(None).cast("string"))
    for name, phrases in SALIENT.items():
        kind = kind.when(contains_phrase(low, phrases), name)
    return kind


def relation_of_kind(kind: Column) -> Column:
    """The relation of a fact that is derived from a statement of this kind."""
    return F.when(kind == "preference", "prefers").when(kind == "decision", "decided").when(kind == "constraint", "requires").when(kind == "error", "failed_with").otherwise("relates_to")


def language_of_path(path: Column) -> Column:
    """Language by the path's last extension; null where it is unknown."""
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit(None).cast("string")
    for language, extensions in LANGUAGE_OF.items():
        out = F.when(extension.isin(*extensions.split()), language).otherwise(out)
    return out


def line_range(text: Column) -> Column:
    """Struct (line_from, line_to) of `A-B` with 1 <= A <= B; null for anything else."""
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d{1,9})-(\d{1,9})$", i), F.lit("")), F.lit("999999999")).cast("long") for i in (1, 2))
    return F.when((a >= 1) & (b >= a), F.struct(a.alias("line_from"), b.alias("line_to")))


def clip(text: Column, most: int = 4000) -> Column:
    """The text, cut after `most` characters with a mark that says so."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" …[truncated]"))).otherwise(text)


# Spellings of the two events that agents send.
PROMPT_EVENTS = "prompt userpromptsubmit user-prompt-submit userpromptsubmitted user-prompt-submitted submit beforeagent before-agent preinvocation pre-invocation beforesubmitprompt before-submit-prompt".split()
END_EVENTS = "session-end sessionend session-ended stop end".split()


def event_kind(name: Column) -> Column:
    """`prompt`, `session_end` or null for an event's name, whatever its case, blanks and underscores."""
    n = F.regexp_replace(F.lower(F.trim(name)), "[_ ]", "-")
    return F.when(n.isin(*PROMPT_EVENTS), "prompt").when(n.isin(*END_EVENTS), "session_end")


def prov_note(valid_from: Column, valid_to: Column, invalidated_at: Column, recorded_at: Column, source: Column, head: Column, confidence: Column, now_ts: int) -> Column:
    """Bracketed note on where a fact comes from and when it held, after a blank; empty where there is nothing to tell."""
    start = F.coalesce(valid_from, recorded_at)
    gone = invalidated_at.isNotNull()
    held = (
        F.when(gone & valid_to.isNotNull(), F.concat(F.lit("was true "), ymd(start), F.lit(" → "), ymd(valid_to)))
        .when(gone, F.concat(F.lit("retracted, noted "), ymd(start)))
        .when(F.lit(now_ts) - start > 2 * DAY, F.concat(F.lit("since "), ymd(start)))
    )
    by = F.when((source != "") & (source != "unknown"), F.concat(F.lit("by "), source))
    at = F.when(head != "", F.concat(F.lit("@ "), head))
    sure = F.when(confidence < 1, F.concat(F.lit("conf "), F.format_string("%.2f", confidence)))
    parts = F.concat_ws(", ", held, by, at, sure)
    return F.when(parts == "", "").otherwise(F.concat(F.lit(" ["), parts, F.lit("]")))


def hook_output(agent: Column, event: Column, context: Column) -> Column:
    """JSON envelope that hands a context back to an agent; null for agents that take none."""
    name = F.when(event == "session_end", "SessionEnd").when(agent == "gemini-cli", "BeforeAgent").otherwise("UserPromptSubmit")
    steps = F.to_json(F.struct(F.array(F.struct(context.alias("ephemeralMessage"))).alias("injectSteps")))
    wrapped = F.to_json(F.struct(F.struct(name.alias("hookEventName"), context.alias("additionalContext")).alias("hookSpecificOutput")))
    return (
        F.when((agent == "antigravity") & (event == "session_end"), '{"decision":"allow"}')
        .when(agent == "antigravity", steps)
        .when(agent.isin("cursor", "copilot-cli"), F.lit(None).cast("string"))
        .otherwise(wrapped)
    )
