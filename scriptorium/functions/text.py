"""Text expressions: predicates, extraction, keys and validation; all are Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults that decide which texts are worth a language check.
MIN_CHARS, MIN_LETTERS = 20, 5

#: Patterns of tokens that a translation has to keep, by category.
PROTECTED = {
    "url": r"https?://[^\s<>\"')]+",
    "email": r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b",
    "currency": r"(?:[$€£¥]\s?\d[\d,.]*\d|\b\d[\d,.]*\d\s?(?:USD|EUR|GBP|JPY))\b",
    "cidr": r"\b(?:\d{1,3}\.){3}\d{1,3}/\d{1,2}\b|\b[0-9a-fA-F:]+::?[0-9a-fA-F:]*/\d{1,3}\b",
    "ticket_id": r"\b(?:[A-Z]{2,}-\d+|#\d{3,})\b",
    "cli_flag": r"(?<!\S)(?:--[a-zA-Z][\w-]*|-[a-zA-Z]\b)",
    "digits": r"(?<![\d.])\d{2,}(?:\.\d+)?(?![\d.])",
}

#: Phrases that only an instruction text holds, in lower case; a service passes those of its own prompts.
LEAK_MARKERS = ("## security notice", "follow all rules strictly", "<<begin content>>", "<<end content>>")

#: Units that are not translatable text (whole-text patterns).
NUMERIC_ONLY = r"[-+]?[\d\s.,:%/()\[\]-]+"
PLACEHOLDER_ONLY = r"(?:\s|[<{\[(]/?[a-zA-Z0-9_.-]*[>}\])]|__DLP_TOKEN_\d+__|%[sd]|[^\w\s])+"
REPEATED_FILL = r"[. 。…，]{20,}"
MASK_TOKEN = r"__DLP_TOKEN_\d{4,}__"


def letters(text: Column) -> Column:
    """Number of Unicode letters."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def is_detectable(text: Column, min_chars: int = MIN_CHARS, min_letters: int = MIN_LETTERS) -> Column:
    """Long enough, and with enough letters, for a language detector."""
    return F.coalesce((F.length(text) >= min_chars) & (letters(text) >= min_letters), F.lit(False))


def fullmatch(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """Tokens without a tokenizer: a quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def skip_reason(text: Column, min_chars: int, language: Column | None = None, target: str | None = None, supported: tuple[str, ...] = ()) -> Column:
    """Why a unit isn't translated, by the first rule that holds; null if it is."""
    out = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty")
        .when(F.length(F.trim(text)) < min_chars, "short")
        .when(fullmatch(F.trim(text), NUMERIC_ONLY), "numeric")
        .when(fullmatch(F.trim(text), PLACEHOLDER_ONLY), "placeholder")
    )
    if language is not None:
        asked = is_detectable(text) & language.isNotNull()
        out = out.when(asked & (language == target), "target_language").when(asked & ~language.isin(*supported), "unsupported")
    return out


def protected(text: Column, category: str) -> Column:
    """Distinct protected tokens of a category, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PROTECTED[category]), F.lit(0)))


def missing(source: Column, target: Column, category: str) -> Column:
    """Protected tokens of the source that aren't in the target; none where either side is empty."""
    found = F.filter(protected(source, category), lambda t: F.instr(target, t) == 0)
    return F.when((F.coalesce(source, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == ""), F.array().cast("array<string>")).otherwise(found)


def leaks_prompt(text: Column, markers: tuple[str, ...] = LEAK_MARKERS) -> Column:
    """The text holds one of the markers, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for marker in markers:
        out = out | low.contains(marker.lower())
    return out


def output_fault(source: Column, target: Column, markers: tuple[str, ...] = LEAK_MARKERS, single: tuple[int, int] | None = None) -> Column:
    """Why an output is not taken, by the first rule that holds; null if it is.

    ``single``: tokens of input or output from which on lengths are compared, for units given one by one.
    """
    trimmed = F.regexp_replace(source, REPEATED_FILL, ".")
    tokens, given = token_estimate(trimmed), token_estimate(target)
    ratio = given / tokens
    compared = (tokens >= single[0]) | (given >= single[1]) if single else F.lit(True)
    return (
        F.when(F.coalesce(F.trim(target), F.lit("")) == "", "empty")
        .when(leaks_prompt(target, markers), "prompt_leak")
        .when((trimmed == target) & (tokens > 10), "same_text")
        .when(~((ratio > 0.3) & (ratio < 3)) & compared, "length_ratio")
        .when((tokens > 20) & F.levenshtein(source, target, 4).between(0, 4), "edit_distance")
    )


def cache_key(text: Column, provider: str, model: str, source: Column, target: str, domain: Column | None = None, version: str = "v4") -> Column:
    """SHA-256 over the call's parts joined by a bar; a blank domain leaves its part out."""
    parts = [F.lit(version), F.lit(provider), F.lit(model), source, F.lit(target)]
    if domain is not None:
        parts.append(F.when(F.trim(domain) != "", domain))
    return F.sha2(F.concat_ws("|", *parts, text), 256)


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?。！？]+"), lambda s: F.trim(s) != ""))


def coalesced_error(row_error: Column, result: Column) -> Column:
    """The row's own error message, else the one inside its result JSON; blank ones count as none."""
    return F.coalesce(F.nullif(row_error, F.lit("")), F.nullif(F.get_json_object(result, "$.error_message"), F.lit("")))


def stripped_fences(text: Column) -> Column:
    """JSON without the tags or code fences around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"\A(?:<json>|```json|```)|(?:</json>|```)\z", ""))


def salvaged_items(text: Column) -> Column:
    """Complete {"id": n, "output": "..."} objects of a truncated array, as array<struct<id, output>>."""
    # Possessive runs: an alternation inside a star takes a frame of the stack for each character.
    pattern = r'\{\s*"id"\s*:\s*(\d+)\s*,\s*"output"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*\}'
    ids = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    outs = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    plain = F.transform(outs, lambda o: F.coalesce(F.get_json_object(F.concat(F.lit('{"o":"'), o, F.lit('"}')), "$.o"), o))
    return F.transform(F.arrays_zip(ids.alias("id"), plain.alias("output")), lambda x: F.struct(x["id"].cast("long").alias("id"), x["output"].alias("output")))


def normalized_items(text: Column, schema: str, keys: tuple[str, ...] = ("translations", "results", "items", "data", "outputs")) -> Column:
    """An array whatever its wrapping: itself, below one of the keys, or a single object."""
    tries = [F.when(F.trim(text).startswith("["), F.from_json(text, schema))]
    tries += [F.from_json(F.get_json_object(text, f"$.{k}"), schema) for k in keys]
    tries.append(F.when(F.trim(text).startswith("{"), F.from_json(F.concat(F.lit("["), text, F.lit("]")), schema)))
    return F.coalesce(*tries)


def safe_filename(name: Column) -> Column:
    """The last path component with anything but word characters, dots, spaces and hyphens replaced."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)\z", 1), r"[^\w. -]", "_")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
