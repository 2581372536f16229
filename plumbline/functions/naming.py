"""Identifiers, labels and the quality of names."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

#: Endings and beginnings that mark a name as abbreviated, with what they stand for.
ENDINGS = {
    "id": "", "dt": "date", "cd": "code", "no": "number", "nm": "name", "amt": "amount", "qty": "quantity", "flg": "flag",
    "ind": "indicator", "num": "number", "cnt": "count", "desc": "description", "typ": "type", "cat": "category", "sts": "status",
}
BEGINNINGS = {"pk": "primary key", "fk": "foreign key", "tbl": "table", "vw": "view"}


def clean_name(name: str | None) -> str:
    """A name fit for an IRI: ASCII letters, digits and underscores, not led by a digit."""
    safe = re.sub("[^A-Za-z0-9_]", "_", name or "")
    return f"_{safe}" if safe[:1].isdigit() else safe or "unnamed"


def clean_name_column(name: Column) -> Column:
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_]", "_")
    return F.when(safe == "", F.lit("unnamed")).when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)


def is_identifier(name: str | None, longest: int = 128) -> bool:
    return bool(name) and len(name) <= longest and bool(_STRICT.fullmatch(name))


def is_lax_identifier(name: str | None, longest: int = 63) -> bool:
    """As remote databases take them: hyphens too."""
    return bool(name) and len(name) <= longest and bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", name))


def is_uri(text: str | None) -> bool:
    """Whether a text is an http or https address with a host."""
    try:
        parts = urlsplit(text or "")
    except ValueError:
        return False
    return parts.scheme in ("http", "https") and bool(parts.netloc)


def is_qualified_identifier(name: str | None) -> bool:
    parts = (name or "").split(".")
    return len(parts) <= 3 and all(map(is_identifier, parts))


def sanitise_identifier(name: str) -> str:
    return clean_name(name) if name else ""


def quote(name: str) -> str:
    """A dotted name with each part in backticks."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def quote_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def measure_label(name: str) -> str:
    return name.replace("_", " ").title()


def measure_label_column(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def is_percentage(name: str) -> bool:
    return name.lower().endswith(("_pct", "_percent", "_percentage"))


def singular(name: str) -> str | None:
    """One singular of a plural name, or None."""
    for ending, instead in (("ies", "y"), ("es", ""), ("s", "")):
        if name.endswith(ending) and len(name) > len(ending):
            return name[: -len(ending)] + instead
    return None


def table_variants(names: list[str]) -> dict[str, str]:
    """Lower-cased names and singulars of tables, to the table; longest first."""
    found: dict[str, str] = {}
    for name in names:
        lower = name.lower()
        found[lower] = name
        if one := singular(lower):
            found[one] = name
    return dict(sorted(found.items(), key=lambda kv: -len(kv[0])))


def find_table(name: str, names: list[str]) -> str | None:
    """The table a word stands for, plural or singular."""
    there, word = {n.lower(): n for n in names}, name.lower()
    #: Forms of a word in the order in which they are tried.
    tries = [word, f"{word}s", f"{word}es", f"{word}ies"]
    for ending, instead in (("ies", "y"), ("es", ""), ("s", "")):
        if word.endswith(ending) and len(word) > len(ending):
            tries.append(word[: -len(ending)] + instead)
    if word.endswith("y"):
        tries.append(f"{word[:-1]}ies")
    return next((there[x] for x in tries if x in there), None)


@dataclass(frozen=True)
class NameQuality:
    is_cryptic: bool
    reasons: tuple[str, ...]

    @property
    def confidence(self) -> str:
        return ("low", "medium", "high")[min(2, len(self.reasons))]


def name_quality(name: str) -> NameQuality:
    """Whether a name needs a better one, and why; a trailing number alone is only remarked."""
    lower, parts, reasons = name.lower(), name.split("_"), []
    if len(name) <= 3:
        reasons.append("at most three characters")
    if len(name) > 1 and name.isupper():
        reasons.append("all capitals")
    if 2 * sum(len(p) <= 3 and p.isalpha() for p in parts) > len(parts):
        reasons.append("mostly short parts")
    reasons += [f"ends with _{x}" + (f" for {y}" if y else "") for x, y in ENDINGS.items() if lower.endswith(f"_{x}")]
    reasons += [f"begins with {x}_ for {y}" for x, y in BEGINNINGS.items() if lower.startswith(f"{x}_")]
    cryptic = bool(reasons)
    if name[-1:].isdigit():
        reasons.append("ends with a number")
    return NameQuality(cryptic, tuple(reasons))


def reason_count_column(name: Column) -> Column:
    """Number of reasons of ``name_quality``, for catalogs held as DataFrames."""
    lower, parts = F.lower(name), F.split(name, "_")
    short = F.size(F.filter(parts, lambda p: p.rlike("^[A-Za-z]{1,3}$")))
    tests = [
        F.length(name) <= 3,
        (F.length(name) > 1) & (F.upper(name) == name) & name.rlike("[A-Z]"),
        2 * short > F.size(parts),
        name.rlike("[0-9]$"),
        *(lower.endswith(f"_{x}") for x in ENDINGS),
        *(lower.startswith(f"{x}_") for x in BEGINNINGS),
    ]
    return sum((t.cast("int") for t in tests), F.lit(0))


def redact_log(sql: str, longest: int = 200) -> str:
    """A statement for the log: literals hidden, cut to length."""
    return re.sub(r"'(?:[^']|'')*'", "'***'", sql)[:longest]


def redact_secrets(value, words: tuple[str, ...] = ("password", "secret", "token", "key", "credential")):
    """A nested value with what stands under telling names hidden."""
    if isinstance(value, dict):
        return {k: "***" if str(k).lower() == "pat" or any(w in str(k).lower() for w in words) else redact_secrets(v, words) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return type(value)(redact_secrets(v, words) for v in value)
    return value


def format_bytes(n: float) -> str:
    """Whole bytes below 1024, one decimal of the largest fitting unit above."""
    units, place = ("B", "KB", "MB", "GB", "TB", "PB"), 0
    while n >= 1024 and place < len(units) - 1:
        n, place = n / 1024, place + 1
    return f"{n:.1f} {units[place]}" if place else f"{int(n)} B"


def strip_leading_comments(sql: str) -> str:
    return re.sub(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", "", sql, flags=re.S)
