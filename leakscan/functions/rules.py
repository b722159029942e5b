"""Rule sets for personal-data detection and their translation to the JVM regex dialect."""

from __future__ import annotations

import re

# The pattern of each rule, in detection order.
BASE_RULES: dict[str, str] = {
    "card": r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b",
    "passport": r"\b\d{4}\s\d{6}\b",
    "inn": r"\b\d{12}\b",
    "snils": r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b",
    "phone": r"(\+7|8)[\s\-\(]?\d{3}[\s\-\)]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
}

# Fixed value: the card dialect that also takes hyphens or no separator.
EXTENDED_CARD = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"

RULE_SETS: dict[str, dict[str, str]] = {
    "base": BASE_RULES,
    "extended": {**BASE_RULES, "card": EXTENDED_CARD},
}

# Cheap tests a text must pass before a rule is tried on it: every number rule needs three digits in a row, an e-mail
# needs its sign. Most text fails them, and the e-mail pattern is kept off long runs of word characters.
THREE_DIGITS = r"\p{Nd}{3}"
EMAIL_SIGN = "@"
_NUMBER_PATTERNS = {p for name, p in BASE_RULES.items() if name != "email"} | {EXTENDED_CARD}


def needs_digits(pattern: str) -> bool:
    return pattern in _NUMBER_PATTERNS


def needs_sign(pattern: str) -> bool:
    return pattern == BASE_RULES["email"]


# The rules are written for Unicode-aware classes. The JVM's own classes are ASCII, and its Unicode mode draws the
# word class differently (marks and connectors), so the three escapes are spelled out.
_WORD = r"[\p{L}\p{N}_]"
_ESCAPES = {
    r"\b": rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    r"\d": r"\p{Nd}",
    r"\s": r"[\t-\r\x1c-\x20\x85\p{Z}]",
}
# A boundary beside a digit has only one side left to look at.
_BEFORE_DIGIT = rf"(?=\p{{Nd}})(?<!{_WORD})"
_AFTER_DIGIT = rf"(?!{_WORD})"


def email_pattern() -> str:
    """The e-mail rule for the JVM in linear time; group 1 is the match.

    All starts within one run of local-part characters end at the same place, so only the first boundary of a run is
    tried: a match starts where the last one ended or no such character precedes, skips what is no boundary, and takes
    the local part without giving back.
    """
    local, rest = BASE_RULES["email"].removeprefix(r"\b").split("+@", 1)
    boundary = _ESCAPES[r"\b"]
    return rf"(?:\G|(?<!{local}))(?:(?!{boundary}){local})*+({boundary}{local}++@{jvm_pattern(rest)})"


def rule_set(rules: str | dict[str, str]) -> dict[str, str]:
    """A named rule set, or a caller's own ``{name: pattern}`` map unchanged."""
    if isinstance(rules, dict):
        return rules
    if rules not in RULE_SETS:
        raise ValueError(f"unknown rule set {rules!r}; known: {', '.join(sorted(RULE_SETS))}")
    return RULE_SETS[rules]


def jvm_pattern(pattern: str) -> str:
    """The same pattern for ``java.util.regex`` with Unicode word, digit and space classes."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            escape = pattern[i : i + 2]
            if escape == r"\b" and pattern.startswith(r"\d", i + 2):
                out.append(_BEFORE_DIGIT)
            elif escape == r"\b" and re.search(r"\\d(\{\d+\})?$", pattern[:i]):
                out.append(_AFTER_DIGIT)
            else:
                out.append(_ESCAPES.get(escape, escape))
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)
