"""The regular expressions of rule files: checked, and as Python and Java patterns.

The dialect is the linear-time one: no look-around, back references, possessive or named groups,
POSIX classes or ``\\p``. Here a backtracking engine runs it, so texts are bounded by TEXT_LIMIT.
"""

from __future__ import annotations

import re

from tidegate.lang.tree import RuleFileError

#: Limits on patterns.
MOST_BYTES, MOST_GROUPS, MOST_REPEAT = 1024, 9, 255
TEXT_LIMIT = 1 << 20
_REFUSED = [
    (r"\(\?(?:<?[=!]|>)", "look-around isn't supported"),
    (r"\(\?P?<\w", "named groups aren't supported"),
    (r"\\[1-9]", "back references aren't supported"),
    (r"[*+?}]\+", "possessive repeats aren't supported"),
    (r"\[\[?:\w+:", "POSIX classes aren't supported"),
    (r"\\[pPkAzZGQE]", "this escape isn't supported"),
]


def _plain(pattern: str) -> str:
    """The pattern with escaped backslashes out of the way, for the checks."""
    return pattern.replace("\\\\", "__")


def check(pattern: str) -> None:
    if len(pattern.encode()) > MOST_BYTES:
        raise RuleFileError("the pattern is too long")
    bare = _plain(pattern)
    for refused, why in _REFUSED:
        if re.search(refused, bare):
            raise RuleFileError(f"pattern {pattern!r}: {why}")
    if re.search(r"(?<!^)\(\?[a-zA-Z]+\)", bare) or re.search(r"\(\?[a-zA-Z]*-?[a-zA-Z]*:", bare) and not re.search(r"\(\?:", bare):
        raise RuleFileError(f"pattern {pattern!r}: flags stand at the start only")
    for m in re.finditer(r"\{(\d+)(?:,(\d*))?\}", bare):
        if max(int(m[1]), int(m[2] or 0)) > MOST_REPEAT:
            raise RuleFileError(f"pattern {pattern!r}: repeats go up to {MOST_REPEAT}")
    try:
        groups = compiled(pattern).groups
    except re.error as e:
        raise RuleFileError(f"pattern {pattern!r}: {e}") from None
    if groups > MOST_GROUPS:
        raise RuleFileError(f"pattern {pattern!r}: more than {MOST_GROUPS} groups")


def compiled(pattern: str) -> re.Pattern:
    """Python's: ASCII classes, and ``$`` is the end only."""
    return re.compile(_end_only(pattern), re.ASCII)


def _end_only(pattern: str, end: str = r"\Z") -> str:
    out, k, in_class = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class and pattern[k - 1] != "[":
            in_class = False
        out.append(end if c == "$" and not in_class else c)
        k += 1
    return "".join(out)


def java(pattern: str) -> str:
    """The same for Java: ``.`` stops at a line feed only, ``$`` is the end, blanks have \\v."""
    body = _end_only(pattern, r"\\z".replace("\\\\", "\\"))
    return "(?d)" + body


def nullable(pattern: str) -> bool:
    return compiled(pattern).match("") is not None


def replace_all(pattern: str, replacement: str, text: str) -> str:
    """All matches that don't overlap; an empty match right after a match doesn't count."""
    out, at, last_end = [], 0, -1
    for m in compiled(pattern).finditer(text):
        if m.start() == m.end() == last_end:
            continue
        out += [text[at : m.start()], replacement]
        at = last_end = m.end()
    return "".join([*out, text[at:]])


def first_group(pattern: str, text: str) -> str | None:
    m = compiled(pattern).search(text)
    return None if m is None else m[1] if m.re.groups else m[0]
