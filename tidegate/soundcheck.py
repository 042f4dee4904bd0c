"""``python -m tidegate.soundcheck RULES < rows``: runs lines ``SUBJECT|payload`` through a rule file,
echoing each and printing what it emits. Exits with 1 if a row failed, with 2 if the file did."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from tidegate.lang.program import load_file
from tidegate.lang.tree import RuleFileError
from tidegate.runtime.machine import Machine


def check(path: str, rows: Iterable[str], linger_ms: int = 10_000) -> Iterator[tuple[str, bool]]:
    """(line, whether it is an error)."""
    machine = Machine(load_file(path))
    now = 0
    for k, row in enumerate(r.rstrip("\n") for r in rows):
        if not row.strip():
            continue
        subject, _, payload = row.partition("|")
        now = 1000 + k
        yield f"{subject}|{payload}", False
        fed = machine.feed(k, now, subject, payload)
        for e in fed.emissions:
            yield f"  {e.subject}|{e.payload}", False
        for rule, why in fed.errors:
            yield f"  rule {rule}: {why}", True
    for e in machine.finish(now + linger_ms).emissions:
        yield f"  {e.subject}|{e.payload}", False


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__, file=sys.stderr)
        return 2
    failed = False
    try:
        for line, bad in check(args[0], sys.stdin):
            print(line, file=sys.stderr if bad else sys.stdout)
            failed |= bad
    except RuleFileError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
