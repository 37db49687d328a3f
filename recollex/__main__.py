"""Runs a query of the catalogue: python -m recollex NAME DATA [ROWS]."""

from __future__ import annotations

import sys

from recollex.plans.catalogue import QUERIES
from recollex.session import session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in QUERIES:
        print(__doc__, *sorted(QUERIES), sep="\n")
        return 1
    QUERIES[args[0]](session(), args[1]).show(int(args[2]) if len(args) > 2 else 20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
