"""Print the formatted physical plan of registered queries.

usage: python scripts/show_plan.py [sf_dir] name [name ...]
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagemark.plans import registry  # noqa: E402
from pagemark.session import local_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    spark = local_session()
    qs = registry.queries()
    for name in args:
        print(f"== {name} ==")
        qs[name](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
