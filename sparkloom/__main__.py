"""python -m sparkloom EXPERIMENT... [--stage NAME] [--from NAME] [--force] [key=value ...].

EXPERIMENT is a settings file or one of the package's: baseline_naive, standard, fair, no_filter; ``all`` runs these four.
"""

from __future__ import annotations

import argparse
import sys

from .config import load_config
from .pipeline import Stage, run_pipeline
from .session import local_session

EXPERIMENTS = ("baseline_naive", "standard", "fair", "no_filter")


def main(argv: list[str] | None = None) -> int:
    names = [s.name.lower() for s in Stage]
    parser = argparse.ArgumentParser(prog="sparkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", nargs="+", help="experiments, then key=value settings")
    parser.add_argument("--stage", choices=names, help="run this stage alone")
    parser.add_argument("--from", dest="start", choices=names, help="run from this stage on")
    parser.add_argument("--force", action="store_true", help="run stages whose tables are there, too")
    args = parser.parse_args(argv)
    overrides = [w for w in args.what if "=" in w]
    wanted = [w for w in args.what if "=" not in w]
    stage = lambda name: Stage[name.upper()] if name else None
    failed = False
    for name in EXPERIMENTS if wanted == ["all"] else wanted:
        results = run_pipeline(local_session(), load_config(name, overrides), stage(args.start), stage(args.stage), force=args.force)
        failed |= any(r.status == "failed" for r in results.values())
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
