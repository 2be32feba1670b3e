"""Command line: phasing with --gt, imputation with --gt and --ref, accuracy with --truth and --imputed."""

from __future__ import annotations

import argparse
import dataclasses

from .config import Config
from .session import session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgene", description=__doc__)
    p.add_argument("--truth")
    p.add_argument("--imputed")
    for f in dataclasses.fields(Config):
        flag = "--" + f.name.replace("_", "-").replace("map-path", "map")
        if isinstance(f.default, bool):
            p.add_argument(flag, dest=f.name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            kind = {"int": int, "float": float, "float | None": float}.get(f.type, str)
            p.add_argument(flag, dest=f.name, type=kind, default=None if f.default is dataclasses.MISSING else f.default)
    a = vars(p.parse_args(argv))
    truth, imputed = a.pop("truth"), a.pop("imputed")
    from .plans import run

    if truth and imputed:
        for name, table in run.evaluate(session(), truth, imputed).items():
            print(name)
            table.show(truncate=False)
        return
    if not a["gt"] or not a["out"]:
        p.error("--gt and --out are needed")
    c = Config(**a)
    print((run.impute_file if c.ref else run.phase_file)(session(), c))


if __name__ == "__main__":
    main()
