"""python -m kinweave.cli status|next|run [STAGE]|doctor --root FOLDER --records PATH [--smoke]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.linkage import SMOKE, STAGES
from .plans.stages import Chain, Store, doctor, file_identity
from .session import ship


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["status", "next", "run", "doctor"])
    parser.add_argument("stage", nargs="?")
    parser.add_argument("--root")
    parser.add_argument("--records", help="Parquet with entity_id, country, source, raw_name, raw_address, owner_id")
    parser.add_argument("--smoke", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    ship(spark)
    if args.command == "doctor":
        print(json.dumps(doctor(spark), indent=2))
        return 0
    if not args.root or not args.records:
        parser.error("--root and --records are needed")
    chain = Chain(Store(spark, args.root), STAGES, {"records": spark.read.parquet(args.records)}, {"records": file_identity(spark, args.records)}, SMOKE if args.smoke else {})
    if args.command == "status":
        for name, print_, done in chain.status():
            print(name, print_, "done" if done else "-")
    elif args.command == "next":
        print(chain.next() or "all done")
    elif args.stage:
        print("ran" if chain.run(args.stage) else "was done")
    else:
        print("ran", *chain.run_all())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
