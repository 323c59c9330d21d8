"""python -m whinstone ingest | search | eval | drafts"""

from __future__ import annotations

import argparse
from dataclasses import asdict

from whinstone.engine import Engine
from whinstone.operators.retrieval import MODES, format_hits
from whinstone.session import local_session
from whinstone.sources.files import read_eval_set, write_jsonl


def main() -> None:
    parser = argparse.ArgumentParser(prog="whinstone")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--full", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--preview", type=int, default=5)
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--mode", choices=MODES, default="hybrid")
    p = sub.add_parser("eval")
    p.add_argument("--dataset", required=True)
    p.add_argument("--modes", default=",".join(MODES))
    p.add_argument("--ks", default="1,5,10")
    p.add_argument("--abstain-threshold", type=float, default=0.30)
    p.add_argument("--latency-repeats", type=int, default=1)
    p.add_argument("--latency-queries", type=int, default=0)
    p.add_argument("--bootstrap-samples", type=int, default=2000)
    p.add_argument("--out")
    p.add_argument("--json")
    p = sub.add_parser("drafts")
    p.add_argument("--out", required=True)
    p.add_argument("--limit", type=int)
    p.add_argument("--max-chars", type=int, default=6000)
    args = parser.parse_args()
    engine = Engine(local_session())
    if args.command == "ingest":
        if args.dry_run:
            engine.preview(args.preview).show(truncate=False)
        else:
            print(asdict(engine.ingest(args.full)))
    elif args.command == "search":
        for row in format_hits(engine.search([args.query], args.k, args.mode, notes=True), 160).orderBy("rank").collect():
            print(row["line"])
    elif args.command == "eval":
        rows = read_eval_set(engine.spark, args.dataset)
        ks = [int(k) for k in args.ks.split(",")]
        found = engine.evaluation(rows, args.modes.split(","), ks, args.abstain_threshold, args.latency_repeats, args.bootstrap_samples, args.latency_queries)
        text = found.report()
        if args.json:
            found.write_json(args.json)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        print(text)
    else:
        write_jsonl(engine.drafts(args.limit, args.max_chars), args.out)


if __name__ == "__main__":
    main()
