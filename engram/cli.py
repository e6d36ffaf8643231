"""Command line: ``python -m engram.cli recent | admin | import-jsonl | doctor``.

Results go to standard output, what went wrong to standard error.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession

from engram import doctor
from engram.config import ConfigError, Settings
from engram.errors import BusyError, EngramError, StoreError
from engram.functions.embedding import HashingEmbedder
from engram.operators.scan import limit_in
from engram.schemas import RECENT_DEFAULT, RECENT_MAX
from engram.service import MemoryService
from engram.session import session
from engram.sources.importer import Importer
from engram.sources.store import Store

#: What the process ends with. Wrong usage ends with 2, as argparse has it.
DONE, FAILED, UNAVAILABLE, MISCONFIGURED = 0, 1, 3, 4
WIDTH = 120


def _limit(text: str) -> int:
    try:
        return limit_in(int(text), RECENT_MAX)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="engram", description="Memories on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    recent = commands.add_parser("recent", help="the newest memories")
    recent.add_argument("--limit", type=_limit, default=RECENT_DEFAULT)
    admin = commands.add_parser("admin", help="undo or finish a deletion").add_subparsers(dest="operation", required=True)
    for name, said in (("restore", "bring back a forgotten memory within its grace period"), ("hard-delete", "remove a memory for good")):
        admin.add_parser(name, help=said).add_argument("memory_id")
    commands.add_parser("import-jsonl", help="import an export file").add_argument("path")
    commands.add_parser("doctor", help="check the installation")
    return top


def _one_line(text: str) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= WIDTH else flat[: WIDTH - 3] + "..."


class _Run:
    def __init__(self, spark: SparkSession, settings: Settings, now_ms: Callable[[], int]) -> None:
        self.spark, self.settings, self.now_ms = spark, settings, now_ms

    def service(self) -> MemoryService:
        return MemoryService(Store(self.spark, self.settings.store), brain_id=self.settings.brain_id, clock=self.now_ms, tz=self.settings.tz)

    def recent(self, args: argparse.Namespace) -> int:
        rows = self.service().recent(limit=args.limit)
        for r in rows:
            print(f"{r['timeline_day']}  {r['memory_id']}  [{r['catalog']}]  importance={r['importance']}  {r['topic']}: {_one_line(r['summary'])}")
        if not rows:
            print("nothing remembered here so far")
        return DONE

    def admin(self, args: argparse.Namespace) -> int:
        service = self.service()
        act = service.restore if args.operation == "restore" else service.hard_delete
        found = act(args.memory_id, agent_id="cli")
        if not found["ok"]:
            print(f"{args.memory_id}: {found['reason']}", file=sys.stderr)
            return FAILED
        print(f"{args.operation} {args.memory_id}" + (f", expires {found['expires_at']}" if "expires_at" in found else ""))
        return DONE

    def import_jsonl(self, args: argparse.Namespace) -> int:
        service = self.service()  # registers the profile
        print(Importer(service.store, embedder=service.embedder, profile_id=service.profile_id, tz=self.settings.tz).import_file(args.path, now_ms=self.now_ms()).line())
        return DONE

    def doctor(self, args: argparse.Namespace) -> int:
        items = doctor.examine(self.spark, self.settings, HashingEmbedder())
        for i in items:
            print(f"{i.state:4}  {i.name}: {i.said}")
        return FAILED if any(i.state == doctor.FAIL for i in items) else DONE


def main(argv: list[str] | None = None, *, spark: SparkSession | None = None, env: Mapping[str, str] | None = None, now_ms: Callable[[], int] | None = None) -> int:
    args = _arguments().parse_args(argv)
    try:
        settings = Settings.of(env)
    except ConfigError as e:
        print(f"engram: {e}", file=sys.stderr)
        return MISCONFIGURED
    run = _Run(spark or session(), settings, now_ms or (lambda: int(time.time() * 1000)))
    try:
        return getattr(run, args.command.replace("-", "_"))(args)
    except (BusyError, StoreError) as e:
        print(f"engram: {e}", file=sys.stderr)
        return UNAVAILABLE
    except (EngramError, FileNotFoundError) as e:
        print(f"engram: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
