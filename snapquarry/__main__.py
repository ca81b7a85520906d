"""Command line: ``python -m snapquarry COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping, Sequence

from .api import Repo
from .config import Config
from .functions.scalars import human_size, parse_tags, parse_time
from .operators.select import Selector
from .plans.sql import render
from .session import session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("snapquarry")
    p.add_argument("--path", help="directory of the repository")
    p.add_argument("--repo", default="", help="name of a configured repository")
    p.add_argument("--version", action="version", version="snapquarry 0.1")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *aliases: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, aliases=aliases)

    c = add("init")
    c.add_argument("--name", default="")
    c.add_argument("--default", action="store_true")
    c = add("backup")
    c.add_argument("paths", nargs="+")
    c.add_argument("--event", default="")
    c.add_argument("--tag", action="append", default=[])
    c.add_argument("--kind", default="backup")
    c.add_argument("--actor")
    add("snapshots", "list", "ls-snapshots")
    for name in ("ls", "restore"):
        c = add(name)
        if name == "ls":
            c.add_argument("snapshot", nargs="?", default="")
            c.add_argument("prefix", nargs="?", default="")
        else:
            c.add_argument("dest")
            c.add_argument("-s", "--snapshot", default="")
            c.add_argument("--path", dest="prefix", default="")
        for flag in ("--at", "--event", "--before"):
            c.add_argument(flag, default="")
    add("forget").add_argument("snapshot")
    add("compact").add_argument("--threshold", type=float, default=0.5)
    add("verify").add_argument("--deep", action="store_true")
    add("query").add_argument("sql")
    c = add("config")
    c.add_argument("action", nargs="?", choices=["show", "set-default"], default="show")
    c.add_argument("name", nargs="?", default="")
    return p


def _selector(a: argparse.Namespace) -> Selector:
    return Selector(a.snapshot, parse_time(a.at) if a.at else None, a.event, parse_time(a.before) if a.before else None)


def run(args: list[str]) -> str:
    """The text that a command prints."""
    a = _parser().parse_args(args)
    if a.command == "config":
        config = Config.load()
        if a.action == "set-default":
            config.resolve(a.name)
            config.default_repo = a.name
            config.save()
        return json.dumps({"default_repo": config.default_repo, "repos": config.repos}, indent=2) + "\n"
    spark = session()
    if a.command == "init":
        Repo.init(spark, a.path)
        if a.name:
            config = Config.load()
            config.repos[a.name] = {"store": "local", "location": a.path}
            if a.default or not config.default_repo:
                config.default_repo = a.name
            config.save()
        return f"repository ready: {a.path}\n"
    path = a.path if a.command != "restore" else _repository_path(args)
    repo = Repo(spark, path or Config.load().resolve(a.repo))
    if a.command == "backup":
        s = repo.backup(a.paths, a.event, parse_tags(a.tag) or None, a.kind, a.actor)
        return _facts("backup", s, ("id", "parent", "files", "dirs", "symlinks", "total_bytes", "new_chunks", "new_bytes", "reused_chunks"))
    if a.command in ("snapshots", "list", "ls-snapshots"):
        rows = repo.list_snapshots()
        return "nothing backed up so far\n" if rows.isEmpty() else render(rows)
    if a.command == "ls":
        rows = repo.ls(_selector(a), a.prefix)
        return f"nothing at {a.prefix!r}\n" if rows.isEmpty() else render(rows)
    if a.command == "restore":
        return _facts("restore", repo.restore(a.dest, _selector(a), a.prefix), ("id", "files", "dirs", "symlinks", "bytes"))
    if a.command == "forget":
        return f"{repo.forget(a.snapshot)} is gone; its chunks go with the next compaction\n"
    if a.command == "compact":
        return _facts("compaction", repo.compact(a.threshold), ("packs_before", "packs_after", "packs_deleted", "packs_rewritten", "live_chunks", "dead_chunks", "chunks_relocated", "bytes_reclaimed"))
    if a.command == "verify":
        return _facts("verified, contents too" if a.deep else "verified", repo.verify(a.deep), ("snapshots", "files", "chunks"))
    return render(repo.sql(a.sql))


def _facts(title: str, stats: Mapping[str, object], names: Sequence[str]) -> str:
    """A title and a line for each known figure; bytes in larger units."""
    lines = [title]
    for name in names:
        value = stats[name]
        if "bytes" in name:
            value = human_size(max(0, int(value)))
        if value not in ("", None):
            lines.append(f"{name.replace('_', ' '):>17}  {value}")
    return "\n".join(lines) + "\n"


def _repository_path(args: list[str]) -> str | None:
    """``--path`` before the command names the repository, after ``restore`` the subtree."""
    before = args[: args.index("restore")]
    return before[before.index("--path") + 1] if "--path" in before else None


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
    except (RuntimeError, LookupError, ValueError, OSError) as error:
        sys.stderr.write(f"Error: {error}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
