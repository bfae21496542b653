"""python -m koewake run|clear|status|postprocess|fix|export"""

from __future__ import annotations

import argparse
import sys

from koewake.engine import Engine, event
from koewake.operators import convert
from koewake.session import build_session
from koewake.sources.registry import load_dotenv


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="koewake")
    top.add_argument("--home", default=".koewake", help="where cache and registry are kept")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("run", "status", "postprocess", "fix", "export", "clear"):
        c = commands.add_parser(name)
        if name != "clear":
            c.add_argument("dir", nargs="?", default="")
        else:
            c.add_argument("--dirs", action="store_true", help="forget the registered directories too")
        if name in ("run", "export"):
            c.add_argument("--output", default="./output")
            c.add_argument("--speaker", default="heroine")
            c.add_argument("--language", default="ja")
        if name == "run":
            c.add_argument("--concurrency", type=int, default=3)
            c.add_argument("--fix", action="store_true")
            c.add_argument("--hint", default="", help="language that the recogniser is told to expect")
            c.add_argument("--rate", type=float, default=None, help="calls that may begin in a second")
        if name == "fix":
            c.add_argument("--dry-run", action="store_true")
    a = top.parse_args(argv)
    load_dotenv(".env")
    ffmpeg = convert.FFmpeg()
    engine = Engine(build_session(), a.home, converter=ffmpeg if ffmpeg.available() else None)
    engine.progress = lambda what: print(event("progress", what), end="", file=sys.stderr)
    where = getattr(a, "dir", "") or (engine.registry.first() or "" if a.command in ("run", "fix") else "")
    if a.command == "run":
        engine.process(where, a.fix, a.concurrency, a.output, a.speaker, a.language, a.hint, a.rate).show(truncate=False)
    elif a.command == "status":
        engine.stats(where).show(truncate=False)
        engine.emotion_report(where).show(truncate=False)
    elif a.command == "postprocess":
        engine.postprocess(where).show(truncate=False)
        for report in engine.filtered_report(where, 15):
            report.show(truncate=False)
    elif a.command == "fix":
        (engine.plan_fixes if a.dry_run else engine.fix)(where).show(truncate=False)
    elif a.command == "export":
        print(engine.export(a.output, where, a.speaker, a.language) or "nothing to export")
    else:
        print(f"{engine.clear(a.dirs)} rows deleted")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
