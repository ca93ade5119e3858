"""Command line: run, play (without a window) and wizard."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from stackloom.functions.names import output_folder
from stackloom.plans.pipeline import LoadError, Pipeline, process_stack
from stackloom.plans.registry import FILTERS, MASKS, PLUGINS, Step, is_step
from stackloom.plans.steps import DEFAULT_STEPS, dump_steps, literal, load_steps, parse_steps
from stackloom.sources.export import export, export_gif
from stackloom.sources.gif import annotate, grey, write_gif
from stackloom.stack import FrameStack

log = logging.getLogger("stackloom")


def session() -> SparkSession:
    return SparkSession.builder.appName("stackloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def setup_logging(level: str | int = "INFO") -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)


def chosen_steps(text: str | None, path: str | None) -> list[Step]:
    """A file goes before a text; neither is no step."""
    return load_steps(path) if path else parse_steps(text) if text else []


def run(args: argparse.Namespace) -> None:
    steps = chosen_steps(args.processing, args.processing_file)
    stack = process_stack(session(), args.input, args.channel, steps)
    formats = [f for f in (args.export or "").strip("'\"").split(",") if f.strip()]
    if formats:
        export(stack, args.output_folder, args.output_name, formats)
    export_gif(stack, args.make_gif, args.output_folder, args.output_name, args.scale_bar_nm)


class Player:
    """The viewer without a window: keys act on what is shown, frames are rendered on request."""

    def __init__(self, stack: FrameStack, steps: list[Step], folder: str | Path | None, name: str | None, bar_nm: float | None):
        self.stack, self.steps, self.folder, self.name, self.bar_nm = stack, steps or DEFAULT_STEPS, folder, name, bar_nm
        self.filtered = self.done = False
        self.applied = None
        rate = stack.frame_metadata[0].get("line_rate") if stack.n_frames else None
        self.fps = rate / stack.height if rate else 1.0
        stack.keep_raw()

    @property
    def delay_ms(self) -> int:
        return int(50 / self.fps)

    def press(self, key: str) -> None:
        """f applies the steps, space switches views, t n h g export the view, q ends."""
        if key == "f":
            if self.applied is None:
                self.applied = Pipeline(self.stack).add(self.steps).run()
            self.filtered = True
        elif key == " ":
            self.filtered = self.applied is not None and not self.filtered
        elif key in ("t", "n", "h"):
            export(self.stack, self.folder, self.name, [{"t": "tif", "n": "npz", "h": "h5"}[key]], raw=not self.filtered)
        elif key == "g":
            export_gif(self.stack, True, self.folder, self.name, self.bar_nm, raw=not self.filtered)
        elif key in ("q", "\x1b"):
            self.done = True

    def images(self) -> list:
        rows = self.applied if self.filtered else self.stack.snapshots["raw"]
        bar = 100.0 if self.bar_nm is None else self.bar_nm
        return [annotate(grey(f), i / self.fps, self.stack.pixel_size_nm, bar) for i, f in enumerate(self.stack.each_frame(rows))]


def play(args: argparse.Namespace) -> None:
    try:
        stack = FrameStack.load(session(), args.input, args.channel)
    except Exception as e:
        raise LoadError(f"can't load {args.input}: {e}") from e
    player = Player(stack, chosen_steps(args.processing, args.processing_file), args.output_folder, args.output_name, args.scale_bar_nm)
    for key in args.keys:
        player.press(key)
        if player.done:
            return
    write_gif(output_folder(args.output_folder) / "view.gif", player.images(), player.delay_ms)


HELP = """add NAME      add a step (its parameters are asked for)
remove N      remove step N
move N M      move step N to place M
list          show the steps
save FILE     write the steps as YAML
run           process and export
help, quit"""

#: What the wizard asks for, with its defaults.
ASKED = {"mask_threshold": ("threshold", 1.0), "mask_below_threshold": ("threshold", 1.0), "mask_mean_offset": ("factor", 1.0), "polynomial_flatten": ("order", 2), "gaussian_filter": ("sigma", 1.0)}


def wizard(args: argparse.Namespace, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> None:
    """Steps are numbered from 1; the end of the input leaves with code 0."""
    try:
        FrameStack.load(session(), args.input, args.channel)
    except Exception as e:
        raise LoadError(f"can't load {args.input}: {e}") from e
    steps: list[Step] = []
    while True:
        try:
            word, *rest = ask("> ").split() or [""]
            if word == "quit":
                return
            if word in ("", "help"):
                say(HELP)
            elif word == "list":
                for i, s in enumerate(steps, 1):
                    say(f"{i}. {s.name} {s.params or ''}")
            elif word == "add":
                if not is_step(rest[0]):
                    say(f"known steps: clear, {', '.join([*MASKS, *FILTERS, *PLUGINS])}")
                    continue
                params = {}
                if rest[0] in ASKED:
                    key, value = ASKED[rest[0]]
                    given = ask(f"{key} [{value}]: ").strip()
                    params[key] = literal(given) if given else value
                steps.append(Step(rest[0], params))
            elif word == "remove":
                steps.pop(_place(rest[0], steps))
            elif word == "move":
                step = steps.pop(_place(rest[0], steps))
                steps.insert(int(rest[1]) - 1, step)
            elif word == "save":
                Path(rest[0]).write_text(dump_steps(steps), encoding="utf-8")
            elif word == "run":
                stack = process_stack(session(), args.input, args.channel, steps)
                if formats := [f for f in ask("export (tif,npz,h5) []: ").split(",") if f.strip()]:
                    export(stack, args.output_folder, args.output_name, formats)
                if ask("gif? [n]: ").strip().lower().startswith("y"):
                    export_gif(stack, True, args.output_folder, args.output_name, args.scale_bar_nm)
                return
            else:
                say("help shows what can be done")
        except (IndexError, ValueError) as e:
            say(f"that doesn't work: {e}")
        except (EOFError, KeyboardInterrupt):
            sys.exit(0)


def _place(text: str, steps: list[Step]) -> int:
    n = int(text)
    if not 1 <= n <= len(steps):
        raise IndexError(f"there is no step {n}")
    return n - 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stackloom")
    top.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    sub = top.add_subparsers(dest="command")
    for name, action in (("run", run), ("play", play), ("wizard", wizard)):
        p = sub.add_parser(name)
        p.set_defaults(action=action)
        p.add_argument("input")
        p.add_argument("--channel", default="height_trace")
        p.add_argument("--output-folder")
        p.add_argument("--output-name")
        p.add_argument("--scale-bar-nm", type=float)
        if name != "wizard":
            steps = p.add_mutually_exclusive_group()
            steps.add_argument("--processing", help="name:key=value,key=value;name ...")
            steps.add_argument("--processing-file")
        if name == "run":
            p.add_argument("--export", help="of tif,npz,h5,parquet")
            p.add_argument("--make-gif", action="store_true")
        if name == "play":
            p.add_argument("--keys", default="", help="keys pressed, one after another")
    return top


def failed(error: Exception, code: int) -> None:
    log.error("%s", error)
    sys.exit(code)


def main(argv: list[str] | None = None) -> None:
    """Exit codes: 0 without a command; 1 for any error of a command and for input that can't be loaded; 2 for errors around it."""
    p = parser()
    args = p.parse_args(argv)
    try:
        setup_logging(args.log_level)
        if not args.command:
            p.print_help(sys.stderr)
            sys.exit(0)
        try:
            args.action(args)
        except Exception as e:
            failed(e, 1)
    except LoadError as e:
        failed(e, 1)
    except Exception as e:
        failed(e, 2)


if __name__ == "__main__":
    main()
