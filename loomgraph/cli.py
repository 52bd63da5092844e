"""Command line: generate, stats, visual, diff, ask, impact and watch."""

from __future__ import annotations

import argparse
import sys
import tempfile

from .operators import aggregate
from .plans import tools
from .plans.generate import generate, ranked_nodes, scan
from .render import RENDERERS, SUFFIXES, html
from .session import local_session
from .sources.diff import git_diff
from .sources.files import Config, source_files
from .streaming.feed import change_feed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options) -> None:
        c = sub.add_parser(name)
        for args, kw in options:
            c.add_argument(*args, **kw)
        c.add_argument("--root", default=".")

    out = (("--output",), {"default": ""})
    depth = (("--depth",), {"type": int, "default": 2})
    command("generate", (("--format",), {"choices": [*RENDERERS, "all"], "default": "markdown"}), (("--max-tokens",), {"type": int}), (("--around",), {}), (("--hot",), {"action": "store_true"}), (("--narrate",), {"action": "store_true"}), depth, out)
    command("stats")
    command("visual", (("--max-nodes",), {"type": int, "default": 2000}), out)
    command("diff", (("ref",), {}), depth)
    command("ask", (("question",), {}))
    command("impact", (("name",), {}), depth)
    command("watch")
    return p


def _put(text: str, path: str) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session()
    if a.command == "generate":
        for kind in RENDERERS if a.format == "all" else [a.format]:
            path = a.output + SUFFIXES[kind] if a.output and a.format == "all" else a.output
            _put(generate(spark, a.root, kind, a.max_tokens, a.around, a.depth, a.hot, a.narrate), path)
        return 0
    if a.command == "watch":
        return watch(spark, a.root)
    g = scan(spark, a.root, Config.load(a.root))
    if a.command == "stats":
        row = aggregate.stats(g.symbols, g.edges, g.data_models).head().asDict()
        print("\n".join(f"{k}: {v}" for k, v in row.items()))
    elif a.command == "visual":
        nodes, _ = ranked_nodes(g)
        _put(html.page(nodes, g.edges, max_nodes=a.max_nodes), a.output)
    elif a.command == "diff":
        changed, affected = tools.diff_report(g, git_diff(spark, a.root, a.ref), a.depth)
        print(tools.format_report(changed, affected, g.symbols))
    elif a.command == "ask":
        print(tools.answer(g, a.question))
    else:
        print(tools.impact_text(g, a.name, a.depth))
    return 0


def watch(spark, root: str, on_update=print, once: bool = False) -> int:
    """Follows a tree and makes the graph anew from what changed, until the query ends."""
    from .plans.generate import refresh

    config = Config.load(root)
    state = {"graph": scan(spark, root, config)}

    def update(batch, number: int) -> None:
        paths = sorted({r.path for r in batch.select("path").collect()})
        if paths:
            state["graph"] = refresh(state["graph"], source_files(spark, root, config))
            on_update(paths)

    writer = change_feed(spark, root, config.exclude_patterns).writeStream.foreachBatch(update).option("checkpointLocation", tempfile.mkdtemp(prefix="loomgraph-watch-"))
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    query.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
