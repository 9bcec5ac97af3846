"""The textual commands: parsing, execution and printed results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from siltstone.errors import EngineError, StorageError
from siltstone.sources.documents import DocumentStore
from siltstone.sources.store import Delete, Put, Store

#: Rows that a search command prints at most.
SEARCH_LIMIT = 100

#: How each command is to be used. These lines and the answers below are what callers
#: of the commands read (fixed values).
USAGE = {
    "SET": "SET <key> <value>",
    "GET": "GET <key>",
    "DELETE": "DELETE <key>",
    "BATCH": "BATCH (SET <key> <value> | DELETE <key>)...",
    "DOC": "DOC PUT <id> <text> | DOC GET <id> | DOC DELETE <id>",
    "FTS": "FTS AND|OR <query> | FTS RANK AND|OR <query>",
    "EXIT": "EXIT",
}


class ParseError(EngineError):
    """A line that is no command; the text is what is printed."""


@dataclass(frozen=True)
class Command:
    name: str
    args: tuple = field(default=())


_TOKEN = re.compile(
    r"""
      "(?P<double>(?:\\.|[^"\\])*)"
    | '(?P<single>(?:\\.|[^'\\])*)'
    | (?P<bare>[^\s"']+)
    | (?P<open>["'])
    """,
    re.X | re.S,
)


def split_line(line: str) -> list[str]:
    """Tokens of a line.

    Either quote groups a token, and a backslash within quotes takes the next
    character as it is. A quote ends the bare token before it; empty quotes are an
    empty token.
    """
    out = []
    for m in _TOKEN.finditer(line):
        kind = m.lastgroup
        if kind == "open":
            raise ParseError("ERR unterminated quoted value")
        out.append(m.group(kind) if kind == "bare" else re.sub(r"\\(.)", r"\1", m.group(kind), flags=re.S))
    return out


def _usage(name: str) -> ParseError:
    return ParseError(f"ERR usage: {USAGE[name]}")


def _batch(words: list[str]) -> Command:
    ops, left = [], list(words)
    while left:
        word = left.pop(0).upper()
        need = {"SET": 2, "DELETE": 1}.get(word)
        if need is None or len(left) < need:
            raise _usage("BATCH")
        args = [left.pop(0).encode() for _ in range(need)]
        ops.append(Put(*args) if word == "SET" else Delete(*args))
    if not ops:
        raise _usage("BATCH")
    return Command("BATCH", tuple(ops))


def _search(words: list[str]) -> Command:
    if not words:
        raise _usage("FTS")
    mode = words[0].upper()
    if mode == "RANK":
        if len(words) != 3 or words[1].upper() not in ("AND", "OR"):
            raise _usage("FTS")
        return Command("RANK", (words[1].upper() == "AND", words[2]))
    if mode not in ("AND", "OR") or len(words) < 2:
        raise _usage("FTS")
    return Command("SEARCH", (mode == "AND", " ".join(words[1:])))


def parse(line: str) -> Command | None:
    """The command of a line, None for a blank one. Keywords may be in any case."""
    words = split_line(line)
    if not words:
        return None
    name, args = words[0].upper(), words[1:]
    fixed = {"SET": ("SET", 2), "GET": ("GET", 1), "DELETE": ("DELETE", 1), "DEL": ("DELETE", 1)}
    if name in fixed:
        name, need = fixed[name]
        if len(args) != need:
            raise _usage(name)
        return Command(name, tuple(a.encode() for a in args))
    if name == "BATCH":
        return _batch(args)
    if name == "DOC":
        need = {"PUT": 3, "GET": 2, "DELETE": 2}.get(args[0].upper() if args else "")
        if need != len(args):
            raise _usage("DOC")
        return Command("DOC " + args[0].upper(), tuple(args[1:]))
    if name == "FTS":
        return _search(args)
    if name in ("EXIT", "QUIT"):
        return Command("EXIT")
    raise ParseError(f"ERR unknown command: {words[0]}")


def escaped(text: str) -> str:
    """Printable ASCII stays; controls, quotes and all else are written as escapes."""
    short = {"\t": r"\t", "\r": r"\r", "\n": r"\n", "'": r"\'", '"': r"\"", "\\": r"\\"}
    return "".join(
        short.get(c) or (c if " " <= c <= "~" else f"\\u{{{ord(c):x}}}") for c in text
    )


def execute(engine: Store | DocumentStore, command: Command) -> str:
    """Run a command and give what is printed for it."""
    name, args = command.name, command.args
    documents = name.startswith("DOC") or name in ("SEARCH", "RANK")
    if documents and not isinstance(engine, DocumentStore):
        raise StorageError("this engine keeps no documents: DOC and FTS are unsupported")
    if name == "SET":
        engine.put(*args)
        return "OK"
    if name == "GET":
        value = engine.get(*args)
        return "(nil)" if value is None else value.decode("utf-8", "replace")
    if name == "DELETE":
        engine.delete(*args)
        return "OK"
    if name == "BATCH":
        engine.write_batch(list(args))
        return "OK"
    if name == "DOC PUT":
        engine.put_document(args[0], args[1].encode())
        return "OK"
    if name == "DOC GET":
        value = engine.get_document(args[0])
        return "(nil)" if value is None else escaped(value.decode("utf-8", "replace"))
    if name == "DOC DELETE":
        engine.delete_document(args[0])
        return "OK"
    if name == "SEARCH":
        hits = engine.search([args[1]], every=args[0], limit=SEARCH_LIMIT).collect()
        lines = [f"{escaped(h['doc_id'])}\t{escaped(h['document'])}" for h in hits]
        return "\n".join(lines) or "(no results)"
    if name == "RANK":
        hits = engine.search_ranked([args[1]], every=args[0], limit=SEARCH_LIMIT).collect()
        lines = [f"{h['score']:.6f}\t{escaped(h['doc_id'])}\t{escaped(h['document'])}" for h in hits]
        return "\n".join(lines) or "(no results)"
    return "bye"


def respond(engine: Store | DocumentStore, line: str) -> str | None:
    """What is printed for a line, errors included; None for a blank line."""
    try:
        command = parse(line)
        return None if command is None else execute(engine, command)
    except ParseError as e:
        return str(e)
    except EngineError as e:
        return f"ERR {e}"
