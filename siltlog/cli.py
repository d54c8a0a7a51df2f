"""The command language, and a loop that carries it out on a store and its channels.

    put K V | delete K | get K | fill (K,V) (K,V) ... | scan LOW HIGH | keys LOW HIGH
    show memtable|sstable|level|options|files | profile COMMAND
    channel show | channel add N | channel pub N V ... | channel sub N | channel prevmsg-sub N
    exit | clear

LOW and HIGH are ``unbounded``, ``in:KEY`` or ``ex:KEY``. Words are runs of characters other than
space and tab. What follows a complete command is ignored.
"""

from __future__ import annotations

import cmd
import re
import time
import uuid
from dataclasses import dataclass

from .introspect import SHOWS, Profile, profile_read, profile_write
from .schema import UNBOUNDED, Bound
from .store import Store
from .streaming import Channels

WORD, GAP = re.compile(r"[^ \t]+"), re.compile(r"[ \t]+")
IN_PAIR = re.compile(r"[^ \t(),]+")
# The words of the language, all of which Tab completes.
BASIC = ("put", "delete", "get", "fill", "scan", "keys")
CHANNEL = ("show", "add", "pub", "sub", "prevmsg-sub")
CONTROL = ("exit", "clear")
BOUNDS = ("unbounded", "in:", "ex:")
COMPLETIONS = [*dict.fromkeys([*BASIC, "show", *SHOWS, "profile", "channel", *CHANNEL, *BOUNDS, *CONTROL])]


#: Lines that the prompt remembers.
HISTORY = 1000


class ParseError(ValueError):
    """What is wrong, and at which character."""

    def __init__(self, text: str, at: int, wanted: str):
        super().__init__(f"{text}\n{' ' * at}^ {wanted} expected")
        self.at, self.wanted = at, wanted


@dataclass(frozen=True)
class Command:
    """``family`` is basic, show, channel or control."""

    family: str
    op: str
    args: tuple = ()
    profile: bool = False


class Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, pattern: re.Pattern, wanted: str) -> str:
        m = pattern.match(self.text, self.at)
        if not m:
            raise ParseError(self.text, self.at, wanted)
        self.at = m.end()
        return m.group()

    def word(self, wanted: str) -> str:
        self.take(GAP, "a space")
        return self.take(WORD, wanted)

    def choice(self, options: list[str], wanted: str) -> str:
        """A keyword at the start of the next word; more characters may follow it."""
        self.take(GAP, "a space")
        for o in sorted(options, key=len, reverse=True):
            if self.text.startswith(o, self.at):
                self.at += len(o)
                return o
        raise ParseError(self.text, self.at, wanted)

    def bound(self) -> Bound:
        at = GAP.match(self.text, self.at)
        word = self.word("a bound")
        if word.startswith("unbounded"):
            return UNBOUNDED
        if word[:3] in ("in:", "ex:"):
            return Bound(word[3:].encode(), word[:3] == "in:")
        raise ParseError(self.text, at.end(), "unbounded, in:KEY or ex:KEY")

    def pairs(self) -> list[tuple[str, str]]:
        """Pairs up to the first that is malformed; a key without a comma after it is an error."""
        out = []
        while m := re.compile(r"[ \t]+\([ \t]*([^ \t(),]+)[ \t]*").match(self.text, self.at):
            if not self.text.startswith(",", m.end()):
                raise ParseError(self.text, m.end(), "a comma")
            rest = re.compile(r",[ \t]*([^ \t(),]+)[ \t]*\)").match(self.text, m.end())
            if not rest:
                break
            out.append((m[1], rest[1]))
            self.at = rest.end()
        return out


def parse(line: str) -> Command:
    text = line.rstrip("\r\n")
    r = Reader(text)
    r.at = len(text) - len(text.lstrip())
    start = r.at
    head = r.take(WORD, "a command") if r.at < len(text) else ""
    if head in BASIC:
        return basic(r, head)
    if head == "profile":
        at = r.at
        inner = r.word("a command")
        if inner not in BASIC:
            raise ParseError(text, at + 1, "one of " + ", ".join(BASIC))
        c = basic(r, inner)
        return Command(c.family, c.op, c.args, True)
    if head == "show":
        return Command("show", r.choice(list(SHOWS), "one of " + ", ".join(SHOWS)))
    if head == "channel":
        op = r.choice(list(CHANNEL), "show, add, pub, sub or prevmsg-sub")
        if op == "show":
            return Command("channel", op)
        name = r.word("a channel's name")
        if op != "pub":
            return Command("channel", op, (name,))
        values = []
        while GAP.match(text, r.at) and WORD.match(text, GAP.match(text, r.at).end()):
            values.append(r.word("a value"))
        return Command("channel", op, (name, tuple(values)))
    if head in CONTROL:
        return Command("control", head)
    raise ParseError(text, start, "a command")


def basic(r: Reader, op: str) -> Command:
    if op == "put":
        return Command("basic", op, (r.word("a key"), r.word("a value")))
    if op in ("get", "delete"):
        return Command("basic", op, (r.word("a key"),))
    if op == "fill":
        return Command("basic", op, (tuple(r.pairs()),))
    return Command("basic", op, (r.bound(), r.bound()))


def shown(value: bytes) -> str:
    """Text where it is UTF-8, else hexadecimal."""
    try:
        return value.decode()
    except UnicodeDecodeError:
        return value.hex(" ")


def execute(c: Command, store: Store, channels: Channels, say=print) -> Profile | None:
    """Carry the command out; the profile of what it took, for commands on keys."""
    profile = None
    if c.family == "show":
        rows = SHOWS[c.op](store).collect()
        say("\n".join("\t".join(map(str, r)) for r in rows) or "None")
    elif c.family == "channel":
        channel_command(c, channels, say)
    elif c.op in ("put", "fill", "delete"):
        pairs = [c.args] if c.op == "put" else list(c.args[0]) if c.op == "fill" else [(c.args[0], "")]
        _, profile = profile_write(store, c.op, [(k.encode(), v.encode()) for k, v in pairs], (lambda: store.delete(c.args[0])) if c.op == "delete" else (lambda: store.fill(pairs)))
        say("ok")
    elif c.op == "get":
        end = Bound.at(c.args[0])
        rows, profile = profile_read(store, c.op, end, end)
        say(shown(bytes(rows[0]["value"])) if rows else "None")
    else:
        rows, profile = profile_read(store, c.op, *c.args, keys_only=c.op == "keys")
        say("\n".join(shown(bytes(r["key"])) + ("" if c.op == "keys" else "\t" + shown(bytes(r["value"]))) for r in rows) or "None")
    if c.profile and profile:
        say(profile.text())
    return profile


def channel_command(c: Command, channels: Channels, say) -> None:
    if c.op == "show":
        say("\n".join(channels.show()) or "None")
    elif c.op == "add":
        channels.add(c.args[0])
        say("ok")
    elif c.op == "pub":
        channels.publish(c.args[0], list(c.args[1]))
        say("ok")
    else:
        query = channels.subscribe(c.args[0], lambda some: say("\n".join(shown(p) for _, p in some)), previous=c.op == "prevmsg-sub")
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()


class Shell(cmd.Cmd):
    """The interactive loop; Tab completes the commands' words."""

    prompt = "silt> "

    def __init__(self, store: Store, channels: Channels):
        super().__init__()
        self.store, self.channels = store, channels

    def onecmd(self, line: str) -> bool:
        if line == "EOF" or not line.strip():
            return line == "EOF"
        try:
            c = parse(line)
            if c.family == "control":
                if c.op == "clear":
                    print("\033[2J\033[H", end="")
                return c.op == "exit"
            began, profile = time.monotonic(), execute(c, self.store, self.channels)
            print(f"{profile.query_id if profile else uuid.uuid4()}  {time.monotonic() - began:.3f} s")
        except KeyboardInterrupt:  # ends the command, not the shell
            print("stopped")
        except (ParseError, ValueError, FileExistsError) as e:
            print(e)
        return False

    def completenames(self, text: str, *_) -> list[str]:
        return [w for w in COMPLETIONS if w.startswith(text)]

    completedefault = completenames


def main(root: str) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("siltlog").getOrCreate()
    shell = Shell(Store(spark, root), Channels(spark, root + "/channels"))
    try:
        import readline

        readline.set_history_length(HISTORY)
        readline.set_completer_delims(" \t")
    except ImportError:  # no line editing on this platform
        pass
    while True:
        try:
            return shell.cmdloop()
        except KeyboardInterrupt:  # at the prompt: a new line
            print()
