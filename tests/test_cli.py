import pytest

from siltlog.cli import Command, ParseError, Shell, execute, parse
from siltlog.schema import UNBOUNDED, Bound
from siltlog.store import Store
from siltlog.streaming import Channels


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("put a b", Command("basic", "put", ("a", "b"))),
        ("  put 😀 v\tmore", Command("basic", "put", ("😀", "v"))),
        ("get k trailing words", Command("basic", "get", ("k",))),
        ("delete k", Command("basic", "delete", ("k",))),
        ("fill (a,b) ( c , d )", Command("basic", "fill", ((("a", "b"), ("c", "d")),))),
        ("fill", Command("basic", "fill", ((),))),
        ("fill (a,b) (c,) (e,f)", Command("basic", "fill", ((("a", "b"),),))),
        ("scan in:a ex:b", Command("basic", "scan", (Bound(b"a"), Bound(b"b", False)))),
        ("keys unbounded unbounded", Command("basic", "keys", (UNBOUNDED, UNBOUNDED))),
        ("show filesXYZ", Command("show", "files")),
        ("profile get k", Command("basic", "get", ("k",), True)),
        ("channel show", Command("channel", "show")),
        ("channel add n", Command("channel", "add", ("n",))),
        ("channel pub n a b", Command("channel", "pub", ("n", ("a", "b")))),
        ("channel sub n", Command("channel", "sub", ("n",))),
        ("channel prevmsg-sub n", Command("channel", "prevmsg-sub", ("n",))),
        ("exit", Command("control", "exit")),
    ],
)
def test_commands(line, want):
    assert parse(line) == want


@pytest.mark.parametrize("line", ["nope", "put a", "get", "scan a b", "fill (a b)", "profile show files", "show x", "channel", "channel pub"])
def test_errors_point_at_their_place(line):
    with pytest.raises(ParseError, match="expected"):
        parse(line)


def test_a_session(spark, tmp_path, capsys):
    store, channels = Store(spark, "file://" + str(tmp_path / "s")), Channels(spark, "file://" + str(tmp_path / "c"))
    shell = Shell(store, channels)
    for line in ["put a 1", "fill (b,2) (c,3)", "delete b", "scan unbounded unbounded", "keys in:b unbounded", "profile get a", "get zz", "show options", "show memtable", "show files", "channel pub n x", "channel show", "nonsense", ""]:
        assert not shell.onecmd(line)
    out = capsys.readouterr().out
    assert "a\t1\nc\t3" in out and "filter_num" in out and "compaction.multiplier\t4" in out and "n\n" in out and "expected" in out
    store.flush()
    said = []
    for line in ["show sstable", "show level", "show memtable"]:
        execute(parse(line), store, channels, said.append)
    assert said[2] == "None" and said[1].startswith("0\t[")
    assert shell.onecmd("exit") and shell.completenames("ch") == ["channel"]
