"""Exit codes and output of the command line."""

import json

import pytest

from runeframe import cli
from runeframe.sources.transcriptions import SECTIONS

LETTERS = """Guild: Orchard Keepers
Channel: Letters

[5/6/2016 8:00 AM] finch
dear gardener, the owls are back

[5/6/2016 8:40 AM] wren (pinned)
they sit over ᛟᚹᛚᛖᛏ
"""


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("letters")
    (folder / "in").mkdir()
    (folder / "in" / "letters.txt").write_text(LETTERS, encoding="utf-8")
    assert cli.main(["index", str(folder / "in"), str(folder / "out")]) == 0
    return str(folder / "out")


@pytest.fixture
def run(index, capsys):
    def one(*args):
        capsys.readouterr()
        code = cli.main(["search", index, *args])
        return code, capsys.readouterr().out

    return one


def test_text_search_prints_blocks(run):
    code, out = run("owls")
    assert code == 0 and "> 4 2016-05-06 08:00 finch: dear gardener, the owls are back" in out and "  7 2016-05-06 08:40 wren" in out
    assert run("griffins") == (0, "no hits\n")


def test_json_holds_what_was_searched(run):
    code, out = run("owls", "--json", "--full")
    found = json.loads(out)
    assert code == 0 and (found["query"], found["searched"], found["hits"]) == ("owls", "owls", 1)
    [talk] = found["conversations"]
    assert (talk["channel"], talk["channel_name"], talk["file"]) == ("letters", "Letters", "letters.txt") and len(talk["messages"]) == 2
    assert json.loads(run("owls (", "--json")[1])["searched"] == '"owls"'


def test_sequence_search_and_channels(run):
    code, out = run("--runes", "OE-W-L")
    assert code == 0 and "wren" in out and "runic" in out
    code, out = run("--channels")
    assert code == 0 and "2 letters" in out


BAD = [["owls", "--limit", "-3"], ["owls", "--window", "-2"], ["owls", "--chars", "0"], ["owls", "--until", "2016-13"], ["owls", "--runes", "5 6 7"], ["--runes", "OE-W"], ["--runes", "567"], ["?!"], ["lamp-post"], []]


@pytest.mark.parametrize("args", BAD)
def test_bad_questions_end_with_two(index, args):
    assert cli.main(["search", index, *args]) == 2


def test_missing_places(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere")
    assert cli.main(["index", nowhere, str(tmp_path / "out")]) == 1 and cli.main(["search", nowhere, "owls"]) == 2


def test_log(spark, tmp_path, capsys):
    columns = [c.split()[0] for c in SECTIONS.split(", ")]
    (tmp_path / "sections.csv").write_text(",".join(columns) + "\n" + ",".join(["4.1", "", "0"] + [""] * (len(columns) - 3)) + "\n", encoding="utf-8")
    log, known = ["log", str(tmp_path / "log.jsonl")], ["--sections", str(tmp_path / "sections.csv")]
    assert cli.main([*log, "list"]) == 0 and "no entries" in capsys.readouterr().out
    assert cli.main([*log, "add", "--section", "4.2", *known]) == 2
    assert cli.main([*log, "add", "--section", "4.1", "--method", "rail fence", *known]) == 0
    assert cli.main([*log, "add", "--section", "4.5", "--sections", "4.4,4.5"]) == 0
    capsys.readouterr()
    assert cli.main([*log, "search", "Rail"]) == 0
    assert [line[:2] for line in capsys.readouterr().out.splitlines() if line.startswith("#")] == ["#1"]


def test_verify(spark, capsys):
    assert cli.main(["verify"]) == 0 and "FAIL" not in capsys.readouterr().out
