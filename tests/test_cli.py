import pytest

from barline import cli


def test_presets_are_listed(capsys):
    assert cli.main(["--list-presets"]) == 0
    assert "crypto" in capsys.readouterr().out


def test_tables_are_needed():
    with pytest.raises(SystemExit):
        cli.main([])
