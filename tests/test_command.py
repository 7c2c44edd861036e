import subprocess

import pytest

from quarryline import __main__ as command
from quarryline import settings


def _tree(folder):
    (folder / "a.py").write_text("def f(x):\n    return x == x\n\n\ndef g(y):\n    return y  # TODO\n")
    (folder / "note.txt").write_text("no source\n")
    return str(folder)


def test_findings_and_exit_codes(spark, tmp_path, capsys):
    root = _tree(tmp_path)
    assert command.main([root, "--no-config", "--cut=2"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert sorted(out) == [f"{root}/a.py:2    identical_operands (high)", f"{root}/a.py:6    stub_marker (high)"]
    assert command.main([f"{root}/a.py", root, "--no-config", "--cut", "2", "--check", "--format=github"]) == 1
    out = capsys.readouterr().out.splitlines()
    assert f"::error file={root}/a.py,line=2,title=identical_operands::identical_operands (high)" in out and len(out) == 2
    (tmp_path / settings.NAME).write_text("cut = 2\n[rules]\nidentical_operands = false\nstub_marker = false\n")
    assert command.main([root, "--check"]) == 0
    assert capsys.readouterr().out == "No findings.\n"


def test_changed_lines_only(spark, tmp_path, capsys):
    root = _tree(tmp_path)
    git = lambda *args: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=n@example.org", *args], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "a.py").write_text((tmp_path / "a.py").read_text().replace("y == y", "y").replace("# TODO", "# TODO more"))
    assert command.main([root, "--no-config", "--cut=2", "--base=HEAD"]) == 0
    assert [x.split()[1] for x in capsys.readouterr().out.splitlines()] == ["stub_marker"]
    assert command.main([root, "--no-config", "--base=nothing"]) == 1


@pytest.mark.parametrize("argv", [[], ["no/such"], ["--what", "."], [".", "--cut=x"], [".", "--format=html"], [".", "--config=none.toml"], [".", "--config=a", "--no-config"], ["README.md"]])
def test_usage(argv, capsys):
    assert command.main(argv) == 1
    assert capsys.readouterr().err.startswith("quarryline: ")


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "user"))
    assert settings.discover([str(tmp_path)]) == settings.Settings()
    (tmp_path / "user" / "quarryline").mkdir(parents=True)
    (tmp_path / "user" / "quarryline" / "config.toml").write_text("cut = 0.5\n[bands]\ncyclomatic = [3, 4]\n")
    (tmp_path / settings.NAME).write_text("[bands]\ncyclomatic = [5, 6]\nmisplaced = [1, 2]\n[rules]\nnpath = true\n[clones]\nmin_size = 4\n")
    got = settings.discover([str(tmp_path)])
    assert (got.cut, got.bands, got.rules, got.clones["min_size"]) == (0.5, {"cyclomatic": (5, 6), "misplaced": (1, 2)}, {"npath": True}, 4)
    for data in ({"strange": 1}, {"bands": {"strange": [1, 2]}}, {"rules": {"strange": True}}, {"clones": {"strange": 1}}):
        with pytest.warns(UserWarning, match="strange"):
            assert settings.overlay(settings.Settings(), data, "here") == settings.Settings()
    for data in ({"cut": "x"}, {"cut": True}, {"bands": 3}, {"bands": {"npath": [1]}}, {"bands": {"npath": [1, 2.5]}}, {"rules": {"npath": 1}}, {"clones": {"min_size": 1.5}}):
        with pytest.raises(settings.SettingsError, match="here"):
            settings.overlay(settings.Settings(), data, "here")
