"""Every command on the game movie."""

import pytest

from bytelens import cli

from .fixtures import game_block, movie


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("cli") / "game.swf"
    p.write_bytes(movie(game_block()))
    return str(p)


@pytest.mark.parametrize(
    "args,parts",
    [
        (["info"], ["classes: 5", "blocks: 1", "version 40"]), (["tags"], ["DoABC2", "symbol 0 = Main"]), (["classes", "-s", "GAME"], ["com.game.Player", "3 classes"]),
        (["classes", "-i", "-v"], ["IDrawable", "1 classes"]), (["class", "Player"], ["score:int", "attack(int):void"]), (["strings", "-c"], ["Score: 0", "hud.png"]),
        (["strings", "-s", "attack", "-v"], ["com.game.Player.attack"]), (["refs", "Entity"], ["instantiation", "com.ui.HUD.render"]), (["callers", "trace"], ["Player.attack", "2 edges"]),
        (["callees", "HUD.render"], ["Entity"]), (["tree", "Entity"], ["  com.game.Enemy"]), (["tree", "Player", "-a"], ["com.game.Entity", "Object"]), (["packages"], ["com.game"]),
        (["pool", "strings", "-s", "ATTACK"], ["attacking!"]), (["pool", "multinames", "-s", "hud"], ["com.ui.HUD"]), (["disasm", "--class", "Player"], ["callpropvoid trace, 1"]),
        (["decompile"], ["com.ui.HUD"]), (["decompile", "--class", "Player"], ["public class Player extends Entity"]), (["decompile", "--class", "Player", "--method", "attack"], ['trace("player attacks");']),
    ],
)
def test_commands(spark, path, capsys, args, parts):
    command, *rest = args
    names = [x for x in rest if not x.startswith("-")][:1] if command in ("class", "refs", "callers", "callees", "tree", "pool", "fields") else []
    options = rest[1:] if names else rest
    assert cli.main([command, path, *names, *options], spark) == 0
    out = capsys.readouterr().out
    for part in parts:
        assert part in out


def test_files_are_written(spark, path, tmp_path):
    cli.main(["extract", path, "-o", str(tmp_path / "abc")], spark)
    assert (tmp_path / "abc" / "abc_0.abc").read_bytes() == game_block()
    cli.main(["build", path, "-o", str(tmp_path / "new.swf"), "-d"], spark)
    assert (tmp_path / "new.swf").read_bytes()[:3] == b"FWS"
    cli.main(["decompile", path, "--all", "--outdir", str(tmp_path / "src")], spark)
    assert (tmp_path / "src" / "com" / "ui" / "HUD.as").exists()
    with pytest.raises(SystemExit):
        cli.main(["build", path], spark)
    with pytest.raises(SystemExit):
        cli.main(["class", path, "e"], spark)


def test_fields_of_a_class(spark, path, capsys):
    cli.main(["fields", path, "Player"], spark)
    assert capsys.readouterr().out == ""
