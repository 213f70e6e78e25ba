import json

from tilewright.__main__ import main
from tilewright.plans import source_queries as Q

from .conftest import SF


def test_commands(spark, tmp_path, capsys):
    rows = Q.damaged(spark, SF).where("file_id in (1, 2, 7, 13)").collect()
    for r in rows:
        (tmp_path / f"{r.file_id}.bin").write_bytes(r.content)
    good = str(tmp_path / "1.bin")
    assert main(["info", good], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"dimensions": {"width": 8, "height": 8}, "tile_size": 4, "max_zoom_level": 0, "tiles": 4}
    assert main(["inspect", good], spark) == 0 and json.loads(capsys.readouterr().out)["raster_codec"] == "Png"
    assert main(["validate", good], spark) == 0
    assert main(["validate", str(tmp_path)], spark) == 1
    said = capsys.readouterr().out
    assert "7.bin\tmagic\t1" in said and "13.bin\tchecksum\t1" in said and "1.bin\tmagic" not in said.replace("7.bin", "")
    out = f"file://{tmp_path}/out"
    assert main(["extract", good, "--tile", "0/1_0", "--out", out], spark) == 0
    assert [p.name for p in (tmp_path / "out/level_0").iterdir()] == ["tile_1_0.png"]
    assert main(["extract", good, "--out", out], spark) == 0 and len(list((tmp_path / "out/level_0").iterdir())) == 4
    assert main(["extract", good, "--tile", "x", "--out", out], spark) == 2 and main(["extract", good], spark) == 2
    assert main(["extract", good, "--level", "5", "--out", out], spark) == 1
