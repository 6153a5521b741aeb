import pytest

from graphloom.__main__ import main

EDGES = "0 1\n1 2\n2 0\n2 3\n"
LISTS = "0 5 1 2\n1 5 0 2\n2 6 0 1 3\n3 6 2\n"


@pytest.mark.parametrize(
    ("args", "n"),
    [
        (["triangles"], 1), (["closure"], 9), (["pagerank", "--rounds", "2"], 4), (["components", "--shift"], 4), (["cliques"], 5), (["motifs"], 2),
        (["motifs", "-k", "4", "--shuffled"], 5), (["frequent", "--support", "2"], 3), (["frequent", "--support", "1", "--parity", "--edges", "2"], 6),
    ],
)
def test_programs(spark, tmp_path, args, n):
    f = tmp_path / "g.txt"
    f.write_text(EDGES if args[0] in ("triangles", "closure", "pagerank", "components") else LISTS)
    main([args[0], str(f), *args[1:], "--out", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_result_is_shown(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text(EDGES)
    main(["triangles", str(tmp_path / "g.txt")], spark)
    assert "1 rows" in capsys.readouterr().out
