"""The command line on a small dataset: make, list, export, delete."""

import json

import pytest

from sequora.__main__ import main


def test_round_trip(spark, tmp_path, capsys):
    (tmp_path / "a.fasta").write_text(">s1 first\nACGT\nAC\n>s2\nGG\n")
    (tmp_path / "l.csv").write_text("acc,family,genus\ns1,f,g\ns2,f,h\n")
    base = ["--base", str(tmp_path / "sets")]
    main([*base, "list"], spark)
    assert capsys.readouterr().out == ""
    main([*base, "make", "one", str(tmp_path / "a.fasta"), str(tmp_path / "l.csv")], spark)
    made = json.loads(capsys.readouterr().out)
    assert made["sequences"] == 2 and made["taxa"] == {"family": 1, "genus": 2} and made["ranks"] == ["family", "genus"]
    with pytest.raises(ValueError):
        main([*base, "make", "one", str(tmp_path / "a.fasta"), str(tmp_path / "l.csv")], spark)
    main([*base, "list"], spark)
    assert json.loads(capsys.readouterr().out) == made
    main([*base, "export", "one", str(tmp_path / "out")], spark)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "sequences").glob("*.txt")))
    assert ">s1\nACGTAC" in text and ">s2\nGG" in text
    main([*base, "delete", "one"], spark)
    main([*base, "list"], spark)
    assert capsys.readouterr().out == ""
    with pytest.raises(ValueError):
        main([*base, "delete", "../sets"], spark)


def test_query_as_report(spark, tmp_path):
    main(["query", "tax_rollup", "/root/testdata/sf0.001", str(tmp_path / "r")], spark)
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() > 0
