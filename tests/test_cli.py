"""Command line end to end on small files."""

import json

from reploom import cli

SIX = ["CASSLGIRRT", "CASSLGYEQYF", "CASSLEPSGGTDTQYF", "CASSDTSGGTDTQYF", "CASSFGQGSYEQYF", "CASSQETQYF"]


def call(spark, capsys, *argv):
    code = cli.run(spark, cli.parser().parse_args(["--json", *argv]))
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_commands(spark, capsys, tmp_path):
    f = tmp_path / "in.txt"
    f.write_text("\n".join(SIX) + "\n")
    lz, fb = str(tmp_path / "lz"), str(tmp_path / "fb")
    assert call(spark, capsys, "build", str(f), lz)[0] == 0 and call(spark, capsys, "build", str(f), fb, "--variant", "flashback")[0] == 0
    assert call(spark, capsys, "info", fb)[1][0]["n_sequences"] == 6
    assert len(call(spark, capsys, "score", lz, str(f))[1]) == 6
    assert len(call(spark, capsys, "simulate", lz, "-n", "20")[1]) == 20
    assert {r["alpha"] for r in call(spark, capsys, "diversity", fb)[1]} == {0.0, 1.0, 2.0, float("inf")}
    assert call(spark, capsys, "compare", fb, fb)[1][0]["edge_jaccard"] == 1.0
    assert call(spark, capsys, "decompose", "AABCA")[1][0]["tokens"] == ["A", "AB", "C", "A"]
    assert call(spark, capsys, "saturation", str(f), "--every", "3")[1][-1]["n_seqs"] == 6
    assert len(call(spark, capsys, "predict", "richness", lz, "10:1000:3")[1]) == 3
    assert call(spark, capsys, "posterior", fb, str(f), str(tmp_path / "post"))[0] == 0
    assert len(call(spark, capsys, "scale", fb, str(f), "-n", "300")[1]) == 6
    assert any(r["measure"] == "entropy_nats" for r in call(spark, capsys, "grammar", str(f))[1])
    assert call(spark, capsys, "validate-input", str(f))[0] == 0
    f.write_text("CASS\nC!!\n")
    assert call(spark, capsys, "validate-input", str(f))[0] == 2
