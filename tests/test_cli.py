from __future__ import annotations

import json

import pytest
import snapshots as S
from quillon.__main__ import main
from quillon.plans import policy


def test_compare_and_exit_codes(spark, tmp_path, capsys):
    old, new = S.context(), S.context()
    next(r for r in new["records"] if r["type_key"] == "S")["size_bits"] = 128
    (tmp_path / "a.json").write_text(json.dumps(S.snapshot("a", **old)))
    (tmp_path / "b.json").write_text(json.dumps(S.snapshot("b", **new)))
    (tmp_path / "p.json").write_text(json.dumps({"overrides": {"type_size_changed": "ignore"}}))
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    assert main(["compare", a, b, "--format", "json"], spark) == 4
    assert '"kind":"type_size_changed"' in capsys.readouterr().out
    assert main(["compare", a, b, "--policy", str(tmp_path / "p.json")], spark) == 0
    (tmp_path / "bad.json").write_text(json.dumps({"overrides": {"no_such_kind": "ignore"}}))
    with pytest.raises(ValueError, match="no_such_kind"):
        policy.load_policy(spark, str(tmp_path / "bad.json"))


def test_symvers_and_aggregate(spark, tmp_path, capsys):
    (tmp_path / "a").write_text("0x1\tf\tvmlinux\tEXPORT_SYMBOL\n")
    (tmp_path / "b").write_text("0x2\tf\tvmlinux\tEXPORT_SYMBOL\n")
    assert main(["symvers", str(tmp_path / "a"), str(tmp_path / "b")], spark) == 4
    assert main(["symvers", str(tmp_path / "a"), str(tmp_path / "a")], spark) == 0
    (tmp_path / "r").mkdir()
    for k, (profile, changes, cut) in enumerate((("p", [{"kind": "k", "identity": "i"}], False), ("q", [], False), ("r", [], True))):
        (tmp_path / "r" / f"{k}.json").write_text(json.dumps({"target": "t", "profile": profile, "check_id": "c", "truncated": cut, "changes": changes}))
    capsys.readouterr()
    assert main(["aggregate", str(tmp_path / "r")], spark) == 0
    assert capsys.readouterr().out.strip().split("\t") == ["t", "i", "['p']", "['q']", "['r']", "undetermined"]


def test_floors(spark):
    found = spark.createDataFrame([("p", "symbol_version_required_added", "GLIBC_2.34", "libc", "COMPATIBLE_WITH_RISK"), ("p", "symbol_version_required_added", "GLIBC_2.5", "libc", "COMPATIBLE_WITH_RISK"), ("p", "symbol_version_required_added", "OTHER_1", "x", "COMPATIBLE_WITH_RISK")], "pair_id string, kind string, symbol string, new_value string, effective_verdict string")
    assert {r.symbol: r.effective_verdict for r in policy.floors_applied(found, {"GLIBC": "2.17"}).collect()} == {"GLIBC_2.34": "BREAKING", "GLIBC_2.5": "COMPATIBLE", "OTHER_1": "COMPATIBLE_WITH_RISK"}
