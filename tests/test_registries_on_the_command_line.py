"""The command line on a given registry, and loaders of rules and policies."""

import json

import pytest

from veilspark import cli
from veilspark.functions import fixed_values as V
from veilspark.operators import classification as C
from veilspark.sources import documents as D


def asset(i, value, **more):
    return {"asset_id": i, "name": i, "type": "exact", "value": value, "aliases": [], "risk_level": "high", "allowed_roles": [], "protection_modes": ["exact_match"], "enabled": True, "source": "user"} | more


def run(spark, capsys, *argv):
    cli.main(list(argv), spark)
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_chat_guards_the_given_registry(spark, tmp_path, capsys):
    path = tmp_path / "own.json"
    path.write_text(json.dumps([asset("mine", "BLUE-HERON-7")]))
    said = run(spark, capsys, "chat", "please write BLUE-HERON-7 on a card", "--registry", str(path))[0]
    assert "BLUE-HERON-7" not in (said["safe_output"] or "") and said["action"] == "BLOCK"
    other = run(spark, capsys, "chat", "please write BLUE-HERON-7 on a card")[0]
    assert "BLUE-HERON-7" in other["safe_output"]


def test_changes_stay_in_the_registry(spark, tmp_path, capsys):
    path, users = tmp_path / "own.json", tmp_path / "users.json"
    path.write_text(json.dumps([asset("mine", "BLUE-HERON-7", source="system")]))
    users.write_text(json.dumps({"assets": [asset("mine", "taken"), asset("new", "RED-KITE-9"), {"value": "no id"}]}))
    held = lambda: {r["asset_id"] for r in run(spark, capsys, "asset", "list", "--registry", str(path))}
    run(spark, capsys, "asset", "refresh", str(users), "--registry", str(path))
    assert held() == {"mine", "new"}
    assert run(spark, capsys, "asset", "show", "mine", "--registry", str(path))[0]["value"] == "BLUE-HERON-7"
    assert run(spark, capsys, "asset", "add", json.dumps(asset("third", "GREEN-OWL-1")), "--registry", str(path))[0]["success"]
    run(spark, capsys, "asset", "remove", "mine", "--registry", str(path))
    assert held() == {"new", "third"}
    with pytest.raises(SystemExit):
        cli.main(["asset", "refresh"], spark)


def test_rules_and_policies(spark, tmp_path):
    aliases, roles, broken, none = (tmp_path / n for n in ("aliases.json", "roles.json", "broken.json", "none.json"))
    aliases.write_text('{"aliases": {"flag": ["flag", "旗標"]}, "other": 1}')
    roles.write_text('{"roles": {"admin": {"allowed_roles": ["owner"], "permissions": ["read"]}}}')
    broken.write_text("{")
    assert D.load_alias_rules(spark, str(aliases)) == {"flag": ["flag", "旗標"]}
    with pytest.raises(D.RuleLoadError):
        D.load_alias_rules(spark, str(none))
    assert D.load_policy_file(spark, str(none)) == {} and D.load_policy_file(spark, str(roles))["roles"]
    with pytest.raises(D.RuleLoadError):
        D.load_policy_file(spark, str(broken))
    held = D.RolePolicies(spark, str(roles))
    policy = held.policy("admin", ["k"], {"action": "block", "threshold": "high"})
    assert policy == {"action": "block", "risk_threshold": "high", "role": "admin", "restricted_assets": ["k"], "allowed_roles": ["owner"], "required_permissions": ["read"], "enable_monitoring": True, "enable_leakage_check": True}
    free = held.policy("guest", [], {})
    assert free["required_permissions"] == [] and not free["enable_monitoring"] and not free["enable_leakage_check"]
    roles.write_text("{}")
    held.reload()
    assert held.policy("admin", [], {})["allowed_roles"] == []


def test_taxonomy(spark):
    table = C.taxonomy(spark)
    assert {r.category for r in C.categories(table).collect()} == set(V.LEGACY_ATTACKS)
    assert {r.category for r in C.by_risk_level(table, "high").collect()} == {k for k, v in V.LEGACY_ATTACKS.items() if v[2] == "high"}
    asked = spark.createDataFrame([(1, "role_play_bypass"), (2, "unknown"), (3, None)], "id int, category string")
    assert [(r.id, r.confidence) for r in C.get(asked, table).collect()] == [(1, V.LEGACY_ATTACKS["role_play_bypass"][1])]
