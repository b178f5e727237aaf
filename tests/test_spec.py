import pytest

from tablemill import Filter, Join, JoinKey, Pivot, QuerySpec, SpecError
from tablemill.operators.families import Family
from tablemill.plans.spec import Branch, CaseColumn, suggest_alias


def test_from_nested_dicts():
    spec = QuerySpec.from_dict({
        "table": "orders", "select": ["a", "t.b"], "limit_rows": 5,
        "filters": [{"column": "a", "operator": "IN", "value": [1, 2]}],
        "joins": [{"table": "t", "join_type": "LEFT", "conditions": [{"left_column": "a", "right_column": "b"}]}],
        "case_expressions": [{"alias": "c", "branches": [{"column": "a", "operator": "=", "value": 1, "then_value": "x"}]}],
        "pivot": None,
    })
    assert spec.filters == (Filter("a", "IN", [1, 2]),)
    assert spec.joins[0] == Join("t", (JoinKey("a", "b"),), "LEFT")
    assert spec.case_expressions == (CaseColumn("c", (Branch("a", "=", 1, "x"),)),)


def test_defaults_select_everything_with_a_limit():
    spec = QuerySpec(table="t")
    assert spec.selects_all and spec.limit_rows == 1000 and spec.offset == 0
    assert QuerySpec(table="t", select=()).selects_all


@pytest.mark.parametrize("payload", [
    {"table": " "},
    {"table": "t", "limit_rows": 50_001},
    {"table": "t", "limit_rows": -1},
    {"table": "t", "offset": -1},
    {"table": "t", "mode": "REPORT"},
    {"table": "t", "unknown": 1},
    {"execution_mode": "sql", "sql": " "},
    {"table": "t", "filters": [{"column": "a", "operator": "~"}]},
    {"table": "t", "joins": [{"table": "u", "conditions": []}]},
    {"table": "t", "joins": [{"table": "u", "alias": "1x", "conditions": [{"left_column": "a", "right_column": "b"}]}]},
    {"table": "t", "joins": [{"table": "t", "conditions": [{"left_column": "a", "right_column": "b"}]}]},
    {"table": "t", "joins": [{"table": "u", "conditions": [{"left_column": " ", "right_column": "b"}]}]},
])
def test_invalid_specifications_are_refused(payload):
    with pytest.raises(SpecError):
        QuerySpec.from_dict(payload)


def test_report_fields_are_trimmed():
    pivot = Pivot("v", "SUM", (" a ", ""), ("b", " "))
    assert pivot.rows == ("a",) and pivot.columns == ("b",)
    with pytest.raises(SpecError):
        Pivot(" ", "SUM")


def test_alias_suggestions():
    assert suggest_alias("dev.usage view", []) == "usage_view"
    assert suggest_alias("2024", ["j_2024", "j_2024_2"]) == "j_2024_3"
    assert suggest_alias("", []) == "join_ref"


def test_family_from_a_dict():
    assert Family.from_dict({"month": "jan_2026", "regions": ["PVVNL", "pvvnl"]}).regions == ("PVVNL",)
    named = Family.from_dict({"month_tag": "jan_2026", "discoms": ["PVVNL", "KESCO"], "base_discom": "KESCO"})
    assert named.regions == ("PVVNL", "KESCO") and named.base_region == "KESCO"
    assert QuerySpec.from_dict({"table": "t", "engine": "any"}) == QuerySpec(table="t")
    with pytest.raises(SpecError):
        Family.from_dict({"months": "jan_2026"})
