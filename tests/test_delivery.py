"""The whole delivery run: reports agree with the written data, the manifest comes last."""

import pytest

from weft.operators import delivery as DL
from weft.operators import privacy as PV
from weft.plans.cat_delivery import PLAN, SEED
from weft.plans.spec import ColumnSpec, Rule, TableSpec
from weft.session import table
from weft.sources import files as FS

SF = "/root/testdata/sf0.001"


def test_reports_agree_with_counts_of_the_written_data(spark):
    path = FS.scratch_path(spark, "delivery-test")
    m = DL.deliver(table(spark, SF, "orders"), PLAN, SEED, path).first()
    data, rep = DL.read_data(spark, path), {(r.section, r.name): r.value for r in DL.read_reports(spark, path).collect()}
    assert m.n_rows == data.count() == rep["delivery", "rows"] and m.overall_score == rep["audit", "overall_score"]
    assert rep["enhance", "rows"] - rep["rules", "customer_given"] == m.n_rows
    assert rep["privacy", "k"] == PV.k_anonymity(data, list(PLAN.quasi_ids)).first()["k"]
    n, keys = data.selectExpr("count(o_orderkey)", "count(distinct o_orderkey)").first()
    assert rep["audit", "uniqueness:violations"] == n - keys > 0
    flagged = data.where("array_contains(_violations, 'status_known')").count()
    assert 0 < flagged <= rep["rules", "status_known"]


def test_a_failed_run_leaves_no_manifest(spark):
    path = FS.scratch_path(spark, "delivery-test")
    plan = DL.DeliveryPlan(spec=TableSpec("t", (ColumnSpec("a", "integer"),)), key_cols=("a",), rules=(Rule("r", "expression", ("a",), "flag", expression="assert_true(a < 3) IS NULL"),))
    with pytest.raises(Exception):
        DL.deliver(spark.range(9).withColumnRenamed("id", "a"), plan, 1, path)
    with pytest.raises(Exception):
        DL.read_data(spark, path)


def test_empty_table_and_empty_plan(spark):
    path = FS.scratch_path(spark, "delivery-test")
    plan = DL.DeliveryPlan(spec=TableSpec("t", (ColumnSpec("a", "integer", primary_key=True),)), key_cols=("a",))
    assert DL.deliver(spark.range(0).withColumnRenamed("id", "a"), plan, 1, path).first().n_rows == 0
    assert DL.deliver(spark.range(5).withColumnRenamed("id", "a"), plan, 1, FS.scratch_path(spark, "delivery-test")).first().n_rows == 5
