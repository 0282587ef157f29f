"""Steps whose short keys would come in millions to a task if Spark joined their shuffled blocks by bytes."""

from __future__ import annotations

from mineralis.plans import evidence
from mineralis.plans import views as V

SF = "/root/testdata/sf0.001"


def test_amounts_are_dealt_to_all_parts(spark):
    for amounts in (evidence._formula(spark, SF), evidence._found(spark, SF)):
        assert amounts.rdd.getNumPartitions() == V.PARTS
        keys = amounts.select("structure_id", "element")
        assert keys.count() == keys.distinct().count() == V.amount(spark, SF).count()
