"""What changed between two states of assets and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.operators.intervals import dimension


def contract_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(asset_id, contract_id, change, before, after), with rows as structs; unchanged ones are left out."""
    rest = [c for c in before.columns if c not in ("asset_id", "contract_id")]
    b = before.select("asset_id", "contract_id", F.struct(*rest).alias("before"))
    a = after.select("asset_id", "contract_id", F.struct(*rest).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    joined = b.join(a, ["asset_id", "contract_id"], "full").withColumn("change", change)
    return joined.where("change is not null").select("asset_id", "contract_id", "change", "before", "after")


def semantic_diff(assets_before: DataFrame, contracts_before: DataFrame, assets_after: DataFrame, contracts_after: DataFrame, companies: list[str]) -> DataFrame:
    """Per company status_changes, contracts_added, _removed, _changed of assets in both states, zeros included."""
    old = assets_before.select("asset_id", F.col("status").alias("_was"))
    both = assets_after.join(old, "asset_id").select("asset_id", "company", (~F.col("status").eqNullSafe(F.col("_was"))).alias("moved"))
    status = both.groupBy("company").agg(F.count_if("moved").alias("status_changes"))
    kinds = contract_changes(contracts_before, contracts_after).join(both.select("asset_id", "company"), "asset_id")
    counts = kinds.groupBy("company").agg(*[F.count_if(F.col("change") == k).alias(f"contracts_{k}") for k in ("added", "removed", "changed")])
    out = dimension(assets_after.sparkSession, "company", companies).select("company").join(status, "company", "left").join(counts, "company", "left")
    return out.fillna(0)


def asset_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: assets_added, assets_removed."""
    b, a = before.select("asset_id", F.lit(True).alias("b")), after.select("asset_id", F.lit(True).alias("a"))
    return b.join(a, "asset_id", "full").agg(F.count_if(F.col("b").isNull()).alias("assets_added"), F.count_if(F.col("a").isNull()).alias("assets_removed"))
