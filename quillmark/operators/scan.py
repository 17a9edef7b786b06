"""Places, counts and carried values in order within a key, also where one key is too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash

#: Rows of a key from which on it is scanned in parts of about as many.
WHOLE_ROWS = 1_000_000
#: Parts that keys are counted in first: where no part has more rows than a large key, there is none.
COUNTED_PARTS = 1 << 14


def _carry(values: dict[str, Column], sums: dict[str, Column], order: Window) -> dict[str, Column]:
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return {name: F.last(value, ignorenulls=True).over(upto) for name, value in values.items()} | {name: F.sum(value).over(upto) for name, value in sums.items()}


def fullest_part(rows: DataFrame, key: str) -> tuple[int, int]:
    """(rows of the fullest of COUNTED_PARTS parts by key, all rows); no key has more rows than the first."""
    per = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(COUNTED_PARTS))).count()
    most, total = per.agg(F.max("count"), F.sum("count")).first()
    return most or 0, total or 0


def in_order(rows: DataFrame, key: str, order: list, at: str | None = None, count: str | None = None, carried: dict[str, Column] | None = None, summed: dict[str, Column] | None = None, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Adds to each row, within its key and by order: at, its place from 0; count, the key's rows; for each name of
    carried the last value of that column that is not null, and of summed the sum of that column, at the row or before.

    order has to tell all rows of a key apart. Keys of up to whole_rows rows are one window group. The rows of larger
    ones are dealt by ranges of (key, order) to parts; each part is scanned on its own, and then gets what the parts
    before it hand on: their rows counted, and their last values. So no task holds more than about whole_rows of a key.
    A null key is a key like any other; an empty table gives no rows.
    """
    values, sums = carried or {}, summed or {}
    own = Window.partitionBy(key)
    add = ({at: F.row_number().over(own.orderBy(*order)) - 1} if at else {}) | ({count: F.count("*").over(own)} if count else {})
    plain = rows.withColumns(add | _carry(values, sums, own.orderBy(*order)))
    if fullest_part(rows, key)[0] <= whole_rows:
        return plain
    sizes = stash(rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__size")).where(F.col("__size") > whole_rows))
    total = sizes.agg(F.sum("__size")).first()[0]
    if not total:
        return plain
    large = rows[key].eqNullSafe(sizes["__key"])
    small = rows.join(sizes, large, "left_anti").withColumns(add | _carry(values, sums, own.orderBy(*order)))

    parts = -(-total // whole_rows) + 1
    dealt = rows.join(sizes, large, "left_semi").withColumns({f"__v_{n}": v for n, v in (values | sums).items()})
    dealt = stash(dealt.repartitionByRange(parts, F.col(key).asc_nulls_first(), *order).withColumn("__part", F.spark_partition_id()))
    one = Window.partitionBy("__part", key)
    dealt_as = lambda names: {n: F.col(f"__v_{n}") for n in names}
    here = {f"__c_{n}": c for n, c in _carry(dealt_as(values), dealt_as(sums), one.orderBy(*order)).items()}
    local = stash(dealt.withColumns({"__at": F.row_number().over(one.orderBy(*order)) - 1, "__rows": F.count("*").over(one)} | here))
    ends = local.where("__at = __rows - 1").select(F.col(key).alias("__key"), F.col("__part").alias("__of"), "__rows", *here)
    before = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        "__key", "__of", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"), F.sum("__rows").over(Window.partitionBy("__key")).alias("__total"),
        *(F.last(f"__c_{n}", ignorenulls=True).over(before).alias(f"__c_{n}_before") for n in values), *(F.sum(f"__c_{n}").over(before).alias(f"__c_{n}_before") for n in sums),
    )
    both = local.join(handed, local[key].eqNullSafe(handed["__key"]) & (local["__part"] == handed["__of"]))
    found = ({at: (F.col("__at") + F.col("__offset")).cast("int")} if at else {}) | ({count: F.col("__total")} if count else {})
    found |= {n: F.coalesce(F.col(f"__c_{n}"), F.col(f"__c_{n}_before")) for n in values}
    both_sums = lambda n: F.when(F.col(f"__c_{n}").isNotNull() | F.col(f"__c_{n}_before").isNotNull(), F.coalesce(f"__c_{n}", F.lit(0)) + F.coalesce(f"__c_{n}_before", F.lit(0)))
    found |= {n: both_sums(n) for n in sums}
    return small.unionByName(both.withColumns(found).select(*small.columns))
