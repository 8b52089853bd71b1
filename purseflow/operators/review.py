"""Review of unmapped descriptions, what-if previews of mapping changes, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purseflow.operators.checks import union, violations
from purseflow.operators.enrichment import resolve_enrichment

CHANGES = "change_id string, description string, merchant string, category string, confirmed boolean"


def unmapped_expenses(transactions: DataFrame, description_map: DataFrame) -> DataFrame:
    rows = transactions.where("transaction_type = 'expense' and description is not null")
    return rows.join(description_map, "description", "left_anti")


def review_workspace(transactions: DataFrame, source_types: DataFrame, description_map: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per unmapped description: transactions, net amount, latest date, kinds of sources of all
    its records (``source_types`` is transaction_id, source_type) and how many overrides."""
    rows = unmapped_expenses(transactions, description_map)
    own = decisions.select("transaction_id", (F.col("merchant_override").isNotNull() | F.col("category_override").isNotNull()).alias("_override"))
    facts = rows.join(own, "transaction_id", "left").groupBy("description").agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("amount"), F.max("transaction_date").alias("latest_date"), F.count_if("_override").alias("exception_count"))
    kinds = rows.select("transaction_id", "description").join(source_types.select("transaction_id", "source_type").distinct(), "transaction_id").select("description", "source_type").distinct()
    kinds = kinds.groupBy("description").agg(F.sort_array(F.collect_list("source_type")).alias("source_types"))
    return facts.join(kinds, "description", "left").orderBy(F.desc("latest_date"), F.desc("description"))


def merchant_options(merchant_map: DataFrame, description_map: DataFrame) -> DataFrame:
    counts = description_map.groupBy("merchant").agg(F.count("*").alias("description_count"))
    return merchant_map.join(counts, "merchant", "left").select("merchant", "category", F.coalesce("description_count", F.lit(0)).cast("long").alias("description_count"))


def categories(merchant_map: DataFrame) -> DataFrame:
    return merchant_map.select("category").distinct()


def change_guards(changes: DataFrame, transactions: DataFrame, description_map: DataFrame, merchant_map: DataFrame) -> DataFrame:
    """Violations by change: description mapped already or on no expense, category unknown,
    a new merchant without confirmation, a category that would be left empty."""
    key = "change_id"
    mapped = changes.join(description_map.select("description"), "description", "left_semi")
    unused = changes.join(transactions.where("transaction_type = 'expense'").select("description").distinct(), "description", "left_anti")
    unknown = changes.join(categories(merchant_map), "category", "left_anti")
    fresh = changes.where("not coalesce(confirmed, false)").join(merchant_map.select("merchant"), "merchant", "left_anti")
    moved = changes.join(merchant_map.withColumnRenamed("category", "old_category"), "merchant").where("category <> old_category")
    left = merchant_map.groupBy("category").agg(F.count("*").alias("n")).where("n = 1").withColumnRenamed("category", "old_category")
    return union(
        violations(mapped, "description_mapped", key, F.col("description")), violations(unused, "description_unused", key, F.col("description")), violations(unknown, "category_unknown", key, F.col("category")),
        violations(fresh, "merchant_unconfirmed", key, F.col("merchant")), violations(moved.join(left, "old_category", "left_semi"), "category_left_empty", key, F.col("old_category")),
    )


def preview_mapping(changes: DataFrame, transactions: DataFrame, description_map: DataFrame, merchant_map: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each change (description to merchant, merchant to category) would alter, alone.

    Only transactions that the change can reach are resolved twice: those of its
    description, and those of its merchant. Returns counts by change: affected, of these
    by the description and by the merchant's default, and overrides that keep the result.
    """
    known = resolve_enrichment(transactions, description_map, merchant_map, decisions)
    base = transactions.where("transaction_type = 'expense'").join(known.select("transaction_id", F.col("merchant_name").alias("old_merchant"), F.col("category").alias("old_category"), F.col("category_source").alias("old_source"), F.col("is_unclassified").alias("old_unclassified")), "transaction_id")
    base = base.select("transaction_id", "description", "old_merchant", "old_category", "old_source", "old_unclassified").join(decisions.select("transaction_id", "merchant_override", "category_override"), "transaction_id", "left")
    c = changes.select("change_id", F.col("description").alias("new_description"), F.col("merchant").alias("new_merchant"), F.col("category").alias("new_category"))
    by_description = base.join(c, base.description == c.new_description).withColumn("matching", F.lit(True))
    by_merchant = base.join(c, (base.old_merchant == c.new_merchant) & ~base.description.eqNullSafe(c.new_description)).withColumn("matching", F.lit(False))
    reach = by_description.unionByName(by_merchant)
    merchant = F.coalesce("merchant_override", F.when(F.col("matching"), F.col("new_merchant")).otherwise(F.col("old_merchant")))
    reach = reach.withColumn("merchant_after", merchant).join(merchant_map.select(F.col("merchant").alias("merchant_after"), F.col("category").alias("_default")), "merchant_after", "left")
    default = F.when(F.col("merchant_after") == F.col("new_merchant"), F.col("new_category")).otherwise(F.col("_default"))
    source = F.when(F.col("category_override").isNotNull(), "transaction_override").when(default.isNotNull(), "merchant_default").otherwise("unclassified")
    category = F.coalesce("category_override", default, F.lit("待分类"))
    before, after = F.struct("old_merchant", "old_category", "old_source"), F.struct("merchant_after", category.alias("c"), source.alias("s"))
    changed = ~before.eqNullSafe(after)
    override = F.col("merchant_override").isNotNull() | F.col("category_override").isNotNull()
    counts = reach.groupBy("change_id").agg(
        F.count_if(changed).alias("affected"), F.count_if(changed & F.col("matching")).alias("by_description"), F.count_if(changed & ~F.col("matching")).alias("by_default_category"), F.count_if(~changed & override).alias("preserved_exceptions"),
        F.count_if(F.col("old_unclassified") & (source != "unclassified")).alias("newly_classified"),
    )
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in counts.columns if x != "change_id"]
    return changes.select("change_id").join(counts, "change_id", "left").select("change_id", *zero)


def state_token(*tables: DataFrame) -> str:
    """A fingerprint that changes when any row of any table does; one pass a table, no order."""
    parts = []
    for t in tables:
        row = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(t.columns)])
        parts.append(t.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("s"), F.bit_xor(row).alias("x")).first())
    spark = tables[0].sparkSession
    return spark.range(1).select(F.sha2(F.lit(repr([tuple(p) for p in parts])), 256)).first()[0]


def apply_mapping(description_map: DataFrame, merchant_map: DataFrame, changes: DataFrame, token: str, now: str) -> tuple[DataFrame, DataFrame]:
    """The next maps, if nothing has changed since the preview (its token equals the one now)."""
    if token != now:
        raise ValueError("the ledger has changed since the preview")
    d, m = changes.select("description", "merchant"), changes.select("merchant", "category").distinct()
    return description_map.join(d, "description", "left_anti").unionByName(d), merchant_map.join(m, "merchant", "left_anti").unionByName(m)


def review_detail(description: Column | str, transactions: DataFrame, decisions: DataFrame, n: int = 3) -> DataFrame:
    """Representative transactions of a description: its latest ``n``."""
    rows = transactions.where((F.col("description") == description) & (F.col("transaction_type") == "expense"))
    return rows.join(decisions, "transaction_id", "left").orderBy(F.desc("transaction_date"), F.desc("txn_ord")).limit(n)


def invert_mappings(description_map: DataFrame, merchant_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maps as they are stored: descriptions by merchant, merchants by category, sorted."""
    a = description_map.groupBy("merchant").agg(F.sort_array(F.collect_list("description")).alias("descriptions"))
    return a, merchant_map.groupBy("category").agg(F.sort_array(F.collect_list("merchant")).alias("merchants"))


def expand_mappings(by_merchant: DataFrame, by_category: DataFrame) -> tuple[DataFrame, DataFrame]:
    return by_merchant.select(F.explode("descriptions").alias("description"), "merchant"), by_category.select(F.explode("merchants").alias("merchant"), "category")
