"""Jobs on files: ``python -m cinnabar.cli COMMAND ...``; each reads tables or record files and writes a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import reactions as R
from .operators import curation, mining, search
from .operators import reactions as O
from .sources import records, tables


def _reactions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, smiles, meta) of a reaction file."""
    if records.format_of(path) == "ord":
        return records.ord_reactions(spark, path).select("idx", "smiles", "meta")
    if records.format_of(path) == "rdf":
        return tables.parse_blocks(records.rdf_blocks(spark, path)).select("idx", "smiles", "meta")
    own = records.smiles(spark, path)
    source = F.map_from_entries(F.transform("source", lambda x, i: F.struct(F.format_string("source_%04d", i + 1), x)))
    return own.select("idx", "smiles", source.alias("meta"))


def _finish(out: DataFrame, target: str, dedup: bool) -> None:
    """Writes the good records, rejections and faults, and a summary."""
    out = out.select("idx", "original", "smiles", "key", "meta", "status", "reason", "stage", "error_type", "message")
    good = out.where("status = 'ok'")
    tables.write_records(curation.keep_first(good, ["key"], "idx") if dedup else good, f"{target}/records", mode="overwrite")
    tables.write_errors(out.where("status = 'error'").select(F.col("original").alias("original_smiles"), records.source_info(F.col("meta")).alias("source_info"), "stage", "error_type", F.col("message").alias("error_message")), f"{target}/errors", mode="overwrite")
    curation.breakdown(out.where("status = 'filtered'"), "reason").write.mode("overwrite").json(f"{target}/rejections")
    tables.summary_json(curation.summary(out, "status", ["key"])).write.mode("overwrite").text(f"{target}/summary")


def standardize(spark: SparkSession, source: str, target: str, steps: list[str]) -> None:
    df = _reactions(spark, source).withColumn("original", F.col("smiles"))
    _finish(O.curate(df, steps={s: {} for s in steps or R.STEPS}), target, True)


def filter_(spark: SparkSession, source: str, target: str, filters: list[str]) -> None:
    df = _reactions(spark, source).withColumn("original", F.col("smiles"))
    _finish(O.curate(df, filters={f: {} for f in filters or R.FILTERS}), target, False)


def extract(spark: SparkSession, source: str, target: str, min_popularity: int, single_product: bool) -> None:
    """Rules and policy data of mapped reactions."""
    pairs = O.extract_rules(_reactions(spark, source), "smiles", ["idx"], R.RuleOptions(single_product_only=single_product)).withColumnRenamed("idx", "rxn_idx")
    pairs.write.mode("overwrite").parquet(f"{target}/pairs")
    pairs = spark.read.parquet(f"{target}/pairs")
    rules = mining.ranked(mining.key_statistics(pairs), min_popularity)
    members = pairs.join(rules.select("cgr_key", "rule_id"), "cgr_key")
    lists = members.groupBy("rule_id").agg(F.sort_array(F.collect_list("rxn_idx")).alias("reaction_indices"))  # the file's format holds them
    tables.write_rules(rules.join(lists, "rule_id"), f"{target}/rules", mode="overwrite")
    products = pairs.groupBy("rxn_idx").agg(F.min("product_smiles").alias("product_smiles"))
    tables.write_policy(mining.policy_rows(products, mining.reactions_of(pairs, rules)), f"{target}/policy", mode="overwrite")


def stock(spark: SparkSession, source: str, target: str) -> None:
    kind = source.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    own = records.csv_smiles(spark, source, delimiter="\t" if kind == "tsv" else ",") if kind in ("csv", "tsv") else records.smiles(spark, source)
    O.building_blocks(own).select("smiles").write.mode("overwrite").text(target)


def plan(spark: SparkSession, source: str, target: str, rules: str, blocks: str, algorithm: str, iterations: int) -> None:
    targets = records.smiles(spark, source).select(F.col("idx").alias("target_id"), "smiles")
    known, held = tables.read_rules(spark, rules), spark.read.text(blocks).select(F.col("value").alias("smiles"))
    options = search.SearchOptions(algorithm=algorithm, max_iterations=iterations)
    search.plan(targets, known, held, options).write.mode("overwrite").parquet(f"{target}/nodes")
    steps = search.route_steps(spark.read.parquet(f"{target}/nodes"))
    steps.write.mode("overwrite").parquet(f"{target}/routes")
    stats = search.plan_statistics(targets, known, held, options).withColumnRenamed("smiles", "target_smiles")
    tables.write_statistics(stats, f"{target}/statistics", mode="overwrite")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cinnabar")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("standardize", "filter", "extract", "stock", "ord-convert", "plan"):
        own = commands.add_parser(name)
        own.add_argument("source")
        own.add_argument("target")
        if name == "standardize":
            own.add_argument("--steps", nargs="*", default=[], choices=list(R.STEPS))
        elif name == "filter":
            own.add_argument("--filters", nargs="*", default=[], choices=list(R.FILTERS))
        elif name == "extract":
            own.add_argument("--min-popularity", type=int, default=3)
            own.add_argument("--several-products", action="store_true")
        elif name == "plan":
            own.add_argument("--rules", required=True)
            own.add_argument("--stock", required=True)
            own.add_argument("--algorithm", default="uct", choices=search.STRATEGIES)
            own.add_argument("--iterations", type=int, default=100)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cinnabar").getOrCreate()
    if a.command == "standardize":
        standardize(spark, a.source, a.target, a.steps)
    elif a.command == "filter":
        filter_(spark, a.source, a.target, a.filters)
    elif a.command == "extract":
        extract(spark, a.source, a.target, a.min_popularity, not a.several_products)
    elif a.command == "stock":
        stock(spark, a.source, a.target)
    elif a.command == "ord-convert":
        tables.write_records(records.ord_reactions(spark, a.source), a.target, mode="overwrite")
    else:
        plan(spark, a.source, a.target, a.rules, a.stock, a.algorithm, a.iterations)


if __name__ == "__main__":
    main()
