"""Operators bound to the driver's tables, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reactions as kernels
from ..operators import cgr, clusters, curation, embedding, learning, mapping, mining, numbering, policy, quality, reactions, refinement, tanimoto, training, tree, tuning
from ..operators import network as networks
from ..streaming.curation import BATCH_BYTES, curate, record_stream, statistics
from .stage import Stage, parted

RULES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        RULES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- shared views ---------------------------------------------------------------------------


def records(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.concat_ws("\t", "text", "source", "lang").alias("raw"), "text", "source", "lang", "n_chars")


def pairs(spark, d):
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    key = F.concat("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    rules = part.select("p_partkey", key.alias("cgr_key"), F.col("p_name").alias("rule_smarts"), F.when(F.col("p_size") % 7 == 0, "failed").otherwise("passed").alias("validation"))
    return line.join(rules, line.l_partkey == rules.p_partkey).select(F.col("l_orderkey").alias("rxn_idx"), "cgr_key", "rule_smarts", "validation")


PAIRS = """pairs AS (SELECT l_orderkey AS rxn_idx, p_name || p_brand || p_type || p_size::VARCHAR AS cgr_key, p_name AS rule_smarts, CASE WHEN p_size % 7 = 0 THEN 'failed' ELSE 'passed' END AS validation
    FROM lineitem JOIN part ON l_partkey = p_partkey),
rules AS (SELECT cgr_key, list_sort(list(rxn_idx)) AS reaction_indices, min(rule_smarts) AS rule_smarts, min(validation) AS validation, count(*) AS popularity, min(rxn_idx) AS first_idx FROM pairs GROUP BY cgr_key),
ranked AS (SELECT *, row_number() OVER (ORDER BY popularity DESC, first_idx, cgr_key) - 1 AS rule_id FROM rules WHERE validation = 'passed' AND popularity >= 30),
rmap AS (SELECT rxn_idx, max(rule_id) AS rule_id FROM (SELECT unnest(reaction_indices) AS rxn_idx, rule_id FROM ranked) GROUP BY rxn_idx)"""


def ranked_rules(spark, d):
    return mining.ranked(mining.key_statistics(pairs(spark, d)), 30)


def bonds(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("rxn_idx"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"), "l_returnflag", (F.col("l_linenumber") % 3 + 1).cast("long").alias("o"), (F.floor("l_quantity") % 3 + 1).cast("long").alias("p"))
    left = line.where(F.col("l_returnflag").isin("A", "N")).select("rxn_idx", "a", "b", F.col("o").alias("ord"))
    right = line.where(F.col("l_returnflag").isin("R", "N")).select("rxn_idx", "a", "b", F.col("p").alias("ord"))
    return cgr.compose(left, right)


BONDS = """bonds AS (SELECT coalesce(r.rxn_idx, p.rxn_idx) AS rxn_idx, coalesce(r.a, p.a) AS a, coalesce(r.b, p.b) AS b, ord, p_ord FROM
    (SELECT l_orderkey AS rxn_idx, l_suppkey AS a, l_partkey + 1000000 AS b, min(l_linenumber % 3 + 1)::BIGINT AS ord FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2, 3) r
    FULL OUTER JOIN (SELECT l_orderkey AS rxn_idx, l_suppkey AS a, l_partkey + 1000000 AS b, min(floor(l_quantity)::BIGINT % 3 + 1)::BIGINT AS p_ord FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1, 2, 3) p
    ON r.rxn_idx = p.rxn_idx AND r.a = p.a AND r.b = p.b)"""
CHANGES = BONDS + """, changes AS (SELECT rxn_idx, count(*) FILTER (WHERE ord IS NULL) AS formed, count(*) FILTER (WHERE p_ord IS NULL) AS broken,
    count(*) FILTER (WHERE ord <> p_ord) AS changed, count(*) FILTER (WHERE ord = p_ord) AS kept FROM bonds GROUP BY rxn_idx)"""


def nodes(spark, d):
    o = read(spark, d, "orders")
    own = o.select((F.col("o_orderkey") + 1).alias("node_id"), F.expr("(o_orderkey + 1) DIV 3").alias("parent_id"), (F.round("o_totalprice", 0) % 1000 / 1000).alias("prob"), (F.col("o_custkey") % 50).alias("visits"), (F.floor(F.col("o_totalprice")) % 100 / 100).alias("total_value"), "o_orderstatus")
    parents = own.select(F.col("parent_id").alias("node_id")).distinct().withColumn("p", F.lit(True))
    return own.join(parents, "node_id", "left").select("node_id", "parent_id", "prob", "visits", "total_value", ((F.col("o_orderstatus") == "F") & F.col("p").isNull()).alias("solved"))


NODES = """own AS (SELECT o_orderkey + 1 AS node_id, (o_orderkey + 1) // 3 AS parent_id, round(o_totalprice, 0) % 1000 / 1000 AS prob, o_custkey % 50 AS visits, floor(o_totalprice) % 100 / 100 AS total_value, o_orderstatus FROM orders),
nodes AS (SELECT o.*, o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM own c WHERE c.parent_id = o.node_id) AS solved FROM own o),
walk AS (SELECT node_id AS leaf, node_id, parent_id AS up, 0 AS hop FROM nodes UNION ALL SELECT leaf, n.node_id, n.parent_id, hop + 1 FROM walk JOIN nodes n ON n.node_id = up)"""


def logits(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("mol_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = e.select("mol_id", "label", F.posexplode(F.arrays_zip(F.col("v").alias("f"), F.reverse("v").alias("r"))).alias("rule_id", "x"))
    return out.select("mol_id", "label", F.col("rule_id").cast("long").alias("rule_id"), F.col("x.f").alias("f"), F.col("x.r").alias("r"))


LOGITS = """logits AS (SELECT mol_id, label, i - 1 AS rule_id, v[i]::DOUBLE AS f, v[len(v) - i + 1]::DOUBLE AS r FROM (SELECT vec_id AS mol_id, label::BIGINT AS label, embedding AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def interactions(spark, d):
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    matrix = spark.range(7).crossJoin(spark.range(5).withColumnRenamed("id", "j")).select(F.col("id").alias("competing_fg"), F.col("j").alias("reacting_fg"), ((F.col("id") * F.col("j")) % 3).cast("int").alias("level")).where("competing_fg <> 6")
    rows = line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").cast("long").alias("step_id"), (F.col("p_size") % 7).cast("long").alias("competing_fg"), (F.col("l_suppkey") % 5).alias("reacting_fg"), F.floor("l_quantity").cast("long").alias("overlap"), "p_name", F.col("l_partkey").alias("place"), "l_linestatus")
    return quality.lookup(rows, matrix)


INTER = """inter AS (SELECT l_orderkey AS route_id, l_linenumber::BIGINT AS step_id, p_size % 7 AS c, l_suppkey % 5 AS r, floor(l_quantity)::BIGINT AS overlap, p_name, l_partkey AS place, l_linestatus,
    CASE WHEN p_size % 7 = 6 THEN 'compatible' WHEN ((p_size % 7) * (l_suppkey % 5)) % 3 = 2 THEN 'incompatible' WHEN ((p_size % 7) * (l_suppkey % 5)) % 3 = 1 THEN 'competing' ELSE 'compatible' END AS severity
    FROM lineitem JOIN part ON l_partkey = p_partkey),
worst AS (SELECT route_id, step_id, max(CASE severity WHEN 'incompatible' THEN 1.0::DOUBLE WHEN 'competing' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS w FROM inter WHERE l_linestatus = 'F' GROUP BY 1, 2),
hal AS (SELECT l_orderkey AS route_id, count(*) * 0.1::DOUBLE AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
site AS (SELECT o_orderkey AS route_id, round(greatest(1 - (coalesce(w, 0) + coalesce(h, 0)) / greatest(7 - o_orderkey % 8, 1), 0), 6) AS score
    FROM orders LEFT JOIN (SELECT route_id, sum(w) AS w FROM worst GROUP BY 1) s ON s.route_id = o_orderkey LEFT JOIN hal ON hal.route_id = o_orderkey WHERE o_orderstatus <> 'P')"""


def site_scores(spark, d):
    halogens = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("route_id")).agg((F.count("*") * F.lit(0.1)).alias("halogens"))
    # some routes have no interaction, some no halogen, some no step
    routes = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("route_id"), (7 - F.col("o_orderkey") % 8).alias("n_steps"))
    return quality.competing_sites(routes, interactions(spark, d).where("l_linestatus = 'F'"), halogens)


def role_routes(spark, d):
    c = read(spark, d, "conversations")
    seq = c.groupBy(F.col("conv_id").alias("route_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), ">").alias("sb_cgr"), F.count("*").alias("n_bonds"), F.sum(F.length("text")).alias("chars"))
    return seq.withColumn("signature", F.col("chars") % 3)


ROLES = """routes AS (SELECT conv_id AS route_id, string_agg(role, '>' ORDER BY turn, role) AS sb_cgr, count(*) AS n_bonds, sum(length(text))::BIGINT % 3 AS signature FROM conversations GROUP BY 1)"""
CASCADE = """reasons AS (SELECT doc_id AS idx, text, CASE WHEN n_chars < 100 THEN 'SmallMoleculesFilter' WHEN lang = 'de' THEN 'NoReactionFilter' WHEN contains(text, '@') THEN 'parse/ValueError: at' WHEN n_chars > 8000 THEN 'DynamicBondsFilter' END AS reason FROM documents),
st AS (SELECT *, CASE WHEN reason IS NULL THEN 'ok' WHEN contains(reason, '/') THEN 'error' ELSE 'filtered' END AS status FROM reasons)"""


def reasons(spark, d):
    rules = [("SmallMoleculesFilter", F.col("n_chars") < 100), ("NoReactionFilter", F.col("lang") == "de"), ("parse/ValueError: at", F.contains("text", F.lit("@"))), ("DynamicBondsFilter", F.col("n_chars") > 8000)]
    out = records(spark, d).withColumn("reason", curation.first_reason(rules))
    return out.withColumn("status", curation.error_class(F.col("reason")))


# --- curation -------------------------------------------------------------------------------


@query("SELECT doc_id AS idx, trim(string_split(text || chr(9) || source || chr(9) || lang, chr(9))[1], ' ') AS smiles, source || ';' || lang AS source_info FROM documents")
def record_split(spark, d):
    r = records(spark, d).select("idx", curation.split_record(F.col("raw")).alias("s"))
    return r.select("idx", "s.smiles", curation.provenance(F.col("s.fields")).alias("source_info"))


@query(f"WITH {CASCADE} SELECT idx, reason, status FROM st")
def cascade_first_reason(spark, d):
    return reasons(spark, d).select("idx", "reason", "status")


@query(f"WITH {CASCADE} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM st GROUP BY 1")
def cascade_summary(spark, d):
    return curation.breakdown(reasons(spark, d).select(F.coalesce("reason", F.lit("ok")).alias("reason")), "reason")


@query("SELECT min(doc_id) AS idx, md5(text) AS key FROM documents GROUP BY text")
def dedup_keep_first(spark, d):
    return curation.keep_first(records(spark, d).select(F.md5("raw").alias("_"), "idx", F.md5("text").alias("key")).drop("_"), ["key"], "idx")


@query(f"WITH {CASCADE} SELECT count(*) AS total_input, (SELECT count(DISTINCT text) FROM st WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status = 'filtered') AS filtered, count(*) FILTER (WHERE status = 'error') AS errored, count(*) FILTER (WHERE status = 'ok') - (SELECT count(DISTINCT text) FROM st WHERE status = 'ok') AS duplicates FROM st")
def pipeline_summary(spark, d):
    return curation.summary(reasons(spark, d).withColumn("key", F.md5("text")), "status", ["key"])


# --- mining ---------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT cgr_key, rule_smarts, popularity, array_to_string(reaction_indices, ',') AS reaction_indices FROM rules")
def rule_popularity(spark, d):
    r = mining.popularity(pairs(spark, d))
    return r.select("cgr_key", "rule_smarts", "popularity", F.array_join(F.transform("reaction_indices", lambda x: x.cast("string")), ",").alias("reaction_indices"))


@query(f"WITH {PAIRS} SELECT rule_id, cgr_key, popularity FROM ranked")
def rules_ranked(spark, d):
    return ranked_rules(spark, d).select("rule_id", "cgr_key", "popularity")


@query(f"WITH {PAIRS} SELECT count(*) AS total, count(*) FILTER (WHERE validation <> 'passed') AS rejected_validation, count(*) FILTER (WHERE validation = 'passed' AND popularity < 30) AS rejected_popularity, count(*) FILTER (WHERE validation = 'passed' AND popularity >= 30) AS passed FROM rules")
def rule_filter_stats(spark, d):
    return mining.statistics(mining.key_statistics(pairs(spark, d)), 30)


@query(f"WITH {PAIRS} SELECT rxn_idx, rule_id FROM rmap")
def reaction_rule_map(spark, d):
    return mining.reactions_of(pairs(spark, d), ranked_rules(spark, d))


@query(f"WITH {PAIRS} SELECT o_orderkey AS rxn_idx, md5(o_orderpriority || o_custkey::VARCHAR) AS product_smiles, rule_id FROM orders JOIN rmap ON rxn_idx = o_orderkey")
def policy_data(spark, d):
    products = read(spark, d, "orders").select(F.col("o_orderkey").alias("rxn_idx"), F.md5(F.concat("o_orderpriority", F.col("o_custkey").cast("string"))).alias("product_smiles"))
    return mining.policy_rows(products, mining.reactions_of(pairs(spark, d), ranked_rules(spark, d)))


@query(f"WITH {PAIRS} SELECT count(DISTINCT rule_id) AS rules, count(DISTINCT i) AS covered FROM (SELECT rule_id, unnest(reaction_indices) AS i FROM ranked)")
def rule_coverage(spark, d):
    return mining.coverage(pairs(spark, d), ranked_rules(spark, d))


@query(f"WITH {PAIRS} SELECT rule_id, popularity, sum(popularity) OVER (ORDER BY rule_id)::BIGINT AS cumulative, round(sum(popularity) OVER (ORDER BY rule_id) / sum(popularity) OVER (), 6) AS share FROM ranked")
def rule_pareto(spark, d):
    return mining.pareto(ranked_rules(spark, d))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def rule_duplicates(spark, d):
    return mining.duplicates(read(spark, d, "part"), ["p_brand", "p_type"])


@query("SELECT p_type, CASE WHEN bool_or(p_brand = b1) AND bool_or(p_brand = b2) THEN 'shared' WHEN bool_or(p_brand = b1) THEN 'only_a' ELSE 'only_b' END AS side FROM part, (SELECT min(p_brand) AS b1, max(p_brand) AS b2 FROM part) WHERE p_brand IN (b1, b2) GROUP BY 1")
def ruleset_diff(spark, d):
    part = read(spark, d, "part")
    ends = F.broadcast(part.agg(F.min("p_brand").alias("b1"), F.max("p_brand").alias("b2")))  # one row
    a, b = (part.join(ends, F.col("p_brand") == F.col(x)).select("p_type").distinct() for x in ("b1", "b2"))
    return mining.difference(a, b, "p_type")


# --- policy ---------------------------------------------------------------------------------


@query(f"WITH {LOGITS}, p AS (SELECT mol_id, rule_id, exp(f - max(f) OVER w) / sum(exp(f - m)) OVER w AS prob FROM (SELECT *, max(f) OVER (PARTITION BY mol_id) AS m FROM logits) WINDOW w AS (PARTITION BY mol_id)), t AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY prob DESC, rule_id) AS rank FROM p) SELECT mol_id, rule_id, rank, round(prob, 6) AS prob FROM t WHERE rank <= 10")
def softmax_topk(spark, d):
    return policy.ranking(logits(spark, d), 10).select("mol_id", "rule_id", "rank", F.round("prob", 6).alias("prob"))


@query(f"WITH {LOGITS}, t AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY f DESC, rule_id) AS rank FROM logits), c AS (SELECT *, exp(f - max(f) OVER (PARTITION BY mol_id)) AS e FROM t WHERE rank <= 10) SELECT mol_id, rule_id, rank, round(e / sum(e) OVER (PARTITION BY mol_id), 6) AS prob FROM c")
def filtering_topk_then_softmax(spark, d):
    return policy.filtering(logits(spark, d), 10).select("mol_id", "rule_id", "rank", F.round("prob", 6).alias("prob"))


@query(f"WITH {LOGITS}, m AS (SELECT *, (f + 0.5 * r) / 2.0 AS x FROM logits), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY mol_id)) AS e FROM m), p AS (SELECT *, e / sum(e) OVER (PARTITION BY mol_id) AS prob FROM e), t AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY prob DESC, rule_id) AS rank FROM p) SELECT mol_id, rule_id, rank, round(prob, 6) AS prob FROM t WHERE rank <= 10")
def combined_policy(spark, d):
    return policy.combined(logits(spark, d), 0.5, 2.0, 10).select("mol_id", "rule_id", "rank", F.round("prob", 6).alias("prob"))


# --- reaction graphs ------------------------------------------------------------------------


@query(f"WITH {BONDS} SELECT rxn_idx, a, b, ord, p_ord FROM bonds")
def cgr_compose(spark, d):
    return bonds(spark, d)


@query(f"WITH {BONDS} SELECT DISTINCT rxn_idx, unnest([a, b]) AS atom FROM bonds WHERE ord IS DISTINCT FROM p_ord")
def center_atoms(spark, d):
    return cgr.center_atoms(bonds(spark, d))


@query(f"WITH {CHANGES} SELECT *, NOT (formed + broken + changed BETWEEN 1 AND 6) AS is_rejected FROM changes")
def bond_change_counts(spark, d):
    return cgr.bond_changes(bonds(spark, d)).withColumn("is_rejected", cgr.dynamic_bonds_reject(1, 6))


@query(f"WITH {CHANGES} SELECT rxn_idx, CASE WHEN formed + broken + changed = 0 THEN 'other' WHEN broken + changed = 0 THEN 'bond_formation' WHEN formed + changed = 0 THEN 'bond_breaking' ELSE 'substitution' END AS class FROM changes")
def reaction_class(spark, d):
    return cgr.bond_changes(bonds(spark, d)).select("rxn_idx", cgr.broad_class().alias("class"))


@query(f"WITH {BONDS}, c AS (SELECT DISTINCT rxn_idx, unnest([a, b]) AS atom FROM bonds WHERE ord IS DISTINCT FROM p_ord), s AS (SELECT rxn_idx, a AS x, b AS y FROM bonds UNION ALL SELECT rxn_idx, b, a FROM bonds) SELECT rxn_idx, atom FROM c UNION SELECT s.rxn_idx, y FROM s JOIN c ON s.rxn_idx = c.rxn_idx AND s.x = c.atom")
def environment_1hop(spark, d):
    return cgr.center_environment(bonds(spark, d), 1)


@query(f"WITH {BONDS}, s AS (SELECT rxn_idx, unnest([a, b]) AS atom, ord IS NOT NULL AS l, p_ord IS NOT NULL AS r FROM bonds) SELECT rxn_idx, atom, CASE WHEN bool_or(l) THEN 'leaving' ELSE 'incoming' END AS kind FROM s GROUP BY 1, 2 HAVING NOT (bool_or(l) AND bool_or(r))")
def leaving_incoming(spark, d):
    return cgr.leaving_incoming(bonds(spark, d))


@query(f"WITH {BONDS} SELECT rxn_idx, string_agg(least(a, b)::VARCHAR || '-' || greatest(a, b)::VARCHAR, ',' ORDER BY least(a, b), greatest(a, b)) AS bonds, count(*) AS n_bonds FROM bonds WHERE ord IS NULL GROUP BY 1")
def strategic_bonds(spark, d):
    return cgr.strategic(bonds(spark, d))


@query("SELECT l_suppkey AS route_id, l_orderkey % 100 AS a, l_partkey % 50 AS b, arg_min(l_linenumber % 3 + 1, (l_shipdate, l_orderkey, l_linenumber))::BIGINT AS ord, arg_max(floor(l_quantity)::BIGINT % 3 + 1, (l_shipdate, l_orderkey, l_linenumber)) AS p_ord FROM lineitem GROUP BY 1, 2, 3")
def route_cgr_fold(spark, d):
    line = read(spark, d, "lineitem")
    return cgr.fold(line.select(F.col("l_suppkey").alias("route_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("step"), (F.col("l_orderkey") % 100).alias("a"), (F.col("l_partkey") % 50).alias("b"), (F.col("l_linenumber") % 3 + 1).cast("long").alias("ord"), (F.floor("l_quantity") % 3 + 1).alias("p_ord")))


# --- search trees ---------------------------------------------------------------------------


@query(f"WITH RECURSIVE {NODES} SELECT leaf AS node_id, max(hop)::BIGINT AS depth FROM walk GROUP BY leaf")
def tree_depth(spark, d):
    return tree.depths(nodes(spark, d))


@query(f"WITH RECURSIVE {NODES} SELECT leaf AS node_id, round(sum(n.total_value) / (count(*) * count(*)), 9) AS score, count(*) AS length FROM walk JOIN nodes n ON n.node_id = walk.node_id JOIN nodes l ON l.node_id = leaf AND l.solved GROUP BY leaf")
def route_score(spark, d):
    return tree.route_scores(nodes(spark, d))


UCT = f"WITH RECURSIVE {NODES}, s AS (SELECT n.parent_id, n.node_id, round(n.total_value + 0.1 * sqrt(p.visits) / (n.visits + 1), 9) AS uct, round(n.total_value + n.prob * (0.1 * sqrt(p.visits) / (n.visits + 1)), 9) AS puct FROM nodes n JOIN nodes p ON p.node_id = n.parent_id)"


@query(f"{UCT} SELECT * FROM s")
def uct_puct_scores(spark, d):
    return tree.selection_scores(nodes(spark, d), 0.1)


@query(f"{UCT} SELECT parent_id, arg_max(node_id, (uct, -node_id)) AS child, max(uct) AS best FROM s GROUP BY 1")
def select_child(spark, d):
    return tree.select_child(tree.selection_scores(nodes(spark, d), 0.1))


@query(f"WITH RECURSIVE {NODES} SELECT node_id, parent_id, rank() OVER (PARTITION BY parent_id ORDER BY prob DESC) AS rule_rank FROM nodes")
def winning_rule_ranks(spark, d):
    return tree.rule_ranks(nodes(spark, d))


@query(f"WITH RECURSIVE {NODES}, dep AS (SELECT leaf AS node_id, max(hop)::BIGINT AS depth FROM walk GROUP BY 1), k AS (SELECT parent_id AS node_id, count(*) AS k FROM nodes GROUP BY 1) SELECT depth, count(*) AS nodes, round(avg(k), 2) AS mean_children FROM dep JOIN k ON k.node_id = dep.node_id GROUP BY depth")
def branching_profile(spark, d):
    return tree.branching(nodes(spark, d))


@query(f"WITH RECURSIVE {NODES} SELECT node_id, count(*) AS walks FROM walk WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = leaf) GROUP BY 1")
def visit_backup(spark, d):
    return tree.visit_backup(nodes(spark, d))


@query(f"WITH RECURSIVE {NODES}, c AS (SELECT parent_id, list_sort(list(total_value)) AS v FROM nodes GROUP BY 1), t AS (SELECT parent_id, v[floor(0.6 * (len(v) - 1))::BIGINT + 1] AS cut FROM c) SELECT n.parent_id, node_id, total_value, cut FROM nodes n JOIN t ON t.parent_id = n.parent_id WHERE total_value >= cut")
def lazy_percentile(spark, d):
    return tree.percentile_keep(nodes(spark, d), 0.6)


@query(f"WITH RECURSIVE {NODES}, t AS (SELECT node_id % 17 AS target, node_id, total_value, row_number() OVER (PARTITION BY node_id % 17 ORDER BY total_value DESC, node_id) AS place FROM nodes) SELECT * FROM t WHERE place <= 10")
def beam_cut(spark, d):
    return tree.beam(nodes(spark, d).select((F.col("node_id") % 17).alias("target"), "node_id", "total_value"), "target", "total_value", 10)


# --- stock and route quality ----------------------------------------------------------------


def stocked(spark, d):
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    parts = part.select("p_partkey", "p_size", "p_brand")
    marked = quality.in_stock(parts, parts.where("p_size % 2 = 0").select("p_partkey"), "p_partkey", "p_size", 20)
    return line.select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_linenumber").join(marked, "p_partkey")


@query("SELECT p_partkey, p_size <= 20 OR p_size % 2 = 0 AS in_stock FROM part")
def stock_membership(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_size")
    return quality.in_stock(part, part.where("p_size % 2 = 0").select("p_partkey"), "p_partkey", "p_size", 20).select("p_partkey", "in_stock")


@query("SELECT l_orderkey, bool_and(p_size <= 20 OR p_size % 2 = 0) AS solved, count(*) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def solved_targets(spark, d):
    return quality.solved(stocked(spark, d), "l_orderkey")


@query(f"WITH {INTER} SELECT severity, count(*) AS n, sum(overlap)::BIGINT AS overlap FROM inter GROUP BY 1")
def severity_lookup(spark, d):
    return interactions(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.sum("overlap").alias("overlap"))


@query(f"WITH {INTER} SELECT route_id, score FROM site")
def competing_sites_score(spark, d):
    return site_scores(spark, d)


@query(f"WITH {INTER}, m AS (SELECT CASE WHEN max(o_totalprice) > 0 THEN max(o_totalprice) ELSE 1 END AS m FROM orders), r AS (SELECT o_orderkey AS route_id, o_totalprice AS original, coalesce(score, 0) AS site_score, round(0.5 * o_totalprice / m + 0.5 * coalesce(score, 0), 6) AS combined FROM orders LEFT JOIN site ON route_id = o_orderkey, m) SELECT *, row_number() OVER (ORDER BY combined DESC, route_id) AS place FROM r")
def rank_routes_combined(spark, d):
    routes = read(spark, d, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_totalprice").alias("original"))
    return quality.rank_routes(routes, site_scores(spark, d), 0.5)


@query(f"WITH {INTER} SELECT route_id, count(*) FILTER (WHERE severity = 'compatible') AS compatible, count(*) FILTER (WHERE severity = 'competing') AS competing, count(*) FILTER (WHERE severity = 'incompatible') AS incompatible FROM inter GROUP BY 1")
def classify_interactions(spark, d):
    return quality.kinds(interactions(spark, d))


@query(f"WITH {INTER} SELECT route_id AS step_id, arg_max(p_name, (overlap, -place)) AS reacting_fg, max(overlap) AS overlap FROM inter GROUP BY 1")
def reacting_fg(spark, d):
    return quality.reacting_group(interactions(spark, d).select(F.col("route_id").alias("step_id"), F.col("p_name").alias("name"), "overlap", "place"))


# --- clusters -------------------------------------------------------------------------------


@query(f"WITH {ROLES}, g AS (SELECT n_bonds, sb_cgr, string_agg(route_id::VARCHAR, ',' ORDER BY route_id) AS route_ids, count(*) AS group_size FROM routes GROUP BY 1, 2) SELECT n_bonds::VARCHAR || '.' || (row_number() OVER (PARTITION BY n_bonds ORDER BY length(sb_cgr), sb_cgr))::VARCHAR AS cluster_key, sb_cgr, route_ids, group_size FROM g")
def cluster_routes(spark, d):
    return clusters.clusters(role_routes(spark, d), "sb_cgr", "n_bonds")


@query(f"WITH {ROLES}, g AS (SELECT sb_cgr, signature, count(*) AS group_size, min(route_id) AS first_route FROM routes GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY sb_cgr ORDER BY group_size DESC, first_route) AS sub_id FROM g")
def subclusters(spark, d):
    return clusters.subclusters(role_routes(spark, d), "sb_cgr", "signature")


@query("SELECT * FROM (SELECT conv_id, turn, role AS from_value, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS to_value FROM conversations) WHERE to_value IS NOT NULL")
def route_pairs(spark, d):
    return clusters.step_pairs(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query("SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id) AS prior FROM events e")
def prior_step_asof(spark, d):
    return clusters.prior_step(read(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "prior")


# --- learning -------------------------------------------------------------------------------


@query("WITH c AS (SELECT doc_id, source || lang AS rule, count(*) OVER (PARTITION BY text) = 1 AS single FROM documents), p AS (SELECT *, count(*) OVER (PARTITION BY rule, single) AS n, row_number() OVER (PARTITION BY rule, single ORDER BY md5(doc_id::VARCHAR), doc_id) AS place FROM c) SELECT doc_id, CASE WHEN single AND n > 20 AND place <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS part FROM p")
def stratified_split(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("product"), F.concat("source", "lang").alias("rule"))
    return learning.stratified_split(docs, "product", "rule", "doc_id").select("doc_id", "part")


@query("SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id)::BIGINT AS label FROM events GROUP BY 1")
def value_labels(spark, d):
    return learning.last_label(read(spark, d, "events"), "user_id", "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long"))


@query("SELECT l_orderkey, string_agg(r::VARCHAR, ',' ORDER BY r) AS labels FROM (SELECT DISTINCT l_orderkey, p_size AS r FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def multi_hot_labels(spark, d):
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    return learning.multi_hot(line.join(part, line.l_partkey == part.p_partkey), "l_orderkey", "p_size")


@query(f"WITH {LOGITS}, k AS (SELECT mol_id, label, rule_id, rank() OVER (PARTITION BY mol_id ORDER BY f DESC) AS rank FROM logits) SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS top5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS top10 FROM k WHERE rule_id = label")
def topk_accuracy(spark, d):
    own = logits(spark, d)
    return learning.rank_accuracy(own, own.where("rule_id = label").select("mol_id", "rule_id"))


@query("WITH s AS (SELECT vec_id, label, list_filter(range(1, 65), lambda i: embedding[i] > 0) AS s FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS tanimoto FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id")
def tanimoto_pairs(spark, d):
    bits = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i + 1)), lambda i: i.isNotNull())
    own = read(spark, d, "embeddings")
    size = own.agg(F.max(F.size("embedding"))).first()[0] or 0
    words = [f"w{i}" for i, _ in enumerate(learning.bit_words(bits, size))]
    # sets are made once, not for every pair that they are in
    own = Stage(spark, "bits").put(own.select("vec_id", "label", *(w.alias(n) for n, w in zip(words, learning.bit_words(bits, size), strict=True))), "sets")
    both = learning.label_pairs(own.withColumnRenamed("vec_id", "id"), words)
    return both.select("a", "b", learning.word_tanimoto([F.col(f"x{n}") for n in words], [F.col(f"y{n}") for n in words], 6).alias("tanimoto"))


@query("SELECT coalesce(c_mktsegment, 'TOTAL') AS bucket, count(*) AS targets, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS solve_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)")
def solve_rate_rollup(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    both = o.join(c, o.o_custkey == c.c_custkey)
    return both.rollup("c_mktsegment").agg(F.count("*").alias("targets"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("solve_rate")).select(F.coalesce("c_mktsegment", F.lit("TOTAL")).alias("bucket"), "targets", "solve_rate")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- more of curation, mining, graphs and trees ----------------------------------------------


@query(f"WITH {CASCADE} SELECT idx, CASE WHEN contains(reason, '/') THEN split_part(reason, '/', 1) END AS stage, CASE WHEN contains(reason, '/') THEN 'ValueError' END AS error_type, CASE WHEN contains(reason, '/') THEN 'at' END AS message, CASE WHEN contains(reason, '/') THEN 'data' ELSE 'pipeline' END AS origin FROM st")
def reason_split(spark, d):
    own = reasons(spark, d).select("idx", curation.reason_parts(F.col("reason")).alias("p")).select("idx", "p.*")
    return own.withColumn("origin", F.coalesce(reactions.fault_origin(F.col("stage"), F.col("error_type")), F.lit("pipeline")))


@query(f"WITH {PAIRS}, r AS (SELECT popularity, sum(popularity) OVER (ORDER BY popularity DESC, rule_id) AS upto, sum(popularity) OVER () AS total FROM ranked) SELECT count(*) AS rules, quantile_cont(popularity, 0.25) AS p25, quantile_cont(popularity, 0.5) AS p50, quantile_cont(popularity, 0.75) AS p75, quantile_cont(popularity, 0.9) AS p90, max(popularity) AS top, count(*) FILTER (WHERE upto < 0.8 * total) + 1 AS n_share FROM r")
def rule_popularity_profile(spark, d):
    return mining.popularity_profile(ranked_rules(spark, d))


@query(f"WITH {PAIRS} SELECT cgr_key, rule_smarts, popularity, first_idx FROM rules")
def merged_statistics(spark, d):
    own = pairs(spark, d)
    parts = [mining.key_statistics(own.where(F.col("rxn_idx") % 3 == i)) for i in range(3)]
    return mining.merge_statistics(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("cgr_key", "rule_smarts", "popularity", "first_idx")


def _pair_list(where: str) -> str:
    return f"coalesce(string_agg(a::VARCHAR || '-' || b::VARCHAR, ',' ORDER BY a, b) FILTER (WHERE {where}), '')"


@query(f"WITH {BONDS} SELECT rxn_idx, {_pair_list('ord IS NULL')} AS formed, {_pair_list('p_ord IS NULL')} AS broken, {_pair_list('ord <> p_ord')} AS changed FROM bonds WHERE ord IS DISTINCT FROM p_ord GROUP BY 1")
def bond_change_pairs(spark, d):
    own = cgr.change_pairs(bonds(spark, d))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x.a.cast("string"), x.b.cast("string"))), ",")
    return own.select("rxn_idx", *(text(f"{k}_pairs").alias(k) for k in ("formed", "broken", "changed")))


@query(f"WITH {BONDS}, q AS (SELECT l_orderkey AS rxn_idx, l_suppkey AS atom, min(l_linenumber % 2) AS charge, max(l_linenumber % 2) AS p_charge FROM lineitem GROUP BY 1, 2) SELECT DISTINCT rxn_idx, unnest([a, b]) AS atom FROM bonds WHERE ord IS DISTINCT FROM p_ord UNION SELECT rxn_idx, atom FROM q WHERE charge <> p_charge")
def center_with_charges(spark, d):
    line = parted(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("rxn_idx"), F.col("l_suppkey").alias("atom"), (F.col("l_linenumber") % 2).alias("c")), "rxn_idx")
    atoms = line.groupBy("rxn_idx", "atom").agg(F.min("c").alias("charge"), F.max("c").alias("p_charge"))
    return cgr.center_with_charges(bonds(spark, d), atoms)


@query(f"""WITH RECURSIVE {BONDS}, e AS (SELECT rxn_idx, a AS x, b AS y FROM bonds UNION SELECT rxn_idx, b, a FROM bonds),
    r AS (SELECT rxn_idx, x, x AS y FROM e UNION SELECT r.rxn_idx, r.x, e.y FROM r JOIN e ON e.rxn_idx = r.rxn_idx AND e.x = r.y)
    SELECT rxn_idx, count(DISTINCT m) AS parts FROM (SELECT rxn_idx, x, min(y) AS m FROM r GROUP BY 1, 2) GROUP BY 1""")
def graph_components(spark, d):
    return cgr.components(bonds(spark, d))


@query(f"WITH {BONDS} SELECT rxn_idx, a, b, CASE WHEN ord IS NOT NULL THEN p_ord END AS ord, p_ord FROM bonds WHERE p_ord IS NOT NULL")
def strategic_graph(spark, d):
    return cgr.strategic_graph(bonds(spark, d))


@query(f"WITH RECURSIVE {NODES} SELECT parent_id, max(total_value) AS value FROM nodes GROUP BY 1")
def child_value_max(spark, d):
    return tree.child_values(nodes(spark, d).withColumnRenamed("total_value", "init_value"))


@query(f"WITH RECURSIVE {NODES}, k AS (SELECT parent_id AS node_id, count(*) AS k FROM nodes GROUP BY 1), x AS (SELECT n.*, k.k, n.node_id % 4 <> 0 AS ex, n.node_id % 9 AS target_id FROM nodes n LEFT JOIN k ON k.node_id = n.node_id), kk AS (SELECT target_id, parent_id AS node_id, count(*) AS c FROM (SELECT node_id % 9 AS target_id, parent_id FROM nodes) GROUP BY 1, 2), y AS (SELECT x.target_id, x.node_id % 5 AS depth, solved, CASE WHEN ex THEN coalesce(c, 0) END AS b FROM x LEFT JOIN kk ON kk.target_id = x.target_id AND kk.node_id = x.node_id) SELECT target_id, count(*) AS num_nodes, count(*) FILTER (WHERE solved) AS num_routes, bool_or(solved) AS solved, max(depth) AS tree_depth, coalesce(max(b), 0) AS max_branching_factor, coalesce(round(avg(b), 2), 0) AS mean_branching_factor FROM y GROUP BY 1")
def tree_statistics(spark, d):
    own = nodes(spark, d).select((F.col("node_id") % 9).alias("target_id"), "node_id", "parent_id", (F.col("node_id") % 5).alias("depth"), (F.col("node_id") % 4 != 0).alias("is_expanded"), F.col("solved").alias("is_solved"))
    return tree.tree_statistics(own)


@query("SELECT user_id AS node_id, event_id AS seq, avg(value) OVER w AS mean, 0.5 + sum(value) OVER w AS cumulative FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_backup(spark, d):
    own = tree.running_values(read(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), "value"), 0.5)
    return own


@query(f"WITH RECURSIVE {NODES} SELECT node_id % 17 AS target, node_id, row_number() OVER (PARTITION BY node_id % 17 ORDER BY total_value DESC, node_id) AS place FROM nodes")
def scored_frontier(spark, d):
    return tree.frontier(nodes(spark, d).select((F.col("node_id") % 17).alias("target"), "node_id", "total_value"), "target", "total_value").drop("total_value")


@query("SELECT o_custkey % 100 AS target_id, count(*) FILTER (WHERE least((o_orderkey % 40) * 4 // 40, 3) = 0) AS q1, count(*) FILTER (WHERE least((o_orderkey % 40) * 4 // 40, 3) = 1) AS q2, count(*) FILTER (WHERE least((o_orderkey % 40) * 4 // 40, 3) = 2) AS q3, count(*) FILTER (WHERE least((o_orderkey % 40) * 4 // 40, 3) = 3) AS q4 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def routes_by_quarter(spark, d):
    found = read(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 100).alias("target_id"), (F.col("o_orderkey") % 40 + 1).alias("iteration"), F.lit(40).alias("iterations"))
    return tree.found_by_quarter(found)


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT e.user_id AS node_id, e.event_id AS seq FROM events e JOIN f ON f.user_id = e.user_id AND f.event_type = e.event_type AND first = event_id")
def new_outcomes(spark, d):
    return tree.new_outcomes(read(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("product")))


@query("SELECT o_orderkey AS node_id, CASE WHEN o_orderkey > min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) THEN min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) END AS same_as FROM orders")
def redundant_nodes(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.concat_ws(",", "o_custkey", "o_orderstatus").alias("open_parts"))
    return tree.redundant(own, "open_parts").select("node_id", "same_as")


@query(f"WITH {LOGITS} SELECT mol_id, rule_id, round(1 / (1 + exp(-f)), 9) AS sigmoid, round(0.5 * (1 / (1 + exp(-f))) + 0.5 * (rule_id % 2), 9) AS mixed, round(greatest(0, least(1, (f + 1) / 2)), 9) AS rescaled FROM logits")
def scalar_scores(spark, d):
    p = tree.sigmoid(F.col("f"))
    return logits(spark, d).select("mol_id", "rule_id", F.round(p, 9).alias("sigmoid"), F.round(tree.mixed_priority(p, (F.col("rule_id") % 2).cast("double"), 0.5), 9).alias("mixed"), F.round(tree.rescaled(F.col("f"), -1.0, 1.0), 9).alias("rescaled"))


@query("SELECT o_orderkey AS route_id, round(o_totalprice * (o_orderkey % 11 / 10.0), 6) AS full_weight, round(o_totalprice * (0.75 + 0.25 * (o_orderkey % 11 / 10.0)), 6) AS part_weight FROM orders")
def route_rescore(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderkey").alias("route_id"), "o_totalprice", (F.col("o_orderkey") % 11 / 10.0).alias("s"))
    return own.select("route_id", F.round(quality.rescored(F.col("o_totalprice"), F.col("s")), 6).alias("full_weight"), F.round(quality.rescored(F.col("o_totalprice"), F.col("s"), 0.25), 6).alias("part_weight"))


# --- molecules and reactions, spelled out from the tables' numbers ---------------------------


def alcohols(spark, d):
    """Chains of 1 to 12 carbons behind an oxygen, a nitrogen or a chlorine, written from the far end."""
    part = read(spark, d, "part")
    return part.select("p_partkey", F.concat(F.element_at(F.array(F.lit("O"), F.lit("N"), F.lit("Cl")), (F.col("p_partkey") % 3 + 1).cast("int")), F.expr("repeat('C', CAST(p_size % 12 + 1 AS INT))")).alias("smiles"))


HETERO = "CASE p_partkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'N' ELSE 'Cl' END"


@query(f"SELECT p_partkey, repeat('C', (p_size % 12 + 1)::INT) || {HETERO} AS canonical, (p_size % 12 + 2)::INT AS n_atoms, (p_size % 12 + 1)::INT AS n_bonds, 0 AS n_rings, (2 * (p_size % 12 + 1) + CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END)::INT AS n_hydrogens FROM part")
def molecule_table(spark, d):
    return reactions.distinct_molecules(alcohols(spark, d)).select("p_partkey", "canonical", "n_atoms", "n_bonds", "n_rings", "n_hydrogens")


@query(f"SELECT DISTINCT repeat('C', (p_size % 12 + 1)::INT) || {HETERO} AS smiles FROM part")
def building_block_stock(spark, d):
    return reactions.building_blocks(alcohols(spark, d))


@query("SELECT p_partkey, (p_size % 12 + 2)::BIGINT AS n_atoms, 2 * (p_size % 12 + 1)::BIGINT AS n_edges, (6 * (p_size % 12 + 1) + CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 7 ELSE 17 END)::BIGINT AS numbers FROM part")
def molecule_features(spark, d):
    own = reactions.features(alcohols(spark, d))
    return own.select("p_partkey", F.size("x").cast("long").alias("n_atoms"), F.size("edge_index").cast("long").alias("n_edges"), F.aggregate("x", F.lit(0).cast("long"), lambda s, r: s + r[0]).alias("numbers"))


def esterifications(spark, d):
    """Acids of a + 1 carbons with alcohols of b carbons, mapped: idx, a, b, smiles."""
    own = read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 4 + 1).cast("int").alias("a"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("b"))
    chain = lambda n, base: F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.concat(F.lit("[CH"), F.when(i == 1, "3").otherwise("2"), F.lit(":"), (i + base).cast("string"), F.lit("]")))
    acid, alcohol = chain("a", 0), chain("b", 30)
    left = F.concat(F.array_join(acid, ""), F.lit("[C:20](=[O:21])[OH:22]."), F.array_join(alcohol, ""), F.lit("[OH:40]"))
    right = F.concat(F.array_join(alcohol, ""), F.lit("[O:40][C:20](=[O:21])"), F.array_join(F.reverse(acid), ""), F.lit(".[OH2:22]"))
    return own.withColumn("smiles", F.concat(left, F.lit(">>"), right))


ESTERS = "est AS (SELECT o_orderkey AS idx, o_custkey % 4 + 1 AS a, o_orderkey % 5 + 1 AS b FROM orders)"
STEPS = {n: {} for n in ("functional_groups", "kekulize", "check_valence", "implicify_hydrogens", "clean_isotopes", "split_ions", "aromatize")}


@query(f"WITH {ESTERS} SELECT idx, CASE WHEN a + b <= 3 THEN 'filtered' ELSE 'ok' END AS status, CASE WHEN a + b <= 3 THEN 'SmallMoleculesFilter' END AS reason, 'ester_formation' AS class, 2 AS n_changed, 1 AS n_centers FROM est")
def reaction_curation(spark, d):
    return reactions.curate(esterifications(spark, d), steps=STEPS, filters={n: {} for n in kernels.FILTERS}).select("idx", "status", "reason", "class", "n_changed", "n_centers")


@query(f"WITH {ESTERS} SELECT idx, 'reactant' AS side, (a + b + 4)::BIGINT AS atoms, (a + b + 2)::BIGINT AS bonds FROM est UNION ALL SELECT idx, 'product', (a + b + 4)::BIGINT, (a + b + 2)::BIGINT FROM est")
def reaction_tables(spark, d):
    own = esterifications(spark, d)
    kinds = [reactions.atoms(own, "smiles", ["idx"]).select("idx", "side", F.lit(1).alias("a"), F.lit(0).alias("b")), reactions.bonds(own, "smiles", ["idx"]).select("idx", "side", F.lit(0), F.lit(1))]
    # one aggregation of both tables; sides without bonds have no row
    return kinds[0].union(kinds[1]).groupBy("idx", "side").agg(F.sum("a").alias("atoms"), F.sum("b").alias("bonds")).where("bonds > 0")


@query(f"WITH {ESTERS} SELECT idx, 20 AS a, 22 AS b, 1 AS ord, NULL::INT AS p_ord FROM est UNION ALL SELECT idx, 20, 40, NULL, 1 FROM est")
def reaction_changes(spark, d):
    return reactions.condensed_bonds(esterifications(spark, d), "smiles", ["idx"]).where(cgr.changed())


@query(f"WITH {ESTERS} SELECT 'passed' AS validation, count(*) AS popularity, min(idx) AS first_idx FROM est")
def mined_rules(spark, d):
    options = kernels.RuleOptions(single_product_only=False)
    rules = reactions.extract_rules(esterifications(spark, d), "smiles", ["idx"], options).withColumnRenamed("idx", "rxn_idx")
    return mining.key_statistics(rules).select("validation", "popularity", "first_idx")


@query("SELECT p_partkey, 7 AS rule_id, 'CC(=O)O' AS acid, repeat('C', (p_size % 12 + 1)::INT) || 'O' AS alcohol FROM part")
def rule_application(spark, d):
    esters = read(spark, d, "part").select("p_partkey", F.concat(F.lit("CC(=O)O"), F.expr("repeat('C', CAST(p_size % 12 + 1 AS INT))")).alias("smiles"))
    rules = spark.createDataFrame([(7, "[C:1](=[O:2])[O;D2:3][C:4]>>[C:1](=[O:2])[OH:5].[OH:3][C:4]"), (8, "[N:1]>>[O:1]"), (9, "broken(")], "rule_id long, rule_smarts string")
    out = reactions.apply_rules(esters, "smiles", ["p_partkey"], rules)
    acid = F.lit("CC(=O)O")
    return out.select("p_partkey", F.col("rule_id").cast("int").alias("rule_id"), F.when(F.array_contains("products", acid), acid).alias("acid"), F.coalesce(F.get(F.filter("products", lambda p: p != acid), F.lit(0)), acid).alias("alcohol"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'alcohol' WHEN 1 THEN 'amine' ELSE 'chloride' END AS name, CASE p_partkey % 3 WHEN 2 THEN 'halogen' ELSE 'polar' END AS category FROM part")
def functional_group_matches(spark, d):
    patterns = spark.createDataFrame([(0, "alcohol", "polar", "[O;D1;$(O[C;X4])]"), (1, "amine", "polar", "[N;D1;!$(N=*)]"), (2, "chloride", "halogen", "[Cl][C]")], "place int, name string, category string, smarts string")
    return reactions.functional_groups(alcohols(spark, d), "smiles", patterns).select("p_partkey", F.explode("groups").alias("g")).select("p_partkey", "g.name", "g.category")


# --- clusters, sets and metrics -------------------------------------------------------------


def leaving_groups(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").cast("long").alias("mark"), F.when(F.col("l_linenumber") == 2, "x").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("lg")).distinct()


LGS = "lgs AS (SELECT DISTINCT l_orderkey AS route_id, l_linenumber::BIGINT AS mark, CASE WHEN l_linenumber = 2 THEN 'x' ELSE l_returnflag || l_linestatus END AS lg FROM lineitem), sig AS (SELECT route_id, string_agg(mark::VARCHAR || '=' || lg, ';' ORDER BY mark, lg) AS signature, count(*) AS n FROM lgs GROUP BY 1)"


@query(f"WITH {LGS} SELECT mark, lg, min(route_id) AS first_route FROM lgs GROUP BY 1, 2")
def leaving_group_sets(spark, d):
    return clusters.distinct_groups(leaving_groups(spark, d))


@query(f"WITH {LGS} SELECT signature, count(*) AS group_size, min(route_id) AS first_route FROM sig GROUP BY 1")
def identical_signatures(spark, d):
    return clusters.identical(leaving_groups(spark, d))


@query(f"WITH {LGS}, k AS (SELECT mark, row_number() OVER (ORDER BY mark) AS new FROM lgs GROUP BY mark HAVING min(lg) <> max(lg)) SELECT route_id, new AS mark, lg FROM lgs JOIN k ON k.mark = lgs.mark")
def varying_leaving_groups(spark, d):
    return clusters.without_constant(leaving_groups(spark, d))


@query(f"WITH {LGS}, g AS (SELECT signature, n, count(*) AS group_size, min(route_id) AS first_route FROM sig GROUP BY 1, 2) SELECT n::VARCHAR || '_' || (row_number() OVER (PARTITION BY n ORDER BY first_route))::VARCHAR AS sub_id, signature, group_size, first_route FROM g")
def numbered_subclusters(spark, d):
    own = leaving_groups(spark, d)
    counted = clusters.signatures(own).join(own.groupBy("route_id").agg(F.count("*").alias("n")), "route_id")
    return clusters.numbered_subclusters(counted, ["signature"], "n")


@query(f"WITH {ROLES}, g AS (SELECT DISTINCT n_bonds, sb_cgr FROM routes), k AS (SELECT *, n_bonds::VARCHAR || '.' || (row_number() OVER (PARTITION BY n_bonds ORDER BY length(sb_cgr), sb_cgr))::VARCHAR AS cluster_key FROM g), m AS (SELECT route_id, cluster_key FROM routes JOIN k ON k.n_bonds = routes.n_bonds AND k.sb_cgr = routes.sb_cgr WHERE routes.n_bonds >= 3) SELECT cluster_key, route_id, count(*) OVER (PARTITION BY cluster_key) AS group_size FROM m")
def filtered_clusters(spark, d):
    own = role_routes(spark, d)
    return clusters.without_routes(clusters.membership(own, "sb_cgr", "n_bonds"), own.where("n_bonds < 3"))


@query("WITH x AS (SELECT o_orderstatus AS l, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS p FROM orders), c AS (SELECT l AS c, count(*) FILTER (WHERE l = p) AS hit, count(*) AS t FROM x GROUP BY 1), g AS (SELECT p AS c, count(*) AS g FROM x GROUP BY 1) SELECT round(sum(hit) / sum(t), 9) AS accuracy, round(avg(hit / t), 9) AS balanced_accuracy, round(avg(2 * hit / (t + coalesce(g, 0))), 9) AS f1 FROM c LEFT JOIN g ON g.c = c.c")
def class_metrics(spark, d):
    own = read(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("p"))
    m = learning.class_metrics(own, "o_orderstatus", "p")
    return m.select(*(F.round(c, 9).alias(c) for c in m.columns))


@query("SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS binary, round(avg(-ln(p)), 9) AS categorical FROM (SELECT l_discount * 5 + 0.1 AS p, l_linenumber % 2 AS y FROM lineitem)")
def losses(spark, d):
    own = read(spark, d, "lineitem").select((F.col("l_discount") * 5 + 0.1).alias("p"), (F.col("l_linenumber") % 2).alias("y"))
    return own.agg(F.round(learning.binary_cross_entropy(F.col("p"), F.col("y")), 9).alias("binary"), F.round(learning.cross_entropy(F.col("p")), 9).alias("categorical"))


@query(f"WITH RECURSIVE {NODES}, s AS (SELECT DISTINCT walk.node_id FROM walk JOIN nodes l ON l.node_id = leaf AND l.solved) SELECT n.node_id % 1000 AS smiles, arg_max(CASE WHEN s.node_id IS NULL THEN 0 ELSE 1 END, n.node_id)::BIGINT AS label FROM nodes n LEFT JOIN s ON s.node_id = n.node_id WHERE n.parent_id IN (SELECT node_id FROM nodes) GROUP BY 1")
def solved_path_labels(spark, d):
    return learning.path_labels(nodes(spark, d).withColumn("smiles", F.col("node_id") % 1000))


@query("SELECT conv_id, string_agg(role, '.' ORDER BY role) AS united, bool_and(role IN ('user', 'assistant', 'system')) AS usual FROM conversations GROUP BY 1")
def united_parts(spark, d):
    own = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return own.select("conv_id", reactions.united(F.col("r")).alias("united"), F.expr("forall(r, x -> x IN ('user', 'assistant', 'system'))").alias("usual"))


@query(f"WITH {ESTERS} SELECT idx, true AS back FROM est")
def reversed_reactions(spark, d):
    own = esterifications(spark, d)
    turned = reactions.reversed_reaction(F.col("smiles"))
    return own.select("idx", ((reactions.reversed_reaction(turned) == F.col("smiles")) & F.startswith(turned, F.get(F.split("smiles", ">>"), F.lit(1)))).alias("back"))


@query(f"WITH {LOGITS}, m AS (SELECT *, (f + 0.5 * r) / 2.0 AS x FROM logits) SELECT mol_id, round(max(x), 9) AS best, count(*) AS rules FROM m GROUP BY 1")
def joined_logits(spark, d):
    own = logits(spark, d)
    both = policy.joined_logits(own.select("mol_id", "rule_id", "f"), own.select("mol_id", "rule_id", "r"))
    return both.groupBy("mol_id").agg(F.round(F.max((F.col("f") + 0.5 * F.col("r")) / 2.0), 9).alias("best"), F.count("*").alias("rules"))


@query(f"WITH RECURSIVE {NODES}, k AS (SELECT node_id, rank() OVER (PARTITION BY parent_id ORDER BY prob DESC) AS r FROM nodes), w AS (SELECT leaf, node_id FROM walk WHERE leaf IN (SELECT node_id FROM nodes WHERE solved)), s AS (SELECT leaf, sum(n.total_value) / (count(*) * count(*)) AS score FROM w JOIN nodes n ON n.node_id = w.node_id GROUP BY leaf) SELECT (SELECT round(max(score), 6) FROM s) AS best_score, (SELECT round(avg(r), 2) FROM w JOIN k ON k.node_id = w.node_id WHERE w.node_id IN (SELECT node_id FROM nodes WHERE parent_id IN (SELECT node_id FROM nodes))) AS mean_rank")
def winning_summary(spark, d):
    return tree.winning_summary(nodes(spark, d))


# --- streams, networks, numbering ------------------------------------------------------------


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_curation(spark, d):
    # a pattern, since a stream reads a folder or a pattern, and the table may be a single file
    own, out, key = read(spark, d, "events"), Stage(spark, "streamed").path, ["user_id", "event_type"]
    curate(record_stream(spark, f"{d}/event[s].parquet", own.schema, bytes_per_batch=BATCH_BYTES), key, "event_id", out).awaitTermination()
    # merged by event_id, so that it doesn't matter in which order files come
    parts = statistics(spark, out, own.schema)
    return parts.groupBy(*key).agg(F.min("first_idx").alias("event_id"), F.min_by("value", "first_idx").alias("value"), F.sum("popularity").alias("n"))


# an order is a reaction: its first line's part is made of those of its other lines; parts of three sizes of each seven are stock
NETWORK = """lines AS (SELECT l_orderkey AS reaction, l_partkey AS molecule, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem),
products AS (SELECT reaction, molecule AS product FROM lines WHERE k = 1),
needs AS (SELECT DISTINCT reaction, molecule AS part FROM lines WHERE k > 1),
solved(molecule, depth, reaction) USING KEY (molecule) AS (
    SELECT p_partkey, 0, NULL::BIGINT FROM part WHERE p_size % 7 < 3
    UNION
    SELECT product, depth, reaction FROM (
        SELECT product, max(depth) AS depth, min(reaction) AS reaction FROM (
            SELECT p.product, p.reaction, max(s.depth) + 1 AS depth FROM products p JOIN needs n ON n.reaction = p.reaction LEFT JOIN recurring.solved s ON s.molecule = n.part
            GROUP BY p.product, p.reaction HAVING count(*) = count(s.molecule)) GROUP BY product)
    WHERE product NOT IN (SELECT molecule FROM recurring.solved))"""


def network(spark, d):
    line = read(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    line = parted(line.select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", count=line.count())
    lines = Stage(spark, "lines").put(line.select(F.col("l_orderkey").alias("reaction"), F.col("l_partkey").alias("molecule"), place.alias("k")), "lines")
    stock = read(spark, d, "part").where("p_size % 7 < 3").select(F.col("p_partkey").alias("molecule"))
    return lines.where("k = 1").select("reaction", F.col("molecule").alias("product")), lines.where("k > 1").select("reaction", F.col("molecule").alias("part")), stock


@query(f"WITH RECURSIVE {NETWORK} SELECT p_partkey AS molecule, depth IS NOT NULL AS solved, depth, reaction FROM part LEFT JOIN solved ON molecule = p_partkey")
def network_search(spark, d):
    products, parts, stock = network(spark, d)
    found = networks.solve(products, parts, stock)
    return read(spark, d, "part").select(F.col("p_partkey").alias("molecule")).join(found, "molecule", "left").select("molecule", F.col("depth").isNotNull().alias("solved"), "depth", "reaction")


@query(f"""WITH RECURSIVE {NETWORK}, way(target, molecule) AS (
    SELECT molecule, molecule FROM solved WHERE molecule % 20 = 0 UNION SELECT w.target, n.part FROM way w JOIN solved s ON s.molecule = w.molecule JOIN needs n ON n.reaction = s.reaction)
SELECT w.target, count(*) AS molecules, count(s.reaction) AS steps, count(*) FILTER (WHERE s.reaction IS NULL) AS bought, max(s.depth) AS depth FROM way w JOIN solved s ON s.molecule = w.molecule GROUP BY 1""")
def network_routes(spark, d):
    products, parts, stock = network(spark, d)
    targets = read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("target"))
    ways = networks.routes(targets, networks.solve(products, parts, stock), parts)
    return ways.groupBy("target").agg(F.count("*").alias("molecules"), F.count("reaction").alias("steps"), F.count_if(F.col("reaction").isNull()).alias("bought"), F.max("depth").alias("depth"))


# a customer is a route, an order a step, a line's part an atom; atoms whose parts end alike are the same
ATOMS = """a AS (SELECT DISTINCT o_custkey AS route, l_orderkey AS step, l_partkey AS atom, l_partkey % 50 AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, min((step, atom)) OVER (PARTITION BY route, name) AS first FROM a)"""


@query(f"WITH {ATOMS} SELECT route, step, atom, dense_rank() OVER (PARTITION BY route ORDER BY first) AS number FROM n")
def route_atom_numbers(spark, d):
    line, order = read(spark, d, "lineitem"), read(spark, d, "orders")
    n = line.count()
    own = parted(line, "l_orderkey", count=n).join(parted(order, "o_orderkey", count=n), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.select(F.col("o_custkey").alias("route"), F.col("l_orderkey").alias("step"), F.col("l_partkey").alias("atom"), (F.col("l_partkey") % 50).alias("name"))
    own = Stage(spark, "atoms").put(parted(own, "route", count=n).distinct(), "own")
    # each atom beside the next of its name: a chain, so that joining it needs the components
    after = Window.partitionBy("route", "name").orderBy("step", "atom")
    same = parted(own, "route", count=n).select("route", F.col("step").alias("step_a"), F.col("atom").alias("atom_a"), F.lead("step").over(after).alias("step_b"), F.lead("atom").over(after).alias("atom_b"))
    return numbering.route_numbers(own, same.where("step_b is not null"))


@query("""WITH RECURSIVE l AS (SELECT l_suppkey AS route, l_partkey % 400 AS a, l_orderkey % 400 + 400 AS b FROM lineitem WHERE l_quantity < 3),
t AS (SELECT route, min((a, b)) AS m FROM l GROUP BY route),
cut AS (SELECT route, m[1] AS inner_, m[2] AS outer_ FROM t),
e AS (SELECT l.route, a, b FROM l JOIN cut ON cut.route = l.route WHERE a <> inner_ OR b <> outer_),
u AS (SELECT route, a, b FROM e UNION SELECT route, b, a FROM e),
s AS (SELECT DISTINCT route, x FROM (SELECT route, a AS x FROM l UNION ALL SELECT route, b FROM l)),
r(route, x, y) AS (SELECT route, x, x FROM s UNION SELECT r.route, r.x, u.b FROM r JOIN u ON u.route = r.route AND u.a = r.y),
c AS (SELECT route, x, min(y) AS root FROM r GROUP BY route, x)
SELECT cut.route, 1 AS mark, i.root AS "inner", o.root AS "outer", (SELECT count(*) FROM c WHERE c.route = cut.route AND c.root = o.root) AS size
FROM cut JOIN c i ON i.route = cut.route AND i.x = inner_ JOIN c o ON o.route = cut.route AND o.x = outer_""")
def cut_groups(spark, d):
    line = read(spark, d, "lineitem").where("l_quantity < 3")
    bonds = line.select(F.col("l_suppkey").alias("route"), (F.col("l_partkey") % 400).alias("a"), (F.col("l_orderkey") % 400 + 400).alias("b"))
    least = bonds.groupBy("route").agg(F.min(F.struct("a", "b")).alias("m"))
    return numbering.leaving_groups(bonds, least.select("route", F.lit(1).alias("mark"), F.col("m.a").alias("inner"), F.col("m.b").alias("outer")))


@query(r"""WITH s AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS element FROM documents),
k AS (SELECT * FROM s WHERE element <> ''), n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
p AS (SELECT a.id AS query, b.id AS id, count(*) AS both_ FROM k a JOIN k b ON a.element = b.element AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2)
SELECT query, p.id, both_ AS "both", x.n + y.n - both_ AS total FROM p JOIN n x ON x.id = query JOIN n y ON y.id = p.id WHERE both_ * 100 >= 60 * (x.n + y.n - both_)""")
def tanimoto_search(spark, d):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    sets = read(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("elements"), (F.col("doc_id") % 20 == 0).alias("asked"))
    return tanimoto.similar_sets(sets, 60)


WEIGHTS = [embedding.even_weights(3, 4), embedding.even_weights(4, 2, 1)]


def _layer(source: str, weights, last: str) -> str:
    """SQL of one layer over source(graph, node, x0, ...), with scale s(graph, node, scale) and bonds u(graph, a, b)."""
    rows, bias = weights
    x = range(len(rows))
    sums = ", ".join(f"sum(x{i} * scale) AS x{i}" for i in x)
    made = ", ".join(f"greatest(0, scale * ({' + '.join(f'x{i} * {rows[i][j]!r}' for i in x)})) AS x{j}" for j in range(len(bias)))
    return f"""{last} AS (SELECT graph, node, {made} FROM (SELECT t.graph, t.a AS node, {sums} FROM (SELECT graph, a, b FROM u UNION ALL SELECT graph, node, node FROM {source}) t
        JOIN {source} h ON h.graph = t.graph AND h.node = t.b JOIN s ON s.graph = t.graph AND s.node = t.b GROUP BY 1, 2) JOIN s USING (graph, node))"""


# an order is a graph, its parts are atoms, and lines of neighbouring parts are bonds
@query(f"""WITH a AS (SELECT l_orderkey AS graph, l_partkey AS node, ln(1 + count(*)) AS x0, ln(1 + sum(l_quantity)) AS x1, ln(1 + max(l_linenumber)) AS x2 FROM lineitem GROUP BY 1, 2),
o AS (SELECT graph, node AS a, lead(node) OVER (PARTITION BY graph ORDER BY node) AS b FROM a),
u AS (SELECT * FROM o WHERE b IS NOT NULL UNION ALL SELECT graph, b, a FROM o WHERE b IS NOT NULL),
s AS (SELECT a.graph, a.node, 1 / sqrt(1 + count(u.b)) AS scale FROM a LEFT JOIN u ON u.graph = a.graph AND u.a = a.node GROUP BY 1, 2),
{_layer('a', WEIGHTS[0], 'h1')}, {_layer('h1', WEIGHTS[1], 'h2')} SELECT graph, round(sum(x0), 6) AS x0, round(sum(x1), 6) AS x1 FROM h2 GROUP BY graph""")
def graph_embeddings(spark, d):
    line = read(spark, d, "lineitem")
    atoms = parted(line.select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber"), "l_orderkey", count=line.count())
    atoms = atoms.groupBy(F.col("l_orderkey").alias("graph"), F.col("l_partkey").alias("node")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_linenumber").alias("k"))
    atoms = Stage(spark, "embedded").put(atoms.withColumn("next", F.lead("node").over(Window.partitionBy("graph").orderBy("node"))), "atoms")
    bonds = atoms.select("graph", F.col("node").alias("a"), F.col("next").alias("b")).where("b is not null")
    out = embedding.embed(atoms, bonds, ["n", "q", "k"], WEIGHTS)
    return out.select("graph", *(F.round(c, 6).alias(c) for c in ("x0", "x1")))


# an order is a graph; lines are atoms labelled by their flag. Lines of odd orders form one ring, of even orders rings of three; the last may be a pair or alone
@query("""WITH l AS (SELECT l_orderkey AS graph, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) - 1 AS k, l_returnflag AS f FROM lineitem),
r AS (SELECT graph, CASE WHEN graph % 2 = 0 THEN k // 3 ELSE 0 END AS ring, string_agg(f, '' ORDER BY k) AS s, count(*) AS n FROM l GROUP BY 1, 2),
t AS (SELECT graph, ring, n, substr(s || s, i + 1, n) AS s FROM (SELECT *, unnest(range(n)) AS i FROM r)),
c AS (SELECT graph, ring, min(least(s, reverse(s))) AS s FROM t GROUP BY 1, 2),
k AS (SELECT graph, string_agg(s, '.' ORDER BY s) AS s FROM c GROUP BY 1)
SELECT graph, min(graph) OVER (PARTITION BY s) AS first, count(*) OVER (PARTITION BY s) AS size FROM k""")
def graph_classes(spark, d):
    line = read(spark, d, "lineitem")
    line = parted(line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"), "l_orderkey", count=line.count())
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")) - 1
    own = line.select(F.col("l_orderkey").alias("graph"), k.alias("node"), "l_returnflag").withColumn("ring", F.when(F.col("graph") % 2 == 0, F.floor(F.col("node") / 3)).otherwise(0))
    ring = Window.partitionBy("graph", "ring")
    after = F.coalesce(F.lead("node").over(ring.orderBy("node")), F.min("node").over(ring))
    own = Stage(spark, "classes").put(own.withColumn("after", after).select("graph", "node", "after", "l_returnflag"), "own")
    return refinement.classes(refinement.graph_keys(own, own.select("graph", F.col("node").alias("a"), F.col("after").alias("b")), ["l_returnflag"]))


def _epochs(epochs: int, rate: float, classes: int = 10, size: int = 64, tag: str = "", start: str = "") -> str:
    """SQL of full-batch training from zeros or the weights of the table start: examples x(id, y, val, f, v), weights w0 to w of the last epoch, validation losses; tag ends all names."""
    first = f"FROM {start}" if start else f"FROM range({classes}) t(c), range({size + 1}) u(f)"
    out = [f"w0{tag} AS MATERIALIZED (SELECT c::INT AS c, f::INT AS f, {'w' if start else '0.0::DOUBLE'} AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s {first})"]
    for t in range(epochs + 1):
        x, p, v, w, g, k, after = (f"{n}{tag}" for n in ("x", f"p{t}", f"v{t}", f"w{t}", f"g{t}", f"k{t}", f"w{t + 1}"))
        out.append(f"""{p} AS MATERIALIZED (SELECT id, y, val, c, exp(z) / sum(exp(z)) OVER (PARTITION BY id) AS p FROM (SELECT id, y, val, c, sum(v * w) AS z FROM {x} JOIN {w} USING (f) GROUP BY id, y, val, c)),
{v} AS (SELECT {t} AS t, avg(-ln(p)) AS loss FROM {p} WHERE val AND c = y)""")
        if t < epochs:
            mean, spread = f"0.9 * {w}.m + 0.1 * g", f"(g - (0.9 * {w}.m + 0.1 * g))"
            out.append(f"""{g} AS (SELECT c, {x}.f, sum((p - (c = {x}.y)::INT) * v) / (SELECT count(DISTINCT id) FROM {x} WHERE NOT val) AS g FROM {p} JOIN {x} USING (id) WHERE NOT {x}.val GROUP BY 1, 2),
{k} AS (SELECT c, f, g * least(1, 1 / sqrt(sum(g * g) OVER ())) AS g FROM {g}),
{after} AS MATERIALIZED (SELECT c, f, w - {rate} * m / {1 - 0.9 ** (t + 1)!r} / (sqrt(s / {1 - 0.999 ** (t + 1)!r}) + 1e-8) AS w, m, s
    FROM (SELECT {w}.c, {w}.f, {w}.w, {mean} AS m, 0.999 * {w}.s + 0.001 * {spread} * {spread} + 1e-8 AS s FROM {w} JOIN {k} USING (c, f)))""")
    return ",\n".join(out)


@query(f"""WITH x AS (SELECT vec_id AS id, label AS y, vec_id % 5 = 0 AS val, unnest(range(65))::INT AS f, unnest(list_append(embedding::DOUBLE[], 1)) AS v FROM embeddings),
{_epochs(3, 0.05)}, best AS (SELECT arg_min(t, loss) AS t FROM ({' UNION ALL '.join(f'SELECT * FROM v{t}' for t in range(4))}))
SELECT c AS class, f AS feature, round(w, 6) AS weight FROM ({' UNION ALL '.join(f'SELECT {t} AS t, c, f, w FROM w{t}' for t in range(4))}) JOIN best USING (t)""")
def softmax_policy(spark, d):
    own = read(spark, d, "embeddings").withColumn("val", F.col("vec_id") % 5 == 0)
    model, _ = training.train(own, "embedding", "label", "val", 10, 64, 3, rate=0.05)
    return model.select("class", "feature", F.round("weight", 6).alias("weight"))


def _rounds(rounds: int, epochs: int, rate: float) -> str:
    """SQL of value tuning: a round's customers try their two orders of highest value by the round before, and its weights are trained on these."""
    out = ["c0 AS (SELECT c::INT AS c, f::INT AS f, 0.0::DOUBLE AS w FROM range(2) t(c), range(4) u(f))"]
    for r in range(1, rounds + 1):
        losses, weights = (" UNION ALL ".join(q.format(t=t, r=r) for t in range(epochs + 1)) for q in ("SELECT * FROM v{t}_{r}", "SELECT {t} AS t, c, f, w FROM w{t}_{r}"))
        w = [f"(SELECT sum(w * (2 * c - 1)) FROM c{r - 1} WHERE f = {f})" for f in range(4)]
        value = f"1 / (1 + exp(-(x0 * {w[0]} + x1 * {w[1]} + x2 * {w[2]} + {w[3]})))"
        out.append(f"""t_{r} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY {value} DESC, id) AS place FROM o WHERE round = {r}),
x_{r} AS MATERIALIZED (SELECT id, y, val, unnest(range(4))::INT AS f, unnest([x0, x1, x2, 1]) AS v FROM t_{r} WHERE place <= 2),
{_epochs(epochs, rate, 2, 3, f"_{r}", f"c{r - 1}")},
b{r} AS (SELECT arg_min(t, loss) AS t FROM ({losses})),
c{r} AS MATERIALIZED (SELECT c, f, w FROM ({weights}) JOIN b{r} USING (t))""")
    return ",\n".join(out)


@query(f"""WITH o AS MATERIALIZED (SELECT o_orderkey AS id, o_custkey AS customer, o_custkey % 3 + 1 AS round, (o_orderstatus = 'F')::INT AS y, o_orderkey % 5 < 2 AS val,
    ln(o_totalprice) / 10 AS x0, month(o_orderdate) / 12 AS x1, left(o_orderpriority, 1)::INT / 5 AS x2 FROM orders),
{_rounds(3, 4, 0.05)} SELECT c AS class, f AS feature, round(w, 6) AS weight FROM c3""")
def value_tuning(spark, d):
    orders = read(spark, d, "orders")
    features = F.array(F.log("o_totalprice") / 10, F.month("o_orderdate") / 12, F.left("o_orderpriority", F.lit(1)).cast("int") / 5)

    def plan(batch, value):
        tried = orders.join(batch.select("o_custkey"), "o_custkey").withColumn("features", features).withColumn("value", value(F.col("features")))
        place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("value"), "o_orderkey"))
        return tried.withColumn("place", place).where("place <= 2").select(F.col("o_orderkey").alias("key"), "features", (F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_orderkey") % 5 < 2).alias("val"))

    targets = orders.select("o_custkey", (F.col("o_custkey") % 3 + 1).alias("round")).distinct()
    model, _ = tuning.tune(targets, plan, 3, epochs=4, ratio=None, rate=0.05)
    return model.select("class", "feature", F.round("weight", 6).alias("weight"))


# a supplier is a reaction; lines score a part's atom and an order's atom by price, in one direction or the other; both sides are rings
@query("""WITH l AS (SELECT l_suppkey AS reaction, l_partkey % 25 AS p, 100 + l_orderkey % 25 AS r, max(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END) AS v, max(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END) AS w
    FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT reaction, p, r, coalesce(v, 0) + coalesce(w, 0) AS score FROM l WHERE p % 3 = r % 3 UNION ALL SELECT DISTINCT reaction, p, NULL, 0 FROM l UNION ALL SELECT DISTINCT reaction, -1000, NULL, 0 FROM l),
m AS (WITH RECURSIVE t(reaction, p, r, score, scope, i, j) AS (
    SELECT reaction, p, r, score, false, NULL::BIGINT, NULL::BIGINT FROM s
    UNION ALL SELECT reaction, p, r, CASE WHEN p_near AND r - 100 IN ((bj - 99) % 25, (bj - 76) % 25) THEN score * 1.75::DOUBLE ELSE score END, scope OR p_near, bi, bj
    FROM (SELECT *, p IN ((bi + 1) % 25, (bi + 24) % 25) AS p_near FROM (SELECT *, -best.p AS bi, -best.r AS bj, best.score AS high
        FROM (SELECT *, max(struct_pack(scope := scope, score := score, p := -p, r := coalesce(-r, -1000))) OVER (PARTITION BY reaction) AS best FROM t)))
    WHERE high > 1e-8 AND p <> bi AND (r IS NULL OR r <> bj))
    SELECT DISTINCT reaction, i, j FROM t WHERE i IS NOT NULL)
SELECT a.reaction, a.p AS atom, max(j) AS mapped FROM (SELECT DISTINCT reaction, p FROM l) a LEFT JOIN m ON m.reaction = a.reaction AND m.i = a.p GROUP BY 1, 2""")
def mapped_atoms(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("reaction"), (F.col("l_partkey") % 25).alias("p"), (F.col("l_orderkey") % 25).alias("k"), (F.col("l_linenumber") % 2 == 0).alias("forth"), "l_extendedprice").withColumn("r", F.col("k") + 100)
    attention = line.select("reaction", F.when(F.col("forth"), F.col("p")).otherwise(F.col("r")).alias("a"), F.when(F.col("forth"), F.col("r")).otherwise(F.col("p")).alias("b"), F.col("l_extendedprice").alias("value"))
    own = line.select("reaction", F.col("p").alias("atom"), F.lit("product").alias("side"), (F.col("p") % 3).alias("element"))
    atoms = own.union(line.select("reaction", "r", F.lit("reactant"), F.col("r") % 3)).distinct()
    atoms = Stage(spark, "mapped").put(atoms, "atoms")  # read six times
    ring = F.floor(F.col("atom") / 100) * 100 + (F.col("atom") % 100 + 1) % 25
    return mapping.map_atoms(mapping.pair_scores(attention, atoms), atoms, atoms.select("reaction", F.col("atom").alias("a"), ring.alias("b")))
