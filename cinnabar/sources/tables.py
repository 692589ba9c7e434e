"""Readers and writers of rules, policy data, routes, matrices, patterns, statistics and reports, as text files others can read.

Ordered text files are written by one task after a range sort, since their order is part of the format; what is large goes to
Parquet instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow
from ..operators.reactions import readable_rules
from .records import numbered, record


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """df in order in one partition, that is one file."""
    return df.repartition(1).sortWithinPartitions(*order)


def _tsv(df: DataFrame, path: str, order: list[str], mode: str) -> None:
    (_ordered(df, order) if order else df).write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


# --- rules ----------------------------------------------------------------------------------


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule set (rule_id, rule_smarts, popularity, reaction_indices) of a TSV file; rule_id is the row's place, rules that can't be
    read are dropped and keep their number."""
    table = spark.read.schema("rule_smarts string, popularity long, reaction_indices string").option("sep", "\t").option("header", True).option("quote", "").csv(path)
    own = numbered(table.withColumn("file", F.input_file_name()).withColumn("block", F.input_file_block_start()))
    indices = F.filter(F.transform(F.split(F.coalesce("reaction_indices", F.lit("")), ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999999999999")).cast("long")), lambda x: x.isNotNull())
    return readable_rules(own.select(F.col("idx").alias("rule_id"), "rule_smarts", F.coalesce("popularity", F.lit(0)).alias("popularity"), indices.alias("reaction_indices")))


def write_rules(rules: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """rule_smarts, popularity, reaction_indices in the order of rule_id."""
    text = F.array_join(F.transform("reaction_indices", lambda x: x.cast("string")), ",")
    _tsv(_ordered(rules.select("rule_id", "rule_smarts", "popularity", text.alias("reaction_indices")), ["rule_id"]).drop("rule_id"), path, [], mode)


def select_rules(rules: DataFrame, at: int | slice | Iterable[int]) -> DataFrame:
    """The rules at a place, in a slice (steps count from its start) or in a list, by rule_id; negative places aren't known."""
    if isinstance(at, int):
        return rules.where(F.col("rule_id") == at)
    if isinstance(at, slice):
        start, step = at.start or 0, at.step or 1
        if start < 0 or (at.stop or 0) < 0 or step < 1:
            raise ValueError("places count from the start")
        own = (F.col("rule_id") >= start) & ((F.col("rule_id") - start) % step == 0)
        return rules.where(own if at.stop is None else own & (F.col("rule_id") < at.stop))
    return rules.where(F.col("rule_id").isin(*at))


def rule_of_reaction(rules: DataFrame) -> DataFrame:
    """(rxn_idx, rule_id): of several rules the last."""
    return rules.select(F.explode("reaction_indices").alias("rxn_idx"), "rule_id").groupBy("rxn_idx").agg(F.max("rule_id").alias("rule_id"))


def write_policy(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """product_smiles and rule_id in the order of rxn_idx."""
    _tsv(_ordered(pairs.select("rxn_idx", "product_smiles", "rule_id"), ["rxn_idx"]).drop("rxn_idx"), path, [], mode)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("product_smiles string, rule_id long").option("sep", "\t").option("header", True).option("quote", "").csv(path)


# --- routes ---------------------------------------------------------------------------------


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """(route_id, step_id, smiles, meta) of a CSV file."""
    return spark.read.schema("route_id long, step_id int, smiles string, meta string").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_routes(steps: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _ordered(steps.select("route_id", "step_id", "smiles", "meta"), ["route_id", "step_id"]).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def route_index(name: str) -> int | None:
    """The number of a routes file: what stands between the last underscore and the dot."""
    m = re.search(r"_(\d+)\.", name)
    return int(m[1]) if m else None


def collect_steps(tree: dict) -> list[str]:
    """Reaction texts of a route tree, sources before what is made of them."""
    out: list[str] = []
    work: list[tuple[dict, bool]] = [(tree, False)]
    while work:
        node, done = work.pop()
        if done:
            if node.get("type") == "reaction" and node.get("smiles"):
                out.append(node["smiles"])
            continue
        work.append((node, True))
        work += [(c, False) for c in reversed(node.get("children") or [])]
    return out


def read_route_trees(spark: SparkSession, path: str) -> DataFrame:
    """(route_id, step_id, smiles) of JSON files: a list of trees, or a map from ids to trees; a file a task."""

    def run(text: str | None):
        data = json.loads(text or "[]")
        items = ((int(k), v) for k, v in data.items()) if isinstance(data, dict) else enumerate(data)
        for route, tree in items:
            for step, smiles in enumerate(collect_steps(tree or {})):
                yield route, step, smiles

    files = spark.read.text(path, wholetext=True)
    return arrow.expand(files, ["value"], [], "route_id long, step_id int, smiles string", run, spread=False)


def _tree(steps: list[tuple[int, str]]) -> str | None:
    """JSON of a route from its steps: each reactant is made by the latest earlier step that gives it, or is in stock."""
    from ..functions import molecules as M
    from ..functions import reactions as R

    try:
        read = {i: R.parse(s) for i, s in steps}
    except M.ChemistryError:
        return None
    made: dict[str, list[int]] = {}
    for i, reaction in read.items():
        for mol in reaction.products:
            made.setdefault(R.key(mol), []).append(i)
    last = max(read)
    target = set(read[last].products[0].atoms) if read[last].products else set()
    done: dict[int, dict | None] = {}
    for i in sorted(read):
        children: list[dict | None] = []
        for mol in read[i].reactants:
            before = [j for j in made.get(R.key(mol), []) if j < i]
            children.append(done[max(before)] if before else {"type": "mol", "smiles": R.key(mol), "in_stock": True})
        product = next((m for m in read[i].products if target & set(m.atoms)), None)
        node = {"type": "reaction", "smiles": R.write(read[i]), "children": children}
        done[i] = None if product is None else {"type": "mol", "smiles": R.key(product), "children": [node], "in_stock": False}
    return json.dumps(done[last])


def route_trees(steps: DataFrame) -> DataFrame:
    """(route_id, tree): JSON of each route; a route's steps, few by nature, are gathered."""
    own = steps.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("step_id", "smiles"))).alias("_steps"))
    return arrow.add(own, ["_steps"], "tree string", lambda s: (_tree([(x["step_id"], x["smiles"]) for x in s]),), spread=False).drop("_steps")


def route_levels(trees: DataFrame) -> DataFrame:
    """(route_id, node, parent, level, type, smiles) of route trees, breadth first."""

    def run(text: str | None):
        queue = [(json.loads(text), None, 0)] if text else []
        for n, (node, parent, level) in enumerate(queue):  # grows as it goes
            yield n, parent, level, node.get("type"), node.get("smiles")
            queue.extend((c, n, level + 1) for c in node.get("children") or [] if c)

    return arrow.expand(trees, ["tree"], ["route_id"], "node int, parent int, level int, type string, smiles string", run)


# --- matrices and patterns ------------------------------------------------------------------


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(competing_fg, reacting_fg, level) of a wide TSV file whose first cell is empty."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    # names are read as text, since Spark takes names that differ in case only for one
    rest = spark.read.text(path).first()[0].split("\t")[1:]
    named = wide.toDF("competing_fg", *(f"_c{i}" for i in range(len(rest))))
    long_ = named.unpivot(["competing_fg"], [f"_c{i}" for i in range(len(rest))], "_column", "level")
    names = spark.createDataFrame([(f"_c{i}", n) for i, n in enumerate(rest)], "_column string, reacting_fg string")
    return long_.join(F.broadcast(names), "_column").select("competing_fg", "reacting_fg", F.col("level").cast("int").alias("level")).where("level IS NOT NULL")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(place, name, category, smarts) of a YAML file: category to entries with a name, or name to an entry with a family."""
    import yaml

    rows = []
    for text in (r[0] for r in spark.read.text(path, wholetext=True).collect()):  # pattern files are hand-written
        for outer, inner in (yaml.safe_load(text) or {}).items():
            entries = [(e["name"], outer, e["smarts"]) for e in inner] if isinstance(inner, list) else [(outer, inner.get("family"), inner["smarts"])]
            rows += [(len(rows) + i, *e) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "place int, name string, category string, smarts string")


# --- records and reports --------------------------------------------------------------------


def write_records(df: DataFrame, path: str, smiles: str = "smiles", meta: str = "meta", order: str = "idx", ordered: bool = True, mode: str = "errorifexists") -> None:
    """SMILES lines with meta data; one file in order, or a file a task."""
    own = df.select(order, record(F.col(smiles), F.col(meta)).alias("value"))
    (_ordered(own, [order]).select("value") if ordered else own.select("value")).write.mode(mode).text(path)


def _ctab(mol, reaction_atoms: bool) -> str:
    order = sorted(mol.atoms)
    at = {n: i + 1 for i, n in enumerate(order)}
    lines = ["", "  cinnabar", "", f"{len(order):3d}{len(mol.edges()):3d}  0  0  0  0            999 V2000"]
    for n in order:
        a = mol.atoms[n]
        lines.append(f"{0:10.4f}{0:10.4f}{0:10.4f} {a.element:<3} 0  0  0  0  0  0  0  0  0{n if reaction_atoms else 0:3d}  0  0")
    lines += [f"{at[a]:3d}{at[b]:3d}{o:3d}  0  0  0  0" for a, b, o in mol.edges()]
    for tag, value in (("CHG", lambda a: a.charge), ("ISO", lambda a: a.isotope)):
        own = [(at[n], value(mol.atoms[n])) for n in order if value(mol.atoms[n])]
        for i in range(0, len(own), 8):
            lines.append(f"M  {tag}{len(own[i : i + 8]):3d}" + "".join(f"{n:4d}{v:4d}" for n, v in own[i : i + 8]))
    return "\n".join([*lines, "M  END"])


def _rxn(smiles: str | None, meta: dict | None) -> str | None:
    from ..functions import molecules as M
    from ..functions import reactions as R

    try:
        reaction = R.parse(smiles or "")
    except M.ChemistryError:
        return None
    head = f"$RFMT\n$RXN\n\n  cinnabar\n\n{len(reaction.reactants):3d}{len(reaction.products):3d}"
    mols = "".join(f"\n$MOL\n{_ctab(m, True)}" for m in reaction.reactants + reaction.products)
    return head + mols + "".join(f"\n$DTYPE {k}\n$DATUM {v}" for k, v in sorted(dict(meta or {}).items()))


def rdf_texts(df: DataFrame, smiles: str = "smiles", meta: str = "meta") -> DataFrame:
    """df with rdf: the reaction as a $RFMT record with its meta data; null for what can't be read."""
    return arrow.add(df, [smiles, meta], "rdf string", lambda s, m: (_rxn(s, dict(m) if m else None),))


def write_rdf(df: DataFrame, path: str, order: str = "idx", smiles: str = "smiles", meta: str = "meta", mode: str = "errorifexists") -> None:
    """One RDF file in order, with its header once."""
    own = rdf_texts(df, smiles, meta).where("rdf IS NOT NULL").select(F.col(order).cast("long").alias("_at"), "rdf")
    head = df.sparkSession.createDataFrame([(-(2**63), "$RDFILE 1\n$DATM 01/01/00 00:00")], "_at long, rdf string")
    _ordered(own.unionByName(head), ["_at"]).select("rdf").write.mode(mode).text(path)


def _sd(smiles: str | None) -> str | None:
    from ..functions import molecules as M

    try:
        return _ctab(M.read(smiles or ""), False) + "\n$$$$"
    except M.ChemistryError:
        return None


def write_sdf(df: DataFrame, path: str, order: str = "idx", smiles: str = "smiles", mode: str = "errorifexists") -> None:
    own = arrow.add(df, [smiles], "sdf string", lambda s: (_sd(s),)).where("sdf IS NOT NULL")
    _ordered(own.select(order, "sdf"), [order]).select("sdf").write.mode(mode).text(path)


def _atoms_of(block: str):
    """The molecule of a connection table."""
    from ..functions import molecules as M

    lines = block.splitlines()
    at = next((i for i, x in enumerate(lines) if "V2000" in x), None)
    if at is None:
        raise M.IncorrectSmiles("no connection table")
    n, m = int(lines[at][:3]), int(lines[at][3:6])
    mol, names = M.Molecule(), []
    for i, x in enumerate(lines[at + 1 : at + 1 + n]):
        number = int(x[60:63] or 0) if len(x) >= 63 else 0
        names.append(number if number and number not in mol.atoms else 100_000 + i)
        mol.add(names[-1], M.Atom(x[31:34].strip(), mapped=bool(number)))
    for x in lines[at + 1 + n : at + 1 + n + m]:
        mol.link(names[int(x[:3]) - 1], names[int(x[3:6]) - 1], int(x[6:9]))
    for x in lines[at + 1 + n + m :]:
        if x.startswith(("M  CHG", "M  ISO")):
            numbers = list(map(int, x[9:].split()))
            for i, v in zip(numbers[::2], numbers[1::2], strict=False):
                setattr(mol.atoms[names[i - 1]], "charge" if "CHG" in x else "isotope", v)
    for a in mol.atoms:
        if any(o == 4 for o in mol.bonds[a].values()):
            mol.atoms[a].aromatic = True
    for a, atom in mol.atoms.items():
        fit = [v for v in M.allowed(atom.element, atom.charge) if v >= M.order_sum(mol, a) + (atom.aromatic and atom.element == "C")]
        atom.hydrogens = int(fit[0] - M.order_sum(mol, a) - (atom.aromatic and atom.element == "C")) if fit else 0
    return mol


def _from_block(block: str | None) -> tuple:
    from ..functions import molecules as M
    from ..functions import reactions as R

    try:
        text = block or ""
        meta = dict(re.findall(r"(?m)^\$DTYPE\s+(\S+)\s*\n\$DATUM\s+(.*(?:\n(?!\$).*)*)", text))
        if "$RXN" in text:
            counts = next(x for x in re.split(r"\$RXN[^\n]*\n", text)[1].split("\n")[2:] if x.strip())
            n, m = int(counts[:3]), int(counts[3:6])
            mols = [_atoms_of(x) for x in text.split("$MOL\n")[1:]]
            return R.write(R.Reaction(mols[:n], [], mols[n : n + m])), meta, None
        return M.write(_atoms_of(text)), meta, None
    except (ValueError, IndexError, StopIteration, KeyError) as e:
        return None, None, f"{type(e).__name__}: {e}"


def parse_blocks(df: DataFrame, block: str = "block") -> DataFrame:
    """df with smiles, meta and error of RDF or SDF texts."""
    return arrow.add(df, [block], "smiles string, meta map<string,string>, error string", lambda b: (lambda r: (r[0], list(r[1].items()) if r[1] is not None else None, r[2]))(_from_block(b)))


def write_errors(errors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The five columns of faults, TAB separated; TABs and line feeds of values become blanks."""
    columns = ("original_smiles", "source_info", "stage", "error_type", "error_message")
    _tsv(errors.select(*(F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ").alias(c) for c in columns)), path, [], mode)


#: Columns of the search statistics, in order; fixed values.
STATISTICS = "target_smiles num_routes num_nodes num_iter tree_depth search_time solved expansion_calls expansion_successes total_rules_tried total_rules_succeeded rule_applicability_rate dead_end_nodes first_solution_iteration first_solution_time max_branching_factor mean_branching_factor best_route_score mean_winning_rule_rank newick_tree newick_meta error".split()


def write_statistics(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One row a target in the fixed order of columns; missing ones are empty."""
    stats.select(*(F.col(c) if c in stats.columns else F.lit(None).cast("string").alias(c) for c in STATISTICS)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def summary_json(summary: DataFrame) -> DataFrame:
    """(value): the summary's row as JSON text."""
    return summary.select(F.to_json(F.struct(*summary.columns), {"ignoreNullFields": "false"}).alias("value"))


def digest(files: DataFrame, name: str = "name", size: str = "size", lines: str = "lines") -> DataFrame:
    """(digest): 16 hex digits over name, size and number of lines of the input files, for cache names."""
    own = files.select(F.concat_ws("\t", F.col(name), F.col(size).cast("string"), F.col(lines).cast("string")).alias("t"))
    return own.agg(F.substring(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("t"))), 256), 1, 16).alias("digest"))


def cached(spark: SparkSession, df: DataFrame, folder: str, key: str) -> DataFrame:
    """df from a Parquet table named by the key, written if it isn't there."""
    path = f"{folder.rstrip('/')}/{key}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def html_table(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A plain page of the first rows, for reports."""
    import html

    rows = df.limit(limit).collect()
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{cells('th', df.columns)}</tr>{body}</table></body></html>"
