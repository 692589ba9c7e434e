"""Molecules and reactions as columns: reading, standardisation, filtering, rules, features. One Arrow pass does a record.

Faults of a record become columns and never end a job, unless strict is asked for. Null texts count as empty records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import molecules as M
from ..functions import patterns as P
from ..functions import reactions as R

#: Stages and classes of faults that come from data and not from the pipeline; fixed values.
DATA_STAGES = ("CheckValence", "ReactionMapping", "SplitIons", "UnchangedParts", "SmallMolecules", "RemoveReagents", "parse")
DATA_TYPES = ("InvalidAromaticRing", "MappingError", "EmptyMolecule", "EmptyReaction", "IncorrectSmiles", "ValenceError", "ValueError")

MOLECULE = "canonical string, n_atoms int, n_bonds int, n_rings int, n_aromatic_rings int, n_components int, n_hydrogens int, charge int, valence_faults int, error string"


def _molecule(smiles: str | None) -> tuple:
    try:
        mol = M.read(smiles or "")
        try:
            mol = M.aromatize(mol)
        except M.InvalidAromaticRing:
            pass
    except M.ChemistryError as e:
        return (*[None] * 9, f"{e.kind}: {e}")
    return (M.write(mol), len(mol), len(mol.edges()), len(M.rings(mol.bonds)), len(M.aromatic_rings(mol)), len(M.components(mol.bonds)), sum(a.hydrogens for a in mol.atoms.values()), sum(a.charge for a in mol.atoms.values()), len(M.valence_faults(mol)), None)


def molecules(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with canonical text and counts of each molecule, or the error of a text that is none."""
    return arrow.add(df, [smiles], MOLECULE, _molecule)


def distinct_molecules(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """As molecules, with each text worked on once and joined back."""
    return df.join(molecules(df.select(smiles).distinct(), smiles), smiles, "left")


def building_blocks(df: DataFrame, smiles: str = "smiles", standardize: bool = True) -> DataFrame:
    """Distinct stock (smiles); canonical texts, without what can't be read, if standardize."""
    own = df.select(F.trim(F.col(smiles)).alias("smiles")).where("smiles <> ''").distinct()
    return molecules(own).where("error IS NULL").select(F.col("canonical").alias("smiles")).distinct() if standardize else own


RECORD = "smiles string, key string, n_reactants int, n_products int, n_changed int, n_centers int, class string, reason string, stage string, error_type string, message string, small_reactants string, small_products string"


def _record(steps: dict, filters: dict, strict: bool):
    def run(smiles: str | None) -> tuple:
        stage = "parse"
        try:
            reaction = R.parse(smiles or "")
            stage = "standardize"
            reaction = R.standardize(reaction, steps)
            stage = "filter"
            reason = R.reject_reason(reaction, filters) if filters else None
            stage = "ReactionMapping"
            graph = R.Condensed(R.aromatize(reaction) if filters else reaction)
            return (R.write(reaction), graph.key(), len(reaction.reactants), len(reaction.products), len(graph.changed()), len(graph.centers()), R.detailed_class(graph), reason, None, None, None, reaction.meta.get("small_reactants"), reaction.meta.get("small_products"))
        except M.ChemistryError as e:
            if strict:
                raise
            return (*[None] * 8, getattr(e, "stage", stage), e.kind, str(e), None, None)

    return run


def curate(df: DataFrame, smiles: str = "smiles", steps: dict[str, dict] | None = None, filters: dict[str, dict] | None = None, strict: bool = False) -> DataFrame:
    """df with each reaction standardised and judged: smiles (mapped), key of its condensed graph, counts, class; reason of the
    filter that rejects it, or stage, error_type and message of its fault; status ok, filtered or error."""
    out = arrow.add(df, [smiles], RECORD, _record(steps or {}, filters or {}, strict))
    return out.withColumn("status", F.when(F.col("stage").isNotNull(), "error").when(F.col("reason").isNotNull(), "filtered").otherwise("ok"))


def fault_origin(stage: Column, error_type: Column) -> Column:
    """data for faults of noisy records, pipeline for others."""
    return F.when(stage.isin(*DATA_STAGES) | error_type.isin(*DATA_TYPES), "data").otherwise("pipeline")


ATOM = "side string, mol_idx int, n int, element string, charge int, radical boolean, isotope int, h int, aromatic boolean"
BOND = "side string, mol_idx int, a int, b int, ord int"
CHANGE = "a int, b int, ord int, p_ord int"


def _parsed(smiles: str) -> R.Reaction | None:
    try:
        return R.aromatize(R.parse(smiles))
    except M.ChemistryError:
        return None


def _sides(smiles: str | None):
    reaction = _parsed(smiles) if smiles else None
    if reaction is not None:
        for side, mols in zip(("reactant", "reagent", "product"), reaction.sides(), strict=True):
            for i, mol in enumerate(mols):
                yield side, i, mol


def atoms(df: DataFrame, smiles: str, key: list[str]) -> DataFrame:
    """Atom table of reactions; records that can't be read have no rows."""
    return arrow.expand(df, [smiles], key, ATOM, lambda s: ((side, i, n, a.element, a.charge, a.radical, a.isotope, a.hydrogens, a.aromatic) for side, i, mol in _sides(s) for n, a in sorted(mol.atoms.items())))


def bonds(df: DataFrame, smiles: str, key: list[str]) -> DataFrame:
    """Bond table of reactions, a < b."""
    return arrow.expand(df, [smiles], key, BOND, lambda s: ((side, i, a, b, o) for side, i, mol in _sides(s) for a, b, o in mol.edges()))


def condensed_bonds(df: DataFrame, smiles: str, key: list[str]) -> DataFrame:
    """Bonds of the condensed graphs: order before and after, null where there is none."""

    def run(s: str | None):
        reaction = _parsed(s) if s else None
        return R.Condensed(reaction).edges() if reaction is not None else ()

    return arrow.expand(df, [smiles], key, CHANGE, run)


def extract_rules(df: DataFrame, smiles: str, key: list[str], options: R.RuleOptions | None = None) -> DataFrame:
    """Rules of reactions: (key..., product_smiles, cgr_key, rule_smarts, validation); faulty and skipped records give none."""
    chosen = options or R.RuleOptions()

    def run(s: str | None):
        try:
            reaction = R.parse(s or "")
            product = ".".join(sorted(R.key(m) for m in reaction.products))
            return [(product, *rule) for rule in R.extract_rules(reaction, chosen)[0]]
        except M.ChemistryError:
            return []

    return arrow.expand(df, [smiles], key, "product_smiles string, cgr_key string, rule_smarts string, validation string", run)


def readable_rules(rules: DataFrame) -> DataFrame:
    """Rules whose SMARTS can be read."""

    def good(smarts: str | None) -> tuple:
        try:
            P.Rule(smarts or "")
            return (True,)
        except M.ChemistryError:
            return (False,)

    return arrow.add(rules, ["rule_smarts"], "_readable boolean", good).where("_readable").drop("_readable")


class _Lazy:
    """Rules sent as text and compiled once a task."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows
        self.made: list[tuple[int, P.Rule]] | None = None

    def get(self) -> list[tuple[int, P.Rule]]:
        if self.made is None:
            self.made = [(i, P.Rule(s)) for i, s in self.rows]
        return self.made

    def __getstate__(self):
        return {"rows": self.rows, "made": None}


def lazy_rules(rules: DataFrame) -> _Lazy:
    """(rule_id, rule_smarts) of the readable rules for all tasks; of a checked size."""
    return _Lazy([(r["rule_id"], r["rule_smarts"]) for r in arrow.small_list(readable_rules(rules).select("rule_id", "rule_smarts").orderBy("rule_id"))])


def apply_rules(mols: DataFrame, smiles: str, key: list[str], rules: DataFrame, top: int = 3, by_size: bool = False, validate: bool = True) -> DataFrame:
    """Outcomes of all rules on all molecules: (key..., rule_id, outcome, products); every task holds the rules."""
    ready = lazy_rules(rules)

    def run(s: str | None):
        try:
            mol = M.aromatize(M.read(s or ""))
        except M.ChemistryError:
            return
        for rule_id, rule in ready.get():
            for i, parts in enumerate(P.apply_rule(mol, rule, top, by_size, validate)):
                yield rule_id, i, sorted(R.key(p) for p in parts)

    return arrow.expand(mols, [smiles], key, "rule_id long, outcome int, products array<string>", run)


def rule_labels(mols: DataFrame, smiles: str, rules: DataFrame) -> DataFrame:
    """mols with applied and priority: the ids of rules that apply, and of those that part large molecules or open a ring."""
    ready = lazy_rules(rules)

    def run(s: str | None) -> tuple:
        try:
            mol = M.aromatize(M.read(s or ""))
        except M.ChemistryError:
            return None, None
        ids = [i for i, _ in ready.get()]
        applied, first = R.rule_reactions([r for _, r in ready.get()], mol)
        return [ids[i] for i in applied], [ids[i] for i in first]

    return arrow.add(mols, [smiles], "applied array<long>, priority array<long>", run)


# --- features -------------------------------------------------------------------------------

#: Lengths of the periods.
PERIODS = (2, 8, 8, 18, 18, 32, 32)
#: Transition metals whose outer s subshell has one electron; palladium has none there and ten in d. Fixed values.
SINGLE_S = frozenset("Cr Cu Nb Mo Ru Rh Ag Pt Au".split())


def place(element: str) -> tuple[int, int]:
    """Period and group of an element; 0 for lanthanides and actinides but the first of each, which stands in group 3."""
    n = M.NUMBER[element]
    for period, length in enumerate(PERIODS, 1):
        if n <= length:
            break
        n -= length
    if period == 1:
        return 1, 1 if n == 1 else 18
    if n <= 2:
        return period, n
    if length == 8:
        return period, n + 10
    if length == 32:
        return period, 3 if n == 3 else 0 if n <= 17 else n - 14
    return period, n


def shell(element: str) -> tuple[int, int]:
    """The outermost subshell (1 for s, 2 for p, 3 for d) and its electrons."""
    period, group = place(element)
    if period == 1 or 0 < group <= 2:
        return 1, 2 if element == "He" else group
    if group >= 13:
        return 2, group - 12
    return (3, 10) if element == "Pd" else (1, 1 if element in SINGLE_S else 2)


def _features(smiles: str | None) -> tuple:
    try:
        mol = M.kekulize(M.aromatize(M.read(smiles or "")))
    except M.ChemistryError:
        return None, None, None
    if len(mol) < 2 or M.valence_faults(mol):
        return None, None, None
    ringed = M.ring_bonds(mol.bonds)
    in_ring = {n for e in ringed for n in e}
    order = sorted(mol.atoms)
    at = {n: i for i, n in enumerate(order)}
    x = []
    for n in order:
        a = mol.atoms[n]
        period, group = place(a.element)
        kind, outer = shell(a.element)
        orders = list(mol.bonds[n].values())
        x.append([M.NUMBER[a.element], period, group, outer + a.charge, kind, a.hydrogens + sum(mol.atoms[m].element == "H" for m in mol.bonds[n]), int(n in in_ring), len(orders), orders.count(1), orders.count(2), orders.count(3)])
    edges = [(a, b, o) for a, b, o in mol.edges()] + [(b, a, o) for a, b, o in mol.edges()]
    index = [{"s": at[a], "t": at[b]} for a, b, _ in edges]
    attr = [[float(o == 1), float(o == 2), float(o == 3), float((min(a, b), max(a, b)) in ringed)] for a, b, o in edges]
    return x, index, attr


def features(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with the graph of each molecule for learning: x (11 numbers an atom), edge_index and edge_attr in both directions; null
    for single atoms and molecules that are no good."""
    return arrow.add(df, [smiles], "x array<array<int>>, edge_index array<struct<s:int,t:int>>, edge_attr array<array<float>>", _features)


# --- functional groups ----------------------------------------------------------------------


class _Groups:
    """Named patterns sent as text and compiled once a task; those that can't be read are skipped."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.rows = rows
        self.made: list | None = None

    def __getstate__(self):
        return {"rows": self.rows, "made": None}

    def find(self, mol: M.Molecule) -> list[tuple[str, str, tuple[int, ...]]]:
        """(name, category, atoms) in the order of patterns; each name and set of atoms once."""
        if self.made is None:
            self.made = []
            for name, category, smarts in self.rows:
                try:
                    self.made.append((name, category, P.compile_pattern(smarts)))
                except P.PatternError:
                    continue
        view, out = P.View(mol), {}
        for name, category, pattern in self.made:
            for own in P.atom_sets(pattern, view):
                out.setdefault((name, own), category)
        return [(name, category, own) for (name, own), category in out.items()]


MATCH = "array<struct<name:string,category:string,atoms:array<int>>>"


def functional_groups(df: DataFrame, smiles: str, patterns: DataFrame) -> DataFrame:
    """df with groups: matches of (name, category, smarts) patterns, in the order of name's place in the table of column place."""
    ready = _Groups([(r["name"], r["category"], r["smarts"]) for r in arrow.small_list(patterns.orderBy("place").select("name", "category", "smarts"))])

    def run(s: str | None) -> tuple:
        try:
            mol = M.aromatize(M.read(s or ""))
        except M.ChemistryError:
            return (None,)
        return ([{"name": n, "category": c, "atoms": list(a)} for n, c, a in ready.find(mol)],)

    return arrow.add(df, [smiles], f"groups {MATCH}", run)


def scan_steps(steps: DataFrame, groups: DataFrame, halogens: DataFrame, smiles: str = "smiles", key: tuple[str, ...] = ("route_id", "step_id")) -> DataFrame:
    """Of each step (key...) the reacting group, the competing groups of its product, and how many halogens of a family that
    reacts stand elsewhere: (key..., reacting_fg, competing array<struct<fg_name, fg_atoms>>, halogens)."""
    fg, hal = (_Groups([(r["name"], r["category"], r["smarts"]) for r in arrow.small_list(t.orderBy("place").select("name", "category", "smarts"))]) for t in (groups, halogens))

    def run(s: str | None):
        try:
            reaction = R.aromatize(R.parse(s or ""))
        except M.ChemistryError:
            return
        if not reaction.products:
            return
        center, product = R.Condensed(reaction).center(), reaction.products[0]
        best, name = 0, None
        for mol in reaction.reactants:
            first = next((m for m in fg.find(mol) if center & set(m[2])), None)
            if first and len(center & set(first[2])) > best:
                best, name = len(center & set(first[2])), first[0]
        found = fg.find(product)
        if name is None:
            name = next((m[0] for m in found if center & set(m[2])), None)
        at = hal.find(product)
        families = {m[1] for m in at if center & set(m[2])}
        yield name, [{"fg_name": m[0], "fg_atoms": list(m[2])} for m in found if not center & set(m[2])], sum(m[1] in families and not center & set(m[2]) for m in at)

    return arrow.expand(steps, [smiles], list(key), "reacting_fg string, competing array<struct<fg_name:string,fg_atoms:array<int>>>, halogens long", run)


def interactions(scanned: DataFrame, matrix: DataFrame, key: tuple[str, ...] = ("route_id", "step_id")) -> DataFrame:
    """Competing groups with severities: a pair the matrix (competing_fg, reacting_fg, level) lacks, or a step without a reacting
    group, is compatible."""
    from .quality import severity

    rows = scanned.select(*key, "reacting_fg", F.explode("competing").alias("c")).select(*key, "reacting_fg", F.col("c.fg_name").alias("fg_name"), F.col("c.fg_atoms").alias("fg_atoms"))
    levels = matrix.select(F.col("competing_fg").alias("fg_name"), "reacting_fg", "level")
    return rows.join(levels, ["fg_name", "reacting_fg"], "left").withColumn("severity", severity(F.coalesce("level", F.lit(0)))).select(*key, "fg_name", "fg_atoms", "reacting_fg", "severity")


# --- sets of molecules as arrays of texts ---------------------------------------------------


def on_both_sides(reactants: Column, products: Column) -> Column:
    return F.array_intersect(reactants, products)


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays have the same molecules, each as often."""
    return F.sort_array(a) == F.sort_array(b)


def united(smiles: Column) -> Column:
    """The molecules of an array as one text of parts."""
    return F.array_join(F.sort_array(smiles), ".")


def composed(parts: Column, min_mol_size: int = 6) -> Column:
    """One text of an array of (smiles, size): parts above the size only, if there is any."""
    big = F.filter(parts, lambda p: p["size"] > min_mol_size)
    return united(F.transform(F.when(F.size(big) > 0, big).otherwise(parts), lambda p: p["smiles"]))


def reversed_reaction(smiles: Column) -> Column:
    """R>A>P as P>A>R."""
    parts = F.split(smiles, ">")
    return F.concat_ws(">", F.get(parts, F.lit(2)), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def rule_hash(smarts: Column) -> Column:
    """A hash of left>>right that doesn't depend on the order of parts."""
    side = lambda i: F.sort_array(F.split(F.get(F.split(smarts, ">>"), F.lit(i)), "\\."))
    return F.xxhash64(side(0), side(1))


def first_outcomes(outcomes: Column, top: int = 3, big: int = 6, by_size: bool = False) -> Column:
    """The first top of an array of outcomes, each an array of (smiles, size); those with the most large parts first if by_size."""
    if by_size:
        n = F.transform(outcomes, lambda o, i: F.struct((-F.size(F.filter(o, lambda p: p["size"] > big))).alias("n"), i.alias("i"), o.alias("o")))
        outcomes = F.transform(F.array_sort(n), lambda x: x["o"])
    return F.slice(outcomes, 1, top)
