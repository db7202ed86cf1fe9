"""Operators on the atoms table: contacts, pockets, residues, stitching, design constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.plans import grid as G, skew as S

# fixed values: residue names, solvents, metals, backbone, side-chain centre, alphabet
THREE_TO_ONE = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}
ALPHABET = "ACDEFGHIKLMNPQRSTVWYX"
WATER = ["HOH", "WAT", "H2O", "DOD"]
METALS = [
    "NA", "K", "CL", "CA", "MG", "ZN", "FE", "CU", "MN", "CO", "NI", "CD", "HG",
    "PB", "SR", "CS", "BA", "TI", "V", "CR", "MO", "SE", "W", "RB", "YB", "AL",
]
BACKBONE = ["N", "CA", "C", "O"]
CB_CROSS, CB_B, CB_C = -0.58273431, 0.56802827, -0.54067466
FAR_D2 = 1000.0

RESIDUE = ["structure_id", "chain", "resseq", "icode"]


def classify(atoms: DataFrame) -> DataFrame:
    """Class of each atom: protein, water or ligand."""
    kind = F.when(F.col("resname").isin(*WATER), "water").when(F.col("resname").isin(*THREE_TO_ONE), "protein").otherwise("ligand")
    return atoms.withColumn("kind", kind)


def heavy(atoms: DataFrame) -> DataFrame:
    return atoms.filter(F.col("element") != "H")


def residue_label(chain: str = "chain", resseq: str = "resseq", icode: str = "icode") -> Column:
    return F.concat(F.col(chain), F.col(resseq).cast("string"), F.trim(icode))


def clash_count(ligand: DataFrame, receptor: DataFrame, by: list[str], radius: float = 1.5) -> DataFrame:
    """Heavy-atom pairs closer than the radius; null with a reason when a side has no atoms."""
    lig, rec = heavy(ligand), heavy(receptor)
    pairs = G.within_radius(lig, rec, by, radius).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sides = (
        lig.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ligand"))
        .join(rec.groupBy(*by).agg(F.count(F.lit(1)).alias("n_receptor")), by, "full")
        .join(pairs, by, "left")
    )
    missing = F.when(F.col("n_ligand").isNull(), "no ligand atoms").when(F.col("n_receptor").isNull(), "no receptor atoms")
    n = F.when(missing.isNull(), F.coalesce("_n", F.lit(0)))
    return sides.select(*by, n.alias("n_clashes"), (n > 0).alias("has_clash"), missing.alias("reason"))


def min_distance(ligand: DataFrame, receptor: DataFrame, by: list[str], key: list[str], cutoff: float) -> DataFrame:
    """Smallest heavy-atom distance and whether it lies under the cut-off."""
    # places and keys only: the search holds every pair of neighbouring cells
    lig, rec = heavy(ligand).select(*by, *key, *G.AXES), heavy(receptor).select(*by, "serial", *G.AXES)
    near = G.k_nearest(lig, rec, by, key, "serial", 1)
    d = F.sqrt(F.min("d2"))
    return near.groupBy(*by).agg(d.alias("min_distance"), (d < cutoff).alias("has_clash"))


def pocket_residues(ligand: DataFrame, receptor: DataFrame, by: list[str], radius: float = 8.0) -> DataFrame:
    """Receptor residues with a heavy atom within the radius of the ligand."""
    pairs = G.within_radius(heavy(ligand), heavy(receptor), by, radius)
    return pairs.select(*by, F.col("r_chain").alias("chain"), F.col("r_resseq").alias("resseq"), F.col("r_icode").alias("icode")).distinct()


def pocket_from_ca(atoms: DataFrame, radius: float = 6.0) -> DataFrame:
    """CA atoms of the protein with a flag for those within the radius of a non-water hetero atom."""
    ca = atoms.filter("record = 'ATOM' and atom = 'CA'")
    het = atoms.filter((F.col("record") == "HETATM") & ~F.col("resname").isin("HOH", "WAT"))
    hit = G.within_radius(het, ca, ["structure_id"], radius).select(
        "structure_id", *[F.col(f"r_{c}").alias(c) for c in RESIDUE[1:]]
    ).distinct().withColumn("_in", F.lit(True))
    out = ca.select(*RESIDUE).join(hit, RESIDUE, "left")
    return out.select(*RESIDUE, F.coalesce("_in", F.lit(False)).alias("in_pocket"))


def pocket_overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Jaccard index of two residue tables per key, 0 where one side is empty; counted, not gathered."""
    keys = [*by, "chain", "resseq"]
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return x.groupBy(*by).agg((both / F.count(F.lit(1))).alias("overlap"))


def virtual_cb(atoms: DataFrame) -> DataFrame:
    """Side-chain centre from N, CA and C of each residue."""
    def pick(name, axis):
        return F.max(F.when(F.col("atom") == name, F.col(axis))).alias(f"{name}_{axis}")

    r = atoms.groupBy(*RESIDUE).agg(*[pick(n, v) for n in ("N", "CA", "C") for v in G.AXES])
    b = {v: F.col(f"CA_{v}") - F.col(f"N_{v}") for v in G.AXES}
    c = {v: F.col(f"C_{v}") - F.col(f"CA_{v}") for v in G.AXES}
    turn = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    out = {v: CB_CROSS * (b[p] * c[q] - b[q] * c[p]) + CB_B * b[v] + CB_C * c[v] + F.col(f"CA_{v}") for v, (p, q) in turn.items()}
    return r.select(*RESIDUE, *[e.alias(v) for v, e in out.items()])


def backbone_mask(atoms: DataFrame) -> DataFrame:
    """Residue is valid when N, CA, C and O all exist."""
    has = [F.bool_or(F.col("atom") == n) for n in BACKBONE]
    return atoms.groupBy(*RESIDUE).agg((has[0] & has[1] & has[2] & has[3]).alias("valid"))


def nearest_ligand_atoms(protein: DataFrame, ligand: DataFrame, k: int = 16, cutoff: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest ligand heavy atoms of each valid residue (by its side-chain centre),
    and per residue the closest distance and the pocket flag."""
    centre = virtual_cb(protein).join(backbone_mask(protein), RESIDUE)
    near = G.k_nearest(centre.filter("valid"), heavy(ligand), ["structure_id"], RESIDUE[1:], "serial", k)
    closest = near.filter("rank = 1").select(*RESIDUE, "d2")
    flags = centre.select(*RESIDUE, "valid").join(closest, RESIDUE, "left")
    d = F.sqrt(F.coalesce("d2", F.lit(FAR_D2)))
    return near, flags.select(*RESIDUE, "valid", d.alias("closest"), (F.col("valid") & (d < cutoff)).alias("in_pocket"))


def chain_contacts(atoms: DataFrame, cutoff: float) -> DataFrame:
    """Chains by number of protein atoms that touch a ligand; rank 1 is kept, ties by chain id."""
    protein, ligand = atoms.filter("kind = 'protein'"), atoms.filter("kind = 'ligand'")
    touched = G.within_radius(ligand, protein, ["structure_id"], cutoff).select("structure_id", F.col("r_chain").alias("chain"), F.col("r_serial").alias("serial"))
    n = touched.distinct().groupBy("structure_id", "chain").agg(F.count(F.lit(1)).alias("_n"))
    chains = protein.select("structure_id", "chain").distinct().join(n, ["structure_id", "chain"], "left")
    chains = chains.select("structure_id", "chain", F.coalesce("_n", F.lit(0)).alias("n_contacts"))
    w = W.partitionBy("structure_id").orderBy(F.desc("n_contacts"), F.asc("chain"))  # few chains per structure
    return chains.withColumn("rank", F.row_number().over(w))


def contacting_ligands(atoms: DataFrame, contacts: DataFrame, cutoff: float) -> DataFrame:
    """Ligand residues that touch the best chain."""
    best = contacts.filter("rank = 1").select("structure_id", "chain")
    chain = atoms.filter("kind = 'protein'").join(best, ["structure_id", "chain"], "left_semi")
    return G.within_radius(atoms.filter("kind = 'ligand'"), chain, ["structure_id"], cutoff).select(*RESIDUE, "resname").distinct()


def largest_ligand(atoms: DataFrame, wanted: DataFrame | None = None, min_atoms: int = 5) -> DataFrame:
    """The wanted ligand code per structure where given, else the largest residue that is
    neither water nor metal and has more than ``min_atoms`` atoms."""
    het = atoms.filter("record = 'HETATM'").groupBy(*RESIDUE, "resname").agg(F.count(F.lit(1)).alias("n_atoms"), F.min("serial").alias("_first"))
    if wanted is not None:
        het = het.join(wanted.select("structure_id", "het_id"), "structure_id", "left")
    else:
        het = het.withColumn("het_id", F.lit(None).cast("string"))
    free = ~F.col("resname").isin(*WATER, *METALS) & (F.col("n_atoms") > min_atoms)
    ok = het.filter(F.when(F.col("het_id").isNotNull(), F.col("resname") == F.col("het_id")).otherwise(free))
    size = F.when(F.col("het_id").isNull(), -F.col("n_atoms"))
    return S.first_per(ok, ["structure_id"], [size.asc_nulls_last(), F.col("_first")]).drop("_first", "het_id")


def centroids(atoms: DataFrame, by: list[str]) -> DataFrame:
    return heavy(atoms).groupBy(*by).agg(*[F.avg(v).alias(v) for v in G.AXES])


def com_distance(poses: DataFrame, target: DataFrame, by: list[str], pose: list[str]) -> DataFrame:
    """Distance of the heavy-atom centroids of pose and target ligand."""
    a = centroids(poses, [*by, *pose])
    b = centroids(target, by).withColumnsRenamed({v: f"t{v}" for v in G.AXES})
    d2 = sum(((F.col(v) - F.col(f"t{v}")) * (F.col(v) - F.col(f"t{v}")) for v in G.AXES), F.lit(0.0))
    return a.join(b, by).select(*by, *pose, F.sqrt(d2).alias("com_distance"))


def docking_box(ligand: DataFrame, by: list[str], padding: float, minimum: float = 20.0) -> DataFrame:
    """Centre and box size of a ligand, padded on both sides, at least ``minimum`` per axis."""
    aggs = []
    for v in G.AXES:
        aggs += [F.avg(v).alias(f"centre_{v}"), F.greatest(F.max(v) - F.min(v) + 2 * padding, F.lit(minimum)).alias(f"size_{v}")]
    return ligand.groupBy(*by).agg(*aggs)


def backbone_only(atoms: DataFrame, with_cb: bool = True, to_alanine: bool = True, keep_hetero: bool = True) -> DataFrame:
    """Side chains removed: backbone (and CB) of the first alternative location, hetero atoms kept."""
    allowed = [*BACKBONE, "CB"] if with_cb else BACKBONE
    polymer = F.col("record") == "ATOM"
    keep = polymer & F.col("atom").isin(*allowed) & F.trim("altloc").isin("", "A")
    if keep_hetero:
        keep = keep | ~polymer
    out = atoms.filter(keep)
    return out.withColumn("resname", F.when(polymer, "ALA").otherwise(F.col("resname"))) if to_alanine else out


def renumber(residues: DataFrame, by: list[str], order: str, number: str) -> DataFrame:
    """Residue numbers made consecutive over insertion codes: repeats so far are added.

    Repeats are neighbours with the same number, counted within ranges of the order first
    and carried over range totals, so a structure of any size is not gathered.
    """
    x = S.in_ranges(residues, by, [F.col(order)])
    inside = W.partitionBy(*by, "_range").orderBy(order)
    last = x.groupBy(*by, "_range").agg(F.max_by(number, order).alias("_last"))
    carried = last.select(*by, "_range", F.lag("_last").over(W.partitionBy(*by).orderBy("_range")).alias("_prev"))
    x = S.null_safe_join(x, carried, [*by, "_range"])
    before = F.when(F.row_number().over(inside) == 1, F.col("_prev")).otherwise(F.lag(number).over(inside))
    x = x.withColumn("_same", F.coalesce((before == F.col(number)).cast("long"), F.lit(0)))
    x = x.withColumn("_run", F.sum("_same").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    totals = x.groupBy(*by, "_range").agg(F.sum("_same").alias("_t"))
    upto = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_add"))
    x = S.null_safe_join(x, totals, [*by, "_range"])
    return x.withColumn(f"{number}_new", F.col(number) + F.col("_add") + F.col("_run")).drop("_range", "_at", "_prev", "_same", "_run", "_add")


# ---- stitching of fragments


def residue_upsert(full: DataFrame, fragment: DataFrame, ligand: Column) -> tuple[DataFrame, DataFrame]:
    """Residues of the full structure replaced by those of a fragment with the same key.

    Polymer residues and those hetero residues that ``ligand`` selects are replaced; returns
    the atoms and per structure the numbers of replaced residues, added and removed atoms.
    """
    may = (F.col("record") == "ATOM") | ligand
    fkeys = fragment.select(*RESIDUE, F.col("record").alias("_rec")).distinct()
    hit = full.filter(may).select(*RESIDUE, F.col("record").alias("_rec")).distinct().join(fkeys, [*RESIDUE, "_rec"], "left_semi")
    hit = hit.withColumnRenamed("_rec", "record")
    kept = full.join(hit, [*RESIDUE, "record"], "left_anti")
    new = fragment.join(hit, [*RESIDUE, "record"], "left_semi")
    old = full.join(hit, [*RESIDUE, "record"], "left_semi")
    counts = (
        hit.groupBy("structure_id").agg(F.count(F.lit(1)).alias("residues"))
        .join(new.groupBy("structure_id").agg(F.count(F.lit(1)).alias("added")), "structure_id", "left")
        .join(old.groupBy("structure_id").agg(F.count(F.lit(1)).alias("removed")), "structure_id", "left")
    )
    return kept.unionByName(new), counts


def atom_upsert(full: DataFrame, fragment: DataFrame) -> DataFrame:
    """Side-chain atoms of the fragment overwrite or extend polymer residues of the full
    structure; non-polymer residues of the fragment replace or join it; the backbone stays."""
    key = [*RESIDUE, "atom"]
    value = [c for c in full.columns if c not in key]
    polymer = full.filter("kind = 'protein'")
    side = fragment.filter(~F.col("atom").isin(*BACKBONE)).join(polymer.select(*RESIDUE).distinct(), RESIDUE, "left_semi")
    new = side.select(*key, F.struct(*value).alias("_new"))
    merged = polymer.select(*key, F.struct(*value).alias("_old")).join(new, key, "full")
    names = F.coalesce("_new", "_old")
    stitched = merged.select(*key, *[names[c].alias(c) for c in value])
    # an extended residue keeps its own name
    own = polymer.groupBy(*RESIDUE).agg(F.min("resname").alias("_own"))
    stitched = stitched.join(own, RESIDUE).withColumn("resname", F.col("_own")).drop("_own")
    loose = fragment.filter("kind = 'ligand'")
    others = full.filter("kind <> 'protein'")
    others = others.join(loose.select(*RESIDUE).distinct().withColumn("kind", F.lit("ligand")), [*RESIDUE, "kind"], "left_anti")
    return stitched.select(*full.columns).unionByName(others.select(*full.columns)).unionByName(loose.select(*full.columns))


def match_by_order(a: DataFrame, b: DataFrame, by: list[str], order: str) -> DataFrame:
    """Atoms of one ligand paired with those of another by order: non-hydrogens, then hydrogens.

    Unequal counts leave rows with a missing side; ``element_mismatch`` marks differing elements.
    """
    def numbered(df, name):
        h = F.upper("element").startswith("H")
        x = S.ranked(df.withColumn("is_h", h), [*by, "is_h"], [F.col(order)], "pos")
        cols = [c for c in df.columns if c not in by]
        return x.select(*by, "is_h", "pos", *[F.col(c).alias(f"{name}_{c}") for c in cols])

    out = numbered(a, "a").join(numbered(b, "b"), [*by, "is_h", "pos"], "full")
    differ = F.upper("a_element") != F.upper("b_element")
    return out.withColumn("element_mismatch", F.when(F.col("is_h"), F.lit(False)).otherwise(differ)).withColumn(
        "unmatched", F.col(f"a_{order}").isNull() | F.col(f"b_{order}").isNull()
    )


def complex_union(receptor: DataFrame, ligand: DataFrame, by: list[str], chain: str = "Z", resseq: int = 1) -> DataFrame:
    """Receptor and ligand as one structure; the ligand becomes hetero atoms of its own chain; serials run on."""
    tagged = ligand.withColumns({"chain": F.lit(chain), "record": F.lit("HETATM"), "resseq": F.lit(resseq), "icode": F.lit("")})
    both = receptor.withColumn("_part", F.lit(0)).unionByName(tagged.withColumn("_part", F.lit(1)))
    old = F.col("serial")
    numbered = S.ranked(both, by, [F.col("_part"), old], "_new")
    return numbered.withColumn("serial", F.col("_new")).drop("_new", "_part")


# ---- design constraints


def constraint_matrix(
    residues: DataFrame, constraints: DataFrame, global_bias: dict[str, float], design_chains: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Residue × amino-acid table of bias and omission with the design flag and membrane label.

    ``constraints`` has (structure_id, residue, kind, aa, value), kind one of fixed, redesign,
    bias, omit, buried, interface. The second result lists labels that match no residue.
    """
    res = residues.withColumn("residue", residue_label())
    known = res.select("structure_id", "residue").distinct()
    unknown = constraints.join(known, ["structure_id", "residue"], "left_anti")
    marks = constraints.groupBy("structure_id", "residue").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in ("fixed", "redesign", "buried", "interface")]
    )
    any_redesign = constraints.groupBy("structure_id").agg(F.bool_or(F.col("kind") == "redesign").alias("_any"))
    x = res.join(marks, ["structure_id", "residue"], "left").join(any_redesign, "structure_id", "left")
    flag = {k: F.coalesce(F.col(f"_{k}"), F.lit(False)) for k in ("fixed", "redesign", "buried", "interface")}
    chain_ok = F.lit(True) if not design_chains else F.col("chain").isin(*design_chains)
    design = chain_ok & F.when(F.coalesce("_any", F.lit(False)), flag["redesign"]).otherwise(~flag["fixed"])
    label = F.when(flag["buried"] & ~flag["interface"], 2).when(flag["interface"] & ~flag["buried"], 1).otherwise(0)
    x = x.select("structure_id", "residue", design.alias("design"), label.alias("membrane"), F.explode(F.array(*[F.lit(a) for a in ALPHABET])).alias("aa"))
    cells = constraints.filter(F.col("kind").isin("bias", "omit")).groupBy("structure_id", "residue", "aa").agg(
        F.max(F.when(F.col("kind") == "bias", F.col("value"))).alias("_b"), F.bool_or(F.col("kind") == "omit").alias("_o")
    )
    base = F.coalesce(*[F.when(F.col("aa") == a, F.lit(float(v))) for a, v in global_bias.items()], F.lit(0.0))
    x = x.join(cells, ["structure_id", "residue", "aa"], "left")
    out = x.select(
        "structure_id", "residue", "aa", "design", "membrane",
        (base + F.coalesce("_b", F.lit(0.0))).alias("bias"), F.coalesce("_o", F.lit(False)).alias("omit"),
    )
    return out, unknown


def symmetry_groups(df: DataFrame, groups: str, weights: str) -> DataFrame:
    """Linked residues from ``A1,B1|A2,B2`` and weights in the same shape; missing weights are 1."""
    pairs = F.arrays_zip(F.split(groups, r"\|").alias("g"), F.split(weights, r"\|").alias("w"))
    x = df.select("structure_id", F.posexplode(pairs).alias("group", "_p"))
    cell = F.arrays_zip(F.split("_p.g", ",").alias("r"), F.split("_p.w", ",").alias("w"))
    x = x.select("structure_id", "group", F.posexplode(cell).alias("pos", "_c"))
    return x.select("structure_id", "group", "pos", F.trim("_c.r").alias("residue"), F.coalesce(F.col("_c.w").try_cast("double"), F.lit(1.0)).alias("weight"))


def homo_oligomer_groups(residues: DataFrame) -> DataFrame:
    """The same residue of every chain linked with equal weights; the group is named after the residue."""
    chains = residues.select("structure_id", "chain").distinct().groupBy("structure_id").agg(F.count(F.lit(1)).alias("_n"))
    group = F.concat(F.col("resseq").cast("string"), F.trim("icode"))
    x = residues.select("structure_id", group.alias("group"), residue_label().alias("residue")).distinct()
    return x.join(chains, "structure_id").select("structure_id", "group", "residue", (F.lit(1.0) / F.col("_n")).alias("weight"))


def residues_align(target: DataFrame, off: DataFrame, by: list[str], position: str = "pos", label: str = "residue") -> DataFrame:
    """Whether the off-target has the same residue labels in the same order as the target."""
    a = target.select(*by, position, F.col(label).alias("_a"))
    b = off.select(*by, position, F.col(label).alias("_b"))
    x = a.join(b, [*by, position], "full").groupBy(*by).agg(
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_mismatch"), F.count(F.lit(1)).alias("n_positions")
    )
    return x.withColumn("accepted", F.col("n_mismatch") == 0)
