"""Contacts, pockets, stitching and constraints on the mapped atoms table."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.operators import spatial as A
from bindloom.plans import grid as G

c = F.col
AT = D.with_sql(D.ATOMS)
D2 = D.D2
RES = "structure_id, chain, resseq, icode"


def kind(spark, sf, name):
    return D.atoms(spark, sf).filter(c("kind") == name)


@query(
    "clash_count",
    AT + f"""SELECT structure_id, coalesce(n, 0) AS n_clashes, coalesce(n, 0) > 0 AS has_clash, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT structure_id FROM lig) LEFT JOIN
      (SELECT l.structure_id, count(*) AS n FROM lig l JOIN prot p ON l.structure_id = p.structure_id AND l.element <> 'H' AND p.element <> 'H' AND {D2} <= 6.25 GROUP BY 1) USING (structure_id)""",
)
def _(spark, sf):
    return A.clash_count(kind(spark, sf, "ligand"), kind(spark, sf, "protein"), ["structure_id"], 2.5)


@query(
    "min_distance",
    AT + f"""SELECT structure_id, round(sqrt(min(d2)), 6) AS min_distance, sqrt(min(d2)) < 2.0 AS has_clash FROM (SELECT l.structure_id, {D2} AS d2 FROM lig l JOIN prot p
      ON l.structure_id = p.structure_id AND l.element <> 'H' AND p.element <> 'H') GROUP BY 1""",
)
def _(spark, sf):
    return D.rounded(A.min_distance(kind(spark, sf, "ligand"), kind(spark, sf, "protein"), ["structure_id"], ["serial"], 2.0))


POCKET = f"""pk AS (SELECT DISTINCT l.structure_id, l.vec_id, p.chain, p.resseq, p.icode FROM lig l JOIN prot p ON l.structure_id = p.structure_id AND l.element <> 'H' AND p.element <> 'H' AND {D2} <= 64)"""


@query("pocket_residues", AT + ", " + POCKET + f" SELECT DISTINCT {RES} FROM pk")
def _(spark, sf):
    return A.pocket_residues(kind(spark, sf, "ligand"), kind(spark, sf, "protein"), ["structure_id"], 8.0)


@query(
    "pocket_from_ca",
    AT + f"""SELECT p.structure_id, p.chain, p.resseq, p.icode, EXISTS (SELECT 1 FROM atoms l WHERE l.structure_id = p.structure_id AND l.record = 'HETATM' AND l.resname <> 'HOH' AND {D2} <= 36) AS in_pocket
      FROM atoms p WHERE record = 'ATOM' AND atom = 'CA'""",
)
def _(spark, sf):
    return A.pocket_from_ca(D.atoms(spark, sf))


@query(
    "pocket_overlap",
    AT + ", " + POCKET + """, s AS (SELECT DISTINCT structure_id, vec_id, chain, resseq FROM pk), n AS (SELECT structure_id, vec_id, count(*) AS n FROM s GROUP BY 1, 2),
      f AS (SELECT structure_id, min(vec_id) AS v FROM n GROUP BY 1)
    SELECT structure_id, vec_id, round(k / (a + b - k), 6) AS overlap FROM (SELECT n.structure_id, n.vec_id, n.n AS a, m.n AS b, (SELECT count(*) FROM s s1 JOIN s s2 ON s1.structure_id = s2.structure_id AND s1.chain = s2.chain
        AND s1.resseq = s2.resseq AND s1.structure_id = n.structure_id AND s1.vec_id = n.vec_id AND s2.vec_id = f.v) AS k FROM n JOIN f USING (structure_id) JOIN n m ON m.structure_id = n.structure_id AND m.vec_id = f.v)""",
)
def _(spark, sf):
    pairs = G.within_radius(A.heavy(kind(spark, sf, "ligand")), A.heavy(kind(spark, sf, "protein")), ["structure_id"], 8.0)
    pk = pairs.select("structure_id", "vec_id", c("r_chain").alias("chain"), c("r_resseq").alias("resseq")).distinct()
    first = pk.groupBy("structure_id").agg(F.min("vec_id").alias("_v"))
    target = pk.join(first, "structure_id").filter(c("vec_id") == c("_v")).select("structure_id", "chain", "resseq")
    poses = pk.select("structure_id", "vec_id").distinct()
    b = poses.join(target, "structure_id")
    return D.rounded(A.pocket_overlap(pk, b, ["structure_id", "vec_id"]))


CB = """r AS (SELECT structure_id, chain, resseq, icode, """ + ", ".join(
    f"max({v}) FILTER (atom = '{n}') AS {n.lower()}{v}" for n in ("N", "CA", "C") for v in "xyz"
) + """, count(DISTINCT atom) FILTER (atom IN ('N', 'CA', 'C', 'O')) = 4 AS valid FROM prot GROUP BY 1, 2, 3, 4),
  cb AS (SELECT structure_id, chain, resseq, icode, valid,
    -0.58273431::DOUBLE * ((cay - ny) * (cz - caz) - (caz - nz) * (cy - cay)) + 0.56802827::DOUBLE * (cax - nx) - 0.54067466::DOUBLE * (cx - cax) + cax AS x,
    -0.58273431::DOUBLE * ((caz - nz) * (cx - cax) - (cax - nx) * (cz - caz)) + 0.56802827::DOUBLE * (cay - ny) - 0.54067466::DOUBLE * (cy - cay) + cay AS y,
    -0.58273431::DOUBLE * ((cax - nx) * (cy - cay) - (cay - ny) * (cx - cax)) + 0.56802827::DOUBLE * (caz - nz) - 0.54067466::DOUBLE * (cz - caz) + caz AS z FROM r)"""


@query("virtual_cb", AT + ", " + CB + f" SELECT {RES}, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM cb")
def _(spark, sf):
    return D.rounded(A.virtual_cb(kind(spark, sf, "protein")))


@query("backbone_mask", AT + ", " + CB + f" SELECT {RES}, valid FROM cb")
def _(spark, sf):
    return A.backbone_mask(kind(spark, sf, "protein"))


NEAR = f""", k AS (SELECT p.structure_id, p.chain, p.resseq, p.icode, l.serial, {D2} AS d2, row_number() OVER (PARTITION BY p.structure_id, p.chain, p.resseq, p.icode ORDER BY {D2}, l.serial) AS rank
    FROM cb p JOIN lig l ON l.structure_id = p.structure_id AND l.element <> 'H' WHERE p.valid)"""


def ligand_places(spark, sf):
    """What the search for near ligand atoms reads; it holds every pair of neighbouring cells."""
    return kind(spark, sf, "ligand").select("structure_id", "element", "serial", *G.AXES)


@query("nearest_ligand_atoms", AT + ", " + CB + NEAR + f" SELECT {RES}, serial, round(d2, 5) AS d2, rank FROM k WHERE rank <= 16")
def _(spark, sf):
    near, _flags = A.nearest_ligand_atoms(kind(spark, sf, "protein"), ligand_places(spark, sf), 16)
    return D.rounded(near.select(*A.RESIDUE, c("r_serial").alias("serial"), "d2", "rank"), 5)


@query(
    "ligand_pocket_mask",
    AT + ", " + CB + NEAR + f""" SELECT cb.structure_id, cb.chain, cb.resseq, cb.icode, valid, round(sqrt(coalesce(k.d2, 1000)), 6) AS closest, valid AND sqrt(coalesce(k.d2, 1000)) < 8 AS in_pocket
      FROM cb LEFT JOIN k ON k.rank = 1 AND k.structure_id = cb.structure_id AND k.chain = cb.chain AND k.resseq = cb.resseq AND k.icode = cb.icode""",
)
def _(spark, sf):
    _near, flags = A.nearest_ligand_atoms(kind(spark, sf, "protein"), ligand_places(spark, sf), 16)
    return D.rounded(flags)


CONTACT = f"""t AS (SELECT p.structure_id, p.chain, count(DISTINCT p.serial) AS n FROM lig l JOIN prot p ON l.structure_id = p.structure_id AND {D2} <= 25 GROUP BY 1, 2),
  ch AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY n_contacts DESC, chain) AS rank FROM (SELECT s.structure_id, s.chain, coalesce(n, 0) AS n_contacts
    FROM (SELECT DISTINCT structure_id, chain FROM prot) s LEFT JOIN t ON t.structure_id = s.structure_id AND t.chain = s.chain))"""


@query("chain_contact_rank", AT + ", " + CONTACT + " SELECT * FROM ch")
def _(spark, sf):
    return A.chain_contacts(D.atoms(spark, sf), 5.0)


@query(
    "chain_contact_ligands",
    AT + ", " + CONTACT + f""" SELECT DISTINCT l.structure_id, l.chain, l.resseq, l.icode, l.resname FROM lig l JOIN prot p ON l.structure_id = p.structure_id AND {D2} <= 25
      JOIN ch ON ch.rank = 1 AND ch.structure_id = p.structure_id AND ch.chain = p.chain""",
)
def _(spark, sf):
    at = D.atoms(spark, sf)
    return A.contacting_ligands(at, A.chain_contacts(at, 5.0), 5.0)


@query(
    "largest_ligand",
    AT + f""", h AS (SELECT {RES}, resname, count(*) AS n_atoms, min(serial) AS f FROM atoms WHERE record = 'HETATM' GROUP BY ALL)
    SELECT {RES}, resname, n_atoms FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY CASE WHEN structure_id = 'S3' THEN NULL ELSE -n_atoms END NULLS LAST, f) AS rn FROM h
      WHERE CASE WHEN structure_id = 'S3' THEN resname = 'LG2' ELSE resname <> 'HOH' AND n_atoms > 5 END) WHERE rn = 1""",
)
def _(spark, sf):
    at = D.atoms(spark, sf)
    wanted = at.filter("structure_id = 'S3' and resname = 'LG2'").select("structure_id", c("resname").alias("het_id")).distinct()
    return A.largest_ligand(at, wanted)


CENT = """h AS (SELECT structure_id, vec_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lig WHERE element <> 'H' GROUP BY 1, 2), f AS (SELECT structure_id, min(vec_id) AS v FROM lig GROUP BY 1)"""


@query(
    "com_distance",
    AT + ", " + CENT + """ SELECT l.structure_id, l.vec_id, round(sqrt((l.x - p.x) ** 2 + (l.y - p.y) ** 2 + (l.z - p.z) ** 2), 6) AS com_distance
      FROM h l JOIN f ON f.structure_id = l.structure_id JOIN h p ON p.structure_id = l.structure_id AND p.vec_id = f.v""",
)
def _(spark, sf):
    lig = kind(spark, sf, "ligand")
    first = lig.groupBy("structure_id").agg(F.min("vec_id").alias("_v"))
    target = lig.join(first, "structure_id").filter(c("vec_id") == c("_v"))
    return D.rounded(A.com_distance(lig, target, ["structure_id"], ["vec_id"]))


@query(
    "docking_box",
    AT + "SELECT structure_id, vec_id, " + ", ".join(
        f"round(avg({v}), 6) AS centre_{v}, round(greatest(max({v}) - min({v}) + 16, 20), 6) AS size_{v}" for v in "xyz"
    ) + " FROM lig GROUP BY 1, 2",
)
def _(spark, sf):
    return D.rounded(A.docking_box(kind(spark, sf, "ligand"), ["structure_id", "vec_id"], 8.0))


@query(
    "backbone_only",
    AT + """SELECT structure_id, serial, CASE WHEN record = 'ATOM' THEN 'ALA' ELSE resname END AS resname FROM atoms
      WHERE record <> 'ATOM' OR (atom IN ('N', 'CA', 'C', 'O', 'CB') AND trim(altloc) IN ('', 'A'))""",
)
def _(spark, sf):
    return A.backbone_only(D.atoms(spark, sf)).select("structure_id", "serial", "resname")


@query(
    "residue_renumber",
    """WITH r AS (SELECT *, coalesce(CAST(lag(n) OVER (PARTITION BY s ORDER BY vec_id) = n AS INT), 0) AS same FROM (SELECT 'S' || label AS s, vec_id, vec_id // 40 AS n FROM embeddings))
    SELECT s, vec_id, n, CAST(n + sum(same) OVER (PARTITION BY s ORDER BY vec_id) AS BIGINT) AS n_new FROM r""",
)
def _(spark, sf):
    r = D.table(spark, sf, "embeddings").select(F.concat(F.lit("S"), "label").alias("s"), "vec_id", F.floor(c("vec_id") / 40).alias("n"))
    return A.renumber(r, ["s"], "vec_id", "n")


def fragment(spark, sf):
    """Pocket residues and ligands, moved; one atom has another name, some residues are unknown to the full structure."""
    at = D.atoms(spark, sf)
    near = A.pocket_residues(at.filter("kind = 'ligand'"), at.filter("kind = 'protein'"), ["structure_id"], 8.0)
    part = at.join(near, A.RESIDUE, "left_semi").unionByName(at.filter("kind = 'ligand'"))
    icode = F.when(c("icode") == "C", "D").otherwise(c("icode"))
    atom = F.when(c("i") == 6, "CH").otherwise(c("atom"))
    return part.withColumns({"x": c("x") + 1, "serial": c("serial") + 1000000, "icode": icode, "atom": atom})


def full(spark, sf):
    return D.atoms(spark, sf)


FRAG = POCKET + """, fr AS (SELECT * REPLACE (x + 1 AS x, serial + 1000000 AS serial, CASE WHEN i = 6 THEN 'CH' ELSE atom END AS atom) FROM atoms WHERE kind = 'ligand' OR (kind = 'protein' AND (structure_id, chain, resseq, icode) IN (SELECT (structure_id, chain, resseq, icode) FROM pk))),
  fu AS (SELECT * FROM atoms), hit AS (SELECT DISTINCT vec_id FROM fu WHERE icode <> 'C' AND (record = 'ATOM' OR resname = 'LG1') AND vec_id IN (SELECT vec_id FROM fr))"""


@query(
    "residue_upsert",
    AT + ", " + FRAG + """ SELECT structure_id, serial, round(x, 3) AS x FROM fu WHERE vec_id NOT IN (SELECT vec_id FROM hit) UNION ALL SELECT structure_id, serial, round(x, 3) FROM fr WHERE vec_id IN (SELECT vec_id FROM hit)""",
)
def _(spark, sf):
    out, _n = A.residue_upsert(full(spark, sf), fragment(spark, sf), c("resname") == "LG1")
    return D.rounded(out.select("structure_id", "serial", "x"), 3)


@query(
    "residue_upsert_counts",
    AT + ", " + FRAG + """ SELECT structure_id, count(DISTINCT vec_id) AS residues, count(*) FILTER (k = 1) AS added, count(*) FILTER (k = 0) AS removed FROM (SELECT structure_id, vec_id, 0 AS k FROM fu UNION ALL
      SELECT structure_id, vec_id, 1 FROM fr) WHERE vec_id IN (SELECT vec_id FROM hit) GROUP BY 1""",
)
def _(spark, sf):
    return A.residue_upsert(full(spark, sf), fragment(spark, sf), c("resname") == "LG1")[1]


@query(
    "atom_upsert",
    AT + ", " + FRAG + """, side AS (SELECT * FROM fr WHERE atom NOT IN ('N', 'CA', 'C', 'O') AND vec_id IN (SELECT vec_id FROM fu WHERE kind = 'protein' AND icode <> 'C')),
      pl AS (SELECT coalesce(s.structure_id, f.structure_id) AS structure_id, coalesce(s.serial, f.serial) AS serial, coalesce(s.x, f.x) AS x FROM (SELECT * FROM fu WHERE kind = 'protein') f FULL JOIN side s ON s.vec_id = f.vec_id AND s.atom = f.atom)
    SELECT structure_id, serial, round(x, 3) AS x FROM pl UNION ALL SELECT structure_id, serial, round(x, 3) FROM fr WHERE kind = 'ligand'
    UNION ALL SELECT structure_id, serial, round(x, 3) FROM fu WHERE kind <> 'protein' AND NOT (kind = 'ligand' AND icode <> 'C' AND vec_id IN (SELECT vec_id FROM fr))""",
)
def _(spark, sf):
    return D.rounded(A.atom_upsert(full(spark, sf), fragment(spark, sf)).select("structure_id", "serial", "x"), 3)


@query(
    "atom_match_by_order",
    AT + """, a AS (SELECT *, row_number() OVER (PARTITION BY structure_id, element = 'H' ORDER BY serial) AS pos FROM lig WHERE vec_id % 20 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY structure_id, element = 'H' ORDER BY serial) AS pos FROM lig WHERE vec_id % 20 = 10)
    SELECT coalesce(a.structure_id, b.structure_id) AS structure_id, coalesce(a.element, b.element) = 'H' AS is_h, coalesce(a.pos, b.pos) AS pos, a.serial AS a_serial, b.serial AS b_serial,
      CASE WHEN coalesce(a.element, b.element) = 'H' THEN FALSE ELSE a.element <> b.element END AS element_mismatch, a.serial IS NULL OR b.serial IS NULL AS unmatched
    FROM a FULL JOIN b ON a.structure_id = b.structure_id AND (a.element = 'H') = (b.element = 'H') AND a.pos = b.pos""",
)
def _(spark, sf):
    lig = kind(spark, sf, "ligand").select("structure_id", "vec_id", "serial", "element", "x", "y", "z")
    out = A.match_by_order(lig.filter("vec_id % 20 = 0"), lig.filter("vec_id % 20 = 10"), ["structure_id"], "serial")
    return out.select("structure_id", "is_h", "pos", "a_serial", "b_serial", "element_mismatch", "unmatched")


@query(
    "complex_union",
    AT + """SELECT structure_id, record, chain, resseq, atom, round(x, 3) AS x, row_number() OVER (PARTITION BY structure_id ORDER BY part, serial) AS serial FROM
      (SELECT structure_id, record, chain, resseq, atom, x, serial, 0 AS part FROM prot UNION ALL SELECT structure_id, 'HETATM', 'Z', 1, atom, x, serial, 1 FROM lig)""",
)
def _(spark, sf):
    out = A.complex_union(kind(spark, sf, "protein"), kind(spark, sf, "ligand"), ["structure_id"])
    return D.rounded(out.select("structure_id", "record", "chain", "resseq", "atom", "x", "serial"), 3)


def residues(spark, sf):
    return kind(spark, sf, "protein").filter("atom = 'CA'").select(*A.RESIDUE)


def constraints(spark, sf):
    v = c("vec_id")
    n = v % 23
    e = D.table(spark, sf, "embeddings")
    name = F.concat(F.when(v % 3 < 2, "A").otherwise("B"), F.floor(v / 4), F.element_at(F.array(*[F.lit(x) for x in ["", "A", "B", "C"]]), (v % 4 + 1).cast("int")))
    what = F.when(n == 0, "fixed").when((n == 1) & (c("label") < 5), "redesign").when(n == 2, "bias").when(n == 3, "omit").when(n == 4, "buried").when(n == 5, "interface")
    return e.select(
        F.concat(F.lit("S"), "label").alias("structure_id"), name.alias("residue"), what.alias("kind"),
        F.when(n == 2, "W").when(n == 3, "P").alias("aa"), F.when(n == 2, 1.5).alias("value"),
    ).filter("kind is not null")


CONS = """cs AS (SELECT 'S' || label AS structure_id, CASE WHEN vec_id % 3 < 2 THEN 'A' ELSE 'B' END || (vec_id // 4) || ['', 'A', 'B', 'C'][vec_id % 4 + 1] AS residue, CASE vec_id % 23 WHEN 0 THEN 'fixed' WHEN 1 THEN CASE WHEN label < 5 THEN 'redesign' END
    WHEN 2 THEN 'bias' WHEN 3 THEN 'omit' WHEN 4 THEN 'buried' WHEN 5 THEN 'interface' END AS kind FROM embeddings),
  rs AS (SELECT structure_id, chain, chain || resseq || icode AS residue FROM prot WHERE atom = 'CA'),
  rd AS (SELECT structure_id, bool_or(kind = 'redesign') AS anyr FROM cs WHERE kind IS NOT NULL GROUP BY 1)"""


@query(
    "constraint_matrix",
    AT + ", " + CONS + """ SELECT rs.structure_id, rs.residue, aa, CASE WHEN anyr THEN kind IS NOT DISTINCT FROM 'redesign' ELSE kind IS DISTINCT FROM 'fixed' END AS design, CASE kind WHEN 'buried' THEN 2 WHEN 'interface' THEN 1 ELSE 0 END AS membrane,
      CASE WHEN aa = 'G' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN kind = 'bias' AND aa = 'W' THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS bias, kind IS NOT DISTINCT FROM 'omit' AND aa = 'P' AS omit
    FROM rs CROSS JOIN (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWYX', '')) AS aa) LEFT JOIN cs ON cs.structure_id = rs.structure_id AND cs.residue = rs.residue LEFT JOIN rd ON rd.structure_id = rs.structure_id""",
)
def _(spark, sf):
    return A.constraint_matrix(residues(spark, sf), constraints(spark, sf), {"G": -1.0})[0]


@query(
    "constraint_unknown",
    AT + ", " + CONS + " SELECT structure_id, residue, kind FROM cs WHERE kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.structure_id = cs.structure_id AND rs.residue = cs.residue)",
)
def _(spark, sf):
    return A.constraint_matrix(residues(spark, sf), constraints(spark, sf), {})[1].select("structure_id", "residue", "kind")


@query(
    "symmetry_groups",
    """SELECT structure_id, g AS "group", CAST(i AS BIGINT) AS pos, CASE i WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || (vec_id + g) AS residue, CASE WHEN g = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM (SELECT 'V' || vec_id AS structure_id, vec_id, unnest([0, 0, 1, 1, 1]) AS g, unnest([0, 1, 0, 1, 2]) AS i FROM embeddings)""",
)
def _(spark, sf):
    v = c("vec_id")
    g = F.concat(F.lit("A"), v, F.lit(",B"), v, F.lit("|A"), v + 1, F.lit(", B"), v + 1, F.lit(",C"), v + 1)
    e = D.table(spark, sf, "embeddings").select(F.concat(F.lit("V"), v).alias("structure_id"), g.alias("g"), F.lit("0.5,0.5|1").alias("w"))
    out = A.symmetry_groups(e, "g", "w")
    return out.select("structure_id", c("group").cast("long").alias("group"), c("pos").cast("long").alias("pos"), "residue", "weight")


@query(
    "homo_oligomer_groups",
    AT + """SELECT structure_id, resseq || icode AS "group", chain || resseq || icode AS residue, 1.0::DOUBLE / (SELECT count(DISTINCT chain) FROM prot q WHERE q.structure_id = p.structure_id) AS weight FROM prot p WHERE atom = 'CA'""",
)
def _(spark, sf):
    return A.homo_oligomer_groups(residues(spark, sf))


@query(
    "residue_align_check",
    """WITH t AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderstatus AS r, o_orderkey FROM orders), o AS (SELECT k, pos + CASE WHEN o_orderkey % 31 = 3 THEN 1000 ELSE 0 END AS pos, CASE WHEN o_orderkey % 40 = 7 THEN 'X' ELSE r END AS r FROM t)
    SELECT coalesce(t.k, o.k) AS k, count(*) FILTER (t.r IS DISTINCT FROM o.r) AS n_mismatch, count(*) AS n_positions, count(*) FILTER (t.r IS DISTINCT FROM o.r) = 0 AS accepted FROM t FULL JOIN o ON t.k = o.k AND t.pos = o.pos GROUP BY 1""",
)
def _(spark, sf):
    from bindloom.plans import skew as S

    k = c("o_orderkey")
    t = S.ranked(D.table(spark, sf, "orders").select(c("o_custkey").alias("k"), "o_orderkey", c("o_orderstatus").alias("residue")), ["k"], [k], "pos")
    o = t.withColumn("pos", c("pos") + F.when(k % 31 == 3, 1000).otherwise(0)).withColumn("residue", F.when(k % 40 == 7, "X").otherwise(c("residue")))
    return A.residues_align(t, o, ["k"])
