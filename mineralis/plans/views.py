"""Domain views over the given tables.

The tables hold no crystals, so each view reads one of them as the domain object it resembles. Every
view is a lazy projection; none numbers rows with a window, since one order or user may own a third
of the table. Row identity comes from columns instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import element_table

# ---- fixed values: which element a brand, label or type stands for ------------------------------
BRAND_ELEMENTS = ("O", "Si", "Fe", "H", "N", "P", "Na", "S", "Mg", "Cl", "Ti", "C", "K", "F", "Al",
                  "B", "Mn", "Ca", "Zn", "Cu", "Li", "V", "Cr", "Ni", "Co")
LABEL_ELEMENTS = ("Si", "O", "P", "O", "H", "B", "N", "C", "O", "Fe")
TYPE_ELEMENTS = {"STANDARD": "O", "ECONOMY": "S", "MEDIUM": "F", "PROMO": "Cl", "LARGE": "N",
                 "SMALL": "C"}
THIRD_ELEMENTS = ("Na", "K", "Ca", "Mg", "Zn")
SITE_CELL = 5.0          # cube edge of a v_site structure, angstrom
POINT_CELL = 8.0         # cube edge of a v_point structure, angstrom
PARTS = 256              # tasks that rows of short keys are dealt to
POINTS_PER_CELL = 40     # vectors per v_point structure: the structure size is bounded by this


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(symbols, index):
    return F.element_at(F.array(*[F.lit(s) for s in symbols]), index)


def site(spark, sf_dir) -> DataFrame:
    """Atom-site rows: structure_id, element, occ, pos and fractional x, y, z in a cube."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        _pick(BRAND_ELEMENTS,
              (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") - 1) % 25 + 1).alias("element"))
    gx = F.col("l_partkey") % 3
    gy = F.col("l_suppkey") % 2
    gz = F.col("l_quantity").cast("long") % 2
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("l_orderkey").alias("structure_id"),
            "element",
            F.when(F.col("l_discount") <= 0.07, F.lit(1.0))
            .otherwise(F.round(1 - 5 * F.col("l_discount"), 2)).alias("occ"),
            (gx * 4 + gy * 2 + gz).cast("int").alias("pos"),
            (gx / 4.0).alias("x"), (gy / 2.0).alias("y"), (gz / 4.0).alias("z"),
            (F.col("l_tax") > 0.06).cast("int").alias("raised"),
        )
    )


def site_parts(spark, sf_dir) -> DataFrame:
    """The sites dealt to ``PARTS`` tasks by (structure, element), for sums and joins by these two.

    Left to itself, Spark joins small shuffled blocks up to a size in bytes, and keys this short then come in
    millions to a task, whose hash tables take twenty times those bytes.
    """
    return site(spark, sf_dir).repartition(PARTS, "structure_id", "element")


def species(spark, sf_dir, rows=None) -> DataFrame:
    """Occupancy per (structure, position, element): the species list of a parsed structure (of ``rows`` of ``site``)."""
    return (
        (site(spark, sf_dir) if rows is None else rows)
        .groupBy("structure_id", "pos", "x", "y", "z", "element")
        .agg(F.sum("occ").alias("occ"))
    )


def site_cube():
    """The cell of every v_site structure, row-major."""
    return _cube(SITE_CELL)


def _cube(edge: float):
    return F.array(*[F.lit(v) for v in (edge, 0.0, 0.0, 0.0, edge, 0.0, 0.0, 0.0, edge)])


def valence(spark, sf_dir, rows=None) -> DataFrame:
    """Oxidation numbers as a structure's atom types declare them: (structure, element, oxidation)."""
    rows = (site(spark, sf_dir) if rows is None else rows).select("structure_id", "element", "raised").distinct()
    el = element_table(spark).select(F.col("symbol").alias("element"), "ox_common")
    return rows.join(el, "element").select(
        "structure_id", "element", (F.col("ox_common") + F.col("raised")).cast("double").alias("oxidation"))


def amount(spark, sf_dir) -> DataFrame:
    """Rows and located occupancy per (structure, element)."""
    return (
        site(spark, sf_dir).groupBy("structure_id", "element")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("occ").alias("located"), F.min("occ").alias("min_occ"))
    )


def entry(spark, sf_dir) -> DataFrame:
    """The catalogue: one row per order; orders without lines keep NULL chemistry."""
    from ..operators.catalogue import chemistry_columns

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.format_string("entry_%d.cif", F.col("o_orderkey")).alias("filename"),
        (F.col("o_custkey") % 230 + 1).cast("int").alias("spacegroup_number"),
        "o_totalprice",
    )
    chem = chemistry_columns(amount(spark, sf_dir), element_table(spark))
    return (
        orders.join(chem, orders.id == chem.structure_id, "left").drop("structure_id")
        .withColumn("is_disordered", F.col("min_occupancy") < 0.99)
    )


def entry_element(spark, sf_dir) -> DataFrame:
    """Element bridge."""
    return site(spark, sf_dir).select(F.col("structure_id").alias("id"), "element").distinct()


def point(spark, sf_dir) -> DataFrame:
    """Atoms from embeddings: every POINTS_PER_CELL consecutive vectors share one cube."""
    emb = table(spark, sf_dir, "embeddings")

    def frac(k):
        return F.round(F.pmod(F.element_at("embedding", k).cast("double") * 2, F.lit(1.0)), 4)

    return emb.select(
        F.floor(F.col("vec_id") / POINTS_PER_CELL).cast("long").alias("structure_id"),
        F.col("vec_id").alias("atom"),
        _pick(LABEL_ELEMENTS, F.col("label") + 1).alias("element"),
        frac(1).alias("x"), frac(2).alias("y"), frac(3).alias("z"),
        F.when(F.col("vec_id") % 4 == 0, 0.5).when(F.col("vec_id") % 4 == 1, 0.7).otherwise(1.0).alias("occ"),
        _cube(POINT_CELL).alias("lattice"),
    )


def sample(spark, sf_dir) -> DataFrame:
    """Configuration samples from events: entry = user, ord = event id."""
    ev = table(spark, sf_dir, "events")
    mode = (F.when(F.col("event_type") == "purchase", "dispersed")
            .when(F.col("event_type") == "error", "clustered").otherwise("random"))
    return ev.select(
        F.col("user_id").alias("entry"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit("cfg"), F.col("event_id").cast("string")).alias("label"),
        mode.alias("mode"),
        F.when(F.col("value") <= 1.0, 2).otherwise(0).alias("short_fill"),
        (F.col("value") > 5.0).alias("converged"),
        (F.col("value") / 1000).alias("energy"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_id") % 7).alias("m7"),
        F.when(F.col("event_id") % 5 == 0, 3).otherwise(4).cast("long").alias("n_o"),
    )


def valid_sample(spark, sf_dir) -> DataFrame:
    """Samples with the validity rule applied: filled, converged."""
    s = sample(spark, sf_dir)
    ok = (F.col("short_fill") == 0) & F.col("converged")
    return s.withColumn("valid", ok).withColumn("energy", F.when(ok, F.col("energy")))


def ledger(spark, sf_dir) -> DataFrame:
    """Campaign ledger from events: file = user, seq = event id."""
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = (F.when(kind == "view", "completed").when(kind == "click", "ok")
              .when(kind == "signup", "skipped").when(kind == "purchase", "declined")
              .otherwise("error"))
    return ev.select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".cif")).alias("file"),
        status.alias("status"),
        F.when(kind == "error", "engine").when(kind == "purchase", "review").alias("stage"),
        F.lit(None).cast("string").alias("rundir"),
        F.when(F.col("event_id") % 3 == 0, "B").when(F.col("event_id") % 3 == 1, "D").alias("klass"),
        F.lit(None).cast("string").alias("confidence"),
        F.lit(None).cast("string").alias("gates"),
        F.when(F.col("value") > 200, "revise").when(F.col("value") > 20, "confirm").alias("verdict"),
        F.when(F.col("value") > 20, 1).alias("round"),
        F.lit(None).cast("string").alias("escalate"),
        F.when(kind.isin("error", "purchase"), F.col("props")).alias("error"),
    )


def review(spark, sf_dir) -> DataFrame:
    """Review rounds: one objection per turn, blocking when the text length divides by three."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("entry"),
        F.col("turn").alias("round"),
        F.when(F.col("role") == "assistant", "confirm").otherwise("revise").alias("verdict"),
        F.when(F.length("text") % 3 == 0, "blocking").otherwise("minor").alias("severity"),
        F.concat(F.lit("issue-"), F.md5(F.col("text"))).alias("issue"),
    )


def phase(spark, sf_dir) -> DataFrame:
    """Reference phases from parts: one to three elements, integer amounts of at most four each."""
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    brand = _pick(BRAND_ELEMENTS, (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") - 1) % 25 + 1)
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in TYPE_ELEMENTS.items() for v in kv]),
                        F.col("p_type"))
    third = _pick(THIRD_ELEMENTS, (key % 5 + 1).cast("int"))
    terms = F.filter(
        F.array(
            F.struct(brand.alias("element"), (size % 4 + 1).cast("long").alias("n")),
            F.struct(kind.alias("element"), F.when(key % 17 != 0, F.floor(size / 4) % 4 + 1).otherwise(0).cast("long").alias("n")),
            F.struct(third.alias("element"), F.when((key % 3 == 0) & (key % 17 != 0), key % 2 + 1).otherwise(0).cast("long").alias("n")),
        ),
        lambda t: t["n"] > 0)
    return (
        part.select(
            key.alias("material_id"), terms.alias("terms"),
            (-((key * 7919) % 1000) / 250.0).alias("energy"),
            F.when(key % 11 != 0, ((key * 31) % 50) / 100.0).alias("ehull"),
            F.when(key % 97 == 0, 400).otherwise(40).cast("int").alias("n_cell_atoms"))
    )


def flag(spark, sf_dir) -> DataFrame:
    """Documents with a nullable label: the tri-state column."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("is_good"))
