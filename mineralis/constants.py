"""Thresholds, element roles and element properties.

Thresholds are defaults; every operator takes them as parameters.
"""

from __future__ import annotations

# ---- fixed values: thresholds -------------------------------------------------------------------
DISORDER_TOL = 0.99        # catalogue: smallest occupancy below this -> disordered
PARTIAL_OCC = 0.98         # evidence: occupancy sum below this -> partial position
FULL_SITE_OCC = 0.99       # build: a position below this is disordered
LABEL_TOL = 0.011          # descriptor: occupancy >= 1 - LABEL_TOL counts as full
SIBLING_TOL = 0.02         # sibling search: position sums this close to 1 are full
CONTACT_CUT = 2.6          # close contact / ligand shell, in angstrom
ALTERNATE_CUT = 1.6        # same-element ligands closer than this cannot coexist
BOND_TOL = 1.25            # bond when d < BOND_TOL * (r_i + r_j)
CLASH_FACTOR = 0.6         # clash when d < CLASH_FACTOR * (r_i + r_j)
STRETCH_FACTOR = 1.15
UNIT_PREVALENCE = 0.2
SLAVE_BOND = (0.3, 1.9)
SLAVE_OCC_TOL = 0.15
ORIENT_OCC = (0.25, 0.75)
ORIENT_CUT = 3.4
DUPLICATE_FLOOR = 0.2
SUPERPOSITION_RATIO = 0.5
COINCIDENT_CUT = 0.05
BV_NEIGHBOUR_CUT = 2.85
BV_MIN_DEFICIT = 0.15
COUPLE_DEFAULT_CUT = 2.0
SAME_DEFAULT_CUT = 1.3
CHARGE_TOL = 0.3
FIDELITY_TOL = 0.08
BROAD_SPREAD_MEV = 200.0
HULL_REF_TOL = 0.12
ON_HULL_TOL = 1e-3
MAX_ELEMENTS = 6
MAX_PRESSURE_KPA = 1000.0
MIN_ATOMS = 1.5

# ---- fixed values: formulas ---------------------------------------------------------------------
AMOUNT_TOL = 1e-8          # amounts this close to a whole number are whole
GROUP_DIFFERENCE = 1.65    # electronegativity difference below which the last two elements are a group
MOLECULES = {"LiO": "Li2O2", "NaO": "Na2O2", "KO": "K2O2", "HO": "H2O2", "CsO": "Cs2O2", "RbO": "Rb2O2",
             "O": "O2", "N": "N2", "F": "F2", "Cl": "Cl2", "H": "H2"}

# ---- fixed values: element roles ----------------------------------------------------------------
FORMERS = ("B", "C", "N", "P", "S", "Si", "As", "Se", "Te", "Ge", "Cl", "Br", "I",
           "V", "Cr", "Mo", "W", "Mn", "Re", "Nb", "Ta")
ANIONS = ("O", "N", "S", "F", "Cl", "Br", "I", "Se", "Te")
LIGANDS = ANIONS + ("H",)
LIGHT_LIGANDS = ("H", "B", "C", "N", "O", "F")
PROTON_ACCEPTORS = ("O", "N", "F", "Cl", "S", "Se")
SLAVE_RANK = {"H": 3, "O": 2}

# ---- fixed values: record formats ----------------------------------------------------------------
RECORD_VERSION = "mar-1.0"
RECORD_FILES = ("deaverage_output.json", "record.json")   # preferred name first

# ---- fixed values: vocabularies -----------------------------------------------------------------
PROBE_MODES = ("clustered", "dispersed")
CONFIDENT_STATES = ("derived", "overridden", "vacuous")
FINISHED_STATUSES = ("completed", "ok", "declined", "skipped")
GATES = ("charge", "fidelity", "connectivity", "sqs", "hull")
LEDGER_FIELDS = ("ts", "file", "status", "stage", "rundir", "klass", "confidence", "gates",
                 "verdict", "round", "escalate", "error")
VACANCY_WORDS = ("vacanc", "deficien", "defect", "non-stoich", "nonstoich")
SUBSTITUTION_WORDS = (" dop", "-dop", "substitut", "solid solution", "solid-solution")

# ---- fixed values: elements ---------------------------------------------------------------------
# symbol, atomic number, covalent radius (angstrom), Pauling electronegativity,
# lowest / highest / common oxidation state. Published tables; 0 where none is given.
_ELEMENTS = """
H 1 0.31 2.20 -1 1 1
He 2 0.28 0 0 0 0
Li 3 1.28 0.98 1 1 1
Be 4 0.96 1.57 2 2 2
B 5 0.84 2.04 -3 3 3
C 6 0.76 2.55 -4 4 4
N 7 0.71 3.04 -3 5 -3
O 8 0.66 3.44 -2 -1 -2
F 9 0.57 3.98 -1 -1 -1
Ne 10 0.58 0 0 0 0
Na 11 1.66 0.93 1 1 1
Mg 12 1.41 1.31 2 2 2
Al 13 1.21 1.61 3 3 3
Si 14 1.11 1.90 -4 4 4
P 15 1.07 2.19 -3 5 5
S 16 1.05 2.58 -2 6 -2
Cl 17 1.02 3.16 -1 7 -1
Ar 18 1.06 0 0 0 0
K 19 2.03 0.82 1 1 1
Ca 20 1.76 1.00 2 2 2
Sc 21 1.70 1.36 3 3 3
Ti 22 1.60 1.54 2 4 4
V 23 1.53 1.63 2 5 5
Cr 24 1.39 1.66 2 6 3
Mn 25 1.39 1.55 2 7 2
Fe 26 1.32 1.83 2 3 3
Co 27 1.26 1.88 2 3 2
Ni 28 1.24 1.91 2 4 2
Cu 29 1.32 1.90 1 3 2
Zn 30 1.22 1.65 2 2 2
Ga 31 1.22 1.81 2 3 3
Ge 32 1.20 2.01 2 4 4
As 33 1.19 2.18 -3 5 3
Se 34 1.20 2.55 -2 6 -2
Br 35 1.20 2.96 -1 7 -1
Kr 36 1.16 3.00 0 0 0
Rb 37 2.20 0.82 1 1 1
Sr 38 1.95 0.95 2 2 2
Y 39 1.90 1.22 3 3 3
Zr 40 1.75 1.33 2 4 4
Nb 41 1.64 1.60 2 5 5
Mo 42 1.54 2.16 2 6 6
Tc 43 1.47 1.90 4 7 7
Ru 44 1.46 2.20 2 6 3
Rh 45 1.42 2.28 3 4 3
Pd 46 1.39 2.20 2 4 2
Ag 47 1.45 1.93 1 3 1
Cd 48 1.44 1.69 2 2 2
In 49 1.42 1.78 1 3 3
Sn 50 1.39 1.96 2 4 4
Sb 51 1.39 2.05 -3 5 3
Te 52 1.38 2.10 -2 6 -2
I 53 1.39 2.66 -1 7 -1
Xe 54 1.40 2.60 0 8 0
Cs 55 2.44 0.79 1 1 1
Ba 56 2.15 0.89 2 2 2
La 57 2.07 1.10 3 3 3
Ce 58 2.04 1.12 3 4 3
Pr 59 2.03 1.13 3 4 3
Nd 60 2.01 1.14 3 3 3
Pm 61 1.99 1.13 3 3 3
Sm 62 1.98 1.17 2 3 3
Eu 63 1.98 1.20 2 3 3
Gd 64 1.96 1.20 3 3 3
Tb 65 1.94 1.10 3 4 3
Dy 66 1.92 1.22 3 3 3
Ho 67 1.92 1.23 3 3 3
Er 68 1.89 1.24 3 3 3
Tm 69 1.90 1.25 3 3 3
Yb 70 1.87 1.10 2 3 3
Lu 71 1.87 1.27 3 3 3
Hf 72 1.75 1.30 4 4 4
Ta 73 1.70 1.50 3 5 5
W 74 1.62 2.36 2 6 6
Re 75 1.51 1.90 3 7 4
Os 76 1.44 2.20 4 8 4
Ir 77 1.41 2.20 3 5 3
Pt 78 1.36 2.28 2 4 2
Au 79 1.36 2.54 1 3 3
Hg 80 1.32 2.00 1 2 2
Tl 81 1.45 1.62 1 3 1
Pb 82 1.46 2.33 2 4 2
Bi 83 1.48 2.02 3 5 3
Th 90 2.06 1.30 4 4 4
Pa 91 2.00 1.50 4 5 5
U 92 1.96 1.38 3 6 6
Np 93 1.90 1.36 3 6 5
Pu 94 1.87 1.28 3 6 4
"""

ELEMENTS = [
    (s, int(z), float(r), float(en), int(lo), int(hi), int(common))
    for s, z, r, en, lo, hi, common in (line.split() for line in _ELEMENTS.split("\n") if line)
]
ELEMENT_COLUMNS = ("symbol", "z", "radius", "electronegativity", "ox_low", "ox_high", "ox_common")


def element_table(spark):
    """The element table; a fixed number of rows, so joining it by broadcast is always safe."""
    from pyspark.sql import functions as F

    schema = ("symbol string, z int, radius double, electronegativity double, "
              "ox_low int, ox_high int, ox_common int")
    return F.broadcast(spark.createDataFrame(ELEMENTS, schema))
