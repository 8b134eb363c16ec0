"""A small store of public-domain physics relations of our own, and operators on it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (formula, name, required words): fixed values, written for this repository.
RELATIONS = (
    ("p=m*v", "momentum", ""), ("F=m*a", "net force", ""), ("W=F*d", "work of a constant force", ""),
    ("P=W/t", "mean power", ""), ("E=m*g*h", "gravitational energy", ""), ("K=m*v^2/2", "kinetic energy", ""),
    ("V=I*R", "voltage over a resistor", ""), ("P=V*I", "electric power", ""), ("Q=I*t", "charge of a current", ""),
    ("rho=m/V", "mass density", ""), ("s=v*t", "distance at constant speed", ""), ("v=u+a*t", "final speed", "acceleration"),
    ("f=1/T", "frequency", ""), ("v=f*lambda", "speed of a wave", "wave"), ("p=F/A", "pressure on an area", ""),
    ("Q=m*c*T", "heat for a change of temperature", ""), ("tau=r*F", "torque of a lever", ""), ("J=F*t", "impulse", ""),
    ("F=k*x", "spring force", "spring"), ("E=k*x^2/2", "spring energy", "spring"), ("a=v^2/r", "centripetal acceleration", ""),
    ("L=m*v*r", "angular momentum", ""), ("C=Q/V", "capacitance", ""), ("E=C*V^2/2", "energy of a capacitor", "capacitor"),
    ("n=c/v", "refractive index", ""), ("M=m/n", "molar mass", ""), ("d*x/d*t=v", "speed as a rate", ""), ("x+y=z", "sum of parts", ""),
    ("P = F * v", "power at constant speed", ""), ("eta=W/Q", "efficiency", ""),
)

#: Units that each relation declares, in the order of RELATIONS: fixed values of this repository.
DECLARED = (
    "p kg*m/s, m kg, v m/s", "F N, m kg, a m/s^2", "W J, F N, d m", "P W, W J, t s", "E J, m kg, g m/s^2, h m", "K J, m kg, v m/s",
    "V V, I A, R ohm", "P W, V V, I A", "Q C, I A, t s", "rho kg/m^3, m kg, V m^3", "s m, v m/s, t s", "v m/s, u m/s, a m/s^2, t s",
    "f Hz, T s", "v m/s, f Hz, lambda m", "p Pa, F N, A m^2", "Q J, m kg, c J/(kg*K), T K", "tau N*m, r m, F N", "J kg*m/s, F N, t s",
    "F N, k N/m, x m", "E J, k N/m, x m", "a m/s^2, v m/s, r m", "L kg*m^2/s, m kg, v m/s, r m", "C F, Q C, V V", "E J, C F, V V",
    "n 1, c m/s, v m/s", "M kg/mol, m kg, n mol", "d 1, x m, t s, v m/s", "x m, y m, z m", "P W, F N, v m/s", "eta 1, W J, Q J",
)

#: Families of quantities and the family of each unit: fixed values.
FAMILIES = (
    "Distance, area & volume", "Speed & velocity", "Acceleration", "Time & period", "Force & pressure", "Energy & work", "Power",
    "Mass & momentum", "Electricity & magnetism", "Waves & optics", "Rotation", "Heat & thermodynamics", "Ratios & dimensionless", "Definitions",
)
UNIT_FAMILY = {
    "m": 0, "m^2": 0, "m^3": 0, "m/s": 1, "m/s^2": 2, "s": 3, "N": 4, "N*m": 4, "N/m": 4, "Pa": 4, "J": 5, "W": 6, "kg": 7, "kg*m/s": 7,
    "kg/m^3": 7, "V": 8, "A": 8, "ohm": 8, "F": 8, "C": 8, "T": 8, "V/m": 8, "Hz": 9, "1/m": 9, "W/m^2": 9, "1/s": 10, "1/s^2": 10,
    "kg*m^2/s": 10, "kg*m^2": 10, "K": 11, "J/K": 11, "J/(mol*K)": 11, "1": 12, "text": 13,
}
#: Words that people use for a quantity of a unit: fixed values.
UNIT_NOUNS = {
    "m": "distance length displacement height depth width radius far", "m/s": "speed velocity fast", "m/s^2": "acceleration",
    "s": "time duration period long takes", "kg": "mass heavy weigh", "N": "force weight tension push pull", "J": "energy work heat",
    "W": "power rate", "Hz": "frequency", "1/s": "frequency rate angular", "1/s^2": "angular acceleration", "A": "current amps",
    "V": "voltage potential emf volts battery", "ohm": "resistance resistor", "C": "charge", "F": "capacitance capacitor",
    "T": "field magnetic", "V/m": "field electric", "Pa": "pressure", "K": "temperature", "J/K": "entropy", "J/(mol*K)": "heat capacity molar",
    "J/(kg*K)": "specific heat capacity", "kg*m/s": "momentum", "kg*m^2": "inertia moment", "kg*m^2/s": "angular momentum",
    "N*m": "torque moment", "N/m": "spring constant stiffness", "m^2": "area", "m^3": "volume", "kg/m^3": "density",
}


def dimension() -> tuple[list[str], list[tuple]]:
    """Columns and rows of the store with all that ranking derives from a record alone.

    It is as long as RELATIONS, so joins broadcast it.  `other_*` are the same cues of
    another record, for controls that break the association and keep the amount.
    """
    low = lambda text: re.findall("[a-z]{3,}", text.lower())
    names = [list(dict.fromkeys(low(n))) for _, n, _ in RELATIONS]
    n = len(RELATIONS)
    weight = lambda w: 16 * (n // sum(w in own for own in names)).bit_length() // 2
    told = []
    for i, (formula, name, _) in enumerate(RELATIONS):
        units = dict(x.split(" ") for x in DECLARED[i].split(", "))
        left, right = (x.strip() for x in formula.split("="))
        squeezed = formula.replace(" ", "").replace("(", "").replace(")", "")
        part = squeezed.split("=")[1]
        own = UNIT_FAMILY.get(units.get(left, ""), -1)
        families = [f for f in dict.fromkeys(UNIT_FAMILY.get(u, -1) for u in units.values()) if f >= 0]
        told.append({
            "ord": i, "formula": formula, "name": name, "lhs": left, "rhs": right, "nf": squeezed, "nr": part,
            "op": len(part) >= 3 and any(c in part for c in "*/+-^"), "free": [v for v in units if v != left], "vars": list(units), "units": list(units.values()),
            "words": names[i], "weights": [weight(w) for w in names[i]], "family": own,
            "asked": low(FAMILIES[own]) if own >= 0 else [], "mentioned": [w for f in families if f != own for w in low(FAMILIES[f])],
            "other_asked": low(FAMILIES[(own + 7) % len(FAMILIES)]) if own >= 0 else [], "other_mentioned": [w for f in families if f != own for w in low(FAMILIES[(f + 7) % len(FAMILIES)])],
            "nouns": low(UNIT_NOUNS.get(units.get(left, ""), "")), "given": ", ".join(f"{v} = {k + 2}" for k, v in enumerate(x for x in units if x != left)),
        })
    for i, row in enumerate(told):
        row["other_nouns"], row["other_terms"] = told[(i + 7) % n]["nouns"], len(told[(i + 7) % n]["words"])
    return list(told[0]), [tuple(r.values()) for r in told]


KINDS = {"ord": "long", "op": "boolean", "weights": "array<long>", "family": "long", "other_terms": "long"}
LISTS = ("free", "vars", "units", "words", "asked", "mentioned", "other_asked", "other_mentioned", "nouns", "other_nouns")


def records(spark: SparkSession) -> DataFrame:
    """`dimension` as a one-partition table."""
    names, rows = dimension()
    return spark.createDataFrame(rows, ", ".join(f"{c} {KINDS.get(c, 'array<string>' if c in LISTS else 'string')}" for c in names)).coalesce(1)


def records_sql() -> str:
    """The same rows as a SQL table expression."""

    def literal(x) -> str:
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int):
            return f"{x}::BIGINT"
        if isinstance(x, list):
            return f"[{', '.join(map(literal, x))}]" + ("::BIGINT[]" if x and isinstance(x[0], int) else "::VARCHAR[]")
        return "'" + x.replace("'", "''") + "'"

    names, rows = dimension()
    return "(VALUES " + ", ".join(f"({', '.join(map(literal, r))})" for r in rows) + f") AS rel({', '.join(names)})"


COLUMNS = "ord long, formula string, name string, req string"


def store(spark: SparkSession) -> DataFrame:
    """The store as a one-partition dimension: ord, formula, name, req."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RELATIONS)], COLUMNS).coalesce(1)


def store_sql() -> str:
    """The same rows as a SQL table expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}::BIGINT, {quote(f)}, {quote(n)}, {quote(r)})" for i, (f, n, r) in enumerate(RELATIONS)) + ") AS store(ord, formula, name, req)"


def norm_expr(c: Column) -> Column:
    """Without blanks, tabs and parentheses; case kept."""
    return F.translate(c, " \t()", "")


def lhs(formula: Column) -> Column:
    return F.trim(F.substring_index(formula, "=", 1))


def rhs(formula: Column) -> Column:
    return F.trim(F.expr("substr(formula, instr(formula, '=') + 1)") if formula is None else F.regexp_replace(formula, "^[^=]*=", ""))


def variables(formula: Column) -> Column:
    """Distinct identifiers in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(formula, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)))
